"""Main text of HTML pages: suffix arrays over each host's token streams find the boilerplate, on every page, with markup to say which text is a page's own.

A page becomes a stream of tokens, block by block: the block's tag, then its words. The blocks of an article, whose text the markup settles, are one token in all, a mark of
their texts, as copies of an article are content. The streams of a host's pages are concatenated, and their suffixes sorted to a depth of `run` tokens; suffixes that
agree that far and lie in distinct pages are repeated runs, and the union of those is covered. The words of articles (without one, of the main element) are streams of their own
in a second array of the host. There a run on a few pages is a copy or a common line, and content; one on three quarters of the host's articles, of ten or more, is the
site's own (an advert or a notice without a name), and covered.

What stays: the blocks of the page's articles; without one, of its main element; without that, of the body; less the words that these runs cover. An article of which they
would take over half is a version of the host's other articles, and stays whole. Navigation, headers, footers, asides, forms, scripts, styles and elements named as
adverts, notices, comments and the like never stay.

Hosts above `slice_bytes` of HTML (or a millionth of all, if that is more) are cut into slices of that size, small ones pooled, so that no task holds a host. A cut host's distinct windows, one row for each
class of a slice's suffix array, are merged by their hash; each slice then gets the ones of its own that another page has. Of its articles' windows, a part of the host's rows gives those
on half of its articles or more, with their counts: a window on three quarters of all must come from parts with half of the articles, so nothing else can be one. What these
counts leave open, as parts below half don't tell theirs, is counted over again.

Defined results: null HTML is empty, a page without text has the empty text; a null URL or one without :// belongs to the host ""; rows that repeat an id and a
URL are one page to the count of distinct pages, and each has its row; unclosed and misnested elements are closed by the one around them; an empty table gives no rows. Pages of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keep, whole

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu"
    " nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text isn't markup; none of it is ever shown as text of the page.
RAW = frozenset("script style template noscript iframe textarea title svg math select object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside form menu dialog button head header".split())
#: Words of a class, id or role that name what isn't the page's text.
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe"
    " signup sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments respond replies disqus share sharing social related recommended widget"
    " footer header masthead topbar toolbar contentinfo complementary search".split()
)
WHOLE_PAGE = frozenset(("html", "body", "main"))
TAG = re.compile(r"""<!--(?s:.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^<>]*>""")
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: A run of an article's words is the site's, not the article's, from this share (4ths) of the host's articles, of which there must be so many.
SHARE, LEAST = 3, 10
#: Tokens of articles that one array takes before a host's next rows are sorted by another.
TOKENS = 500_000
#: What a block is, by the markup around it.
ARTICLE, MAIN, OPEN, NOT = 3, 2, 1, 0


def unwanted(name: str, attributes: str, in_article: bool) -> bool:
    """An element that can't hold the page's text, by its name and its class, id and role."""
    if name == "header" and in_article:
        return False  # an article's own header has its title
    if name in NEVER:
        return True
    if not attributes or name in WHOLE_PAGE or (name in HEADINGS and in_article):
        return False
    for m in NAMED.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "article":
            if "comment" in value.lower().split():
                return True
        elif any(p.lower() in NAMES for p in PARTS.findall(value)):
            return True
    return False


def blocks_of(html: str) -> list[tuple[int, str, str]]:
    """(what it is by markup, tag, text) of the page's blocks that have text, in page order; white space is one space."""
    out: list[tuple[int, str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, bool]] = []
    opened: Counter[str] = Counter()
    barred = pos = 0
    block = "body"

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                kind = NOT if barred else ARTICLE if opened["article"] else MAIN if opened["main"] else OPEN
                out.append((kind, block, text))

    def pop() -> None:
        nonlocal barred
        name, bars = stack.pop()
        opened[name] -= 1
        barred -= bars

    size = len(html)
    while pos < size:
        m = TAG.search(html, pos)
        if m is None:
            held.append(html[pos:])
            break
        if m.start() > pos:
            held.append(html[pos : m.start()])
        pos = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
        elif m[1]:
            if name in BLOCKS or (barred and opened[name]):
                flush()
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            if name in BLOCKS:
                block = next((n for n, _ in reversed(stack[-1:]) if n in BLOCKS), "body")
        elif name in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
                pos = end.end() if end else size
        elif name in VOID:
            if name == "hr":
                flush()
        else:
            is_block = name in BLOCKS
            if is_block:
                flush()
                if stack and stack[-1][0] == "p":
                    pop()
                if stack and stack[-1][0] == name and name in ("li", "td", "th", "tr", "dd", "dt"):
                    pop()
                block = name
            bars = unwanted(name, m[3], opened["article"] > 0)
            if is_block or bars:
                if bars and not is_block:
                    flush()
                stack.append((name, bars))
                opened[name] += 1
                barred += bars
    flush()
    return out


def tokens_of(blocks: list[tuple[int, str, str]]) -> tuple[list[str], list[int]]:
    """The page's stream, and where each block's tag lies in it."""
    stream, starts = [], []
    for settled, run in groupby(blocks, lambda b: b[0] == ARTICLE):
        run = list(run)
        if settled:
            starts += [len(stream)] * len(run)
            stream.append("=" + "\n".join(text for _, _, text in run))
            continue
        for _, tag, text in run:
            starts.append(len(stream))
            stream.append(f"<{tag}>")
            stream.extend(text.split(" "))
    return stream, starts


def own_tokens(blocks: list[tuple[int, str, str]]) -> tuple[list[str], list[int]]:
    """The stream of the text that markup says is the page's own, its articles' or else its main element's, and where each block's tag lies in it."""
    best, stream, starts = max((kind for kind, _, _ in blocks), default=NOT), [], []
    for kind, tag, text in blocks:
        starts.append(len(stream))
        if kind == best >= MAIN:
            stream.append(f"<{tag}>")
            stream.extend(text.split(" "))
    return stream, starts


def suffix_classes(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array to a depth, by doubling: the suffixes in order, and where in it classes of suffixes begin that agree to the depth."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order, reach = np.argsort(rank, kind="stable"), 1
    while reach < depth:
        step = min(reach, depth - reach)
        later = np.zeros(n, np.int64)
        later[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        changes = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank[order] = changes
        reach += step
    ranks = rank[order]
    return order, np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))


class Streams:
    """The concatenated token streams of pages of one host, a separator of its own behind each."""

    def __init__(self) -> None:
        self.vocabulary: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.page_ids: list[int] = []
        self.size = 0

    def add(self, page: int, stream: list[str]) -> None:
        known = self.vocabulary
        self.parts.append(np.fromiter((known.setdefault(t, len(known)) for t in stream), np.int64, len(stream)))
        self.page_ids.append(page)
        self.size += len(stream)

    def classes(self, depth: int):
        """codes, suffix order, class starts, first and last page of each class, and which suffixes lie whole in a page."""
        sizes = np.array([len(p) + 1 for p in self.parts])
        codes = np.concatenate([np.append(p, len(self.vocabulary) + i) for i, p in enumerate(self.parts)])
        pages = np.repeat(np.array(self.page_ids, np.int64), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes)) - 1  # tokens up to the separator
        order, starts = suffix_classes(codes, depth)
        low, high = (f.reduceat(pages[order], starts) for f in (np.minimum, np.maximum))
        return codes, order, starts, low, high, left >= depth

    def common(self, depth: int, least: int):
        """codes; the places of the windows on so many streams at least, class by class of the suffix array; where classes begin in these, and on how many streams each is."""
        sizes = np.array([len(p) + 1 for p in self.parts])
        codes = np.concatenate([np.append(p, len(self.vocabulary) + i) for i, p in enumerate(self.parts)])
        of = np.repeat(np.arange(len(sizes)), sizes)
        # A window is on no more streams than each of its tokens, so what is on fewer parts the rest and isn't sorted.
        rare = np.bincount(np.unique(codes * len(sizes) + of) // len(sizes))[codes] < least
        rare[np.cumsum(sizes) - 1] = True
        before = np.append(0, np.cumsum(rare))
        fits = np.zeros(len(codes), bool)
        fits[: max(len(codes) - depth + 1, 0)] = before[depth:] == before[:-depth]
        stay = spans(len(codes), np.flatnonzero(fits), depth)
        kept = np.flatnonzero(stay | np.append(False, stay[:-1]))
        if not len(kept):
            return codes, kept, kept, kept
        order, starts = suffix_classes(np.where(stay[kept], codes[kept], len(self.vocabulary) + len(sizes) + np.arange(len(kept))), depth)
        # The sort is stable, so a class has its suffixes stream by stream.
        places, many = kept[order], np.diff(np.append(starts, len(order)))
        new = np.append(True, of[places[1:]] != of[places[:-1]])
        new[starts] = True
        held = np.add.reduceat(new.astype(np.int64), starts)
        hit = fits[places[starts]] & (held >= least)
        return codes, places[np.repeat(hit, many)], np.cumsum(many[hit]) - many[hit], held[hit]

    def hashes(self, codes: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
        """64 bits for the window at each place, the same in every process."""
        out = np.zeros(len(at), np.uint64)
        if len(at):
            met = np.zeros(len(self.vocabulary) + len(self.parts), bool)
            for j in range(depth):
                met[codes[at + j]] = True
            marks = np.array([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") if m else 0 for t, m in zip(self.vocabulary, met)], np.uint64)
            for j in range(depth):
                out = out * np.uint64(0x9E3779B97F4A7C15) + marks[codes[at + j]]
        return out.view(np.int64)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def filled(streams: Streams, stream: list[str]) -> bool:
    """Whether an article's stream must go to another array."""
    return streams.size > 0 and streams.size + len(stream) > TOKENS


def shares(host: int, streams: Streams, depth: int) -> Iterator[pd.DataFrame]:
    """Of a part of a host's articles: the windows on half of them or more, with the number n of articles that have it and of all, and a row without a window."""
    articles = len(streams.parts)
    if articles:
        codes, places, starts, held = streams.common(depth, -(-articles // 2))
        windows = pd.array(streams.hashes(codes, places[starts], depth), "Int64")
        yield pd.DataFrame({"host": host, "window": windows, "slice": -1, "n": held, "articles": articles})
        yield pd.DataFrame({"host": host, "window": pd.array([None], "Int64"), "slice": -1, "n": 0, "articles": [articles]})


def windows_of(depth: int):
    """For rows of cut hosts: host, window, slice, a row for each class of a batch's suffix array. A page lies in one slice, so what two slices hold is in two pages.

    The articles' shares are rows of slice -1.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for host, of_host in batch.groupby("host"):
                own = Streams()
                for part, rows in of_host.groupby("slice"):
                    streams = Streams()
                    for page, html in zip(rows["page"], rows["html"]):
                        blocks = blocks_of(html)
                        streams.add(page, tokens_of(blocks)[0])
                        if stream := own_tokens(blocks)[0]:
                            if filled(own, stream):
                                yield from shares(host, own, depth)
                                own = Streams()
                            own.add(len(own.parts), stream)
                    codes, order, starts, _, _, fits = streams.classes(depth)
                    first = order[starts]
                    yield pd.DataFrame({"host": host, "window": pd.array(streams.hashes(codes, first[fits[first]], depth), "Int64"), "slice": part, "n": 0, "articles": 0})
                yield from shares(host, own, depth)

    return run


def counts_of(depth: int):
    """For rows with the windows asked of their host: host, window, the number of articles that have it."""

    def counted(host: int, streams: Streams, asked: np.ndarray) -> pd.DataFrame:
        codes, places, starts, held = streams.common(depth, 1)
        windows = streams.hashes(codes, places[starts], depth)
        hit = np.isin(windows, asked)
        return pd.DataFrame({"host": host, "window": windows[hit], "n": held[hit]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for host, rows in batch.groupby("host"):
                asked, own = np.asarray(rows["asked"].iloc[0], np.int64), Streams()
                for html in rows["html"]:
                    if stream := own_tokens(blocks_of(html))[0]:
                        if filled(own, stream):
                            yield counted(host, own, asked)
                            own = Streams()
                        own.add(len(own.parts), stream)
                if own.parts:
                    yield counted(host, own, asked)

    return run


def of_the_site(found: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """host, window: those of articles of cut hosts that lie in the share of the host's articles. Rows are the cut hosts' pages."""
    all_of = found.where("slice = -1 AND window IS NULL").groupBy("host").agg(F.sum("articles").alias("all")).where(F.col("all") >= LEAST)
    told = found.where("slice = -1 AND window IS NOT NULL").groupBy("host", "window").agg(F.sum("n").alias("n"), F.sum("articles").alias("articles"))
    # A part that doesn't tell of a window has it in less than half of its articles.
    told = keep(told.join(F.broadcast(all_of), "host").where(4 * F.col("n") + 2 * (F.col("all") - F.col("articles")) >= SHARE * F.col("all")))
    sure, open_ = told.where(4 * F.col("n") >= SHARE * F.col("all")), told.where(4 * F.col("n") < SHARE * F.col("all"))
    if open_.isEmpty():
        return sure.select("host", "window")
    asked = rows.select("host", "html").join(open_.groupBy("host").agg(F.collect_list("window").alias("asked")), "host")
    again = asked.mapInPandas(counts_of(depth), "host long, window long, n long").groupBy("host", "window").agg(F.sum("n").alias("n"))
    again = again.join(F.broadcast(all_of), "host").where(4 * F.col("n") >= SHARE * F.col("all"))
    return sure.select("host", "window").unionByName(again.select("host", "window"))


def extract_main_text(pages: DataFrame, run: int = 8, slice_bytes: int = 1 << 20) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks (all blocks with text), n_dropped (blocks that don't stay), n_covered (stream tokens in repeated runs), n_cut (stream tokens of articles in
    runs of the site, which go), a row for each page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", whole("html").alias("html"), F.xxhash64(host_of(F.col("url"))).alias("host"), F.xxhash64("page_id", "url").alias("page"))
    sizes = pages.select(F.xxhash64(host_of(F.col("url"))).alias("host"), F.octet_length(whole("html")).alias("bytes")).groupBy("host").agg(F.sum("bytes").alias("bytes"))
    sizes = keep(sizes)
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    # Fewer than a million hosts have a millionth of all bytes, so these can be broadcast.
    cut = keep(sizes.where(F.col("bytes") > max(slice_bytes, total // 1_000_000)).select("host", F.ceil(F.col("bytes") / slice_bytes).cast("long").alias("slices")))
    pools = 2 * max(1, -(-total // slice_bytes))
    dealt = rows.join(F.broadcast(cut), "host", "left")
    one = F.col("slices").isNull()
    dealt = dealt.withColumns({"slice": F.when(one, -1).otherwise(F.pmod(F.hash("page"), F.col("slices"))).cast("long"), "unit": F.when(one, F.pmod("host", F.lit(pools))).otherwise(F.col("host"))})
    of_cut = dealt.where(~one)
    both = keep(of_cut.select("host", "slice", "page", "html").mapInPandas(windows_of(run), "host long, window long, slice long, n long, articles long"))
    found = both.where("slice >= 0").select("host", "window", "slice")
    shared = found.groupBy("host", "window").agg(F.min("slice").alias("one"), F.max("slice").alias("other")).where("one <> other")
    told = found.join(shared.select("host", "window"), ["host", "window"], "left_semi").groupBy("host", "slice", "window").agg(F.lit(1).alias("n"))
    told = told.select(F.col("host").alias("unit"), "slice", "window", F.lit(False).alias("own"))
    site = of_the_site(both, of_cut, run).join(F.broadcast(cut), "host").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    told = told.unionByName(site.select(F.col("host").alias("unit"), "slice", "window", F.lit(True).alias("own")))

    def extract(key: tuple, group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, of_host in group.groupby("host", sort=False):
            parsed = [blocks_of(h) for h in of_host["html"]]
            mine, windows = known["own"].to_numpy(bool), known["window"].to_numpy()
            streams, starts, own = Streams(), [], Streams()
            asked = mine.any() if key[1] >= 0 else len(parsed) >= LEAST
            for row, (page, blocks) in enumerate(zip(of_host["page"], parsed)):
                stream, at = tokens_of(blocks)
                streams.add(page, stream)
                starts.append(at)
                own.add(row, own_tokens(blocks)[0] if asked else [])
            covered = cover(streams, run, windows[~mine])
            sites = cover_site(own, run, windows[mine] if key[1] >= 0 else None)
            end = own_end = 0
            for page_id, url, blocks, at, part, own_part in zip(of_host["page_id"], of_host["url"], parsed, starts, streams.parts, own.parts):
                flags, end = covered[end : end + len(part)], end + len(part) + 1
                site, own_end = sites[own_end : own_end + len(own_part)], own_end + len(own_part) + 1
                if 2 * site.sum() > len(site):
                    site = np.zeros(len(site), bool)
                lines = main_lines(blocks, at, flags, site)
                text = "\n".join(lines)
                out.append((page_id, url, text, len(text), len(blocks), len(blocks) - len(lines), int(flags.sum()), int(site.sum())))
        made = pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars", "n_blocks", "n_dropped", "n_covered", "n_cut"])
        made["page_id"] = pd.array(made["page_id"].tolist(), dtype="object")
        return made

    left = dealt.select("unit", "slice", "host", "page", F.col("page_id").cast("string").alias("page_id"), "url", "html").groupBy("unit", "slice")
    out = left.cogroup(told.groupBy("unit", "slice")).applyInPandas(extract, "page_id string, url string, text string, n_chars long, n_blocks long, n_dropped long, n_covered long, n_cut long")
    return out.withColumn("page_id", F.col("page_id").cast(kind))


def spans(size: int, at: np.ndarray, depth: int) -> np.ndarray:
    """For each of so many tokens whether a window of the depth that begins at one of the places covers it."""
    begins = np.zeros(size + 1, np.int64)
    begins[at] += 1
    begins[at + depth] -= 1
    return np.cumsum(begins[:-1]) > 0


def cover(streams: Streams, depth: int, known: np.ndarray) -> np.ndarray:
    """For each token whether a run of the depth that distinct pages share covers it; known are hashes of windows that pages of other slices share."""
    codes, order, starts, low, high, fits = streams.classes(depth)
    first = order[starts]
    hit = (low != high) & fits[first]
    if len(known):
        asked = np.flatnonzero(fits[first] & ~hit)
        hit[asked] = np.isin(streams.hashes(codes, first[asked], depth), known)
    return spans(len(codes), order[np.repeat(hit, np.diff(np.append(starts, len(order))))], depth)


def cover_site(streams: Streams, depth: int, known: np.ndarray | None) -> np.ndarray:
    """For each token of articles whether a run of the site covers it: by count over the whole host's articles or, of a slice, by the hashes that all slices' counts gave."""
    articles = sum(len(p) > 0 for p in streams.parts)
    if articles < LEAST if known is None else not len(known):
        return np.zeros(sum(len(p) + 1 for p in streams.parts), bool)
    if known is None:
        codes, places, _, _ = streams.common(depth, -(-SHARE * articles // 4))
    else:
        codes, places, starts, _ = streams.common(depth, 1)
        hit = np.isin(streams.hashes(codes, places[starts], depth), known)
        places = places[np.repeat(hit, np.diff(np.append(starts, len(places))))]
    return spans(len(codes), places, depth)


def main_lines(blocks: list[tuple[int, str, str]], starts: list[int], covered: np.ndarray, site: np.ndarray | None = None) -> list[str]:
    """The lines of the main text: what runs leave of the blocks that markup puts first, runs of the site of an article or a main element, else repeated runs of the open blocks."""
    best = max((kind for kind, _, _ in blocks), default=NOT)
    if best == NOT:
        return []
    if best >= MAIN:
        starts = own_tokens(blocks)[1]
        covered = np.zeros(0, bool) if site is None else site
    lines = []
    for (kind, _, text), at in zip(blocks, starts):
        if kind == best:
            words = text.split(" ")
            gone = covered[at + 1 : at + 1 + len(words)]
            if gone.any():
                text = " ".join(w for w, g in zip(words, gone) if not g)
            if text:
                lines.append(text)
    return lines
