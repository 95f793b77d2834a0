"""HTML extraction, conversation repair and whitening, against plain versions."""

import functools
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from orderlens.llm import conversations, pages, queries, whitening

SF = "/root/testdata/sf0.01"

# --- pages


class Plain(HTMLParser):
    """The blocks of an article by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.raw, self.blocks, self.held = False, False, [], []

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text and self.inside:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article", "footer"):
            self.flush()
        if tag == "article":
            self.inside = True
        if tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.flush()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        self.held.append(data)


def test_articles_of_the_whole_table(spark):
    got = queries.op11_html(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows) and len({r["page_id"] for r in got}) == len(rows)
    html = {r["page_id"]: r for r in rows}
    for r in got:
        plain = Plain()
        plain.feed(html[r["page_id"]]["html"])
        plain.close()
        assert r["text"] == "\n".join(plain.blocks) and r["n_chars"] == len(r["text"]) and r["url"] == html[r["page_id"]]["url"]


def texts(spark, rows, **more):
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, host string, slice int")
    return {(r["page_id"], r["url"]): r["text"] for r in pages.extract_main_text(df, **more).collect()}


SHARED = "this long line of the site stands on every page of it and says nothing"


@pytest.mark.parametrize("slice_bytes", [1 << 20, 300])
def test_what_markup_leaves_open_is_settled_by_repeated_runs(spark, slice_bytes):
    """Whole hosts and hosts cut into slices give the same."""
    rows = [(i, f"http://a.org/{i}", f"<body><div>{SHARED}</div><div>{' '.join(f'p{i}w{j}' for j in range(12))}</div><div>{SHARED} edition{i} differs</div></body>") for i in range(20)]
    rows += [(100, "http://b.org/", f"<div>{SHARED}</div><p>alone</p>"), (101, "http://c.org/1", f"<p>{SHARED}</p>"), (101, "http://c.org/1", f"<p>{SHARED}</p>")]
    got = texts(spark, rows, slice_bytes=slice_bytes)
    for i in range(20):
        assert got[i, f"http://a.org/{i}"] == f"{' '.join(f'p{i}w{j}' for j in range(12))}\nedition{i} differs"
    assert got[100, "http://b.org/"] == f"{SHARED}\nalone"  # another host's page repeats it
    assert got[101, "http://c.org/1"] == SHARED  # a repeated row is no distinct page


def articles_of(n, line_on, tag="article"):
    """Pages of a host with articles of their own words; a line without a name stands among them on those asked for."""
    line = f"<p>{SHARED}</p>"
    own = lambda i, k: f"<p>{' '.join(f'p{i}{k}w{j}' for j in range(15))}</p>"
    return [(i, f"http://a.org/{i}", f"<nav>n</nav><{tag}>{own(i, 'a')}{line if line_on(i) else ''}{own(i, 'b')}</{tag}><p>outside {i}</p>") for i in range(n)]


def cut_from(rows, got):
    """Pages whose text is their own two lines, with the shared line between them gone."""
    own = {i: [" ".join(f"p{i}{k}w{j}" for j in range(15)) for k in "ab"] for i, _, _ in rows}
    for i, u, h in rows:
        assert got[i, u] in ("\n".join(own[i]), f"{own[i][0]}\n{SHARED}\n{own[i][1]}")
    return {i for i, u, h in rows if SHARED in h and SHARED not in got[i, u]}


@pytest.mark.parametrize("slice_bytes", [1 << 20, 900])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_runs_of_the_site_leave_articles(spark, slice_bytes, tag):
    """A line without a name on three quarters of a host's articles isn't the articles'; on fewer, on few pages and in copies it is content."""
    rows = articles_of(40, lambda i: i % 4, tag)
    assert cut_from(rows, texts(spark, rows, slice_bytes=slice_bytes)) == {i for i in range(40) if i % 4}
    rows = articles_of(40, lambda i: i % 4 and i > 1, tag)
    assert cut_from(rows, texts(spark, rows, slice_bytes=slice_bytes)) == set()
    rows = articles_of(9, lambda i: True, tag)
    assert cut_from(rows, texts(spark, rows, slice_bytes=slice_bytes)) == set()
    copies = [(i, f"http://a.org/{i}", f"<{tag}><h1>One</h1><p>{SHARED} and {SHARED}</p></{tag}>") for i in range(30)]
    assert set(texts(spark, copies, slice_bytes=slice_bytes).values()) == {f"One\n{SHARED} and {SHARED}"}


@pytest.mark.parametrize("last, gone", [(3, True), (1, True), (0, False)])
def test_shares_of_parts_below_half_are_counted_again(spark, last, gone):
    """Of four parts of ten articles 10, 10 and 9 have the line; the fourth doesn't tell, and 30 of 40 decide."""
    has = {0: 10, 1: 10, 2: 9, 3: last}
    rows = articles_of(40, lambda i: i % 10 < has[i // 10])
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "page_id long, url string, html string")
    got = {(r["page_id"], r["url"]): r["text"] for r in pages.extract_main_text(df, slice_bytes=900).collect()}
    assert cut_from(rows, got) == ({i for i, _, h in rows if SHARED in h} if gone else set())


def brute_cover(streams, depth):
    """Tokens covered by windows of the depth that lie in streams of distinct pages."""
    places = defaultdict(set)
    for page, stream in streams:
        for i in range(len(stream) - depth + 1):
            places[tuple(stream[i : i + depth])].add(page)
    out = []
    for _, stream in streams:
        hit = set()
        for i in range(len(stream) - depth + 1):
            if len(places[tuple(stream[i : i + depth])]) > 1:
                hit.update(range(i, i + depth))
        out.append(sorted(hit))
    return out


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8])
def test_suffix_array_covers_what_brute_force_covers(depth):
    rng = random.Random(depth)
    for _ in range(40):
        streams = [(rng.randrange(4), [rng.choice("abc") for _ in range(rng.randrange(0, 25))]) for _ in range(rng.randrange(1, 8))]
        s = pages.Streams()
        for page, stream in streams:
            s.add(page, stream)
        covered, end, got = pages.cover(s, depth, np.array([], np.int64)), 0, []
        for _, stream in streams:
            got.append(np.flatnonzero(covered[end : end + len(stream)]).tolist())
            end += len(stream) + 1
        assert got == brute_cover(streams, depth)


@pytest.mark.parametrize("depth", [1, 2, 3, 8])
def test_common_windows_are_those_of_brute_force(depth):
    rng = random.Random(depth)
    for _ in range(60):
        streams = [[rng.choice("aaabcdef"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(0, 30))] for _ in range(rng.randrange(1, 9))]
        least, s, held, places = rng.randrange(1, 6), pages.Streams(), defaultdict(set), defaultdict(set)
        at = 0
        for k, stream in enumerate(streams):
            s.add(k, stream)
            for i in range(len(stream) - depth + 1):
                held[tuple(stream[i : i + depth])].add(k)
                places[tuple(stream[i : i + depth])].add(at + i)
            at += len(stream) + 1
        _, found, starts, n = s.common(depth, least)
        got = sorted((sorted(p.tolist()), k) for p, k in zip(np.split(found, starts[1:]), n.tolist()))
        assert got == sorted((sorted(places[w]), len(held[w])) for w in held if len(held[w]) >= least)


def test_slices_count_as_one_host(spark):
    """n_covered of a host cut into slices against brute force over the whole host."""
    rng = random.Random(3)
    html = [f"<div>{' '.join(rng.choice('abc') for _ in range(rng.randrange(5, 40)))}</div><p>{' '.join(rng.choice('abcd') for _ in range(12))}" for _ in range(60)]
    df = spark.createDataFrame([(i, "http://a.org/" + str(i), h) for i, h in enumerate(html)], "page_id long, url string, html string")
    wanted = [len(x) for x in brute_cover([(i, pages.tokens_of(pages.blocks_of(h))[0]) for i, h in enumerate(html)], 6)]
    for size in (1 << 20, 500):
        got = {r["page_id"]: r["n_covered"] for r in pages.extract_main_text(df, run=6, slice_bytes=size).collect()}
        assert [got[i] for i in range(60)] == wanted


def test_markup():
    line = lambda h: "\n".join(pages.main_lines(b := pages.blocks_of(h), pages.tokens_of(b)[1], np.zeros(10_000, bool)))
    assert line("") == line("<!-- <p>x</p> -->") == line("<script>var a='<p>no</p>'</script><style>p{}</style><title>t</title>") == ""
    assert line("<p>a <b>b</b>c&amp;d &lt;p&gt; &#233; &copy 1<p>x\n\n y<br>z") == "a bc&d <p> é © 1\nx y z"
    article = "<nav>n</nav><article><header><h1>T</h1></header><div class='ad-box'>buy</div><p>one<p>two <aside>side</aside><form>f<input></form><section id=comments><article>no</article></section><ul><li>x<li>y</ul></article><footer>f</footer>"
    assert line(article) == "T\none\ntwo\nx\ny"
    assert line("<main><p>a</p></main><p>b") == "a" and line("<div><p>b</div></div></p><span class=advert>c</span>d") == "b\nd"
    assert line("<p>1 < 2 and <3 <p class='cookieNotice'>c<p>d<table><tr><td>e<td>f</table>") == "1 < 2 and <3\nd\ne\nf"
    assert line("<article>" + "<div>" * 5000 + "deep" + "</span>" * 5000) == "deep" and line("<p a='" + "<p b=\"" * 3000 + "x") != ""
    assert line("<article><p>an unclosed quote <a href=\"x>y</a> z</p></article>").startswith("an unclosed quote")


def test_odd_pages(spark):
    rows = [(1, "http://a.org", None), (1, "http://a.org", None), (None, None, "<p>x"), (2, None, ""), (3, "no host", "<p>x"), (4, "http://b.org", "<p>" + "word " * 400_000)]
    df = spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], "page_id long, url string, html string, host string, slice int, text string")
    out = pages.extract_main_text(df).collect()
    assert Counter(r["page_id"] for r in out) == Counter(i for i, _, _ in rows)
    assert {r["page_id"]: r["n_chars"] for r in out} == {1: 0, None: 1, 2: 0, 3: 1, 4: 5 * 400_000 - 1}
    assert pages.extract_main_text(df.limit(0)).count() == 0


# --- conversations


STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def cheapest(rows):
    """Cost, audit and repaired turns, from the end back: the least (cost, whole rest of the audit) of each place and state; rows are (role, text, fault)."""

    @functools.cache
    def rest(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def option(price, letter, role, text, at, inserted=0):
            if role is not None and (state, role[:1]) not in STEP:
                return
            after = rest(at, state if role is None else STEP[state, role[:1]], inserted)
            if after:
                found.append((price + after[0], letter + after[1], ((role, text), *after[2]) if role is not None else after[2]))

        for role in ("user", "assistant"):
            if inserted < 4:
                option(2, "I", role, "", i, inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            option(3, "D", None, None, i + 1)
            if fault in ("", "truncated"):
                extra = int(fault == "truncated")
                option(extra, "K", role, text, i + 1)
                option(2 + extra, "R", "user", text, i + 1)
                option(2 + extra, "R", "assistant", text, i + 1)
        return min(found, default=None)

    return rest(0, 0, 0)


def plain_conversation(rows):
    """rows of one conversation as (conv_id, turn, role, text): what op12 returns."""
    after = []
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        role, text, kind = name(role), name(text), zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        after += [(turn, role, text)] * (2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, marked, white = set(), [], " \t\n\x0b\x0c\r"
    for _, role, text in after:
        solid = text.strip(white)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = [t for t, _, _ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = Counter(f for _, _, f in marked)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    cost, audit, repaired = cheapest(marked)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest), repaired


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def by_conversation(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(tuple(r)[:4])
    return out


def test_conversations_of_the_whole_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    wanted = {k: plain_conversation(v)[0] for k, v in by_conversation(table.collect()).items()}
    got = queries.op12_conversations(spark, SF).collect()
    assert len(got) == len(wanted) and {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in got} == wanted


def test_odd_conversations(spark):
    rng = random.Random(12)
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant", "sys", "agent"]
    said = ["Yes.", "No!", "why", "", None, " \n", "x ", "Yes.", "q? ", "\u0085", "a.  "]
    rows = [(rng.choice([None, *range(300)]), rng.choice([None, *range(7)]), rng.choice(roles), rng.choice(said), 1, "x") for _ in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mark int, twin string").repartition(5)
    damaged = conversations.damaged(df)
    wanted = {k: plain_conversation(v) for k, v in by_conversation(rows).items()}
    got = conversations.repair_conversations(damaged).collect()
    assert len(got) == len(wanted) and {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in got} == {k: v[0] for k, v in wanted.items()}
    turns = defaultdict(list)
    for r in sorted(conversations.repaired_conversations(damaged).collect(), key=lambda r: r["turn"]):
        turns[r["conv_id"]].append((r["role"], r["text"]))
    assert turns == {k: list(v[1]) for k, v in wanted.items() if v[1]}
    assert conversations.repair_conversations(conversations.damaged(df.limit(0))).count() == 0


def test_layers_against_search():
    rng = random.Random(4)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), "x", rng.choice(["", "", "", "truncated", "blank"])) for _ in range(rng.randrange(0, 9))]
        codes = bytes(max(0, "-sua".find(r[0])) | conversations.FAULTS.index(f) << 2 for r, _, f in rows)
        assert conversations.repair(codes) == cheapest(rows)[:2]


def test_long_conversation_is_linear():
    rng = random.Random(5)
    codes = bytes(rng.choice([1, 2, 3, 2, 3, 14, 7]) for _ in range(30_000))
    cost, audit = conversations.repair(codes)
    assert sum(c != "I" for c in audit) == 30_000 and cost == sum({"K": 0, "D": 3, "I": 2, "R": 2}[c] for c in audit) + sum(codes[i] >> 2 == 3 and c in "KR" for i, c in enumerate(a for a in audit if a != "I"))


def test_undamaged(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in conversations.repair_conversations(conversations.as_given(df)).collect()}
    assert got == {1: (0, "KK"), 2: (2, "KI")}


# --- whitening


def plain_whitening(vectors, most=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    c = x - sums / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:most], basis[:, ::-1][:, :most]
    return n, deviation, c @ basis / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whitening_of_the_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, explained = plain_whitening([r["embedding"] for r in table])
    place = {r["vec_id"]: i for i, r in enumerate(table)}
    got = queries.op13_whitening(spark, SF).toPandas()
    assert len(got) == n * 32 and (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    assert not got.duplicated(["vec_id", "component"]).any() and set(got["component"]) == set(range(1, 33))
    rows, cols = got["vec_id"].map(place).to_numpy(), got["component"].to_numpy() - 1
    assert (np.array(deviation)[rows] == got["deviation"]).all() and np.allclose(explained[cols], got["explained"], rtol=1e-10)
    mine = np.zeros((n, 32))
    mine[rows, cols] = got["whitened"]
    signs = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine, white * signs, atol=1e-8)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_merged_states_are_the_whole(spark, parts):
    rng = np.random.default_rng(parts)
    x = rng.normal(size=(300, 5)) * [1e-3, 1, 10, 100, 1000] + 1e5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(parts)
    n, sums, mean, scatter = whitening.tree_state(df, lambda b: np.vstack(b["embedding"].to_numpy()))
    assert n == 300 and np.allclose(mean, x.mean(axis=0)) and np.allclose(scatter, np.cov(x.T, bias=True) * 300, rtol=1e-6)
    got = whitening.whiten(df, components=3)
    assert got.count() == 900 and got.first()["identity_error"] < 1e-6


def test_odd_vectors(spark):
    good = [[0.5, -1.0, 2.0], [0.5, 1.0, 2.0], [1.5, 3.0, -2.0], [1.5, 3.0, -2.0]]
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0]]
    rows = [(i if i != 1 else None, v, 1, "x") for i, v in enumerate([*good, *odd])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, whitened string").repartition(4)
    out = whitening.whiten(df)
    got = out.collect()
    _, deviation, _, _ = plain_whitening(good)
    assert Counter(r["vec_id"] for r in got) == {0: 3, None: 3, 2: 3, 3: 3} and {r["vec_id"]: r["deviation"] for r in got} == {0: deviation[0], None: deviation[1], 2: deviation[2], 3: deviation[3]}
    assert {r["whitened"] for r in got if r["component"] == 3} == {0.0} and got[0]["identity_error"] < 1e-9 and math.isclose(sum({r["component"]: r["explained"] for r in got}.values()), 1)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 0")).where("whitened <> 0 or explained <> 0").count() == 0
    assert whitening.whiten(df.where("vec_id = 0")).columns == whitening.whiten(df.limit(0)).columns == out.columns
