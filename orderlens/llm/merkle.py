"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses, in DataFrame functions only.

Lines are paragraphs; a section ends at the text's end or after a paragraph whose digest starts with 0 or 1 (one in eight),
so sections follow content and an edit moves no boundary elsewhere. Leaves are a paragraph's clauses, cut after a
sign that ends one, and long clauses also after words with one of some last letters, or after LONGEST characters at the latest: so a text without signs or spaces has many leaves too. A node's digest is SHA-256 of its children's; nothing of the text is left out, so equal roots mean equal texts.
A fingerprint shows the root and, section by section (;) and paragraph by paragraph (/), the first six digits of each leaf, so two
fingerprints tell which branches differ and how alike the texts are.

Defined results: a null text is the empty text, with one empty leaf; a null id counts as smaller than all others; among
rows that repeat an id (or have none) a hash of the text decides the order; with one row only, the next document is the row itself; an empty
table gives an empty result; texts of any length are cut whole; other columns are ignored by the query form and kept by merkle_fingerprints().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, whole

#: Characters of a leaf at most.
LONGEST = 40
#: A leaf ends at a space after a character that is neither letter nor digit, at one after a word that ends in e or s (one in three or four), at the paragraph's end, or where it gets too long.
LEAVES = rf".{{1,{LONGEST}}}?(?:(?<=[^\p{{L}}\p{{N}}]) |(?<=[es]) |\z)|.{{1,{LONGEST}}}"
LEAF = 6


def digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the fingerprint of a text column more."""
    _leaves, _paragraphs, _ends, _sections, _shown = free(df, "_leaves", "_paragraphs", "_ends", "_sections", "_shown")
    cut = lambda p: F.when(p == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(p, F.lit(f"(?s){LEAVES}"), F.lit(0)))
    leaves = F.transform(F.split(text, "\n", -1), lambda p: F.transform(cut(p), lambda s: F.sha2(s, 256)))
    df = df.withColumn(_leaves, leaves).withColumn(_paragraphs, F.transform(_leaves, digest))
    ends = F.filter(F.sequence(F.lit(1), F.size(_paragraphs)), lambda i: (i == F.size(_paragraphs)) | F.element_at(_paragraphs, i).rlike("^[01]"))
    df = df.withColumn(_ends, ends)
    bounds = F.transform(_ends, lambda end, k: F.struct(F.when(k == 0, 1).otherwise(F.get(_ends, k - 1) + 1).alias("first"), end.alias("last")))
    df = df.withColumn(_sections, bounds)
    part = lambda of, s: F.slice(of, s["first"], s["last"] - s["first"] + 1)
    root = digest(F.transform(_sections, lambda s: digest(part(_paragraphs, s))))
    shown = F.transform(_leaves, lambda p: F.array_join(F.transform(p, lambda h: F.substring(h, 1, LEAF)), ""))
    df = df.withColumn(_shown, shown)
    branches = F.array_join(F.transform(_sections, lambda s: F.array_join(part(_shown, s), "/")), ";")
    return df.withColumn(out, F.concat(root, F.lit(":"), branches)).drop(_leaves, _paragraphs, _ends, _sections, _shown)


def sections_of(fingerprint: str | Column) -> Column:
    return F.split(F.substring_index(fingerprint, ":", -1), ";")


def leaves_of(branches: Column) -> Column:
    """The distinct leaves of an array of branches."""
    return F.array_distinct(F.regexp_extract_all(F.array_join(branches, ";"), F.lit(f"[0-9a-f]{{{LEAF}}}"), F.lit(0)))


def with_likeness(df: DataFrame, ours: str, theirs: str, out: str) -> DataFrame:
    """df with the likeness of two fingerprint columns more: twice the shared leaves over all.

    Equal sections share all their leaves; only the leaves of sections that the other doesn't have are compared.
    """
    _a, _b, _same, _left, _right = free(df, "_a", "_b", "_same", "_left", "_right")
    df = df.withColumns({_a: sections_of(ours), _b: sections_of(theirs)})
    df = df.withColumns({_same: F.size(leaves_of(F.array_intersect(_a, _b))), _left: leaves_of(F.array_except(_a, _b)), _right: leaves_of(F.array_except(_b, _a))})
    shared = F.col(_same) + F.size(F.array_intersect(_left, _right))
    return df.withColumn(out, 2 * shared / (2 * F.col(_same) + F.size(_left) + F.size(_right))).drop(_a, _b, _same, _left, _right)


def narrowed(df: DataFrame, ours: str, theirs: str, start: str, end: str) -> DataFrame:
    """Of two array columns only what is left without the parts in common at the start and at the end; start and end tell how many these were. A column for each step, so that none is computed twice."""
    common = lambda a, b: F.coalesce(F.nullif(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False), F.lit(0)) - 1, F.least(F.size(a), F.size(b))).cast("int")
    df = df.withColumn(start, common(F.col(ours), F.col(theirs)))
    df = df.withColumns({c: F.slice(c, F.col(start) + 1, F.size(c)) for c in (ours, theirs)})
    df = df.withColumn(end, common(F.reverse(ours), F.reverse(theirs)))
    return df.withColumns({c: F.slice(c, F.lit(1), F.size(c) - F.col(end)) for c in (ours, theirs)})


def with_difference(df: DataFrame, ours: str, theirs: str, out: str) -> DataFrame:
    """df with a struct more (section, paragraph, leaf, leaves): where the first text differs from the second, from 0, and how many of its leaves are in the differing part.

    Found by descent from the root: of the sections that differ the paragraphs that differ, of these the leaves. Null where the roots are equal.
    """
    columns = free(df, "_ours", "_theirs", "_section", "_paragraph", "_leaf", "_end1", "_end2", "_end3")
    a, b, *starts = columns[:5]
    leaves = lambda branches: F.regexp_extract_all(F.array_join(branches, "/"), F.lit(f"[0-9a-f]{{{LEAF}}}"), F.lit(0))
    parts = [lambda c: F.flatten(F.transform(c, lambda x: F.split(x, "/", -1))), leaves]
    df = narrowed(df.withColumns({a: sections_of(ours), b: sections_of(theirs)}), a, b, starts[0], columns[5])
    for part, start, end in zip(parts, starts[1:], columns[6:]):
        df = narrowed(df.withColumns({c: part(F.col(c)) for c in (a, b)}), a, b, start, end)
    place = F.struct(*[F.col(c).alias(n) for c, n in zip(starts, ("section", "paragraph", "leaf"))], F.size(a).alias("leaves"))
    return df.withColumn(out, F.when(F.substring_index(ours, ":", 1) != F.substring_index(theirs, ":", 1), place)).drop(*columns)


def merkle_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a fingerprint column more, its name led by underscores where docs has one of that name. No shuffle."""
    text, out = free(docs, "_text", "fingerprint")
    return with_fingerprint(docs.withColumn(text, whole(text_col)), text, out).drop(text)


def chunk_of(bounds: list[int]) -> Column:
    """Index of the first bound that isn't below the row's id, by halving; null ids have a chunk of their own below the first."""
    held = F.array(*[F.lit(b).cast("long") for b in bounds])

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.col("id") <= F.element_at(held, middle + 1)
        return F.struct(F.when(below, s["low"]).otherwise(middle + 1).alias("low"), F.when(below, middle).otherwise(s["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length())))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds) - 1).alias("high"))
    return F.when(F.col("id").isNull(), -1).otherwise(F.aggregate(steps, start, halve)["low"])


def next_by_id(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Each row (id, tie and the carried columns) with those of the next row in descending order of id (next_*), the first after the last.

    Rows go to chunks of ids between quantiles. An id that fills a chunk or more (or null) is a chunk of its own, cut by ranges of the tie,
    a hash that orders the rows of one id. Each chunk's first row is found beforehand, by id and tie alone, and sent to the chunk
    before it as well, where it stands last; so no order over all rows is needed in one place, and no id brings its rows into one task.
    """
    # Several chunks for each shuffle partition even out what hashing deals to one; the driver holds a few numbers for each.
    chunks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("id", "tie")
    told = ids.agg(F.percentile_approx("id", [(i + 1) / chunks for i in range(chunks)], max(10_000, 20 * chunks)).alias("q"), F.max("id").alias("top"), F.count("id").alias("n"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    quantiles = sorted([*(told["q"] or []), *([told["top"]] if told["top"] is not None else [])])
    often = {b: quantiles.count(b) for b in {a for a, c in zip(quantiles, quantiles[1:]) if a == c}}
    bounds = sorted({*quantiles, *(b - 1 for b in often)})
    own = chunk_of(bounds) if bounds else F.lit(-1)
    parts = {bounds.index(b): n for b, n in often.items()} | {-1: 1 + chunks * told["nulls"] // (told["n"] + told["nulls"] or 1)}
    split = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    part = F.floor((F.shiftright("tie", 33) + (1 << 30)) * F.coalesce(F.try_element_at(split, F.col("own")), F.lit(1)) / (1 << 31)).cast("int")
    placed = lambda df: df.withColumn("own", own).withColumn("part", part)
    first = F.min(F.struct((-F.col("id")).alias("id"), "tie"))
    heads = [(r["own"], r["part"], None if r["head"]["id"] is None else -r["head"]["id"], r["head"]["tie"]) for r in placed(ids).groupBy("own", "part").agg(first.alias("head")).collect()]
    # In the order of the rows: the largest ids first, the parts of one id by tie.
    heads.sort(key=lambda h: (-h[0], h[1]))
    before = {h[:2]: heads[i - 1][:2] for i, h in enumerate(heads)}
    schema = "own int, part int, head_id long, head_tie long, to_own int, to_part int"
    table = rows.sparkSession.createDataFrame([(*h, *before[h[:2]]) for h in heads], schema)
    # One row for each chunk.
    sent = placed(rows).join(F.broadcast(table), ["own", "part"])
    is_head = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    place = lambda o, p, guest: F.struct(F.col(o).alias("own"), F.col(p).alias("part"), F.lit(guest).alias("guest"))
    both = F.array(place("own", "part", False), place("to_own", "to_part", True))
    sent = sent.select("id", "tie", *carried, F.explode(F.when(is_head, both).otherwise(F.array(place("own", "part", False)))).alias("at")).select("id", "tie", *carried, "at.*")
    order = Window.partitionBy("own", "part").orderBy("guest", F.desc_nulls_last("id"), "tie")
    follow = F.lead(F.struct(*carried)).over(order)
    return sent.repartition("own", "part").withColumn("_next", follow).where("not guest").withColumn("_next", F.coalesce("_next", F.struct(*carried))).select("id", *carried, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in carried])


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, first_change.

    The edited text has its last half replaced by as much of the next document (descending id); first_change is the section, paragraph and leaf
    where the edit shows, or null. Texts go through one shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    pairs = next_by_id(with_fingerprint(rows, "text", "fingerprint"), ["text", "fingerprint"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    pairs = pairs.select("id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    made = with_fingerprint(pairs, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    made = with_likeness(with_likeness(made, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    made = with_difference(made, "fingerprint", "edited_fingerprint", "_change")
    change = F.when(F.col("_change").isNotNull(), F.concat_ws(".", *[F.col(f"_change.{c}").cast("string") for c in ("section", "paragraph", "leaf")]))
    return made.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", change.alias("first_change"))
