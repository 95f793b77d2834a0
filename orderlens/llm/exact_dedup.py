"""Exact dedup by a tree-merge of sorted digest runs.

Each row's normalised text becomes a digest. Rows are dealt to runs by a hash of their id, and every run
is a set of (digest, survivor, count) entries sorted by digest. Rounds of a binomial tree then fold the
runs: one exchange brings ``fan_in`` neighbouring runs of a digest range together (log2(fan_in) binomial
levels at once) and one streaming pass over their sorted union merges equal digests, keeping the smaller
(or larger) identifier. A digest range is a merge unit of its own, so the root of the tree isn't one task.
The way down sends a survivor first to the runs that have its digest and then to their rows, so that one
text held by a third of all rows is spread over all runs.

Defined results: a null text is the empty text; a null id is larger than all others; rows that repeat an id and a text share one
decision and each counts in group_size, while drop_copies() lets one of them stay; of texts that differ in A-Z only, those of one id share
the decision as well, and drop_copies() lets the one stay whose text hashes lowest; an empty table gives an empty result; other columns,
whatever their names, are ignored by the query form and kept by drop_copies().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keep, marked, stay, whole

LAST = 2**63 - 1
RUN_SCHEMA = "bucket int, run int, digest string, proof long, id long, n long"
KEY = ["bucket", "run", "digest", "proof"]


def merge_sorted(batches: Iterator[pd.DataFrame], largest: bool) -> Iterator[pd.DataFrame]:
    """Merge neighbouring entries of one key in rows that come sorted by KEY; the last key of a batch waits for the next batch."""
    best, held = (np.maximum if largest else np.minimum), None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if batch.empty:
            continue
        new = np.ones(len(batch), bool)
        new[1:] = False
        for c in KEY:
            x = batch[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(new)
        out = batch.iloc[at].copy()
        out["id"] = best.reduceat(batch["id"].to_numpy(), at)
        out["n"] = np.add.reduceat(batch["n"].to_numpy(), at)
        held = out.iloc[-1:]
        if len(out) > 1:
            yield out.iloc[:-1]
    if held is not None:
        yield held


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=ascii_lower) -> DataFrame:
    """(id, key, digest, proof): proof is the length and a second hash of the text, so a digest alone decides nothing."""
    text = normalise(whole(text_col))
    proof: Column = F.xxhash64(text, F.octet_length(text))
    names = ("id", "mark", "check")
    return marked(docs.select(id_col, text_col), id_col, text_col, *names).select(*names, F.coalesce("id", F.lit(LAST)).alias("key"), F.sha2(text, 256).alias("digest"), proof.alias("proof"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_largest: bool = False, fan_in: int = 8, normalise=ascii_lower, with_marks: bool = False) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256; with_marks adds mark and check, which name the text as written."""
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs, levels = fan_in, 1
    while runs < width:
        runs, levels = runs * fan_in, levels + 1
    best = F.max if keep_largest else F.min
    rows = digests(docs, id_col, text_col, normalise)
    marks = ["mark", "check"] if with_marks else []
    rows = keep(rows.select("id", *marks, "key", "digest", "proof").withColumn("run", F.pmod(F.xxhash64("key"), F.lit(runs)).cast("int")))
    bucket = F.conv(F.substring("digest", 1, 3), 16, 10).cast("int")
    leaves = rows.groupBy("run", "digest", "proof").agg(best("key").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("bucket", bucket).select(*RUN_SCHEMA.replace(",", "").split()[::2])
    tree = leaves
    for _ in range(levels):
        tree = (
            tree.withColumn("run", (F.col("run") / fan_in).cast("int"))
            .repartition("bucket", "run")
            .sortWithinPartitions(*KEY)
            .mapInPandas(lambda batches: merge_sorted(batches, keep_largest), RUN_SCHEMA)
        )
    groups = keep(tree.where("n > 1").select("digest", "proof", F.col("id").alias("keep_key"), F.col("n").alias("group_size")))
    down = leaves.select("run", "digest", "proof").join(groups, ["digest", "proof"])
    out = rows.join(down, ["run", "digest", "proof"], "left").withColumn("keep_key", F.coalesce("keep_key", "key"))
    kept = F.when(F.col("keep_key") == LAST, F.lit(None).cast("long")).otherwise(F.col("keep_key"))
    return out.select(F.col("id").alias(id_col), kept.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("keep_key") == F.col("key")).alias("kept"), F.col("digest").alias("text_sha256"), *marks)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts."""
    rows = exact_dedup(docs, id_col, text_col, with_marks=True, **how).select(F.col(id_col).alias("id"), "mark", "check", "kept", "group_size", "text_sha256")
    # A group's kept rows have one id; where they differ as written (in A-Z), the smallest pair of hashes stays.
    several = rows.where("kept and group_size > 1")
    best = several.groupBy("text_sha256").agg(F.min(F.struct("mark", "check")).alias("best"))
    several = several.join(best, "text_sha256").withColumn("kept", F.struct("mark", "check") == F.col("best"))
    verdict = ["id", "mark", "check", "kept"]
    return stay(docs, rows.where("not kept").select(*verdict).union(several.select(*verdict)), id_col, text_col)
