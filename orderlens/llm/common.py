"""What the operators of this subpackage share: the shared scratch folder and small text helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes outside the six ASCII white-space characters; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Paths of the tables in the shared folder that this program wrote.
KEPT: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local folder on one machine; a cluster must name one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="orderlens-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def keep(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again, so that lost executors cost no recomputation.

    instead_of is a kept table that nothing but df reads; it is deleted once df is written.
    """
    path = f"{scratch(df.sparkSession)}/orderlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    KEPT.append(path)
    if instead_of is not None:
        release(df.sparkSession, [instead_of.kept_at])
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete tables that keep() wrote in this program (all, or those at the paths), once no result that reads them is needed; how many there were."""
    gone = [p for p in KEPT if paths is None or p in paths]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        KEPT.remove(name)
    return len(gone)


def spread_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, size: str | None = None, share: int = 1000, least: int = 10_000, most_bytes: int = 32 << 20) -> DataFrame:
    """rows joined to a table with one row for each key, so that a key with many rows isn't one task's.

    counts has the number n of rows of each key. Keys with over a share of all rows (and enough rows to matter to a task) are fewer than that share's inverse; their
    rows of the table go to all tasks, where they are small (column size, if its values vary); the others meet by key. The result is the same either way.
    """
    told = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    enough = max(told["total"] / share, least)
    if told["most"] <= enough:
        return rows.join(table, key)
    hot = table.join(counts.where(F.col("n") > enough).select(key), key)
    length = F.octet_length(size) if size else F.lit(64)
    if (hot.agg(F.sum(length + 64)).first()[0] or most_bytes + 1) > most_bytes:
        return rows.join(table, key)
    hot = keep(hot)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key))


def whole(text: str | Column) -> Column:
    """The text, a null one as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave all other letters."""
    return F.translate(text, UPPER, UPPER.lower())


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df doesn't have, as near to the wanted ones as can be."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def same(left: Column, right: Column) -> Column:
    """Equality where null equals null."""
    return left.eqNullSafe(right)


def marked(docs: DataFrame, id_col: str, text_col: str, *names: str) -> DataFrame:
    """docs with three columns more, which together name a row's id and text: the id as a long, and two hashes of the text."""
    text = whole(docs[text_col])
    return docs.withColumns(dict(zip(names, (docs[id_col].cast("long"), F.xxhash64(text, F.octet_length(text)), F.hash(text)))))


def stay(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that stay, by verdicts (id, mark, check, kept: a row for each row of docs, marked() as there).

    Ids alone don't decide, as they can repeat or be null. Of rows that repeat an id and a text one stays.
    """
    key = ["id", "mark", "check"]
    names = free(docs, *(f"key_{k}" for k in key))
    told = verdicts.groupBy(*key).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    told = keep(told.select(*[F.col(k).alias(n) for k, n in zip(key, names)], "kept"))
    rows, match = marked(docs, id_col, text_col, *names), lambda t: [F.col(f"d.{n}").eqNullSafe(F.col(f"t.{n}")) for n in names]
    gone, twice = told.where("not kept").select(*names), told.where("kept").select(*names)
    left = rows.alias("d").join(gone.alias("t").hint("shuffle_hash"), match("t"), "left_anti")
    if not twice.isEmpty():
        once = left.alias("d").join(twice.alias("t"), match("t"), "left_semi").dropDuplicates(names)
        left = left.alias("d").join(twice.alias("t"), match("t"), "left_anti").unionByName(once)
    return left.drop(*names)
