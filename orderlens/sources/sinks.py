"""Sinks: Parquet keeps values whole; CSV is for people, with numbers as text of fixed precision."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def number_text(x: float | None, digits: int) -> str | None:
    """Of that many significant digits, without trailing zeros."""
    return None if x is None else f"{x:.{digits}g}"


def write_summary(df: DataFrame, path: str, digits: int = 12) -> None:
    """A summary (a row for each rank, stage or book) as one CSV file with a header."""

    @F.pandas_udf("string")
    def show(x: pd.Series) -> pd.Series:
        return x.map(lambda v: number_text(None if pd.isna(v) else v, digits))

    shown = [show(F.col(c).cast("double")).alias(c) if kind in ("double", "float") else F.col(c).cast("int").alias(c) if kind == "boolean" else F.col(c) for c, kind in df.dtypes]
    df.select(*shown).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_calibration(losses: DataFrame, moments: DataFrame, folder: str) -> None:
    """All candidates with their losses, the best one, and its moments, each as a table of its own."""
    write_table(losses, f"{folder}/candidates")
    best = losses.orderBy("loss", "candidate_id").limit(1)
    write_summary(best, f"{folder}/best")
    write_summary(moments.join(best.select("candidate_id"), "candidate_id", "left_semi").orderBy("name"), f"{folder}/best_moments")


def append_stream(df: DataFrame, path: str, checkpoint: str):
    """A streaming table appended as Parquet, exactly once."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
