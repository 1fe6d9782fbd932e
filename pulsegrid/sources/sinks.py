"""Sinks: partitioned tables, summaries, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_frames(rows: DataFrame, path: str) -> None:
    """One table partitioned by fold, not a file per video."""
    rows.repartition("fold", "video_id").write.mode("overwrite").partitionBy("fold").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    as_json(rows).write.mode("overwrite").text(path)
