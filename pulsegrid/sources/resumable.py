"""A partitioned table that is written batch by batch and can be resumed after a break.

Every batch of videos is one partition, and a small log beside the table says what was planned
and what is done, a row per video. A batch is planned before it is computed and marked done
after it is written, so a broken run leaves a planned batch: the next run computes the same
videos again and overwrites that partition alone. Readers see the batches that are done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "video_id string, batch long, state string, n_rows long"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's rows; none before the first run."""
    return spark.read.schema(LOG).parquet(f"{path}/log") if _exists(spark, f"{path}/log") else spark.createDataFrame([], LOG)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, batch, state, n_rows): a row per video, ``done`` where any run has finished it."""
    done = F.max(F.when(F.col("state") == "done", F.struct("batch", "n_rows")))
    rows = read_log(spark, path).groupBy("video_id").agg(done.alias("d"), F.max("batch").alias("planned"))
    return rows.select("video_id", F.coalesce("d.batch", "planned").alias("batch"), F.when(F.col("d").isNotNull(), "done").otherwise("planned").alias("state"), F.col("d.n_rows").alias("n_rows"))


def write_resumable(videos: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, batches: int = 16) -> list[int]:
    """Computes and writes the videos that no earlier run has finished; gives the numbers of the batches written.

    ``videos`` holds ``video_id`` (null ids are left out, repeated ones count once); ``compute`` makes
    their rows, with ``video_id``, from some of them. New videos are dealt to ``batches``
    new batches by a hash of their ids; videos planned before stay in theirs. A video without rows is
    done with 0 rows. ``compute`` must not give rows of other videos.
    """
    spark = videos.sparkSession
    if batches < 1:
        raise ValueError("a run needs a batch at least")
    known = progress(spark, path)
    last = known.agg(F.max("batch")).first()[0]
    first = 0 if last is None else last + 1
    fresh = videos.where("video_id IS NOT NULL").select("video_id").distinct().join(known.select("video_id"), "video_id", "left_anti")
    planned = fresh.select("video_id", (F.lit(first) + F.pmod(F.xxhash64("video_id"), F.lit(batches))).alias("batch"), F.lit("planned").alias("state"), F.lit(None).cast("long").alias("n_rows"))
    planned.write.mode("append").parquet(f"{path}/log")
    # a broken run's batches and this one's: the number of runs times ``batches`` at most
    open_ = [r["batch"] for r in progress(spark, path).where("state = 'planned'").select("batch").distinct().orderBy("batch").collect()]
    for batch in open_:
        own = progress(spark, path).where((F.col("batch") == batch) & (F.col("state") == "planned")).select("video_id")
        rows = compute(own).withColumn("batch", F.lit(batch).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/rows")
        written = read_rows(spark, path, [batch], rows.schema).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
        done = own.join(written, "video_id", "left").select("video_id", F.lit(batch).cast("long").alias("batch"), F.lit("done").alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))
        done.write.mode("append").parquet(f"{path}/log")
    return open_


def read_rows(spark: SparkSession, path: str, batches: list[int], schema: T.StructType) -> DataFrame:
    """The rows of some batches; other partitions are not listed as input."""
    if not _exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/rows").where(F.col("batch").isin(batches))


def read_resumable(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What is done; ``schema`` is that of the computed rows."""
    whole = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*whole.fields, T.StructField("batch", T.LongType())])
    done = [r["batch"] for r in progress(spark, path).where("state = 'done'").select("batch").distinct().collect()]
    return read_rows(spark, path, done, whole).drop("batch")
