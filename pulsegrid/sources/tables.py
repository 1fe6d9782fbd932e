"""Sources: manifests, frame tables, feature orders, image folders, resumable inputs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.config import FEATURES, LABELS
from pulsegrid.functions.scalars import frame_step, lookup

MANIFEST_COLUMNS = ("video_id", "fold", "part", "subject_id", "score_label", "video_path")

#: The fixture: each user of the events table as one video (identical text runs in DuckDB).
FRAMES_SQL = """
WITH b AS (
  SELECT user_id AS u, event_type AS et, value AS val,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i
  FROM {events})
SELECT concat('V', lpad(CAST(u AS VARCHAR(12)), 5, '0'))                        AS video_id,
       concat('Fold', CAST(CAST(floor(u / 3) AS BIGINT) % 4 + 1 AS VARCHAR(3))) AS fold,
       CASE WHEN u % 2 = 0 THEN 'part1' ELSE 'part2' END                        AS part,
       CAST(CAST(floor(u / 3) AS BIGINT) AS VARCHAR(12))                        AS subject_id,
       CASE u % 3 WHEN 0 THEN '0' WHEN 1 THEN '5' ELSE '10' END                 AS score_label,
       CAST(i AS BIGINT)                                                        AS processed_idx,
       CAST(i * 2 AS BIGINT)                                                    AS frame_idx,
       CAST(i * 2 AS DOUBLE) / CAST(30 AS DOUBLE)                               AS timestamp,
       CASE WHEN et <> 'error' THEN 1 ELSE 0 END                                AS face_detected,
       CASE WHEN et <> 'error' THEN CAST(0.2 AS DOUBLE) + val / CAST(1000 AS DOUBLE) END AS mean_ear,
       CASE WHEN et <> 'error' THEN CAST(k AS DOUBLE) / CAST(100 AS DOUBLE) END AS mar,
       CASE WHEN et <> 'error' THEN CAST(k - 50 AS DOUBLE) / CAST(CASE WHEN u % 3 = 0 AND i >= 24 THEN 40 ELSE 10 END AS DOUBLE) END AS pitch,
       CASE WHEN et <> 'error' THEN CAST(k - 50 AS DOUBLE) / CAST(CASE WHEN u % 3 = 0 AND i >= 24 THEN 80 ELSE 20 END AS DOUBLE) END AS yaw,
       CASE WHEN et <> 'error' THEN CAST(50 - k AS DOUBLE) / CAST(CASE WHEN u % 3 = 0 AND i >= 24 THEN 160 ELSE 40 END AS DOUBLE) END AS roll,
       CASE WHEN et <> 'error' THEN CAST(CASE u % 3
            WHEN 0 THEN CASE WHEN i BETWEEN 4 AND 9 THEN 1 ELSE 0 END
            WHEN 1 THEN CASE WHEN i % 18 < 6 THEN 1 ELSE 0 END
            ELSE CASE WHEN CAST(floor(i / 40) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END END AS DOUBLE) END AS p_closed
FROM b
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FRAMES_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


#: Frames that a task holds at most on average: some ten sorts over them in one stage stay below 1 GB.
FRAMES_A_TASK = 50_000
#: Fewer are not worth a task.
LEAST_FRAMES = 5_000


def tasks(frames: DataFrame) -> int:
    """Into how many tasks windows over the frames are dealt: as many as the frames ask for.

    Left to itself, adaptive execution joins shuffled blocks by their compressed bytes, and the sorts
    over one task's rows take over fifty times as much memory.
    """
    n, own = frames.count(), int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n // FRAMES_A_TASK), min(own, n // LEAST_FRAMES))


def videos(rows: DataFrame) -> DataFrame:
    """The manifest behind a frame table: one row per video, in the order of ids."""
    return rows.select("video_id", "fold", "part", "subject_id", "score_label").distinct()


def label_manifest(manifest: DataFrame) -> DataFrame:
    """Adds label, label_id and original_label; rows of unmapped scores go."""
    score = F.col("score_label")
    named = manifest.withColumns(
        {
            "label": lookup(score, [(s, n) for s, n, _, _ in LABELS]),
            "label_id": lookup(score, [(s, i) for s, _, i, _ in LABELS]),
            "original_label": lookup(score, [(s, o) for s, _, _, o in LABELS]),
        }
    )
    return named.where("label IS NOT NULL")


#: Ranges of the order in the numbering of repeated ids.
RANGES = 1024


def unique_ids(manifest: DataFrame, order: str) -> DataFrame:
    """The nth repeat of a video id gets the suffix ``_dup{n}``; ``order`` is a whole number.

    Repeats are counted in two levels, so that an id with very many is no single task: by id and
    range of the order, whose counts are summed up over the ranges, and then within a range.
    """
    ends = manifest.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, width = (ends.lo or 0), max(1, -(-((ends.hi or 0) - (ends.lo or 0) + 1) // RANGES))
    part = F.coalesce(F.floor((F.col(order) - F.lit(lo)) / F.lit(width)), F.lit(-1))
    rows = manifest.withColumn("__p", part)
    counts = rows.groupBy(F.col("video_id").alias("__v"), F.col("__p").alias("__q")).agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("__v").orderBy("__q")) - F.col("__c")
    nth = F.row_number().over(Window.partitionBy("video_id", "__p").orderBy(order))
    both = rows.withColumn("__i", nth).join(counts.withColumn("__b", before), F.col("video_id").eqNullSafe(F.col("__v")) & (F.col("__p") == F.col("__q")))
    n = F.col("__b") + F.col("__i")
    named = F.when(n > 1, F.concat("video_id", F.lit("_dup"), n.cast("string"))).otherwise(F.col("video_id"))
    return both.select(*manifest.columns, n.alias("__n"), named.alias("__named")).withColumns({"video_id_original": F.col("video_id"), "video_id": F.col("__named")}).drop("__n", "__named")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV: required columns, scores mapped, ids made unique, subject numbers without leading zeros.

    ``manifest_pos`` keeps the order of the file; a manifest is one row per video and small.
    """
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    if missing := [c for c in MANIFEST_COLUMNS if c not in raw.columns]:
        raise ValueError(f"the manifest lacks {missing}")
    raw = raw.withColumn("manifest_pos", F.monotonically_increasing_id())
    number = F.col("subject_id").rlike("^[0-9]+$")
    raw = raw.withColumn("subject_id", F.when(number, F.regexp_replace("subject_id", "^0+(?=.)", "")).otherwise(F.col("subject_id")))
    return unique_ids(label_manifest(raw), "manifest_pos")


def read_csv_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table; an absent or empty file is an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def sample_frames(rows: DataFrame, fps: str, target: int = 15) -> DataFrame:
    """Every step-th frame with its time: the temporal down-sampling of a video scan."""
    step = frame_step(F.col(fps), target)
    known = F.coalesce(F.nanvl(F.col(fps).cast("double"), F.lit(None)), F.lit(30.0))
    known = F.when(known <= 1e-6, 30.0).otherwise(known)
    return (
        rows.withColumns({"frame_step": step, "source_fps": known})
        .where("frame_idx % frame_step = 0")
        .withColumns({"timestamp": F.col("frame_idx") / F.col("source_fps"), "effective_fps": F.col("source_fps") / F.col("frame_step")})
    )


def feature_order(text: str | None) -> tuple[str, ...]:
    """From JSON, an object with ``frame_feature_order`` or a list; without it the fixed order."""
    found = json.loads(text) if text else None
    if isinstance(found, dict):
        found = found.get("frame_feature_order")
    return tuple(found) if isinstance(found, list) else FEATURES


def image_classes(paths: DataFrame, path: str = "path") -> DataFrame:
    """Adds class_name, the folder of the file, and class_id by the order of names."""
    named = paths.withColumn("class_name", F.element_at(F.split(path, "/"), -2))
    names = named.select("class_name").distinct()
    ids = names.withColumn("class_id", F.row_number().over(Window.orderBy("class_name")) - 1)
    return named.join(ids, "class_name")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    return image_classes(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder))


def same_classes(splits: list[DataFrame]) -> None:
    """Raises unless all splits number their classes alike."""
    found = [{(r["class_name"], r["class_id"]) for r in s.select("class_name", "class_id").distinct().collect()} for s in splits]
    if any(x != found[0] for x in found):
        raise ValueError("the splits differ in their classes")


def not_yet_done(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Resume: the videos that have no output yet."""
    return manifest.join(done.select("video_id").distinct(), "video_id", "left_anti")


def first_videos(manifest: DataFrame, n: int | None, order: str = "manifest_pos") -> DataFrame:
    """The first n videos of the manifest, a top-k; all without a limit."""
    return manifest if n is None else manifest.orderBy(order).limit(n)


def checked_arrays(rows: DataFrame, meta: DataFrame, key: str, required: tuple[str, ...], max_samples: int | None = None, label: str = "label_id") -> DataFrame:
    """Sequence arrays beside their metadata: raises on columns that are missing, keys that are null, repeated or on one side only, and labels that are null or not 0 to 2.

    ``max_samples`` takes the first so many by key, as a stated limit of a trial run.
    """
    if missing := [c for c in (key, label, *required) if c not in meta.columns]:
        raise ValueError(f"the metadata lacks {missing}")
    known = F.coalesce(F.col(label).isin(0, 1, 2), F.lit(False))
    sides = rows.select(key, F.lit(1).alias("a"), F.lit(0).alias("m"), F.lit(0).alias("odd")).unionByName(
        meta.select(key, F.lit(0).alias("a"), F.lit(1).alias("m"), (~known).cast("int").alias("odd"))
    )
    counts = sides.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("a", "m", "odd")])
    odd = counts.agg(
        F.count_if(F.col(key).isNull()).alias("null keys"), F.count_if(F.col("m") == 0).alias("arrays without metadata"),
        F.count_if(F.col("a") == 0).alias("metadata without arrays"), F.count_if((F.col("a") > 1) | (F.col("m") > 1)).alias("repeated keys"),
        F.coalesce(F.sum("odd"), F.lit(0)).alias("unknown labels"),
    ).first().asDict()
    if any(odd.values()):
        raise ValueError(f"arrays and metadata do not match: {odd}")
    whole = rows.join(meta, key)
    return whole if max_samples is None else whole.orderBy(key).limit(max_samples)
