"""Per-subject calibration: statistics of the subject's first normal video, z scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.config import RAW_COLUMNS, Z_COLUMNS, FrameConfig
from pulsegrid.functions.scalars import f32, f64, finite

STATUS = ("no_normal_video", "empty_calib_video", "too_few_calibration_frames", "ok")


def calibration_videos(manifest: DataFrame, cfg: FrameConfig) -> DataFrame:
    """(subject_id, calib_video_id): the first normal video in the manifest's order, by subject."""
    first = F.row_number().over(Window.partitionBy("subject_id").orderBy("manifest_pos"))
    chosen = manifest.where(F.col("score_label") == cfg.calibration_score).withColumn("n", first).where("n = 1")
    return chosen.select("subject_id", F.col("video_id").alias("calib_video_id"))


def calibration_frames(frames: DataFrame, chosen: DataFrame, cfg: FrameConfig) -> DataFrame:
    """The first (or last) share of the valid frames of the chosen videos."""
    own = frames.select("video_id", "processed_idx", "face_detected", *RAW_COLUMNS).join(
        chosen.withColumnRenamed("calib_video_id", "video_id"), "video_id"
    )
    return _marked(own, cfg, ("video_id",)).where("used").drop("used")


def _marked(frames: DataFrame, cfg: FrameConfig, keys: tuple[str, ...]) -> DataFrame:
    """Adds ``used``: the frame is valid and among the first (or last) share of its video's valid ones."""
    valid = F.coalesce(reduce(lambda a, c: a & finite(F.col(c)).isNotNull(), RAW_COLUMNS, F.col("face_detected") == 1), F.lit(False)).cast("int")
    order = F.col("processed_idx").desc() if cfg.calibration_part == "last" else F.col("processed_idx").asc()
    by = Window.partitionBy(*keys)
    so_far = by.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = frames.withColumn("__valid", valid).withColumns({"__k": F.sum("__valid").over(by), "__r": F.sum("__valid").over(so_far)})
    most = F.greatest(F.lit(1), F.floor(F.col("__k") * F.lit(cfg.calibration_ratio)))
    return held.withColumn("used", (F.col("__valid") == 1) & (F.col("__r") <= most)).drop("__valid", "__k", "__r")


def subject_stats(frames: DataFrame, manifest: DataFrame, cfg: FrameConfig = FrameConfig(), hashed: bool = False) -> DataFrame:
    """One row per subject: status, calibration frames, single-precision means and deviations.

    One pass over the manifest chooses the videos, one over their frames counts and measures
    those that are used; a subject without frames keeps its row. ``hashed`` makes
    the subjects the hashed side, so that only frames of the chosen videos are sorted.
    """
    normal = F.when(F.col("score_label") == cfg.calibration_score, F.struct("manifest_pos", "video_id"))
    subjects = manifest.groupBy("subject_id").agg(F.min(normal).getField("video_id").alias("calib_video_id"))
    seen = frames.select(F.col("video_id").alias("calib_video_id"), "processed_idx", "face_detected", *RAW_COLUMNS, F.lit(1).alias("there"))
    marked = _marked((subjects.hint("shuffle_hash") if hashed else subjects).join(seen, "calib_video_id", "left"), cfg, ("calib_video_id", "subject_id"))
    used = lambda c: F.when(F.col("used"), F.col(c))
    rows = marked.groupBy("calib_video_id", "subject_id").agg(
        F.count_if("used").alias("n"), F.max("there").alias("there"),
        *[f32(F.avg(used(c))).alias(f"mean_{c}") for c in RAW_COLUMNS],
        *[f32(F.stddev_pop(used(c))).alias(f"s_{c}") for c in RAW_COLUMNS],
    )
    status = (
        F.when(F.col("calib_video_id").isNull(), STATUS[0]).when(F.col("there").isNull(), STATUS[1])
        .when(F.coalesce("n", F.lit(0)) < cfg.min_calibration_frames, STATUS[2]).otherwise(STATUS[3])
    )
    rows = rows.withColumn("status", status)
    ok = F.col("status") == "ok"
    deviation = lambda c: F.when(finite(F.col(f"s_{c}")).isNull() | (f64(F.col(f"s_{c}")) < 1e-8), f32(F.lit(1.0))).otherwise(F.col(f"s_{c}"))
    return rows.select(
        "subject_id", "calib_video_id", "status",
        F.when(F.col("status").isin(*STATUS[2:]), F.coalesce("n", F.lit(0))).alias("num_calibration_frames"),
        *[F.when(ok, F.col(f"mean_{c}")).alias(f"mean_{c}") for c in RAW_COLUMNS],
        *[F.when(ok, deviation(c)).alias(f"std_{c}") for c in RAW_COLUMNS],
    )


def z_scores(frames: DataFrame, stats: DataFrame, hashed: bool = False) -> DataFrame:
    """Frames of calibrated subjects with z scores in single precision.

    ``hashed`` makes the statistics, one row per subject, the hashed side: frames are neither
    broadcast where their files are small nor sorted by subject. Few frames need no such care.
    """
    means, stds = [f"mean_{c}" for c in RAW_COLUMNS], [f"std_{c}" for c in RAW_COLUMNS]
    own = stats.where("status = 'ok'").select("subject_id", *[F.col(c).alias(f"__{c}") for c in means + stds])
    z = {z: f32((F.col(c) - f64(F.col(f"__mean_{c}"))) / f64(F.col(f"__std_{c}"))) for c, z in zip(RAW_COLUMNS, Z_COLUMNS)}
    return frames.join(own.hint("shuffle_hash") if hashed else own, "subject_id").withColumns(z).drop(*[f"__{c}" for c in means + stds])
