"""Count-based sliding sequences, their scores and the transparent decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.config import FEATURES, SequenceConfig
from pulsegrid.functions.scalars import clip01, f64, finite, sequence_id

META = ("fold", "part", "subject_id", "score_label", "original_label", "label", "label_id")


def slide(rows: DataFrame, cfg: SequenceConfig) -> DataFrame:
    """Each frame once per full window that it belongs to: seq_idx and start_row.

    A frame's windows follow from its place and the video's length, so frames are only
    multiplied by length / stride and never gathered to be cut. Short videos give none.
    """
    by = Window.partitionBy("video_id")
    placed = rows.withColumns(
        {"__i": F.row_number().over(by.orderBy("timestamp")) - 1, "__n": F.count(F.lit(1)).over(by)}
    ).where(F.col("__n") >= cfg.length)
    lo = F.greatest(F.lit(0), F.ceil((F.col("__i") - (cfg.length - 1)) / cfg.stride))
    hi = F.least(F.floor(F.col("__i") / cfg.stride), F.floor((F.col("__n") - cfg.length) / cfg.stride))
    windows = placed.withColumns({"__lo": lo, "__hi": hi}).where("__lo <= __hi").withColumn("seq_idx", F.explode(F.sequence("__lo", "__hi")))
    return windows.withColumn("start_row", F.col("seq_idx") * cfg.stride).drop("__i", "__n", "__lo", "__hi")


def _mean(c: str) -> Column:
    return F.coalesce(F.avg(finite(f64(F.col(c)))), F.lit(0.0))


def _max(c: Column) -> Column:
    return F.coalesce(F.max(finite(f64(c))), F.lit(0.0))


def sequence_stats(windows: DataFrame, cfg: SequenceConfig, *keys: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """One row per sequence with enough faces: bounds, means and maxima. Numbers of left-out sequences stay unused."""
    pitch = F.col("pitch_z")
    down = {"abs": F.abs(pitch), "positive": pitch, "negative": -pitch}[cfg.head_down]
    ends = {
        f"{e}_{c}": f(s, "processed_idx") for e, f in (("start", F.min_by), ("end", F.max_by)) for c, s in (("frame", "frame_idx"), ("time", "timestamp"))
    }
    out = windows.groupBy("video_id", "seq_idx", "start_row", *keys).agg(
        F.avg(f64(F.col("face_detected"))).alias("face_detection_rate"),
        *[c.alias(n) for n, c in ends.items()],
        _mean("perclos_10s").alias("mean_perclos"), _max(F.col("current_closed_duration")).alias("max_closed_duration"),
        _mean("p_closed").alias("mean_p_closed"), F.greatest(_max(F.col("mar_z")), F.lit(0.0)).alias("max_mar_z"),
        _max(F.abs(pitch)).alias("max_abs_pitch_z"), F.greatest(_max(down), F.lit(0.0)).alias("max_head_down_z"),
        _mean("avg_blink_duration_10s").alias("mean_blink_duration"), F.avg(f64(F.col("blink_frequency_10s"))).alias("mean_blink_frequency"), *more,
    )
    out = out.where(F.col("face_detection_rate") >= cfg.min_face_rate)
    return out.withColumns(
        {"end_row": F.col("start_row") + (cfg.length - 1), "sequence_id": sequence_id(F.col("video_id"), F.col("seq_idx")), "num_frames": F.lit(cfg.length), "feature_dim": F.lit(len(FEATURES))}
    )


def score(stats: DataFrame, cfg: SequenceConfig = SequenceConfig()) -> DataFrame:
    """Adds the five scores; the weights are fixed values."""
    part = lambda c, cap: clip01(F.col(c) / F.lit(cfg.caps[cap]))
    perclos, closed, p = part("mean_perclos", "perclos"), part("max_closed_duration", "closed"), part("mean_p_closed", "p")
    yawn, head, down = part("max_mar_z", "yawn"), part("max_abs_pitch_z", "head"), part("max_head_down_z", "head_down")
    blink = part("mean_blink_duration", "blink")
    eye = clip01(0.40 * perclos + 0.35 * closed + 0.20 * p + 0.05 * blink)
    drowsy = clip01(0.20 * perclos + 0.15 * p + 0.30 * yawn + 0.20 * head + 0.15 * blink)
    out = stats.withColumns({"eye_sleep_score": eye, "drowsy_score": drowsy, "head_down_score": down})
    out = out.withColumn("sleepy_score", F.greatest("eye_sleep_score", "head_down_score"))
    return out.withColumn("confidence_score", F.greatest("sleepy_score", "drowsy_score"))


def decide(scored: DataFrame) -> DataFrame:
    """Adds is_high_confidence and filter_reason; the thresholds are fixed values."""
    eye, drowsy, down = F.col("eye_sleep_score"), F.col("drowsy_score"), F.col("head_down_score")
    closed, perclos, p, label = F.col("max_closed_duration"), F.col("mean_perclos"), F.col("mean_p_closed"), F.col("label")
    normal = (eye <= 0.15) & (drowsy <= 0.25) & (down <= 0.30)
    mid = drowsy.between(0.25, 0.70) & (eye < 0.55) & (closed < 2.0) & (down < 0.70)
    signs = (
        (closed >= 2.0, "long_eye_closed"), ((perclos >= 0.70) & (p >= 0.75), "high_perclos_and_p_closed"),
        (eye >= 0.55, "high_eye_sleep_score"), (down >= 0.75, "head_down"),
    )
    why = F.concat_ws("+", *[F.when(c, F.lit(n)) for c, n in signs])
    reason = (
        F.when(label == "normal", F.when(normal, "normal_low_eye_drowsy_head_scores").otherwise("normal_confidence_rejected"))
        .when(label == "drowsy", F.when(mid, "drowsy_mid_drowsy_score_not_sleepy").otherwise("drowsy_confidence_rejected"))
        .when(label == "sleepy", F.when(why != "", F.concat(F.lit("sleepy_"), why)).otherwise("sleepy_confidence_rejected"))
        .otherwise("unknown_label")
    )
    keep = ((label == "normal") & normal) | ((label == "drowsy") & mid) | ((label == "sleepy") & (why != ""))
    return scored.withColumns({"is_high_confidence": F.coalesce(keep, F.lit(False)).cast("int"), "filter_reason": reason})


def tensors(windows: DataFrame) -> DataFrame:
    """(video_id, seq_idx, x): the features of a sequence's frames in order; its length bounds the array."""
    frame = F.array(*[F.col(c).cast("float") for c in FEATURES])
    rows = windows.groupBy("video_id", "seq_idx").agg(F.sort_array(F.collect_list(F.struct("processed_idx", frame.alias("f")))).alias("r"))
    return rows.select("video_id", "seq_idx", F.col("r.f").alias("x"))


def chunks(tensor: DataFrame, size: int = 10) -> DataFrame:
    """A sequence's frames as chunks of ``size``, the last one filled with zero frames."""
    pad = (size - F.size("x") % size) % size
    zero = F.array(*[F.lit(0.0).cast("float")] * len(FEATURES))
    whole = F.concat("x", F.array_repeat(zero, pad))
    at = F.sequence(F.lit(0), F.floor(F.size(whole) / size).cast("int") - 1)
    return tensor.withColumn("chunks", F.transform(at, lambda i: F.slice(whole, i * size + 1, size)))


def mirror(kept: DataFrame) -> DataFrame:
    """The table that stands for all sequences but mirrors the chosen ones."""
    return kept.withColumns({"label_source": F.lit("dummy_all_mirrors_high_confidence"), "is_dummy_all": F.lit(1)})


def video_summary(frames: DataFrame, manifest: DataFrame, rolled: DataFrame, sequences: DataFrame, ended: str = "blink_end") -> DataFrame:
    """One row per video: frames, face rate, counts and status; subjects without calibration keep a row.

    ``rolled`` holds the frames of calibrated subjects, with the time of the blink that ends at
    each in ``ended``: its videos are the calibrated ones and its blinks are counted in place.
    ``manifest`` is asked for its own columns alone.
    """
    per = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("num_frames"), F.avg(f64(F.col("face_detected"))).alias("rate"))
    blinks = rolled.groupBy("video_id").agg(F.count(ended).alias("num_blinks"), F.lit(1).alias("ok"))
    seqs = sequences.groupBy("video_id").agg(F.count(F.lit(1)).alias("num_all_sequences"), F.sum("is_high_confidence").alias("num_high_conf_sequences"))
    rows = manifest.join(per, "video_id", "left").join(blinks, "video_id", "left").join(seqs, "video_id", "left")
    status = F.when(F.col("num_frames").isNull(), "empty_raw_frame_csv").when(F.col("ok").isNull(), "no_subject_calibration").otherwise("ok")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select(
        "video_id", "subject_id", "label", zero("num_frames"), F.coalesce("rate", F.lit(0.0)).alias("face_detection_rate"),
        zero("num_blinks"), zero("num_all_sequences"), zero("num_high_conf_sequences"), status.alias("status"),
    )


def processing_log(frames: DataFrame) -> DataFrame:
    """Frames, frames with a face and their rate, by video."""
    n, d = F.count(F.lit(1)), F.sum("face_detected")
    return frames.groupBy("video_id").agg(n.alias("processed_frames"), d.alias("face_detected_frames"), (d / F.greatest(n, F.lit(1))).alias("face_detection_rate"))


def log_rows(manifest: DataFrame, done: DataFrame, existing: DataFrame, failed: DataFrame) -> DataFrame:
    """One row per video: ``ok`` with the counts of its frames, ``skipped_exists`` with those read again, ``error`` with the message, or ``no_frames``.

    ``failed`` has (video_id, error). A failure wins over frames, new frames over old ones.
    """
    tag = lambda rows, status: processing_log(rows).withColumn("__s", F.lit(status))
    counted = tag(done, "ok").unionByName(tag(existing.join(done.select("video_id").distinct(), "video_id", "left_anti"), "skipped_exists"))
    rows = manifest.select("video_id").join(counted, "video_id", "left").join(failed.groupBy("video_id").agg(F.max("error").alias("error")), "video_id", "left")
    bad = F.col("error").isNotNull()
    zero = lambda c: F.when(bad, F.lit(0)).otherwise(F.coalesce(F.col(c), F.lit(0)))
    return rows.select(
        "video_id", F.when(bad, "error").otherwise(F.coalesce("__s", F.lit("no_frames"))).alias("status"),
        *[zero(c).cast("long").alias(c) for c in ("processed_frames", "face_detected_frames")],
        zero("face_detection_rate").cast("double").alias("face_detection_rate"), "error",
    )


def keep_ratio(sequences: DataFrame) -> DataFrame:
    n, k = F.count(F.lit(1)), F.sum("is_high_confidence")
    return sequences.groupBy("label_id", F.col("label").alias("class_name")).agg(n.alias("before_count"), k.alias("after_count"), (k / n).alias("keep_ratio"))
