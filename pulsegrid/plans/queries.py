"""The registered queries over the reference's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.config import FEATURES, FIXTURE_FRAMES, FIXTURE_SEQUENCES, RAW_COLUMNS, SHORT_BLINKS, Z_COLUMNS, RuleConfig
from pulsegrid.functions import scalars as S
from pulsegrid.operators import blinks, calibration, metrics, rules, scoring, sequences, signals, splits
from pulsegrid.plans import frames as P
from pulsegrid.sources import tables

KEY = ("video_id", "processed_idx")


def r6(*names: str):
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_manifest_map(spark, d):
    man = P.manifest(tables.frames(spark, d))
    return man.select("video_id", "fold", "part", "subject_id", "score_label", "label", "label_id", "original_label")


def q_unique_ids(spark, d):
    docs = read(spark, d, "documents").select(F.col("source").alias("video_id"), "doc_id")
    return tables.unique_ids(docs, "doc_id").select("doc_id", "video_id_original", "video_id")


def q_safe_name(spark, d):
    name = S.safe_name(F.col("url"))
    return read(spark, d, "pages").select("page_id", name.alias("safe_name"), S.sequence_id(F.col("url"), F.col("page_id")).alias("sequence_id"))


def q_frame_sampling(spark, d):
    fps = F.when(F.col("part") == "part1", 29.97).when(F.col("fold") == "Fold1", 37.5).when(F.col("fold") == "Fold2", 0.0)
    rows = tables.sample_frames(tables.frames(spark, d).drop("timestamp").withColumn("fps", fps), "fps")
    return rows.select("video_id", "frame_idx", F.col("frame_step").cast("int"), *r6("timestamp", "effective_fps"))


def q_processing_log(spark, d):
    log = sequences.processing_log(tables.frames(spark, d))
    return log.select("video_id", "processed_frames", "face_detected_frames", *r6("face_detection_rate"))


def q_calibration_stats(spark, d):
    f = tables.frames(spark, d)
    stats = calibration.subject_stats(f, P.manifest(f), FIXTURE_FRAMES, tables.tasks(f) > 1)
    cols = [f"{k}_{c}" for k in ("mean", "std") for c in RAW_COLUMNS]
    return stats.select("subject_id", "calib_video_id", "status", F.col("num_calibration_frames").cast("long"), *[F.round(F.col(c).cast("double"), 5).alias(c) for c in cols])


def q_calibration_status(spark, d):
    """With the production minimum, which the fixture's videos do not reach."""
    f = tables.frames(spark, d)
    return calibration.subject_stats(f, P.manifest(f), hashed=tables.tasks(f) > 1).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def q_zscore(spark, d):
    f = tables.frames(spark, d)
    z = P.z_scores(f, P.manifest(f), FIXTURE_FRAMES, tables.tasks(f))
    return z.select(*KEY, *[F.round(F.col(c).cast("double"), 4).alias(c) for c in Z_COLUMNS])


def q_interpolate(spark, d):
    rows = signals.interpolate(tables.frames(spark, d), ("mar", "p_closed"), 5)
    return rows.select(*KEY, *r6("mar", "p_closed"))


def q_smooth(spark, d):
    return P.fixture_norm(spark, d)[2].select(*KEY, *r6("p_closed", "p_closed_smooth"))


def q_closed_state(spark, d):
    rows = signals.closed_state(P.fixture_norm(spark, d)[2])
    return rows.select(*KEY, "closed_state", *r6("current_closed_duration"))


def q_perclos(spark, d):
    return P.states(P.fixture_norm(spark, d)[2]).select(*KEY, *r6("perclos_10s"))


def q_perclos_short(spark, d):
    return P.states(P.fixture_norm(spark, d)[2], SHORT_BLINKS).select(*KEY, *r6("perclos_10s"))


def q_blink_events(spark, d):
    events = blinks.blink_events(signals.closed_state(P.fixture_norm(spark, d)[2]))
    real = ("start_time", "end_time", "min_time", "duration_sec", "frequency", "p_closed_max")
    ear = ("amplitude", "opening_velocity", "ear_z_start", "ear_z_min", "ear_z_end")
    return events.select("video_id", "blink_id", "start_idx", "end_idx", "min_idx", "duration", *r6(*real), *[F.round(c, 3).alias(c) for c in ear])


ROLLED = ("avg_blink_duration_10s", "blink_frequency_10s", "time_since_last_blink")
ROLLED_EAR = ("avg_blink_amplitude_10s", "avg_opening_velocity_10s")


def _rolling(spark, d, cfg):
    rows = P.rolling(P.fixture_norm(spark, d)[2], cfg)
    return rows.select(*KEY, *r6(*ROLLED), *[F.round(F.col(c).cast("double"), 3).alias(c) for c in ROLLED_EAR])


def q_blink_rolling(spark, d):
    from pulsegrid.config import BlinkConfig

    return _rolling(spark, d, BlinkConfig())


def q_blink_rolling_short(spark, d):
    return _rolling(spark, d, SHORT_BLINKS)


def q_sequences(spark, d):
    _, man, norm = P.fixture_norm(spark, d)
    win = sequences.slide(norm, FIXTURE_SEQUENCES)
    return win.groupBy("video_id", F.col("seq_idx").cast("long").alias("seq_idx"), F.col("start_row").cast("long").alias("start_row")).agg(
        F.count(F.lit(1)).alias("n"), F.min("processed_idx").alias("lo"), F.max("processed_idx").alias("hi")
    )


def q_sequence_meta(spark, d):
    seq = P.fixture_sequences(spark, d)[1]
    ints = [F.col(c).cast("long").alias(c) for c in ("start_row", "end_row", "start_frame", "end_frame", "num_frames", "feature_dim")]
    return seq.select("sequence_id", "video_id", "fold", "subject_id", "label", *ints, *r6("start_time", "end_time", "face_detection_rate", "mean_blink_frequency"))


def q_scores(spark, d):
    seq = P.fixture_sequences(spark, d)[1]
    cols = ("confidence_score", "eye_sleep_score", "drowsy_score", "sleepy_score", "head_down_score", "mean_perclos", "max_closed_duration", "mean_p_closed", "max_mar_z", "max_abs_pitch_z", "max_head_down_z", "mean_blink_duration")
    return seq.select("sequence_id", *[F.round(F.col(c), 4).alias(c) for c in cols])


def q_high_confidence(spark, d):
    return P.fixture_sequences(spark, d)[1].select("sequence_id", "label", "is_high_confidence", "filter_reason")


def q_filter_reasons(spark, d):
    return P.fixture_sequences(spark, d)[1].groupBy("label", "filter_reason").agg(F.count(F.lit(1)).alias("n"))


def q_video_summary(spark, d):
    frames, man, norm = P.fixture_norm(spark, d)
    rolled = P.rolling(norm, ended="blink_end")
    seq = P.decided(P.windows(rolled, man, FIXTURE_SEQUENCES), FIXTURE_SEQUENCES)
    out = sequences.video_summary(frames, man, rolled, seq)
    return out.select("video_id", "subject_id", "label", "num_frames", "num_blinks", "num_all_sequences", "num_high_conf_sequences", "status", *r6("face_detection_rate"))


def q_keep_ratio(spark, d):
    rows = sequences.keep_ratio(P.fixture_sequences(spark, d)[1])
    return rows.select("label_id", "class_name", "before_count", "after_count", *r6("keep_ratio"))


def q_dummy_all(spark, d):
    kept = P.fixture_sequences(spark, d)[1].where("is_high_confidence = 1")
    return sequences.mirror(kept).select("sequence_id", "label_source", "is_dummy_all")


def q_sequence_tensor(spark, d):
    """Every frame of every sequence by chunk of eight and place in it, the two that fill the last chunk too."""
    rows = sequences.chunks(sequences.tensors(P.fixture_sequences(spark, d)[0]), 8)
    rows = rows.select("video_id", F.col("seq_idx").cast("long").alias("seq_idx"), F.posexplode("chunks").alias("chunk", "frames"))
    rows = rows.select("video_id", "seq_idx", "chunk", F.posexplode("frames").alias("place", "f"))
    return rows.select("video_id", "seq_idx", "chunk", "place", *[F.round(F.get("f", i).cast("double"), 3).alias(c) for i, c in enumerate(FEATURES)])


def _documents_meta(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.col("source").alias("subject_id"), F.concat(F.lit("Fold"), (F.col("doc_id") % 4 + 1).cast("string")).alias("fold"), (F.col("n_chars") % 3).cast("int").alias("label_id"))


def q_fold_split(spark, d):
    return splits.fold_masks(_documents_meta(spark, d), "Fold2").select("doc_id", "fold", "split")


def q_fold_order(spark, d):
    folds = _documents_meta(spark, d).select("subject_id").distinct()
    return folds.select("subject_id", *[c.alias(f"k{i}") for i, c in enumerate(splits.fold_key("subject_id"))])


def q_group_class_counts(spark, d):
    return splits.group_class_counts(_documents_meta(spark, d), "subject_id")


def q_group_split(spark, d):
    return splits.group_split(_documents_meta(spark, d)).select("doc_id", "subject_id", "split")


def q_stratified_split(spark, d):
    rows = splits.stratified_split(_documents_meta(spark, d), "doc_id", hashed=splits.portable_hash("doc_id"))
    return rows.select("doc_id", "label_id", "split")


def q_split_meta(spark, d):
    meta = _documents_meta(spark, d)
    parts = {f"fold{k}": meta.where(F.col("fold") == f"Fold{k}").select("doc_id") for k in (1, 2, 3)}
    return splits.tagged(parts).join(meta, "doc_id", "left").select("doc_id", "split", "fold", "subject_id", "label_id")


def _values(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


def q_standardizer(spark, d):
    """Fitted on four fifths of the vectors."""
    return splits.standardizer(_values(spark, d), F.col("vec_id") % 5 != 0).select("feature", *r6("mean", "std"))


def q_standardized(spark, d):
    rows = _values(spark, d)
    out = splits.standardize(rows, splits.standardizer(rows, F.col("vec_id") % 5 != 0))
    return out.select("vec_id", "feature", F.round("z", 5).alias("z"))


def _logits(spark, d):
    at = {n: F.element_at("embedding", i).cast("double") for i, n in enumerate(("a0", "a1", "s0", "s1"), 1)}
    return read(spark, d, "embeddings").withColumns(at | {"y": (F.col("label") % 3).cast("int")})


def q_hier_probs(spark, d):
    p = S.hierarchical((F.col("a0"), F.col("a1")), (F.col("s0"), F.col("s1")))
    rows = _logits(spark, d).withColumns({f"prob_{i}": x for i, x in enumerate(p)})
    return rows.select("vec_id", *r6("prob_0", "prob_1", "prob_2"), S.argmax3(*[F.col(f"prob_{i}") for i in range(3)]).alias("pred"), F.round(S.sigmoid(F.col("a0")), 6).alias("sig"))


def q_hier_loss(spark, d):
    return rules.hierarchical_loss(_logits(spark, d)).select(*r6("abnormal_loss", "stage_loss", "loss"))


def _ruled(spark, d, cfg):
    rows = P.fixture_ruled(spark, d, cfg)
    return rows.select("sequence_id", F.col("rule_mask").cast("int").alias("rule_mask"), "pred_rule", *[F.round(F.col(f"prob_rule_{c}").cast("double"), 4).alias(f"prob_rule_{c}") for c in range(3)])


def q_hier_loss_weighted(spark, d):
    out = rules.hierarchical_loss(_logits(spark, d), abnormal_weights=(1.5, 0.75), stage_weights=(0.6, 3.0))
    return out.select(*r6("abnormal_loss", "stage_loss", "loss"))


def q_rule_off(spark, d):
    return _ruled(spark, d, RuleConfig(use_rule=False))


def q_predictions_meta(spark, d):
    """Rule predictions joined back to the metadata of their sequences."""
    ruled = P.fixture_ruled(spark, d, RuleConfig()).select("sequence_id", "pred_rule")
    return metrics.with_metadata(ruled, P.fixture_sequences(spark, d)[1]).select("sequence_id", "pred_rule", "video_id", "fold", "label_id")


def q_cv_runs(spark, d):
    """The summaries of two runs as one table."""
    one = lambda t, p: metrics.cv_summary(metrics.summary(_truth(spark, d), t, p, 3, "fold"), ["accuracy", "macro_f1"])
    return metrics.union_runs({"plain": one("t", "p"), "swapped": one("p", "t")}).select("run", "metric", *r6("mean", "std", "min", "max"))


def q_first_videos(spark, d):
    man = P.manifest(tables.frames(spark, d))
    return tables.first_videos(man, 10, "video_id").select("video_id", "label")


def q_log_rows(spark, d):
    """Videos done before, new ones, and those that failed."""
    f = tables.frames(spark, d)
    group = F.substring("video_id", -1, 1)
    failed = tables.videos(f).where(group == "3").select("video_id", F.lit("no stream").alias("error"))
    rows = sequences.log_rows(tables.videos(f), f.where(group >= "5"), f.where(group < "3"), failed)
    return rows.select("video_id", "status", "processed_frames", "face_detected_frames", *r6("face_detection_rate"), "error")


def q_sleepy_boost(spark, d):
    return _ruled(spark, d, RuleConfig())


def q_sleepy_force(spark, d):
    return _ruled(spark, d, RuleConfig(mode="force", use_yawn=True))


def _truth(spark, d):
    rows = read(spark, d, "labels")
    return rows.select("doc_id", (F.col("quality") + F.col("toxic")).cast("int").alias("t"), (F.col("doc_id") % 3).cast("int").alias("p"), (F.col("doc_id") % 4).cast("int").alias("fold"))


def q_confusion(spark, d):
    return metrics.confusion(_truth(spark, d), "t", "p").select("t", "p", "n", *r6("share"))


def q_report(spark, d):
    rows = metrics.report(_truth(spark, d), "t", "p")
    return rows.select("class_id", "support", "predicted", *r6("precision", "recall", "f1"))


def q_report_averages(spark, d):
    rows = metrics.averages(metrics.report(_truth(spark, d), "t", "p"))
    return rows.select("support", *r6(*[f"{k}_{c}" for k in ("macro", "weighted") for c in ("precision", "recall", "f1")]))


METRICS = ("accuracy", "macro_f1", "recall_0", "recall_1", "recall_2", "normal_false_alarm_rate")


def q_seq_metrics(spark, d):
    return metrics.summary(_truth(spark, d), "t", "p").select("n", *r6(*METRICS))


def q_cv_summary(spark, d):
    folds = metrics.summary(_truth(spark, d), "t", "p", 3, "fold")
    return metrics.cv_summary(folds, list(METRICS)).select("metric", *r6("mean", "std", "min", "max"))


def q_running_mean(spark, d):
    folds = metrics.summary(_truth(spark, d), "t", "p", 3, "fold")
    return metrics.running_mean(folds, "accuracy", "n").select(*r6("accuracy"))


def q_class_weights(spark, d):
    return splits.class_weights(read(spark, d, "labels"), "quality").select("class_id", *r6("weight"))


def _videos(spark, d, how="majority_vote"):
    return metrics.video_predictions(P.fixture_probs(spark, d), how)


def q_video_vote(spark, d):
    return _videos(spark, d).select("video_id", "num_sequences", "true_label_id", "pred_label_id", *[F.round(f"prob_mean_{c}", 4).alias(f"prob_mean_{c}") for c in range(3)])


def q_video_prob_mean(spark, d):
    return _videos(spark, d, "prob_mean").select("video_id", "true_label_id", "pred_label_id")


def q_video_metrics(spark, d):
    return metrics.summary(_videos(spark, d), "true_label_id", "pred_label_id").select("n", *r6(*METRICS))


def q_video_logloss(spark, d):
    return metrics.log_loss(_videos(spark, d)).select(F.round("log_loss", 4).alias("log_loss"))


def q_stream_smooth(spark, d):
    rows = metrics.stream_predictions(P.fixture_probs(spark, d), RuleConfig(warmup=1))
    return rows.select("sequence_id", "pred_label_id", *[F.round(f"smooth_prob_{c}", 4).alias(f"smooth_prob_{c}") for c in range(3)])


def q_change_rate(spark, d):
    return metrics.change_rate(metrics.stream_predictions(P.fixture_probs(spark, d))).select(*r6("prediction_change_rate"))


def q_ear_geometry(spark, d):
    e = read(spark, d, "embeddings").withColumn("e", F.expr("transform(embedding, x -> cast(x as double))"))
    x, y = [F.get("e", i) * 640 for i in range(6)], [F.get("e", i) * 480 for i in range(6, 12)]
    eye = S.eye_aspect_ratio(list(zip(x, y)))
    mouth = S.mouth_aspect_ratio((x[0], y[0]), (x[1], y[1]), (x[2], y[2]), (x[3], y[3]))
    rows = e.select("vec_id", eye.alias("ear"), mouth.alias("mar"))
    return rows.select("vec_id", *r6("ear", "mar"), F.round(S.either(F.col("ear"), F.col("mar")), 6).alias("mean_any"), F.round(S.both(F.col("ear"), F.col("mar")), 6).alias("mean_both"))


def q_crop_box(spark, d):
    e = read(spark, d, "embeddings").withColumn("e", F.expr("transform(embedding, x -> cast(x as double))"))
    xs, ys = F.transform(F.slice("e", 1, 6), lambda v: 320 + v * 320), F.transform(F.slice("e", 7, 6), lambda v: 240 + v * 240)
    return e.select("vec_id", S.crop_box(xs, ys, 640, 480).alias("b"), S.fit_width(F.col("vec_id") * 7 + 100, F.col("vec_id") + 90, 960).alias("f")).select(
        "vec_id", "b.x0", "b.y0", "b.x1", "b.y1", F.col("f.w").alias("fit_w"), F.col("f.h").alias("fit_h")
    )


def q_resume(spark, d):
    f = tables.frames(spark, d)
    done = f.where("face_detected = 0 AND processed_idx < 3")
    return tables.not_yet_done(tables.videos(f), done).select("video_id", "subject_id")


def q_image_classes(spark, d):
    paths = read(spark, d, "documents").select(F.concat(F.lit("/data/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return tables.image_classes(paths).groupBy("class_name", "class_id").agg(F.count(F.lit(1)).alias("n"))


def _epochs(spark, d):
    """Days of an event type as epochs of a series."""
    days = read(spark, d, "events").withColumn("day", F.to_date("ts")).groupBy("event_type", "day").agg(F.round(F.avg("value"), 6).alias("v"))
    return days.select(F.col("event_type").alias("series"), F.row_number().over(Window.partitionBy("event_type").orderBy("day")).alias("epoch"), "v")


def q_best_epoch(spark, d):
    return metrics.best_epoch(_epochs(spark, d), "v").select("series", "best_epoch", "best_value", "stopped_at")


def q_plateau(spark, d):
    """The schedule of the learning rate over the same series."""
    return metrics.plateau_rates(_epochs(spark, d), "v").select("series", "epoch", "rate")


def q_pixels(spark, d):
    """Landmarks in pixels, in single precision."""
    e = read(spark, d, "embeddings")
    at = lambda i: F.get("embedding", i).cast("double")
    return e.select("vec_id", *[F.round(S.pixel(at(i), size).cast("double"), 4).alias(n) for n, i, size in (("x", 0, 640), ("y", 6, 480))])


def q_nan_to_num(spark, d):
    """Vectors with NaN and infinities put in, cleaned again."""
    spoilt = "transform(embedding, x -> CASE WHEN x > 0.1 THEN double('NaN') WHEN x < -0.1 THEN double('-Infinity') ELSE cast(x AS double) END)"
    e = read(spark, d, "embeddings").withColumn("e", F.expr(spoilt))
    return e.select("vec_id", F.posexplode(S.nan_to_num(F.col("e"))).alias("feature", "v")).select("vec_id", "feature", *r6("v"))


def q_safe_float(spark, d):
    """Numbers, numbers with an exponent, words, NaN and nothing, as text."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    kind = F.col("event_id") % 6
    text = F.when(kind == 0, k).when(kind == 1, F.concat(k, F.lit("x"))).when(kind == 2, F.concat(F.lit(" -"), k, F.lit(".5e1 "))).when(kind == 3, "nan").when(kind == 4, "1d")
    return read(spark, d, "events").select("event_id", S.safe_float(text, -1.0).alias("v"))


def q_eligible(spark, d):
    return splits.eligible(P.fixture_sequences(spark, d)[1], "high_confidence").select("sequence_id", "label_id")


def q_distinct_subjects(spark, d):
    return splits.distinct_groups(P.manifest(tables.frames(spark, d)), "subject_id", "fold")


def q_scatter_sides(spark, d):
    """Scores of single eyes, some missing, put back to their frames."""
    f = tables.frames(spark, d)
    seen = f.where("p_closed IS NOT NULL")
    left = seen.where("processed_idx % 3 <> 0").select("video_id", "frame_idx", F.lit("left").alias("side"), F.col("p_closed").alias("p"))
    right = seen.where("processed_idx % 2 = 0").select("video_id", "frame_idx", F.lit("right").alias("side"), (F.lit(1.0) - F.col("p_closed") / 4).alias("p"))
    return scoring.scatter_sides(f, left.unionByName(right)).select("video_id", "frame_idx", "p_left", "p_right", "p_closed")


def q_checked_arrays(spark, d):
    """Arrays beside their metadata; the first fifty are the stated limit of a trial run."""
    e = read(spark, d, "embeddings")
    meta = e.select("vec_id", (F.col("label") % 3).alias("label_id"), F.concat(F.lit("Fold"), (F.col("vec_id") % 4 + 1).cast("string")).alias("fold"))
    out = tables.checked_arrays(e.select("vec_id", "embedding"), meta, "vec_id", ("fold",), 50)
    return out.select("vec_id", "label_id", "fold", F.round(F.get("embedding", 0).cast("double"), 6).alias("first"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
