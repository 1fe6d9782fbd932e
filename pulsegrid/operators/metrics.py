"""Classification metrics by sequence, video and stream; all are partial aggregates over counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.config import RuleConfig
from pulsegrid.functions.scalars import argmax3

CLASSES = 3


def confusion(rows: DataFrame, true: str, pred: str, classes: int = CLASSES) -> DataFrame:
    """(t, p, n, share) for every pair of classes; share is of the true class's rows, with a floor of one row."""
    spark = rows.sparkSession
    # A grid of classes x classes, a few rows by construction.
    grid = spark.range(classes * classes).select((F.col("id") / classes).cast("int").alias("t"), (F.col("id") % classes).cast("int").alias("p"))
    counts = rows.groupBy(F.col(true).cast("int").alias("t"), F.col(pred).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    whole = grid.join(counts, ["t", "p"], "left").select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))
    return whole.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("t")), F.lit(1)))


def report(rows: DataFrame, true: str, pred: str, classes: int = CLASSES) -> DataFrame:
    """Precision, recall, F1 and support by class; a zero denominator gives 0."""
    t, p = F.col(true), F.col(pred)
    counts = rows.agg(
        *[c for k in range(classes) for c in (F.count_if((t == k) & (p == k)).alias(f"tp{k}"), F.count_if(t == k).alias(f"t{k}"), F.count_if(p == k).alias(f"p{k}"))]
    )
    per = counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("class_id"), F.col(f"tp{k}").alias("tp"), F.col(f"t{k}").alias("support"), F.col(f"p{k}").alias("predicted")) for k in range(classes)])))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    total = F.col("precision") + F.col("recall")
    return per.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def averages(per_class: DataFrame) -> DataFrame:
    """Macro and weighted averages of a report, over the classes that occur as true or predicted."""
    seen = per_class.where("support + predicted > 0")
    n = F.sum("support")
    cols = ("precision", "recall", "f1")
    return seen.agg(*[F.avg(c).alias(f"macro_{c}") for c in cols], *[(F.sum(F.col(c) * F.col("support")) / n).alias(f"weighted_{c}") for c in cols], n.alias("support"))


def summary(rows: DataFrame, true: str, pred: str, classes: int = CLASSES, *keys: str) -> DataFrame:
    """Accuracy, macro F1 (over classes seen), recalls (null without support) and the false alarm rate of class 0.

    One pass of conditional counts, by ``keys`` if given.
    """
    t, p = F.col(true), F.col(pred)
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((t == p).cast("double")).alias("accuracy"),
        *[c for k in range(classes) for c in (F.count_if((t == k) & (p == k)).alias(f"tp{k}"), F.count_if(t == k).alias(f"t{k}"), F.count_if(p == k).alias(f"p{k}"))],
    )
    f1 = lambda k: 2.0 * F.col(f"tp{k}") / (F.col(f"t{k}") + F.col(f"p{k}"))
    seen = [(F.col(f"t{k}") + F.col(f"p{k}") > 0) for k in range(classes)]
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    macro = add([F.when(s, f1(k)).otherwise(0.0) for k, s in enumerate(seen)]) / F.nullif(add([s.cast("int") for s in seen]), F.lit(0))
    recall = lambda k: F.when(F.col(f"t{k}") > 0, F.col(f"tp{k}") / F.col(f"t{k}"))
    return counts.select(
        *keys, "n", "accuracy", macro.alias("macro_f1"), *[recall(k).alias(f"recall_{k}") for k in range(classes)],
        (1.0 - recall(0)).alias("normal_false_alarm_rate"),
    )


def _votes(label: str, out: str) -> list[Column]:
    """Aggregates by class: how often the label occurs, and where first."""
    return [c for k in range(CLASSES) for c in (F.count_if(F.col(label) == k).alias(f"__{out}_n{k}"), F.min(F.when(F.col(label) == k, F.col("pos"))).alias(f"__{out}_at{k}"))]


def _winner(out: str) -> Column:
    """The most frequent label; of equals the one met first."""
    found = F.array(*[F.struct((-F.col(f"__{out}_n{k}")).alias("n"), F.col(f"__{out}_at{k}").alias("at"), F.lit(k).alias("label")) for k in range(CLASSES)])
    return F.array_min(found)["label"]


def video_predictions(rows: DataFrame, how: str = "majority_vote") -> DataFrame:
    """One row per video from prob_0..2, true_label_id and pos: votes, mean probabilities, number of sequences.

    One aggregation: classes are few, so their counts and first places are columns of it.
    """
    if how not in ("majority_vote", "prob_mean"):
        raise ValueError(f"no such aggregation: {how}")
    rows = rows.withColumn("__pred", argmax3(F.col("prob_0"), F.col("prob_1"), F.col("prob_2")))
    out = rows.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("num_sequences"), *[F.avg(f"prob_{c}").alias(f"prob_mean_{c}") for c in range(CLASSES)],
        *_votes("true_label_id", "true"), *_votes("__pred", "pred"),
    )
    pred = _winner("pred") if how == "majority_vote" else argmax3(*[F.col(f"prob_mean_{c}") for c in range(CLASSES)])
    means = [f"prob_mean_{c}" for c in range(CLASSES)]
    return out.select("video_id", "num_sequences", *means, _winner("true").alias("true_label_id"), pred.alias("pred_label_id"))


def with_metadata(predictions: DataFrame, meta: DataFrame, key: str = "sequence_id") -> DataFrame:
    """Predictions beside the metadata of their sequences; the prediction's columns win over equal names."""
    more = [c for c in meta.columns if c == key or c not in predictions.columns]
    return predictions.join(meta.select(*more), key)


def union_runs(summaries: dict[str, DataFrame]) -> DataFrame:
    """Summaries of several runs as one table, each row with the name of its own run."""
    first, *rest = [df.withColumn("run", F.lit(name)) for name, df in summaries.items()]
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def log_loss(videos: DataFrame, eps: float = 2.220446049250313e-16) -> DataFrame:
    """Mean of -ln of the true class's share, kept away from 0 and 1."""
    p = [F.col(f"prob_mean_{c}") for c in range(CLASSES)]
    own = F.when(F.col("true_label_id") == 0, p[0]).when(F.col("true_label_id") == 1, p[1]).otherwise(p[2]) / (p[0] + p[1] + p[2])
    return videos.agg(F.avg(-F.log(F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), own)))).alias("log_loss"))


STREAM_ORDER = ("start_time", "end_time", "start_frame", "sequence_id")


def stream_predictions(rows: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Windows of a video in time order with probabilities smoothed over the last few; the warm-up goes."""
    by = Window.partitionBy("video_id").orderBy(*STREAM_ORDER)
    smooth = {f"smooth_prob_{c}": F.avg(f"prob_{c}").over(by.rowsBetween(1 - cfg.smooth_windows, 0)) for c in range(CLASSES)}
    out = rows.withColumns(smooth | {"window_no": F.row_number().over(by)}).where(F.col("window_no") > cfg.warmup)
    return out.withColumn("pred_label_id", argmax3(*[F.col(f"smooth_prob_{c}") for c in range(CLASSES)]))


def change_rate(stream: DataFrame) -> DataFrame:
    """How often a video's prediction changes, as the mean over videos of two windows or more; 0 without any."""
    before = F.lag("pred_label_id").over(Window.partitionBy("video_id").orderBy(*STREAM_ORDER))
    changed = stream.withColumn("b", before).where("b IS NOT NULL")
    per = changed.groupBy("video_id").agg(F.avg((F.col("b") != F.col("pred_label_id")).cast("double")).alias("r"))
    return per.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("prediction_change_rate"))


def cv_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, std, min, max) over folds; missing values are left out."""
    long = folds.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def running_mean(batches: DataFrame, value: str, weight: str) -> DataFrame:
    return batches.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def best_epoch(history: DataFrame, value: str, min_delta: float = 1e-4, patience: int = 12, mode: str = "max") -> DataFrame:
    """(best_epoch, best_value, stopped_at) of early stopping by series: a fold over its epochs, at most a few dozen.

    ``mode``: whether a larger (max) or a smaller (min) value is the better one.
    """
    if mode not in ("max", "min"):
        raise ValueError(f"no such mode: {mode}")
    worst = float("-inf" if mode == "max" else "inf")
    state = F.struct(F.lit(0).alias("best_epoch"), F.lit(worst).alias("best_value"), F.lit(0).alias("waited"), F.lit(0).alias("stopped_at"))

    def step(s: Column, x: Column) -> Column:
        better = x["v"] > s["best_value"] + min_delta if mode == "max" else x["v"] < s["best_value"] - min_delta
        waited = F.when(better, 0).otherwise(s["waited"] + 1)
        new = F.struct(
            F.when(better, x["epoch"]).otherwise(s["best_epoch"]).alias("best_epoch"), F.when(better, x["v"]).otherwise(s["best_value"]).alias("best_value"),
            waited.alias("waited"), F.when(waited >= patience, x["epoch"]).otherwise(0).alias("stopped_at"),
        )
        return F.when(s["stopped_at"] > 0, s).otherwise(new)

    series = history.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("epoch", F.col(value).alias("v")))).alias("e"))
    return series.withColumn("r", F.aggregate("e", state, step)).select("series", "r.best_epoch", "r.best_value", "r.stopped_at")


def plateau_rates(history: DataFrame, value: str, rate: float = 1e-3, factor: float = 0.5, patience: int = 4, threshold: float = 1e-4) -> DataFrame:
    """(series, epoch, rate): the learning rate after each epoch, times ``factor`` once more than ``patience`` epochs bring no lower value.

    Lower means by the share ``threshold`` at least. A fold over a series' epochs, at most a few dozen.
    """
    state = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(rate).alias("rate"), F.array().cast("array<struct<epoch:int,rate:double>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        better = x["v"] < s["best"] * (1 - threshold)
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        new = F.when(bad > patience, s["rate"] * factor).otherwise(s["rate"])
        return F.struct(
            F.when(better, x["v"]).otherwise(s["best"]).alias("best"), F.when(bad > patience, 0).otherwise(bad).alias("bad"), new.alias("rate"),
            F.concat(s["out"], F.array(F.struct(x["epoch"].alias("epoch"), new.alias("rate")))).alias("out"),
        )

    rows = F.struct(F.col("epoch").cast("int").alias("epoch"), F.col(value).cast("double").alias("v"))
    series = history.groupBy("series").agg(F.sort_array(F.collect_list(rows)).alias("e"))
    return series.select("series", F.inline(F.aggregate("e", state, step)["out"]))
