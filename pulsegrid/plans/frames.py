"""The chain from raw frames to decided sequences; every function is a lazy DataFrame plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.config import FEATURES, FIXTURE_FRAMES, FIXTURE_SEQUENCES, BlinkConfig, FrameConfig, SequenceConfig
from pulsegrid.operators import blinks, calibration, rules, sequences, signals
from pulsegrid.sources import tables


def manifest(frames: DataFrame) -> DataFrame:
    """The fixture's manifest; the order of ids stands for the order of a file."""
    labelled = tables.label_manifest(tables.videos(frames))
    by = Window.partitionBy("subject_id").orderBy("video_id")
    return labelled.withColumn("manifest_pos", F.row_number().over(by))


def z_scores(frames: DataFrame, man: DataFrame, cfg: FrameConfig, tasks: int | None = None) -> DataFrame:
    many = (tasks or 0) > 1
    return calibration.z_scores(frames, calibration.subject_stats(frames, man, cfg, many), many)


def normalised(frames: DataFrame, man: DataFrame, cfg: FrameConfig, tasks: int | None = None) -> DataFrame:
    """``tasks`` deals the frames by video into so many; every later window of a video stays there."""
    z = z_scores(frames, man, cfg, tasks)
    return signals.smooth(signals.fill_signals(z.repartition(tasks, "video_id") if tasks else z, cfg), cfg)


def states(norm: DataFrame, cfg: BlinkConfig = BlinkConfig()) -> DataFrame:
    return signals.perclos(signals.closed_state(norm, cfg), cfg)


def rolling(norm: DataFrame, cfg: BlinkConfig = BlinkConfig(), ended: str | None = None) -> DataFrame:
    rows = states(norm, cfg)
    return blinks.sanitise(blinks.blink_rolling(rows, cfg, ended), FEATURES)


def windows(roll: DataFrame, man: DataFrame, cfg: SequenceConfig) -> DataFrame:
    return sequences.slide(roll, cfg).join(man.select("video_id", "label", "label_id", "original_label"), "video_id")


def decided(win: DataFrame, cfg: SequenceConfig, *more: Column) -> DataFrame:
    """Scored and decided sequences; ``more`` are further aggregates over their frames."""
    return sequences.decide(sequences.score(sequences.sequence_stats(win, cfg, *sequences.META, more=more), cfg))


def fixture_norm(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, manifest, normalised frames)"""
    frames = tables.frames(spark, sf_dir)
    man = manifest(frames)
    return frames, man, normalised(frames, man, FIXTURE_FRAMES, tables.tasks(frames))


def fixture_sequences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(windows, decided sequences)"""
    _, man, norm = fixture_norm(spark, sf_dir)
    win = windows(rolling(norm), man, FIXTURE_SEQUENCES)
    return win, decided(win, FIXTURE_SEQUENCES)


def with_probs(seq: DataFrame) -> DataFrame:
    """Probabilities from the sequences' scores; every seventh is surely normal."""
    total = 1 + F.col("drowsy_score") + F.col("sleepy_score")
    sure = F.col("seq_idx") % 7 == 0
    p = {"prob_0": (0.96, 1 / total), "prob_1": (0.02, F.col("drowsy_score") / total), "prob_2": (0.02, F.col("sleepy_score") / total)}
    return seq.withColumns({n: F.when(sure, a).otherwise(b) for n, (a, b) in p.items()})


def fixture_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, seq = fixture_sequences(spark, sf_dir)
    return with_probs(seq).withColumns({"true_label_id": F.col("label_id"), "pos": F.col("seq_idx")})


def fixture_ruled(spark: SparkSession, sf_dir: str, cfg: rules.RuleConfig) -> DataFrame:
    """Scores, decisions and the rule's values come from one aggregation."""
    _, man, norm = fixture_norm(spark, sf_dir)
    win = windows(rolling(norm), man, FIXTURE_SEQUENCES)
    return rules.apply_rule(with_probs(decided(win, FIXTURE_SEQUENCES, *rules.last_columns())), cfg)
