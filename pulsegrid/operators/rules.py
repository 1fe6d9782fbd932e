"""Probability post-rules and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.config import FEATURES, RuleConfig
from pulsegrid.functions.scalars import argmax3, f32, f64, finite


#: Columns of the rule: (the last frame's value of a feature) and (the sequence's maximum of one).
LAST = {
    "last_closed": "current_closed_duration", "last_perclos": "perclos_10s", "last_p": "p_closed",
    "last_pitch": "pitch_z", "last_yaw": "yaw_z", "last_roll": "roll_z",
}
MAXIMA = {"max_closed": "current_closed_duration", "max_mar": "mar_z"}


def last_columns(features: tuple[str, ...] = FEATURES) -> list[Column]:
    """Aggregates over a sequence's frames that the rule reads, missing values as 0; of absent features none."""
    clean = lambda c: F.coalesce(finite(F.col(c)), f32(F.lit(0.0)))
    last = [F.max_by(clean(c), "processed_idx").alias(n) for n, c in LAST.items() if c in features]
    return last + [F.max(clean(c)).alias(n) for n, c in MAXIMA.items() if c in features]


def sleepy_mask(cfg: RuleConfig = RuleConfig(), features: tuple[str, ...] = FEATURES) -> Column:
    """The rule's condition over ``last_columns`` and prob_0.

    Features are compared in single precision, the probability in double. A clause falls
    away with a feature that is not there; a rule that is off holds nowhere.
    """
    known = {n for n, c in (LAST | MAXIMA).items() if c in features}
    at_least = lambda c, x: f32(F.col(c)) >= f32(F.lit(x)) if c in known else F.lit(False)
    if not cfg.use_rule:
        return F.lit(False)
    mask = at_least("last_closed", cfg.closed_sec) | at_least("max_closed", cfg.max_closed_sec) | at_least("last_perclos", cfg.perclos)
    mask = mask | (at_least("last_p", cfg.p_closed) & at_least("last_perclos", cfg.p_closed_perclos))
    if cfg.use_yawn:  # before the head: the head does not count as a sign for a yawn
        mask = mask | (at_least("max_mar", cfg.yawn_z) & (mask | at_least("last_p", cfg.yawn_p_closed)))
    if cfg.use_head:
        for c in ("last_pitch", "last_yaw", "last_roll"):
            if c in known:
                mask = mask | (F.abs(f32(F.col(c))) >= f32(F.lit(cfg.head_z)))
    return mask & (~(f64(F.col("prob_0")) >= F.lit(cfg.normal_guard)) | at_least("max_closed", cfg.closed_sec))


def apply_rule(rows: DataFrame, cfg: RuleConfig = RuleConfig(), features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Adds rule_mask, prob_rule_0..2 and pred_rule, the first largest before single precision.

    A rule that is off leaves the probabilities as they are.
    """
    p0, p1, p2 = (f64(F.col(f"prob_{c}")) for c in range(3))
    rows = rows.withColumn("rule_mask", sleepy_mask(cfg, features))
    if not cfg.use_rule:
        return rows.withColumns({"pred_rule": argmax3(p0, p1, p2)} | {f"prob_rule_{c}": f32(p) for c, p in enumerate((p0, p1, p2))})
    if cfg.mode == "force":
        hit, new = F.col("rule_mask"), (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    else:
        rest, room = p0 + p1, 1.0 - cfg.min_sleepy
        hit = F.col("rule_mask") & (p2 < cfg.min_sleepy)
        new = (
            F.when(rest > 1e-8, p0 / rest * room).otherwise(0.0), F.when(rest > 1e-8, p1 / rest * room).otherwise(room), F.lit(cfg.min_sleepy),
        )
    raw = [F.when(hit, n).otherwise(p) for n, p in zip(new, (p0, p1, p2))]
    rows = rows.withColumns({f"__r{c}": x for c, x in enumerate(raw)})
    total = F.greatest(F.col("__r0") + F.col("__r1") + F.col("__r2"), F.lit(1e-8))
    rows = rows.withColumns({f"__q{c}": F.col(f"__r{c}") / total for c in range(3)})
    out = {"pred_rule": argmax3(*[F.col(f"__q{c}") for c in range(3)])} | {f"prob_rule_{c}": f32(F.col(f"__q{c}")) for c in range(3)}
    return rows.withColumns(out).drop(*[f"__{x}{c}" for x in "rq" for c in range(3)])


def _cross_entropy(logits: tuple[Column, Column], target: Column, smoothing: float, weights: tuple[float, float]) -> tuple[Column, Column]:
    """(smoothed loss of a row, its weight): a weighted mean divides the sums of both."""
    top = F.greatest(*logits)
    norm = top + F.log(F.exp(logits[0] - top) + F.exp(logits[1] - top))
    own = F.when(target == 0, weights[0] * (norm - logits[0])).otherwise(weights[1] * (norm - logits[1]))
    every = weights[0] * (norm - logits[0]) + weights[1] * (norm - logits[1])
    return (1 - smoothing) * own + smoothing / 2 * every, F.when(target == 0, weights[0]).otherwise(weights[1])


def hierarchical_loss(
    rows: DataFrame, smoothing: float = 0.03, weights: tuple[float, float] = (1.0, 1.0),
    abnormal_weights: tuple[float, float] = (1.0, 1.0), stage_weights: tuple[float, float] = (1.0, 1.0),
) -> DataFrame:
    """One row: abnormal_loss, stage_loss (over abnormal rows; 0 without any) and their weighted sum.

    Reads a0, a1, s0, s1 (logits) and y (0, 1, 2). The class weights of a head (see
    ``splits.class_weights``) count its rows and the terms of the smoothing.
    """
    y = F.col("y")
    loss, count = _cross_entropy((F.col("a0"), F.col("a1")), (y > 0).cast("int"), smoothing, abnormal_weights)
    own, own_count = (F.when(y > 0, c) for c in _cross_entropy((F.col("s0"), F.col("s1")), y - 1, smoothing, stage_weights))
    out = rows.agg((F.sum(loss) / F.sum(count)).alias("abnormal_loss"), F.coalesce(F.sum(own) / F.sum(own_count), F.lit(0.0)).alias("stage_loss"))
    return out.withColumn("loss", weights[0] * F.col("abnormal_loss") + weights[1] * F.col("stage_loss"))
