"""Leakage-free splits: held-out folds, group-aware validation, standardisers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.scalars import finite

#: Most groups whose class counts the split's search reads.
MAX_GROUPS = 1_000_000
#: Ranges of hashes (a power of two) in the ranking of a class.
RANGES = 4_096


def fold_key(c: str) -> list[Column]:
    """Natural order of fold names: prefix, number (9999 without one), whole name."""
    digits = F.regexp_extract(c, "([0-9]+)", 1)
    return [F.regexp_extract(c, "^([^0-9]*)", 1), F.when(digits == "", 9999).otherwise(digits.cast("int")), F.col(c)]


def eligible(meta: DataFrame, mode: str) -> DataFrame:
    """All rows, or those of high confidence."""
    if mode not in ("all", "high_confidence"):
        raise ValueError(f"no such mode: {mode}")
    if "is_high_confidence" not in meta.columns:  # then every row counts as such
        return meta
    return meta if mode == "all" else meta.where("is_high_confidence = 1")


def fold_masks(meta: DataFrame, test_fold: str, fold: str = "fold") -> DataFrame:
    return meta.withColumn("split", F.when(F.col(fold) == test_fold, "test").otherwise("trainval"))


def distinct_groups(meta: DataFrame, group: str, *keys: str) -> DataFrame:
    """How many groups there are, by ``keys`` if given; exact."""
    return meta.groupBy(*keys).agg(F.count_distinct(group).alias("n_groups"))


def group_class_counts(meta: DataFrame, group: str, label: str = "label_id", classes: int = 3) -> DataFrame:
    """The contingency table of groups and classes: all that a split search needs."""
    return meta.groupBy(group).agg(*[F.count_if(F.col(label) == c).alias(f"n_{c}") for c in range(classes)])


def choose_groups(names: list[str], counts: np.ndarray, ratio: float, seed: int) -> list[str]:
    """The validation groups whose class shares come nearest to the whole, of random tries.

    ``counts`` holds a row per group of ``names`` (sorted) and a column per class. A class
    that a side lacks weighs ten. The first best try wins; fewer than two groups give none.
    """
    if len(names) < 2:
        return []
    rng, whole = np.random.default_rng(seed), counts.sum(0).astype(float)
    # Fixed values below: 1000, 100 and 20 bound the tries, 10.0 is the weight of a missing class.
    share = lambda x: x / max(x.sum(), 1.0)
    size = min(max(1, round(len(names) * ratio)), len(names) - 1)
    best, chosen = np.inf, []
    for _ in range(min(1000, max(100, 20 * len(names)))):
        pick = rng.choice(len(names), size=size, replace=False)
        val = counts[pick].sum(0).astype(float)
        rest = whole - val
        if not val.sum() or not rest.sum():
            continue
        off = np.abs(share(val) - share(whole)).sum() + 10.0 * ((val == 0).sum() + (rest == 0).sum())
        if off < best:
            best, chosen = off, [names[i] for i in pick]
    return chosen


def group_split(meta: DataFrame, group: str = "subject_id", ratio: float = 0.2, seed: int = 42, classes: int = 3, label: str = "label_id") -> DataFrame:
    """Adds split, train or val, so that no group is in both.

    The search reads the contingency table only, one row per group, of which there may be
    ``MAX_GROUPS``; the chosen names, a fraction of the groups, go back as a join.
    """
    chosen = validation_groups(meta, group, ratio, seed, classes, label)
    if not chosen:
        raise ValueError(f"no split by {group}: fewer than two groups, or a side without labels")
    return _by_group(meta, group, chosen)


def validation_groups(meta: DataFrame, group: str, ratio: float, seed: int, classes: int = 3, label: str = "label_id") -> list:
    """The groups of the validation side; none where no split by groups exists."""
    table = group_class_counts(meta, group, label, classes).orderBy(group).limit(MAX_GROUPS + 1).collect()
    if len(table) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    counts = np.array([[r[f"n_{c}"] for c in range(classes)] for r in table], dtype=np.int64).reshape(len(table), classes)
    return choose_groups([r[group] for r in table], counts, ratio, seed)


def _by_group(meta: DataFrame, group: str, chosen: list) -> DataFrame:
    schema = T.StructType([T.StructField(group, meta.schema[group].dataType)])
    names = meta.sparkSession.createDataFrame([(g,) for g in chosen], schema).withColumn("__val", F.lit(1))
    return meta.join(names, group, "left").withColumn("split", F.when(F.col("__val") == 1, "val").otherwise("train")).drop("__val").select(*meta.columns, "split")


def portable_hash(key: str, seed: int = 42) -> Column:
    """A seeded 64-bit hash that other engines compute too: the first 60 bits of an MD5."""
    first = F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string"))), 1, 15)
    return (F.conv(first, 16, 10).cast("long") - F.lit(1 << 59)) * 16


def stratified_split(meta: DataFrame, key: str, label: str = "label_id", ratio: float = 0.2, seed: int = 42, hashed: Column | None = None) -> DataFrame:
    """Adds split by class: the share of each class with the least seeded hash is val; a single row is train.

    ``hashed`` is a 64-bit hash of the key, never null, in place of the seeded one.

    Ranks are found in two levels, so that no class lies in one task: counts by class and
    range of hashes with running sums over the ranges (``RANGES`` a class), then places within a range.
    """
    h = F.xxhash64(F.lit(seed), key) if hashed is None else hashed
    rows = meta.withColumns({"__h": h, "__b": F.shiftright(h, 64 - RANGES.bit_length() + 1)})
    by = Window.partitionBy("__l")
    sums = rows.groupBy(F.col(label).alias("__l"), F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    sums = sums.withColumns({"__before": F.sum("__n").over(by.orderBy("__c")) - F.col("__n"), "__all": F.sum("__n").over(by)})
    nth = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key))
    both = rows.withColumn("__r", nth).join(sums, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__c")))
    n = F.col("__all")
    take = F.when(n > 1, F.greatest(F.lit(1), F.bround(n * F.lit(ratio)).cast("int"))).otherwise(0)
    return both.withColumn("split", F.when(F.col("__before") + F.col("__r") <= take, "val").otherwise("train")).select(*meta.columns, "split")


def train_val(meta: DataFrame, key: str, group: str = "subject_id", ratio: float = 0.2, seed: int = 42, fallback: bool = True, hashed: Column | None = None, label: str = "label_id", classes: int = 3) -> DataFrame:
    """Adds split, train or val: by groups, or by class where no split by groups exists and ``fallback`` allows that."""
    if chosen := validation_groups(meta, group, ratio, seed, classes, label):
        return _by_group(meta, group, chosen)
    if not fallback:
        raise ValueError(f"no split by {group}, and the one by class is not allowed")
    return stratified_split(meta, key, label, ratio, seed, hashed)


def fold_split(meta: DataFrame, test_fold: str, key: str, mode: str = "high_confidence", full_test: bool = True, fold: str = "fold", **split) -> DataFrame:
    """Adds split, train, val or test: the test fold, whole or its eligible rows, and a split of the other folds' eligible rows.

    Rows that no side takes are left out. A side without rows raises. ``split`` are settings
    of ``train_val``.
    """
    own = F.col(fold).cast("string") == test_fold
    able = eligible(meta, mode)
    test = (meta if full_test and mode == "high_confidence" else able).where(own)
    rest = able.where(~own | F.col(fold).isNull())
    for name, side in (("test", test), ("train or validation", rest)):
        if side.isEmpty():
            raise ValueError(f"no {name} rows for fold {test_fold} in mode {mode}")
    return train_val(rest, key, **split).unionByName(test.withColumn("split", F.lit("test")))


def final_split(meta: DataFrame, key: str, mode: str = "high_confidence", seed: int = 42, **split) -> DataFrame:
    """Adds split, train or val, to all eligible rows, with a seed apart from the folds'; no eligible rows raise."""
    able = eligible(meta, mode)
    if able.isEmpty():
        raise ValueError(f"no rows in mode {mode}")
    return train_val(able, key, seed=seed + 999, **split)


def tagged(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables put together, each row with the name of its own."""
    first, *rest = [df.withColumn("split", F.lit(name)) for name, df in parts.items()]
    for df in rest:
        first = first.unionByName(df)
    return first


def standardizer(values: DataFrame, train: Column, feature: str = "feature", value: str = "value", floor: float = 1e-6) -> DataFrame:
    """(feature, mean, std) over the rows where ``train`` holds, missing and infinite values as 0; a deviation below the floor counts as 1."""
    rows = values.where(train).select(feature, F.coalesce(finite(F.col(value)), F.lit(0.0)).alias("__v"))
    s = F.stddev_pop("__v")
    return rows.groupBy(feature).agg(F.avg("__v").alias("mean"), F.when(s < floor, 1.0).otherwise(s).alias("std"))


def standardize(values: DataFrame, stats: DataFrame, feature: str = "feature", value: str = "value", out: str = "z") -> DataFrame:
    """Adds ``out``: the cleaned value less the feature's mean, over its deviation. ``stats`` has a row per feature."""
    clean = F.coalesce(finite(F.col(value)), F.lit(0.0))
    return values.join(F.broadcast(stats), feature).withColumn(out, (clean - F.col("mean")) / F.col("std")).drop("mean", "std")


def class_weights(rows: DataFrame, target: str) -> DataFrame:
    """N / (2 n_c) of a binary target; no rows if a class is absent."""
    counts = rows.agg(*[F.count_if(F.col(target) == c).alias(f"n{c}") for c in (0, 1)])
    both = counts.where("n0 > 0 AND n1 > 0")
    return both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("class_id"), ((F.col("n0") + F.col("n1")) / (2.0 * F.col(f"n{c}"))).alias("weight")) for c in (0, 1)])))
