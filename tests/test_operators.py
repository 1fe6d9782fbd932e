"""Edge fixtures and sequential oracles for the frame operators."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid import config as C
from pulsegrid.functions import scalars as S
from pulsegrid.operators import blinks, metrics, rules, sequences, signals, splits
from pulsegrid.sources import sinks, tables


def series(spark, values, column="mar", fps=15.0):
    rows = [("V", i, i / fps, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"video_id string, processed_idx long, timestamp double, {column} double")


def interpolated(spark, values):
    out = signals.interpolate(series(spark, values), ("mar",), 5).orderBy("processed_idx").collect()
    return [r["mar"] for r in out]


def test_interpolation_gap_of_twelve(spark):
    got = interpolated(spark, [0.0, *[None] * 12, 13.0])
    assert got[:6] == pytest.approx([0, 1, 2, 3, 4, 5]) and got[6:8] == [None, None] and got[8:] == pytest.approx([8, 9, 10, 11, 12, 13])


def test_interpolation_edges(spark):
    assert interpolated(spark, [*[None] * 7, 2.0]) == [None, None, 2, 2, 2, 2, 2, 2]
    assert interpolated(spark, [2.0, *[None] * 7]) == [2, 2, 2, 2, 2, 2, None, None]
    assert interpolated(spark, [None] * 4) == [None] * 4


def test_interpolation_equals_pandas(spark):
    rng = random.Random(3)
    values = [rng.random() if rng.random() < 0.4 else None for _ in range(300)]
    want = pd.Series(values, dtype=float).interpolate(method="linear", limit=5, limit_direction="both")
    got = pd.Series(interpolated(spark, values), dtype=float)
    assert np.array_equal(got.to_numpy(), want.to_numpy(), equal_nan=True)


def latch(values, cfg=C.BlinkConfig()):
    state, out = 0, []
    for p in values:
        p = float(np.float32(p))
        state = 1 if p >= cfg.start else 0 if p <= cfg.end else state
        out.append(state)
    return out


@pytest.mark.parametrize("values", [[0.5] * 5, [0.7, 0.3, 0.71, 0.5, 0.29, 0.5], [0.9, 0.9, 0.1, 0.8]])
def test_latch(spark, values):
    df = series(spark, values, "p_closed_smooth").withColumn("p_closed_smooth", F.col("p_closed_smooth").cast("float"))
    got = [r["closed_state"] for r in signals.closed_state(df).orderBy("processed_idx").collect()]
    assert got == latch(values)


def test_latch_needs_ordered_thresholds():
    with pytest.raises(ValueError):
        C.BlinkConfig(start=0.3, end=0.7)


def machine(rows, cfg):
    """The blink machine, row by row."""
    out, opened, last = [], None, -1e9
    for i, (t, p, ear) in enumerate(rows):
        if opened is None:
            if p >= cfg.start and t - last >= cfg.min_gap:
                opened = i
        elif p <= cfg.end:
            part = rows[opened : i + 1]
            took, low = t - part[0][0], min(x[2] for x in part)
            if cfg.min_duration <= took <= cfg.max_duration and (part[0][2] + ear) / 2 - low >= cfg.min_amplitude:
                out.append((opened, i))
                last = t
            opened = None
    return out


@pytest.mark.parametrize("fps", [15.0, 22.0, 30.0, 60.0])
def test_blinks_equal_the_machine(spark, fps):
    rng, cfg = random.Random(int(fps)), C.BlinkConfig()
    rows, p = [], 0.0
    for i in range(500):
        p = rng.choice([0.0, 1.0, 0.5]) if rng.random() < 0.4 else p
        rows.append((i / fps, p, float(np.float32(rng.gauss(0, 1)))))
    df = spark.createDataFrame([("V", i, 2 * i, *r) for i, r in enumerate(rows)], "video_id string, processed_idx long, frame_idx long, timestamp double, p_closed_smooth float, ear_z float")
    events = blinks.blink_events_with_gap(signals.closed_state(df, cfg), cfg)
    assert sorted((r["start_idx"], r["end_idx"]) for r in events.collect()) == machine(rows, cfg)
    free = C.BlinkConfig(min_gap=0.0)
    plain = blinks.blink_events(signals.closed_state(df, free), free)
    assert sorted((r["start_idx"], r["end_idx"]) for r in plain.collect()) == machine(rows, free)


def test_unterminated_closure_is_no_event(spark):
    df = spark.createDataFrame([("V", i, i, i / 15, 1.0, -float(i)) for i in range(9)], "video_id string, processed_idx long, frame_idx long, timestamp double, p_closed_smooth float, ear_z float")
    state = signals.closed_state(df)
    assert blinks.blink_events(state).count() == 0
    assert state.agg(F.max("current_closed_duration")).first()[0] == pytest.approx(8 / 15)


def test_sequences_of_short_and_exact_videos(spark):
    cfg = C.SequenceConfig(length=10, stride=4)
    rows = [(f"V{n}", i, i / 15) for n in (9, 10, 14, 25) for i in range(n)]
    df = spark.createDataFrame(rows, "video_id string, processed_idx long, timestamp double")
    got = sequences.slide(df, cfg).groupBy("video_id", "seq_idx").agg(F.count("*").alias("n"), F.min("processed_idx").alias("lo")).collect()
    assert sorted((r["video_id"], r["seq_idx"]) for r in got) == sorted((f"V{n}", k) for n in (10, 14, 25) for k in range((n - 10) // 4 + 1))
    assert all(r["n"] == 10 and r["lo"] == 4 * r["seq_idx"] for r in got)


def ruled(spark, cfg=C.RuleConfig(), **values):
    base = dict(last_closed=0.0, last_perclos=0.0, last_p=0.0, last_pitch=0.0, last_yaw=0.0, last_roll=0.0, max_closed=0.0, max_mar=0.0, prob_0=0.5, prob_1=0.3, prob_2=0.2) | values
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {'double' if k[0] == 'p' else 'float'}" for k in base))
    return rules.apply_rule(df, cfg).first()


def test_rule_compares_in_single_precision(spark):
    assert ruled(spark, last_perclos=float(np.float32(0.7)))["rule_mask"]


def test_rule_boost_without_other_mass(spark):
    row = ruled(spark, last_closed=2.0, prob_0=0.0, prob_1=0.0, prob_2=0.0)
    assert [row[f"prob_rule_{c}"] for c in range(3)] == pytest.approx([0.0, 0.35, 0.65]) and row["pred_rule"] == 2


def test_rule_guard(spark):
    assert not ruled(spark, last_perclos=0.9, prob_0=0.96)["rule_mask"]
    assert ruled(spark, last_perclos=0.9, max_closed=2.0, prob_0=0.96)["rule_mask"]


@pytest.mark.parametrize("preds, want", [([2, 1, 1, 2], 2), ([1, 2, 2, 1], 1)])
def test_vote_takes_the_first_of_equals(spark, preds, want):
    rows = [("V", i, 0, *[1.0 if c == p else 0.0 for c in range(3)]) for i, p in enumerate(preds)]
    df = spark.createDataFrame(rows, "video_id string, pos int, true_label_id int, prob_0 double, prob_1 double, prob_2 double")
    assert metrics.video_predictions(df).first()["pred_label_id"] == want


def test_metrics_of_absent_classes(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "t int, p int")
    row = metrics.summary(df, "t", "p").first()
    assert row["recall_0"] is None and row["normal_false_alarm_rate"] is None
    assert row["macro_f1"] == pytest.approx((0.8 + 0.0) / 2)


def test_group_split_does_not_leak_and_repeats(spark):
    df = spark.createDataFrame([(i, f"s{i % 9}", i % 3) for i in range(200)], "k int, subject_id string, label_id int")
    one, two = (sorted(map(tuple, splits.group_split(df).collect())) for _ in range(2))
    assert one == two
    sides = {}
    for _, s, _, split in [(r[0], r[1], r[2], r[3]) for r in splits.group_split(df).select("k", "subject_id", "label_id", "split").collect()]:
        sides.setdefault(s, set()).add(split)
    assert all(len(x) == 1 for x in sides.values()) and {"train", "val"} == set().union(*sides.values())
    assert splits.choose_groups(["a"], np.ones((1, 3)), 0.2, 1) == []


def test_best_epoch(spark):
    values = [0.1, 0.3, 0.2, 0.30005, 0.2]
    df = spark.createDataFrame([("s", i + 1, v) for i, v in enumerate(values)], "series string, epoch int, v double")
    row = metrics.best_epoch(df, "v", patience=3).first()
    assert (row["best_epoch"], row["stopped_at"]) == (2, 5)


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.csv"
    lines = ["video_id,fold,part,subject_id,score_label,video_path", "A,Fold1,p,01,0,x", "A,Fold1,p,02,5,x", "A,Fold1,p,10,10,x", "B,Fold1,p,3,10_1,x"]
    path.write_text("﻿" + "\n".join(lines), encoding="utf-8")
    rows = sorted((r["video_id"], r["subject_id"], r["label"]) for r in tables.read_manifest(spark, str(path)).collect())
    assert rows == [("A", "1", "normal"), ("A_dup2", "2", "drowsy"), ("A_dup3", "10", "sleepy")]
    path.write_text("video_id,fold\nA,B")
    with pytest.raises(ValueError):
        tables.read_manifest(spark, str(path))


def test_small_sources(spark, tmp_path):
    schema = spark.createDataFrame([], "a int").schema
    assert tables.read_csv_or_empty(spark, str(tmp_path / "none.csv"), schema).count() == 0
    (tmp_path / "zero.csv").write_text("")
    assert tables.read_csv_or_empty(spark, str(tmp_path / "zero.csv"), schema).count() == 0
    assert tables.feature_order(None) == C.FEATURES
    assert tables.feature_order(json.dumps({"frame_feature_order": ["a"]})) == ("a",)
    a = spark.createDataFrame([("a", 0)], "class_name string, class_id int")
    with pytest.raises(ValueError):
        tables.same_classes([a, a.withColumn("class_id", F.lit(1))])


def test_blink_ids_begin_at_zero(spark):
    p = [0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0]
    df = spark.createDataFrame([("V", i, i, i / 15, v, -v) for i, v in enumerate(p)], "video_id string, processed_idx long, frame_idx long, timestamp double, p_closed_smooth float, ear_z float")
    rows = blinks.blink_events(signals.closed_state(df)).orderBy("start_idx").collect()
    assert [(r["blink_id"], r["start_idx"], r["end_idx"]) for r in rows] == [(0, 1, 3), (1, 5, 7)]
    assert [r["frequency"] for r in rows] == pytest.approx([1 / (3 / 15), 2 / (7 / 15)])


@pytest.mark.parametrize("fps", [15.0, 30.0])
def test_events_in_place_equal_the_events(spark, fps):
    rng, cfg = random.Random(int(fps) + 1), C.BlinkConfig(min_gap=0.0)
    p, rows = 0.0, []
    for i in range(400):
        p = rng.choice([0.0, 1.0, 0.5]) if rng.random() < 0.4 else p
        rows.append((f"V{i % 2}", i // 2, i, i // 2 / fps, p, rng.gauss(0, 1)))
    df = signals.closed_state(spark.createDataFrame(rows, "video_id string, processed_idx long, frame_idx long, timestamp double, p_closed_smooth float, ear_z float"), cfg)
    events = {(r["video_id"], r["end_idx"]): (r["end_time"], r["duration_sec"], r["amplitude"], r["opening_velocity"]) for r in blinks.blink_events(df, cfg).collect()}
    placed = blinks._events_in_place(df, cfg).where("__end IS NOT NULL").collect()
    got = {(r["video_id"], r["processed_idx"]): (r["__end"], r["__duration_sec"], r["__amplitude"], r["__opening_velocity"]) for r in placed}
    assert got == events and len(got) > 10


def test_rule_guard_is_in_double_precision(spark):
    """The nearest single to 0.95 lies below it: not guarded."""
    assert ruled(spark, last_perclos=0.9, prob_0=float(np.float32(0.95)))["rule_mask"]
    assert not ruled(spark, last_perclos=0.9, prob_0=0.95)["rule_mask"]


def test_rule_off_and_absent_features(spark):
    row = ruled(spark, C.RuleConfig(use_rule=False), last_perclos=0.9, prob_0=0.2, prob_1=0.5, prob_2=0.1)
    assert not row["rule_mask"] and row["pred_rule"] == 1 and row["prob_rule_1"] == pytest.approx(0.5)
    few = tuple(c for c in C.FEATURES if c not in ("perclos_10s", "current_closed_duration", "yaw_z"))
    df = spark.createDataFrame([(0.0, 3.0, 0.0, 0.5), (0.0, 0.0, 0.0, 0.5), (0.0, 3.0, 0.0, 0.95)], "last_p float, last_pitch float, last_roll float, prob_0 double")
    got = df.select(rules.sleepy_mask(C.RuleConfig(), few).alias("m")).collect()
    assert [r["m"] for r in got] == [True, False, False]


def test_sequence_ids_keep_all_digits(spark):
    from pulsegrid.functions.scalars import sequence_id

    df = spark.createDataFrame([(7,), (123456,), (123457,), (None,)], "n long")
    assert [r[0] for r in df.select(sequence_id(F.lit("v"), F.col("n"))).collect()] == ["v_seq00007", "v_seq123456", "v_seq123457", None]


def test_standardizer_reads_clean_train_rows(spark):
    rows = [("a", 1.0, 1), ("a", 3.0, 1), ("a", float("nan"), 1), ("a", None, 1), ("a", 1000.0, 0), ("b", 5.0, 1), ("b", 5.0, 1)]
    df = spark.createDataFrame(rows, "feature string, value double, train int")
    stats = splits.standardizer(df, F.col("train") == 1)
    got = {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}
    assert got == {"a": (1.0, pytest.approx(np.std([1, 3, 0, 0]))), "b": (5.0, 1.0)}
    z = splits.standardize(df, stats).where("value = 1000").first()["z"]
    assert z == pytest.approx(999 / np.std([1, 3, 0, 0]))


@pytest.mark.parametrize("ranges", [1, 4, 4096])
def test_stratified_split_ranks_in_two_levels(spark, monkeypatch, ranges):
    monkeypatch.setattr(splits, "RANGES", ranges)
    df = spark.createDataFrame([(i, (i % 7 > 0) + (i % 50 == 0)) for i in range(300)] + [(900, 9), (901, None), (902, None)], "k int, label_id int")
    got = splits.stratified_split(df, "k").withColumn("h", F.xxhash64(F.lit(42), "k")).collect()
    for label in {r["label_id"] for r in got}:
        own = sorted((r["h"], r["k"], r["split"]) for r in got if r["label_id"] == label)
        take = max(1, round(len(own) * 0.2)) if len(own) > 1 else 0
        assert [s for *_, s in own] == ["val"] * take + ["train"] * (len(own) - take)


def test_group_split_of_numbers_and_its_bound(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 9, i % 3) for i in range(90)], "k int, subject_id int, label_id int")
    assert {r["split"] for r in splits.group_split(df).collect()} == {"train", "val"}
    monkeypatch.setattr(splits, "MAX_GROUPS", 5)
    with pytest.raises(ValueError):
        splits.group_split(df)


def test_arrays_are_checked(spark):
    x = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "k int, x array<double>")
    meta = spark.createDataFrame([(1, 0, "a"), (2, 2, "b")], "k int, label_id int, fold string")
    assert tables.checked_arrays(x, meta, "k", ("fold",)).count() == 2
    assert [r["k"] for r in tables.checked_arrays(x, meta, "k", ("fold",), 1).collect()] == [1]
    for bad in (meta.drop("fold"), meta.limit(1), meta.withColumn("label_id", F.lit(3))):
        with pytest.raises(ValueError):
            tables.checked_arrays(x, bad, "k", ("fold",)).count()


@pytest.mark.parametrize("name", ["q_blink_rolling", "q_video_vote", "q_sleepy_boost"])
def test_the_frame_chain_runs_once_after_calibration(spark, name):
    """Scans of the fixture: the chain itself, the manifest's and the calibration's."""
    from conftest import SF

    from pulsegrid.plans.queries import QUERIES

    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4, plan.count("FileScan")


def test_calibration_is_one_pass(spark):
    from conftest import SF

    from pulsegrid.plans.queries import QUERIES

    plan = QUERIES["q_smooth"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 3 and plan.count("Exchange ") <= 7, plan


@pytest.mark.parametrize("ranges", [1, 3, 1024])
def test_repeats_are_numbered_in_order(spark, monkeypatch, ranges):
    monkeypatch.setattr(tables, "RANGES", ranges)
    rows = [("a" if i % 3 else f"v{i % 4}", (i * 37) % 101 - 20) for i in range(101)] + [(None, 500), (None, 501), ("a", None)]
    got = tables.unique_ids(spark.createDataFrame(rows, "video_id string, at long"), "at").collect()
    seen = {}
    for v, at in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        seen.setdefault(v, []).append(at)
    want = [(v, v if n == 0 or v is None else f"{v}_dup{n + 1}", at) for v, ats in seen.items() for n, at in enumerate(ats)]
    assert sorted(((r.video_id_original, r.video_id, r.at) for r in got), key=repr) == sorted(want, key=repr)
    none = spark.createDataFrame([], "video_id string, at long")
    assert tables.unique_ids(none, "at").count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("Fold1", "a", 1.5), ("Fold1", "b", None), ("Fold2", "c", 2.0)], "fold string, video_id string, v double")
    sinks.write_frames(rows, f"{tmp_path}/frames")
    assert sorted(p.name for p in (tmp_path / "frames").iterdir() if p.is_dir()) == ["fold=Fold1", "fold=Fold2"]
    assert sorted(spark.read.parquet(f"{tmp_path}/frames").select("fold", "video_id", "v").collect(), key=str) == sorted(rows.collect(), key=str)
    sinks.write_csv(rows, f"{tmp_path}/csv")
    assert sorted(tables.read_csv_or_empty(spark, f"{tmp_path}/csv", rows.schema).collect(), key=str) == sorted(rows.collect(), key=str)
    sinks.write_json(rows, f"{tmp_path}/json")
    assert sorted(spark.read.schema(rows.schema).json(f"{tmp_path}/json").collect(), key=str) == sorted(rows.collect(), key=str)


def test_an_empty_sink_keeps_its_columns(spark, tmp_path):
    none = spark.createDataFrame([], "fold string, video_id string, x array<array<float>>")
    none.write.parquet(f"{tmp_path}/x")
    assert spark.read.parquet(f"{tmp_path}/x").schema == none.schema


def test_images_by_folder(spark, tmp_path):
    for name in ("open/1.png", "closed/2.png", "open/3.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = tables.read_images(spark, str(tmp_path)).select("class_name", "class_id").collect()
    assert sorted(map(tuple, got)) == [("closed", 0), ("open", 1), ("open", 1)]


@pytest.mark.parametrize("way, want", [("abs", 3.0), ("positive", 2.0), ("negative", 3.0)])
def test_head_down_directions(spark, way, want):
    cfg = C.SequenceConfig(length=3, stride=3, head_down=way)
    rows = series(spark, [2.0, -3.0, 1.0], "pitch_z").withColumns({"frame_idx": F.col("processed_idx"), "face_detected": F.lit(1), "seq_idx": F.lit(0), "start_row": F.lit(0)})
    zero = ("perclos_10s", "current_closed_duration", "p_closed", "mar_z", "avg_blink_duration_10s", "blink_frequency_10s")
    row = sequences.sequence_stats(rows.withColumns({c: F.lit(0.0) for c in zero}), cfg).first()
    assert row["max_head_down_z"] == want and row["max_abs_pitch_z"] == 3.0


def test_numbers_in_text(spark):
    rows = [("1.5",), (" -2e1 ",), (".5",), ("3.",), ("nan",), ("inf",), ("1d",), ("x",), ("",), (None,)]
    got = spark.createDataFrame(rows, "s string").select(S.safe_float(F.col("s"), 9.0).alias("v")).collect()
    assert [r["v"] for r in got] == [1.5, -20.0, 0.5, 3.0] + [9.0] * 6
    nums = spark.createDataFrame([(1e-7,), (float("nan"),), (float("-inf"),), (None,)], "v double")
    assert [r["v"] for r in nums.select(S.safe_float(F.col("v"), None).alias("v")).collect()] == [1e-7, None, None, None]
    arrays = spark.createDataFrame([([1.0, float("nan"), None, float("inf")],), ([],), (None,)], "x array<double>")
    assert [r["x"] for r in arrays.select(S.nan_to_num(F.col("x")).alias("x")).collect()] == [[1.0, 0.0, 0.0, 0.0], [], None]


def test_plateau_halves_after_the_fifth_epoch_without_a_lower_value(spark):
    values = [1.0, 0.5, 0.5, 0.49999, 0.6, 0.5, 0.5, 0.4, 0.5]
    df = spark.createDataFrame([("s", i + 1, v) for i, v in enumerate(values)], "series string, epoch int, v double")
    got = {r["epoch"]: r["rate"] for r in metrics.plateau_rates(df, "v", rate=1.0).collect()}
    assert got == {e: 0.5 if e >= 7 else 1.0 for e in range(1, 10)}
    assert metrics.plateau_rates(df.limit(0), "v").count() == 0


def test_portable_hash_covers_all_64_bits(spark):
    rows = spark.range(2_000).select(splits.portable_hash("id").alias("h"), F.lit(None).cast("long").alias("id")).agg(F.min("h"), F.max("h")).first()
    assert rows[0] < -(1 << 62) and rows[1] > 1 << 62
    assert spark.range(1).select(F.lit(None).cast("long").alias("k")).select(splits.portable_hash("k").alias("h")).first()["h"] is not None
