"""Windows over segments and time joins equal those over whole videos, and brute force."""

import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from pulsegrid.config import SHORT_BLINKS, Z_COLUMNS, BlinkConfig, FrameConfig
from pulsegrid.operators import blinks, segments, signals, time_joins
from pulsegrid.plans import frames as frame_plans
from pulsegrid.sources import tables

FRAMES = f"video_id string, processed_idx long, frame_idx long, timestamp double, p_closed double, {', '.join(f'{z} float' for z in Z_COLUMNS)}"
STATES = ["video_id", "processed_idx", "p_closed", *Z_COLUMNS, "p_closed_smooth", "closed_state", "current_closed_duration"]
ROLLED = ["video_id", "processed_idx", "perclos_10s", *blinks.ROLLED, "blink_frequency_10s", "time_since_last_blink"]


def frames_of(seed):
    """Three videos with gaps in time, missing values, closures of many lengths; one starts closed, one is a single frame."""
    rng = random.Random(seed)
    for video, n in (("a", 900), ("b", 70), ("c", 1)):
        t, closed, left = 0.0, video == "a", 10
        for i in range(n):
            t += 1 / 15 if rng.random() > 0.01 else rng.choice([0.9, 3.1, 14.0])
            left -= 1
            if left <= 0:
                closed, left = not closed, rng.choice([1, 2, 6, 9, 25, 60])
            p = None if rng.random() < 0.15 else rng.uniform(0.75, 1.0) if closed else rng.uniform(0.0, 0.25)
            z = [None if rng.random() < 0.1 else rng.uniform(-3, 3) - 2 * closed for _ in Z_COLUMNS]
            yield (video, i, 2 * i, t, p, *z)


@pytest.fixture(scope="module")
def z(spark):
    return spark.createDataFrame(list(frames_of(4)), FRAMES).repartition(3).cache()


def told(rows, columns):
    return sorted(tuple(r) for r in rows.select(*columns).collect())


def same(got, want):
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and all(x == y if not isinstance(x, float) else abs(x - y) < 1e-9 for x, y in zip(a[2:], b[2:])), (a, b)


@pytest.mark.parametrize("seconds", [0.1, 0.7, 3.0, 20.0, 1e6])
def test_segments_equal_whole_videos(z, seconds):
    whole = signals.closed_state(signals.smooth(signals.fill_signals(z)))
    parts = segments.chain(z, seconds=seconds, keep=lambda df: df.checkpoint()).cache()
    same(told(parts, STATES), told(whole, STATES))
    same(told(segments.rolling(parts, SHORT_BLINKS, seconds), ROLLED), told(blinks.blink_rolling(signals.perclos(whole, SHORT_BLINKS), SHORT_BLINKS), ROLLED))
    want = blinks.blink_events(whole)
    same(told(segments.events(parts, BlinkConfig(), seconds), ["video_id", "blink_id", *want.drop("video_id", "blink_id").columns]), told(want, ["video_id", "blink_id", *want.drop("video_id", "blink_id").columns]))
    parts.unpersist()


@pytest.mark.parametrize("rows", [1, 2, 9])
def test_smoothing_over_any_number_of_rows(z, rows):
    cfg = FrameConfig(smooth_rows=rows)
    filled = signals.fill_signals(z, cfg)
    got = segments.smooth(segments.cut(filled, 0.2), cfg)
    same(told(got, ["video_id", "processed_idx", "p_closed_smooth"]), told(signals.smooth(filled, cfg), ["video_id", "processed_idx", "p_closed_smooth"]))


def test_one_video_is_many_tasks(spark, z):
    """No frame is dealt by its video alone; summaries, one row per segment, are."""
    parts = segments.chain(z.where("video_id = 'a'"), seconds=2.0)
    sizes = [r["n"] for r in parts.groupBy("segment").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 25 and max(sizes) <= 31
    plan = segments.rolling(parts, SHORT_BLINKS, 2.0)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "processed_idx" in line and "[video_id" in line]
    assert all("segment" in line for line in windows)


def test_no_rows(z):
    none = z.where("video_id = 'x'")
    parts = segments.chain(none)
    assert segments.rolling(parts).count() == 0 and segments.events(parts).count() == 0


def test_a_pause_that_may_bind_raises(z):
    cfg = BlinkConfig(min_gap=0.5)
    whole = signals.perclos(signals.closed_state(signals.smooth(signals.fill_signals(z))))
    for plan in (lambda: blinks.blink_events(whole, cfg), lambda: blinks.blink_rolling(whole, cfg), lambda: segments.events(segments.chain(z), cfg)):
        with pytest.raises(ValueError, match="blink_events_with_gap"):
            plan()
    assert blinks.blink_events_with_gap(whole, cfg).count() < blinks.blink_events(whole).count() + 1


# --- time joins ---


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(9)
    at = lambda: rng.choice([round(rng.uniform(-5, 30), 2), float(rng.randrange(30))])
    rows = [(rng.choice("aab"), i, at()) for i in range(300)] + [("z", 900, 3.0), (None, 901, 3.0), ("a", 902, None), ("a", 903, 4.0), ("a", 903, 4.0)]
    events = [(rng.choice("aac"), 1000 + i, at(), rng.choice([None, rng.random()])) for i in range(200)] + [(None, 1, 3.0, 1.0), ("a", 2, None, 1.0)]
    r = spark.createDataFrame(rows, "k string, row_id long, t double").repartition(3)
    e = spark.createDataFrame(events, "k string, event_id long, e double, v double").repartition(3)
    return rows, events, r, e


@pytest.mark.parametrize(("before", "after"), [(2.0, 0.0), (0.0, 1.5), (3.3, 0.7), (0.0, 0.0)])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join(sides, before, after, how):
    rows, events, r, e = sides
    want = []
    for k, i, t in rows:
        met = [(k, i, t, ei, et, v) for ek, ei, et, v in events if ek == k is not None and None not in (t, et) and t - before <= et <= t + after]
        want += met or ([(k, i, t, None, None, None)] if how == "left" else [])
    got = time_joins.interval_join(r, e, "k", "t", "e", before, after, how)
    assert sorted(map(tuple, got.select("k", "row_id", "t", "event_id", "e", "v").collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_interval_join_rejects_other_kinds(sides):
    with pytest.raises(ValueError):
        time_joins.interval_join(sides[2], sides[3], "k", "t", "e", 1.0, how="outer")


@pytest.mark.parametrize("seconds", [0.5, 4.0, 1e6])
def test_interval_aggregate(sides, seconds):
    rows, events, r, e = sides
    want = []
    for k, i, t in rows:
        met = [(et, v) for ek, _, et, v in events if ek == k is not None and None not in (t, et) and t - 2.0 <= et <= t]
        values = [v for _, v in met if v is not None]
        want.append((k, i, t, len(met), len(values), max(values, default=None)))
    got = time_joins.interval_aggregate(r, e, "k", "t", "e", 2.0, {"n": ("count", "e"), "valued": ("count", "v"), "top": ("max", "v")}, seconds)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("seconds", [0.5, 4.0, 1e6])
def test_as_of_join(sides, seconds):
    rows, events, r, e = sides
    want = []
    for k, i, t in rows:
        met = [(et, ei, v) for ek, ei, et, v in events if ek == k is not None and None not in (t, et) and et <= t]
        last = max(met, default=(None, None, None), key=lambda x: x[:2])
        want.append((k, i, t, last[0], last[1], last[2]))
    got = time_joins.as_of_join(r, e, "k", "t", "e", ["event_id", "v"], seconds, tie="event_id")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_time_joins_of_nothing(sides):
    _, _, r, e = sides
    assert time_joins.as_of_join(r, e.where("k = 'q'"), "k", "t", "e", ["v"]).where("v IS NOT NULL OR e IS NOT NULL").count() == 0
    assert time_joins.as_of_join(r.where("k = 'q'"), e, "k", "t", "e", ["v"]).count() == 0
    assert time_joins.interval_aggregate(r, e.where("k = 'q'"), "k", "t", "e", 1.0, {"n": ("count", "e")}).agg(F.sum("n")).first()[0] == 0


# --- tasks ---


def task_counts(df):
    """Rows of each task of the last stage."""
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def test_copies_end_with_the_video(spark, z):
    """One second of video with a reach of twelve is not copied into eleven segments that have no frame."""
    parts = segments.chain(z.where("video_id = 'b' AND timestamp < 1"), seconds=1.0)
    assert segments.with_context(parts, 12.0, 1.0).count() == parts.count() > 0
    two = segments.chain(z.where("video_id = 'b' AND timestamp < 2"), seconds=1.0)
    assert segments.with_context(two, 12.0, 1.0).count() == two.count() + two.where("timestamp < 1").count()


def test_frames_ask_for_their_tasks(spark, z, monkeypatch):
    """Small compressed blocks are not joined into few tasks whose sorts grow with the table."""
    monkeypatch.setattr(tables, "FRAMES_A_TASK", 30)
    n = tables.tasks(z)
    assert n == -(-971 // 30) and tables.tasks(z.limit(0)) == 1
    parts = segments.chain(z, seconds=0.5, tasks=n)
    assert len(task_counts(parts)) > 20 and max(task_counts(parts)) <= 100
    same(told(segments.rolling(parts, SHORT_BLINKS, 0.5, n), ROLLED), told(segments.rolling(segments.chain(z, seconds=0.5), SHORT_BLINKS, 0.5), ROLLED))


def test_the_chain_deals_videos_by_their_frames(spark, monkeypatch):
    monkeypatch.setattr(tables, "FRAMES_A_TASK", 50)
    frames, _, norm = frame_plans.fixture_norm(spark, SF)
    assert norm.rdd.getNumPartitions() == -(-frames.count() // 50) > 4
    plan = norm._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
