"""Registered queries, with their SQL, of the segmented frame chain and of the time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.config import FIXTURE_FRAMES, SHORT_BLINKS, Z_COLUMNS, BlinkConfig
from pulsegrid.operators import segments, time_joins
from pulsegrid.plans import oracles as O
from pulsegrid.plans import queries as Q
from pulsegrid.plans.frames import manifest, z_scores
from pulsegrid.sources import tables

#: The fixture's videos last some four seconds, so segments of one second meet every case.
SECONDS = 1.0


def _chain(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """(closed states over segments, tasks)"""
    frames = tables.frames(spark, d)
    n = tables.tasks(frames)
    z = z_scores(frames, manifest(frames), FIXTURE_FRAMES, n)
    return segments.chain(z, FIXTURE_FRAMES, seconds=SECONDS, tasks=n), n


def q_segmented_signals(spark, d):
    """Filled, smoothed and latched signals of all videos, over segments."""
    rows, _ = _chain(spark, d)
    return rows.select(*Q.KEY, "closed_state", *Q.r6("p_closed", "p_closed_smooth", "current_closed_duration"))


def _rolled(rows: DataFrame) -> DataFrame:
    return rows.select(*Q.KEY, *Q.r6("perclos_10s", *Q.ROLLED), *[F.round(F.col(c).cast("double"), 3).alias(c) for c in Q.ROLLED_EAR])


def q_segmented_rolling(spark, d):
    """PERCLOS and blink features over segments and their context."""
    rows, n = _chain(spark, d)
    return _rolled(segments.rolling(rows, SHORT_BLINKS, SECONDS, n))


def q_segmented_events(spark, d):
    """Blink events over segments, numbered through each video."""
    rows, n = _chain(spark, d)
    events = segments.events(rows, BlinkConfig(), SECONDS, n)
    real = ("start_time", "end_time", "min_time", "duration_sec", "frequency", "p_closed_max")
    ear = ("amplitude", "opening_velocity", "ear_z_start", "ear_z_min", "ear_z_end")
    return events.select("video_id", F.col("blink_id").cast("int").alias("blink_id"), "start_idx", "end_idx", "min_idx", "duration", *Q.r6(*real), *[F.round(c, 3).alias(c) for c in ear])


#: The whole of events as one video, a frame per event (identical text runs in DuckDB).
LONG_SQL = """
SELECT 'all' AS video_id, event_id AS processed_idx, event_id * 2 AS frame_idx, CAST(event_id AS DOUBLE) / CAST(15 AS DOUBLE) AS timestamp,
  CASE WHEN event_type <> 'error' AND event_id % 11 <> 3 THEN CASE WHEN event_id % 40 < 12 THEN CAST(1 AS DOUBLE) - value / CAST(400 AS DOUBLE) ELSE value / CAST(300 AS DOUBLE) END END AS p_closed,
  {z}
FROM {events}
""".replace("{z}", ", ".join(f"CAST(CASE WHEN event_type <> 'error' THEN value / CAST({20 + i} AS DOUBLE) - CAST(2 AS DOUBLE) END AS FLOAT) AS {z}" for i, z in enumerate(Z_COLUMNS)))


def q_one_long_video(spark, d):
    """All events as the frames of one video, in segments of 30 seconds."""
    frames = spark.sql(LONG_SQL, events=Q.read(spark, d, "events"))
    n = tables.tasks(frames)
    return _rolled(segments.rolling(segments.chain(frames, seconds=30.0, tasks=n), SHORT_BLINKS, 30.0, n))


#: Events beside the frames' times, some on them.
MARKS_SQL = """
SELECT video_id, CASE WHEN processed_idx % 5 = 0 THEN timestamp ELSE timestamp * CAST(0.97 AS DOUBLE) + CAST(0.013 AS DOUBLE) END AS mark_time, processed_idx AS mark_id, mar AS mark_value
FROM {frames} WHERE processed_idx % 3 <> 1
"""


def _marks(spark, d):
    frames = tables.frames(spark, d)
    return frames.select(*Q.KEY, "timestamp"), spark.sql(MARKS_SQL, frames=frames)


def q_interval_pairs(spark, d):
    """Every frame with the events of the half second before it."""
    frames, marks = _marks(spark, d)
    return time_joins.interval_join(frames, marks, "video_id", "timestamp", "mark_time", 0.5, how="left").select(*Q.KEY, "mark_id")


def q_interval_aggregate(spark, d):
    """Every frame with counts and means of those events, without pairs."""
    frames, marks = _marks(spark, d)
    over = {"n": ("count", "mark_time"), "mean_value": ("avg", "mark_value"), "top": ("max", "mark_value")}
    return time_joins.interval_aggregate(frames, marks, "video_id", "timestamp", "mark_time", 0.5, over, SECONDS).select(*Q.KEY, "n", *Q.r6("mean_value", "top"))


def q_as_of(spark, d):
    """Every frame with the last event at or before it."""
    frames, marks = _marks(spark, d)
    rows = time_joins.as_of_join(frames.where("processed_idx % 2 = 0"), marks.where("mark_id % 4 = 0"), "video_id", "timestamp", "mark_time", ["mark_id", "mark_value"], SECONDS)
    return rows.select(*Q.KEY, "mark_id", *Q.r6("mark_time", "mark_value"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

_ROLLED = f"SELECT video_id, processed_idx, {O.rs('perclos_10s', *Q.ROLLED)}, {O.rs(*Q.ROLLED_EAR, digits=3)} FROM roll"
_LONG = [("z", LONG_SQL.replace("{events}", "events")), *O.NORM[O.NORM.index(O.Z) + 1 :]]
_MARKS = [O.F, ("marks", MARKS_SQL.replace("{frames}", "frames"))]
_BETWEEN = "m.video_id = f.video_id AND m.mark_time BETWEEN f.timestamp - 0.5::DOUBLE AND f.timestamp"

ORACLES = {
    "q_segmented_signals": O.with_(*O.NORM, *O.STATE, select=f"SELECT video_id, processed_idx, CAST(closed_state AS INT) AS closed_state, {O.rs('p_closed', 'p_closed_smooth', 'current_closed_duration')} FROM st"),
    "q_segmented_rolling": O.with_(*O.NORM, *O.STATE, *O.EVENTS, *O.rolled(2.5), select=_ROLLED),
    "q_segmented_events": O.ORACLES["q_blink_events"],
    "q_one_long_video": O.with_(*_LONG, *O.STATE, *O.EVENTS, *O.rolled(2.5), select=_ROLLED),
    "q_interval_pairs": O.with_(*_MARKS, select=f"SELECT f.video_id, f.processed_idx, mark_id FROM frames f LEFT JOIN marks m ON {_BETWEEN}"),
    "q_interval_aggregate": O.with_(*_MARKS, select=f"SELECT f.video_id, f.processed_idx, count(mark_time) AS n, {O.r('avg(mark_value)', 'mean_value')}, {O.r('max(mark_value)', 'top')} FROM frames f LEFT JOIN marks m ON {_BETWEEN} GROUP BY 1, 2"),
    "q_as_of": O.with_(*_MARKS, select=f"SELECT f.video_id, f.processed_idx, mark_id, {O.rs('mark_time', 'mark_value')} FROM (SELECT * FROM frames WHERE processed_idx % 2 = 0) f ASOF LEFT JOIN (SELECT * FROM marks WHERE mark_id % 4 = 0) m ON f.video_id = m.video_id AND f.timestamp >= m.mark_time"),
}
