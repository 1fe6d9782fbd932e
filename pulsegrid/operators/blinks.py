"""Blink events from closed runs, and their features on frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.config import BlinkConfig
from pulsegrid.functions.scalars import f32, f64, finite
from pulsegrid.operators.signals import by_video, so_far, time_window


def runs(rows: DataFrame) -> DataFrame:
    """Rows of closed runs, each with the row that ends it; run_id counts the runs of a video."""
    before = F.coalesce(F.lag("closed_state").over(by_video()), F.lit(0))
    marked = rows.withColumn("__before", before)
    rise = F.when((F.col("closed_state") == 1) & (F.col("__before") == 0), 1).otherwise(0)
    numbered = marked.withColumn("run_id", F.sum(rise).over(so_far()))
    return numbered.where("closed_state = 1 OR __before = 1").drop("__before")


def _events(closed: DataFrame, cfg: BlinkConfig) -> DataFrame:
    at = F.struct("processed_idx", "frame_idx", "timestamp", f64(F.col("ear_z")).alias("ear"))
    least = F.struct(f64(F.col("ear_z")).alias("ear"), "processed_idx", "frame_idx", "timestamp")
    e = closed.groupBy("video_id", "run_id").agg(
        F.min(at).alias("s"), F.max(at).alias("e"), F.min(least).alias("m"),
        f64(F.max("p_closed_smooth")).alias("p_closed_max"), F.min("closed_state").alias("last_state"),
    )
    took = F.col("e.timestamp") - F.col("s.timestamp")
    amplitude = (F.col("s.ear") + F.col("e.ear")) / 2 - F.col("m.ear")
    kept = (F.col("last_state") == 0) & took.between(cfg.min_duration, cfg.max_duration) & (amplitude >= cfg.min_amplitude)
    return e.where(kept).select(
        "video_id", *[F.col(f"{a}.{c}").alias(f"{n}_{o}") for c, o in (("processed_idx", "idx"), ("frame_idx", "frame"), ("timestamp", "time")) for a, n in (("s", "start"), ("e", "end"), ("m", "min"))],
        took.alias("duration_sec"), (F.col("e.frame_idx") - F.col("s.frame_idx") + 1).alias("duration"),
        amplitude.alias("amplitude"),
        ((F.col("e.ear") - F.col("m.ear")) / F.greatest(F.col("e.timestamp") - F.col("m.timestamp"), F.lit(1e-6))).alias("opening_velocity"),
        "p_closed_max", F.col("s.ear").alias("ear_z_start"), F.col("m.ear").alias("ear_z_min"), F.col("e.ear").alias("ear_z_end"),
    )


def number_events(events: DataFrame) -> DataFrame:
    """Adds blink_id from 0 on, and frequency: events so far, the row's own among them, per second of video."""
    nth = F.row_number().over(Window.partitionBy("video_id").orderBy("end_time"))
    return events.withColumns({"blink_id": nth - 1, "frequency": nth / F.greatest("end_time", F.lit(1e-6))})


def blink_events(rows: DataFrame, cfg: BlinkConfig = BlinkConfig()) -> DataFrame:
    """Closures that end, of allowed length and amplitude, as one row each.

    The least pause between events cannot bind where a smoothed signal needs longer than the
    pause to climb from the end to the start threshold, as under the defaults. For other
    signals there is ``blink_events_with_gap``; a pause longer than a frame raises here.
    """
    cfg.without_pause()
    return number_events(_events(runs(rows), cfg))


def blink_events_with_gap(rows: DataFrame, cfg: BlinkConfig = BlinkConfig()) -> DataFrame:
    """The same with the least pause after an accepted event, which makes videos sequential.

    Only the accept test runs in Python, over a video's closed rows: a closure that begins
    within the pause begins at its first row after it with the signal above the start threshold.
    """
    columns = ["video_id", "processed_idx", "frame_idx", "timestamp", "ear_z", "p_closed_smooth", "closed_state", "run_id"]

    def shift(frame: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], -float("inf")
        for _, run in frame.sort_values("timestamp").groupby("run_id", sort=True):
            late = run[(run["timestamp"] - last >= cfg.min_gap) & (run["p_closed_smooth"].astype(float) >= cfg.start)]
            if late.empty:
                continue
            run = run[run["timestamp"] >= late["timestamp"].iloc[0]]
            kept.append(run)
            ear, took = run["ear_z"].astype(float), run["timestamp"].iloc[-1] - run["timestamp"].iloc[0]
            ended = run["closed_state"].iloc[-1] == 0
            amplitude = (ear.iloc[0] + ear.iloc[-1]) / 2 - ear.min()
            if ended and cfg.min_duration <= took <= cfg.max_duration and amplitude >= cfg.min_amplitude:
                last = run["timestamp"].iloc[-1]
        return pd.concat(kept) if kept else frame.iloc[:0]

    closed = runs(rows).select(*columns)
    return number_events(_events(closed.groupBy("video_id").applyInPandas(shift, closed.schema), cfg))


#: Rolling column: (event column, aggregate).
ROLLED = {
    "avg_blink_duration_10s": "duration_sec",
    "avg_blink_amplitude_10s": "amplitude",
    "avg_opening_velocity_10s": "opening_velocity",
}


def _events_in_place(rows: DataFrame, cfg: BlinkConfig) -> DataFrame:
    """Adds an event's time and values to the frame that ends it, by windows over the rows as they lie.

    ``__run`` counts the closures of a video; frames between two closures belong to the
    former, but only its closed frames and the one that ends it count.
    """
    before = F.coalesce(F.lag("closed_state").over(by_video()), F.lit(0))
    marked = rows.withColumn("__before", before)
    rise = F.when((F.col("closed_state") == 1) & (F.col("__before") == 0), 1).otherwise(0)
    numbered = marked.withColumn("__run", F.sum(rise).over(so_far()))
    run = Window.partitionBy("video_id", "__run").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ear, within = f64(F.col("ear_z")), (F.col("closed_state") == 1) | (F.col("__before") == 1)
    found = numbered.withColumns(
        {
            "__s": F.first(F.struct("timestamp", ear.alias("ear"))).over(run),
            "__m": F.min(F.when(within, F.struct(ear.alias("ear"), "processed_idx", "timestamp"))).over(run),
        }
    )
    took = F.col("timestamp") - F.col("__s.timestamp")
    amplitude = (F.col("__s.ear") + ear) / 2 - F.col("__m.ear")
    ends = (F.col("closed_state") == 0) & (F.col("__before") == 1)
    kept = ends & took.between(cfg.min_duration, cfg.max_duration) & (amplitude >= cfg.min_amplitude)
    opening = (ear - F.col("__m.ear")) / F.greatest(F.col("timestamp") - F.col("__m.timestamp"), F.lit(1e-6))
    values = {"__end": F.col("timestamp"), "__duration_sec": took, "__amplitude": amplitude, "__opening_velocity": opening}
    return found.withColumns({n: F.when(kept, v) for n, v in values.items()}).drop("__before", "__run", "__s", "__m")


def blink_rolling(rows: DataFrame, cfg: BlinkConfig = BlinkConfig(), ended: str | None = None) -> DataFrame:
    """Means and frequency of the blinks that ended in the trailing window, and the time since the last one.

    An event sits on the frame where it ends, so a range window replaces the interval join,
    and no event leaves the partitioning of its frames. ``ended`` names a column for the
    time of the event that ends at the frame. A pause longer than a frame raises.
    """
    cfg.without_pause()
    out = _events_in_place(rows, cfg).withColumns(
        {n: f32(F.coalesce(time_window(f"__{c}", "avg", cfg.window_sec), F.lit(0.0))) for n, c in ROLLED.items()}
        | {
            "blink_frequency_10s": f32(time_window("__end", "count", cfg.window_sec) / F.lit(cfg.window_sec)),
            "time_since_last_blink": f32(F.coalesce(F.least(F.col("timestamp") - F.last("__end", ignorenulls=True).over(so_far()), F.lit(cfg.cap_sec)), F.lit(cfg.cap_sec))),
        }
    )
    out = out.withColumn(ended, F.col("__end")) if ended else out
    return out.drop("__end", *[f"__{c}" for c in ROLLED.values()])


def sanitise(rows: DataFrame, features: tuple[str, ...], cap: float = 10.0) -> DataFrame:
    """Features that are missing or not finite become 0; the time since the last blink its cap."""
    return rows.withColumns({c: F.coalesce(finite(F.col(c)), f32(F.lit(cap if c == "time_since_last_blink" else 0.0))) for c in features})
