"""The frame chain over segments of a video, so that one very long video is many tasks.

A segment is a stretch of ``seconds`` of one video. Three mechanisms make its windows whole:

* *carried values*: each segment is summarised in one row (first and last known values, the
  last rows' signals, the latch as a function of the state it is entered with); a window over
  those rows alone, one per segment, tells every segment what it is entered with;
* *context rows*: a row is copied into the later segments that its trailing window reaches,
  so a time window over (video, segment) is the one over the video;
* *prefix counts*: events of the segments before, for ordinals.

Frames are dealt by (video, segment) once for the carried values and once for the context rows.
Results equal those of ``signals`` and ``blinks`` for any segment length. Segments are by time,
so ``timestamp`` must not be null; rows of a segment are what one task holds of a video.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.config import Z_COLUMNS, BlinkConfig, FrameConfig
from pulsegrid.functions.scalars import clip01, f32, f64
from pulsegrid.operators.blinks import ROLLED
from pulsegrid.operators.signals import line_between

KEY = ("video_id", "segment")
#: Ten minutes: some 9,000 frames at 15 a second.
SECONDS = 600.0


def cut(rows: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """Adds ``segment``, the number of the row's stretch of its video."""
    return rows.withColumn("segment", F.floor(F.col("timestamp") / F.lit(seconds)))


def _own(order: Column | str = "timestamp") -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy(order)


def _own_so_far(order: Column | str = "timestamp") -> WindowSpec:
    return _own(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier(descending: bool = False) -> WindowSpec:
    """Segments of the video before this one; after it, if descending."""
    by = F.col("segment").desc() if descending else F.col("segment")
    return Window.partitionBy("video_id").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def interpolate(rows: DataFrame, columns: tuple[str, ...], limit: int) -> DataFrame:
    """``signals.interpolate`` over segments: the last value before and the first one after a segment are carried."""
    i = F.col("processed_idx")
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(i.alias("i"), f64(F.col(c)).alias("y")))
    ends = rows.groupBy(*KEY).agg(*[f(at(c)).alias(f"{n}_{c}") for c in columns for n, f in (("first", F.min), ("last", F.max))])
    carried = {f"__b_{c}": F.last(f"last_{c}", ignorenulls=True).over(_earlier()) for c in columns}
    carried |= {f"__a_{c}": F.last(f"first_{c}", ignorenulls=True).over(_earlier(descending=True)) for c in columns}
    both = rows.join(ends.select(*KEY, *[v.alias(n) for n, v in carried.items()]), [*KEY])
    down = F.col("timestamp").desc()
    near = {f"__b_{c}": F.coalesce(F.last(at(c), ignorenulls=True).over(_own_so_far()), f"__b_{c}") for c in columns}
    near |= {f"__a_{c}": F.coalesce(F.last(at(c), ignorenulls=True).over(_own_so_far(down)), f"__a_{c}") for c in columns}
    found = both.withColumns(near)
    return found.withColumns({c: line_between(c, F.col(f"__b_{c}"), F.col(f"__a_{c}"), limit) for c in columns}).drop(*carried)


def fill_signals(rows: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """``signals.fill_signals`` over segments."""
    done = interpolate(rows, (*Z_COLUMNS, "p_closed"), cfg.interpolate_limit)
    z = {c: f32(F.coalesce(F.col(c), F.lit(0.0))) for c in Z_COLUMNS}
    return done.withColumns(z | {"p_closed": f32(clip01(F.coalesce("p_closed", F.lit(0.0))))})


def smooth(rows: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """``signals.smooth`` over segments: the signals of the last rows before a segment are carried."""
    n, p = cfg.smooth_rows, f64(F.col("p_closed"))
    ranked = rows.select(*KEY, "timestamp", p.alias("p"), F.row_number().over(_own(F.col("timestamp").desc())).alias("back"))
    tails = ranked.where(F.col("back") < n).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("timestamp", "p")))["p"].alias("tail"))
    # each segment has a row at least, so n - 1 segments hold as many rows
    before = F.flatten(F.collect_list("tail").over(Window.partitionBy("video_id").orderBy("segment").rowsBetween(1 - n, -1))) if n > 1 else F.array().cast("array<double>")
    held = rows.join(tails.select(*KEY, before.alias("__tail")), [*KEY], "left")
    frame = _own().rowsBetween(1 - n, 0)
    own = held.withColumns({"__n": F.count(F.lit(1)).over(frame), "__s": F.sum(p).over(frame)})
    lacking = F.least(F.lit(n) - F.col("__n"), F.size("__tail")).cast("int")
    more = F.when(lacking > 0, F.aggregate(F.slice("__tail", F.size("__tail") - lacking + 1, lacking), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)
    mean = (F.col("__s") + more) / (F.col("__n") + F.greatest(lacking, F.lit(0)))
    return own.withColumn("p_closed_smooth", f32(clip01(mean))).drop("__tail", "__n", "__s")


def closed_state(rows: DataFrame, cfg: BlinkConfig = BlinkConfig()) -> DataFrame:
    """``signals.closed_state`` over segments, with ``closed_since``, the time of the last rise.

    A segment maps the state it is entered with to the one it is left with, and so to its last
    rise; both are known for either state before the states themselves are. ``last_segment``
    is the video's last one, beyond which no row needs to be copied.
    """
    p = f64(F.col("p_closed_smooth"))
    signal = F.when(p >= cfg.start, 1).when(p <= cfg.end, 0)
    told = rows.withColumn("__last", F.last(signal, ignorenulls=True).over(_own_so_far()))
    state = lambda entered: F.coalesce(F.col("__last"), entered)
    before = lambda entered: F.coalesce(F.lag("__last").over(_own()), entered)
    rises = {f"r{s}": (state(F.lit(s)) == 1) & (before(F.lit(s)) == 0) for s in (0, 1)}
    ends = told.withColumns(rises).groupBy(*KEY).agg(
        F.max_by("__last", "timestamp").alias("left"), *[F.max(F.when(F.col(r), F.col("timestamp"))).alias(r) for r in rises]
    )
    entered = ends.withColumn("__in", F.coalesce(F.last("left", ignorenulls=True).over(_earlier()), F.lit(0)))
    rise = F.when(F.col("__in") == 0, F.col("r0")).otherwise(F.col("r1"))
    carried = entered.withColumn("rise", rise).select(*KEY, "__in", F.last("rise", ignorenulls=True).over(_earlier()).alias("__since"), F.max("segment").over(Window.partitionBy("video_id")).alias("last_segment"))
    done = told.join(carried, [*KEY]).withColumns({"closed_state": state(F.col("__in")), "__before": before(F.col("__in"))})
    here = F.when((F.col("closed_state") == 1) & (F.col("__before") == 0), F.col("timestamp"))
    since = F.coalesce(F.last(here, ignorenulls=True).over(_own_so_far()), "__since")
    timed = done.withColumn("closed_since", since)
    lasting = F.when(F.col("closed_state") == 1, F.col("timestamp") - F.col("closed_since")).otherwise(0.0)
    return timed.withColumn("current_closed_duration", f32(lasting)).drop("__last", "__in", "__since", "__before")


def with_context(rows: DataFrame, reach: float, seconds: float = SECONDS, time: str = "timestamp", tasks: int | None = None) -> DataFrame:
    """The rows, and copies of those whose trailing window of ``reach`` seconds ends in a later segment.

    ``context`` marks the copies; ``segment`` is the one that a row serves, at most the video's
    ``last_segment``. The rows are dealt by the segments they serve, into ``tasks`` if given.
    """
    first = F.floor(F.col(time) / F.lit(seconds))
    served = F.sequence(first, F.least(F.floor((F.col(time) + F.lit(reach)) / F.lit(seconds)), F.col("last_segment")))
    copied = rows.drop("segment").select("*", F.posexplode(served).alias("__nth", "segment")).withColumn("context", F.col("__nth") > 0).drop("__nth", "last_segment")
    return copied.repartition(tasks, *KEY) if tasks else copied


def in_window(function: str, value: str, seconds: float, keys: tuple[str, ...] = KEY, time: str = "timestamp") -> Column:
    """An aggregate over the trailing seconds within a segment and its context."""
    return F.expr(f"{function}({value}) OVER (PARTITION BY {', '.join(keys)} ORDER BY {time} RANGE BETWEEN {seconds!r}D PRECEDING AND CURRENT ROW)")


def _ended(rows: DataFrame, cfg: BlinkConfig) -> DataFrame:
    """Adds ``__e``, the values of the event that ends at the row.

    A closure's rows share ``closed_since``. One that began before the context is longer
    than an event may be, and ``closed_since`` tells that. A least pause longer than a frame raises.
    """
    cfg.without_pause()
    ear = f64(F.col("ear_z"))
    marked = rows.withColumn("__before", F.coalesce(F.lag("closed_state").over(_own()), F.lit(0)))
    run = Window.partitionBy(*KEY, "closed_since").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = (F.col("closed_state") == 1) | (F.col("__before") == 1)
    found = marked.withColumns(
        {
            "__s": F.first(F.struct(ear.alias("ear"), "processed_idx", "frame_idx", "timestamp")).over(run),
            "__m": F.min(F.when(within, F.struct(ear.alias("ear"), "processed_idx", "frame_idx", "timestamp"))).over(run),
            "__p": F.max(F.when(within, f64(F.col("p_closed_smooth")))).over(run),
        }
    )
    took = F.col("timestamp") - F.col("closed_since")
    amplitude = (F.col("__s.ear") + ear) / 2 - F.col("__m.ear")
    ends = (F.col("closed_state") == 0) & (F.col("__before") == 1)
    kept = ends & took.between(cfg.min_duration, cfg.max_duration) & (amplitude >= cfg.min_amplitude)
    opening = (ear - F.col("__m.ear")) / F.greatest(F.col("timestamp") - F.col("__m.timestamp"), F.lit(1e-6))
    places = [F.col(f"__{a}.{c}").alias(f"{n}_{o}") for c, o in (("processed_idx", "idx"), ("frame_idx", "frame"), ("timestamp", "time")) for a, n in (("s", "start"), ("m", "min"))]
    event = F.struct(
        *places, F.col("processed_idx").alias("end_idx"), F.col("frame_idx").alias("end_frame"), F.col("timestamp").alias("end_time"), took.alias("duration_sec"),
        (F.col("frame_idx") - F.col("__s.frame_idx") + 1).alias("duration"), amplitude.alias("amplitude"), opening.alias("opening_velocity"), F.col("__p").alias("p_closed_max"),
        F.col("__s.ear").alias("ear_z_start"), F.col("__m.ear").alias("ear_z_min"), ear.alias("ear_z_end"),
    )
    return found.withColumn("__e", F.when(kept, event)).drop("__before", "__s", "__m", "__p")


def reach(cfg: BlinkConfig) -> float:
    """Seconds of context: the window's, or the cap's, and the longest event that ends in them."""
    return max(cfg.window_sec, cfg.cap_sec) + cfg.max_duration


def _context_tasks(tasks: int | None, reach: float, seconds: float) -> int | None:
    """Copies are narrower than frames, so a task may hold four times as many."""
    return tasks and tasks * ceil((1 + reach / seconds) / 4)


def rolling(rows: DataFrame, cfg: BlinkConfig = BlinkConfig(), seconds: float = SECONDS, tasks: int | None = None) -> DataFrame:
    """``signals.perclos`` and ``blinks.blink_rolling`` over segments; rows come from ``closed_state``."""
    copied = with_context(rows, reach(cfg), seconds, tasks=_context_tasks(tasks, reach(cfg), seconds))
    found = _ended(copied, cfg).withColumns({f"__{c}": F.col(f"__e.{c}") for c in (*ROLLED.values(), "end_time")})
    last = F.last("__end_time", ignorenulls=True).over(_own_so_far())
    out = found.withColumns(
        {n: f32(F.coalesce(in_window("avg", f"__{c}", cfg.window_sec), F.lit(0.0))) for n, c in ROLLED.items()}
        | {
            "perclos_10s": f32(in_window("avg", "closed_state", cfg.window_sec)),
            "blink_frequency_10s": f32(in_window("count", "__end_time", cfg.window_sec) / F.lit(cfg.window_sec)),
            "time_since_last_blink": f32(F.coalesce(F.least(F.col("timestamp") - last, F.lit(cfg.cap_sec)), F.lit(cfg.cap_sec))),
        }
    )
    return out.where(~F.col("context")).drop("context", "__e", "__end_time", *[f"__{c}" for c in ROLLED.values()])


def events(rows: DataFrame, cfg: BlinkConfig = BlinkConfig(), seconds: float = SECONDS, tasks: int | None = None) -> DataFrame:
    """``blinks.blink_events`` over segments, ordinals from the counts of the segments before."""
    reached = cfg.max_duration + 1.0
    copied = with_context(rows, reached, seconds, tasks=_context_tasks(tasks, reached, seconds))
    found = _ended(copied, cfg).where(~F.col("context") & F.col("__e").isNotNull())
    here = found.select(*KEY, "__e.*")
    before = here.groupBy(*KEY).count().select(*KEY, F.coalesce(F.sum("count").over(_earlier()), F.lit(0)).alias("__n"))
    nth = F.row_number().over(_own("end_time")) + F.col("__n")
    numbered = here.join(before, [*KEY]).withColumns({"blink_id": nth - 1, "frequency": nth / F.greatest("end_time", F.lit(1e-6))})
    return numbered.drop("segment", "__n")


def chain(z: DataFrame, frame: FrameConfig = FrameConfig(), blink: BlinkConfig = BlinkConfig(), seconds: float = SECONDS, keep: Callable[[DataFrame], DataFrame] = lambda df: df, tasks: int | None = None) -> DataFrame:
    """From z scores to closed states. ``keep`` may store the filled and the smoothed rows,
    which are read twice each (for the summaries and for the rows), for example ``DataFrame.checkpoint``.
    ``tasks`` deals the frames by segment into so many."""
    own = cut(z, seconds)
    filled = keep(fill_signals(own.repartition(tasks, *KEY) if tasks else own, frame))
    return closed_state(keep(smooth(filled, frame)), blink)
