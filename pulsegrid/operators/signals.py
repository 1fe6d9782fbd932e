"""Gap filling, smoothing and latched states over one order key per video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.config import Z_COLUMNS, BlinkConfig, FrameConfig
from pulsegrid.functions.scalars import clip01, f32, f64


def by_video() -> WindowSpec:
    return Window.partitionBy("video_id").orderBy("timestamp")


def so_far() -> WindowSpec:
    return by_video().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ahead() -> WindowSpec:
    """From the row to the video's end, as a descending window."""
    down = Window.partitionBy("video_id").orderBy(F.col("timestamp").desc())
    return down.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def time_window(value: str, function: str, seconds: float) -> Column:
    """An aggregate over the trailing seconds up to the row's own time."""
    frame = f"PARTITION BY video_id ORDER BY timestamp RANGE BETWEEN {seconds!r}D PRECEDING AND CURRENT ROW"
    return F.expr(f"{function}({value}) OVER ({frame})")


def line_between(c: str, b: Column, a: Column, limit: int) -> Column:
    """The value, or that of the line from the known place ``b`` to ``a`` (structs i, y) where either is near."""
    i = F.col("processed_idx")
    near_b, near_a = i - b["i"] <= limit, a["i"] - i <= limit
    line = (a["y"] - b["y"]) / (a["i"] - b["i"]) * (i - b["i"]) + b["y"]
    return (
        F.when(F.col(c).isNotNull(), f64(F.col(c)))
        .when(b.isNotNull() & a.isNotNull() & (near_b | near_a), line)
        .when(a.isNull() & near_b, b["y"])
        .when(b.isNull() & near_a, a["y"])
    )


def interpolate(rows: DataFrame, columns: tuple[str, ...], limit: int) -> DataFrame:
    """Linear interpolation by row place, at most ``limit`` rows from a value on either side; the rest stays null.

    The value ahead comes from a descending window: an ascending one over all following
    rows would be quadratic.
    """
    i = F.col("processed_idx")
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(i.alias("i"), f64(F.col(c)).alias("y")))
    back = {f"__b_{c}": F.last(at(c), ignorenulls=True).over(so_far()) for c in columns}
    later = {f"__a_{c}": F.last(at(c), ignorenulls=True).over(ahead()) for c in columns}
    both = rows.withColumns(back).withColumns(later)
    return both.withColumns({c: line_between(c, F.col(f"__b_{c}"), F.col(f"__a_{c}"), limit) for c in columns}).drop(*back, *later)


def fill_signals(rows: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """z columns and p_closed interpolated, missing values 0, p_closed within 0 and 1, in single precision."""
    done = interpolate(rows, (*Z_COLUMNS, "p_closed"), cfg.interpolate_limit)
    z = {c: f32(F.coalesce(F.col(c), F.lit(0.0))) for c in Z_COLUMNS}
    return done.withColumns(z | {"p_closed": f32(clip01(F.coalesce("p_closed", F.lit(0.0))))})


def smooth(rows: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """Adds p_closed_smooth, the mean of the last rows."""
    mean = F.avg(f64(F.col("p_closed"))).over(by_video().rowsBetween(1 - cfg.smooth_rows, 0))
    return rows.withColumn("p_closed_smooth", f32(clip01(mean)))


def closed_state(rows: DataFrame, cfg: BlinkConfig = BlinkConfig()) -> DataFrame:
    """Adds closed_state (set at the start threshold, reset at the end threshold, else held) and current_closed_duration."""
    p = f64(F.col("p_closed_smooth"))
    signal = F.when(p >= cfg.start, 1).when(p <= cfg.end, 0)
    latched = rows.withColumn("closed_state", F.coalesce(F.last(signal, ignorenulls=True).over(so_far()), F.lit(0)))
    rise = (F.col("closed_state") == 1) & (F.coalesce(F.lag("closed_state").over(by_video()), F.lit(0)) == 0)
    opened = latched.withColumns({"__rise": rise}).withColumn("__since", F.last(F.when(F.col("__rise"), F.col("timestamp")), ignorenulls=True).over(so_far()))
    lasting = F.when(F.col("closed_state") == 1, F.col("timestamp") - F.col("__since")).otherwise(0.0)
    return opened.withColumn("current_closed_duration", f32(lasting)).drop("__rise", "__since")


def perclos(rows: DataFrame, cfg: BlinkConfig = BlinkConfig()) -> DataFrame:
    """Adds perclos_10s, the share of closed rows in the trailing window."""
    return rows.withColumn("perclos_10s", f32(time_window("closed_state", "avg", cfg.window_sec)))
