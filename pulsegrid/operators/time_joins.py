"""Interval and as-of joins on time for events that lie anywhere, not only on the rows.

Both are equi-joins or windows over (key, stretch of time), so a key with a third of all rows is
many tasks, and no plan holds a product of both sides:

* ``interval_join`` gives pairs: events carry the number of their time bin, rows are
  copied to the one or two bins that their interval meets;
* ``interval_aggregate`` gives one row per row and makes no pairs: both sides become one
  table, in which a range window passes over the events;
* ``as_of_join`` gives each row the last event at or before it: the last event of one
  table of both sides, carried over from stretch to stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.segments import SECONDS, in_window


def interval_join(rows: DataFrame, events: DataFrame, key: str, time: str, event_time: str, before: float, after: float = 0.0, how: str = "inner") -> DataFrame:
    """Pairs of one key with ``time - before <= event_time <= time + after``; ``how``: inner or left.

    Bins are as wide as the interval, so a row meets two of them (three where rounding asks
    for it) and each pair is found once, in the event's bin. Rows with a null key or time
    have no pair, events with such are in none. Other columns of the two sides must differ.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no such join: {how}")
    width = F.lit(max(before + after, 1e-6))
    bins = lambda t: F.floor(t / width)
    low, high = F.col(time) - F.lit(before), F.col(time) + F.lit(after)
    right = events.withColumnRenamed(key, "__key").withColumn("__bin", bins(F.col(event_time)))
    spread = rows.select("*", F.explode_outer(F.sequence(bins(low), bins(high))).alias("__row_bin"))
    on = (F.col(key) == F.col("__key")) & (F.col("__row_bin") == F.col("__bin")) & F.col(event_time).between(low, high)
    pairs = spread.join(right, on).drop("__row_bin", "__bin", "__key")
    if how == "inner":
        return pairs
    # a left join on bins would keep a row once for each bin without a pair
    met = pairs.select(key, time).distinct()
    alone = rows.join(met, [key, time], "left_anti").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != key])
    return pairs.unionByName(alone)


def _one_table(rows: DataFrame, events: DataFrame, key: str, time: str, event_time: str, values: list[str]) -> DataFrame:
    """Both sides as (key, __t, __side, __row, __event): 0 for an event, 1 for a row, so that events at the row's time come first."""
    e = events.where(F.col(event_time).isNotNull() & F.col(key).isNotNull())
    right = e.select(F.col(key).alias("__key"), F.col(event_time).cast("double").alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(event_time).alias("__at"), *values).alias("__event"))
    left = rows.select(F.col(key).alias("__key"), F.col(time).cast("double").alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"))
    return right.unionByName(left, allowMissingColumns=True)


def interval_aggregate(rows: DataFrame, events: DataFrame, key: str, time: str, event_time: str, before: float, aggregates: dict[str, tuple[str, str]], seconds: float = SECONDS) -> DataFrame:
    """The rows with ``aggregates`` ({name: (function, event column)}) over the events in [time - before, time].

    An event is copied into the later stretches that its interval reaches. Rows with a
    null key or time get the aggregate of nothing. ``count`` of an event column counts the
    events with a value there.
    """
    values = sorted({c for _, c in aggregates.values()} - {event_time})
    table = _one_table(rows, events, key, time, event_time, values)
    stretch = lambda t: F.floor(t / F.lit(seconds))
    to = F.when(F.col("__side") == 0, stretch(F.col("__t") + F.lit(before) + 1e-6)).otherwise(stretch(F.col("__t")))
    spread = table.select("*", F.explode_outer(F.sequence(stretch(F.col("__t")), to)).alias("__stretch"))
    flat = spread.select("*", *[F.col(f"__event.{c}").alias(f"__v_{c}") for c in values], F.col("__event.__at").alias("__v_at"))
    column = lambda c: "__v_at" if c == event_time else f"__v_{c}"
    timed = F.col("__t").isNotNull() & F.col("__key").isNotNull()
    over = {n: in_window(f, column(c), before, ("__key", "__stretch"), "__t") for n, (f, c) in aggregates.items()}
    nothing = {n: F.lit(0).cast("long") if f == "count" else F.lit(None) for n, (f, _) in aggregates.items()}
    found = flat.withColumns({n: F.when(timed, v).otherwise(nothing[n]) for n, v in over.items()})
    return found.where("__side = 1").select("__row.*", *aggregates)


def as_of_join(rows: DataFrame, events: DataFrame, key: str, time: str, event_time: str, values: list[str], seconds: float = SECONDS, tie: str | None = None) -> DataFrame:
    """The rows with ``event_time`` and ``values`` of the last event at or before ``time``; null where there is none.

    Of events at one time that with the largest ``tie`` counts (without it, by their values).
    A stretch's last event is carried on by a window over one row per stretch.
    """
    table = _one_table(rows, events, key, time, event_time, [*([tie] if tie and tie not in values else []), *values])
    own = table.withColumn("__stretch", F.floor(F.col("__t") / F.lit(seconds)))
    tied = F.struct(*([F.col(f"__event.{tie}").alias("tie")] if tie else []), *[F.col(f"__event.{c}") for c in values])
    # order of the events of one time; rows come after them
    ordered = own.withColumn("__tied", F.when(F.col("__side") == 0, tied))
    ends = ordered.where("__side = 0").groupBy("__key", "__stretch").agg(F.max(F.struct("__t", "__tied", "__event")).getField("__event").alias("__end"))
    earlier = Window.partitionBy("__key").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = ordered.select("__key", "__stretch").distinct().join(ends, ["__key", "__stretch"], "left")
    carried = stretches.select("__key", "__stretch", F.last("__end", ignorenulls=True).over(earlier).alias("__carried"))
    here = Window.partitionBy("__key", "__stretch").orderBy("__t", "__side", "__tied").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last: Column = F.last(F.when(F.col("__side") == 0, F.col("__event")), ignorenulls=True).over(here)
    found = ordered.withColumn("__here", last).where("__side = 1").join(carried, ["__key", "__stretch"], "left")
    event = F.when(F.col("__t").isNotNull() & F.col("__key").isNotNull(), F.coalesce("__here", "__carried"))
    return found.withColumn("__found", event).select("__row.*", F.col("__found.__at").alias(event_time), *[F.col(f"__found.{c}").alias(c) for c in values])
