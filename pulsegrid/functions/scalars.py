"""Column functions: cleaning, geometry, probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(c: Column) -> Column:
    return c.cast("float")


def f64(c: Column) -> Column:
    return c.cast("double")


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


#: What counts as a number in text; "nan" and "inf" give the default anyway.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def safe_float(c: Column, default: float | None) -> Column:
    """The number, also from text; the default where there is none, or it is not finite."""
    return F.coalesce(F.when(c.cast("string").rlike(NUMBER), finite(c.try_cast("double"))), F.lit(default))


def nan_to_num(xs: Column) -> Column:
    """An array with 0 for what is missing, NaN or infinite."""
    return F.transform(xs, lambda x: F.coalesce(finite(f64(x)), F.lit(0.0)))


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def safe_name(c: Column) -> Column:
    """Every run of characters that a file name should not have becomes one underscore."""
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_")


def sequence_id(video: Column, number: Column) -> Column:
    """At least five digits; larger numbers keep all of theirs."""
    return F.concat(safe_name(video), F.lit("_seq"), F.when(number.isNotNull(), F.format_string("%05d", number.cast("long"))))


def lookup(c: Column, pairs: list[tuple[str, object]]) -> Column:
    """A map with null for keys that it lacks."""
    return reduce(lambda out, p: out.when(c == p[0], F.lit(p[1])), pairs[1:], F.when(c == pairs[0][0], F.lit(pairs[0][1])))


def frame_step(fps: Column, target: int) -> Column:
    """max(1, fps / target) with halves to even; an fps that is missing or not positive counts as 30."""
    known = F.coalesce(F.nanvl(f64(fps), F.lit(None)), F.lit(30.0))
    known = F.when(known <= 1e-6, 30.0).otherwise(known)
    return F.greatest(F.lit(1), F.bround(known / target).cast("int"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def pixel(c: Column, size: int) -> Column:
    """A landmark's place in pixels, in single precision."""
    return f32(c * size)


def eye_aspect_ratio(points: list[tuple[Column, Column]]) -> Column:
    """(|p2 p6| + |p3 p5|) / (2 |p1 p4|); null for an eye without width."""
    p = points
    across = distance(*p[0], *p[3])
    up = distance(*p[1], *p[5]) + distance(*p[2], *p[4])
    return F.when(across > 1e-6, up / (2.0 * across))


def mouth_aspect_ratio(top, bottom, left, right) -> Column:
    across = distance(*left, *right)
    return F.when(across > 1e-6, distance(*top, *bottom) / across)


def both(left: Column, right: Column) -> Column:
    """The mean if both are there."""
    return (left + right) / 2


def either(left: Column, right: Column) -> Column:
    """The mean of those that are there."""
    return F.coalesce((left + right) / 2, left, right)


def crop_box(xs: Column, ys: Column, width: int, height: int, padding: float = 0.65) -> Column:
    """A square around the points with padding, clamped to the frame; null if too small or empty."""
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    side = F.greatest(x1 - x0, y1 - y0) * (1.0 + padding)
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    at = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), F.bround(c).cast("int")))
    box = F.struct(
        at(cx - side / 2, width).alias("x0"), at(cy - side / 2, height).alias("y0"),
        at(cx + side / 2, width).alias("x1"), at(cy + side / 2, height).alias("y1"),
    )
    return F.when((side > 2) & (box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), box)


def fit_width(width: Column, height: Column, most: int) -> Column:
    """(width, height) scaled down to a width of at most ``most``; never up."""
    scale = most / width
    return F.when(width <= most, F.struct(width.cast("int").alias("w"), height.cast("int").alias("h"))).otherwise(
        F.struct(F.lit(most).alias("w"), F.bround(height * scale).cast("int").alias("h"))
    )


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax2(a: Column, b: Column) -> tuple[Column, Column]:
    top = F.greatest(a, b)
    ea, eb = F.exp(a - top), F.exp(b - top)
    return ea / (ea + eb), eb / (ea + eb)


def hierarchical(abn: tuple[Column, Column], stage: tuple[Column, Column]) -> tuple[Column, Column, Column]:
    """Probabilities of three classes from the logits of two heads."""
    a0, a1 = softmax2(*abn)
    s0, s1 = softmax2(*stage)
    p = (a0, a1 * s0, a1 * s1)
    total = F.greatest(p[0] + p[1] + p[2], F.lit(1e-8))
    return tuple(x / total for x in p)


def argmax3(p0: Column, p1: Column, p2: Column) -> Column:
    """The first class of the largest value."""
    return F.when((p0 >= p1) & (p0 >= p2), 0).when(p1 >= p2, 1).otherwise(2)
