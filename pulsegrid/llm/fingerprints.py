"""Document fingerprints by winnowing, in Spark's own functions only.

A text is a row of units: its words, and the single code points of words longer than
``LONG_WORD`` (scripts without spaces, encoded junk). Every run of ``k`` units is hashed, at
every place; of each window of ``w`` successive hashes the least is chosen, of equal ones the
rightmost. What the windows choose, each place once, is the fingerprint, with places. Texts
that share ``k + w - 1`` units in a row share a hash at the matching places, wherever the run
lies: the windows within it choose by its hashes alone.

Place and hash are one long (hash above, place counted down below), so the least long of a
window is its least hash with ties to the right, and windows of length ``w`` come by doubling:
each pass takes the least of two windows of half the length, over whole arrays. Spark's
functions carry no state along an array in linear time, so a hash is taken afresh for each
place from its ``k`` units in place of being rolled on from the one before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import WORD_GAP, cut, row_key

K = 5
WINDOW = 8
LONG_WORD = 32
_PLACES = (1 << 31) - 1


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, not once for each element of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def units(text: Column) -> Column:
    """The words of a text in order, long ones as their code points."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    long_ = lambda w: F.char_length(w) > LONG_WORD
    parts = lambda ws: F.flatten(F.transform(ws, lambda w: F.when(long_(w), F.split(w, "")).otherwise(F.array(w))))
    return _bound(words, lambda ws: F.when(F.exists(ws, long_), parts(ws)).otherwise(ws))


def _hashes(u: Column, k: int) -> Column:
    """Of each run of ``k`` units its 32-bit hash above its place counted down; fewer units are one run."""
    run = lambda i: F.xxhash64(*[F.get(u, i + j) for j in range(k)])
    places = F.when(F.size(u) > 0, F.sequence(F.lit(0), F.greatest(F.size(u) - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.shiftleft(run(i).bitwiseAND(F.lit(0xFFFFFFFF)), 31) + (F.lit(_PLACES) - i))


def _window_minima(hashes: Column, w: int) -> Column:
    """The least of each ``w`` successive elements; of fewer than ``w`` elements, the least of all."""
    least = lambda h, by: F.zip_with(h, F.slice(h, by + 1, F.greatest(F.size(h) - by, F.lit(0))), lambda x, y: F.least(x, y))
    out, width = hashes, 1
    while width < w:
        by = min(width, w - width)
        out, width = _bound(out, lambda h: least(h, by)), width + by  # noqa: B023
    # places near the end have no whole window
    return _bound(out, lambda h: F.slice(h, 1, F.greatest(F.size(h) - (w - 1), F.lit(1))))


def winnow(text: Column, k: int = K, w: int = WINDOW) -> Column:
    """The fingerprint as an array of longs, in the order of places: see ``places`` and ``hashes``."""
    chosen = lambda m: F.filter(m, lambda x, i: (i == 0) | (x != F.get(m, i - 1)))
    return _bound(_bound(units(text), lambda u: _window_minima(_hashes(u, k), w)), chosen)


def places(fingerprint: Column) -> Column:
    """Places of a fingerprint, in units from 0."""
    return F.transform(fingerprint, lambda x: F.lit(_PLACES) - x.bitwiseAND(F.lit(_PLACES)))


def hashes(fingerprint: Column) -> Column:
    """Hashes of a fingerprint (0 to 2**32 - 1), in the order of places."""
    return F.transform(fingerprint, lambda x: F.shiftright(x, 31))


def likeness(a: Column, b: Column) -> Column:
    """Shared share of the distinct hashes of two arrays of them; of two without any, 1."""
    both = F.size(F.array_intersect(a, b))
    return _bound(both, lambda n: F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(n / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - n)))


def shown(fingerprint: Column) -> Column:
    """``place:hash`` pairs, in hexadecimal, joined by commas."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat_ws(":", F.hex(F.lit(_PLACES) - x.bitwiseAND(F.lit(_PLACES))), F.hex(F.shiftright(x, 31)))), ",")


def fingerprints(docs: DataFrame, k: int = K, w: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, place, hash): a row for each place that a window chooses; an index to join on ``hash``.

    Null and empty texts, and texts of white space, have no rows; texts of fewer than ``k``
    units have one hash over all, and those of fewer hashes than ``w`` one choice. Null ids stay;
    repeated rows give their places again; very long texts are read whole, in memory that
    grows with their units; an empty table has no rows. Other columns are not read.
    """
    f = winnow(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), k, w)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.explode(f).alias("x"))
    return rows.select(id_col, (F.lit(_PLACES) - F.col("x").bitwiseAND(F.lit(_PLACES))).alias("place"), F.shiftright("x", 31).alias("hash"))


def _ring(keys: DataFrame) -> DataFrame:
    """(k0, k1, p0, p1): each key with the one before it; the first one's is the last.

    Keys are dealt by range and kept (32 bytes each); within a range they follow a window, and of
    the ranges only the last keys, as many rows as there are partitions, meet in one task.
    """
    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(keys.repartitionByRange(n, "k0", "k1").withColumn("range", F.spark_partition_id()))
    key = F.struct("k0", "k1")
    own = Window.partitionBy("range").orderBy("k0", "k1")
    within = ranged.select("k0", "k1", "range", F.lag(key).over(own).alias("before"))
    ends = ranged.groupBy("range").agg(F.max(key).alias("end"))
    # the range before the first is the last one
    links = ends.select("range", F.lag("end").over(Window.orderBy("range")).alias("earlier"), F.max("end").over(Window.partitionBy()).alias("last"))
    rows = within.join(F.broadcast(links), "range").select("k0", "k1", F.coalesce("before", "earlier", "last").alias("b"))
    return rows.select("k0", "k1", F.col("b.k0").alias("p0"), F.col("b.k1").alias("p1"))


def neighbours(docs: DataFrame, k: int = K, w: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text has the last floor(n / 4) of the text's n code points replaced by the first
    as many (or all) of the next document in ascending id; the last one's is the first.
    Columns: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    * null text: empty; two empty fingerprints have likeness 1, an empty and another one 0
    * null ids come last; documents of one id follow each other in the order of a hash of
      their texts; equal rows follow each other and have a result row each
    * very long texts are read whole; an empty table has no rows; extra columns are not read

    Texts are shuffled once. With each goes its fingerprint; the start of a text and its
    hashes go to the document before it. Equal rows are merged before that shuffle.
    """
    k0, k1 = row_key(id_col, text_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(k0.alias("k0"), k1.alias("k1"), F.col(f"`{id_col}`").alias("id"), text.alias("t"))
    read = F.struct("id", "t", winnow(F.col("t"), k, w).alias("f"))
    # one struct and its count: both uses below read the same columns, so Spark shuffles them once
    whole = rows.groupBy("k0", "k1").agg(F.any_value(read).alias("r"), F.count(F.lit(1)).alias("copies"))
    lengths = rows.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.floor(F.char_length("t") / 4).cast("int").alias("tail")).distinct()
    ring = _ring(rows.select("k0", "k1").distinct()).join(lengths, ["p0", "p1"])
    sent = whole.where(F.col("copies") > 0).join(ring, ["k0", "k1"]).select(
        F.col("p0").alias("k0"), F.col("p1").alias("k1"), F.substring("r.t", F.lit(1), F.col("tail")).alias("head"), F.array_distinct(hashes(F.col("r.f"))).alias("next")
    )
    return _edited(whole.where(F.col("copies") > 0).join(sent, ["k0", "k1"]).select("r.*", "copies", "head", "next"), k, w, id_col)


def _edited(rows: DataFrame, k: int, w: int, id_col: str) -> DataFrame:
    """Of a group of equal rows all but the last are followed by their own copy."""
    n = F.char_length("t")
    tail = F.floor(n / 4).cast("int")
    own = F.struct(F.substring("t", F.lit(1), tail).alias("head"), hashes(F.col("f")).alias("next"), (F.col("copies") - 1).alias("times"))
    other = F.struct("head", "next", F.lit(1).cast("long").alias("times"))
    cases = rows.select("id", "t", "f", n.cast("long").alias("n"), tail.alias("tail"), F.explode(F.when(F.col("copies") > 1, F.array(other, own)).otherwise(F.array(other))).alias("c"))
    edited = cases.select("*", F.concat(F.substring("t", F.lit(1), (F.col("n") - F.col("tail")).cast("int")), "c.head").alias("e"))
    both = edited.select("id", "n", "f", "c", F.sha2(F.encode("e", "UTF-8"), 256).alias("sha"), F.when(F.col("tail") == 0, F.col("f")).otherwise(winnow(F.col("e"), k, w)).alias("ef"))
    told = both.select(
        "id", "n", "sha", shown(F.col("f")).alias("fingerprint"), shown(F.col("ef")).alias("edited_fingerprint"),
        _bound(hashes(F.col("f")), lambda h: likeness(h, hashes(F.col("ef")))).alias("near_edited"),
        _bound(hashes(F.col("f")), lambda h: likeness(h, F.col("c.next"))).alias("near_next"), "c.times",
    )
    copies = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", copies.alias("copy")).drop("copy")
