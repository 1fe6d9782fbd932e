"""Anchored blocks: how repeats of a fixed length find each other without a row per position.

Every window of ``length`` items (bytes or words) contains ``length - gram + 1`` grams; the
one of least hash is its anchor, the same in every copy of the window. Consecutive windows
with one anchor form a block, about two per ``length`` items, so equal windows always lie
in blocks of equal key (the anchor's hash) at equal offsets from the anchor. Rows of blocks
are shuffled instead of rows of windows, and only blocks whose key occurs again go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: Items that are worked on at once; their places must fit in 24 bits.
BATCH = 1 << 21
#: Different blocks of one key above which each is parted by further anchors.
HOT = 500
_RANDOM = np.random.default_rng(20_240_101).integers(1, 1 << 63, 8, np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Windows:
    """What a window is: its length and gram in items, and how a text gives items.

    ``items(text)`` returns (hash of each item, bytes, start and end of each item therein).
    """

    length: int
    gram: int
    items: Callable[[str], tuple[np.ndarray, bytes, np.ndarray, np.ndarray]]


def _grams(h: np.ndarray, gram: int) -> np.ndarray:
    """A mixed hash of every run of ``gram`` (a power of two) items."""
    size, step = 1, 0
    while size < gram:
        h = h[:-size] * _RANDOM[step] + h[size:]
        h = (h ^ (h >> np.uint64(29))) * _RANDOM[step + 1]
        size, step = 2 * size, (step + 1) % 6
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width``, from minima towards the borders of blocks of that width."""
    n = len(x)
    rows = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    rows[:n] = x
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def find_blocks(h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, last window) of the blocks of one run of items."""
    g = _grams(h, gram)
    low = (1 << 24) - 1
    packed = (g & np.uint64(~low & (1 << 64) - 1)) | np.arange(len(g), dtype=np.uint64)
    anchor = (_sliding_min(packed, length - gram + 1) & np.uint64(low)).astype(np.int64)
    begins = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return g[anchor[begins]], begins, np.r_[begins[1:], len(anchor)] - 1


_ORDERS = np.random.default_rng(20_240_102).integers(1, 1 << 63, 4, np.uint64) | np.uint64(1)


def part_block(h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, last window) of the parts of a block whose windows agree in four more anchors.

    A gram that is everywhere gathers blocks that have little else in common. The least
    grams under other orders tell them apart: equal windows still meet under one name.
    """
    g = _grams(h, gram)
    n, low = len(h) - length + 1, np.uint64((1 << 24) - 1)
    name, new = np.zeros(n, np.uint64), np.zeros(n, bool)
    new[0] = True
    for order in _ORDERS:
        mixed = g * order
        packed = ((mixed ^ (mixed >> np.uint64(31))) * _RANDOM[0] & ~low) | np.arange(len(g), dtype=np.uint64)
        anchor = (_sliding_min(packed, length - gram + 1) & low).astype(np.int64)
        new[1:] |= anchor[1:] != anchor[:-1]
        name = (name ^ (name >> np.uint64(29))) * _RANDOM[1] + g[anchor]
    begins = np.flatnonzero(new)
    return name[begins].view(np.int64), begins, np.r_[begins[1:], n] - 1


def _combine(key: np.ndarray, dig: np.ndarray, k0: np.ndarray, k1: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """One row per (key, dig) of the frame: how many there are, the first and last document."""
    order = np.lexsort((lo, k1, k0, dig, key))
    key, dig, k0 = key[order], dig[order], k0[order]
    begins = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (dig[1:] != dig[:-1])]) if len(key) else np.zeros(0, int)
    ends = np.r_[begins[1:], len(key)] - 1 if len(key) else begins
    first = order[begins]
    return pd.DataFrame(
        {"key": key[begins], "dig": dig[begins], "k0": k0[begins], "k1": k1[first], "lo": lo[first], "n": n[first], "c": ends - begins + 1, "last": k0[ends]}
    )


def _blocks_of(spec: Windows, combined: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for k0, k1, text in zip(frame["k0"], frame["k1"], frame["text"]):
                h, raw, starts, ends = spec.items(text)
                # A long text is taken in runs that overlap by a window less one item.
                for at in range(0, max(0, len(h) - spec.length + 1), BATCH):
                    key, first, last = find_blocks(h[at : at + BATCH + spec.length - 1], spec.length, spec.gram)
                    first, last, view = first + at, last + at, memoryview(raw)
                    begin, end = starts[first].tolist(), ends[last + spec.length - 1].tolist()
                    dig = np.fromiter((xxh3_64_intdigest(view[s:e]) for s, e in zip(begin, end)), np.uint64, len(begin))
                    same = np.full(len(key), k0, np.int64), np.full(len(key), k1, np.int64)
                    parts.append((key.view(np.int64), dig.view(np.int64), *same, first, last - first + 1))
            cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 6
            yield _combine(*cols) if combined else pd.DataFrame(dict(zip(("key", "dig", "k0", "k1", "lo", "n"), cols)))

    return run


def occurrences(rows: DataFrame, spec: Windows) -> DataFrame:
    """(key, dig, k0, k1, lo, n): every block of every text; ``dig`` is a digest of its items."""
    schema = "key long, dig long, k0 long, k1 long, lo int, n int"
    return rows.select("k0", "k1", "text").mapInPandas(_blocks_of(spec, False), schema)


def combined_blocks(rows: DataFrame, spec: Windows) -> DataFrame:
    """Blocks put together within each task's frames: (key, dig, k0, k1, lo, n, c, last).

    Of equal blocks one stays, with its count and the first and last document, so a passage
    in very many documents shrinks before the shuffle.
    """
    schema = "key long, dig long, k0 long, k1 long, lo int, n int, c long, last long"
    return rows.select("k0", "k1", "text").mapInPandas(_blocks_of(spec, True), schema)


#: Rows of blocks that are put together at once where blocks are read from a table.
TOGETHER = 1 << 19


def _combine_read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    columns = ("key", "dig", "k0", "k1", "lo", "n")
    for frame in frames:
        held.append([frame[c].to_numpy() for c in columns])
        size += len(frame)
        if size >= TOGETHER:
            yield _combine(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield _combine(*map(np.concatenate, zip(*held)))


def combine(blocks: DataFrame) -> DataFrame:
    """``combined_blocks`` from rows of ``occurrences``, for callers that have stored these."""
    schema = "key long, dig long, k0 long, k1 long, lo int, n int, c long, last long"
    return blocks.select("key", "dig", "k0", "k1", "lo", "n").mapInPandas(_combine_read, schema)


def distinct_blocks(combined: DataFrame) -> DataFrame:
    """One row per (key, dig): the first place ``rep``, the count, the last document."""
    n = int(combined.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        combined.repartition(n, "key")
        .groupBy("key", "dig")
        .agg(F.min(F.struct("k0", "k1", "lo", "n")).alias("rep"), F.sum("c").alias("c"), F.max("last").alias("last"))
    )


def repeated(distinct: DataFrame, other_documents: bool) -> DataFrame:
    """Distinct blocks whose key occurs again (or, if asked, in another document), with ``nb``,
    the number of distinct blocks of the key. No shuffle: the rows lie by key already."""
    by_key = Window.partitionBy("key")
    again: Column = F.min("rep.k0").over(by_key) < F.max("last").over(by_key) if other_documents else F.sum("c").over(by_key) > 1
    return distinct.select("*", F.count(F.lit(1)).over(by_key).alias("nb"), again.alias("again")).where("again").drop("again")


def packed_texts(rows: DataFrame, *more: str) -> DataFrame:
    """(k0, k1, z, *more): texts compressed for the shuffles by document."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        squeeze = zstandard.ZstdCompressor(3).compress
        return texts.map(lambda t: squeeze(t.encode()))

    return rows.select("k0", "k1", pack("text").alias("z"), *more)


def unpack_text(z: bytes) -> str:
    return zstandard.decompress(z).decode()
