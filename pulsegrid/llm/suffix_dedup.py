"""Exact substring dedup with suffix arrays by two-stage sorting.

Anchored blocks (see ``anchors``) bring together every two places where one string of 200
bytes could start twice. Blocks whose 128 bits of anchor and digest are equal repeat as a
whole; what blocks of one anchor share that differ is found by sorting. A task lays the blocks of its keys end to end and sorts their
suffixes in two stages: suffixes smaller than their successors are sorted directly, the
others are induced by scans over the buckets of first bytes. Common prefixes of neighbours
of the array then tell which strings repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.anchors import HOT, Windows, combined_blocks, distinct_blocks, occurrences, packed_texts, part_block, repeated, unpack_text
from pulsegrid.llm.shared import LAST, cut, keyed

#: Bytes of blocks that are sorted together; blocks of one key and part stay together.
SORT_BYTES = 1 << 18


def _bytes(text: str) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    raw = text.encode()
    b = np.frombuffer(raw, np.uint8)
    at = np.arange(len(b))
    return _BYTE_HASH[b], raw, at, at + 1


_BYTE_HASH = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)


def _words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number (zeros past the end)."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(t)].copy().view(">u8").ravel().astype(np.uint64)


_MIX = np.random.default_rng(11).integers(1, 1 << 63, 2, np.uint64) | np.uint64(1)


def _stretches(words: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bytes, a hash of so many bytes from each place on), the longest first; past the end all are zeros."""
    out, size, h, rest = [(8, words)], 8, words, np.zeros(1, np.uint64)
    while size < 128:
        both = h * _MIX[0] + np.concatenate([h[size:], np.full(min(size, len(h)), rest[0])])
        rest = rest * _MIX[0] + rest
        h, rest = ((x ^ (x >> np.uint64(29))) * _MIX[1] for x in (both, rest))
        size *= 2
        out.insert(0, (size, h))
    return out


def _sort_directly(places: np.ndarray, depth: int, words: np.ndarray, stretches: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The places in the order of the ``depth`` bytes from each on.

    Eight bytes are sorted at first; then, within each group that is still equal, stretches
    that all members share are passed over and the next bytes sorted beside the group's number.
    """
    last = len(words) - 1
    out = places[np.argsort(words[places])]
    slots, places, own = np.arange(len(out)), out, words[out]
    new = np.r_[True, own[1:] != own[:-1]][: len(out)]
    at = np.full(np.count_nonzero(new), 8)
    while True:
        sizes = np.diff(np.r_[np.flatnonzero(new), len(places)])
        tied = (sizes > 1) & (at < depth)
        if not tied.any():
            return out
        members = np.repeat(tied, sizes)
        slots, places, sizes, at = slots[members], places[members], sizes[tied], at[tied]
        begins, group = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        for size, h in stretches:
            own = h[np.minimum(places + at[group], last)]
            at += np.where(np.logical_or.reduceat(own != own[begins][group], begins), 0, size)
        take = min(7, (64 - len(sizes).bit_length()) // 8)
        key = words[np.minimum(places + at[group], last)] >> np.uint64(64 - 8 * take)
        key |= group.astype(np.uint64) << np.uint64(8 * take)
        order = np.argsort(key)
        key, places = key[order], places[order]
        out[slots] = places
        new = np.r_[True, key[1:] != key[:-1]]
        at = at[group[new]] + take


def two_stage_sort(t: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffix array of bytes ``t`` (its last byte, 0, is the unique least), by the first ``depth`` bytes.

    Places whose suffix is smaller than the next one's are sorted directly. Scanning the
    buckets of first bytes upwards, each place in order puts its predecessor, if that is
    larger than it, at the next free slot of the predecessor's bucket. With the mask
    ``wanted`` the array is sparse: it holds these places, and those after a larger one up
    to the next smaller one, from which its order is induced.
    """
    n = len(t)
    nxt = np.append(t[1:], 0)
    # Where two neighbours are equal, the next unequal pair decides.
    where = np.minimum.accumulate(np.where(t != nxt, np.arange(n), n - 1)[::-1])[::-1]
    smaller = t[where] < nxt[where]
    if wanted is None:
        held = np.ones(n, bool)
    else:
        # Runs of larger places end at a smaller one: a run is held from its first wanted place on.
        run = np.cumsum(np.r_[True, smaller[:-1]]) - 1
        first = np.full(int(run[-1]) + 1, n)
        np.minimum.at(first, run[wanted], np.flatnonzero(wanted))
        held = np.arange(n) >= first[run]
        held[n - 1] = True
    words = _words(t)
    direct = _sort_directly(np.flatnonzero(smaller & held), depth, words, _stretches(words))
    counts = np.bincount(t[held], minlength=256)
    ends = np.cumsum(counts)
    free = ends - counts
    sa = np.full(int(ends[-1]), -1, np.int64)
    firsts = t[direct]
    per = np.bincount(firsts, minlength=256)
    begins = np.cumsum(per) - per
    sa[(ends - per)[firsts] + np.arange(len(direct)) - begins[firsts]] = direct
    sa[0], free[0] = n - 1, max(free[0], 0) + 1  # the end of the text
    induced = held & ~smaller
    induced[n - 1] = False

    def induce(places: np.ndarray) -> None:
        before = places[places > 0] - 1
        before = before[induced[before]]
        chars = t[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        many = np.bincount(chars, minlength=256)
        at = free[chars] + np.arange(len(before)) - (np.cumsum(many) - many)[chars]
        sa[at] = before
        free[:] += many

    for c in range(256):
        if not counts[c]:
            continue
        at = ends[c] - counts[c]
        while at < free[c]:  # larger suffixes; some put others into this very bucket
            to = free[c]
            induce(sa[at:to])
            at = to
        induce(sa[ends[c] - per[c] : ends[c]])
    return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray, least: int) -> np.ndarray:
    """For each neighbouring pair of the array: whether they share ``least`` bytes or more."""
    words, n = _words(t), len(t)
    a, b = sa[:-1], sa[1:]
    live = np.flatnonzero(np.maximum(a, b) + least <= n)
    for at in [*range(0, least - 7, 8), least - 8]:
        live = live[words[a[live] + at] == words[b[live] + at]]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def _sort_blocks(length: int):
    """From rows (key, part, dig, c, at, block), those of a key and part together, to (key, dig, at, n, bits)."""

    def solve(rows: list[tuple]) -> pd.DataFrame:
        blocks = [r[5] for r in rows]
        sizes = np.array([len(b) for b in blocks])
        # Blocks are told apart by place: a window never runs into the next block.
        t = np.frombuffer(b"".join([*blocks, b"\0"]), np.uint8)
        starts = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        is_start = np.zeros(len(t) + 1, np.int32)
        np.add.at(is_start, starts, 1)
        np.add.at(is_start, starts + windows, -1)
        is_start = np.cumsum(is_start)[:-1] > 0
        sa = two_stage_sort(t, length, is_start)
        sa = sa[is_start[sa]]
        same = common_prefixes(t, sa, length)
        hit = np.zeros(len(t), bool)
        hit[sa[:-1][same]] = True
        hit[sa[1:][same]] = True
        out = []
        for (key, _, dig, c, at, _), s, w in zip(rows, starts, windows):
            bits = hit[s : s + w]
            if c == 1 and bits.any():  # a block that occurs again repeats as a whole
                out.append((key, dig, at, w, np.packbits(bits).tobytes()))
        return pd.DataFrame(out, columns=["key", "dig", "at", "n", "bits"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                if size >= SORT_BYTES and row[:2] != rows[-1][:2]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield solve(rows)

    return run


def _cut_out(length: int, gram: int):
    """From rows (z, blocks) of documents to the blocks' bytes; blocks of a hot key go in parts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for z, blocks in zip(frame["z"], frame["blocks"]):
                raw = unpack_text(z).encode()
                for b in blocks:
                    block = raw[b["lo"] : b["lo"] + b["n"] + length - 1]
                    if b["nb"] <= HOT:
                        out.append((b["key"], 0, b["dig"], b["c"], 0, block))
                        continue
                    parts = part_block(_BYTE_HASH[np.frombuffer(block, np.uint8)], length, gram)
                    for name, first, last in zip(*(x.tolist() for x in parts)):
                        out.append((b["key"], name, b["dig"], b["c"], first, block[first : last + length]))
            yield pd.DataFrame(out, columns=["key", "part", "dig", "c", "at", "block"])

    return run


def _remove(length: int, with_text: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for id_, null, z, found in zip(frame["id"], frame["null"], frame["z"], frame["found"]):
                raw = np.frombuffer(unpack_text(z).encode(), np.uint8)
                gone = np.zeros(len(raw), bool)
                if found is not None:
                    hit = np.zeros(len(raw), np.uint8)  # a document's blocks, and a block's parts, have no window in common
                    for b in found:
                        bits = b["bits"]
                        hit[b["lo"] : b["lo"] + b["n"]] = 1 if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), count=b["n"])
                    so_far = np.cumsum(hit, dtype=np.int64)
                    so_far[length:] -= so_far[:-length].copy()
                    gone = so_far > 0  # a window starts here or less than its length before
                kept = raw[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                row = (None if null else int(id_), len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_text else row)
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5]
            yield pd.DataFrame(out, columns=names).astype({"id": "Int64"})

    return run


def remove_repeats(
    docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the kept bytes.

    Each byte goes that a ``length``-byte string covers which also starts elsewhere, in the
    same text or another; strings are judged on the input. ``length`` is at least 32.

    * null or empty text: no bytes; texts shorter than ``length`` stay whole
    * null id: kept (ids are below 2**63 - 1); repeated rows: copies of each other, so both lose what repeats
    * texts are read whole, in bounded runs; an empty table: no rows; other columns are not read
    """
    spec = Windows(length, 16, _bytes)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs, id_col, text_col)
    blocks = cut(repeated(distinct_blocks(combined_blocks(rows, spec)), False).select("key", "dig", "rep", "c", "nb"))
    # A block that occurs again repeats as a whole; the sort finds what different blocks of one anchor share.
    whole = blocks.where("c > 1").select("key", "dig", F.lit(0).alias("at"), F.col("rep.n").alias("n"), F.lit(None).cast("binary").alias("bits"))
    texts = packed_texts(rows)  # by document twice below, in the same columns: shuffled once
    differ = blocks.where("nb > 1")
    wanted = differ.groupBy("rep.k0", "rep.k1").agg(F.collect_list(F.struct("key", "dig", "c", "nb", "rep.lo", "rep.n")).alias("blocks"))
    cut_out = texts.join(wanted, ["k0", "k1"]).select("z", "blocks").mapInPandas(_cut_out(length, spec.gram), "key long, part long, dig long, c long, at int, block binary")
    by_part = cut_out.repartition(n, "key", "part").sortWithinPartitions("key", "part")
    solved = by_part.mapInPandas(_sort_blocks(length), "key long, dig long, at int, n int, bits binary").unionByName(whole)
    found = occurrences(rows, spec).drop("n").join(solved, ["key", "dig"])
    by_doc = found.groupBy("k0", "k1").agg(F.collect_set(F.struct((F.col("lo") + F.col("at")).alias("lo"), "n", "bits")).alias("found"))
    made = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    beside = texts.join(by_doc, ["k0", "k1"], "left")
    out = beside.select(F.col("k0").alias("id"), (F.col("k0") == LAST).alias("null"), "z", "found").mapInPandas(_remove(length, with_text), made)
    return out.withColumnRenamed("id", id_col)
