"""Near copies by the exact Jaccard similarity of their word shingles: the wide setting of operator 9.

Texts of five-word similarity 0.8 differ in about 15 % of their SimHash bits, so over one
bit in a byte: however wide a SimHash is, no count of whole bytes is guaranteed. The wide
fingerprint therefore has 64 positional bytes of which each tells the least shingle under
an order of its own; two texts share a byte with the probability of their similarity or
more, 51 of 64 at 0.8. As in the narrow setting the index keeps postings of positions taken
together (16 bands of four bytes) and the shared bytes are counted within a list; the
minimum of 36 and a common band fail for about one pair in 4,000 at 0.8, fewer above. The
pairs found so make loose components only: within them the shingles themselves are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from pulsegrid.llm.components import components
from pulsegrid.llm.decontaminate import grams
from pulsegrid.llm.shared import cut, keyed

BYTES, BAND, SHARED = 64, 4, 36
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 63, BYTES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, BYTES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int) -> np.ndarray:
    """The different shingles' hashes, sorted; a shorter text is one shingle, one without words has none."""
    own = text.encode().lower().split()
    h = np.fromiter(map(xxh3_64_intdigest, own), np.uint64, len(own))
    return np.unique(grams(h, min(words, len(h)) or 1).view(np.uint64))


def wide_fingerprint(s: np.ndarray) -> bytes:
    """64 bytes: of the least shingle under each of as many orders."""
    s = (s ^ (s >> np.uint64(29))) * _MIX
    s ^= s >> np.uint64(32)
    least = np.full(BYTES, (1 << 64) - 1, np.uint64)
    for at in range(0, len(s), 8_192):
        np.minimum(least, (s[at : at + 8_192, None] * _FACTORS + _OFFSETS).min(0), out=least)
    least = (least ^ (least >> np.uint64(31))) * _MIX
    return (least >> np.uint64(56)).astype(np.uint8).tobytes()


def _joined(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs that connect all of n indices that ``near`` links; one that is linked isn't compared with its class again."""
    left = np.arange(n)
    while len(left):
        waiting, left = [int(left[0])], left[1:]
        while waiting and len(left):
            i = waiting.pop()
            hit = near(i, left)
            for j in left[hit].tolist():
                yield i, j
                waiting.append(j)
            left = left[~hit]


def _whole(frames: Iterator[pd.DataFrame], by: str) -> Iterator[pd.DataFrame]:
    """Frames that end where a group of the sorted column ``by`` ends."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        key = frame[by].to_numpy()
        if at := int(np.flatnonzero(key == key[-1])[0]):
            yield pd.concat([*kept, frame.iloc[:at]])
            kept = []
        elif kept and kept[-1][by].iloc[-1] != key[0]:
            yield pd.concat(kept)
            kept = []
        kept.append(frame.iloc[at:])
    if kept:
        yield pd.concat(kept)


def _groups(key: np.ndarray) -> Iterator[slice]:
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[begins[1:], len(key)]
    for g in np.flatnonzero(ends - begins > 1):
        yield slice(int(begins[g]), int(ends[g]))


def _loose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in _whole(frames, "key"):
        node, out = frame["t"].to_numpy(), []
        for g in _groups(frame["key"].to_numpy()):
            z = np.frombuffer(b"".join(frame["z"].iloc[g]), np.uint8).reshape(-1, BYTES)
            own = node[g]
            out += [(own[i], own[j]) for i, j in _joined(len(own), lambda i, left: (z[left] == z[i]).sum(1) >= SHARED)]
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64").drop_duplicates()


def _near(sets: list[np.ndarray], share: Fraction) -> Callable[[int, np.ndarray], np.ndarray]:
    sizes = np.array([len(s) for s in sets])

    def near(i: int, left: np.ndarray) -> np.ndarray:
        hit = np.minimum(sizes[left], sizes[i]) * share.denominator >= np.maximum(sizes[left], sizes[i]) * share.numerator
        some = left[hit]
        if len(some):
            starts = np.r_[0, np.cumsum(sizes[some])[:-1]]
            both = np.add.reduceat(np.isin(np.concatenate([sets[j] for j in some]), sets[i]).astype(np.int64), starts)
            hit[hit] = both * share.denominator >= (sizes[some] + sizes[i] - both) * share.numerator
        return hit

    return near


def links(docs: DataFrame, id_col: str, text_col: str, similarity: float, words: int, name: Callable[[str], int]) -> DataFrame:
    """Edges (a, b) between the names, 64 unsigned bits as longs, of texts whose shingles are similar.

    Their closure is that of all pairs of the loose components with the similarity or more.
    A loose component's different texts meet in one task, in memory that grows with their
    words; each is compared only with texts that no text before has linked.
    """
    n, share = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), Fraction(str(similarity))
    texts = keyed(docs, id_col, text_col).select(F.xxhash64("text").alias("t"), "text")

    def wide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [(t, wide_fingerprint(s)) for t, text in zip(frame["t"], frame["text"]) if len(s := shingles(text, words))]
            yield pd.DataFrame(made, columns=["t", "z"])

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole(frames, "root"):
            text, out = frame["text"].to_numpy(), []
            for g in _groups(frame["root"].to_numpy()):
                own = text[g]
                pairs = list(_joined(len(own), _near([shingles(x, words) for x in own], share)))
                names = {i: name(own[i]) for i in {i for pair in pairs for i in pair}}
                out += [(names[i], names[j]) for i, j in pairs]
            yield pd.DataFrame(np.array(out, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    prints = texts.mapInPandas(wide, "t long, z binary").dropDuplicates(["t"])
    keys = [F.xxhash64(F.lit(i), F.substring("z", 1 + BAND * i, BAND)) for i in range(BYTES // BAND)]
    lists = prints.select("t", "z", F.explode(F.array(*keys)).alias("key")).repartition(n, "key").sortWithinPartitions("key")
    loose = components(lists.mapInPandas(_loose, "a long, b long"))
    members = texts.join(loose, texts["t"] == loose["node"]).select("root", "t", "text").dropDuplicates(["t"])
    return cut(members.repartition(n, "root").sortWithinPartitions("root", "t").mapInPandas(exact, "a long, b long").where("a <> b"))
