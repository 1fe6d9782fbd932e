"""SimHash near-duplicates by an inverted index over positional bytes with count filtering.

Fingerprints that differ in at most three bits differ in at most three of their eight
bytes, so a linked pair shares at least five positional bytes: the guaranteed minimum. A
posting list of a single byte would hold a 256th of all fingerprints, and its pairs grow
with the square; so a posting stands for three positions and their bytes. Of five shared
positions three lie in one half of the eight: the four threes of either half, eight
postings a fingerprint, are enough to bring every such pair together. Within a list the
shared positional bytes of each pair are tallied, pairs that reach five are verified bit by
bit, and what leaves a list is a forest over its linked members, not its pairs.

Few pairs of five-word similarity 0.8 are within three bits; ``keep_one`` with a similarity
adds the links of the wide setting (``shingle_links``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pulsegrid.llm import shingle_links
from pulsegrid.llm.components import components
from pulsegrid.llm.shared import LAST, cut, keyed, semi

BYTES = 8
#: Lists above this size are split by two more positions, and probed by bit flips if that leaves them so long.
PAIRWISE = 2_048
#: Rows of small lists that are compared side by side.
SIDE_BY_SIDE = 16
#: Words per shingle where a similarity is asked for.
SIMILAR_WORDS = 5
_HASH = partial(xxh64_intdigest, seed=42)


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    total, n = np.zeros(64, np.int64), 0
    for at in range(0, len(words) - k + 1, 500_000):
        part = words[at : at + 500_000 + k - 1]
        hashes = np.fromiter(map(_HASH, map(b" ".join, zip(*(part[i:] for i in range(k))))), np.uint64, len(part) - k + 1)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(id, k1, fp) of every row; the unsigned fingerprint in the bits of a long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        got = np.fromiter((fingerprint(t, words_per_shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(got.view(np.int64))

    return keyed(docs, id_col, text_col).select("id", "k1", of("text").alias("fp"))


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Pairs that reach the guaranteed count of shared bytes and then hold bit by bit."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
    close = shared >= BYTES - bits
    close[close] = np.bitwise_count(x[close]) <= bits
    return close


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for x in (a, b, before[a], before[b]):
            np.minimum.at(root, x, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _choices(bits: int) -> list[tuple[int, ...]]:
    """Positions of a posting: any set of as many positions as a linked pair shares holds one of the choices."""
    half, shared = BYTES // 2, BYTES - bits
    take = -(-shared // 2)
    return [tuple(i + at for i in c) for at in (0, half) for c in combinations(range(half), take)]


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << 8 * i for i in positions)


def _joined(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a short list that connect what is linked: a member once linked isn't compared with its class again."""
    left, pairs = np.arange(len(fps)), []
    while len(left):
        waiting, left = [int(left[0])], left[1:]
        while waiting and len(left):
            i = waiting.pop()
            hit = _close(fps[left], fps[i], bits)
            found = left[hit]
            if len(found):
                pairs.append((np.full(len(found), i), found))
                waiting += found.tolist()
                left = left[~hit]
    none = [np.zeros(0, np.int64)]
    return np.concatenate([*none, *(a for a, _ in pairs)]), np.concatenate([*none, *(b for _, b in pairs)])


def _list_links(fps: np.ndarray, shared: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs, as far as they connect, within one list of distinct fingerprints that agree at ``shared``."""
    if len(fps) <= PAIRWISE:
        return _joined(fps, bits)
    more, others = BYTES - bits - len(shared), [i for i in range(BYTES) if i not in shared]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if more > 0:
        for chosen in combinations(others, more):
            key = fps & np.uint64(_mask(chosen))
            order = np.argsort(key, kind="stable")
            begins = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            for s, e in zip(begins, np.r_[begins[1:], len(fps)]):
                if e - s > 1:
                    own = order[s:e]
                    a, b = _list_links(fps[own], (*shared, *chosen), bits)
                    left.append(own[a])
                    right.append(own[b])
    else:
        order = np.argsort(fps)
        ranked, n = fps[order], len(fps)
        root = np.arange(n)
        flips = [np.uint64(1 << 8 * i + b) for i in others for b in range(8)]
        for k in range(1, bits + 1):
            for chosen in combinations(flips, k):
                other = ranked ^ np.bitwise_or.reduce(chosen)
                at = np.minimum(np.searchsorted(ranked, other), n - 1)
                i = np.flatnonzero((ranked[at] == other) & (root[at] != root))
                if len(i):  # a forest is kept instead of the pairs
                    root = _forest(n, np.r_[i, np.arange(n)], np.r_[at[i], root])
        i = np.flatnonzero(root != np.arange(n))
        left.append(order[i])
        right.append(order[root[i]])
    return np.concatenate(left), np.concatenate(right)


def _links(choices: list[tuple[int, ...]], bits: int):
    """From rows (m, key, fp), those of a list together, to forest edges (a, b)."""

    def edges(m: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        begins = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[begins, len(fp)])
        group = np.repeat(np.arange(len(begins)), sizes)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(1, SIDE_BY_SIDE):
            i = np.flatnonzero((group[:-s] == group[s:]) & (sizes[group[:-s]] <= SIDE_BY_SIDE)) if len(fp) > s else left[0]
            if not len(i):
                break
            i = i[_close(fp[i], fp[i + s], bits)]
            left.append(i)
            right.append(i + s)
        for g in np.flatnonzero(sizes > SIDE_BY_SIDE):
            at = begins[g]
            a, b = _list_links(fp[at : at + sizes[g]], choices[m[at]], bits)
            left.append(a + at)
            right.append(b + at)
        root = _forest(len(fp), np.concatenate(left), np.concatenate(right))
        i = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[i].view(np.int64), "b": fp[root[i]].view(np.int64)}).drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for frame in frames:
            m, key = frame["m"].to_numpy(), frame["key"].to_numpy()
            # The last list may go on in the next frame.
            at = int(np.flatnonzero((m == m[-1]) & (key == key[-1]))[0]) if len(m) else 0
            if at:
                whole = pd.concat([*kept, frame.iloc[:at]])
                yield edges(whole["m"].to_numpy(), whole["key"].to_numpy(), whole["fp"].to_numpy().view(np.uint64))
                kept = []
            kept.append(frame.iloc[at:])
        if kept and len(whole := pd.concat(kept)):
            yield edges(whole["m"].to_numpy(), whole["key"].to_numpy(), whole["fp"].to_numpy().view(np.uint64))

    return run


def link_fingerprints(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Edges (a, b) whose closure links all pairs of distinct ``fp`` within ``bits`` bits (at most four).

    Any fingerprint has the same number of postings, so rows grow with the fingerprints.
    A list holds distinct values: copies of a text are one value. It is worked on in
    memory that grows with its length only.
    """
    n, choices = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), _choices(bits)
    signed = [m - (1 << 64) * (m >> 63) for m in map(_mask, choices)]
    postings = fps.repartition(n, "fp").select(
        "fp", F.inline(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))
    )
    lists = postings.repartition(n, "m", "key").sortWithinPartitions("m", "key")
    return lists.mapInPandas(_links(choices, bits), "a long, b long").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, bits: int, words_per_shingle: int, similarity: float | None = None) -> DataFrame:
    """(id, k1, fp, least, n_fingerprints): ``least`` tells the first row of the component."""
    made = cut(fingerprints(docs, id_col, text_col, words_per_shingle))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k1"))
    fps = made.groupBy("fp").agg(first.alias("least"))
    edges = link_fingerprints(fps.select("fp"), bits)
    if similarity is not None:
        name = partial(fingerprint, words_per_shingle=words_per_shingle)
        edges = edges.unionByName(shingle_links.links(docs, id_col, text_col, similarity, SIMILAR_WORDS, name))
    roots = components(edges)
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n_fingerprints"))
    known = rooted.drop("least").join(least, "root").select("fp", "least", "n_fingerprints")
    return made.join(known, "fp")


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3, words_per_shingle: int = 3
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, n_fingerprints.

    ``component_id`` is the least id of the rows that are reached over links, itself
    included; ``n_fingerprints`` counts the distinct fingerprints of the component.

    * null, empty or wordless texts have fingerprint zero and are linked like any other
    * very long texts are read whole, in bounded parts; ids are numbers below 2**63 - 1
    * null ids are kept but name no component unless all ids of it are null
    * repeated rows: a result row each, in one component; an empty table: no rows
    * other columns are not read
    """
    return _classes(docs, id_col, text_col, bits, words_per_shingle).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.id").alias("component_id"),
        "n_fingerprints",
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3, words_per_shingle: int = 3,
    similarity: float | None = None,
) -> DataFrame:
    """The documents without near copies: of each component the row of the least id stays.

    With ``similarity``, texts whose sets of five-word shingles have that Jaccard similarity
    or more are linked as well as those within ``bits``.

    Rows with equal ids and texts count as one document and stay or go together. Of a
    component of null ids alone, the rows of one text stay. Null and empty texts are like any
    other, very long ones are read whole; all columns travel along, whatever their names; an
    empty table: no rows.
    """
    here = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1")
    stay = _classes(docs, id_col, text_col, bits, words_per_shingle, similarity).where(here == F.col("least"))
    stay = stay.select(F.coalesce(F.col("id").cast("long"), F.lit(LAST)).alias("__k0"), F.col("k1").alias("__k1")).distinct()
    return semi(docs, stay, id_col, text_col)
