"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A passage with at least ``similarity`` of an item's words in place lacks at most
d = (1 - similarity) * words of them. Every gram of n neighbouring words of an item is a
seed, for which grams an edit spoils is not known beforehand; in a passage up to ``GAP``
other words may stand between two words of a seed. So inserted words, up to that many at
one place, spoil none, and each missing word spoils at most n: of w - n + 1 grams at least
w - n + 1 - n * d are found. Where that is no gram at all (w = 5 at 0.8), the item's grams
are shorter, so that one at least is left, and all that must be left are asked for; else
half of the number is (one at least), which leaves room for places where more words are
inserted.

If k of an item's m seeds must occur, one of any m - k + 1 does. So its m - k + 1 rarest
seeds, by the number of times that they occur in the texts and in items, lead to passages;
grams that many texts share join nothing unless an item has no others. Only in passages so
found the other seeds are looked for, and item and passage are aligned word by word around
all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh3_64_intdigest

from pulsegrid.llm.anchors import packed_texts, unpack_text
from pulsegrid.llm.shared import cut, keyed, semi

#: Items up to so many characters in all travel with the tasks; beyond, they are joined.
CARRIED_CHARS = 4_000_000
MATCH, MISMATCH, SKIP = 2, -1, -1
#: Words of the passage that may stand between two neighbours of a seed.
GAP = 2
#: Least and greatest size of the filter over seeds as a power of two bits (so 64 MB at most), and words of texts that are looked up at once.
FILTER_BITS, LOOKED_UP = (19, 29), 1 << 20
#: Passages of more words per word of the item are scored first and traced back only around the best end.
LONG = 16
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    """Words are runs of letters, digits and underscores; case doesn't count."""
    words = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n words; of a shorter text none."""
    if len(h) < n:
        return np.zeros(0, np.int64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = (out ^ (out >> np.uint64(31))) * _MIX + h[i : len(h) - n + 1 + i]
    return out.view(np.int64)


def _spread_grams(h: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """``grams`` of words with up to ``GAP`` others between neighbours, one array for each choice of gaps."""
    for gaps in product(range(GAP + 1), repeat=n - 1):
        offsets = np.cumsum([0, *(g + 1 for g in gaps)])
        m = len(h) - int(offsets[-1])
        if m <= 0:
            continue
        out = h[:m].copy()
        for at in offsets[1:]:
            out = (out ^ (out >> np.uint64(31))) * _MIX + h[at : at + m]
        yield out.view(np.int64)


def gram_size(words: int, similarity: float, n: int) -> int:
    """Words of an item's grams: n, or fewer where the edits could spoil every gram of n."""
    return max(1, min(n, words // (1 + edits(words, similarity))))


def least_seeds(words: int, similarity: float, n: int) -> int:
    """Places of an item whose seeds must occur before it is aligned."""
    size = gram_size(words, similarity, n)
    left = words - size + 1 - size * edits(words, similarity)
    return left if size < n else max(1, left // 2)


def edits(words: int, similarity: float) -> int:
    """Words of an item that may be missing from a copy."""
    return int(words * (1 - Fraction(str(similarity))))


def _next_row(row: np.ndarray, word: np.uint64, passage: np.ndarray, ramp: np.ndarray) -> np.ndarray:
    """The row below ``row`` in the table of alignments; gaps along a row are a running maximum."""
    new = np.zeros(len(row), np.int32)
    new[1:] = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + SKIP)
    np.maximum(new, 0, out=new)
    return np.maximum.accumulate(new + ramp) - ramp


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman: (score, equal words on the best path, its start and end in the passage).

    Of equal scores the one that ends first wins, and diagonal steps go before gaps. A best
    path gains two per word of the item and loses one per other word of the passage, so it
    spans fewer than three words per word of the item: of a long passage two rows are held,
    and the table is filled around the best end alone.
    """
    n, shift = len(item), 0
    if len(passage) > LONG * n:
        ramp = np.arange(len(passage) + 1, dtype=np.int32) * -SKIP
        row = best = np.zeros(len(passage) + 1, np.int32)
        for word in item:
            row = _next_row(row, word, passage, ramp)
            best = np.maximum(best, row)
        end = int(best.argmax())
        shift = max(0, end - 3 * n)
        passage = passage[shift:end]
    ramp = np.arange(len(passage) + 1, dtype=np.int32) * -SKIP
    table = np.zeros((n + 1, len(passage) + 1), np.int32)
    for i in range(1, n + 1):
        table[i] = _next_row(table[i - 1], item[i - 1], passage, ramp)
    end = int(table.max(0).argmax())
    i, j = int(table[:, end].argmax()), end
    score, equal = int(table[i, j]), 0
    while i and j and table[i, j]:
        same = item[i - 1] == passage[j - 1]
        if table[i, j] == table[i - 1, j - 1] + (MATCH if same else MISMATCH):
            i, j, equal = i - 1, j - 1, equal + int(same)
        elif table[i, j] == table[i - 1, j] + SKIP:
            i -= 1
        else:
            j -= 1
    return score, equal, shift + j, shift + end


def best_match(item: np.ndarray, text: np.ndarray, starts: np.ndarray, similarity: float) -> tuple | None:
    """The best alignment near the places where seeds say that the item might start.

    Places that are close are aligned as one region, so each word of the text is aligned a
    bounded number of times. The best path gains two per word of the item and loses one per
    inserted word, so it holds fewer than two inserted words per word of the item: regions
    reach that far. Those with too few of the item's words are left out: they cannot reach
    the similarity.
    """
    need = len(item) - edits(len(item), similarity)
    slack = MATCH * len(item)
    starts = np.unique(starts)
    first = np.maximum(starts - slack, 0)
    last = np.minimum(starts + len(item) + slack, len(text))
    begins = np.flatnonzero(np.r_[True, first[1:] > np.maximum.accumulate(last)[:-1]])
    best = None
    for a, b in zip(begins, np.r_[begins[1:], len(starts)]):
        lo, hi = int(first[a]), int(last[a:b].max())
        region = text[lo:hi]
        if np.count_nonzero(np.isin(region, item)) < need or np.count_nonzero(np.isin(item, region)) < need:
            continue
        score, equal, s, e = align(item, region)
        if equal >= need and (best is None or (equal, score) > best[:2]):
            best = (equal, score, lo + s, lo + e)
    return best


_SCHEMA = "k0 long, k1 long, no_id boolean, item long, similarity double, score int, start int, end int"


def _lookups(frame: pd.DataFrame) -> Iterator[tuple[range, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(rows, hashes of their words, all of them in one array with fillers between texts, each text's first place)."""
    rows, own, size = 0, [], 0
    filler = np.full(64, _MIX, np.uint64)

    def out() -> tuple:
        flat = np.concatenate([x for h in own for x in (h, filler)])
        starts = np.cumsum([0, *(len(h) + len(filler) for h in own[:-1])])
        return range(rows, rows + len(own)), own, flat, starts

    for text in frame["text"]:
        own.append(word_hashes(text))
        size += len(own[-1])
        if size >= LOOKED_UP:
            yield out()
            rows, own, size = rows + len(own), [], 0
    if own:
        yield out()


def _filter_bits(seeds: int) -> int:
    """Size of the filter over so many seeds: about one bit in 32 is set, until the greatest size is reached."""
    return min(max(FILTER_BITS[0], (32 * seeds).bit_length()), FILTER_BITS[1])


def _filter_place(g: np.ndarray, bits: int) -> np.ndarray:
    return g.view(np.uint64) >> np.uint64(64 - bits)


def _seeded(flat: np.ndarray, sizes: list[int], filter_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, gram) of grams of these sizes that pass the filter: bytes of eight seeds each."""
    places, found, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], len(filter_).bit_length() + 2
    for g in (g for size in sizes for g in _spread_grams(flat, size)):
        at = _filter_place(g, bits)
        hit = np.flatnonzero(filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
        places.append(hit)
        found.append(g[hit])
    return np.concatenate(places), np.concatenate(found)


def _equal(names: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into g, index into the sorted names) of all equal pairs."""
    lo, hi = np.searchsorted(names, g, "left"), np.searchsorted(names, g, "right")
    many = hi - lo
    return np.repeat(np.arange(len(g)), many), np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _rarest(item: np.ndarray, often: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Which seeds are among the ``spare`` rarest of their item."""
    order = np.lexsort((often, item))
    own = item[order]
    out = np.zeros(len(item), bool)
    out[order] = np.arange(len(own)) - np.searchsorted(own, own) < spare[order]
    return out


def _carried(items: dict[int, np.ndarray], seeds: pd.DataFrame, n: int, similarity: float):
    """Items and seeds travel with the task; what is rare is told by the texts that are looked up at once."""
    seeds = seeds.sort_values("gram", kind="stable")
    names, item_of, at_of, spare = (seeds[c].to_numpy() for c in ("gram", "item", "at", "spare"))
    sizes, width = sorted(set(seeds["size"])), int(item_of.max(initial=0)) + 1
    sharing = np.searchsorted(names, names, "right") - np.searchsorted(names, names, "left")
    bits = np.zeros(1 << _filter_bits(len(names)), bool)
    bits[_filter_place(names, _filter_bits(len(names)))] = True
    filter_ = np.packbits(bits, bitorder="little")
    need = {i: least_seeds(len(h), similarity, n) for i, h in items.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            ids = list(zip(frame["k0"].tolist(), frame["k1"].tolist(), frame["no_id"].tolist()))
            for rows, own, flat, starts in _lookups(frame):
                place, g = _seeded(flat, sizes, filter_)
                hit, at = _equal(names, g)
                rare = _rarest(item_of, np.bincount(at, minlength=len(names)) * sharing, spare)
                text = np.searchsorted(starts, place[hit], "right") - 1
                pair = text * width + item_of[at]
                led = np.isin(pair, np.unique(pair[rare[at]]))
                hit, at, text = hit[led], at[led], text[led]
                start = place[hit] - starts[text] - at_of[at]
                order = np.lexsort((item_of[at], text))
                text, item, start, seed = text[order], item_of[at][order], start[order], at_of[at][order]
                cuts = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]), True]) if len(text) else [0]
                for a, b in zip(cuts, cuts[1:]):
                    i = int(item[a])
                    if b - a < need[i] or len(np.unique(seed[a:b])) < need[i]:
                        continue
                    if got := best_match(items[i], own[text[a]], start[a:b], similarity):
                        out.append((*ids[rows[text[a]]], i, got[0] / len(items[i]), *got[1:]))
            yield pd.DataFrame(out, columns=["k0", "k1", "no_id", "item", "similarity", "score", "start", "end"])

    return run


def _seeds(items: pd.DataFrame, n: int, similarity: float = 0.8) -> pd.DataFrame:
    """(item, gram, at, size, spare): all grams of the items at each place, and how many of the rarest lead to passages."""
    out = []
    for i, text in zip(items["item"], items["text"]):
        h = word_hashes(text)
        if len(h) < n:
            continue
        size = gram_size(len(h), similarity, n)
        spare = len(h) - size + 1 - least_seeds(len(h), similarity, n) + 1
        out += [(i, g, at, size, spare) for at, g in enumerate(grams(h, size).tolist())]
    return pd.DataFrame(out, columns=["item", "gram", "at", "size", "spare"]).astype({"item": "int64", "gram": "int64", "at": "int32", "size": "int32", "spare": "int32"})


def _find_carried(rows: DataFrame, items: pd.DataFrame, n: int, similarity: float) -> DataFrame:
    hashes = {int(i): word_hashes(t) for i, t in zip(items["item"], items["text"])}
    return rows.mapInPandas(_carried(hashes, _seeds(items, n, similarity), n, similarity), _SCHEMA)


def _all_seeds(item: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Where the seeds found say that the item starts, and how many of its places they are."""
    g = grams(item, size)
    at_of = np.argsort(g, kind="stable")
    starts, seen = [np.zeros(0, np.int64)], np.zeros(len(g), bool)
    for own in _spread_grams(text, size):
        hit, at = _equal(g[at_of], own)
        starts.append(hit - at_of[at])
        seen[at_of[at]] = True
    return np.unique(np.concatenate(starts)), int(seen.sum())


def _joined_filter(seeds: DataFrame) -> np.ndarray:
    """The filter over the seeds: blocks of 64 KB are made by tasks, so the driver reads a thousand rows at most."""
    bits = _filter_bits(seeds.count())
    place = F.shiftrightunsigned("gram", 64 - bits)

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << FILTER_BITS[0], bool)
        own[frame["place"].to_numpy() & (len(own) - 1)] = True
        return pd.DataFrame({"block": [frame["place"].iloc[0] >> FILTER_BITS[0]], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    filter_, size = np.zeros(1 << bits - 3, np.uint8), 1 << FILTER_BITS[0] - 3
    made = seeds.select(place.alias("place")).distinct().groupBy(F.shiftright("place", FILTER_BITS[0])).applyInPandas(block, "block long, bits binary")
    for r in made.toLocalIterator():
        filter_[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return filter_


def _find_joined(rows: DataFrame, items: DataFrame, n: int, similarity: float) -> DataFrame:
    """The same by joins, for items of any number; what is rare is told by all texts.

    Grams of the texts pass a filter over the seeds before they are shuffled; its size
    follows the number of seeds up to 64 MB.
    """

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, words = None, np.zeros(0, np.uint64)
        for frame in frames:
            out = []
            for k0, k1, null, z, item, text in frame.itertuples(index=False, name=None):
                own = word_hashes(text)
                if last != (k0, k1):
                    last, words = (k0, k1), word_hashes(unpack_text(z))
                starts, n_seeds = _all_seeds(own, words, gram_size(len(own), similarity, n))
                if n_seeds < least_seeds(len(own), similarity, n):
                    continue
                if got := best_match(own, words, starts, similarity):
                    out.append((k0, k1, null, item, got[0] / len(own), *got[1:]))
            yield pd.DataFrame(out, columns=["k0", "k1", "no_id", "item", "similarity", "score", "start", "end"])

    seeds = cut(items.mapInPandas(lambda it: (_seeds(f, n, similarity) for f in it), "item long, gram long, at int, size int, spare int"))
    carried = rows.sparkSession.sparkContext.broadcast(_joined_filter(seeds))
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # n of them at most

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            k0, k1 = frame["k0"].to_numpy(), frame["k1"].to_numpy()
            for own, _, flat, starts in _lookups(frame):
                at, g = _seeded(flat, sizes, carried.value)
                text = own.start + np.searchsorted(starts, at, "right") - 1
                yield pd.DataFrame({"gram": g, "k0": k0[text], "k1": k1[text]}).drop_duplicates()

    hits = cut(rows.mapInPandas(places, "gram long, k0 long, k1 long"))
    often = hits.groupBy("gram").agg(F.count("*").alias("texts")).join(seeds.groupBy("gram").agg(F.count("*").alias("items")), "gram")
    by_rarity = Window.partitionBy("item").orderBy(F.coalesce(F.col("texts") * F.col("items"), F.lit(0)), "at")
    ranked = seeds.join(often, "gram", "left").withColumn("nth", F.row_number().over(by_rarity))
    rare = ranked.where("nth <= spare AND texts IS NOT NULL").select("gram", "item").distinct()
    pairs = hits.join(rare, "gram").select("k0", "k1", "item").distinct()
    texts = packed_texts(rows, "no_id").dropDuplicates(["k0", "k1"])
    joined = pairs.join(items, "item").join(texts, ["k0", "k1"])
    return joined.select("k0", "k1", "no_id", "z", "item", "text").mapInPandas(verify, _SCHEMA)


def _find(docs: DataFrame, benchmark: DataFrame, similarity: float, n: int, id_col: str, text_col: str, item_col: str, item_text_col: str, carried_chars: int):
    """(matches by row keys, items with their numbers)."""
    rows = keyed(docs, id_col, text_col).select("k0", "k1", F.col("id").isNull().alias("no_id"), "text")
    texts = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).where("text IS NOT NULL").distinct()
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars <= carried_chars:
        own = sorted(texts.collect(), key=lambda r: (True, r["text"]) if r["item_id"] is None else (False, r["item_id"], r["text"]))
        frame = pd.DataFrame({"item": np.arange(len(own)), "text": [r["text"] for r in own]})
        schema = StructType([StructField("item", LongType()), StructField("item_id", texts.schema["item_id"].dataType)])
        items = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], schema)
        return _find_carried(rows, frame, n, similarity), items
    numbered = cut(texts.withColumn("item", F.xxhash64("item_id", "text")))
    return _find_joined(rows, numbered.select("item", "text"), n, similarity), numbered.select("item", "item_id")


def find(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, n: int = 3, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", carried_chars: int = CARRIED_CHARS,
) -> DataFrame:
    """A row per document and item that it leaks: ids, similarity, score, start and end (words of the document).

    The similarity is the share of the item's words that the best alignment has in place.

    * null texts hold nothing; items of fewer than ``n`` words have no seeds and match nothing
    * ids of items are of any type, those of documents whole numbers
    * null ids are kept on either side; repeated rows of documents give one row, of items too
    * very long texts are read whole; an empty table on either side: no rows
    * other columns of either table are not read
    """
    found, items = _find(docs, benchmark, similarity, n, id_col, text_col, item_col, item_text_col, carried_chars)
    id_ = F.when(~F.col("no_id"), F.col("k0")).cast(docs.schema[id_col].dataType).alias(id_col)
    named = found.distinct().join(items, "item")
    return named.select(id_, F.col("item_id").alias(item_col), "similarity", "score", "start", "end")


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, n: int = 3, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", carried_chars: int = CARRIED_CHARS,
) -> DataFrame:
    """The documents, with their own columns, that leak no item.

    Null, empty and very long texts, null ids, repeated rows and empty tables are as in
    ``find``: a row goes if its id and text leak; all columns travel along, whatever their names.
    """
    found, _ = _find(docs, benchmark, similarity, n, id_col, text_col, item_col, item_text_col, carried_chars)
    leaks = found.select(F.col("k0").alias("__k0"), F.col("k1").alias("__k1")).distinct()
    return semi(docs, leaks, id_col, text_col, "left_anti")
