"""Phrase collocations by vertical positional inverted lists.

Documents are cut into chunks of one language; a chunk is stored once as the local numbers of
its words in order. Within a chunk an inverted list holds the positions of one phrase. A list
of k words is extended by merging its positions with those of the lists that begin one word
later (a sublist of the next word's postings, as only phrases that are frequent everywhere
have lists), so each merged list is one phrase of k + 1 words and its length its count there.
The lengths of a phrase's lists, added up over all chunks, are its exact frequency; only
(chunk, list, length) rows are shuffled, and chunks learn which of their lists are frequent.
Phrases are known by the pair of their first and last k - 1 words' numbers: no hash decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import fresh_dir

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
#: A phrase goes if a longer one has at least so many hundredths of its occurrences.
COVERED = 80
#: Words of a chunk; a longer text makes a longer chunk, as no phrase may be cut.
CHUNK_WORDS = 1 << 21
#: Bytes of text that are split into words at a time.
SPLIT_BYTES = 1 << 22
#: Characters that end a piece.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Parts of a language's phrases that are ranked apart before the best of all are.
SHARES = 64
#: A phrase's number is its first chunk's number and that of its list there: bits of a task's
#: chunks and of a chunk's lists.
TASK_BITS, LIST_BITS = 14, 29
_LIST = "own long, a long, b long, n int"


def _table() -> bytes:
    """Bytes to bytes: A-Z lower-cased, ends of pieces to one of them, tabs to spaces."""
    t = bytearray(range(256))
    t[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
    for c in PIECE_ENDS:
        t[c] = 0x0A
    t[0x09] = 0x20
    return bytes(t)


class _Chunk:
    """Words of a chunk by their numbers in the order of first occurrence; -1 ends a piece."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, raw: bytes, table: bytes) -> None:
        at = 0
        while at < len(raw):
            end = min(len(raw), at + SPLIT_BYTES)
            if end < len(raw):  # not within a word: go on to its end
                ends = [p for p in (raw.find(s, end) for s in (b" ", b"\t", b"\n", b".", b",")) if p >= 0]
                end = min(ends) if ends else len(raw)
            # 0xFF occurs in no UTF-8 text; here it stands for an end of a piece
            words = raw[at:end].translate(table).replace(b"\n", b" \xff ").split(b" ")
            codes, distinct = pd.factorize(np.array(words, dtype=object))
            known = self.numbers
            local = np.array([-2 if not w else -1 if w == b"\xff" else known.setdefault(w, len(known)) for w in distinct], np.int32)
            got = local[codes]
            self._put(got[got != -2])
            at = end
        self._put(np.array([-1], np.int32))

    def _put(self, a: np.ndarray) -> None:
        self.parts.append(a)
        self.size += len(a)

    def row(self, chunk: int, lang: str) -> pa.RecordBatch:
        if self.size >> LIST_BITS:
            raise ValueError(f"a text has {self.size} words and ends of pieces; {1 << LIST_BITS} is the limit")
        ids = np.concatenate(self.parts)
        n = np.bincount(ids[ids >= 0], minlength=len(self.numbers))
        words = [w.decode() for w in self.numbers]
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk]), pa.array([lang]), pa.array([ids.tobytes()], pa.binary()), pa.array([words], pa.list_(pa.string())), pa.array([n.tolist()], pa.list_(pa.int64()))],
            ["chunk", "lang", "ids", "words", "n"],
        )


def chunks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(chunk, lang, ids, words, n): the words of whole texts in order, as local numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, open_ = _table(), {}
        numbers = iter(range(1 << TASK_BITS))  # of more chunks, next() raises
        number = lambda: TaskContext.get().partitionId() << TASK_BITS | next(numbers)
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                if not (raw := text.as_py()):
                    continue
                c = open_.setdefault(lang, _Chunk())
                c.add(raw, table)
                if c.size >= CHUNK_WORDS:
                    yield open_.pop(lang).row(number(), lang)
        for lang, c in open_.items():
            if c.numbers:
                yield c.row(number(), lang)

    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.encode(F.col(f"`{text_col}`"), "UTF-8").alias("text"))
    return rows.mapInArrow(run, "chunk long, lang string, ids binary, words array<string>, n array<long>")


def merged(positions: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lists of phrases one word longer: (positions, list of each, first part, last part, length).

    ``positions`` ascend; ``lists`` names the list that holds each. A position is merged with
    the next where that lies one word on; equal pairs of lists make one new list.
    """
    meets = np.flatnonzero(positions[1:] == positions[:-1] + 1)
    first, last = lists[meets].astype(np.int64), lists[meets + 1].astype(np.int64)
    width = int(lists.max(initial=0)) + 1
    pairs, which, n = np.unique(first * width + last, return_inverse=True, return_counts=True)
    return positions[meets], which, pairs // width, pairs % width, n


def _extended(ids: bytes, known: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list, first part's phrase, last part's phrase, length) of a chunk's phrases of ``k`` words."""
    words = np.frombuffer(ids, np.int32)
    positions = np.flatnonzero(words >= 0)
    lists, n_lists = words[positions], int(words.max(initial=-1)) + 1
    for level in range(1, k):
        own = known[known["k"] == level]
        phrase = np.full(n_lists, -1, np.int64)  # of each list; -1: not frequent
        phrase[own["no"].to_numpy()] = own["id"].to_numpy()
        stays = phrase[lists] >= 0
        positions, lists, first, last, n = merged(positions[stays], lists[stays])
        n_lists = len(n)
    return np.arange(n_lists), phrase[first], phrase[last], n


def _candidates(stored: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """A row per chunk and list of ``k`` words (``own``: both in one number), with the list's length."""

    def run(chunk: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if chunk.empty or known.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("own", "a", "b", "n")})
        no, a, b, n = _extended(chunk["ids"][0], known, k)
        return pd.DataFrame({"own": int(chunk["chunk"][0]) << LIST_BITS | no, "a": a, "b": b, "n": n})

    return stored.select("chunk", "ids").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(run, _LIST)


def _frequent(lists: DataFrame, key: list[str], min_count: int) -> DataFrame:
    """Lists of phrases with at least ``min_count`` occurrences in all chunks: chunk, no, id, f, first.

    One shuffle by phrase. A phrase has a row per chunk at most, whatever its frequency. Its
    number is the least (chunk, list) that holds it; ``first`` marks that row.
    """
    phrase = Window.partitionBy(*key)
    rows = lists.select("*", F.sum("n").over(phrase).alias("f"), F.min("own").over(phrase).alias("id")).where(F.col("f") >= min_count)
    chunk, no = F.shiftright("own", LIST_BITS), F.col("own").bitwiseAND(F.lit((1 << LIST_BITS) - 1))
    return rows.select(chunk.alias("chunk"), no.alias("no"), *key, "id", "f", (F.col("own") == F.col("id")).alias("first"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    folder = fresh_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text") -> tuple[dict[int, DataFrame], DataFrame]:
    """({k: frequent phrases of k words}, words by lang): (lang, id, f, word) for 1, else (id, f, a, b).

    ``a`` and ``b`` are the numbers of the first and the last k - 1 words. Null texts count as
    empty and null languages as ``und``; repeated rows count as often as they stand; texts of
    any length are read whole (in steps of ``SPLIT_BYTES``), one text within one chunk; an
    empty table has no phrases. Other columns, ids included, are not read.
    """
    stored = _stored(chunks(docs, lang_col, text_col), "chunks")
    words = stored.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "n"))).select((F.col("chunk") * (1 << LIST_BITS) + F.col("pos")).alias("own"), "lang", F.col("col.words").alias("word"), F.col("col.n").cast("int").alias("n"))
    total = stored.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    levels = {1: _stored(_frequent(words, ["lang", "word"], min_count), "words")}
    for k in range(2, LONGEST + 1):
        known = None
        for level, rows in levels.items():
            told = rows.select("chunk", F.lit(level).alias("k"), "no", "id")
            known = told if known is None else known.unionByName(told)
        levels[k] = _stored(_frequent(_candidates(stored, known, k), ["a", "b"], min_count), "phrases")
    return {k: rows.where("first").drop("chunk", "no", "first") for k, rows in levels.items()}, total


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 * a / (left + right)), in decimals of 38 digits."""
    d = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", d(a) * F.lit(2_000_000), d(left) + d(right))


def _sides(level: dict[int, DataFrame]) -> DataFrame:
    """Candidates: k, id, lang, phrase, f, ``cuts`` (array of l, r by the first part's length) and ``inside`` (shorter phrases)."""
    one = level[1].select("lang", "id", F.col("word").alias("phrase"), "f", F.array(F.col("f")).alias("heads"), F.array(F.col("f")).alias("tails"), F.array().cast("array<struct<k:int,id:bigint>>").alias("inside"))
    found, out = one, None
    for k in range(2, LONGEST + 1):
        left, right = (found.select(*[F.col(c).alias(f"{side}_{c}") for c in found.columns]) for side in "ab")
        part = lambda c: F.struct(F.lit(k - 1).cast("int").alias("k"), F.col(c).cast("long").alias("id"))  # noqa: B023, E731
        whole = level[k].join(left, F.col("a") == F.col("a_id")).join(right, F.col("b") == F.col("b_id"))
        # heads[j], tails[j]: frequencies of the first and of the last j + 1 words
        found = whole.select(
            F.col("a_lang").alias("lang"), "id", F.concat_ws(" ", "a_phrase", F.substring_index("b_phrase", " ", -1)).alias("phrase"), "f",
            F.concat("a_heads", F.array("f")).alias("heads"), F.concat("b_tails", F.array("f")).alias("tails"),
            F.array_distinct(F.concat(F.array(part("a"), part("b")), "a_inside", "b_inside") if k > 2 else F.array().cast("array<struct<k:int,id:bigint>>")).alias("inside"),
        )
        cuts = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda j: F.struct(F.get("heads", j - 1).alias("l"), F.get("tails", F.lit(k) - j - 1).alias("r"), j.alias("at")))  # noqa: B023
        rows = found.select(F.lit(k).cast("int").alias("k"), "id", "lang", "phrase", "f", cuts.alias("cuts"), "inside")
        out = rows if out is None else out.unionByName(rows)
    return out


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to four words.

    ``a``, ``l`` and ``r`` are the frequencies of the phrase and of the two parts at its worst
    cut (of equal scores the earliest), ``n`` all words of the language. A phrase that lies
    in a longer one with at least ``COVERED`` hundredths of its occurrences is left out,
    whatever becomes of the longer one. ``top`` is the report's length. Ties are broken by
    frequency and by the phrase's bytes; nulls, repeats, long texts and empty tables are as in
    ``phrases``.
    """
    level, total = phrases(docs, min_count, lang_col, text_col)
    sides = _stored(_sides(level), "sides")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    longer = sides.select("f", F.inline("inside")).groupBy("k", "id").agg(F.max("f").alias("longer"))
    left = sides.join(longer, ["k", "id"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("f") * COVERED))
    scored = F.transform("cuts", lambda c: F.struct(_score(F.col("f"), c["l"], c["r"]).alias("score"), c["at"].alias("at"), c["l"].alias("l"), c["r"].alias("r")))
    best = left.select("lang", "phrase", F.col("f").alias("a"), F.array_min(scored).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    # in two levels: the best of each share of a language's phrases, and of those the best
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    by = [F.desc("score"), F.desc("a"), F.col("phrase")]
    within = best.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*by))).where(F.col("rank") <= top)
    ranked = within.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
