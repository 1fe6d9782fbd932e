"""Incremental substring dedup over a log-structured index of window fingerprints.

The index holds sorted immutable runs: tables bucketed and sorted by fingerprint, one per
batch of documents. A fingerprint stands for a block of windows (see ``anchors``): the hash
of the words that anchor them and a digest of the block, with the first document that has
it. Beside the runs lie the batches' texts, bucketed by document.

A new batch becomes a run and is merge-joined with the runs of the history by the anchors;
blocks that share an anchor but are not equal are verified over their words, for which only
those documents of the history are unpacked that have such a block. The batch's removals
are returned; documents of earlier batches are not judged again. When a level holds
``FANOUT`` runs they are merged into one of the next level, so a fingerprint is rewritten
once a level, not once a batch.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from pulsegrid.llm.anchors import HOT, Windows, combine, combined_blocks, occurrences, packed_texts, part_block, unpack_text  # noqa: F401
from pulsegrid.llm.shared import LAST, cut, fresh_dir, keyed, remove_dir

#: Bytes of blocks that are resolved together; blocks of one key and part stay together.
SOLVE_BYTES = 1 << 21
#: Runs of one level that are merged into one of the next.
FANOUT = 4


def _split(text: str) -> tuple[list[bytes], bytes, np.ndarray, np.ndarray]:
    words = text.encode().split()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return words, b" ".join(words), ends - sizes, ends


def _words(text: str) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    words, raw, starts, ends = _split(text)
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)), raw, starts, ends


def _cut_out(length: int, gram: int):
    """From documents and their blocks to the blocks' words; blocks of a hot key go in parts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k0, z, blocks in zip(frame["k0"], frame["z"], frame["blocks"]):
                words, raw, starts, ends = _split(unpack_text(z))
                for b in blocks:
                    lo, to = b["lo"], b["lo"] + b["n"] + length - 1
                    if b["nb"] <= HOT:
                        out.append((b["key"], 0, b["dig"], k0, 0, raw[starts[lo] : ends[to - 1]]))
                        continue
                    h = np.fromiter(map(xxh3_64_intdigest, words[lo:to]), np.uint64, to - lo)
                    for name, first, last in zip(*(x.tolist() for x in part_block(h, length, gram))):
                        out.append((b["key"], name, b["dig"], k0, first, raw[starts[lo + first] : ends[lo + last + length - 1]]))
            yield pd.DataFrame(out, columns=["key", "part", "dig", "k0", "at", "block"])

    return run


def _first_documents(length: int):
    """From rows (key, part, dig, k0, at, block), those of a key and part together, to the first document of each window.

    Windows are told apart by all their words.
    """

    def solve(rows: list[tuple]) -> pd.DataFrame:
        first: dict[bytes, int] = {}
        windows = []
        for _, _, _, k0, _, block in rows:
            gaps = [-1, *np.flatnonzero(np.frombuffer(block, np.uint8) == 32).tolist(), len(block)]
            own = [block[gaps[i] + 1 : gaps[i + length]] for i in range(len(gaps) - length)]
            windows.append(own)
            for w in own:
                if first.get(w, LAST) > k0:
                    first[w] = k0
        out = []
        for (key, _, dig, _, at, _), own in zip(rows, windows):
            firsts = np.array([first.get(w, LAST) for w in own], np.int64)
            out.append((key, dig, at, len(own), firsts.tobytes()))
        return pd.DataFrame(out, columns=["key", "dig", "at", "n", "firsts"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                if size >= SOLVE_BYTES and row[:2] != rows[-1][:2]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield solve(rows)

    return run


def _remove(length: int, with_text: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for id_, null, z, found in zip(frame["id"], frame["null"], frame["z"], frame["found"]):
                words = unpack_text(z).encode().split()
                edge = np.zeros(len(words) + 1, np.int32)
                for b in found if found is not None else ():
                    at = b["lo"] + np.arange(b["n"])
                    if b["firsts"] is not None:
                        at = at[np.frombuffer(b["firsts"], np.int64) < id_]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                row = (None if null else int(id_), len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode()) if with_text else row)
            names = ["id", "n_words", "n_removed", "kept_sha256", "kept"][: 5 if with_text else 4]
            yield pd.DataFrame(out, columns=names).astype({"id": "Int64"})

    return run


class SubstringIndex:
    """The runs of an index and the texts beside them, as tables below the shared folder."""

    def __init__(self, spark: SparkSession, length: int = 50, name: str | None = None, fanout: int = FANOUT):
        self.spark, self.spec, self.fanout = spark, Windows(length, 8, _words), fanout
        self.name = name or f"substring_index_{uuid.uuid4().hex}"
        self.folder = fresh_dir(spark, "substring_index")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.texts: list[str] = []
        self.n_tables = 0

    def _write(self, rows: DataFrame, by: tuple[str, ...], sort: tuple[str, ...]) -> str:
        """An immutable table of one file per bucket, sorted within it."""
        table = f"{self.name}_{self.n_tables}"
        self.n_tables += 1
        rows.write.option("compression", "zstd").option("path", f"{self.folder}/{table}").bucketBy(self.buckets, *by).sortBy(*sort).saveAsTable(table)
        return table

    def _forget(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove_dir(self.spark, f"{self.folder}/{table}")

    def _write_run(self, blocks: DataFrame) -> str:
        """One row per fingerprint with its first document, dealt by key so that a run has one file per bucket."""
        first = F.min(F.struct("k0", "k1", "lo", "n")).alias("rep")
        rows = blocks.repartition(self.buckets, "key").groupBy("key", "dig").agg(first, F.max("last").alias("last"))
        return self._write(rows.select("key", "dig", "rep.*", "last"), ("key",), ("key", "dig"))

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, rows: DataFrame, with_text: bool = False) -> DataFrame:
        """Takes in a batch, rows of ``keyed``, and returns what each of its documents loses to smaller ids so far."""
        # The batch's blocks are needed for its run and for its removals: found once, kept until both are done.
        folder = f"{self.folder}/blocks-{uuid.uuid4().hex}"
        found = occurrences(rows, self.spec)
        found.write.option("compression", "zstd").parquet(folder)
        blocks = self.spark.read.schema(found.schema).parquet(folder)
        new = self._write_run(combine(blocks))
        texts = packed_texts(rows, "id").repartition(self.buckets, "k0", "k1")
        own = self._write(texts, ("k0", "k1"), ("k0", "k1"))
        out = cut(self._removals(blocks, own, self._repeats(new, own), with_text))
        remove_dir(self.spark, folder)
        self.texts.append(own)
        self.levels[0].append(new)
        self.compact()
        return out

    def compact(self) -> None:
        """Merges the runs of each full level into one of the next: of equal fingerprints the first document stays."""
        for level, names in enumerate(self.levels):
            if len(names) < self.fanout:
                continue
            run = self.spark.table(names[0])
            for name in names[1:]:
                run = run.unionByName(self.spark.table(name))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write_run(run))
            self.levels[level] = []
            for name in names:
                self._forget(name)

    def drop(self) -> None:
        for name in [*self.runs(), *self.texts]:
            self._forget(name)
        remove_dir(self.spark, self.folder)
        self.levels, self.texts = [[]], []

    def candidates(self, new: str) -> DataFrame:
        """Blocks of the batch and, merge-joined by key, of the history, where a window of the batch can repeat a smaller id's.

        (key, dig, rep, nb): ``nb`` counts the different blocks of the key.
        """
        batch = self.spark.table(new)
        blocks = batch.select("*", F.lit(True).alias("own"))
        for name in self.runs():
            # Both sides lie by key in as many buckets: neither is shuffled.
            met = self.spark.table(name).join(batch.select("key"), "key", "left_semi")
            blocks = blocks.unionByName(met.select("*", F.lit(False).alias("own")))
        by_key = Window.partitionBy("key")
        merged = blocks.repartition(self.buckets, "key").groupBy("key", "dig").agg(
            F.min(F.struct("k0", "k1", "lo", "n")).alias("rep"), F.max(F.when(F.col("own"), F.col("last"))).alias("last")
        )
        again = (F.min("rep.k0").over(by_key) < F.max("last").over(by_key)).alias("again")
        return merged.select("*", F.count(F.lit(1)).over(by_key).alias("nb"), again).where("again").select("key", "dig", "rep", "nb")

    def _repeats(self, new: str, own: str) -> DataFrame:
        """(key, dig, at, n, first, firsts): what the batch's blocks can repeat.

        ``firsts`` has the first document of each window where blocks of one anchor differ;
        where all are equal it is null and ``first`` holds for every window.
        """
        again = cut(self.candidates(new))
        wanted = again.where("nb > 1").groupBy("rep.k0", "rep.k1").agg(F.collect_list(F.struct("key", "dig", "nb", "rep.lo", "rep.n")).alias("blocks"))
        schema = "key long, part long, dig long, k0 long, at int, block binary"
        pieces = None
        for name in [own, *self.texts]:
            # Texts stay where they lie; those without a wanted block are not unpacked.
            met = self.spark.table(name).join(wanted, ["k0", "k1"]).select("k0", "z", "blocks")
            piece = met.mapInPandas(_cut_out(self.spec.length, self.spec.gram), schema)
            pieces = piece if pieces is None else pieces.unionByName(piece)
        by_part = pieces.repartition(self.buckets, "key", "part").sortWithinPartitions("key", "part")
        solved = by_part.mapInPandas(_first_documents(self.spec.length), "key long, dig long, at int, n int, firsts binary")
        plain = again.where("nb = 1").select("key", "dig", F.lit(0).alias("at"), "rep.n", F.col("rep.k0").alias("first"), F.lit(None).cast("binary").alias("firsts"))
        return plain.unionByName(solved.select("key", "dig", "at", "n", F.lit(None).cast("long").alias("first"), "firsts"))

    def _removals(self, blocks: DataFrame, own: str, repeats: DataFrame, with_text: bool) -> DataFrame:
        """One row per document of the batch: what its windows lose to documents with smaller ids."""
        found = blocks.drop("n").join(repeats, ["key", "dig"]).where("first IS NULL OR first < k0")
        by_doc = found.groupBy("k0", "k1").agg(F.collect_set(F.struct((F.col("lo") + F.col("at")).alias("lo"), "n", "firsts")).alias("found"))
        made = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
        whole = self.spark.table(own).join(by_doc, ["k0", "k1"], "left")
        whole = whole.select(F.col("k0").alias("id"), F.col("id").isNull().alias("null"), "z", "found")
        return whole.mapInPandas(_remove(self.spec.length, with_text), made)


def remove_repeats(
    docs: DataFrame, length: int = 50, batches: int = FANOUT + 1, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 and, if asked, the kept words.

    Documents enter the index in ``batches`` ranges of ids, the smaller ones first; the default is
    one more than a level holds runs, so runs are compacted on the way. Each word
    goes that lies in a window of ``length`` words which also starts in a document with a
    smaller id; windows are judged on the input.

    * null or empty text: no words; texts shorter than a window stay whole
    * null id: kept (ids are below 2**63 - 1), after all ids and never smaller than another null
    * rows with equal ids never repeat each other; each gives a result row
    * texts are read whole, in bounded runs; an empty table: no rows; other columns are not read
    """
    id_ = F.col(f"`{id_col}`")
    index = SubstringIndex(docs.sparkSession, length)
    low, high = docs.agg(F.min(id_.cast("long")), F.max(id_.cast("long"))).first()
    step = ((high or 0) - (low or 0)) // batches + 1
    out = None
    try:
        for b in range(batches):
            # on the ids as they lie, so that the scan skips the other batches' row groups
            own = (id_ >= (low or 0) + b * step) & (id_ < (low or 0) + (b + 1) * step)
            taken = index.add(keyed(docs.where(own | id_.isNull() if b == batches - 1 else own), id_col, text_col), with_text)
            out = taken if out is None else out.unionByName(taken)
    finally:
        index.drop()
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
