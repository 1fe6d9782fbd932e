"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

A *word* here is a stretch of text between single spaces, its leading space included
(``"the cat"`` holds ``"the"`` and ``" cat"``). The tokenizer's pattern always starts a
new match at a space that stands between two non-space characters, so words can be
encoded apart from their surroundings, each pattern match separately.

1. ``_chunks``: each task turns its documents into bounded chunks, once: the chunk's
   distinct words, dealt into hash buckets, and for every document the places of its words.
   The chunks are a table below the shared folder, bucketed by chunk, so that all that
   follows starts from the same rows whatever executor is lost.
2. The buckets are shuffled: all copies of a word meet in one task, which encodes it once.
3. The ids go back by a shuffle to their chunk, whose documents stay where they lie, and are
   put together by place; each word's ids are decoded through the token-byte table.

Words travel as one compressed row per (chunk, bucket), for a row per word would take
several times the disk. A frequent word counts once per chunk, so no key is hot.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from pulsegrid.llm.shared import fresh_dir, keyed

#: A chunk ends with the document that brings its text to so many characters.
CHUNK_CHARS = 16_000_000
#: Different words that a task remembers; beyond, it starts anew.
REMEMBERED = 1_000_000
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: its size is that of the vocabulary, whatever the corpus."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    table = [b""] * (max(int(n) for _, n in pairs) + 1)
    for token, n in pairs:
        table[int(n)] = base64.b64decode(token)
    return table


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    ranks = {t: i for i, t in enumerate(token_bytes(path)) if t}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _only_lone_spaces(text: str) -> bool:
    """Whether each space stands between two characters that are no white space."""
    if "  " in text or text[0] == " " or text[-1] == " ":
        return False
    return not any(c in text and (" " + c in text or c + " " in text) for c in _OTHER_SPACES)


def split_words(text: str) -> list[str]:
    """Pieces of the text between lone spaces; each but the first had a space before it."""
    return text.split(" ") if not text or _only_lone_spaces(text) else _LONE_SPACE.split(text)


class _Numbers(dict):
    """Numbers new keys in the order in which they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _pack(value) -> bytes:
    return zstandard.compress(pickle.dumps(value, 5), 3)


def _unpack(blob: bytes):
    return pickle.loads(zstandard.decompress(blob))


def _planes(x: np.ndarray) -> np.ndarray:
    """Numbers as four planes of bytes: those of one significance lie together."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()


def _numbers(planes: np.ndarray) -> np.ndarray:
    return planes.T.copy().view("<u4").ravel()


def _chunks(buckets: int):
    """Rows (chunk, bucket, blob): bucket -1 holds the documents, the others words."""

    def rows(seed: int, docs: list, places: list, rest: dict, first: dict) -> pd.DataFrame:
        words = [" " + w for w in rest] + list(first)
        # A first word's number follows those of all the others.
        seq = np.concatenate([p + np.where(head, len(rest), 0) for p, head in places])
        of = (np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)).astype(np.uint16)
        own = _pack((docs, _planes(seq), of))
        chunk = xxh3_64_intdigest(own, seed) - (1 << 63)
        out, order = [(chunk, -1, own)], np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            out.append((chunk, b, _pack([words[i] for i in order[cuts[b] : cuts[b + 1]].tolist()])))
        return pd.DataFrame(out, columns=["chunk", "bucket", "blob"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seed, size = TaskContext.get().partitionId() << 20, 0
        docs, places, rest, first = [], [], _Numbers(), _Numbers()
        for frame in frames:
            for id_, null, text in zip(frame["id"], frame["null"], frame["text"]):
                pieces = split_words(text) if text else []
                nums = np.empty(len(pieces), np.uint32)
                head = np.zeros(len(pieces), bool)
                if pieces:
                    head[0], nums[0] = True, first[pieces[0]]
                    nums[1:] = np.fromiter(map(rest.__getitem__, pieces[1:]), np.uint32, len(pieces) - 1)
                docs.append((None if null else int(id_), len(pieces)))
                places.append((nums, head))
                size += len(text)
                if size >= CHUNK_CHARS:
                    yield rows(seed, docs, places, rest, first)
                    seed, size = seed + 1, 0
                    docs, places, rest, first = [], [], _Numbers(), _Numbers()
        if docs:
            yield rows(seed, docs, places, rest, first)

    return run


def _encode_words(path: str):
    """Every word of the task's buckets is encoded once; rows (chunk, bucket, ids of the words)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary

        class Ids(dict):
            def __missing__(self, word: str) -> bytes:
                self[word] = got = array("I", encode(word)).tobytes()
                return got

        known = Ids()
        for frame in frames:
            for chunk, bucket, blob in frame.itertuples(index=False):
                if len(known) > REMEMBERED:
                    known.clear()
                ids = list(map(known.__getitem__, _unpack(blob)))
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                packed = _pack((_planes(sizes), _planes(np.frombuffer(b"".join(ids), np.uint32))))
                yield pd.DataFrame({"chunk": [chunk], "bucket": [bucket], "blob": [packed]})

    return run


def _reassemble(path: str, with_ids: bool):
    """A chunk's documents beside the ids of its words, one row each by bucket."""
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 5 if with_ids else 4]

    def documents(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        docs, planes, of = _unpack(own["blob"].iloc[0])
        words = [_unpack(blob) for blob in found.sort_values("bucket")["blob"]]
        sizes = np.concatenate([np.zeros(0, np.uint32), *(_numbers(s) for s, _ in words)]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, np.uint32), *(_numbers(i) for _, i in words)])
        place = np.empty(len(of), np.int64)
        place[np.argsort(of, kind="stable")] = np.arange(len(of))
        seq = place[_numbers(planes)]
        ends = np.cumsum(sizes)
        # Decoding: each token's bytes from the table, joined to each word's.
        pieces, table = ids.tolist(), token_bytes(path)
        raw = b"".join(map(table.__getitem__, pieces))
        until = np.r_[0, np.cumsum(np.fromiter((len(table[i]) for i in pieces), np.int64, len(pieces)))]
        decoded = [raw[a:b] for a, b in zip(until[ends - sizes].tolist(), until[ends].tolist())]
        out, at = [], 0
        for id_, n in docs:
            own_words = seq[at : at + n]
            at += n
            lens = sizes[own_words]
            after = np.cumsum(lens)
            total = int(after[-1]) if n else 0
            here = ids[np.repeat((ends - sizes)[own_words] - (after - lens), lens) + np.arange(total)].astype("<u4")
            text = b"".join(map(decoded.__getitem__, own_words.tolist()))
            row = (id_, total, hashlib.sha256(here.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest())
            out.append((*row, here.astype(np.int32)) if with_ids else row)
        return pd.DataFrame(out, columns=names).astype({"id": "Int64"})

    return documents


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True
) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers,
    ``decoded_sha256`` over the bytes that decoding the ids through the token-byte table
    gives. ``path`` names a rank file that every executor can read.

    * null or empty text: no tokens; null id: kept; repeated rows: a result row each
    * very long texts are encoded whole, a text of over ``CHUNK_CHARS`` as a chunk of its own
    * ids are numbers below 2**63 - 1; an empty table: no rows; other columns are not read

    The chunks stay below ``spark.checkpoint.dir``, like a checkpoint, until that is cleared.
    """
    path = path or default_ranks()
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Null ids travel beside the number: pandas would turn a nullable integer into a float.
    rows = keyed(docs, id_col, text_col).select(F.col("k0").alias("id"), F.col("id").isNull().alias("null"), "text")
    schema = "chunk long, bucket int, blob binary"
    folder = fresh_dir(spark, "chunks")
    table = "pulsegrid_" + folder.rpartition("/")[2].replace("-", "_")
    writer = rows.mapInPandas(_chunks(buckets), schema).write.option("path", folder).option("compression", "none")
    writer.bucketBy(buckets, "chunk").saveAsTable(table)
    chunks = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name alone: the files of a table with a path stay
    words = chunks.where("bucket >= 0").repartition(buckets, "bucket").mapInPandas(_encode_words(path), schema)
    made = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    own = chunks.where("bucket < 0").groupBy("chunk")
    out = own.cogroup(words.groupBy("chunk")).applyInPandas(_reassemble(path, with_ids), made)
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row per input row: the id and ``decoded``, the bytes of its ids.

    The token-byte table has as many rows as the vocabulary and so is bounded.
    Null ids give null; ids outside the table raise.
    """
    path = path or default_ranks()

    @F.pandas_udf("binary")
    def joined(ids: pd.Series) -> pd.Series:
        table = token_bytes(path)
        return ids.map(lambda x: None if x is None else b"".join(map(table.__getitem__, x)))

    return tokens.select(F.col(f"`{id_col}`"), joined(F.col(f"`{ids_col}`")).alias("decoded"))
