"""Arrays in ``.npy`` files as a Spark source and sink.

Reading: a file, or a folder of parts that the sink wrote, is dealt out by ranges of rows; only
headers are read on the driver, and a task reads its own bytes. Writing: each task writes one
part; the commit puts the parts in the order of the tasks into ``parts.json``, without which
the folder is no array, and an abort takes the parts away again. Every part is a
``.npy`` file by itself. Paths are local or any that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

INDEX = "parts.json"
#: Bytes of a range of rows, and rows of one batch within it.
RANGE_BYTES, BATCH_ROWS = 32 << 20, 1024
_KINDS = {"float32": "float", "float64": "double", "int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint"}


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


@dataclass
class Part:
    """A file's array: where its rows begin, their number, the shape of one and the type of its numbers."""

    path: str
    offset: int
    rows: int
    shape: tuple[int, ...]
    dtype: str

    @property
    def row_bytes(self) -> int:
        return math.prod(self.shape) * np.dtype(self.dtype).itemsize


def header(path: str) -> Part:
    """Reads a file's header alone; arrays in column order, of objects or without rows as a dimension raise."""
    fs, inner = _store(path)
    with fs.open_input_file(inner) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_columns, dtype = read(f)
        at = f.tell()
    if by_columns and len(shape) > 1:
        raise ValueError(f"{path} is in column order")
    if dtype.hasobject or not shape or dtype.newbyteorder("=").name not in _KINDS:
        raise ValueError(f"{path} holds {dtype} of shape {shape}")
    return Part(path, at, shape[0], tuple(shape[1:]), dtype.str)


def parts_of(path: str) -> list[Part]:
    """The parts of an array in order: of a file itself, of a folder those that its index names."""
    fs, inner = _store(path)
    kind = fs.get_file_info(inner).type
    if kind == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if kind == pafs.FileType.File:
        return [header(path)]
    with fs.open_input_file(f"{inner}/{INDEX}") as f:
        named = json.loads(f.read())["parts"]
    found = [header(f"{path}/{n}") for n in named]
    if len({(p.shape, p.dtype) for p in found}) > 1:
        raise ValueError(f"the parts of {path} differ in shape or type")
    return found


class _Rows(InputPartition):
    def __init__(self, part: Part, first: int, n: int, place: int) -> None:
        self.part, self.first, self.n, self.place = part, first, n, place


def _nested(flat: pa.Array, shape: tuple[int, ...]) -> pa.Array:
    """Values in row order as arrays of arrays of the row's shape."""
    for size in reversed(shape):
        n = len(flat) // size if size else 0
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), flat)
    return flat


class NpyReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[InputPartition]:
        out, place = [], 0
        for p in parts_of(self.path):
            step = max(1, self.range_bytes // max(1, p.row_bytes))
            out += [_Rows(p, lo, min(step, p.rows - lo), place + lo) for lo in range(0, p.rows, step)]
            place += p.rows
        return out or [_Rows(parts_of(self.path)[0], 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        p = partition.part
        fs, inner = _store(p.path)
        with fs.open_input_file(inner) as f:
            for lo in range(0, partition.n, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.n - lo)
                raw = f.read_at(n * p.row_bytes, p.offset + (partition.first + lo) * p.row_bytes)
                if len(raw) < n * p.row_bytes:
                    raise ValueError(f"{p.path} ends within a row")
                values = np.frombuffer(raw, p.dtype)
                flat = pa.array(values.astype(values.dtype.newbyteorder("="), copy=False))
                place = np.arange(partition.place + lo, partition.place + lo + n)
                yield pa.RecordBatch.from_arrays([pa.array(place), _nested(flat, p.shape)], ["pos", "x"])


@dataclass
class _Written(WriterCommitMessage):
    task: int
    name: str
    rows: int


class NpyWriter(DataSourceArrowWriter):
    """Rows of one column, a number or arrays of one shape; ``shape`` is that of a row."""

    def __init__(self, path: str, shape: tuple[int, ...], dtype: str, overwrite: bool) -> None:
        self.path, self.shape, self.dtype, self.overwrite = path, shape, dtype, overwrite
        self.run = uuid.uuid4().hex[:12]
        fs, inner = _store(path)
        if not overwrite and fs.get_file_info(f"{inner}/{INDEX}").type != pafs.FileType.NotFound:
            raise ValueError(f"{path} holds an array")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context, fs_path = TaskContext.get(), _store(self.path)
        fs, inner = fs_path
        fs.create_dir(inner, recursive=True)
        name = f"part-{context.partitionId():05d}-{self.run}-{context.taskAttemptId()}.npy"
        body, rows = f"{inner}/.{name}", 0
        want = math.prod(self.shape)
        with fs.open_output_stream(body) as out:
            for b in batches:
                flat = b.column(0)
                for size in self.shape:
                    lengths = flat.value_lengths().to_numpy(zero_copy_only=False)
                    if flat.null_count or (lengths != size).any():
                        raise ValueError(f"a row is not of shape {self.shape}")
                    flat = flat.flatten()
                if flat.null_count or len(flat) != b.num_rows * want:
                    raise ValueError(f"a row is null, holds a null or is not of shape {self.shape}")
                out.write(flat.to_numpy(zero_copy_only=False).astype(self.dtype, copy=False).tobytes())
                rows += b.num_rows
        # the header names the number of rows, which is known at the end only
        with fs.open_output_stream(f"{inner}/{name}") as out, fs.open_input_stream(body) as got:
            np.lib.format.write_array_header_1_0(out, {"descr": np.dtype(self.dtype).str, "fortran_order": False, "shape": (rows, *self.shape)})
            while block := got.read(8 << 20):
                out.write(block)
        fs.delete_file(body)
        return _Written(context.partitionId(), name, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, inner = _store(self.path)
        fs.create_dir(inner, recursive=True)
        done = sorted((m for m in messages if m), key=lambda m: m.task)
        named = [m.name for m in done if m.rows] or [m.name for m in done[:1]]
        if not named:  # no task ran at all
            named = [f"part-00000-{self.run}.npy"]
            with fs.open_output_stream(f"{inner}/{named[0]}") as out:
                np.lib.format.write_array_header_1_0(out, {"descr": np.dtype(self.dtype).str, "fortran_order": False, "shape": (0, *self.shape)})
        with fs.open_output_stream(f"{inner}/.{INDEX}") as out:
            out.write(json.dumps({"parts": named, "rows": sum(m.rows for m in done), "shape": self.shape, "dtype": self.dtype}).encode())
        fs.move(f"{inner}/.{INDEX}", f"{inner}/{INDEX}")
        self._clear(set(named))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(None)

    def _clear(self, kept: set[str] | None) -> None:
        """Takes away the parts of this run, and after a commit those of earlier ones too, but for ``kept``."""
        fs, inner = _store(self.path)
        for f in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
            ours = f.base_name.startswith(("part-", ".part-")) and (kept is not None or self.run in f.base_name)
            if ours and f.base_name not in (kept or ()):
                fs.delete_file(f.path)


def _row_type(shape: tuple[int, ...], dtype: str) -> str:
    kind = _KINDS[np.dtype(dtype).newbyteorder("=").name]
    for _ in shape:
        kind = f"array<{kind}>"
    return kind


class NpySource(DataSource):
    """``spark.read.format("npy").load(path)`` gives (pos, x): each row's place and its values."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        p = parts_of(self.options["path"])[0]
        return f"pos long, x {_row_type(p.shape, p.dtype)}"

    def reader(self, schema: T.StructType) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> NpyWriter:
        if len(schema) != 1:
            raise ValueError("an array is written from one column")
        shape = tuple(int(s) for s in self.options.get("shape", "").split(",") if s)
        kind, depth = schema[0].dataType, 0
        while isinstance(kind, T.ArrayType):
            kind, depth = kind.elementType, depth + 1
        if depth != len(shape):
            raise ValueError(f"shape {shape} for a column of {schema[0].dataType.simpleString()}")
        dtype = {v: k for k, v in _KINDS.items()}.get(kind.simpleString())
        if dtype is None:
            raise ValueError(f"no array of {kind.simpleString()}")
        return NpyWriter(self.options["path"], shape, self.options.get("dtype", dtype), overwrite)


def read_npy(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(pos, x) of a file or of a folder that ``write_npy`` made; a missing path raises."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("rangeBytes", range_bytes).load(path)


def write_npy(rows: DataFrame, path: str, value: str, order: list[str], shape: tuple[int, ...] = (), overwrite: bool = False) -> None:
    """The column ``value`` as an array, rows in the global order of ``order``; no rows: an array (0, *shape).

    ``shape`` is a row's: () for numbers, (150, 13) for sequences. Other lengths, nulls in the
    values and null rows raise, and then nothing is left.
    """
    rows.sparkSession.dataSource.register(NpySource)
    sorted_ = rows.orderBy(*order).select(F.col(value))
    sorted_.write.format("npy").mode("overwrite" if overwrite else "append").option("shape", ",".join(map(str, shape))).save(path)


def write_training_set(sequences: DataFrame, folder: str, shape: tuple[int, int], order: list[str], x: str = "x", label: str = "label_id") -> None:
    """``X`` and ``y`` of the same order below ``folder``; without rows, or where a row has no values, both are empty."""
    blank = sequences.where(F.col(x).isNull()).limit(1).count()
    rows = sequences.where(F.lit(not blank))
    write_npy(rows, f"{folder}/X.npy", x, order, shape, overwrite=True)
    write_npy(rows.select(*order, F.col(label).cast("long").alias("y")), f"{folder}/y.npy", "y", order, overwrite=True)


def numbered(rows: DataFrame, name: str = "pos") -> DataFrame:
    """Adds the rows' places, 0 and on, in the order in which they are read; only counts by partition meet."""
    shift = 33
    held = rows.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", shift))
    counts = {r["__part"]: r["count"] for r in held.groupBy("__part").count().collect()}
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part], total = total, total + counts[part]
    first = rows.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "__part long, __first long")
    place = F.col("__first") + F.col("__id").bitwiseAND(F.lit((1 << shift) - 1))
    # one row per partition of the input
    return held.join(F.broadcast(first), "__part").withColumn(name, place).drop("__id", "__part", "__first")


def training_set(spark: SparkSession, x_path: str, y_path: str, metadata_path: str, required: tuple[str, ...] = (), max_samples: int | None = None) -> DataFrame:
    """Arrays, labels and their metadata, row by row: pos, x, label_id and the metadata's columns.

    Missing files, other lengths, missing columns and labels that are null, not 0 to 2 or not
    those of the metadata raise. Metadata without ``is_high_confidence`` counts as high
    confidence. ``max_samples`` keeps the first so many, as a stated limit of a trial run.
    """
    lengths = {n: sum(p.rows for p in parts_of(p_)) for n, p_ in (("X", x_path), ("y", y_path))}
    meta = numbered(spark.read.csv(metadata_path, header=True, inferSchema=True))
    if missing := [c for c in ("label_id", *required) if c not in meta.columns]:
        raise ValueError(f"the metadata lacks {missing}")
    lengths["metadata"] = meta.count()
    if len(set(lengths.values())) > 1:
        raise ValueError(f"lengths differ: {lengths}")
    if "is_high_confidence" not in meta.columns:
        meta = meta.withColumn("is_high_confidence", F.lit(1))
    y = read_npy(spark, y_path).select("pos", F.col("x").alias("__y"))
    both = y.join(meta, "pos")
    odd = both.where(F.col("__y").isNull() | ~F.col("__y").isin(0, 1, 2) | F.col("label_id").isNull() | (F.col("label_id") != F.col("__y"))).limit(1).count()
    if odd:
        raise ValueError("labels are null, not 0 to 2 or not those of the metadata")
    whole = read_npy(spark, x_path).join(both.drop("__y"), "pos")
    return whole if max_samples is None else whole.where(F.col("pos") < max_samples)
