"""Models given by a code file, a class name and a weights file, applied in batches of fixed size.

Code and weights travel once to each executor as files of the session; a Python worker
builds the model when it first needs it and keeps it for its later tasks. Rows are cut anew
into batches of ``batch`` rows, across the Arrow batches in which they come, and each
row keeps its columns, so results need no join back to their places.
"""

from __future__ import annotations

import importlib.util
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys under which a checkpoint may hold its weights, in the order of preference.
STATE_KEYS = ("model_state_dict", "state_dict", "model", "net")
PREFIX = "module."


@dataclass(frozen=True)
class ModelSpec:
    """Where a model lies. Its class is built with ``arguments``; it has ``load_state(weights)``,
    ``state_names`` (names that it needs) and, called with an array of rows, gives an array of as many."""

    code: str
    class_name: str
    weights: str
    arguments: dict[str, Any] = field(default_factory=dict)
    state_keys: tuple[str, ...] = STATE_KEYS
    strict: bool = True

    def shipped(self, spark: SparkSession) -> "ModelSpec":
        """The same with the names that the files have on every executor."""
        for path in (self.code, self.weights):
            spark.sparkContext.addFile(path)
        name = lambda p: p.rsplit("/", 1)[-1]
        return ModelSpec(name(self.code), self.class_name, name(self.weights), self.arguments, self.state_keys, self.strict)

    def key(self) -> str:
        return json.dumps([self.code, self.class_name, self.weights, self.arguments, self.state_keys, self.strict], sort_keys=True)


def read_checkpoint(raw: bytes) -> dict[str, Any]:
    """An ``.npz`` file as a dictionary; a slash in a name opens a dictionary within."""
    out: dict[str, Any] = {}
    with np.load(io.BytesIO(raw), allow_pickle=False) as held:
        for name in held.files:
            *path, last = name.split("/")
            at = out
            for p in path:
                at = at.setdefault(p, {})
            at[last] = held[name]
    return out


def find_state(checkpoint: dict[str, Any], keys: tuple[str, ...] = STATE_KEYS) -> dict[str, np.ndarray]:
    """The weights: the dictionary under the first candidate key that has one, else the checkpoint itself if it holds only arrays.

    Names lose the prefix of a parallel wrapper.
    """
    found = next((checkpoint[k] for k in keys if isinstance(checkpoint.get(k), dict)), checkpoint)
    if not found or not all(hasattr(v, "shape") for v in found.values()):
        raise ValueError(f"no weights under {list(keys)}, and the checkpoint holds more than arrays: {sorted(checkpoint)}")
    return {n.removeprefix(PREFIX): v for n, v in found.items()}


def build(spec: ModelSpec, code_path: str, weights: bytes) -> Any:
    """The model with its weights; unknown classes raise, and so do missing or surplus weights if ``strict``."""
    found = importlib.util.spec_from_file_location(f"model_{abs(hash(code_path))}", code_path)
    if found is None or found.loader is None:
        raise ValueError(f"{code_path} is no Python file")
    module = importlib.util.module_from_spec(found)
    found.loader.exec_module(module)
    if not hasattr(module, spec.class_name):
        raise ValueError(f"{code_path} has no class {spec.class_name}")
    model = getattr(module, spec.class_name)(**spec.arguments)
    state = find_state(read_checkpoint(weights), spec.state_keys)
    needed = set(model.state_names)
    if spec.strict and set(state) != needed:
        raise ValueError(f"weights missing: {sorted(needed - set(state))}, not asked for: {sorted(set(state) - needed)}")
    model.load_state({n: v for n, v in state.items() if n in needed})
    return model


_BUILT: dict[str, Any] = {}


def in_worker(spec: ModelSpec) -> Any:
    """The worker's model, built once."""
    if (key := spec.key()) not in _BUILT:
        with open(SparkFiles.get(spec.weights), "rb") as f:
            weights = f.read()
        _BUILT[key] = build(spec, SparkFiles.get(spec.code), weights)
    return _BUILT[key]


def rebatched(frames: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The same rows in order as tables of ``size`` rows and one rest."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for frame in frames:
        while frame.num_rows:
            taken = frame.slice(0, size - rows)
            held.append(taken)
            rows, frame = rows + taken.num_rows, frame.slice(taken.num_rows)
            if rows == size:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _values(column: pa.ChunkedArray) -> np.ndarray:
    """Nested lists of equal lengths as one array."""
    a, shape = column.combine_chunks(), []
    while pa.types.is_list(a.type):
        sizes = np.unique(a.value_lengths().to_numpy(zero_copy_only=False))
        if len(sizes) != 1:
            raise ValueError(f"rows of one model differ in shape: {sizes.tolist()}")
        shape.append(int(sizes[0]))
        a = a.flatten()
    return a.to_numpy(zero_copy_only=False).reshape(len(column), *shape)


def apply_model(rows: DataFrame, spec: ModelSpec, column: str, name: str = "p", batch: int = 64) -> DataFrame:
    """Adds ``name``, array<double>, the model's row of results for each value of ``column``.

    A row without a value gets none and is in no batch. Every batch but a partition's last
    has ``batch`` rows with a value. Rows of other shapes than the first of their batch raise.
    """
    spec_ = spec.shipped(rows.sparkSession)
    schema = rows.withColumn(name, F.lit(None).cast("array<double>")).schema
    at = rows.columns.index(column)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank: list[pa.RecordBatch] = []

        def valued() -> Iterator[pa.RecordBatch]:
            for f in frames:
                there = f.column(at).is_valid()
                if there.false_count:
                    blank.append(f.filter(pa.compute.invert(there)))
                yield f.filter(there)

        def with_column(t: pa.Table, p: pa.Array) -> Iterator[pa.RecordBatch]:
            return iter(t.append_column(name, p).combine_chunks().to_batches())

        for table in rebatched(valued(), batch):
            p = np.asarray(in_worker(spec_)(_values(table.column(at))), np.float64).reshape(table.num_rows, -1)
            yield from with_column(table, pa.array(list(p), pa.list_(pa.float64())))
            while blank:
                b = blank.pop()
                yield from with_column(pa.Table.from_batches([b]), pa.nulls(b.num_rows, pa.list_(pa.float64())))
        for b in blank:
            yield from with_column(pa.Table.from_batches([b]), pa.nulls(b.num_rows, pa.list_(pa.float64())))

    return rows.mapInArrow(run, schema)
