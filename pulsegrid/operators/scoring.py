"""Model scoring: image tensors by array functions, encoders over sequence arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import either, hierarchical


def image_tensor(pixels: Column, size: int, mean: list[float], std: list[float]) -> Column:
    """Interleaved bytes of an image as planes by channel, scaled; an image that is missing is black.

    Channels, mean and deviation come with the model and are not fixed here.
    """
    n = len(mean)
    known = F.coalesce(pixels, F.array_repeat(F.lit(0), size * size * n))
    plane = lambda c: F.transform(
        F.filter(known, lambda x, i: i % n == c), lambda x: ((x / 255.0 - mean[c]) / std[c]).cast("float")
    )
    return F.concat(*[plane(c) for c in range(n)])


def closed_probability(logits: Column, closed_index: int) -> Column:
    """One logit: a sigmoid; more: the softmax share of the closed class, whose index comes from the class map."""
    top = F.array_max(logits)
    parts = F.transform(logits, lambda x: F.exp(x - top))
    share = F.get(parts, closed_index) / F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(logits) == 1, 1.0 / (1.0 + F.exp(-F.get(logits, 0)))).otherwise(share)


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-a))


def gru(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """All states of one gated recurrent layer over a batch [n, t, d]; gates in the order reset, update, new."""
    h, out = np.zeros((len(x), w["hh"].shape[1]), np.float32), []
    inside = x @ w["ih"].T + w["bi"]
    for t in range(x.shape[1]):
        i_r, i_z, i_n = np.split(inside[:, t], 3, axis=1)
        h_r, h_z, h_n = np.split(h @ w["hh"].T + w["bh"], 3, axis=1)
        z = _sigmoid(i_z + h_z)
        h = (1 - z) * np.tanh(i_n + _sigmoid(i_r + h_r) * h_n) + z * h
        out.append(h)
    return np.stack(out, 1)


def lstm(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """All states of one long short-term memory layer; gates in the order input, forget, cell, output."""
    h = c = np.zeros((len(x), w["hh"].shape[1]), np.float32)
    out, inside = [], x @ w["ih"].T + w["bi"] + w["bh"]
    for t in range(x.shape[1]):
        i, f, g, o = np.split(inside[:, t] + h @ w["hh"].T, 4, axis=1)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h = _sigmoid(o) * np.tanh(c)
        out.append(h)
    return np.stack(out, 1)


def causal_convolution(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray, dilation: int) -> np.ndarray:
    """[n, t, d] by a kernel [out, d, k] that sees a frame and those before it, ``dilation`` apart."""
    k, t = kernel.shape[2], x.shape[1]
    padded = np.pad(x, ((0, 0), ((k - 1) * dilation, 0), (0, 0)))
    return sum(padded[:, j * dilation : j * dilation + t] @ kernel[:, :, j].T for j in range(k)) + bias


def tcn(x: np.ndarray, blocks: list[dict]) -> np.ndarray:
    """Temporal blocks with dilations 1, 2, 4, ...: two convolutions with normalised, rectified outputs, and a shortcut.

    A convolution holds kernel, bias and, from training, the batch mean, var, scale and
    shift; ``down`` is the shortcut's kernel where the width changes.
    """
    for level, block in enumerate(blocks):
        y = x
        for c in block["convolutions"]:
            y = causal_convolution(y, c["kernel"], c["bias"], 1 << level)
            y = np.maximum((y - c["mean"]) / np.sqrt(c["var"] + 1e-5) * c["scale"] + c["shift"], 0)
        down = block.get("down")
        x = np.maximum(y + (x if down is None else causal_convolution(x, down["kernel"], down["bias"], 1)), 0)
    return x


def two_levels(x: np.ndarray, lower: dict, upper: dict, size: int = 10) -> np.ndarray:
    """A memory over the last states of a memory over chunks of ``size`` frames, the last chunk filled with zeros."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % size), (0, 0)))
    n, t, d = x.shape
    ends = lstm(x.reshape(n * t // size, size, d), lower)[:, -1]
    return lstm(ends.reshape(n, t // size, -1), upper)


def encode(x: np.ndarray, weights: dict) -> np.ndarray:
    """The encoder's vectors [n, h] of sequences [n, t, d].

    ``weights`` names the ``encoder`` (gru by default, lstm, tcn or two_levels), its parameters, the
    ``pooling`` (last or mean; two_levels always takes the last) and, if the model has one,
    the layer norm's ``scale`` and ``shift``.
    """
    kind = weights.get("encoder", "gru")
    if kind in ("gru", "lstm"):
        for layer in weights["layers"]:
            x = (gru if kind == "gru" else lstm)(x, layer)
    elif kind == "tcn":
        x = tcn(x, weights["blocks"])
    elif kind == "two_levels":
        x = two_levels(x, weights["lower"], weights["upper"], weights.get("chunk", 10))
    else:
        raise ValueError(f"no such encoder: {kind}")
    pooling = "last" if kind == "two_levels" else weights.get("pooling", "last")
    if pooling not in ("last", "mean"):
        raise ValueError(f"no such pooling: {pooling}")
    h = x[:, -1] if pooling == "last" else x.mean(1)
    if "norm" in weights:
        h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5) * weights["norm"]["scale"] + weights["norm"]["shift"]
    return h


def score_sequences(tensors: DataFrame, weights: dict, column: str = "x", precision: type = np.float32) -> DataFrame:
    """Adds prob_0..2 from an encoder and two linear heads over arrays [t][d] of equal length.

    ``weights`` is that of ``encode`` with w and b of the heads "abnormal" and "stage": a
    model's size, whatever the table's. Missing and infinite values count as 0; values are
    read in ``precision``.
    """

    @F.pandas_udf("array<double>")
    def logits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in parts:
            x = np.nan_to_num(np.array([np.vstack(v) for v in xs], precision), posinf=0.0, neginf=0.0)
            h = encode(x, weights)
            both = [h @ weights[k]["w"].T + weights[k]["b"] for k in ("abnormal", "stage")]
            yield pd.Series(list(np.hstack(both).astype(np.float64)))

    rows = tensors.withColumn("__l", logits(column))
    p = hierarchical((F.get("__l", 0), F.get("__l", 1)), (F.get("__l", 2), F.get("__l", 3)))
    return rows.withColumns({f"prob_{c}": v for c, v in enumerate(p)}).drop("__l")


def scatter_sides(frames: DataFrame, scored: DataFrame) -> DataFrame:
    """Frames with p_left and p_right from scored crops (video_id, frame_idx, side, p), and p_closed, the mean of those there.

    Crops are scored in batches of any order; a frame and a side name their place.
    """
    sides = scored.groupBy("video_id", "frame_idx").agg(*[F.max(F.when(F.col("side") == s, F.col("p"))).alias(f"p_{s}") for s in ("left", "right")])
    return frames.join(sides, ["video_id", "frame_idx"], "left").withColumn("p_closed", either(F.col("p_left"), F.col("p_right")))
