import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import scoring


def test_image_tensor(spark):
    df = spark.createDataFrame([([0, 255, 51, 102, 0, 255, 0, 0],), (None,)], "p array<int>")
    got = [list(r[0]) for r in df.select(scoring.image_tensor(F.col("p"), 2, [0.5, 0.0], [0.5, 1.0])).collect()]
    assert got[0] == pytest.approx([-1.0, -0.6, -1.0, -1.0, 1.0, 0.4, 1.0, 0.0])
    assert got[1] == pytest.approx([-1.0] * 4 + [0.0] * 4)


def test_closed_probability(spark):
    df = spark.createDataFrame([([0.0],), ([1.0, 1.0],), ([0.0, float(np.log(3.0))],)], "l array<double>")
    assert [r[0] for r in df.select(scoring.closed_probability(F.col("l"), 1)).collect()] == pytest.approx([0.5, 0.5, 0.75])


def test_scores(spark):
    rng = np.random.default_rng(4)
    layer = {k: rng.normal(size=s).astype(np.float32) for k, s in (("ih", (12, 3)), ("hh", (12, 4)), ("bi", (12,)), ("bh", (12,)))}
    heads = {k: {"w": rng.normal(size=(2, 4)).astype(np.float32), "b": np.zeros(2, np.float32)} for k in ("abnormal", "stage")}
    x = rng.normal(size=(5, 7, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, x array<array<float>>")
    got = {r["k"]: [r[f"prob_{c}"] for c in range(3)] for r in scoring.score_sequences(df, {"layers": [layer], **heads}).collect()}
    for i, v in enumerate(x):
        h = np.zeros(4)
        for row in v:
            a, b = layer["ih"] @ row + layer["bi"], layer["hh"] @ h + layer["bh"]
            r, z = 1 / (1 + np.exp(-(a[:4] + b[:4]))), 1 / (1 + np.exp(-(a[4:8] + b[4:8])))
            h = (1 - z) * np.tanh(a[8:] + r * b[8:]) + z * h
        la, ls = heads["abnormal"]["w"] @ h, heads["stage"]["w"] @ h
        pa, ps = np.exp(la) / np.exp(la).sum(), np.exp(ls) / np.exp(ls).sum()
        assert got[i] == pytest.approx([pa[0], pa[1] * ps[0], pa[1] * ps[1]], abs=1e-5)


def slow_lstm(rows, w):
    n = w["hh"].shape[1]
    h, c, out = np.zeros(n), np.zeros(n), []
    sig = lambda a: 1 / (1 + np.exp(-a))
    for row in rows:
        a = w["ih"] @ row + w["bi"] + w["hh"] @ h + w["bh"]
        c = sig(a[n : 2 * n]) * c + sig(a[:n]) * np.tanh(a[2 * n : 3 * n])
        h = sig(a[3 * n :]) * np.tanh(c)
        out.append(h)
    return np.array(out)


def lstm_layer(rng, d, h):
    return {k: rng.normal(size=s).astype(np.float32) for k, s in (("ih", (4 * h, d)), ("hh", (4 * h, h)), ("bi", (4 * h,)), ("bh", (4 * h,)))}


def normed(h, norm):
    return (h - h.mean()) / np.sqrt(h.var() + 1e-5) * norm["scale"] + norm["shift"]


@pytest.mark.parametrize("pooling", ["last", "mean"])
def test_lstm_of_two_layers_with_layer_norm(pooling):
    rng = np.random.default_rng(1)
    layers = [lstm_layer(rng, 3, 5), lstm_layer(rng, 5, 5)]
    norm = {"scale": rng.normal(size=5), "shift": rng.normal(size=5)}
    x = rng.normal(size=(4, 9, 3)).astype(np.float32)
    got = scoring.encode(x, {"encoder": "lstm", "layers": layers, "pooling": pooling, "norm": norm})
    for v, g in zip(x, got):
        out = slow_lstm(slow_lstm(v, layers[0]), layers[1])
        assert g == pytest.approx(normed(out[-1] if pooling == "last" else out.mean(0), norm), abs=1e-4)


def test_two_levels_pads_the_last_chunk():
    rng = np.random.default_rng(2)
    lower, upper = lstm_layer(rng, 3, 4), lstm_layer(rng, 4, 6)
    x = rng.normal(size=(2, 7, 3)).astype(np.float32)
    got = scoring.encode(x, {"encoder": "two_levels", "lower": lower, "upper": upper, "chunk": 3})
    for v, g in zip(x, got):
        whole = np.vstack([v, np.zeros((2, 3))])
        ends = [slow_lstm(whole[i : i + 3], lower)[-1] for i in (0, 3, 6)]
        assert g == pytest.approx(slow_lstm(ends, upper)[-1], abs=1e-5)


def test_tcn_sees_only_the_past():
    rng = np.random.default_rng(3)

    def convolution(i, o):
        return {"kernel": rng.normal(size=(o, i, 3)), "bias": rng.normal(size=o), "mean": rng.normal(size=o), "var": rng.uniform(0.5, 2, o), "scale": rng.normal(size=o), "shift": rng.normal(size=o)}

    blocks = [
        {"convolutions": [convolution(2, 4), convolution(4, 4)], "down": {"kernel": rng.normal(size=(4, 2, 1)), "bias": rng.normal(size=4)}},
        {"convolutions": [convolution(4, 4), convolution(4, 4)]},
    ]
    x = rng.normal(size=(3, 11, 2))
    got = scoring.encode(x, {"encoder": "tcn", "blocks": blocks, "pooling": "mean"})
    for v, g in zip(x, got):
        rows = v
        for level, block in enumerate(blocks):
            y = rows
            for c in block["convolutions"]:
                out = np.zeros((len(y), len(c["bias"])))
                for t in range(len(y)):
                    for j in range(3):
                        at = t - (2 - j) * 2**level
                        if at >= 0:
                            out[t] += c["kernel"][:, :, j] @ y[at]
                y = np.maximum((out + c["bias"] - c["mean"]) / np.sqrt(c["var"] + 1e-5) * c["scale"] + c["shift"], 0)
            short = rows @ block["down"]["kernel"][:, :, 0].T + block["down"]["bias"] if "down" in block else rows
            rows = np.maximum(y + short, 0)
        assert g == pytest.approx(rows.mean(0))


def test_unknown_encoders_and_poolings():
    for weights in ({"encoder": "other"}, {"encoder": "lstm", "layers": [], "pooling": "most"}):
        with pytest.raises(ValueError):
            scoring.encode(np.zeros((1, 2, 3)), weights)


def test_sides_are_scattered_back(spark):
    frames = spark.createDataFrame([("V", 0), ("V", 2), ("V", 4)], "video_id string, frame_idx int")
    scored = spark.createDataFrame([("V", 2, "right", 0.5), ("V", 0, "right", 0.25), ("V", 0, "left", 0.75)], "video_id string, frame_idx int, side string, p double")
    got = {r["frame_idx"]: (r["p_left"], r["p_right"], r["p_closed"]) for r in scoring.scatter_sides(frames, scored).collect()}
    assert got == {0: (0.75, 0.25, 0.5), 2: (None, 0.5, 0.5), 4: (None, None, None)}
