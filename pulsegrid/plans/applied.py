"""Registered queries, with their SQL, of arrays in files, models, heads, splits as a whole and table functions."""

from __future__ import annotations

import io
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import linear_model, metrics, models, scoring, signals, splits, table_functions, training
from pulsegrid.plans import frames as P
from pulsegrid.plans import oracles as O
from pulsegrid.plans import queries as Q
from pulsegrid.sources import npy, resumable, tables
from pulsegrid.sources.store import fresh_dir

DIMENSIONS = 64


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.read(spark, d, "embeddings").where((F.size("embedding") == DIMENSIONS) & F.forall("embedding", lambda x: x.isNotNull()))
    return rows.select("vec_id", "embedding", (F.col("label") % 3).cast("int").alias("label_id"))


def q_npy_round_trip(spark, d):
    """Vectors and labels written as arrays in files and read back, row by row."""
    folder = fresh_dir(spark, "arrays")
    npy.write_training_set(_vectors(spark, d), folder, (DIMENSIONS,), ["vec_id"], x="embedding")
    rows = npy.read_npy(spark, f"{folder}/X.npy").join(npy.read_npy(spark, f"{folder}/y.npy").withColumnRenamed("x", "label_id"), "pos")
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return rows.select("pos", "label_id", F.size("x").cast("long").alias("n"), F.round(F.get("x", 0).cast("double"), 6).alias("first"), F.round(total, 4).alias("total"))


def _weight(i: int) -> float:
    """The fixture's weights, by a rule that SQL has too."""
    return (i * 37 % 64 - 32) / 64


def q_model_by_path(spark, d):
    """Every vector scored by a model class from a file with weights from another."""
    raw = io.BytesIO()
    np.savez(raw, **{"model_state_dict/module.w": np.array([[_weight(i) for i in range(DIMENSIONS)]]), "model_state_dict/module.b": np.array([0.25])})
    path = f"{fresh_dir(spark, 'weights')}.npz"
    fs, inner = npy._store(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(inner) as f:
        f.write(raw.getvalue())
    spec = models.ModelSpec(str(Path(linear_model.__file__)), "LinearHead", path, {"inputs": DIMENSIONS})
    return models.apply_model(_vectors(spark, d), spec, "embedding").select("vec_id", F.round(F.get("p", 0), 6).alias("p"))


#: The fixture's encoders: eight steps of eight values, two states.
STEPS, INPUTS, STATES = 8, 8, 2


def _table(start: int, *shape: int) -> np.ndarray:
    return np.array([_weight(start + i) for i in range(int(np.prod(shape)))]).reshape(shape)


def _encoder(kind: str, gates: int) -> dict:
    """Weights of one layer and both heads, by the rule of ``_weight`` from a start for each."""
    table = _table
    rows = gates * STATES
    layer = {"ih": table(1, rows, INPUTS), "hh": table(5, rows, STATES), "bi": table(9, rows), "bh": table(13, rows)}
    heads = {"abnormal": {"w": table(17, 2, STATES), "b": table(21, 2)}, "stage": {"w": table(25, 2, STATES), "b": table(29, 2)}}
    return {"encoder": kind, "layers": [layer], **heads}


def _convolutions() -> dict:
    """One temporal block of two convolutions over three steps with a shortcut, averaged over the steps."""
    norm = lambda start: {"mean": _table(start, STATES), "var": 1 + _table(start + 2, STATES), "scale": 1 + _table(start + 4, STATES), "shift": _table(start + 6, STATES)}
    both = [{"kernel": _table(start, STATES, inputs, 3), "bias": _table(start + 3, STATES), **norm(start + 5)} for start, inputs in ((33, INPUTS), (37, STATES))]
    block = {"convolutions": both, "down": {"kernel": _table(41, STATES, INPUTS, 1), "bias": _table(45, STATES)}}
    return _encoder("gru", 3) | {"encoder": "tcn", "blocks": [block], "pooling": "mean"}


def _encoded(spark, d, weights: dict) -> DataFrame:
    steps = F.array(*[F.slice(F.col("embedding").cast("array<double>"), 1 + INPUTS * t, INPUTS) for t in range(STEPS)])
    scored = scoring.score_sequences(_vectors(spark, d).select("vec_id", steps.alias("x")), weights, precision=np.float64)
    return scored.select("vec_id", *Q.r6("prob_0", "prob_1", "prob_2"))


def q_encoder_gru(spark, d):
    """Every vector as a sequence through a gated recurrent layer and both heads."""
    return _encoded(spark, d, _encoder("gru", 3))


def q_encoder_lstm(spark, d):
    """Every vector as a sequence through a long short-term memory layer and both heads."""
    return _encoded(spark, d, _encoder("lstm", 4))


def q_encoder_tcn(spark, d):
    """Every vector as a sequence through a block of causal convolutions and both heads."""
    return _encoded(spark, d, _convolutions())


def q_trained_heads(spark, d):
    """Both heads trained on the vectors, with their classes' weights and smoothed labels, as one row per weight."""
    rows = _vectors(spark, d)
    heads = training.fit_heads(rows, "embedding", "label_id", (1.5, 0.75), (1.0, 1.0), smoothing=0.05, ridge=0.01)
    told = [(name, i, float(w)) for name, fit in zip(("abnormal", "stage"), heads) for i, w in enumerate([*fit.weights, fit.bias])]
    return spark.createDataFrame(told, "head string, feature int, weight double").select("head", "feature", F.round("weight", 5).alias("weight"))


def _meta(spark, d):
    return Q._documents_meta(spark, d).withColumn("is_high_confidence", (F.col("doc_id") % 3 != 0).cast("int"))


def q_fold_split_whole(spark, d):
    """Train and validation from eligible rows, the whole test fold; one group only, so the split is by class."""
    one = _meta(spark, d).withColumn("one", F.lit("g"))
    return splits.fold_split(one, "Fold2", "doc_id", group="one", hashed=splits.portable_hash("doc_id")).select("doc_id", "split")


def q_final_split(spark, d):
    """All eligible rows by class."""
    one = _meta(spark, d).withColumn("one", F.lit("g"))
    return splits.final_split(one, "doc_id", group="one", hashed=splits.portable_hash("doc_id", 1041)).select("doc_id", "split")


def q_best_epoch_min(spark, d):
    """Early stopping on a value that should fall."""
    return metrics.best_epoch(Q._epochs(spark, d), "v", mode="min").select("series", "best_epoch", "best_value", "stopped_at")


def q_blink_function(spark, d):
    """Blink events by the table function over each video's rows in order."""
    events = table_functions.blink_events(signals.closed_state(P.fixture_norm(spark, d)[2]))
    real = ("start_time", "end_time", "min_time", "duration_sec", "frequency", "p_closed_max")
    ear = ("amplitude", "opening_velocity", "ear_z_start", "ear_z_min", "ear_z_end")
    return events.select("video_id", F.col("blink_id").cast("int").alias("blink_id"), "start_idx", "end_idx", "min_idx", "duration", *Q.r6(*real), *[F.round(c, 3).alias(c) for c in ear])


def q_resumed_table(spark, d):
    """Frames of every video through the resumable table, in two runs, the second with the videos that the first had not."""
    frames, folder = tables.frames(spark, d).select("video_id", "processed_idx", "mean_ear"), fresh_dir(spark, "resumable")
    videos = tables.videos(tables.frames(spark, d)).select("video_id")
    compute = lambda own: frames.join(own, "video_id")
    resumable.write_resumable(videos.where("video_id < 'V00020'"), compute, folder, 2)
    resumable.write_resumable(videos, compute, folder, 2)
    return resumable.read_resumable(spark, folder, frames.schema).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.count("mean_ear").alias("n_seen"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

_KEPT = f"SELECT vec_id, embedding AS e, CAST(label % 3 AS INT) AS label_id FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL)) = {DIMENSIONS}"
_DOUBLES = "list_transform(e, lambda x: CAST(x AS DOUBLE))"
_WEIGHTS = f"list_transform(range(0, {DIMENSIONS}), lambda i: CAST(i * 37 % 64 - 32 AS DOUBLE) / CAST(64 AS DOUBLE))"


def _by_class(rows: str, seed: int) -> str:
    return f"""SELECT doc_id, CASE WHEN n > 1 AND k <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS split
      FROM (SELECT doc_id, count(*) OVER (PARTITION BY label_id) AS n, row_number() OVER (PARTITION BY label_id ORDER BY substr(md5(concat('{seed}:', doc_id)), 1, 15), doc_id) AS k FROM ({rows}))"""


def _group_split(groups: int, ratio: float = 0.2, seed: int = 42) -> str:
    """The definition over the candidates that the seeded generator draws for so many groups."""
    rng, size = np.random.default_rng(seed), min(max(1, round(groups * ratio)), groups - 1)
    draws = [(t, i) for t in range(min(1000, max(100, 20 * groups))) for i in rng.choice(groups, size=size, replace=False).tolist()]
    n = [f"n{c}" for c in range(3)]
    whole, side = "(" + " + ".join(f"w.{c}" for c in n) + ")", "(" + " + ".join(f"v.{c}" for c in n) + ")"
    off = " + ".join(f"abs(v.{c} / {side} - w.{c} / {whole})" for c in n)
    lacking = " + ".join(f"CAST(v.{c} = 0 AS INT) + CAST(w.{c} = v.{c} AS INT)" for c in n)
    return O.with_(
        O.META,
        ("g", "SELECT subject_id, row_number() OVER (ORDER BY subject_id) - 1 AS i, " + ", ".join(f"CAST(count(*) FILTER (label_id = {c}) AS DOUBLE) AS n{c}" for c in range(3)) + " FROM meta GROUP BY 1"),
        ("draws", "SELECT * FROM (VALUES " + ", ".join(f"({t}, {i})" for t, i in draws) + ") AS x(t, i)"),
        ("w", "SELECT " + ", ".join(f"sum({c}) AS {c}" for c in n) + " FROM g"),
        ("v", "SELECT t, " + ", ".join(f"sum({c}) AS {c}" for c in n) + " FROM draws JOIN g ON g.i = draws.i GROUP BY t"),
        ("best", f"SELECT t FROM v, w WHERE {side} > 0 AND {whole} > {side} ORDER BY {off} + 10.0::DOUBLE * ({lacking}), t LIMIT 1"),
        ("chosen", "SELECT g.subject_id FROM draws JOIN best ON best.t = draws.t JOIN g ON g.i = draws.i"),
        select="SELECT doc_id, subject_id, CASE WHEN subject_id IN (SELECT subject_id FROM chosen) THEN 'val' ELSE 'train' END AS split FROM meta",
    )


_FINITE = f"k AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN isfinite(CAST(x AS DOUBLE)) THEN CAST(x AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS x FROM ({_KEPT}))"


def _number(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def _logistic(v: str) -> str:
    return f"(1 / (1 + exp(-({v}))))"


def _heads_sql(w: dict, states: str) -> str:
    """The three probabilities from the states h0, h1, ... of a query."""
    logit = lambda head, c: " + ".join([f"{_number(v)} * h{k}" for k, v in enumerate(w[head]["w"][c])] + [_number(w[head]["b"][c])])
    second = lambda head: _logistic(f"({logit(head, 1)}) - ({logit(head, 0)})")
    return f"""SELECT vec_id, round(1 - a, 6) AS prob_0, round(a * (1 - g), 6) AS prob_1, round(a * g, 6) AS prob_2
      FROM (SELECT vec_id, {second('abnormal')} AS a, {second('stage')} AS g FROM ({states}))"""


def _encoder_sql(kind: str, gates: int) -> str:
    """The layer as a recursive query, one step of every sequence a round."""
    w = _encoder(kind, gates)
    layer, number, logistic = w["layers"][0], _number, _logistic
    states = range(STATES)
    inner = [f"list_dot_product(x[{INPUTS} * t + 1 : {INPUTS} * t + {INPUTS}], [{', '.join(map(number, row))}]) + {number(b)}" for row, b in zip(layer["ih"], layer["bi"])]
    outer = [" + ".join([f"{number(v)} * h{k}" for k, v in enumerate(row)] + [number(b)]) for row, b in zip(layer["hh"], layer["bh"])]
    sums = ", ".join([f"{v} AS i{g}" for g, v in enumerate(inner)] + [f"{v} AS o{g}" for g, v in enumerate(outer)])
    gate = lambda g, j: logistic(f"i{g * STATES + j} + o{g * STATES + j}")
    if kind == "gru":
        new = [f"tanh(i{2 * STATES + j} + {gate(0, j)} * o{2 * STATES + j})" for j in states]
        kept, after = [], [f"(1 - {gate(1, j)}) * {new[j]} + {gate(1, j)} * h{j}" for j in states]
    else:
        kept = [f"{gate(1, j)} * c{j} + {gate(0, j)} * tanh(i{2 * STATES + j} + o{2 * STATES + j})" for j in states]
        after = [f"{gate(3, j)} * tanh({kept[j]})" for j in states]
    held = [f"h{j}" for j in states] + [f"c{j}" for j in range(len(kept))]
    moved = ", ".join(f"{v} AS {n}" for v, n in zip(after + kept, held))
    return f"""WITH RECURSIVE {_FINITE},
      s AS (SELECT vec_id, x, 0 AS t, {', '.join(f'CAST(0 AS DOUBLE) AS {n}' for n in held)} FROM k
        UNION ALL SELECT vec_id, x, t + 1 AS t, {moved} FROM (SELECT *, {sums} FROM s WHERE t < {STEPS}))
      {_heads_sql(w, f"SELECT * FROM s WHERE t = {STEPS}")}"""


def _tcn_sql() -> str:
    """The block as windows over the steps: earlier steps are lagged rows, zeros before the first."""
    w = _convolutions()
    block = w["blocks"][0]

    def layer(c: dict, name: str) -> str:
        n, out = c["kernel"].shape[1], []
        zeros = f"[{', '.join(['CAST(0 AS DOUBLE)'] * n)}]"
        for j in range(STATES):
            taps = [f"list_dot_product(coalesce(lag({name}, {2 - k}) OVER w, {zeros}), [{', '.join(map(_number, c['kernel'][j, :, k]))}])" for k in range(3)]
            normed = f"({' + '.join(taps)} + {_number(c['bias'][j])} - {_number(c['mean'][j])}) / sqrt({_number(c['var'][j])} + 1e-5::DOUBLE)"
            out.append(f"greatest({normed} * {_number(c['scale'][j])} + {_number(c['shift'][j])}, CAST(0 AS DOUBLE))")
        return f"[{', '.join(out)}]"

    first, second = block["convolutions"]
    down = [f"list_dot_product(v, [{', '.join(map(_number, block['down']['kernel'][j, :, 0]))}]) + {_number(block['down']['bias'][j])}" for j in range(STATES)]
    ends = ", ".join(f"avg(greatest(z[{j + 1}] + {down[j]}, CAST(0 AS DOUBLE))) AS h{j}" for j in range(STATES))
    order = "WINDOW w AS (PARTITION BY vec_id ORDER BY t)"
    return f"""WITH {_FINITE}, s AS (SELECT vec_id, t, x[{INPUTS} * t + 1 : {INPUTS} * t + {INPUTS}] AS v FROM k, (SELECT unnest(range(0, {STEPS})) AS t)),
      y AS (SELECT *, {layer(first, 'v')} AS y FROM s {order}), z AS (SELECT *, {layer(second, 'y')} AS z FROM y {order})
      {_heads_sql(w, f"SELECT vec_id, {ends} FROM z GROUP BY 1")}"""


#: The sources of the given tables are so many groups.
GROUPS = 20
ORACLES = {
    "q_npy_round_trip": f"""SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, CAST(label_id AS BIGINT) AS label_id, len(e) AS n, round(CAST(e[1] AS DOUBLE), 6) AS first,
      round(list_sum({_DOUBLES}), 4) AS total FROM ({_KEPT})""",
    "q_model_by_path": f"SELECT vec_id, round(1 / (1 + exp(-(list_dot_product({_DOUBLES}, {_WEIGHTS}) + 0.25::DOUBLE))), 6) AS p FROM ({_KEPT})",
    "q_encoder_gru": _encoder_sql("gru", 3),
    "q_encoder_tcn": _tcn_sql(),
    "q_encoder_lstm": _encoder_sql("lstm", 4),
    "q_fold_split_whole": O.with_(O.META, select=f"SELECT doc_id, 'test' AS split FROM meta WHERE fold = 'Fold2' UNION ALL {_by_class('SELECT * FROM meta WHERE fold <> ' + chr(39) + 'Fold2' + chr(39) + ' AND doc_id % 3 <> 0', 42)}"),
    "q_final_split": O.with_(O.META, select=_by_class("SELECT * FROM meta WHERE doc_id % 3 <> 0", 1041)),
    "q_best_epoch_min": O.ORACLES["q_best_epoch"].replace("'-inf'::DOUBLE AS best_value", "'inf'::DOUBLE AS best_value").replace("v > best_value + 1e-4::DOUBLE", "v < best_value - 1e-4::DOUBLE"),
    "q_blink_function": O.ORACLES["q_blink_events"],
    "q_resumed_table": O.with_(O.F, select="SELECT video_id, count(*) AS n, count(mean_ear) AS n_seen FROM frames GROUP BY 1"),
    "q_group_split": _group_split(GROUPS),
}
