"""Models by path, fixed batches and trained heads against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import linear_model, models, training

CODE = '''
import os
class Recorder:
    state_names = ("scale",)
    built = 0
    def __init__(self, folder, shift=0.0):
        self.folder, self.shift = folder, shift
        open(os.path.join(folder, f"built-{os.getpid()}-{id(self)}"), "w").close()
    def load_state(self, state):
        self.scale = float(state["scale"])
    def __call__(self, x):
        with open(os.path.join(self.folder, f"sizes-{os.getpid()}"), "a") as f:
            f.write(f"{len(x)}\\n")
        return x.reshape(len(x), -1).sum(1) * self.scale + self.shift
'''


@pytest.fixture
def recorder(tmp_path):
    """A model class in a file of its own name, with its weights below a candidate key and a wrapper's prefix."""
    name = tmp_path.name.replace("-", "_")
    (tmp_path / f"code_{name}.py").write_text(CODE)
    np.savez(tmp_path / f"weights_{name}.npz", **{"state_dict/module.scale": np.float64(2.0), "epoch": np.int64(3)})
    (tmp_path / "out").mkdir()
    return models.ModelSpec(str(tmp_path / f"code_{name}.py"), "Recorder", str(tmp_path / f"weights_{name}.npz"), {"folder": str(tmp_path / "out"), "shift": 1.0}), tmp_path / "out"


def test_rows_come_in_batches_of_64_and_one_rest(spark, recorder):
    spec, out = recorder
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        rows = [(i, None if i % 10 == 3 else [[float(i), 1.0], [0.5, float(-i)]], f"k{i}") for i in range(333)]
        df = spark.createDataFrame(rows, "id long, x array<array<float>>, p_name string").coalesce(1)
        got = models.apply_model(df, spec, "x").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.id for r in got) == list(range(333)) and all(r.p_name == f"k{r.id}" for r in got)
    assert all(r.p is None if r.id % 10 == 3 else r.p == [2 * 1.5 + 1] for r in got)
    sizes = [int(n) for f in out.glob("sizes-*") for n in f.read_text().split()]
    valued = sum(i % 10 != 3 for i in range(333))
    assert sorted(sizes, reverse=True) == [64] * (valued // 64) + [valued % 64]


def test_a_worker_builds_its_model_once(spark, recorder):
    spec, out = recorder
    df = spark.range(400).select("id", F.array(F.col("id").cast("float")).alias("x")).repartition(16)
    for _ in range(2):
        assert sorted(r.p[0] for r in models.apply_model(df, spec, "x").collect()) == [2.0 * i + 1 for i in range(400)]
    built = [f.name.split("-")[1] for f in out.glob("built-*")]
    assert built and len(built) == len(set(built)) < 16


def test_no_rows_and_other_shapes(spark, recorder):
    spec, _ = recorder
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, x array<float>").coalesce(1)
    assert models.apply_model(df.where("id > 5"), spec, "x").count() == 0
    with pytest.raises(Exception, match="differ in shape"):
        models.apply_model(df, spec, "x").collect()


def test_state_by_candidate_keys():
    a, b = np.ones(2), np.zeros(3)
    assert models.find_state({"state_dict": {"module.w": a, "module.b.module.c": b}, "model": {"w": b}}, ("absent", "state_dict")) == {"w": a, "b.module.c": b}
    assert models.find_state({"model": {"w": b}, "state_dict": {"w": a}}, ("model", "state_dict"))["w"] is b
    assert models.find_state({"w": a}, ("model",))["w"] is a
    for odd in ({}, {"w": a, "epoch": 3}, {"optimizer": {"w": a}}):
        with pytest.raises(ValueError):
            models.find_state(odd)


@pytest.mark.parametrize(("change", "said"), [({"class_name": "Other"}, "no class"), ({"state_keys": ("absent",)}, "no weights"), ({}, None)])
def test_what_does_not_fit_raises(recorder, change, said):
    spec, _ = recorder
    odd = models.ModelSpec(**{**spec.__dict__, **change})
    raw = open(spec.weights, "rb").read()
    if said is None:
        assert models.build(odd, spec.code, raw).scale == 2.0
    else:
        with pytest.raises(ValueError, match=said):
            models.build(odd, spec.code, raw)


def test_strict_weights(tmp_path):
    np.savez(tmp_path / "w.npz", w=np.ones((1, 3)), b=np.zeros(1), more=np.ones(1))
    raw = (tmp_path / "w.npz").read_bytes()
    spec = models.ModelSpec("", "LinearHead", "", {"inputs": 3})
    with pytest.raises(ValueError, match="not asked for"):
        models.build(spec, linear_model.__file__, raw)
    loose = models.build(models.ModelSpec("", "LinearHead", "", {"inputs": 3}, strict=False), linear_model.__file__, raw)
    assert np.allclose(loose(np.zeros((2, 3))), 0.5)
    with pytest.raises(ValueError, match="shape"):
        models.build(models.ModelSpec("", "LinearHead", "", {"inputs": 4}, strict=False), linear_model.__file__, raw)


# --- training ---


def table(n=600, d=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    label = np.digitize(x @ rng.normal(size=d) + rng.normal(size=n), [-0.3, 0.8])
    return x, label


def numpy_fit(x, y, weights, smoothing, ridge):
    """The same loss by plain gradient descent on all rows."""
    one, theta = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    w = np.where(y == 1, weights[1], weights[0]) / np.where(y == 1, weights[1], weights[0]).sum()
    target = y * (1 - smoothing) + smoothing / 2
    for _ in range(20000):
        p = 1 / (1 + np.exp(-one @ theta))
        theta -= 2.0 * (one.T @ (w * (p - target)) + np.r_[np.full(x.shape[1], ridge), 0] * theta)
    return theta


@pytest.mark.parametrize(("weights", "smoothing"), [((1.0, 1.0), 0.0), ((0.7, 2.0), 0.1)])
def test_heads_equal_a_numpy_fit(spark, weights, smoothing):
    x, label = table()
    rows = [(r.tolist(), int(c)) for r, c in zip(x, label)] + [(None, 1), ([0.0] * 5, None)]
    df = spark.createDataFrame(rows, "x array<double>, label_id int").repartition(3)
    heads = training.fit_heads(df, "x", "label_id", weights, weights, smoothing, 0.01)
    wants = [numpy_fit(x, (label > 0) * 1.0, weights, smoothing, 0.01), numpy_fit(x[label > 0], (label[label > 0] == 2) * 1.0, weights, smoothing, 0.01)]
    for fit, want in zip(heads, wants):
        assert np.allclose(np.r_[fit.weights, fit.bias], want, atol=1e-6) and fit.steps < 15
    assert heads[0].loss < np.log(2) * 1.01


def test_separable_classes_end_and_odd_tables_raise(spark):
    df = spark.createDataFrame([([float(i)], int(i > 5)) for i in range(12)], "x array<double>, y int")
    assert training.fit_head(df, "x", "y").weights[0] > 0.5
    for odd in (df.where("y = 1"), df.limit(0), df.withColumn("y", F.col("y") + 1), df.unionByName(spark.createDataFrame([([1.0, 2.0], 1)], df.schema))):
        with pytest.raises(ValueError):
            training.fit_head(odd, "x", "y")
