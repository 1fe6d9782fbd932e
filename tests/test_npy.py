"""Arrays in files: what is written is read, in order; whatever does not match raises."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import npy, tables


def frame(spark, n, parts=5):
    rows = [(i, (i * 7) % n if n else 0, [[float(i), -float(i)], [0.5, i / 3], [1.0, 2.0]], i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "id long, place long, x array<array<float>>, label_id int").repartition(parts)


def stacked(path):
    parts = json.load(open(f"{path}/{npy.INDEX}"))["parts"]
    return np.concatenate([np.load(f"{path}/{p}") for p in parts])


@pytest.mark.parametrize("shape", [(40,), (40, 3), (7, 4, 2), (0, 150, 13)])
@pytest.mark.parametrize("kind", ["float32", "int64", ">f8", "int16"])
def test_reads_what_numpy_wrote(spark, tmp_path, shape, kind):
    a = (np.arange(np.prod(shape)).reshape(shape) % 97).astype(kind)
    np.save(f"{tmp_path}/a.npy", a)
    df = npy.read_npy(spark, f"{tmp_path}/a.npy", range_bytes=64)
    got = [(r.pos, r.x) for r in df.orderBy("pos").collect()]
    assert [p for p, _ in got] == list(range(shape[0]))
    assert [x for _, x in got] == a.tolist()
    if shape[0] == 40 and len(shape) == 2:
        assert df.rdd.getNumPartitions() >= 4


def test_round_trip_in_order(spark, tmp_path):
    path = f"{tmp_path}/X.npy"
    npy.write_npy(frame(spark, 50), path, "x", ["place"], (3, 2))
    want = np.array([r.x for r in frame(spark, 50).orderBy("place").collect()], np.float32)
    assert stacked(path).dtype == np.float32 and (stacked(path) == want).all()
    assert [r.x for r in npy.read_npy(spark, path, 48).orderBy("pos").collect()] == want.tolist()
    with pytest.raises(Exception, match="holds an array"):
        npy.write_npy(frame(spark, 5), path, "x", ["place"], (3, 2))
    npy.write_npy(frame(spark, 5), path, "x", ["place"], (3, 2), overwrite=True)
    assert stacked(path).shape == (5, 3, 2)
    named = set(json.load(open(f"{path}/{npy.INDEX}"))["parts"])
    assert {f for f in os.listdir(path) if not f.endswith(".crc")} == named | {npy.INDEX}


def test_empty_and_blank_sets_keep_their_shape(spark, tmp_path):
    npy.write_training_set(frame(spark, 0), f"{tmp_path}/none", (150, 13), ["id"])
    blank = frame(spark, 9).withColumn("x", F.when(F.col("id") != 4, F.col("x")))
    npy.write_training_set(blank, f"{tmp_path}/blank", (3, 2), ["id"])
    for folder, shape in (("none", (150, 13)), ("blank", (3, 2))):
        assert stacked(f"{tmp_path}/{folder}/X.npy").shape == (0, *shape) and stacked(f"{tmp_path}/{folder}/y.npy").shape == (0,)
        assert npy.read_npy(spark, f"{tmp_path}/{folder}/X.npy").count() == 0


@pytest.mark.parametrize("bad", ["array(array(1f, 2f))", "array(array(1f, 2f), array(1f), array(1f, 2f))", "array(array(1f, null), array(1f, 2f), array(1f, 2f))", "cast(null as array<array<float>>)"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    rows = frame(spark, 20).withColumn("x", F.when(F.col("id") == 7, F.expr(bad)).otherwise(F.col("x")))
    with pytest.raises(Exception, match="shape|Writing"):
        npy.write_npy(rows, f"{tmp_path}/X", "x", ["id"], (3, 2))
    left = os.listdir(f"{tmp_path}/X") if os.path.exists(f"{tmp_path}/X") else []
    assert npy.INDEX not in left and not [f for f in left if f.endswith(".npy") and not f.startswith(".")]
    with pytest.raises(Exception, match=npy.INDEX):
        npy.read_npy(spark, f"{tmp_path}/X").count()


def test_odd_files_raise(spark, tmp_path):
    np.save(f"{tmp_path}/f.npy", np.asfortranarray(np.ones((3, 4))))
    np.save(f"{tmp_path}/o.npy", np.array([{}], dtype=object), allow_pickle=True)
    np.save(f"{tmp_path}/s.npy", np.float32(3))
    for name in ("f", "o", "s", "absent"):
        with pytest.raises((ValueError, FileNotFoundError)):
            npy.parts_of(f"{tmp_path}/{name}.npy")
    np.save(f"{tmp_path}/cut.npy", np.ones((9, 4)))
    os.truncate(f"{tmp_path}/cut.npy", os.path.getsize(f"{tmp_path}/cut.npy") - 8)
    with pytest.raises(Exception, match="within a row"):
        npy.read_npy(spark, f"{tmp_path}/cut.npy").collect()


@pytest.mark.parametrize("n", [0, 1, 23])
def test_rows_are_numbered_as_they_are_read(spark, n):
    df = spark.range(n).repartition(4).cache()
    got = npy.numbered(df).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(n)) and [r.id for r in got] == [r.id for r in df.collect()]


def test_training_set(spark, tmp_path):
    rows = frame(spark, 30)
    npy.write_training_set(rows, str(tmp_path), (3, 2), ["id"])
    meta = rows.orderBy("id").select("id", "label_id", F.lit("Fold1").alias("fold")).toPandas()
    meta.to_csv(f"{tmp_path}/meta.csv", index=False)
    load = lambda m="meta", **k: npy.training_set(spark, f"{tmp_path}/X.npy", f"{tmp_path}/y.npy", f"{tmp_path}/{m}.csv", **k)
    got = load(required=("fold",)).orderBy("pos").collect()
    assert [(r.id, r.x[0][0], r.is_high_confidence) for r in got] == [(i, float(i), 1) for i in range(30)]
    assert [r.pos for r in load(max_samples=4).orderBy("pos").collect()] == [0, 1, 2, 3]
    meta.iloc[:29].to_csv(f"{tmp_path}/short.csv", index=False)
    meta.assign(label_id=(meta.label_id + 1) % 3).to_csv(f"{tmp_path}/other.csv", index=False)
    meta.assign(label_id=meta.label_id.where(meta.id != 3)).to_csv(f"{tmp_path}/null.csv", index=False)
    for m, kind, said in (("short", ValueError, "lengths"), ("other", ValueError, "labels"), ("null", ValueError, "labels"), ("absent", Exception, "exist")):
        with pytest.raises(kind, match=said):
            load(m)
    with pytest.raises(ValueError, match="lacks"):
        load(required=("subject_id",))


def test_checked_arrays_raise(spark):
    x = spark.createDataFrame([(1, [0.5]), (2, [0.5])], "k long, v array<float>")
    meta = spark.createDataFrame([(1, 0), (2, 2)], "k long, label_id int")
    assert tables.checked_arrays(x, meta, "k", ()).count() == 2
    odd = {
        "unknown labels": (x, meta.withColumn("label_id", F.when(F.col("k") == 1, F.col("label_id")))),
        "repeated keys": (x, meta.unionByName(meta.where("k = 1"))),
        "metadata without": (x.where("k = 1"), meta),
        "arrays without": (x, meta.where("k = 1")),
        "null keys": (x.withColumn("k", F.lit(None).cast("long")).limit(1), meta.limit(0)),
    }
    for said, (a, m) in odd.items():
        with pytest.raises(ValueError, match=said):
            tables.checked_arrays(a, m, "k", ())
    twice = x.unionByName(x.where("k = 2"))
    with pytest.raises(ValueError, match="repeated"):
        tables.checked_arrays(twice, meta, "k", ())
