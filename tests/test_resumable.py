"""The resumable table, the table function and splits as a whole."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_segments import FRAMES, frames_of

from pulsegrid.operators import blinks, metrics, signals, splits, table_functions
from pulsegrid.sources import resumable

ROWS = "video_id string, i long"


def test_a_broken_run_is_resumed(spark, tmp_path):
    """The first run breaks at one video; the second finishes its batch and the rest, and writes each video once."""
    path, marks = f"{tmp_path}/t", tmp_path / "seen"
    marks.mkdir()
    videos = spark.createDataFrame([(f"v{i}",) for i in range(30)] + [(None,), ("v3",)], "video_id string")

    def compute(bad):
        def rows(own):
            def run(frames):
                for f in frames:
                    for v in f["video_id"]:
                        if v == bad:
                            raise ValueError("broken video")
                        (marks / f"{v}-{random.random()}").touch()
                    yield f.loc[f.index.repeat(f["video_id"].str[1:].astype(int) % 4)].assign(i=1)

            return own.mapInPandas(run, ROWS)

        return rows

    with pytest.raises(Exception, match="broken video"):
        resumable.write_resumable(videos, compute("v17"), path, 4)
    before = resumable.progress(spark, path).where("state = 'done'").count()
    shown = resumable.read_resumable(spark, path, ROWS).select("video_id").distinct().count()
    assert before < 30 and shown <= before
    done = {r.video_id for r in resumable.progress(spark, path).where("state = 'done'").collect()}
    for f in marks.iterdir():
        f.unlink()
    written = resumable.write_resumable(videos, compute(None), path, 4)
    assert written and not {f.name.split("-")[0] for f in marks.iterdir()} & done
    got = {r.video_id: r["count"] for r in resumable.read_resumable(spark, path, ROWS).groupBy("video_id").count().collect()}
    assert got == {f"v{i}": i % 4 for i in range(30) if i % 4}
    state = resumable.progress(spark, path)
    assert state.where("state = 'done'").count() == 30 and state.where("n_rows = 0").count() == 8
    assert resumable.write_resumable(videos, compute("v1"), path, 4) == []
    more = videos.unionByName(spark.createDataFrame([("v99",)], "video_id string"))
    assert len(resumable.write_resumable(more, compute("v1"), path, 4)) == 1
    assert resumable.read_resumable(spark, path, ROWS).where("video_id = 'v99'").count() == 3
    assert len([f for f in os.listdir(f"{path}/rows") if f.startswith("batch=")]) <= 5


def test_nothing_to_write(spark, tmp_path):
    none = spark.createDataFrame([], "video_id string")
    assert resumable.write_resumable(none, lambda own: own.withColumn("i", F.lit(1)), f"{tmp_path}/t") == []
    assert resumable.read_resumable(spark, f"{tmp_path}/t", ROWS).count() == 0
    with pytest.raises(ValueError):
        resumable.write_resumable(none, lambda own: own, f"{tmp_path}/t", 0)


def test_table_function_equals_the_grouped_map(spark):
    """Also for signals that fall and rise within the least pause."""
    z = spark.createDataFrame(list(frames_of(8)), FRAMES)
    filled = signals.fill_signals(z)
    for rows in (signals.smooth(filled), filled.withColumn("p_closed_smooth", F.col("p_closed"))):
        states = signals.closed_state(rows).cache()
        want = blinks.blink_events_with_gap(states)
        names = want.columns
        got = table_functions.blink_events(states).select(*names)
        a, b = (sorted(map(tuple, df.collect())) for df in (got, want))
        assert len(a) == len(b) > 0
        for x, y in zip(a, b):
            assert all(p == q or abs(p - q) < 1e-9 for p, q in zip(x[1:], y[1:])) and x[0] == y[0]
    assert table_functions.blink_events(states.where("video_id = 'none'")).count() == 0


META = "k long, subject_id string, fold string, label_id int, is_high_confidence int"


def meta_rows(spark, n=120, subjects=6):
    return spark.createDataFrame([(i, f"s{i % subjects}", f"Fold{i % 4 + 1}", i % 3, int(i % 5 != 0)) for i in range(n)], META)


@pytest.mark.parametrize("full", [True, False])
@pytest.mark.parametrize("mode", ["all", "high_confidence"])
def test_fold_split(spark, full, mode):
    rows = meta_rows(spark)
    got = splits.fold_split(rows, "Fold3", "k", mode, full).collect()
    sides = {s: [r for r in got if r.split == s] for s in ("train", "val", "test")}
    able = lambda r: mode == "all" or r.is_high_confidence == 1
    assert {r.k for r in sides["test"]} == {i for i in range(120) if i % 4 == 2 and (mode == "all" or full or i % 5)}
    assert all(able(r) and r.fold != "Fold3" for r in sides["train"] + sides["val"]) and sides["train"] and sides["val"]
    assert len(got) == len({r.k for r in got}) == sum(r.fold == "Fold3" and (full or able(r)) or r.fold != "Fold3" and able(r) for r in rows.collect())
    assert not {r.subject_id for r in sides["train"]} & {r.subject_id for r in sides["val"]}


def test_splits_fall_back_or_raise(spark):
    one = meta_rows(spark, subjects=1)
    got = splits.fold_split(one, "Fold1", "k")
    assert {r.split for r in got.select("split").distinct().collect()} == {"train", "val", "test"}
    with pytest.raises(ValueError, match="not allowed"):
        splits.fold_split(one, "Fold1", "k", fallback=False)
    with pytest.raises(ValueError, match="no split by"):
        splits.group_split(one)
    with pytest.raises(ValueError, match="no test"):
        splits.fold_split(one, "Fold9", "k")
    with pytest.raises(ValueError, match="no train"):
        splits.fold_split(one.where("fold = 'Fold1'"), "Fold1", "k")
    with pytest.raises(ValueError, match="no rows"):
        splits.final_split(one.where("is_high_confidence = 0"), "k")
    final = splits.final_split(meta_rows(spark), "k").collect()
    assert {r.k for r in final} == {i for i in range(120) if i % 5} and {r.split for r in final} == {"train", "val"}
    assert splits.eligible(one.drop("is_high_confidence"), "high_confidence").count() == 120


def test_best_epoch_of_a_falling_value(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([3.0, 2.0, 1.99995, 2.5, 2.6, 0.1], 1)], "series string, epoch int, v double")
    row = metrics.best_epoch(df, "v", patience=3, mode="min").first()
    assert (row.best_epoch, row.best_value, row.stopped_at) == (2, 2.0, 5)
    with pytest.raises(ValueError):
        metrics.best_epoch(df, "v", mode="least")
