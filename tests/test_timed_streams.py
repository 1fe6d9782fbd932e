"""Streams with timers: replay equals batch, idle keys are forgotten, and operators follow each other in one query."""

import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_streaming import near

from pulsegrid.config import FIXTURE_SEQUENCES, SHORT_BLINKS, RuleConfig
from pulsegrid.operators import metrics, sequences
from pulsegrid.plans import frames as P
from pulsegrid.streaming import timed

BEGIN = pd.Timestamp("2024-01-01", tz="UTC")


@pytest.fixture(scope="module")
def store(spark):
    timed.with_state_store(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream(spark, batches, schema, folder, delay="10 seconds"):
    """One micro-batch for each frame of rows; ``event_time`` follows ``timestamp``."""
    for k, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    at = F.timestamp_micros((F.col("timestamp") * 1e6 + int(BEGIN.timestamp()) * 1_000_000).cast("long"))
    return source.withColumn("event_time", at).withWatermark("event_time", delay)


def run(plan, folder, name, sink="memory"):
    query = plan.writeStream.format(sink).queryName(name).option("path", f"{folder}/out").outputMode("append").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()


def by_time(rows, cuts=((-1.0, 1.0), (0.8, 2.7), (2.7, 1e9))):
    plain = rows.toPandas()
    return [plain[(plain["timestamp"] >= lo) & (plain["timestamp"] < hi)] for lo, hi in cuts], rows.schema


def test_states_equal_batch(store, tmp_path):
    norm = P.fixture_norm(store, SF)[2].where("p_closed IS NOT NULL")
    columns = ["video_id", "timestamp", "closed_state", "p_closed_smooth", "current_closed_duration", "perclos_10s"]
    want = sorted(tuple(r) for r in P.states(norm, SHORT_BLINKS).select(*columns).collect())
    parts, schema = by_time(norm.select("video_id", "timestamp", "p_closed"))
    run(timed.States(SHORT_BLINKS).over(stream(store, parts, schema, tmp_path)), tmp_path, "timed_states")
    near(sorted(tuple(r) for r in store.table("timed_states").select(*columns).collect()), want, 3)


def test_an_idle_video_is_forgotten(store, tmp_path):
    """``a`` ends closed; ``b`` carries the watermark past a's timer; a's last row begins anew."""
    schema = "video_id string, timestamp double, p_closed float"
    batches = [
        [("a", 0.0, 0.9), ("a", 0.1, 0.9), ("b", 0.0, 0.1)], [("a", 0.2, 0.5), ("b", 5.0, 0.1)], [("b", 200.0, 0.1)], [("b", 201.0, 0.1)], [("a", 260.0, 0.5), ("b", 260.0, 0.1)],
    ]
    plan = timed.States(idle=30.0).over(stream(store, batches[:4], schema, tmp_path))
    rows = lambda: {(r.video_id, r.timestamp): r for r in store.read.parquet(f"{tmp_path}/out").collect()}
    run(plan, tmp_path, "idle_states", "parquet")
    got = rows()
    assert got["a", 0.2].closed_state == 1 and len(got) == 7
    held = store.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "latch").load()
    assert [r.k for r in held.select(F.col("key.video_id").alias("k")).collect()] == ["b"]
    store.createDataFrame(batches[4], schema).coalesce(1).write.parquet(f"{tmp_path}/in/4")
    run(plan, tmp_path, "idle_again", "parquet")
    again = rows()
    assert len(again) == 9 and again["a", 260.0].closed_state == 0 and again["a", 260.0].p_closed_smooth == 0.5


def test_seconds_that_have_passed_leave_the_state(store, tmp_path):
    schema = "video_id string, timestamp double, p_closed float"
    batches = [[("a", k * 4.0 + i / 5, 0.1) for i in range(20)] for k in range(4)]
    run(timed.States(SHORT_BLINKS).over(stream(store, batches, schema, tmp_path)), tmp_path, "seconds")
    reader = store.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "seconds").load()
    kept = sorted(r.s for r in reader.select(F.col("user_map_key.second").alias("s")).collect())
    assert kept and min(kept) >= 12 and max(kept) == 15
    assert store.table("seconds").count() == 80


def probabilities(x):
    """Three shares from the mean of a sequence's first feature, as columns."""
    m = F.aggregate(x, F.lit(0.0), lambda s, f: s + F.get(f, 0).cast("double")) / F.size(x)
    up = 1 / (1 + F.exp(-3 * m))
    return {"prob_0": (1 - up) * 0.9 + 0.05, "prob_1": up * 0.3, "prob_2": 1 - ((1 - up) * 0.9 + 0.05) - up * 0.3}


def test_frames_to_smoothed_predictions_in_one_query(store, tmp_path):
    """Two stateful operators with a scorer between them, against slide and stream_predictions."""
    frames = P.fixture_norm(store, SF)[2].select("video_id", "processed_idx", "frame_idx", "timestamp", "ear_z", "p_closed_smooth").cache()
    cfg = RuleConfig(warmup=1)
    win = sequences.slide(frames, FIXTURE_SEQUENCES).groupBy("video_id", "seq_idx").agg(
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.min("frame_idx").alias("start_frame"),
        F.sort_array(F.collect_list(F.struct("processed_idx", F.array("ear_z").alias("f")))).getField("f").alias("x"),
    )
    batch = metrics.stream_predictions(win.withColumns(probabilities(F.col("x"))).withColumn("sequence_id", F.concat("video_id", F.col("seq_idx").cast("string"))), cfg)
    columns = ["video_id", "seq_idx", "pred_label_id", *[f"smooth_prob_{c}" for c in range(3)]]
    want = sorted(tuple(r) for r in batch.select(*columns).collect())
    parts, schema = by_time(frames.select("video_id", "timestamp", "ear_z", "p_closed_smooth"), ((-1.0, 1.0), (1.0, 2.7), (2.7, 1e9)))
    source = stream(store, parts, schema, tmp_path)
    seqs = timed.Sequences(("ear_z", "p_closed_smooth"), FIXTURE_SEQUENCES).over(source)
    scored = seqs.select("video_id", "seq_idx", "event_time", *[v.alias(n) for n, v in probabilities(F.col("x")).items()])
    run(timed.SmoothedPredictions(cfg).over(scored), tmp_path, "predictions")
    got = store.table("predictions")
    near(sorted(tuple(r) for r in got.select(*columns).collect()), want, 3)
    rate = got.where("changed = 1").count() / max(1, got.count())
    assert 0 <= rate < 1 and got.where(f"seq_idx < {cfg.warmup}").count() == 0
