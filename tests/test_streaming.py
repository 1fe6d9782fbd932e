"""Replaying frames as a stream gives what the batch plan gives."""

from conftest import SF
from pyspark.sql import functions as F

from pulsegrid.config import FIXTURE_SEQUENCES, SHORT_BLINKS
from pulsegrid.operators import blinks, sequences
from pulsegrid.plans import frames as P
from pulsegrid.streaming.states import stream_blinks, stream_sequences, stream_states

COLUMNS = ["video_id", "timestamp", "p_closed_smooth", "closed_state", "current_closed_duration", "perclos_10s"]


def test_replay_equals_batch(spark, tmp_path):
    norm = P.fixture_norm(spark, SF)[2].where("p_closed IS NOT NULL")
    want = sorted(tuple(r) for r in P.states(norm).select(*COLUMNS).collect())
    plain = norm.select("video_id", "timestamp", "p_closed").toPandas()
    for k, (lo, hi) in enumerate(((-1.0, 1.0), (1.0, 2.7), (2.7, 1e9))):
        part = plain[(plain["timestamp"] >= lo) & (plain["timestamp"] < hi)]
        spark.createDataFrame(part, "video_id string, timestamp double, p_closed float").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    schema = "video_id string, timestamp double, p_closed float"
    batches = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream_states(batches).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("states").select(*COLUMNS).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and a[3] == b[3] and all(abs(x - y) < 1e-6 for x, y in ((a[2], b[2]), (a[4], b[4]), (a[5], b[5])))


def replay(spark, rows, plan, folder, name):
    """The rows in three micro-batches by time, a part of them sent twice, through a stream."""
    plain, schema = rows.toPandas(), rows.schema
    for k, (lo, hi) in enumerate(((-1.0, 1.0), (0.8, 2.7), (2.7, 1e9))):
        part = plain[(plain["timestamp"] >= lo) & (plain["timestamp"] < hi)]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = plan(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def near(got, want, exact):
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a[:exact] == b[:exact] and all(abs(x - y) < 1e-5 for x, y in zip(a[exact:], b[exact:])), (a, b)


def test_blinks_of_a_stream(spark, tmp_path):
    states = P.states(P.fixture_norm(spark, SF)[2].where("p_closed IS NOT NULL AND ear_z IS NOT NULL")).select("video_id", "processed_idx", "frame_idx", "timestamp", "p_closed_smooth", "closed_state", F.expr("cast(ear_z as double)").alias("ear_z")).cache()
    columns = ["video_id", "timestamp", *[f"avg_{c}_10s" for c in ("blink_duration", "blink_amplitude", "opening_velocity")], "blink_frequency_10s", "time_since_last_blink"]
    want = blinks.blink_rolling(states, SHORT_BLINKS).select(*columns)
    assert want.where("blink_frequency_10s > 0").count() > 0
    got = replay(spark, states.select("video_id", "timestamp", "closed_state", "ear_z"), lambda s: stream_blinks(s, SHORT_BLINKS), tmp_path, "blinks")
    near(sorted(map(tuple, got.select(*columns).collect())), sorted(map(tuple, want.collect())), 2)


def test_sequences_of_a_stream(spark, tmp_path):
    frames = P.fixture_norm(spark, SF)[0].select("video_id", "timestamp", "processed_idx", F.expr("cast(face_detected as float)").alias("face"), F.expr("cast(frame_idx as float)").alias("at")).cache()
    win = sequences.slide(frames, FIXTURE_SEQUENCES).groupBy("video_id", "seq_idx", "start_row")
    want = win.agg(F.min("timestamp").alias("s"), F.max("timestamp").alias("e"), F.sort_array(F.collect_list(F.struct("processed_idx", F.array("face", "at").alias("f")))).alias("r"))
    want = sorted((r[0], r[1], r[2], r[3], r[4], [list(x) for x in r[5]]) for r in want.select("video_id", "seq_idx", "start_row", "s", "e", "r.f").collect())
    got = replay(spark, frames.drop("processed_idx"), lambda s: stream_sequences(s, ("face", "at"), FIXTURE_SEQUENCES), tmp_path, "sequences")
    assert sorted((r[0], r[1], r[2], r[3], r[4], [list(x) for x in r[5]]) for r in got.collect()) == want and want
