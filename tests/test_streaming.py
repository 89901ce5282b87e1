from pyspark.sql import functions as F

from bagweave.sources import logs
from bagweave.streaming.replay import replay_stream

LINES = ["item 1", "pos 1 0 2", "grasp 9 1", "time sim 1 0.1", "release 9 1", "time sim 2 0.2", "pos 1 0 0.5", "clear", "time sim 3 0.3"]


def test_stream_gives_the_states_of_the_whole_log(spark, tmp_path):
    """The lines of two logs come in three batches; the state goes on from batch to batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [(log, i, line) for log in ("a", "b") for i, line in enumerate(LINES)]
    for k in range(3):
        part = [r for r in rows if r[1] % 9 // 3 == k]
        spark.createDataFrame(part, "log string, line_no bigint, value string").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("log string, line_no bigint, value string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = replay_stream(stream).writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("replayed").select("log", "state_idx", "time", "cleared", F.col("items")[0]["grasped"], F.col("items")[0]["location"]).collect()
    want = [(s, t, c, items[0]["grasped"], items[0]["location"]) for s, t, c, items in logs.replay_blocks(iter(LINES))][:-1]
    assert sorted(tuple(r) for r in got) == [(log, *w) for log in ("a", "b") for w in want]
