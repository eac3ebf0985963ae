"""Streaming operators over a directory of event files."""

from brightfield.streaming import events as stream
from pyspark.sql import functions as F

COLUMNS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def write(spark, path, rows, n):
    df = spark.createDataFrame([(i, t, u, k, float(v), "{}") for i, t, u, k, v in rows], "event_id long, t string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.to_timestamp("t")).select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{path}/part{n}")


def test_windows_late_rows_and_resume(spark, tmp_path):
    src, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    write(spark, src, [(1, "2024-01-01 00:05:00", 1, "a", 1), (2, "2024-01-01 00:20:00", 1, "a", 2), (3, "2024-01-01 03:00:00", 2, "a", 3)], 0)
    counts = lambda: stream.tumbling_counts(spark.readStream.schema(COLUMNS).option("recursiveFileLookup", True).parquet(src))
    stream.run_available(counts(), mark, str(tmp_path / "out"))
    write(spark, src, [(4, "2024-01-01 00:10:00", 1, "a", 9), (5, "2024-01-01 09:00:00", 1, "a", 1)], 1)  # the first is too late
    stream.run_available(counts(), mark, str(tmp_path / "out"))
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(F.hour("window_start"), "n", "total").collect()]
    assert (0, 2, 3.0) in rows and not any(n == 3 for _, n, _ in rows)


def test_last_rows_state_and_duplicates(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(3):
        write(spark, src, [(n, f"2024-01-01 0{n}:00:00", 1, "a", n), (9, "2024-01-01 00:30:00", 2, "a", n)], n)
    events = spark.readStream.schema(COLUMNS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(src)
    q = events.writeStream.foreachBatch(stream.upsert_last(target, ["user_id"], ["ts"])).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.user_id: r.value for r in spark.read.parquet(f"{target}/v0").collect()}
    assert last[1] == 2.0 and set(last) == {1, 2}
    stream.run_available(stream.running_totals(events), str(tmp_path / "c2"), name="totals", mode="update").stop()
    totals = spark.table("totals").groupBy("user_id").agg(F.max("n").alias("n"), F.max("total").alias("t"))
    assert {r.user_id: (r.n, r.t) for r in totals.collect()} == {1: (3, 3.0), 2: (3, 3.0)}
    stream.run_available(stream.first_events(events), str(tmp_path / "c3"), name="once").stop()
    assert spark.table("once").filter("event_id = 9").count() == 1


def test_batch_forms(spark):
    rows = [(1, "2024-01-01 00:00:00", 1, "a", 1), (2, "2024-01-05 00:00:00", 1, "a", 2), (3, "2024-01-09 00:00:01", 1, "a", 3)]
    df = spark.createDataFrame([(i, t, u, k, float(v)) for i, t, u, k, v in rows], "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r.n for r in stream.sessions(df).collect()) == [1, 2]  # exactly 96 hours stay together
    assert stream.sliding_average(df).count() == 6
