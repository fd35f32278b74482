from pyspark.sql import functions as F

from loreweave import streaming
from loreweave.operators.maintain import Snapshots
from loreweave.sources import table


def drain(spark, df, name, tmp_path, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(300)
    return spark.table(name)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/events")
    stream = streaming.with_event_time(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"), "60 days")
    got = drain(spark, streaming.tumbling_counts(stream), "tumbling", tmp_path, "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streaming.tumbling_counts(events).collect()))
    daily = drain(spark, streaming.daily_activity(stream), "daily", tmp_path)
    assert sorted(map(tuple, daily.collect())) == sorted(map(tuple, streaming.daily_activity(events).collect()))
    users = events.filter("user_id <= 3")
    users.write.parquet(f"{tmp_path}/users")
    s = streaming.with_event_time(spark.readStream.schema(users.schema).parquet(f"{tmp_path}/users"), "60 days")
    sess = drain(spark, streaming.sessions(s), "sessions", tmp_path, "complete")
    assert sorted(map(tuple, sess.collect())) == sorted(map(tuple, streaming.sessions(users).collect()))


def test_outbox_keeps_one(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "file int, revision int")
    assert streaming.outbox(df, ["file", "revision"]).count() == 2


def test_index_stream(spark, tmp_path):
    schema = "source_type string, source_id long, content string, version int"
    for i, rows in enumerate([[("n", 1, "one", 1), ("n", 2, "two", 1)], [("n", 1, "one again", 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i}")
        changes = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        streaming.index_stream(changes, f"file://{tmp_path}/kb", f"{tmp_path}/cp").awaitTermination(300)
    got = {(r.source_id, r.chunk_text) for r in Snapshots(spark, f"file://{tmp_path}/kb").read("chunks").collect()}
    assert got == {(1, "one again"), (2, "two")}
