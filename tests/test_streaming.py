import datetime

from pyspark.sql import functions as F

from quire.streaming import jobs as ST


def test_stream_rate_limit(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(c, t + datetime.timedelta(minutes=i)) for c in (1, 2) for i in range(10)] + [(1, t + datetime.timedelta(minutes=61))]
    spark.createDataFrame(rows, "client int, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("client int, ts timestamp").parquet(f"{tmp_path}/in").withWatermark("ts", "10 minutes")
    q = ST.stream_rate_limit(stream, "client", "ts", limit=4).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        got = spark.table("limited").groupBy("client").agg(F.count_if("accepted").alias("ok"), F.count("*").alias("n")).collect()
    finally:
        q.stop()
    assert {r.client: (r.ok, r.n) for r in got} == {1: (5, 11), 2: (4, 10)}


def test_upsert_latest(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, "queued", t), (1, "done", t + datetime.timedelta(hours=1)), (2, "queued", t)]
    spark.createDataFrame(rows, "id int, status string, created timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, status string, created timestamp").parquet(f"{tmp_path}/in")
    q = ST.upsert_latest(stream, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    newest = sorted(p.name for p in (tmp_path / "out").iterdir())[-1]
    assert {r.id: r.status for r in spark.read.parquet(f"{tmp_path}/out/{newest}").collect()} == {1: "done", 2: "queued"}


def test_stream_states(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("a", t), ("a", t + datetime.timedelta(minutes=30)), ("b", t + datetime.timedelta(hours=1)), ("b", t + datetime.timedelta(hours=9))], "status string, created timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("status string, created timestamp").parquet(f"{tmp_path}/in")
    q = ST.stream_states(stream).writeStream.format("memory").queryName("states").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert sorted((r.status, r.n) for r in spark.table("states").collect()) == [("a", 2), ("b", 1), ("b", 1)]
    finally:
        q.stop()
