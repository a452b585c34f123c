import time

from pyspark.sql import functions as F

from lorewell.streaming import ingest
from tests.compare import plain


def test_debounced_stream_matches_its_batch_twin(spark, tmp_path):
    events = spark.sql("select id as event_id, id % 3 as user_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,0, cast(id * 4 + if(id > 20, 60, 0) as decimal(18,6))) as ts, 'modified' as event_type from range(40)")
    source = str(tmp_path / "events")
    events.write.parquet(source)
    stream = ingest.file_stream(spark, source, "event_id long, user_id long, ts timestamp, event_type string", 1)
    out = str(tmp_path / "out")
    q = ingest.debounced(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = {tuple(plain(x) for x in r) for r in spark.read.schema("user_id long, started timestamp, ended timestamp, events long").parquet(out).collect()}
    every = {tuple(plain(x) for x in r) for r in ingest.debounced(events).collect()}
    assert closed and closed <= every


def test_progress_resumes_and_starts_over(spark, tmp_path):
    source = str(tmp_path / "p")
    rows = [("f", "h1", "in_progress", 3, 10), ("g", "h1", "completed", 2, 2)]
    later = [("f", "h1", "in_progress", 0, 10)]
    last = [("f", "h2", "in_progress", 1, 0)]
    schema = "path string, hash string, status string, done long, total long"
    for i, r in enumerate((rows, later, last)):
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(source)
        q = (
            ingest.progress_states(ingest.file_stream(spark, source, schema)).writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(str(tmp_path / "o")))
            .option("checkpointLocation", str(tmp_path / "c")).outputMode("update").trigger(availableNow=True).start()
        )
        q.awaitTermination()
    states = {(r.path, r.hash, r.done, r.total) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert ("f", "h1", 3, 10) in states and ("f", "h2", 1, 0) in states and ("g", "h1", 2, 2) in states


def test_queue_and_ingest(spark, tmp_path):
    queue = spark.createDataFrame([("a", 2, 1), ("b", 0, 2), ("a", 0, 3), ("c", 1, 4)], "path string, priority int, seq long")
    assert [r.path for r in ingest.dequeue(queue, 2).collect()] == ["b", "c"]
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "x"), (2, "")], "id long, text string").write.parquet(source)
    stream = ingest.file_stream(spark, source, "id long, text string")
    for _ in range(2):  # a second run finds nothing new
        ingest.run_ingest(stream, lambda b: b.where(F.length("text") > 0), str(tmp_path / "t"), str(tmp_path / "c"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [1]


def test_distinct_changes_plan(spark, tmp_path):
    spark.createDataFrame([(1,)], "k long").selectExpr("k", "timestamp'2024-01-01' as ts").write.parquet(str(tmp_path / "d"))
    stream = ingest.file_stream(spark, str(tmp_path / "d"), "k long, ts timestamp")
    assert ingest.distinct_changes(stream, ["k"]).isStreaming


def test_queue(spark):
    arrivals = spark.createDataFrame([("a", 2, 1), ("b", 1, 2), ("a", 0, 3), ("c", 2, 4)], "path string, priority int, seq long")
    q = ingest.Queue.empty(spark).add(arrivals)
    assert [(r.path, r.priority) for r in q.next(9).collect()] == [("b", 1), ("a", 2), ("c", 2)]
    assert q.pause().next(9).count() == 0 and q.pause().resume().next(1).first().path == "b"
    q = q.taken(q.next(2))
    again = q.add(spark.createDataFrame([("a", 0, 9), ("d", 0, 10)], "path string, priority int, seq long"))
    assert [r.path for r in again.next(9).collect()] == ["d", "c"]
    assert {r.state: r.entries for r in again.sizes().collect()} == {"queued": 2, "working": 2}
    done = again.complete(spark.createDataFrame([("a",)], "path string"))
    assert [r.path for r in done.add(arrivals).next(9).collect()] == ["d", "a", "c"]
    assert done.clear().entries.count() == 0


def test_progress_and_isolated_items(spark, tmp_path):
    spark.createDataFrame([(i, "bad" if i % 5 == 0 else "good") for i in range(50)], "id long, kind string").write.parquet(str(tmp_path / "in"))
    watch = ingest.Progress(expected=100)
    spark.streams.addListener(watch)
    stream = ingest.counted_reasons(ingest.file_stream(spark, str(tmp_path / "in"), "id long, kind string"), "reasons", "kind", ("bad", "good"))
    process = lambda b: b.withColumn("problem", F.when(F.col("kind") == "bad", "broken"))
    ingest.run_isolated(stream, process, str(tmp_path / "out"), str(tmp_path / "state"))
    for _ in range(100):
        if watch.ended:
            break
        time.sleep(0.1)
    spark.streams.removeListener(watch)
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 40 and spark.read.parquet(str(tmp_path / "out/problems")).count() == 10
    assert watch.rows == 50 and watch.counts["reasons"] == {"rows": 50, "bad": 10, "good": 40} and watch.rate() > 0 and watch.seconds_left() > 0
