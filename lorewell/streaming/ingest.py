"""Streams of file events: debounce, change sets, priority queue, incremental ingestion; each with a batch twin.

Event time, watermarks and session windows take the place of timers; a rate limit (maxFilesPerTrigger)
takes the place of dropping what is over a batch's cap.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorewell.session import shared_folder, table

GAP = "10 seconds"
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def file_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 50) -> DataFrame:
    """Files of events as they arrive, at most `per_trigger` a batch; the rest waits for the next."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("latestFirst", "false").parquet(folder)


def debounced(events: DataFrame, key: str = "user_id", gap: str = GAP, watermark: str = "1 minute") -> DataFrame:
    """(key, started, ended, events): quiet-gap sessions of a stream or a table of (key, ts, event_type)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", watermark) if events.isStreaming else timed
    w = F.session_window("ts", gap)
    return timed.groupBy(key, w.alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


@query(
    "st2_debounced_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 SECOND THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
      SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 10 SECOND AS ended, count(*) AS events FROM n GROUP BY user_id, session""",
)
def debounced_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The batch twin of the debounced stream."""
    return debounced(table(spark, folder, "events")).select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "events")


@query("st1_streamed_sessions", SQL["st2_debounced_sessions"])
def streamed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The debounced sessions as a stream computes them: read file by file, until what is there is read."""
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    schema = table(spark, folder, "events").schema
    # A pattern, since a stream of files takes folders and patterns, not the name of one file.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 50).parquet(f"{folder}/events.parque[t]")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")  # a batch that is run again overwrites its own rows

    # Append: a session is written once, when the watermark has passed its end, and leaves the state.
    run = debounced(stream).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return spark.read.parquet(f"{at}/rows").select("user_id", ntz("started"), ntz("ended"), "events").unionByName(_still_open(spark, folder, GAP))


def _still_open(spark: SparkSession, folder: str, gap: str, watermark: str = "1 minute") -> DataFrame:
    """Sessions that the watermark had not closed when the input ended, from the events near its end alone."""
    e = table(spark, folder, "events").select("user_id", "ts")
    last = e.agg(F.max("ts").alias("last"))
    # The watermark stands `watermark` before the last event; a session is open if it ends after that.
    open_ = debounced(e).crossJoin(F.broadcast(last)).where(F.col("ended") > F.col("last").cast("timestamp") - F.expr(f"INTERVAL {watermark}"))  # one row
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return open_.select("user_id", ntz("started"), ntz("ended"), "events")


@query(
    "st3_change_sets",
    "SELECT user_id, date_trunc('hour', ts) AS hour, count(DISTINCT event_type) AS kinds, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS changes FROM events GROUP BY ALL",
)
def change_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct changes of each key in each hour."""
    e = table(spark, folder, "events").groupBy("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"))
    return e.agg(F.count_distinct("event_type").alias("kinds"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("changes"))


def distinct_changes(stream: DataFrame, keys: list[str], watermark: str = "10 minutes") -> DataFrame:
    """Each change once within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def progress_states(stream: DataFrame) -> DataFrame:
    """(path, hash, status, done, total) after each event of (path, hash, status, done, total).

    The same hash keeps what was done, so an interrupted file resumes; a new hash starts over.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ("", "", 0, 0)
        for batch in batches:
            if batch.empty:
                continue
            last = batch.iloc[-1]
            changed = batch["hash"].ne(last["hash"])
            same = batch[changed[::-1].cummax()[::-1].eq(False)]  # the rows since the hash last changed
            before = held if len(same) == len(batch) and held[0] == last["hash"] else ("", "", 0, 0)
            held = (last["hash"], last["status"], max(before[2], int(same["done"].max())), max(before[3], int(same["total"].max())))
        state.update(held)
        yield pd.DataFrame({"path": [key[0]], "hash": [held[0]], "status": [held[1]], "done": [held[2]], "total": [held[3]]})

    out = "path string, hash string, status string, done long, total long"
    return stream.groupBy("path").applyInPandasWithState(step, out, "hash string, status string, done long, total long", "update", GroupStateTimeout.NoTimeout)


def dequeue(queue: DataFrame, n: int) -> DataFrame:
    """The next n entries of (path, priority, seq): a path counts once, as first queued; lower numbers go first."""
    first = Window.partitionBy("path").orderBy("seq")
    return queue.withColumn("_at", F.row_number().over(first)).where("_at = 1").drop("_at").orderBy("priority", "seq").limit(n)


def run_ingest(stream: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Process what has arrived and append it to `target`; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# --- the queue as a control table


class Queue:
    """Entries (path, priority, seq, state) as a frame: each step gives the table after it, which the caller writes.

    A path that is queued or being worked on is not queued again, whatever its new priority; it may be once it
    is complete. A paused queue gives nothing out. Equal priorities go in the order of arrival.
    """

    SCHEMA = "path string, priority int, seq long, state string"

    def __init__(self, entries: DataFrame, paused: bool = False):
        self.entries, self.paused = entries, paused

    @staticmethod
    def empty(spark: SparkSession) -> Queue:
        return Queue(spark.createDataFrame([], Queue.SCHEMA))

    def add(self, arrivals: DataFrame) -> Queue:
        """arrivals: (path, priority, seq); of several for one path the first counts."""
        first = arrivals.groupBy("path").agg(F.min_by("priority", "seq").alias("priority"), F.min("seq").alias("seq"))
        new = first.join(self.entries.select("path"), "path", "left_anti").select("path", F.col("priority").cast("int").alias("priority"), "seq", F.lit("queued").alias("state"))
        return Queue(self.entries.unionByName(new), self.paused)

    def next(self, n: int) -> DataFrame:
        """The n entries that are due."""
        due = self.entries.where("state = 'queued'").orderBy("priority", "seq")
        return due.limit(0 if self.paused else n)

    def taken(self, batch: DataFrame) -> Queue:
        """After a batch was given out: its paths stay known until they are complete."""
        at = batch.select("path", F.lit(True).alias("_out"))
        return Queue(self.entries.join(at, "path", "left").select("path", "priority", "seq", F.when(F.col("_out"), "working").otherwise(F.col("state")).alias("state")), self.paused)

    def complete(self, paths: DataFrame) -> Queue:
        return Queue(self.entries.join(paths.select("path"), "path", "left_anti").select("path", "priority", "seq", "state"), self.paused)

    def pause(self) -> Queue:
        return Queue(self.entries, True)

    def resume(self) -> Queue:
        return Queue(self.entries, False)

    def clear(self) -> Queue:
        return Queue(self.entries.limit(0), self.paused)

    def sizes(self) -> DataFrame:
        """(state, entries, most_urgent)."""
        return self.entries.groupBy("state").agg(F.count("*").alias("entries"), F.min("priority").alias("most_urgent"))


@query(
    "st5_queue",
    """WITH q AS (SELECT o_custkey AS path, min_by(CAST(left(o_orderpriority, 1) AS INTEGER), o_orderkey) AS priority, min(o_orderkey) AS seq FROM orders GROUP BY o_custkey),
      r AS (SELECT *, row_number() OVER (ORDER BY priority, seq) AS spot FROM q) SELECT CAST(path AS VARCHAR) AS path, priority, CASE WHEN spot <= 200 THEN 'working' ELSE 'queued' END AS state FROM r WHERE spot > 100""",
)
def worked_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as arrivals, customers as paths: 200 entries are given out, the first 100 of them completed; what the queue holds then."""
    arrivals = table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderkey").alias("seq"))
    queue = Queue.empty(spark).add(arrivals)
    batch = queue.next(200)
    queue = queue.taken(batch).add(arrivals)
    done = batch.orderBy("priority", "seq").limit(100)
    return queue.complete(done).entries.select("path", "priority", "state")


# --- progress of streams


def counted_reasons(rows: DataFrame, name: str, reason: str, kinds: tuple[str, ...]) -> DataFrame:
    """The rows themselves; how many there are of each reason is observed on the way, at no extra pass."""
    return rows.observe(name, F.count("*").alias("rows"), *[F.count_if(F.col(reason) == k).alias(k) for k in kinds])


class Progress(StreamingQueryListener):
    """Keeps what running streams report: rows in all, rows a second, time left for an expected number, observed counts."""

    def __init__(self, expected: int | None = None):
        self.expected, self.rows, self.seconds, self.batches, self.counts, self.ended = expected, 0, 0.0, 0, {}, False

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.ended = False

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.batches += 1
        self.rows += p.numInputRows
        self.seconds += p.durationMs.get("triggerExecution", 0) / 1000
        for name, row in p.observedMetrics.items():
            held = self.counts.setdefault(name, {})
            for k, v in row.asDict().items():
                held[k] = held.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended = True

    def rate(self) -> float:
        return self.rows / self.seconds if self.seconds else 0.0

    def seconds_left(self) -> float | None:
        return None if self.expected is None or not self.rate() else max(0, self.expected - self.rows) / self.rate()


def run_isolated(stream: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, problem: str = "problem") -> None:
    """Like run_ingest, but an item that fails does not end its batch: `process` fills the column `problem`, and such rows are kept apart."""

    def write(batch: DataFrame, number: int) -> None:
        done = process(batch).persist()
        done.where(F.col(problem).isNull()).drop(problem).write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        done.where(F.col(problem).isNotNull()).write.mode("overwrite").parquet(f"{target}/problems/batch={number}")
        done.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
