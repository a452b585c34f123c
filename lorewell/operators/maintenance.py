"""Integrity, clean-up, repair, incremental indexing and replacement of stored rows.

Plain Parquet has no MERGE: a change is a new version built by anti joins and unions, written beside the
old one; a pointer is then switched to it. All functions take and give frames, so a dry run is the same plan, counted.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.functions import model as m
from lorewell.functions import text as t
from lorewell.operators.ordered import places
from lorewell.operators.retrieval import hash_embedding

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_CHECKS_SQL = """SELECT 'orphan_chunks' AS check_name, count(DISTINCT id) AS found FROM chunks WHERE document_id IS NULL OR document_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'orphan_vectors', count(DISTINCT rowid) FROM vec_chunks WHERE rowid NOT IN (SELECT id FROM chunks)
  UNION ALL SELECT 'orphan_links', count(DISTINCT id) FROM chunk_graph_links WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT id FROM chunks)
  UNION ALL SELECT 'chunks_without_vector', count(DISTINCT id) FROM chunks WHERE id NOT IN (SELECT rowid FROM vec_chunks)
  UNION ALL SELECT 'duplicate_paths', count(*) FROM (SELECT file_path FROM documents GROUP BY file_path HAVING count(*) > 1)"""


def integrity_checks(spark: SparkSession, folder: str) -> DataFrame:
    """(check_name, found), one row a check."""
    load = lambda n: m.table(spark, folder, n)
    ids = load("chunks").select("id").distinct()
    docs = load("documents").select(F.col("doc_id").alias("document_id"))
    parts = {
        "orphan_chunks": load("chunks").select("id", "document_id").distinct().join(docs, "document_id", "left_anti"),
        "orphan_vectors": load("vec_chunks").select(F.col("rowid").alias("id")).distinct().join(ids, "id", "left_anti"),
        "orphan_links": load("chunk_graph_links").where("chunk_id is not null").select(F.col("id").alias("link"), F.col("chunk_id").alias("id")).distinct().join(ids, "id", "left_anti"),
        "chunks_without_vector": ids.join(load("vec_chunks").select(F.col("rowid").alias("id")), "id", "left_anti"),
        "duplicate_paths": load("documents").groupBy("file_path").count().where("count > 1"),
    }
    return reduce(DataFrame.unionByName, (df.agg(F.lit(n).alias("check_name"), F.count("*").alias("found")) for n, df in parts.items()))


@query("ma1_integrity", _CHECKS_SQL)
def integrity(spark: SparkSession, folder: str) -> DataFrame:
    return integrity_checks(spark, folder)


@query("ma2_health", f"SELECT sum(found) = 0 AS healthy, count_if(found > 0) AS issues FROM ({_CHECKS_SQL})")
def health(spark: SparkSession, folder: str) -> DataFrame:
    return integrity_checks(spark, folder).agg((F.sum("found") == 0).alias("healthy"), F.count_if(F.col("found") > 0).alias("issues"))


@query(
    "ma3_after_orphan_cleanup",
    """SELECT 'chunks' AS name, count(DISTINCT id) AS kept FROM chunks WHERE document_id IN (SELECT doc_id FROM documents)
      UNION ALL SELECT 'vec_chunks', count(DISTINCT rowid) FROM vec_chunks WHERE rowid IN (SELECT id FROM chunks WHERE document_id IN (SELECT doc_id FROM documents))
      UNION ALL SELECT 'chunk_graph_links', count(DISTINCT id) FROM chunk_graph_links WHERE chunk_id IN (SELECT id FROM chunks WHERE document_id IN (SELECT doc_id FROM documents))
      UNION ALL SELECT 'graph_nodes', count(DISTINCT node_id) FROM graph_nodes WHERE node_type IS NULL OR node_type NOT IN ('tag', 'note_ref') OR node_id IN (SELECT target_id FROM graph_edges WHERE target_id IS NOT NULL)
      UNION ALL SELECT 'documents', count(DISTINCT doc_id) FROM documents WHERE file_path IN (SELECT file_path FROM """ + m.PROGRESS_SQL + ")",
)
def after_orphan_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    """What stays when orphans go, cascading to vectors and links; tags and placeholders need an edge, documents a listed file."""
    load = lambda n: m.table(spark, folder, n)
    kept = load("chunks").select("id", "document_id").distinct().join(load("documents").select(F.col("doc_id").alias("document_id")), "document_id", "left_semi").select("id")
    v = load("vec_chunks").select(F.col("rowid").alias("id")).distinct().join(kept, "id", "left_semi")
    n = load("chunk_graph_links").select(F.col("id").alias("link"), F.col("chunk_id").alias("id")).distinct().join(kept, "id", "left_semi")
    count = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("kept"))
    nodes = m.nodes(spark, folder).select("node_id", F.coalesce(F.col("node_type").isin("tag", "note_ref"), F.lit(False)).alias("loose"))
    held = load("graph_edges").where("target_id is not null").select(F.col("target_id").alias("node_id")).distinct()
    nodes = nodes.where("not loose").unionByName(nodes.where("loose").join(held, "node_id", "left_semi"))
    files = load("documents").select("doc_id", "file_path").join(m.progress(spark, folder).select("file_path"), "file_path", "left_semi")
    parts = (("chunks", kept), ("vec_chunks", v), ("chunk_graph_links", n), ("graph_nodes", nodes), ("documents", files))
    return reduce(DataFrame.unionByName, (count(df, name) for name, df in parts))


@query("ma4_without_empty_documents", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT document_id FROM chunks)")
def without_empty_documents(spark: SparkSession, folder: str) -> DataFrame:
    c = m.table(spark, folder, "chunks").select(F.col("document_id").alias("doc_id"))
    return m.documents(spark, folder).select("doc_id").join(c, "doc_id", "left_semi")


@query(
    "ma5_backfilled_counts",
    f"""SELECT p.file_path, CASE WHEN p.total_chunks = 0 AND p.status = 'completed' AND coalesce(c.n, 0) > 0 THEN c.n ELSE p.total_chunks END AS total_chunks FROM {m.PROGRESS_SQL} p
      LEFT JOIN documents d USING (file_path) LEFT JOIN (SELECT document_id, count(*) AS n FROM {m.CHUNKS_SQL} GROUP BY document_id) c ON c.document_id = d.doc_id""",
)
def backfilled_counts(spark: SparkSession, folder: str) -> DataFrame:
    d = m.documents(spark, folder).select("doc_id", "file_path").join(m.chunk_counts(spark, folder), F.col("doc_id") == F.col("document_id"), "left").select("file_path", "n")
    p = m.progress(spark, folder).join(d, "file_path", "left")
    wrong = (F.col("total_chunks") == 0) & (F.col("status") == "completed") & (F.coalesce("n", F.lit(0)) > 0)
    return p.select("file_path", F.when(wrong, F.col("n")).otherwise(F.col("total_chunks")).alias("total_chunks"))


@query("ma6_orphan_repair_queue", f"SELECT p.file_path, 1 AS priority FROM {m.PROGRESS_SQL} p WHERE p.status = 'completed' AND p.file_path NOT IN (SELECT file_path FROM documents) AND p.file_path NOT LIKE '%.epub'")
def orphan_repair_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Finished files without a document go back into the queue with high priority; converted books don't."""
    p = m.progress(spark, folder).where("status = 'completed' and file_path not like '%.epub'").select("file_path")
    return p.join(m.documents(spark, folder).select("file_path"), "file_path", "left_anti").select("file_path", F.lit(1).alias("priority"))


@query("ma8_path_reindex", "SELECT doc_id, file_path FROM documents WHERE starts_with(file_path, 'kb/vault-')")
def path_reindex(spark: SparkSession, folder: str, prefix: str = "kb/vault-") -> DataFrame:
    """Documents below a folder, to be deleted and queued again."""
    return m.documents(spark, folder).where(F.col("file_path").startswith(prefix)).select("doc_id", "file_path")


def rebuilt_vectors(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], at: Column) -> DataFrame:
    """(rowid, embedding, embedded_at): the whole table of vectors made anew of (id, content), of length 1; rows delivered twice give one."""
    made = embed(chunks.where("content is not null").select("id", "content")).dropDuplicates(["id"])
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(norm > 0, F.transform("embedding", lambda x: (x / norm).cast("float"))).otherwise(F.col("embedding"))
    return made.select(F.col("id").alias("rowid"), unit.alias("embedding"), at.alias("embedded_at"))


@query("ma9_rebuilt_vectors", "SELECT count(DISTINCT id) AS vectors, 64 AS dimensions, true AS of_unit_length, count(DISTINCT id) AS indexed FROM chunks WHERE content IS NOT NULL")
def rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors and word index rebuilt from the stored chunks, checked."""
    rows = m.table(spark, folder, "chunks").select("id", "content")
    v = rebuilt_vectors(rows, hash_embedding, F.current_timestamp())
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    facts = v.agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dimensions"), F.bool_and((norm == 0) | (F.abs(norm - 1) < 1e-5)).alias("of_unit_length"))
    index = m.chunks(spark, folder, words=F.size(t.tokens("content"))).where("words >= 0").agg(F.count("*").alias("indexed"))
    return facts.crossJoin(index)  # single rows


@query("ma10_partial_rebuild", "WITH b AS (SELECT median(rowid) AS mid FROM (SELECT DISTINCT rowid FROM vec_chunks)) SELECT rowid AS id, rowid <= (SELECT mid FROM b) AS rebuilt FROM (SELECT DISTINCT rowid FROM vec_chunks)")
def partial_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a range of ids replaced, the others kept: the lower half here."""
    v = m.table(spark, folder, "vec_chunks").select(F.col("rowid").alias("id")).distinct()
    middle = v.agg(F.percentile("id", F.lit(0.5)).alias("mid"))
    return v.crossJoin(F.broadcast(middle)).select("id", (F.col("id") <= F.col("mid")).alias("rebuilt"))  # one number


@query("ma11_vectors_after_rebuild", "SELECT DISTINCT rowid AS id FROM vec_chunks WHERE rowid IN (SELECT id FROM chunks)")
def vectors_after_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    ids = m.table(spark, folder, "chunks").select("id")
    return m.table(spark, folder, "vec_chunks").select(F.col("rowid").alias("id")).distinct().join(ids, "id", "left_semi")


@query(
    "ma12_self_healing",
    f"""SELECT 'empty_documents' AS step, count(*) AS rows FROM documents WHERE doc_id NOT IN (SELECT document_id FROM chunks WHERE document_id IS NOT NULL)
      UNION ALL SELECT 'counts_to_fill', count(*) FROM {m.PROGRESS_SQL} p JOIN documents d USING (file_path) WHERE p.total_chunks = 0 AND p.status = 'completed' AND d.doc_id IN (SELECT document_id FROM chunks)""",
)
def self_healing(spark: SparkSession, folder: str) -> DataFrame:
    c = m.table(spark, folder, "chunks").select(F.col("document_id").alias("doc_id")).distinct()
    d = m.documents(spark, folder).select("doc_id", "file_path")
    p = m.progress(spark, folder).where("total_chunks = 0 and status = 'completed'").select("file_path")
    count = lambda df, step: df.agg(F.lit(step).alias("step"), F.count("*").alias("rows"))
    return count(d.join(c, "doc_id", "left_anti"), "empty_documents").unionByName(count(d.join(p, "file_path").join(c, "doc_id", "left_semi"), "counts_to_fill"))


@query("ma13_resume", f"SELECT file_path, CASE WHEN file_path IN (SELECT file_path FROM documents) THEN 'high' ELSE 'failed' END AS next FROM {m.PROGRESS_SQL} WHERE status = 'in_progress'")
def resume(spark: SparkSession, folder: str) -> DataFrame:
    """Unfinished files: queued again if they still exist, failed if not."""
    there = m.documents(spark, folder).select("file_path", F.lit(True).alias("there"))
    p = m.progress(spark, folder).where("status = 'in_progress'").select("file_path").join(there, "file_path", "left")
    return p.select("file_path", F.when(F.col("there"), "high").otherwise("failed").alias("next"))


@query("ma14_statistics", f"SELECT coalesce(d.source, '') AS source, count(DISTINCT d.doc_id) AS documents, count(c.id) AS chunks, CAST(coalesce(sum(length(c.content)), 0) AS BIGINT) AS size FROM documents d LEFT JOIN {m.CHUNKS_SQL} c ON c.document_id = d.doc_id GROUP BY ALL")
def statistics(spark: SparkSession, folder: str) -> DataFrame:
    c = m.chunks(spark, folder, "document_id", size=F.length("content")).groupBy("document_id").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    d = m.documents(spark, folder).select("doc_id", F.coalesce("source", F.lit("")).alias("source")).join(c, F.col("doc_id") == F.col("document_id"), "left")
    total = lambda k: F.coalesce(F.sum(k), F.lit(0)).cast("long")
    return d.groupBy("source").agg(F.count("*").alias("documents"), total("n").alias("chunks"), total("s").alias("size"))


# --- sinks and mutations


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """Stored rows with `rows` put in by key; with `newest`, of several rows for a key the newest wins."""
    if newest is None:
        return stored.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(newest))
    return stored.unionByName(rows).withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def chunk_id(path: str | Column, index: str | Column) -> Column:
    """Identifiers that need no sequence: the same file and position give the same id."""
    return F.xxhash64(t.col(path), t.col(index))


def replace_documents(documents: DataFrame, chunks: DataFrame, new_documents: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after documents with the same path were replaced, their chunks included."""
    old = documents.join(new_documents.select("file_path"), "file_path", "left_semi").select("doc_id")
    kept = chunks.join(old.withColumnRenamed("doc_id", "document_id"), "document_id", "left_anti")
    return upsert(documents, new_documents, ["file_path"]), kept.unionByName(new_chunks)


@query(
    "sk3_cascade_delete",
    """WITH gone AS (SELECT DISTINCT record_key AS k FROM deletion_log WHERE table_name = 'documents'), d AS (SELECT doc_id FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT k FROM gone)),
      c AS (SELECT DISTINCT id FROM chunks WHERE document_id IN (SELECT doc_id FROM d))
      SELECT (SELECT count(*) FROM d) AS documents_deleted, (SELECT count(*) FROM c) AS chunks_deleted, (SELECT count(DISTINCT rowid) FROM vec_chunks WHERE rowid IN (SELECT id FROM c)) AS vectors_deleted""",
)
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """What deleting the logged documents takes along."""
    gone = m.table(spark, folder, "deletion_log").where("table_name = 'documents'").select(F.col("record_key").alias("k")).distinct()
    d = m.documents(spark, folder).select("doc_id").join(gone, F.col("doc_id").cast("string") == F.col("k"), "left_semi")
    c = m.table(spark, folder, "chunks").select("id", "document_id").distinct().join(d, F.col("document_id") == F.col("doc_id"), "left_semi").select("id")
    v = m.table(spark, folder, "vec_chunks").select(F.col("rowid").alias("id")).distinct().join(c, "id", "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(d, "documents_deleted").crossJoin(count(c, "chunks_deleted")).crossJoin(count(v, "vectors_deleted"))  # single rows


@query(
    "sk4_latest_wins",
    "SELECT table_name, record_key, max(deleted_at) AS deleted_at, count(*) AS times FROM (SELECT DISTINCT * FROM deletion_log) GROUP BY ALL",
)
def latest_deletion(spark: SparkSession, folder: str) -> DataFrame:
    return m.table(spark, folder, "deletion_log").distinct().groupBy("table_name", "record_key").agg(F.max("deleted_at").alias("deleted_at"), F.count("*").alias("times"))


@query("sk5_document_records", f"SELECT d.doc_id, coalesce(c.n, 0) AS chunks, c.n IS NULL AS empty FROM documents d LEFT JOIN (SELECT document_id, count(*) AS n FROM {m.CHUNKS_SQL} GROUP BY document_id) c ON c.document_id = d.doc_id")
def document_records(spark: SparkSession, folder: str) -> DataFrame:
    """A record for every document, also for those that gave no chunk."""
    d = m.documents(spark, folder).select("doc_id").join(m.chunk_counts(spark, folder), F.col("doc_id") == F.col("document_id"), "left")
    return d.select("doc_id", F.coalesce("n", F.lit(0)).alias("chunks"), F.col("n").isNull().alias("empty"))


@query("sk6_remapped_ids", "WITH r AS (SELECT doc_id, file_path, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS new_id FROM documents) SELECT * FROM r")
def remapped_ids(spark: SparkSession, folder: str) -> DataFrame:
    """New ids per source, as a migration gives them."""
    d = m.documents(spark, folder).select("doc_id", "file_path", F.coalesce("source", F.lit("")).alias("group"), F.floor(F.col("doc_id") / 256).alias("index"))
    return places(d, ["group"], "index", "doc_id").select("doc_id", "file_path", (F.col("place") + 1).alias("new_id"))


POINTER = "CURRENT"


def write_snapshot(df: DataFrame, path: str, keep: int = 2) -> str:
    """Write a new version of a table and switch to it; gives the version's name.

    Versions are folders of their own and never change. The pointer names the current one; it is replaced by
    one rename over itself, so a reader sees the old or the new version and never none. Older versions than
    the last `keep` are deleted, which readers that began earlier still need until then.
    """
    fs, as_path, jvm = _file_system(df.sparkSession, path)
    numbers = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(as_path(path)) if s.getPath().getName().startswith("v")) if fs.exists(as_path(path)) else []
    name = f"v{numbers[-1] + 1 if numbers else 1:08d}"
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    part = as_path(f"{path}/{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(name, "ascii"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else as_path("file:///").toUri(), df.sparkSession._jsc.hadoopConfiguration())
    options = df.sparkSession.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, as_path(f"{path}/{POINTER}"), options)
    for old in numbers[: max(0, len(numbers) + 1 - keep)]:
        fs.delete(as_path(f"{path}/v{old:08d}"), True)
    return name


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table."""
    name = "".join(r.value for r in spark.read.text(f"{path}/{POINTER}").collect())
    return spark.read.parquet(f"{path}/{name}")


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    as_path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return as_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), as_path, jvm


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)


def move_to_quarantine(files: list[str], folder: str) -> list[str]:
    """Move files of this machine into the quarantine folder; the rows of the list are what the report names."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for file in files:
        target = os.path.join(folder, os.path.basename(file))
        shutil.move(file, target)
        out.append(target)
    return out


# --- incremental indexing


@query("st7_already_indexed", "SELECT p.file_path, p.file_hash FROM " + m.PROGRESS_SQL + " p WHERE p.file_hash NOT IN (SELECT file_hash FROM documents WHERE indexed_at IS NOT NULL AND file_hash IS NOT NULL)")
def not_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are not skipped, since no indexed document has their hash."""
    done = m.documents(spark, folder).where("indexed_at is not null").select("file_hash")
    return m.progress(spark, folder).select("file_path", "file_hash").join(done, "file_hash", "left_anti").select("file_path", "file_hash")


@query(
    "st9_progress_state",
    """SELECT user_id, max_by(event_type, {'a': ts, 'b': event_id}) AS state, count(*) AS events, min(ts) AS started, max(ts) AS last_updated FROM events GROUP BY user_id""",
)
def progress_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state of each key after all its events: the latest wins."""
    e = m.table(spark, folder, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("last_updated"))


@query("st10_moved_files", f"SELECT d.doc_id, d.file_path AS old_path, p.file_path AS new_path FROM documents d JOIN {m.PROGRESS_SQL} p USING (file_hash) WHERE p.file_path NOT IN (SELECT file_path FROM documents) AND d.file_path NOT IN (SELECT file_path FROM {m.PROGRESS_SQL})")
def moved_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a new listing with the hash of a stored one whose path is gone."""
    p, d = m.progress(spark, folder).select("file_path", "file_hash"), m.documents(spark, folder).select("doc_id", "file_path", "file_hash")
    new = p.join(d.select("file_path"), "file_path", "left_anti").select(F.col("file_path").alias("new_path"), "file_hash")
    gone = d.join(p.select("file_path"), "file_path", "left_anti")
    return gone.join(new, "file_hash").select("doc_id", F.col("file_path").alias("old_path"), "new_path")
