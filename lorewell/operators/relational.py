"""Lookups, joins, aggregations, rankings and set operations over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.functions import model as m
from lorewell.functions import text as t
from lorewell.operators.ordered import following, places

CODE = (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".swift", ".kt", ".scala", ".r", ".jl", ".lua", ".sh", ".bash", ".zsh")
MARKDOWN = (".md", ".markdown", ".rst", ".adoc", ".ipynb")
EXT_SQL = r"lower(regexp_extract(regexp_extract(file_path, '[^/]*$'), '^.+(\.[^.]*)$', 1))"
CLASS_SQL = f"CASE WHEN {EXT_SQL} IN {CODE} THEN 'code' WHEN {EXT_SQL} IN {MARKDOWN} THEN 'markdown' ELSE 'text' END"


def content_class(path: str = "file_path") -> Column:
    """code, markdown or text, by extension."""
    return F.when(t.extension(path).isin(*CODE), "code").when(t.extension(path).isin(*MARKDOWN), "markdown").otherwise("text")


QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# --- lookups and filters


@query("pf1_lookup_by_hash", "SELECT d.doc_id, d.file_path, h.n FROM documents d JOIN (SELECT file_hash, count(*) AS n FROM documents GROUP BY file_hash HAVING count(*) > 1) h USING (file_hash)")
def lookup_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose hash another document has, too."""
    d = m.documents(spark, folder).select("doc_id", "file_path", "file_hash")
    return d.join(d.groupBy("file_hash").agg(F.count("*").alias("n")).where("n > 1"), "file_hash").select("doc_id", "file_path", "n")


@query("pf1_exists", "SELECT DISTINCT l.record_key, d.doc_id IS NOT NULL AS found FROM deletion_log l LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = l.record_key WHERE l.table_name = 'documents'")
def existence(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each logged document key exists."""
    keys = m.table(spark, folder, "deletion_log").where("table_name = 'documents'").select("record_key").distinct()
    d = m.documents(spark, folder).select(F.col("doc_id").cast("string").alias("record_key"), F.lit(True).alias("hit"))
    return keys.join(d, "record_key", "left").select("record_key", F.coalesce("hit", F.lit(False)).alias("found"))


@query("pf2_substring_search", "SELECT doc_id, file_path, indexed_at, row_number() OVER (ORDER BY indexed_at DESC NULLS LAST, doc_id) AS rank FROM documents WHERE file_path LIKE '%notes%' ORDER BY rank LIMIT 50")
def substring_search(spark: SparkSession, folder: str, pattern: str = "%notes%", top: int = 50) -> DataFrame:
    """The newest documents whose path matches a pattern: a top-k, so only k rows meet in one task."""
    found = m.documents(spark, folder).where(F.col("file_path").like(pattern)).select("doc_id", "file_path", "indexed_at")
    found = found.orderBy(F.desc_nulls_last("indexed_at"), "doc_id").limit(top)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("indexed_at"), "doc_id")).cast("long"))


@query("pf2_substring_search_any_case", "SELECT doc_id, file_path FROM documents WHERE file_path ILIKE '%NOTES%'")
def substring_search_any_case(spark: SparkSession, folder: str) -> DataFrame:
    return m.documents(spark, folder).where(F.col("file_path").ilike("%NOTES%")).select("doc_id", "file_path")


@query(
    "pf3_document_info",
    r"""SELECT name, doc_id, coalesce(extraction_method, 'unknown') AS extraction_method FROM (
      SELECT *, row_number() OVER (PARTITION BY name ORDER BY indexed_at DESC NULLS LAST, doc_id) AS r
      FROM (SELECT *, regexp_extract(file_path, '[^/]*$') AS name FROM documents)) WHERE r = 1""",
)
def document_info(spark: SparkSession, folder: str) -> DataFrame:
    """The newest document of each file name."""
    d = m.documents(spark, folder).select(t.file_name("file_path").alias("name"), "doc_id", "indexed_at", "extraction_method")
    newest = Window.partitionBy("name").orderBy(F.desc_nulls_last("indexed_at"), "doc_id")
    d = d.withColumn("r", F.row_number().over(newest)).where("r = 1")
    return d.select("name", "doc_id", F.coalesce("extraction_method", F.lit("unknown")).alias("extraction_method"))


@query("pf5_names", r"SELECT doc_id, regexp_extract(file_path, '[^/]*$') AS name, regexp_replace(regexp_extract(file_path, '[^/]*$'), '^(.+)\.[^.]*$', '\1') AS stem FROM documents")
def names(spark: SparkSession, folder: str) -> DataFrame:
    return m.documents(spark, folder).select("doc_id", t.file_name("file_path").alias("name"), t.stem("file_path").alias("stem"))


@query("pf6_chunks_in_order", f"SELECT document_id, id, row_number() OVER (PARTITION BY document_id, coalesce(page, -1) ORDER BY chunk_index NULLS LAST, id) AS place FROM {m.CHUNKS_SQL} WHERE document_id IS NOT NULL")
def chunks_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of each page of each document in order."""
    return _in_order(spark, folder).select("document_id", "id", (F.col("place") + 1).alias("place"))


def _in_order(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, page, id, place) of chunks with a document; without a page the page is -1."""
    c = m.chunks(spark, folder, "document_id", "page", "chunk_index").where("document_id is not null").withColumn("page", F.coalesce("page", F.lit(-1)))
    return places(c, ["document_id", "page"], "chunk_index", "id")


@query("pf8_by_status", f"SELECT file_path, status, last_updated FROM {m.PROGRESS_SQL} WHERE status IN ('in_progress', 'rejected')")
def by_status(spark: SparkSession, folder: str) -> DataFrame:
    return m.progress(spark, folder).where(F.col("status").isin("in_progress", "rejected")).select("file_path", "status", "last_updated")


@query("pf9_reject_reason", rf"SELECT file_path, regexp_extract(error_message, 'Validation failed \(([^)]*)\)', 1) AS reason FROM {m.PROGRESS_SQL} WHERE status = 'rejected'")
def reject_reason(spark: SparkSession, folder: str) -> DataFrame:
    return m.progress(spark, folder).where("status = 'rejected'").select("file_path", F.regexp_extract("error_message", r"Validation failed \(([^)]*)\)", 1).alias("reason"))


@query("pf10_content_class", f"SELECT {CLASS_SQL} AS class, count(*) AS documents FROM documents GROUP BY ALL")
def content_classes(spark: SparkSession, folder: str) -> DataFrame:
    return m.documents(spark, folder).groupBy(content_class().alias("class")).agg(F.count("*").alias("documents"))


# --- joins


@query("j1_chunks_with_documents", f"SELECT c.id, d.doc_id, d.file_path, c.page, length(c.content) AS size FROM {m.CHUNKS_SQL} c JOIN documents d ON d.doc_id = c.document_id")
def chunks_with_documents(spark: SparkSession, folder: str) -> DataFrame:
    c = m.chunks(spark, folder, "document_id", "page", size=F.length("content").cast("long"))
    d = m.documents(spark, folder).select("doc_id", "file_path")
    return c.join(d, c["document_id"] == d["doc_id"]).select("id", "doc_id", "file_path", "page", "size")


@query("j3_chunks_per_document", f"SELECT d.doc_id, d.file_path, count(c.id) AS chunks FROM documents d LEFT JOIN {m.CHUNKS_SQL} c ON c.document_id = d.doc_id GROUP BY ALL")
def chunks_per_document(spark: SparkSession, folder: str) -> DataFrame:
    """Counted per document before the join, so one huge document is no hot key."""
    d = m.documents(spark, folder).select("doc_id", "file_path")
    return d.join(m.chunk_counts(spark, folder), F.col("doc_id") == F.col("document_id"), "left").select("doc_id", "file_path", F.coalesce("n", F.lit(0)).alias("chunks"))


@query("j4_orphan_chunks", f"SELECT c.id, c.document_id FROM {m.CHUNKS_SQL} c LEFT JOIN documents d ON d.doc_id = c.document_id WHERE d.doc_id IS NULL")
def orphan_chunks(spark: SparkSession, folder: str) -> DataFrame:
    d = m.documents(spark, folder).select(F.col("doc_id").alias("document_id"))
    return m.chunks(spark, folder, "document_id").join(d, "document_id", "left_anti").select("id", "document_id")


@query("j5_orphan_vectors", "SELECT DISTINCT v.rowid AS id FROM vec_chunks v WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.id = v.rowid)")
def orphan_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return m.table(spark, folder, "vec_chunks").select(F.col("rowid").alias("id")).distinct().join(m.table(spark, folder, "chunks").select("id"), "id", "left_anti")


@query("j5_documents_without_chunks", "SELECT doc_id, NOT EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = d.doc_id AND length(c.content) >= 200) AS without FROM documents d")
def documents_with_few_chunks(spark: SparkSession, folder: str, least_size: int = 200) -> DataFrame:
    """Whether a document has no chunk of some size."""
    c = m.table(spark, folder, "chunks").where(F.length("content") >= least_size).select(F.col("document_id").alias("doc_id")).distinct()
    d = m.documents(spark, folder).select("doc_id").join(c.withColumn("has", F.lit(True)), "doc_id", "left")
    return d.select("doc_id", F.col("has").isNull().alias("without"))


def documents_without_chunks(spark: SparkSession, folder: str) -> DataFrame:
    c = m.table(spark, folder, "chunks").select(F.col("document_id").alias("doc_id"))
    return m.documents(spark, folder).select("doc_id").join(c, "doc_id", "left_anti")


@query("j5_orphan_postings", f"SELECT c.id FROM {m.CHUNKS_SQL} c WHERE NOT EXISTS (SELECT 1 FROM vec_chunks v WHERE v.rowid = c.id) AND length(c.content) > 0")
def postings_without_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Indexed chunks that no vector belongs to."""
    c = m.table(spark, folder, "chunks").where(F.length("content") > 0).select("id").distinct()
    return c.join(m.table(spark, folder, "vec_chunks").select(F.col("rowid").alias("id")), "id", "left_anti")


@query("j6_completed_without_document", f"SELECT p.file_path, p.last_updated FROM {m.PROGRESS_SQL} p LEFT JOIN documents d USING (file_path) WHERE p.status = 'completed' AND d.doc_id IS NULL")
def completed_without_document(spark: SparkSession, folder: str) -> DataFrame:
    p = m.progress(spark, folder).where("status = 'completed'").select("file_path", "last_updated")
    return p.join(m.documents(spark, folder).select("file_path"), "file_path", "left_anti")


@query("j7_unreferenced_nodes", f"SELECT node_id, node_type FROM {m.NODES_SQL} WHERE node_type IN ('tag', 'note_ref') AND node_id NOT IN (SELECT target_id FROM graph_edges WHERE target_id IS NOT NULL)")
def unreferenced_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Tags and placeholders that no edge points to. A null target is no reference, so a plain anti join is right."""
    targets = m.table(spark, folder, "graph_edges").select(F.col("target_id").alias("node_id"))
    return m.nodes(spark, folder).where(F.col("node_type").isin("tag", "note_ref")).select("node_id", "node_type").join(targets, "node_id", "left_anti")


@query(
    "j8_progress_with_actual_counts",
    f"""SELECT p.file_path, d.doc_id, CAST((SELECT count(*) FROM {m.CHUNKS_SQL} c WHERE c.document_id = d.doc_id) AS BIGINT) AS actual
      FROM {m.PROGRESS_SQL} p JOIN documents d USING (file_path) WHERE p.total_chunks = 0 AND p.status = 'completed'""",
)
def progress_with_actual_counts(spark: SparkSession, folder: str) -> DataFrame:
    p = m.progress(spark, folder).where("total_chunks = 0 and status = 'completed'").select("file_path")
    d = m.documents(spark, folder).select("doc_id", "file_path")
    return p.join(d, "file_path").join(m.chunk_counts(spark, folder), F.col("doc_id") == F.col("document_id"), "left").select("file_path", "doc_id", F.coalesce("n", F.lit(0)).alias("actual"))


@query("j9_chunk_nodes", f"SELECT l.chunk_id, n.node_id, n.node_type, n.title, l.link_type FROM {m.LINKS_SQL} l JOIN {m.NODES_SQL} n USING (node_id) WHERE l.chunk_id IS NOT NULL")
def chunk_nodes(spark: SparkSession, folder: str) -> DataFrame:
    links = m.links(spark, folder).where("chunk_id is not null").select("chunk_id", "node_id", "link_type")
    return links.join(m.nodes(spark, folder).select("node_id", "node_type", "title"), "node_id").select("chunk_id", "node_id", "node_type", "title", "link_type")


@query("j12_hash_lists", "SELECT doc_id, file_hash FROM documents WHERE file_hash IN (SELECT file_hash FROM documents GROUP BY file_hash HAVING count(*) > 1)")
def hash_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Semi join against a list of hashes."""
    d = m.documents(spark, folder).select("doc_id", "file_hash")
    listed = d.groupBy("file_hash").count().where("count > 1").select("file_hash")
    return d.join(listed, "file_hash", "left_semi").select("doc_id", "file_hash")


@query("j13_valid_and_invalid_vectors", "SELECT rowid AS id, rowid IN (SELECT id FROM chunks) AS valid FROM (SELECT DISTINCT rowid FROM vec_chunks)")
def valid_vectors(spark: SparkSession, folder: str) -> DataFrame:
    v = m.table(spark, folder, "vec_chunks").select(F.col("rowid").alias("id")).distinct()
    c = m.table(spark, folder, "chunks").select("id").distinct().withColumn("valid", F.lit(True))
    return v.join(c, "id", "left").select("id", F.coalesce("valid", F.lit(False)).alias("valid"))


@query("j15_missing_embeddings", f"SELECT c.id FROM {m.CHUNKS_SQL} c WHERE c.id NOT IN (SELECT rowid FROM vec_chunks WHERE rowid IS NOT NULL)")
def missing_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    v = m.table(spark, folder, "vec_chunks").select(F.col("rowid").alias("id"))
    return m.table(spark, folder, "chunks").select("id").distinct().join(v, "id", "left_anti")


# --- aggregations

_COUNTED = {"documents": "doc_id", "chunks": "id", "vec_chunks": "rowid", "graph_nodes": "node_id", "graph_edges": "id", "chunk_graph_links": "id"}


@query("ag1_table_counts", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS delivered, count(DISTINCT {k}) AS records FROM {n}" for n, k in _COUNTED.items()))
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda n, k: m.table(spark, folder, n).agg(F.lit(n).alias("name"), F.count("*").alias("delivered"), F.count_distinct(F.col(k)).alias("records"))
    return reduce(DataFrame.unionByName, (one(n, k) for n, k in _COUNTED.items()))


@query("ag2_documents_by_method", "SELECT coalesce(extraction_method, 'unknown') AS method, count(*) AS documents FROM documents GROUP BY ALL")
def documents_by_method(spark: SparkSession, folder: str) -> DataFrame:
    return m.documents(spark, folder).groupBy(F.coalesce("extraction_method", F.lit("unknown")).alias("method")).agg(F.count("*").alias("documents"))


@query(
    "ag3_size_statistics",
    f"""SELECT round(avg(length(content)), 6) AS avg_size, CAST(sum(length(content)) AS BIGINT) AS total_size, count(*) AS chunks,
      round(count(*) / (SELECT count(*) FROM documents), 6) AS chunks_per_document,
      (SELECT count(*) FROM documents d WHERE d.doc_id NOT IN (SELECT document_id FROM chunks WHERE document_id IS NOT NULL)) AS without_chunks FROM {m.CHUNKS_SQL}""",
)
def size_statistics(spark: SparkSession, folder: str) -> DataFrame:
    size = m.chunks(spark, folder, n=F.length("content"))
    facts = size.agg(F.round(F.avg("n"), 6).alias("avg_size"), F.sum("n").cast("long").alias("total_size"), F.count("*").alias("chunks"))
    whole = m.documents(spark, folder).agg(F.count("*").alias("documents"))
    without = documents_without_chunks(spark, folder).agg(F.count("*").alias("without_chunks"))
    return facts.crossJoin(whole).crossJoin(without).select(  # three single rows
        "avg_size", "total_size", "chunks", F.round(F.col("chunks") / F.col("documents"), 6).alias("chunks_per_document"), "without_chunks"
    )


@query(
    "ag4_duplicates_within_document",
    f"SELECT document_id, sha256(left(content, 30)) AS digest, count(*) AS copies FROM {m.CHUNKS_SQL} WHERE document_id IS NOT NULL AND content IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_openings(spark: SparkSession, folder: str, opening: int = 30) -> DataFrame:
    """Chunks of a document that begin alike, as running headers make them; with whole contents see duplicates_within_document."""
    return duplicates_within_document(spark, folder, F.substring("content", 1, opening))


def duplicates_within_document(spark: SparkSession, folder: str, content: str | Column = "content") -> DataFrame:
    """Grouped by digest, so contents are not shuffled."""
    c = m.table(spark, folder, "chunks").where("document_id is not null and content is not null").select("id", "document_id", F.sha2(t.col(content), 256).alias("digest")).distinct()
    return c.groupBy("document_id", "digest").agg(F.count("*").alias("copies")).where("copies > 1")


@query("ag5_duplicates_across_documents", f"SELECT sha256(content) AS digest, count(DISTINCT document_id) AS documents, count(*) AS copies FROM {m.CHUNKS_SQL} WHERE content IS NOT NULL GROUP BY 1 HAVING count(DISTINCT document_id) > 1 ORDER BY copies DESC, digest LIMIT 10")
def duplicates_across_documents(spark: SparkSession, folder: str) -> DataFrame:
    c = m.table(spark, folder, "chunks").where("content is not null").select("id", "document_id", F.sha2("content", 256).alias("digest")).distinct()
    found = c.groupBy("digest").agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("copies")).where("documents > 1")
    return found.orderBy(F.desc("copies"), "digest").limit(10)


@query(
    "ag6_keep_first",
    f"""WITH c AS (SELECT id, document_id, sha256(left(content, 30)) AS digest FROM {m.CHUNKS_SQL} WHERE document_id IS NOT NULL AND content IS NOT NULL),
      k AS (SELECT document_id, digest, min(id) AS kept FROM c GROUP BY ALL) SELECT c.id, k.kept FROM c JOIN k USING (document_id, digest) WHERE c.id > k.kept""",
)
def first_of_openings(spark: SparkSession, folder: str, opening: int = 30) -> DataFrame:
    """The chunk that stays of those of a document that begin alike."""
    return keep_first(spark, folder, F.substring("content", 1, opening))


def keep_first(spark: SparkSession, folder: str, content: str | Column = "content") -> DataFrame:
    """Chunks that a clean-up removes, and the copy of the same document that stays."""
    c = m.table(spark, folder, "chunks").where("document_id is not null and content is not null").select("id", "document_id", F.sha2(t.col(content), 256).alias("digest")).distinct()
    kept = c.groupBy("document_id", "digest").agg(F.min("id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    return c.join(kept, ["document_id", "digest"]).where("id > kept").select("id", "kept")


@query("ag7_duplicate_paths", "SELECT lower(file_path) AS path, count(*) AS documents FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_paths(spark: SparkSession, folder: str) -> DataFrame:
    return m.documents(spark, folder).groupBy(F.lower("file_path").alias("path")).agg(F.count("*").alias("documents")).where("documents > 1")


@query("ag8_chunk_counts", f"SELECT document_id, count(*) AS chunks, count(page) AS with_page FROM {m.CHUNKS_SQL} GROUP BY document_id")
def counted_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return m.chunks(spark, folder, "document_id", "page").groupBy("document_id").agg(F.count("*").alias("chunks"), F.count("page").alias("with_page"))


@query("ag9_graph_statistics", f"SELECT 'node' AS what, node_type AS type, count(*) AS n FROM {m.NODES_SQL} GROUP BY ALL UNION ALL SELECT 'edge', edge_type, count(*) FROM {m.EDGES_SQL} GROUP BY ALL")
def graph_statistics(spark: SparkSession, folder: str) -> DataFrame:
    n = m.nodes(spark, folder).groupBy(F.col("node_type").alias("type")).agg(F.count("*").alias("n")).withColumn("what", F.lit("node"))
    e = m.edges(spark, folder).groupBy(F.col("edge_type").alias("type")).agg(F.count("*").alias("n")).withColumn("what", F.lit("edge"))
    return n.unionByName(e).select("what", "type", "n")


@query("ag18_counters_by_reason", f"SELECT status, coalesce(regexp_extract(error_message, '\\(([^)]*)\\)', 1), '') AS reason, count(*) AS n FROM {m.PROGRESS_SQL} GROUP BY ALL")
def counters_by_reason(spark: SparkSession, folder: str) -> DataFrame:
    reason = F.coalesce(F.regexp_extract("error_message", r"\(([^)]*)\)", 1), F.lit(""))
    return m.progress(spark, folder).groupBy("status", reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "ag20_embedding_coverage",
    """SELECT (SELECT count(DISTINCT id) FROM chunks) AS chunks, (SELECT count(DISTINCT rowid) FROM vec_chunks) AS vectors,
      (SELECT count(DISTINCT id) FROM chunks WHERE length(content) > 0) AS indexed,
      (SELECT count(DISTINCT id) FROM chunks) - (SELECT count(DISTINCT rowid) FROM vec_chunks) AS difference""",
)
def embedding_coverage(spark: SparkSession, folder: str) -> DataFrame:
    c = m.table(spark, folder, "chunks").agg(F.count_distinct("id").alias("chunks"), F.count_distinct(F.when(F.length("content") > 0, F.col("id"))).alias("indexed"))
    v = m.table(spark, folder, "vec_chunks").agg(F.count_distinct("rowid").alias("vectors"))
    return c.crossJoin(v).select("chunks", "vectors", "indexed", (F.col("chunks") - F.col("vectors")).alias("difference"))  # two single rows


# --- windows, order, sets


@query("w2_next_chunk", f"SELECT id, lead(id) OVER (PARTITION BY document_id, coalesce(page, -1) ORDER BY chunk_index NULLS LAST, id) AS next_id FROM {m.CHUNKS_SQL} WHERE document_id IS NOT NULL")
def next_chunk(spark: SparkSession, folder: str) -> DataFrame:
    return following(_in_order(spark, folder).select("document_id", "page", "id", "place"), ["document_id", "page"], ["id"]).select("id", "next_id")


@query(
    "w3_short_pages",
    f"""WITH p AS (SELECT document_id, page, sum(length(content)) AS size FROM {m.CHUNKS_SQL} WHERE page > 0 AND document_id IS NOT NULL GROUP BY ALL),
      s AS (SELECT document_id, avg(size) AS mean, stddev_pop(size) AS sd, count(*) AS pages FROM p GROUP BY document_id)
      SELECT document_id, page, round((size - mean) / sd, 6) AS z FROM p JOIN s USING (document_id) WHERE pages >= 3 AND sd > 0 AND round((size - mean) / sd, 6) < -2""",
)
def short_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages far shorter than those of their document; the document's mean is an aggregate, not a window, so it combines map-side."""
    c = m.chunks(spark, folder, "document_id", "page", n=F.length("content")).where("page > 0 and document_id is not null")
    p = c.groupBy("document_id", "page").agg(F.sum("n").alias("size"))
    s = p.groupBy("document_id").agg(F.avg("size").alias("mean"), F.stddev_pop("size").alias("sd"), F.count("*").alias("pages")).where("pages >= 3 and sd > 0")
    return p.join(s, "document_id").select("document_id", "page", F.round((F.col("size") - F.col("mean")) / F.col("sd"), 6).alias("z")).where("z < -2")


@query(
    "w4_first_seen",
    f"""SELECT id, source, head FROM (SELECT c.id, regexp_extract(d.file_path, '[^/]*$') AS source, left(c.content, 100) AS head,
      row_number() OVER (PARTITION BY regexp_extract(d.file_path, '[^/]*$'), left(c.content, 100) ORDER BY c.id) AS r
      FROM {m.CHUNKS_SQL} c JOIN documents d ON d.doc_id = c.document_id) WHERE r = 1""",
)
def first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """The first chunk of each (source, first 100 characters)."""
    c = m.table(spark, folder, "chunks").select("id", "document_id", F.substring("content", 1, 100).alias("head"))
    d = m.documents(spark, folder).select(F.col("doc_id").alias("document_id"), t.file_name("file_path").alias("source"))
    return c.join(d, "document_id").groupBy("source", "head").agg(F.min("id").alias("id")).select("id", "source", "head")


@query("s5_priority_order", "SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, row_number() OVER (ORDER BY left(o_orderpriority, 1), o_orderdate, o_orderkey) AS place FROM orders ORDER BY place LIMIT 1000")
def priority_order(spark: SparkSession, folder: str, top: int = 1000) -> DataFrame:
    """The next entries of a priority queue."""
    o = m.table(spark, folder, "orders").select("o_orderkey", "o_orderdate", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"))
    o = o.orderBy("priority", "o_orderdate", "o_orderkey").limit(top)
    return o.select("o_orderkey", "priority", F.row_number().over(Window.orderBy("priority", "o_orderdate", "o_orderkey")).cast("long").alias("place"))


@query("s6_sample_of_empty_documents", "SELECT doc_id, file_path FROM documents d WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = d.doc_id AND length(c.content) >= 200) ORDER BY doc_id LIMIT 50")
def sample_of_empty_documents(spark: SparkSession, folder: str, least_size: int = 200) -> DataFrame:
    """The first documents without a chunk of some size, a top-k."""
    c = m.table(spark, folder, "chunks").where(F.length("content") >= least_size).select(F.col("document_id").alias("doc_id"))
    return m.documents(spark, folder).select("doc_id", "file_path").join(c, "doc_id", "left_anti").orderBy("doc_id").limit(50)


@query("so1_vector_sets", "SELECT 'both' AS part, count(*) AS n FROM (SELECT rowid FROM vec_chunks INTERSECT SELECT id FROM chunks) UNION ALL SELECT 'vectors only', count(*) FROM (SELECT rowid FROM vec_chunks EXCEPT SELECT id FROM chunks) UNION ALL SELECT 'chunks only', count(*) FROM (SELECT id FROM chunks EXCEPT SELECT rowid FROM vec_chunks)")
def vector_sets(spark: SparkSession, folder: str) -> DataFrame:
    v, c = m.table(spark, folder, "vec_chunks").select(F.col("rowid").alias("id")), m.table(spark, folder, "chunks").select("id")
    count = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return count(v.intersect(c), "both").unionByName(count(v.subtract(c), "vectors only")).unionByName(count(c.subtract(v), "chunks only"))


# --- the star schema: parent and child rows as for documents and chunks


@query("st_order_lines", "SELECT o_orderkey, o_orderpriority, count(l_linenumber) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = m.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    o = m.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderpriority", F.coalesce("n", F.lit(0)).alias("lines"), "quantity")
