"""Chunk quality and completeness of what was processed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import model as m
from lorewell.functions import text as t
from lorewell.operators.ordered import following, places
from lorewell.operators.relational import CLASS_SQL, EXT_SQL, content_class
from lorewell.session import checkpoint

QUERIES, SQL = {}, {}
SENTENCE_END = r"[.!?][\"')\]]*\s*$"
BLANK_PAGE = 50


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def size_bucket(n: str | Column) -> Column:
    c = t.col(n)
    return F.when(c < 100, "tiny").when(c < 500, "small").when(c < 2000, "medium").when(c < 5000, "large").otherwise("huge")


def _classed(spark: SparkSession, folder: str, **facts: Column) -> DataFrame:
    """Chunks with a content, their document's class and extension, and facts about the content; the content stays where it is."""
    c = m.chunks(spark, folder, "document_id", "page", "chunk_index", filled=F.col("content").isNotNull(), **facts).where("filled").drop("filled")
    d = m.documents(spark, folder).select(F.col("doc_id").alias("document_id"), content_class().alias("class"), t.extension("file_path").alias("extension"))
    return c.join(d, "document_id")


_CLASSED_SQL = f"(SELECT c.id, c.document_id, c.content, c.page, c.chunk_index, {CLASS_SQL} AS class, {EXT_SQL} AS extension FROM {m.CHUNKS_SQL} c JOIN documents d ON d.doc_id = c.document_id WHERE c.content IS NOT NULL)"


@query(
    "ag11_chunk_sizes",
    f"""SELECT class, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, min(n) AS least, max(n) AS most, round(coalesce(stddev_samp(n), 0), 4) AS deviation,
      count_if(n < 100) AS tiny, count_if(n >= 100 AND n < 500) AS small, count_if(n >= 500 AND n < 2000) AS medium, count_if(n >= 2000 AND n < 5000) AS large, count_if(n >= 5000) AS huge
      FROM (SELECT class, length(content) AS n FROM {_CLASSED_SQL}) GROUP BY class""",
)
def chunk_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Exact median: sizes are whole numbers, so the aggregate holds counts per size, not rows."""
    c = _classed(spark, folder, n=F.length("content").cast("long")).select("class", "n")
    buckets = [F.count_if(size_bucket("n") == b).alias(b) for b in ("tiny", "small", "medium", "large", "huge")]
    return c.groupBy("class").agg(
        F.count("*").alias("chunks"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"),
        F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 4).alias("deviation"), *buckets,
    )


_ENDS_SQL = rf"""SELECT id, document_id, class, extension, coalesce(page, -1) AS page, chunk_index, regexp_matches(content, '\p{{L}}$') AS ends_letter, regexp_matches(content, '^\p{{L}}') AS starts_letter,
    regexp_matches(content, '[.!?]["'')\]]*\s*$') OR (class = 'markdown' AND regexp_matches(content, '\n\s*$')) OR (class = 'code' AND regexp_matches(content, '[}};:)]\s*$')) AS ends_clean FROM {_CLASSED_SQL}"""
_BOUNDS_SQL = f"""SELECT *, lead(starts_letter) OVER w AS next_letter, lead(id) OVER w AS next_id FROM ({_ENDS_SQL}) WINDOW w AS (PARTITION BY document_id, page ORDER BY chunk_index NULLS LAST, id)"""


def boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """(extension, class, kind) per boundary of neighbouring chunks of a page: clean, mid_word or mid_sentence.

    Only flags are moved, not contents.
    """
    c = F.col("content")
    flags = {
        "ends_letter": c.rlike(r"\p{L}$(?!\n)"), "starts_letter": c.rlike(r"^\p{L}"),
        "ends_sentence": c.rlike(SENTENCE_END), "ends_line": c.rlike(r"\n\s*$"), "ends_block": c.rlike(r"[};:)]\s*$"),
    }
    clean = F.col("ends_sentence") | ((F.col("class") == "markdown") & F.col("ends_line")) | ((F.col("class") == "code") & F.col("ends_block"))
    ends = _classed(spark, folder, **flags).select(
        "id", "document_id", "class", "extension", F.coalesce("page", F.lit(-1)).alias("page"), "chunk_index", "ends_letter", "starts_letter", clean.alias("ends_clean")
    )
    placed = places(ends, ["document_id", "page"], "chunk_index", "id")
    pairs = following(placed, ["document_id", "page"], ["id", "starts_letter"]).where("next_id is not null")
    kind = F.when(F.col("ends_letter") & F.col("next_starts_letter"), "mid_word").when(F.col("ends_clean"), "clean").otherwise("mid_sentence")
    return pairs.select("extension", "class", kind.alias("kind"))


@query(
    "ag12_boundary_coherence",
    f"""SELECT class, count(*) AS boundaries, count_if(kind = 'clean') AS clean, count_if(kind = 'mid_sentence') AS mid_sentence, count_if(kind = 'mid_word') AS mid_word, round(count_if(kind = 'clean') / count(*), 6) AS score
      FROM (SELECT class, CASE WHEN ends_letter AND next_letter THEN 'mid_word' WHEN ends_clean THEN 'clean' ELSE 'mid_sentence' END AS kind FROM ({_BOUNDS_SQL}) WHERE next_id IS NOT NULL) GROUP BY class""",
)
def boundary_coherence(spark: SparkSession, folder: str) -> DataFrame:
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return boundaries(spark, folder).groupBy("class").agg(
        F.count("*").alias("boundaries"), count("clean"), count("mid_sentence"), count("mid_word"), F.round(F.count_if(F.col("kind") == "clean") / F.count("*"), 6).alias("score")
    )


@query(
    "ag13_quality_by_extension",
    f"""SELECT s.extension, chunks, mean, coalesce(score, 1) AS score FROM (SELECT extension, count(*) AS chunks, round(avg(length(content)), 6) AS mean FROM {_CLASSED_SQL} GROUP BY extension) s
      LEFT JOIN (SELECT extension, round(count_if(NOT (ends_letter AND next_letter) AND ends_clean) / count(*), 6) AS score FROM ({_BOUNDS_SQL}) WHERE next_id IS NOT NULL GROUP BY extension) b USING (extension)""",
)
def quality_by_extension(spark: SparkSession, folder: str) -> DataFrame:
    s = _classed(spark, folder, n=F.length("content")).groupBy("extension").agg(F.count("*").alias("chunks"), F.round(F.avg("n"), 6).alias("mean"))
    b = boundaries(spark, folder).groupBy("extension").agg(F.round(F.count_if(F.col("kind") == "clean") / F.count("*"), 6).alias("score"))
    return s.join(b, "extension", "left").select("extension", "chunks", "mean", F.coalesce("score", F.lit(1.0)).alias("score"))


@query("ag16_term_frequencies", r"SELECT term, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(content), '[^\p{L}\p{N}_]+')) AS term FROM " + m.CHUNKS_SQL + ") WHERE length(term) >= 4 GROUP BY term ORDER BY n DESC, term LIMIT 100")
def term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Counted where the texts are; rows delivered n times count 1/n each."""
    rows = m.table(spark, folder, "chunks").where("content is not null").select("id", "content")
    odd = checkpoint(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"))
    few = odd.limit(m.FEW + 1).count() <= m.FEW
    rows = rows.join(F.broadcast(odd) if few else odd, "id", "left").select(F.explode(t.tokens("content")).alias("term"), (1 / F.coalesce("n", F.lit(1))).alias("w"))
    return rows.where(F.length("term") >= 4).groupBy("term").agg(F.round(F.sum("w")).cast("long").alias("n")).orderBy(F.desc("n"), "term").limit(100)


@query("ch7_valid_chunks", rf"SELECT id, length(regexp_replace(regexp_replace(content, '^[\s\p{{Z}}\x1c-\x1f\x85]+', ''), '[\s\p{{Z}}\x1c-\x1f\x85]+$', '')) >= 50 AS valid FROM {m.CHUNKS_SQL} WHERE content IS NOT NULL")
def valid_chunks(spark: SparkSession, folder: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("content", r"^[\s\p{Z}\x1c-\x1f\x85]+", ""), r"[\s\p{Z}\x1c-\x1f\x85]+$", "")
    return m.chunks(spark, folder, valid=F.length(bare) >= 50).where("valid is not null")


# --- completeness


@query("co1_chunk_count", f"SELECT file_path, CASE WHEN total_chunks IS NULL THEN 'ok' WHEN total_chunks = 0 AND chunks_processed = 0 THEN 'zero_chunks' WHEN total_chunks <> chunks_processed THEN 'chunk_count_mismatch' ELSE 'ok' END AS issue FROM {m.PROGRESS_SQL}")
def chunk_count_check(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("total_chunks"), F.col("chunks_processed")
    return m.progress(spark, folder).select("file_path", F.when(a.isNull(), "ok").when((a == 0) & (b == 0), "zero_chunks").when(a != b, "chunk_count_mismatch").otherwise("ok").alias("issue"))


@query("co2_status", f"SELECT file_path, CASE status WHEN 'completed' THEN 'ok' WHEN 'failed' THEN 'ERROR' ELSE 'WARNING' END AS severity FROM {m.PROGRESS_SQL}")
def status_check(spark: SparkSession, folder: str) -> DataFrame:
    return m.progress(spark, folder).select("file_path", F.when(F.col("status") == "completed", "ok").when(F.col("status") == "failed", "ERROR").otherwise("WARNING").alias("severity"))


def vectors_per_document(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, chunks, vectors): counts before the join to documents, so a huge document stays a single row there."""
    c = m.chunks(spark, folder, "document_id").where("document_id is not null")
    v = m.table(spark, folder, "vec_chunks").select(F.col("rowid").alias("id"), F.lit(1).alias("has")).distinct()
    per = c.join(v, "id", "left").groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("chunks"), F.count("has").alias("vectors"))
    zero = F.lit(0).cast("long")
    return m.documents(spark, folder).select("doc_id", "file_path").join(per, "doc_id", "left").select("doc_id", "file_path", F.coalesce("chunks", zero).alias("chunks"), F.coalesce("vectors", zero).alias("vectors"))


_PER_SQL = f"""(SELECT d.doc_id, d.file_path, count(c.id) AS chunks, count(v.rowid) AS vectors FROM documents d LEFT JOIN {m.CHUNKS_SQL} c ON c.document_id = d.doc_id
  LEFT JOIN (SELECT DISTINCT rowid FROM vec_chunks) v ON v.rowid = c.id GROUP BY ALL)"""


@query("co3_chunk_presence", f"SELECT doc_id, chunks, CASE WHEN chunks = 0 THEN 'missing_embeddings' ELSE 'ok' END AS issue FROM {_PER_SQL}")
def chunk_presence(spark: SparkSession, folder: str) -> DataFrame:
    return vectors_per_document(spark, folder).select("doc_id", "chunks", F.when(F.col("chunks") == 0, "missing_embeddings").otherwise("ok").alias("issue"))


@query("co4_embedding_count", f"SELECT doc_id, chunks, vectors FROM {_PER_SQL} WHERE chunks <> vectors")
def embedding_count(spark: SparkSession, folder: str) -> DataFrame:
    return vectors_per_document(spark, folder).where("chunks <> vectors").select("doc_id", "chunks", "vectors")


@query("co5_blank_pages", f"SELECT document_id, page, count(*) AS blank_chunks FROM {m.CHUNKS_SQL} WHERE page > 0 AND document_id IS NOT NULL AND length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) < {BLANK_PAGE} GROUP BY ALL")
def blank_pages(spark: SparkSession, folder: str) -> DataFrame:
    c = m.chunks(spark, folder, "document_id", "page", n=F.length(F.btrim("content", F.lit(" \t\n\r")))).where("page > 0 and document_id is not null")
    return c.where(F.col("n") < BLANK_PAGE).groupBy("document_id", "page").agg(F.count("*").alias("blank_chunks"))


_REPORT_SQL = f"""(SELECT d.doc_id, d.chunks, p.status, p.total_chunks, p.chunks_processed, list_filter([
    CASE WHEN p.status IS NULL THEN 'processing_incomplete' WHEN p.status = 'failed' THEN 'processing_failed' WHEN p.status <> 'completed' THEN 'processing_incomplete' END,
    CASE WHEN p.total_chunks = 0 AND p.chunks_processed = 0 THEN 'zero_chunks' WHEN p.total_chunks <> p.chunks_processed THEN 'chunk_count_mismatch' END,
    CASE WHEN d.chunks = 0 THEN 'missing_embeddings' END], lambda x: x IS NOT NULL) AS issues FROM {_PER_SQL} d LEFT JOIN {m.PROGRESS_SQL} p USING (file_path))"""


def completeness(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, chunks, issues): all issues of each document in one pass."""
    p = m.progress(spark, folder).select("file_path", "status", "total_chunks", "chunks_processed")
    d = vectors_per_document(spark, folder).join(p, "file_path", "left")
    a, b, s = F.col("total_chunks"), F.col("chunks_processed"), F.col("status")
    found = F.array(
        F.when(s.isNull(), "processing_incomplete").when(s == "failed", "processing_failed").when(s != "completed", "processing_incomplete"),
        F.when((a == 0) & (b == 0), "zero_chunks").when(a != b, "chunk_count_mismatch"),
        F.when(F.col("chunks") == 0, "missing_embeddings"),
    )
    return d.select("doc_id", "chunks", F.array_compact(found).alias("issues"))


@query("co8_issues", f"SELECT doc_id, unnest(issues) AS issue FROM {_REPORT_SQL}")
def completeness_issues(spark: SparkSession, folder: str) -> DataFrame:
    return completeness(spark, folder).select("doc_id", F.explode("issues").alias("issue"))


@query("co8_summary", f"SELECT count(*) AS total, count_if(len(issues) = 0) AS complete, count_if(len(issues) > 0) AS incomplete FROM {_REPORT_SQL}")
def completeness_summary(spark: SparkSession, folder: str) -> DataFrame:
    n = F.size("issues")
    return completeness(spark, folder).agg(F.count("*").alias("total"), F.count_if(n == 0).alias("complete"), F.count_if(n > 0).alias("incomplete"))


@query("ma7_to_reindex", f"SELECT doc_id FROM {_REPORT_SQL} WHERE len(list_intersect(issues, ['zero_chunks', 'chunk_count_mismatch', 'missing_embeddings'])) > 0")
def to_reindex(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to index again, by the kinds of issue."""
    wanted = F.array(F.lit("zero_chunks"), F.lit("chunk_count_mismatch"), F.lit("missing_embeddings"))
    return completeness(spark, folder).where(F.arrays_overlap("issues", wanted)).select("doc_id")
