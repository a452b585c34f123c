"""The stored tables as frames: rows delivered twice count once, and a progress table derived from documents.

The test tables hold no progress of processing; a fixed rule on doc_id stands in for it, the same in PROGRESS_SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.session import checkpoint, table

FEW = 1_000_000  # keys of a broadcast, 16 MB

CHUNKS_SQL = "(SELECT DISTINCT * FROM chunks)"
VECTORS_SQL = "(SELECT DISTINCT rowid AS rid, embedded_at FROM vec_chunks)"
NODES_SQL = "(SELECT DISTINCT * FROM graph_nodes)"
EDGES_SQL = "(SELECT DISTINCT * FROM graph_edges)"
LINKS_SQL = "(SELECT DISTINCT * FROM chunk_graph_links)"

PROGRESS_SQL = f"""(
  SELECT CASE WHEN d.doc_id % 17 = 0 THEN 'lost/' || d.file_path ELSE d.file_path END AS file_path, d.file_hash,
    CASE WHEN d.doc_id % 13 = 0 THEN NULL WHEN d.doc_id % 5 = 0 THEN 0 ELSE coalesce(c.n, 0) END AS total_chunks,
    CASE WHEN d.doc_id % 7 = 0 THEN 0 ELSE coalesce(c.n, 0) END AS chunks_processed,
    CASE d.doc_id % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'rejected' ELSE 'completed' END AS status,
    CASE d.doc_id % 11 WHEN 0 THEN 'Extraction error (page 1)'
      WHEN 2 THEN 'Validation failed (' || CASE d.doc_id % 3 WHEN 0 THEN 'FileSizeStrategy' WHEN 1 THEN 'YARAStrategy' ELSE 'ArchiveBombStrategy' END || '): see log' END AS error_message,
    d.indexed_at AS last_updated
  FROM documents d LEFT JOIN (SELECT document_id, count(*) AS n FROM {CHUNKS_SQL} GROUP BY document_id) c ON c.document_id = d.doc_id
  WHERE d.doc_id % 19 <> 0)"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def chunks(spark: SparkSession, folder: str, *columns: str, **computed: Column) -> DataFrame:
    """Distinct chunk rows; ids are unique after that, so hashing the id alone is enough.

    `computed` columns are taken in the scan's stage, so that a length or a flag is moved and not the text.
    """
    rows = table(spark, folder, "chunks")
    return rows.select("id", *[c for c in columns if c != "id"], *[c.alias(n) for n, c in computed.items()]).dropDuplicates(["id"])


def texts_of(spark: SparkSession, folder: str, ids: DataFrame, *columns: str) -> DataFrame:
    """(id, content, columns) of the named chunks: the ids travel to the texts if they are few, else both meet by id."""
    ids = checkpoint(ids.select("id").distinct())
    few = ids.limit(FEW + 1).count() <= FEW
    rows = table(spark, folder, "chunks").select("id", "content", *columns)
    return rows.join(F.broadcast(ids) if few else ids, "id", "left_semi").dropDuplicates(["id"])


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "vec_chunks").dropDuplicates(["rowid"])


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graph_nodes").dropDuplicates(["node_id"])


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graph_edges").dropDuplicates(["id"])


def links(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunk_graph_links").dropDuplicates(["id"])


def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, n)."""
    return chunks(spark, folder, "document_id").groupBy("document_id").agg(F.count("*").alias("n"))


def progress(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder).select("doc_id", "file_path", "file_hash", "indexed_at").where("doc_id % 19 <> 0")
    rest = F.col("doc_id") % 11
    n = F.coalesce("n", F.lit(0)).cast("long")
    check = F.when(F.col("doc_id") % 3 == 0, "FileSizeStrategy").when(F.col("doc_id") % 3 == 1, "YARAStrategy").otherwise("ArchiveBombStrategy")
    return d.join(chunk_counts(spark, folder), F.col("doc_id") == F.col("document_id"), "left").select(
        F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("lost/"), "file_path")).otherwise(F.col("file_path")).alias("file_path"),
        "file_hash",
        F.when(F.col("doc_id") % 13 == 0, None).when(F.col("doc_id") % 5 == 0, 0).otherwise(n).cast("long").alias("total_chunks"),
        F.when(F.col("doc_id") % 7 == 0, 0).otherwise(n).cast("long").alias("chunks_processed"),
        F.when(rest == 0, "failed").when(rest == 1, "in_progress").when(rest == 2, "rejected").otherwise("completed").alias("status"),
        F.when(rest == 0, "Extraction error (page 1)").when(rest == 2, F.concat(F.lit("Validation failed ("), check, F.lit("): see log"))).alias("error_message"),
        F.col("indexed_at").alias("last_updated"),
    )
