"""References whose target is absent, deleted or stored later (problem 4).

Integer parent keys are compressed into runs of consecutive keys. A run never crosses the edge of a
key block, so the run that precedes a reference lies in the reference's own block: the as-of match is
a window over one block of bounded size, and a reference beyond the end of that run has no target.
References are first reduced to one row per key, which makes the work independent of how often a
single parent is referred to. String keys have no order to compress and are matched by hash.

Defined results: a null key is no reference; rows delivered twice count once; an empty parent table
makes every reference an orphan; a null time of either side is never late and has period `unknown`;
columns of the inputs other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.session import checkpoint, table

KEY_BLOCK = 1 << 15
ROWS_A_SALT, FEW = 100_000, 1_000_000


@dataclass(frozen=True)
class Reference:
    """A referring column and the key it must find."""

    name: str
    row_id: str
    key: str
    at: str
    parent: str
    parent_key: str
    parent_at: str
    log_name: str


REFERENCES = (
    Reference("chunks", "id", "document_id", "created_at", "documents", "doc_id", "indexed_at", "documents"),
    Reference("vec_chunks", "rowid", "rowid", "embedded_at", "chunks", "id", "created_at", "chunks"),
    Reference("chunk_graph_links", "id", "chunk_id", "created_at", "chunks", "id", "created_at", "chunks"),
    Reference("graph_edges", "id", "target_id", "created_at", "graph_nodes", "node_id", "created_at", "graph_nodes"),
)


def parent_runs(parents: DataFrame, key: str, block: int = KEY_BLOCK) -> DataFrame:
    """(block, run_start, run_end) of the distinct integer keys, cut at multiples of `block`."""
    keys = parents.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k")).distinct()
    keys = keys.withColumn("block", F.floor(F.col("k") / block))
    island = F.col("k") - F.row_number().over(Window.partitionBy("block").orderBy("k"))
    return (
        keys.withColumn("island", island)
        .groupBy("block", "island")
        .agg(F.min("k").alias("run_start"), F.max("k").alias("run_end"))
        .drop("island")
    )


def asof_present(keys: DataFrame, runs: DataFrame, block: int = KEY_BLOCK) -> DataFrame:
    """`keys` (one row per key `k`) with `present`: whether the run that starts at or before k reaches it."""
    refs = keys.withColumn("block", F.floor(F.col("k") / block)).withColumn("run_end", F.lit(None).cast("long"))
    starts = runs.select("block", F.col("run_start").alias("k"), "run_end")
    both = refs.withColumn("is_ref", F.lit(1)).unionByName(starts.withColumn("is_ref", F.lit(0)), allowMissingColumns=True)
    # The start of a run sorts before a reference to the same key.
    before = Window.partitionBy("block").orderBy("k", "is_ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        both.withColumn("run_end", F.last("run_end", ignorenulls=True).over(before))
        .where("is_ref = 1")
        .withColumn("present", F.coalesce(F.col("k") <= F.col("run_end"), F.lit(False)))
        .drop("is_ref", "run_end", "block")
    )


def orphan_references(children: DataFrame, parents: DataFrame, deletions: DataFrame, ref: Reference) -> DataFrame:
    """(table_name, row_id, kind, period), one row per affected reference of one referring column."""
    rows = children.select(
        F.col(ref.row_id).alias("row_id"), F.col(ref.key).alias("k"), F.col(ref.at).cast("timestamp").alias("at")
    ).where("k is not null")
    owners = parents.select(F.col(ref.parent_key).alias("k"), F.col(ref.parent_at).cast("timestamp").alias("parent_at"))
    owners = owners.where("k is not null").groupBy("k").agg(F.min("parent_at").alias("parent_at"))
    keys = rows.groupBy("k").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    if dict(children.dtypes)[ref.key] in ("string",):
        matched = keys.join(owners.select("k", F.lit(True).alias("hit")), "k", "left").withColumn(
            "present", F.coalesce("hit", F.lit(False))
        ).drop("hit")
    else:
        matched = asof_present(keys.withColumn("k", F.col("k").cast("long")), parent_runs(owners, "k"))
    gone = (
        deletions.where((F.col("table_name") == ref.log_name) & F.col("record_key").isNotNull())
        .select(F.col("record_key").alias("log_key")).distinct()
    )
    absent = (
        matched.where(~F.col("present"))
        .join(gone, F.col("k").cast("string") == F.col("log_key"), "left")
        .select("k", "n", F.when(F.col("log_key").isNull(), "missing").otherwise("deleted").alias("kind"), F.lit(None).cast("timestamp").alias("parent_at"))
    )
    late = (
        matched.where(F.col("present"))
        .join(owners, "k")
        .where(F.col("parent_at") > F.col("first_at"))
        .select("k", "n", F.lit("late").alias("kind"), "parent_at")
    )
    # A key may have most of the rows: its verdict is repeated per salt and its rows are spread over the salts,
    # one for each ROWS_A_SALT rows. Only keys with more rows than that are looked up, at most one in so many rows.
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / ROWS_A_SALT)).cast("int")
    crowded = checkpoint(keys.where(F.col("n") > ROWS_A_SALT).select("k", salts.alias("salts")))
    few = crowded.limit(FEW + 1).count() <= FEW
    verdicts = absent.unionByName(late).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    salted = rows.join(F.broadcast(crowded) if few else crowded, "k", "left").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    return (
        salted.join(verdicts, ["k", "salt"])
        .where((F.col("kind") != "late") | (F.col("parent_at") > F.col("at")))
        .select(
            F.lit(ref.name).alias("table_name"),
            F.col("row_id").cast("long").alias("row_id"),
            "kind",
            F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")).alias("period"),
        )
        .distinct()
    )


def all_orphans(spark: SparkSession, folder: str, references=REFERENCES) -> DataFrame:
    """The affected references of every referring column."""
    load = lambda name: table(spark, folder, name)
    parts = [orphan_references(load(r.name), load(r.parent), load("deletion_log"), r) for r in references]
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return all_orphans(spark, folder)


def p4_orphans_by_period(spark: SparkSession, folder: str) -> DataFrame:
    """Affected references counted per table, kind and month."""
    return all_orphans(spark, folder).groupBy("table_name", "kind", "period").agg(F.count("*").alias("references"))


_SQL_FOUND = """
WITH refs AS (
  SELECT DISTINCT 'chunks' AS t, id AS row_id, CAST(document_id AS VARCHAR) AS k, created_at AS at, 'documents' AS p FROM chunks WHERE document_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'vec_chunks', rowid, CAST(rowid AS VARCHAR), embedded_at, 'chunks' FROM vec_chunks WHERE rowid IS NOT NULL
  UNION ALL SELECT DISTINCT 'chunk_graph_links', id, CAST(chunk_id AS VARCHAR), created_at, 'chunks' FROM chunk_graph_links WHERE chunk_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'graph_edges', id, target_id, created_at, 'graph_nodes' FROM graph_edges WHERE target_id IS NOT NULL
), owners AS (
  SELECT 'documents' AS p, CAST(doc_id AS VARCHAR) AS k, min(indexed_at) AS pat FROM documents GROUP BY doc_id
  UNION ALL SELECT 'chunks', CAST(id AS VARCHAR), min(created_at) FROM chunks GROUP BY id
  UNION ALL SELECT 'graph_nodes', node_id, min(created_at) FROM graph_nodes GROUP BY node_id
), gone AS (SELECT DISTINCT table_name AS p, record_key AS k FROM deletion_log)
SELECT DISTINCT r.t AS table_name, r.row_id AS row_id,
  CASE WHEN o.k IS NULL AND g.k IS NOT NULL THEN 'deleted' WHEN o.k IS NULL THEN 'missing' ELSE 'late' END AS kind,
  coalesce(strftime(r.at, '%Y-%m'), 'unknown') AS period
FROM refs r LEFT JOIN owners o ON o.p = r.p AND o.k = r.k LEFT JOIN gone g ON g.p = r.p AND g.k = r.k
WHERE o.k IS NULL OR o.pat > r.at
"""

QUERIES = {"p4_found": p4_found, "p4_orphans_by_period": p4_orphans_by_period}
SQL = {
    "p4_found": _SQL_FOUND,
    "p4_orphans_by_period": f'SELECT table_name, kind, period, count(*) AS "references" FROM ({_SQL_FOUND}) GROUP BY ALL',
}
