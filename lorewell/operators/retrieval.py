"""The query algebra: vector search, BM25 with title boost, rank fusion, decomposition, suggestions, metrics.

Queries come as a frame, never one by one. Rows and queries meet in blocks: a dense matrix product for
vectors, a sparse one for words, and only the best of each query leave a block. Texts are read twice (document
frequencies; postings of the terms that some query has) and are never moved: a row delivered n times counts
1/n, a row without a document 0, and only these exceptions are looked up.

Ties are broken by the lower chunk id and scores are ranked as rounded (6 places; 9 for fused scores).
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.functions import model as m
from lorewell.functions import text as t
from lorewell.operators.relational import CLASS_SQL, content_class
from lorewell.session import checkpoint

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 20
TOP, DEEP = 10, 40
QUERY_STEP = 20
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 4_096
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# --- vectors


def usable_vectors(rows: DataFrame, id_col: str = "rowid", dimensions: int = 64) -> DataFrame:
    """(id, v): vectors of the right length without nulls, NaN, infinities, and not all zero; one row an id."""
    v = F.col("embedding")
    fine = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).dropDuplicates(["id"])


def _block_product(top: int):
    def compare(block: pa.Table) -> pa.Table:
        member = block.column("member").to_numpy(zero_copy_only=False)
        sides = []
        for own in (member, ~member):
            part = block.filter(pa.array(own)).sort_by("id")
            x = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1) if part.num_rows else np.zeros((0, 1))
            sides.append((part.column("id").to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x))
        (ids, rows), (qids, asked) = sides
        out: list[np.ndarray] = []
        for lo in range(0, len(qids), 256) if len(ids) else ():
            cosine = np.round(asked[lo : lo + 256] @ rows.T, 12)
            score = np.round((1 + cosine) / 2, 6)
            score[qids[lo : lo + 256][:, None] == ids[None, :]] = -1
            k = min(top, len(ids))
            kth = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
            above, equal = score > kth, score == kth  # of equal scores the lowest ids, which come first
            q, r = np.nonzero((above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))) & (score >= 0))
            out.append(np.stack([qids[lo + q].astype(np.float64), ids[r].astype(np.float64), cosine[q, r]]))
        q, r, c = np.concatenate(out, axis=1) if out else np.zeros((3, 0))
        return pa.table({"query_id": q.astype(np.int64), "id": r.astype(np.int64), "cosine": c})

    return compare


def exact_nearest(vectors: DataFrame, asked: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, id, score, rank) of every asked vector (id, v) against all vectors; score = (1 + cosine) / 2.

    Rows and queries are dealt to a grid of blocks by hash; each cell of the grid keeps its best.
    """
    vectors, asked = checkpoint(vectors.select("id", "v")), checkpoint(asked.select("id", "v"))
    n, q = vectors.count(), asked.count()
    row_blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-q // BLOCK_QUERIES))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int").alias("r")).withColumn("q", every(query_blocks)).withColumn("member", F.lit(True))
    asks = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("q")).withColumn("r", every(row_blocks)).withColumn("member", F.lit(False))
    compare = _block_product(top)

    def block(cell: pa.Table) -> pa.Table:
        return compare(cell)

    met = rows.unionByName(asks).groupBy("r", "q").applyInArrow(block, "query_id long, id long, cosine double")
    met = met.withColumn("score", F.round((1 + F.col("cosine")) / 2, 6)).drop("cosine")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)


_USABLE_SQL = """SELECT DISTINCT rowid AS id, CAST(embedding AS DOUBLE[]) AS v FROM vec_chunks WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""
_NEAREST_SQL = f"""u AS ({_USABLE_SQL}), near AS (SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT a.id AS query_id, b.id, round((1 + round(list_cosine_similarity(a.v, b.v), 12)) / 2, 6) AS score FROM u a JOIN u b ON a.id <> b.id WHERE a.id % {QUERY_STEP} = 0)) WHERE rank <= {TOP})"""


@query("qx1_exact_nearest", f"WITH {_NEAREST_SQL} SELECT * FROM near")
def nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all."""
    v = checkpoint(usable_vectors(m.table(spark, folder, "vec_chunks")))
    return exact_nearest(v, v.where(F.col("id") % QUERY_STEP == 0))


@query("qx1_legacy_scale", f"WITH {_NEAREST_SQL} SELECT query_id, id, round(2 * score - 1, 5) AS score FROM near")
def legacy_scale(spark: SparkSession, folder: str) -> DataFrame:
    """The same search on the other scale, 1 - distance."""
    return nearest(spark, folder).select("query_id", "id", F.round(2 * F.col("score") - 1, 5).alias("score"))


@query("pf4_threshold", f"WITH {_NEAREST_SQL} SELECT query_id, id, score FROM near WHERE score >= 0.85")
def threshold(spark: SparkSession, folder: str, least: float = 0.85) -> DataFrame:
    return nearest(spark, folder).where(F.col("score") >= least).select("query_id", "id", "score")


@query("j2_nearest_with_documents", f"WITH {_NEAREST_SQL} SELECT n.query_id, n.rank, n.id, d.file_path, c.page FROM near n JOIN {m.CHUNKS_SQL} c ON c.id = n.id JOIN documents d ON d.doc_id = c.document_id")
def nearest_with_documents(spark: SparkSession, folder: str) -> DataFrame:
    c = m.chunks(spark, folder, "document_id", "page")
    d = m.documents(spark, folder).select(F.col("doc_id").alias("document_id"), "file_path")
    return nearest(spark, folder).join(c, "id").join(d, "document_id").select("query_id", "rank", "id", "file_path", "page")


@query(
    "j14_embeddings_theta_join",
    f"""SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (
      SELECT a.vec_id AS query_id, b.vec_id, round((1 + round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12)) / 2, 6) AS score
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {QUERY_STEP} = 0)) WHERE r <= {TOP}""",
)
def embeddings_search(spark: SparkSession, folder: str) -> DataFrame:
    v = usable_vectors(m.table(spark, folder, "embeddings"), "vec_id")
    return exact_nearest(v, v.where(F.col("id") % QUERY_STEP == 0)).select("query_id", F.col("id").alias("vec_id"), "score")


# --- approximate vector search

CELL_ROWS, MOST_CELLS, SAMPLE_PER_CELL, PROBES = 1_000, 4_096, 32, 12


def _unit(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def centroids(vectors: DataFrame, count: int, cell_rows: int = CELL_ROWS, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a sample by hash: SAMPLE_PER_CELL vectors a cell, at most MOST_CELLS cells."""
    cells = int(min(MOST_CELLS, max(1, count // cell_rows)))
    share = min(1.0, SAMPLE_PER_CELL * max(cells, 64) / max(count, 1))
    sample = vectors.select("id", "v").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).toArrow()
    x = np.concatenate([_unit(b) for b in sample.to_batches() if b.num_rows] or [np.ones((1, 1), np.float32)])
    x = x[np.lexsort(x.T[:3])]
    c = x[np.random.default_rng(11).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        label = np.concatenate([np.argmax(x[lo : lo + 4096] @ c.T, axis=1) for lo in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, label, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def approximate_nearest(vectors: DataFrame, asked: DataFrame, top: int = TOP, probes: int = PROBES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, id, score, rank) of every asked vector against the vectors of its `probes` nearest cells.

    All vectors are indexed. A cell with very many rows is divided by hash into blocks, so no cell is one task.
    """
    vectors, asked = checkpoint(vectors.select("id", "v")), asked.select("id", "v")
    n = vectors.count()
    c = centroids(vectors, n, cell_rows)

    def nearest_cells(k: int):
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                score = _unit(batch) @ c.T
                take = min(k, len(c))
                cell = np.argpartition(-score, take - 1, axis=1)[:, :take] if take < len(c) else np.tile(np.arange(len(c)), (len(score), 1))
                of = np.repeat(np.arange(len(score)), take)
                rows = batch.take(pa.array(of))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(cell.ravel().astype(np.int32))], names=["id", "v", "cell"])

        return assign

    schema = "id long, v array<float>, cell int"
    members = checkpoint(vectors.mapInArrow(nearest_cells(1), schema))
    crowd = members.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    crowd = F.broadcast(checkpoint(crowd))  # at most MOST_CELLS rows
    members = members.join(crowd, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("member", F.lit(True))
    queries = asked.mapInArrow(nearest_cells(probes), schema).join(crowd, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("member", F.lit(False))
    compare = _block_product(top)

    def block(cell: pa.Table) -> pa.Table:
        return compare(cell)

    met = members.unionByName(queries).groupBy("cell", "block").applyInArrow(block, "query_id long, id long, cosine double")
    met = met.withColumn("score", F.round((1 + F.col("cosine")) / 2, 6)).drop("cosine")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)


@query("qx2_approximate_nearest")
def approximate(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against its nearest cells."""
    v = checkpoint(usable_vectors(m.table(spark, folder, "vec_chunks")))
    return approximate_nearest(v, v.where(F.col("id") % QUERY_STEP == 0))


@query("qx2_recall", f"WITH {_NEAREST_SQL} SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS recall_reached FROM near")
def approximate_recall(spark: SparkSession, folder: str, least: float = 0.9) -> DataFrame:
    """Whether the approximate search finds at least `least` of the exact neighbours; the share itself is in the README."""
    v = checkpoint(usable_vectors(m.table(spark, folder, "vec_chunks")))
    asked = v.where(F.col("id") % QUERY_STEP == 0)
    both = exact_nearest(v, asked).join(approximate_nearest(v, asked).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (F.count("hit") >= least * F.count("*")).alias("recall_reached"))


# --- BM25


def stem_queries(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, words): the words of the file name of every document whose id is divisible by 20."""
    return m.documents(spark, folder).where(F.col("doc_id") % QUERY_STEP == 0).select(F.col("doc_id").alias("query_id"), t.tokens(t.stem("file_path")).alias("words"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(id, content, w) of the chunks with a document, where they are stored: a chunk delivered n times has w = 1/n in each."""
    rows = m.table(spark, folder, "chunks").where("content is not null")
    each = rows.groupBy("id").agg(F.count("*").alias("n"), F.min("document_id").alias("document_id"))
    known = m.documents(spark, folder).select(F.col("doc_id").alias("document_id"), F.lit(1.0).alias("known"))
    w = F.coalesce(F.col("known") / F.col("n"), F.lit(0.0)).alias("w")
    odd = checkpoint(each.join(known, "document_id", "left").select("id", w).where("w <> 1"))
    few = odd.limit(m.FEW + 1).count() <= m.FEW
    placed = rows.select("id", "content").join(F.broadcast(odd) if few else odd, "id", "left")
    return placed.select("id", "content", F.coalesce("w", F.lit(1.0)).alias("w")).where("w > 0")


def found_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(id, document_id, page, head, file_path) of chunks with a document; the head is the first 100 characters."""
    c = m.chunks(spark, folder, "document_id", "page", head=F.substring("content", 1, 100)).where("head is not null")
    d = m.documents(spark, folder).select(F.col("doc_id").alias("document_id"), "file_path")
    return c.join(d, "document_id").select("id", "document_id", "page", "head", "file_path")


def document_frequencies(texts: DataFrame) -> tuple[DataFrame, int, float]:
    """((term, df), rows, average length) of (id, content, w) in one pass; counts are combined before they move."""
    worded = texts.select("w", t.tokens("content").alias("words"))
    # The row of the null term counts the texts and their words.
    terms = F.concat(F.array_distinct("words"), F.array(F.lit(None).cast("string")))
    each = worded.select("w", F.size("words").alias("dl"), F.explode(terms).alias("term"))
    counts = each.groupBy("term").agg(F.round(F.sum("w")).cast("long").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("w") * F.col("dl"))).alias("words"))
    counts = checkpoint(counts)
    whole = counts.where("term is null").first()
    n_rows = int(whole.df) if whole else 0
    return counts.where("term is not null").select("term", "df"), n_rows, round(whole.words) / n_rows if n_rows else 0.0


def _raw_idf(n_rows: int) -> Column:
    return F.log(F.lit(n_rows) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, id, dl, tf) of the given terms only."""
    terms = checkpoint(terms.select("term").distinct())
    few = terms.limit(m.FEW + 1).count() <= m.FEW
    each = texts.select("id", "w", t.tokens("content").alias("words")).select("id", "w", F.size("words").alias("dl"), F.explode("words").alias("term"))
    each = each.join(F.broadcast(terms) if few else terms, "term", "left_semi")
    return each.groupBy("term", "id").agg(F.round(F.sum("w")).cast("long").alias("tf"), F.max("dl").alias("dl"))


BLOCK_POSTINGS, BLOCK_TERMS = 1_000_000, 50_000
_FACTOR = np.array([1.0, 1.5, 2.0, 3.0])


def _sparse_product(top: int | None):
    """Scores of a block of postings and a block of queries: the `top` best of each query, or (None) the rows with all its terms."""

    def score(cell: pa.Table) -> pa.Table:
        member, title = (cell.column(k).to_numpy(zero_copy_only=False) for k in ("member", "title"))
        key, value = cell.column("key").to_numpy(), cell.column("value").to_numpy()
        _, term = np.unique(cell.column("term").to_numpy(), return_inverse=True)
        ids = np.unique(key[member & ~title])
        lists = []
        for of_title in (False, True):
            own = np.flatnonzero(member & (title == of_title))
            at = np.searchsorted(ids, key[own])
            held = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == key[own]) if len(ids) else np.zeros(len(own), bool)
            own, at = own[held], at[held]
            order = np.argsort(term[own], kind="stable")
            lists.append((at[order], value[own[order]], np.searchsorted(term[own[order]], np.arange(term.max(initial=0) + 2))))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        asked = np.flatnonzero(~member)
        asked = asked[np.argsort(key[asked], kind="stable")]
        queries, first = np.unique(key[asked], return_index=True)
        for q, mine in zip(queries, np.split(asked, first[1:])) if len(ids) else ():
            sums = []
            for of_title, (at, held, start) in zip((False, True), lists):
                rows = mine[title[mine] == of_title]
                spans = [(start[term[i]], start[term[i] + 1], value[i]) for i in rows]
                index = np.concatenate([at[a:b] for a, b, _ in spans]) if spans else np.zeros(0, np.int64)
                part = np.concatenate([held[a:b] * w for a, b, w in spans]) if spans else np.zeros(0)
                sums.append((index, part, len(spans)))
            (index, part, n_terms), (shared, _, _) = sums
            total = np.bincount(index, part, len(ids))
            if top is None:
                best = np.flatnonzero(np.bincount(index, minlength=len(ids)) == n_terms)
            else:
                if len(shared):
                    total = np.where(total > 0, total * _FACTOR[np.minimum(np.bincount(shared, minlength=len(ids)), 3)], total)
                shown = np.round(total, 6)
                best = np.flatnonzero(shown > 0)
                best = best[np.lexsort((best, -shown[best]))[:top]]
            out.append((np.full(len(best), q), ids[best], total[best]))
        a, b, c = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": a.astype(np.int64), "id": b.astype(np.int64), "score": c.astype(np.float64)})

    return score


def sparse_search(posts: DataFrame, asked: DataFrame, top: int | None) -> DataFrame:
    """(query_id, id, score): (key, term, value, title) rows of postings and of queries, dealt to a grid of blocks by hash."""
    posts, asked = checkpoint(posts.withColumn("term", F.xxhash64("term"))), checkpoint(asked.withColumn("term", F.xxhash64("term")))
    row_blocks, query_blocks = max(1, -(-posts.count() // BLOCK_POSTINGS)), max(1, -(-asked.count() // BLOCK_TERMS))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda k: F.pmod(F.xxhash64("key"), F.lit(k)).cast("int")
    rows = posts.withColumn("r", dealt(row_blocks)).withColumn("q", every(query_blocks)).withColumn("member", F.lit(True))
    asks = asked.withColumn("q", dealt(query_blocks)).withColumn("r", every(row_blocks)).withColumn("member", F.lit(False))
    compare = _sparse_product(top)

    def block(cell: pa.Table) -> pa.Table:
        return compare(cell)

    return rows.unionByName(asks).groupBy("r", "q").applyInArrow(block, "query_id long, id long, score double")


def bm25(texts: DataFrame, asked: DataFrame, top: int = DEEP, titles: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank); texts: (id, content, w), asked: (query_id, words), titles: (id, file_path) if they are to boost."""
    df, n_rows, avgdl = document_frequencies(texts)
    raw = _raw_idf(n_rows)
    mean = df.agg(F.avg(raw).alias("mean")).first().mean or 0.0
    idf = F.when(raw < 0, EPSILON * F.lit(mean)).otherwise(raw)
    terms = asked.select("query_id", F.explode("words").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    weighed = terms.join(df, "term").select(F.col("query_id").alias("key"), "term", (F.col("qf") * idf).alias("value"), F.lit(False).alias("title"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    posts = postings(texts, terms).select(F.col("id").alias("key"), "term", part.alias("value"), F.lit(False).alias("title"))
    if titles is not None:
        one = [F.lit(1.0).alias("value"), F.lit(True).alias("title")]
        named = titles.select(F.col("id").alias("key"), F.explode(F.array_distinct(t.tokens(t.stem("file_path")))).alias("term"), *one)
        posts = posts.unionByName(named.join(terms.select("term").distinct(), "term", "left_semi"))
        weighed = weighed.unionByName(terms.select(F.col("query_id").alias("key"), "term", *one))
    scored = sparse_search(posts, weighed, top).select("query_id", "id", F.round("score", 6).alias("score")).where("score > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)


def title_boosted(spark: SparkSession, folder: str, top: int = DEEP) -> DataFrame:
    """BM25 with title boost of every document name whose id is divisible by 20."""
    titles = m.chunks(spark, folder, "document_id").join(m.documents(spark, folder).select(F.col("doc_id").alias("document_id"), "file_path"), "document_id")
    return bm25(corpus(spark, folder), stem_queries(spark, folder), top, titles.select("id", "file_path"))


_WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
_STEM_SQL = r"regexp_replace(regexp_extract(file_path, '[^/]*$'), '^(.+)\.[^.]*$', '\1')"
_BM25_SQL = rf"""s AS (SELECT c.id, c.document_id, c.content, c.page, d.file_path FROM {m.CHUNKS_SQL} c JOIN documents d ON d.doc_id = c.document_id WHERE c.content IS NOT NULL),
  w AS (SELECT id, {_WORDS.format('content')} AS words, {_WORDS.format(_STEM_SQL)} AS title FROM s),
  tok AS (SELECT id, len(words) AS dl, unnest(words) AS term FROM w), tot AS (SELECT count(*) AS n_rows, avg(len(words)) AS avgdl FROM w),
  df AS (SELECT term, count(DISTINCT id) AS df FROM tok GROUP BY term),
  raw AS (SELECT term, df, ln(n_rows - df + 0.5e0) - ln(df + 0.5e0) AS raw FROM df, tot),
  idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25e0 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
  q AS (SELECT doc_id AS query_id, {_WORDS.format(_STEM_SQL)} AS words FROM documents WHERE doc_id % {QUERY_STEP} = 0),
  qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(words) AS term FROM q) GROUP BY ALL),
  tf AS (SELECT term, id, dl, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
  plain AS (SELECT query_id, id, sum(qf * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score FROM tf JOIN qt USING (term) JOIN idf USING (term), tot GROUP BY ALL),
  boosted AS (SELECT query_id, id, CASE WHEN p.score <= 0 THEN p.score ELSE p.score * CASE least(len(list_intersect(w.title, q.words)), 3) WHEN 0 THEN 1e0 WHEN 1 THEN 1.5e0 WHEN 2 THEN 2e0 ELSE 3e0 END END AS score
    FROM plain p JOIN w USING (id) JOIN q USING (query_id)),
  kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(score, 6) AS score FROM boosted) WHERE score > 0) WHERE rank <= {DEEP})"""


@query("ag17_corpus_statistics", rf"WITH {_BM25_SQL} SELECT n_rows, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS terms, round((SELECT avg(raw) FROM raw), 6) AS mean_idf FROM tot")
def corpus_statistics(spark: SparkSession, folder: str) -> DataFrame:
    df, n_rows, avgdl = document_frequencies(corpus(spark, folder))
    facts = df.agg(F.count("*").alias("terms"), F.round(F.avg(_raw_idf(n_rows)), 6).alias("mean_idf"))
    return facts.select(F.lit(n_rows).cast("long").alias("n_rows"), F.round(F.lit(avgdl), 6).alias("avgdl"), "terms", "mean_idf")


@query("qx3_bm25", f"WITH {_BM25_SQL} SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(score, 6) AS score FROM plain) WHERE score > 0) WHERE rank <= {DEEP}")
def bm25_plain(spark: SparkSession, folder: str) -> DataFrame:
    return bm25(corpus(spark, folder), stem_queries(spark, folder))


@query("qx4_bm25_title_boost", f"WITH {_BM25_SQL} SELECT query_id, id, score, rank FROM kw")
def bm25_boosted(spark: SparkSession, folder: str) -> DataFrame:
    return title_boosted(spark, folder)


@query(
    "qx14_all_terms",
    f"""WITH {_BM25_SQL}, two AS (SELECT DISTINCT query_id, unnest(words[1:2]) AS term FROM q)
      SELECT query_id, id, hits FROM (SELECT two.query_id, tf.id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS hits FROM tf JOIN two USING (term) GROUP BY ALL) f
      JOIN (SELECT query_id, count(*) AS need FROM two GROUP BY query_id) n USING (query_id) WHERE terms = need""",
)
def all_terms(spark: SparkSession, folder: str, n: int = 2) -> DataFrame:
    """Boolean AND search: chunks that hold each of a name's first two words, with the number of hits."""
    terms = stem_queries(spark, folder).select("query_id", F.explode(F.array_distinct(F.slice("words", 1, n))).alias("term"))
    posts = postings(corpus(spark, folder), terms).select(F.col("id").alias("key"), "term", F.col("tf").cast("double").alias("value"), F.lit(False).alias("title"))
    asked = terms.select(F.col("query_id").alias("key"), "term", F.lit(1.0).alias("value"), F.lit(False).alias("title"))
    return sparse_search(posts, asked, None).select("query_id", "id", F.col("score").cast("long").alias("hits"))


# --- fusion


def fuse(vector: DataFrame, keyword: DataFrame, shown: DataFrame, top: int = TOP, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, id, rank).

    Results are the same if source, page and the first 50 characters are; their reciprocal ranks add up.
    shown: (id, key). Order: fused score, then the first appearance (vector list first).
    """
    both = vector.select("query_id", "id", "rank", F.lit(0).alias("list")).unionByName(keyword.select("query_id", "id", "rank", F.lit(1).alias("list")))
    both = both.join(shown, "id")
    first = F.min(F.struct("list", "rank", "id")).alias("first")
    fused = both.groupBy("query_id", "key").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), first)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.list", "first.rank")
    return fused.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top).select("query_id", "rank", F.col("first.id").alias("id"), "score")


def result_keys(rows: DataFrame) -> DataFrame:
    """(id, key) by which results of both lists are the same."""
    page = F.coalesce(F.col("page").cast("string"), F.lit("None"))
    return rows.select("id", F.concat_ws(":", t.file_name("file_path"), page, F.substring("head", 1, 50)).alias("key"))


def hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """For every document whose id is divisible by 20: its title words and its first usable chunk vector as one query."""
    rows = checkpoint(found_rows(spark, folder))
    return fuse(first_chunk_nearest(spark, folder, rows), title_boosted(spark, folder), result_keys(rows))


def first_chunk_nearest(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """The nearest of each asked document's first usable chunk vector, that chunk left out."""
    v = checkpoint(usable_vectors(m.table(spark, folder, "vec_chunks")))
    first = rows.where(F.col("document_id") % QUERY_STEP == 0).select("id", "document_id").join(v.select("id"), "id", "left_semi").groupBy("document_id").agg(F.min("id").alias("id"))
    asked = v.join(first, "id").select(F.col("document_id").alias("id"), "v")
    return exact_nearest_of(v, asked, first.select(F.col("document_id").alias("query_id"), F.col("id").alias("own")))


def exact_nearest_of(vectors: DataFrame, asked: DataFrame, own: DataFrame, top: int = TOP) -> DataFrame:
    """Nearest of queries named by other keys: one more is fetched, and the query's own vector is left out."""
    shifted = asked.select((-F.col("id") - 1).alias("id"), "v")  # negative keys never meet a row's id
    near = exact_nearest(vectors, shifted, top + 1).select((-F.col("query_id") - 1).alias("query_id"), "id", "score")
    near = near.join(own, "query_id").where("id <> own")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top).select("query_id", "id", "score", "rank")


_HYBRID_SQL = rf"""{_BM25_SQL}, u AS ({_USABLE_SQL}),
  own AS (SELECT document_id AS query_id, min(id) AS own FROM s JOIN u USING (id) WHERE document_id % {QUERY_STEP} = 0 GROUP BY ALL),
  vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT o.query_id, b.id, round((1 + round(list_cosine_similarity(a.v, b.v), 12)) / 2, 6) AS score FROM own o JOIN u a ON a.id = o.own JOIN u b ON b.id <> a.id)) WHERE rank <= {TOP}),
  keyed AS (SELECT id, regexp_extract(file_path, '[^/]*$') || ':' || coalesce(CAST(page AS VARCHAR), 'None') || ':' || left(content, 50) AS key FROM s),
  lists AS (SELECT query_id, id, rank, 0 AS list FROM vr UNION ALL SELECT query_id, id, rank, 1 FROM kw),
  fused AS (SELECT query_id, key, round(sum(1e0 / ({RRF_K} + rank)), 9) AS score, min({{'list': list, 'rank': rank, 'id': id}}) AS first FROM lists JOIN keyed USING (id) GROUP BY ALL),
  hy AS (SELECT query_id, rank, id, score FROM (SELECT query_id, first.id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first.list, first.rank) AS rank FROM fused) WHERE rank <= {TOP})"""


@query("qx5_hybrid_fusion", f"WITH {_HYBRID_SQL} SELECT * FROM hy")
def hybrid_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return hybrid(spark, folder)


@query(
    "qx6_suggestions",
    rf"""WITH {_HYBRID_SQL}, words AS (SELECT query_id, rank * 1000000 + pos AS place_at, regexp_replace(lower(word), '[^\p{{L}}\p{{N}}]', '', 'g') AS word FROM (
        SELECT query_id, rank, unnest(string_split_regex(content, '[\s\p{{Z}}]+')) AS word, unnest(range(len(string_split_regex(content, '[\s\p{{Z}}]+')))) AS pos FROM hy JOIN s USING (id) WHERE rank <= 3)),
      counted AS (SELECT query_id, word, count(*) AS n, min(place_at) AS place_at FROM words JOIN q USING (query_id) WHERE length(word) >= 4 AND NOT list_contains(q.words, word) GROUP BY ALL)
      SELECT query_id, 'more about ' || word AS suggestion, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, place_at) AS place FROM counted) WHERE place <= 3""",
)
def suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """The three most frequent longer words of the first three results that the query doesn't have."""
    found = checkpoint(hybrid(spark, folder).where("rank <= 3"))
    found = found.join(m.texts_of(spark, folder, found), "id")
    words = found.select("query_id", "rank", F.posexplode(F.split("content", r"[\s\p{Z}]+")).alias("pos", "word"))
    words = words.select("query_id", (F.col("rank") * 1_000_000 + F.col("pos")).alias("at"), F.regexp_replace(F.lower("word"), r"[^\p{L}\p{N}]", "").alias("word"))
    words = words.where(F.length("word") >= 4).join(stem_queries(spark, folder), "query_id").where(~F.array_contains("words", F.col("word")))
    counted = words.groupBy("query_id", "word").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    best = Window.partitionBy("query_id").orderBy(F.desc("n"), "at")
    counted = counted.withColumn("place", F.row_number().over(best).cast("long")).where("place <= 3")
    return counted.select("query_id", F.concat(F.lit("more about "), "word").alias("suggestion"), "place")


# --- decomposition

def is_compound(c: str | Column) -> Column:
    return F.lower(t.col(c)).rlike(r"(^|[^\p{L}\p{N}_])(and|or|vs\.?|versus|compare)([^\p{L}\p{N}_]|$)|\?[\s\S]*\?")


def sub_queries(c: str | Column) -> Column:
    """The parts of a compound query: at the first kind of separator that divides it; else an empty array."""
    parts = lambda word: F.filter(F.transform(F.split(t.col(c), rf"(?i)\s+{word}\s+"), t.strip), lambda p: F.length(p) > 3)
    divided = lambda word: F.size(F.split(t.col(c), rf"(?i)\s+{word}\s+")) > 1
    chosen = F.when(divided(r"vs\.?"), parts(r"vs\.?")).when(divided("versus"), parts("versus")).when(divided("and"), parts("and")).when(divided("or"), parts("or"))
    return F.when(F.size(chosen) >= 2, chosen).otherwise(F.array().cast("array<string>"))


@query("qx7_compound_titles", r"SELECT node_id, regexp_matches(lower(content), '(^|[^\p{L}\p{N}_])(and|or|vs\.?|versus|compare)([^\p{L}\p{N}_]|$)|\?[\s\S]*\?') AS compound FROM " + m.NODES_SQL + " WHERE content IS NOT NULL")
def compound_titles(spark: SparkSession, folder: str) -> DataFrame:
    return m.nodes(spark, folder).where("content is not null").select("node_id", is_compound("content").alias("compound"))


_SPLIT_SQL = r"string_split_regex(content, '(?i)\s+{0}\s+')"
_PARTS_SQL = "list_filter(list_transform(" + _SPLIT_SQL + r", lambda p: regexp_replace(regexp_replace(p, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')), lambda p: length(p) > 3)"
_CHOSEN_SQL = "CASE " + " ".join(f"WHEN len({_SPLIT_SQL.format(w)}) > 1 THEN {_PARTS_SQL.format(w)}" for w in (r"vs\.?", "versus", "and", "or")) + " END"


@query("qx8_sub_queries", f"SELECT node_id, unnest(range(1, len(parts) + 1)) AS place, unnest(parts) AS part FROM (SELECT node_id, {_CHOSEN_SQL} AS parts FROM {m.NODES_SQL} WHERE content IS NOT NULL) WHERE len(parts) >= 2")
def decomposed(spark: SparkSession, folder: str) -> DataFrame:
    n = m.nodes(spark, folder).where("content is not null").select("node_id", F.posexplode(sub_queries("content")).alias("place", "part"))
    return n.select("node_id", (F.col("place") + 1).cast("long").alias("place"), "part")


@query(
    "qx9_multi_query",
    rf"""WITH {_BM25_SQL}, sub AS (SELECT query_id, unnest(range(len(words))) AS part, unnest(words) AS term FROM q),
      sc AS (SELECT sub.query_id, part, tf.id, idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)) AS score FROM sub JOIN tf USING (term) JOIN idf USING (term), tot),
      rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, id) AS r FROM (SELECT query_id, part, id, round(score, 6) AS score FROM sc) WHERE score > 0),
      dd AS (SELECT rk.*, row_number() OVER (PARTITION BY query_id, regexp_extract(file_path, '[^/]*$'), left(content, 100) ORDER BY part, r) AS seen FROM rk JOIN s USING (id) WHERE r <= {TOP})
      SELECT query_id, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, part, r) AS place FROM dd WHERE seen = 1) WHERE place <= {TOP}""",
)
def multi_query(spark: SparkSession, folder: str) -> DataFrame:
    """Each word of a title as its own sub-query, all in one pass: ranked, first-seen results kept, merged by score."""
    sub = stem_queries(spark, folder).select("query_id", F.posexplode("words").alias("part", "term"))
    keyed = sub.select((F.col("query_id") * (1 << 16) + F.col("part")).alias("query_id"), F.array("term").alias("words"))  # a path has fewer words
    ranked = bm25(corpus(spark, folder), keyed, top=TOP).withColumnRenamed("query_id", "key").withColumnRenamed("rank", "r")
    ranked = ranked.withColumn("query_id", F.shiftright("key", 16)).withColumn("part", F.pmod("key", F.lit(1 << 16)))
    ranked = ranked.join(found_rows(spark, folder).select("id", t.file_name("file_path").alias("source"), "head"), "id")
    seen = Window.partitionBy("query_id", "source", "head").orderBy("part", "r")
    ranked = ranked.withColumn("seen", F.row_number().over(seen)).where("seen = 1")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "part", "r")
    return ranked.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= TOP).select("query_id", "id", "score", "place")


# --- pluggable parts


def lexical_scores(asked: str = "words", content: str = "content") -> Column:
    """The default reranking score: the share of the query's distinct words that the content has."""
    words = F.array_distinct(asked)
    return F.round(F.size(F.array_intersect(words, t.tokens(content))) / F.greatest(F.size(words), F.lit(1)), 6)


def rerank(results: DataFrame, rows: DataFrame, asked: DataFrame, top: int = 5, scorer=lexical_scores) -> DataFrame:
    """Results (query_id, id, rank) in the order of a scorer; a single candidate stays as it is."""
    found = results.join(rows.select("id", "content"), "id").join(asked, "query_id").withColumn("rerank_score", scorer("words", "content"))
    best = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return found.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= top).select("query_id", "id", "rerank_score", "place")


@query(
    "qx11_rerank",
    f"""WITH {_BM25_SQL} SELECT query_id, id, rerank_score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS place FROM (
      SELECT kw.query_id, kw.id, kw.rank, round(len(list_intersect(list_distinct(q.words), w.words)) / greatest(len(list_distinct(q.words)), 1), 6) AS rerank_score FROM kw JOIN w USING (id) JOIN q USING (query_id))) WHERE place <= 5""",
)
def reranked(spark: SparkSession, folder: str) -> DataFrame:
    found = checkpoint(title_boosted(spark, folder))
    return rerank(found, m.texts_of(spark, folder, found), stem_queries(spark, folder))


def expand(asked: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, words) with the synonyms (word, synonym) of each word appended; a joined table instead of a model."""
    more = asked.select("query_id", F.explode("words").alias("word")).join(synonyms, "word").groupBy("query_id").agg(F.sort_array(F.collect_set("synonym")).alias("more"))
    return asked.join(more, "query_id", "left").select("query_id", F.when(F.col("more").isNull(), F.col("words")).otherwise(F.array_distinct(F.concat("words", "more"))).alias("words"))


class ResultCache:
    """The most recently used results on the driver; size 0 or less keeps none, an empty result is no hit."""

    def __init__(self, size: int = 100):
        self.size, self.kept = size, OrderedDict()

    @staticmethod
    def key(text: str, top: int = 5, least: float | None = None, decompose: bool = True) -> str:
        return hashlib.md5(json.dumps({"q": text.strip().lower(), "k": top, "t": least, "d": decompose}, sort_keys=True).encode()).hexdigest()

    def get(self, key: str):
        if self.kept.get(key):
            self.kept.move_to_end(key)
            return self.kept[key]
        return None

    def put(self, key: str, results: list) -> None:
        if self.size > 0:
            self.kept[key] = results
            self.kept.move_to_end(key)
            while len(self.kept) > self.size:
                self.kept.popitem(last=False)

    def clear(self) -> None:
        self.kept.clear()


def hash_embedding(texts: DataFrame, dimensions: int = 64) -> DataFrame:
    """(id, embedding): a deterministic bag-of-words embedding, for use without a model. Arrow batches, unit length."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        import zlib

        word = re.compile(r"\w+")
        for batch in batches:
            out = np.zeros((batch.num_rows, dimensions), np.float32)
            for i, text in enumerate(batch.column(1).to_pylist()):
                for w in word.findall((text or "").lower()):
                    h = zlib.crc32(w.encode())
                    out[i, h % dimensions] += 1 if h >> 31 else -1
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out /= np.where(norm > 0, norm, 1)
            offsets = pa.array(np.arange(0, batch.num_rows * dimensions + 1, dimensions, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["id", "embedding"])

    return texts.mapInArrow(embed, "id long, embedding array<float>")


@query("qx15_embed_chunks")
def embedded_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Embedded where the texts are; of rows delivered twice one vector is kept."""
    return hash_embedding(m.table(spark, folder, "chunks").where("content is not null").select("id", "content")).dropDuplicates(["id"])


# --- quality of retrieval


@query(
    "ag14_retrieval_metrics",
    f"""WITH {_BM25_SQL}, rel AS (SELECT document_id AS query_id, count(*) AS relevant FROM s WHERE document_id % {QUERY_STEP} = 0 GROUP BY ALL),
      got AS (SELECT kw.query_id, count(*) FILTER (WHERE s.document_id = kw.query_id) AS hits, min(kw.rank) FILTER (WHERE s.document_id = kw.query_id) AS first FROM kw JOIN s USING (id) WHERE kw.rank <= {TOP} GROUP BY ALL)
      SELECT count(*) AS queries, round(avg(coalesce(hits, 0) / {TOP}e0), 6) AS precision_at_k, round(avg(coalesce(hits, 0) / CAST(relevant AS DOUBLE)), 6) AS recall, round(avg(coalesce(1e0 / first, 0)), 6) AS mrr FROM rel LEFT JOIN got USING (query_id)""",
)
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Title search judged by whether it finds the document's own chunks."""
    rows = found_rows(spark, folder)
    relevant = rows.where(F.col("document_id") % QUERY_STEP == 0).groupBy(F.col("document_id").alias("query_id")).agg(F.count("*").alias("relevant"))
    got = title_boosted(spark, folder, TOP).join(rows.select("id", "document_id"), "id")
    own = F.col("document_id") == F.col("query_id")
    got = got.groupBy("query_id").agg(F.count_if(own).alias("hits"), F.min(F.when(own, F.col("rank"))).alias("first"))
    return relevant.join(got, "query_id", "left").agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.coalesce(F.col("hits") / TOP, F.lit(0.0))), 6).alias("precision_at_k"),
        F.round(F.avg(F.coalesce(F.col("hits") / F.col("relevant"), F.lit(0.0))), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )


@query(
    "ag15_benchmark_grades",
    f"""WITH {_BM25_SQL}, g AS (SELECT d.doc_id AS query_id, {CLASS_SQL} AS class, kw.rank, s.document_id = d.doc_id AS own, s.file_path LIKE '%' || coalesce(d.source, '?') || '%' AS same_source
        FROM documents d LEFT JOIN kw ON kw.query_id = d.doc_id AND kw.rank <= 5 LEFT JOIN s ON s.id = kw.id WHERE d.doc_id % {QUERY_STEP} = 0),
      e AS (SELECT query_id, class, coalesce(bool_or(rank = 1 AND own), false) AS correct, coalesce(bool_or(rank = 1 AND same_source), false) AS acceptable, coalesce(bool_or(own), false) AS in_top_5
        FROM (SELECT g.query_id, g.class, g.rank, g.own, g.same_source FROM g) GROUP BY ALL)
      SELECT coalesce(class, 'all') AS class, count(*) AS queries, count_if(correct) AS correct, count_if(NOT correct AND acceptable) AS acceptable, count_if(NOT correct AND NOT acceptable) AS wrong, count_if(in_top_5) AS in_top_5 FROM e GROUP BY ROLLUP (class)""".replace("FROM documents d LEFT", "FROM (SELECT doc_id, source, file_path AS file_path FROM documents) d LEFT").replace(CLASS_SQL, CLASS_SQL.replace("file_path", "d.file_path")),
)
def benchmark_grades(spark: SparkSession, folder: str) -> DataFrame:
    """Title search graded: the document itself first, else its source first, else wrong; per content class and overall."""
    rows = found_rows(spark, folder)
    asked = m.documents(spark, folder).where(F.col("doc_id") % QUERY_STEP == 0).select(F.col("doc_id").alias("query_id"), content_class().alias("class"), F.coalesce("source", F.lit("?")).alias("wanted"))
    found = title_boosted(spark, folder, 5).join(rows.select("id", "document_id", "file_path"), "id").drop("score")
    own, alike = F.col("document_id") == F.col("query_id"), F.col("file_path").contains(F.col("wanted"))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    each = asked.join(found, "query_id", "left").groupBy("query_id", "class").agg(
        some((F.col("rank") == 1) & own).alias("right"), some((F.col("rank") == 1) & alike).alias("near"), some(own).alias("top")
    )
    return each.rollup("class").agg(
        F.count("*").alias("queries"), F.count_if("right").alias("correct"), F.count_if(~F.col("right") & F.col("near")).alias("acceptable"),
        F.count_if(~F.col("right") & ~F.col("near")).alias("wrong"), F.count_if("top").alias("in_top_5"),
    ).withColumn("class", F.coalesce("class", F.lit("all")))


@query(
    "qx16_three_way",
    f"""WITH {_HYBRID_SQL}, branches AS (SELECT 'vector' AS branch, query_id, id FROM vr WHERE rank <= 5 UNION ALL SELECT 'keyword', query_id, id FROM kw WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, id FROM hy WHERE rank <= 5)
      SELECT branch, count(DISTINCT query_id) AS answered, count(DISTINCT query_id) FILTER (WHERE s.document_id = query_id) AS hit FROM branches JOIN s USING (id) GROUP BY ALL""",
)
def three_way(spark: SparkSession, folder: str) -> DataFrame:
    """How many queries each branch answers with the document itself among the first five."""
    rows = checkpoint(found_rows(spark, folder))
    near, words = checkpoint(first_chunk_nearest(spark, folder, rows)), checkpoint(title_boosted(spark, folder))
    fused = fuse(near, words, result_keys(rows))
    part = lambda df, name: df.where("rank <= 5").select(F.lit(name).alias("branch"), "query_id", "id")
    every = part(near, "vector").unionByName(part(words, "keyword")).unionByName(part(fused, "hybrid"))
    every = every.join(rows.select("id", "document_id"), "id")
    return every.groupBy("branch").agg(F.count_distinct("query_id").alias("answered"), F.count_distinct(F.when(F.col("document_id") == F.col("query_id"), F.col("query_id"))).alias("hit"))
