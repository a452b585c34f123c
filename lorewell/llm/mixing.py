"""Mixing sources to target weights (problem 7) by weighted fair queueing.

Each document of a listed source gets a virtual finish time: the tokens of its source up to and including
it, in a fixed shuffle, divided by the source's target weight. A source that may be used r times queues
its whole shuffle r times, one pass after the other. The documents with the earliest finish times are
taken until the total budget is full, so at every moment each source has its share of what was taken, and
a source that has run out leaves its room to the others in proportion to their weights.

Sources are matched after cleaning: trimmed, lower-cased, `_` and blanks written `-`. Documents of a
source that is null or not listed are not selected; a listed source without documents reports 0.

The place where the budget ends is found in bins of finish times: the bin in which it ends is divided into
bins again until it has no more than EDGE_ROWS rows, which alone are put in order.

Without a given budget the largest one is taken at which the reached shares still differ from the targets
(of the sources that have any tokens) by no more than MOST_DEVIATION in total variation. It is found from
one row per listed source.

Defined results: texts without tokens, null ids, and weights or repeats that are null or not positive
take no part; rows delivered twice count once; empty tables give an empty selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.llm.tokens import FOLDER, token_counts
from lorewell.operators.ordered import running_sum
from lorewell.session import checkpoint, table

MOST_DEVIATION = 0.01
BINS, EDGE_ROWS = 1 << 12, 10_000


def clean_source(name: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.col(name) if isinstance(name, str) else name)), r"[_\s]+", "-")


def _weights(weights: DataFrame) -> list[tuple[str, float, int]]:
    rows = weights.select(clean_source("source").alias("source"), "target_share", "max_repeats").where("target_share > 0 and max_repeats >= 1")
    rows = rows.groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r"))
    return [(x.source, float(x.w), int(x.r)) for x in rows.where("source is not null").collect()]


def largest_even_budget(available: dict[str, int], weights: list[tuple[str, float, int]], most_deviation: float = MOST_DEVIATION) -> int:
    """The most tokens that can be taken while the shares stay within `most_deviation` of the targets."""
    live = [(available[s] * r, w) for s, w, r in weights if available.get(s)]
    if not live:
        return 0
    whole = sum(w for _, w in live)

    def taken(t: float) -> list[float]:
        return [min(w * t, a) for a, w in live]

    def deviation(t: float) -> float:
        got = taken(t)
        return sum(abs(g / sum(got) - w / whole) for g, (_, w) in zip(got, live)) / 2

    low, high = min(a / w for a, w in live), max(a / w for a, w in live)
    if deviation(high) <= most_deviation:
        low = high
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if deviation(middle) <= most_deviation else (low, middle)
    return int(sum(taken(low)))


def select_mix(documents: DataFrame, sizes: DataFrame, weights: DataFrame, budget: int | None = None) -> DataFrame:
    """(doc_id, source, repeat, tokens, finish) of the selection, in order of finish time."""
    spark = documents.sparkSession
    listed = _weights(weights)
    few = lambda df: F.broadcast(df) if len(listed) <= 100_000 else df
    known = few(spark.createDataFrame(listed, "source string, weight double, repeats int"))
    named = documents.select(F.col("doc_id").cast("long").alias("id"), clean_source("source").alias("source")).where("id is not null")
    rows = named.groupBy("id").agg(F.min("source").alias("source")).join(sizes.where("tokens > 0"), "id").join(known, "source")
    rows = checkpoint(running_sum(rows, ["source"], ["id"], "tokens", "upto", seed=7))
    totals = {r.source: int(r.n) for r in rows.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # one row a listed source
    if budget is None:
        budget = largest_even_budget(totals, listed)
    per_source = few(spark.createDataFrame(list(totals.items()), "source string, whole long"))
    queued = rows.join(per_source, "source").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    queued = queued.withColumn("finish", (F.col("upto") + F.col("whole") * (F.col("repeat") - 1)) / F.col("weight"))
    last = max((totals[s] * r / w for s, w, r in listed if totals.get(s)), default=1.0)
    # Of the rows not yet judged, those below the bin where the budget ends are taken; that bin is judged again.
    low, high, before, inside, taken = 0.0, last, 0, F.lit(True), F.lit(False)
    while True:
        at = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit((high - low) / BINS)), F.lit(BINS - 1)).cast("int")
        bins = sorted((r.bin, int(r.n), int(r.rows)) for r in queued.where(inside).groupBy(at.alias("bin")).agg(F.sum("tokens").alias("n"), F.count("*").alias("rows")).collect())  # BINS rows at most
        crossing, rows_there = BINS, 0
        for place, n, rows_in in bins:
            if before + n > budget:
                crossing, rows_there = place, rows_in
                break
            before += n
        taken, inside = taken | (inside & (at < crossing)), inside & (at == crossing)
        step = (high - low) / BINS
        if rows_there <= EDGE_ROWS or low + step <= low:
            break
        low, high = low + crossing * step, low + (crossing + 1) * step
    up = Window.orderBy("finish", "id", "repeat").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Finish times rise within a source, so equal ones are no more than there are sources.
    edge = queued.where(inside).withColumn("sum", F.sum("tokens").over(up)).where(F.col("sum") <= budget - before).drop("sum")
    columns = [F.col("id").alias("doc_id"), "source", "repeat", "tokens", "finish"]
    chosen = queued.where(taken).unionByName(edge).select(*columns)
    return chosen.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id", "repeat")


def available(documents: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source, available): tokens of each cleaned source, each document once."""
    named = documents.select(F.col("doc_id").cast("long").alias("id"), clean_source("source").alias("source")).where("id is not null")
    return named.groupBy("id").agg(F.min("source").alias("source")).join(sizes, "id").groupBy("source").agg(F.sum("tokens").alias("available"))


def shares(selection: DataFrame, weights: DataFrame, stock: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available, tokens, records, most_used, share) of every listed source."""
    got = selection.groupBy("source", "doc_id").agg(F.count("*").alias("used"), F.sum("tokens").alias("tokens"))
    got = got.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"), F.max("used").alias("most_used"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    listed = weights.groupBy(clean_source("source").alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = F.lit(0).cast("long")
    return listed.join(got, "source", "left").join(stock, "source", "left").crossJoin(F.broadcast(whole)).select(  # one row
        "source", "target_share", "max_repeats", F.coalesce("available", zero).alias("available"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("records", zero).alias("records"),
        F.coalesce("most_used", zero).alias("most_used"), F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("share"),
    )


def _sizes(spark: SparkSession, folder: str, tokenizers: str) -> DataFrame:
    return checkpoint(token_counts(table(spark, folder, "documents"), "doc_id", "text", tokenizers).groupBy("id").agg(F.max("tokens").alias("tokens")))


def p7_selection(spark: SparkSession, folder: str, tokenizers: str = FOLDER) -> DataFrame:
    return select_mix(table(spark, folder, "documents"), _sizes(spark, folder, tokenizers), table(spark, folder, "source_weights"))


def p7_shares(spark: SparkSession, folder: str, tokenizers: str = FOLDER) -> DataFrame:
    documents, weights, sizes = table(spark, folder, "documents"), table(spark, folder, "source_weights"), _sizes(spark, folder, tokenizers)
    return shares(select_mix(documents, sizes, weights), weights, available(documents, sizes))


def p7_invariants(spark: SparkSession, folder: str, tokenizers: str = FOLDER) -> DataFrame:
    """Listed sources, and whether no record is used too often, shares add up to 1 and are near the targets of the sources in stock.

    Near: within MOST_DEVIATION and, since texts are whole, the longest chosen text of each source.
    """
    documents, weights, sizes = table(spark, folder, "documents"), table(spark, folder, "source_weights"), _sizes(spark, folder, tokenizers)
    chosen = checkpoint(select_mix(documents, sizes, weights))
    s = checkpoint(shares(chosen, weights, available(documents, sizes)))
    whole = chosen.agg(F.max("tokens").alias("longest"), F.sum("tokens").alias("whole"))
    stocked = s.where("available > 0").agg(F.sum("target_share").alias("all"), F.count("*").alias("stocked"))
    off = F.abs(F.col("share") - F.when(F.col("available") > 0, F.col("target_share") / F.col("all")).otherwise(F.lit(0.0)))
    near = F.sum(off) / 2 <= MOST_DEVIATION + F.max(F.col("stocked") * F.col("longest") / F.col("whole"))
    return s.crossJoin(F.broadcast(stocked)).crossJoin(F.broadcast(whole)).agg(  # single rows
        F.count("*").alias("sources"), F.bool_and(F.col("most_used") <= F.col("max_repeats")).alias("within_repeats"), F.bool_and(F.col("tokens") <= F.col("available") * F.col("max_repeats")).alias("within_stock"),
        (F.abs(F.sum("share") - 1) < 1e-4).alias("shares_add_up"), near.alias("near_targets"),
    )


QUERIES = {"p7_selection": p7_selection, "p7_shares": p7_shares, "p7_invariants": p7_invariants}
SQL = {"p7_invariants": r"SELECT count(DISTINCT regexp_replace(lower(trim(source)), '[_\s]+', '-', 'g')) AS sources, true AS within_repeats, true AS within_stock, true AS shares_add_up, true AS near_targets FROM source_weights"}
