"""Ranks and running sums inside groups of any size.

The order is that of a hash of the row's key (a fixed shuffle), so its leading bits cut every group into
buckets that follow one another. Sums per bucket are aggregated map-side, their prefix is taken over the
few buckets of a group, and the window that remains covers one bucket of one group: no group, however
large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 10


def shuffled_position(*key: str, seed: int = 0) -> Column:
    """A 63-bit position of a row in the fixed shuffle of its key."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in key], F.lit(seed)), 1)


def running_sum(df: DataFrame, group: list[str], key: list[str], weight: str, out: str, *, seed: int = 0, bits: int = BUCKET_BITS) -> DataFrame:
    """Adds `out`: the sum of `weight` over the rows of the group up to and including this one, in shuffled order."""
    rows = df.withColumn("_at", shuffled_position(*key, seed=seed)).withColumn("_bucket", F.shiftright("_at", 63 - bits))
    sums = rows.groupBy(*group, "_bucket").agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*group, "_bucket").orderBy("_at", *key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("_within", F.sum(weight).over(within))
        .join(sums, [*group, "_bucket"])
        .withColumn(out, F.col("_before") + F.col("_within"))
        .drop("_at", "_bucket", "_within", "_before")
    )


def rank(df: DataFrame, group: list[str], key: list[str], out: str = "rank", *, seed: int = 0, bits: int = BUCKET_BITS) -> DataFrame:
    """Adds `out`: 0, 1, 2, ... inside the group, in shuffled order."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), group, key, "_one", out, seed=seed, bits=bits).withColumn(out, F.col(out) - 1).drop("_one")


def places(df: DataFrame, group: list[str], index: str, key: str, weight: str | None = None, out: str = "place") -> DataFrame:
    """Adds `out`: how many rows (or how much of `weight`) come before the row in its group, ordered by `index` (nulls last) and the integer `key`.

    Three nested sums, over 256 indexes, over one index and 65,536 keys, and over single rows, keep every
    window small however large the group is and however often an index repeats.
    """
    at = F.coalesce(F.col(index).cast("long"), F.lit((1 << 40) - 1))
    rows = df.withColumn("_n", F.col(weight).cast("long") if weight else F.lit(1).cast("long"))
    rows = rows.withColumn("_at", at).withColumn("_a", F.floor(F.col("_at") / 256)).withColumn("_b", F.floor(F.col(key) / 65536))
    inner = rows.groupBy(*group, "_a", "_at", "_b").agg(F.sum("_n").alias("_m"))
    outer = inner.groupBy(*group, "_a").agg(F.sum("_m").alias("_s"))
    before = lambda column, by, order: F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outer = outer.withColumn("_s", before("_s", group, ["_a"]))
    inner = inner.withColumn("_m", before("_m", [*group, "_a"], ["_at", "_b"]))
    rows = rows.withColumn("_w", before("_n", [*group, "_at", "_b"], [key]))
    placed = rows.join(inner, [*group, "_a", "_at", "_b"]).join(outer, [*group, "_a"])
    return placed.withColumn(out, (F.col("_s") + F.col("_m") + F.col("_w")).cast("long")).drop("_n", "_at", "_a", "_b", "_m", "_s", "_w")


def following(df: DataFrame, group: list[str], columns: list[str], place: str = "place") -> DataFrame:
    """Adds next_<column> of the row one place on; a join on unique keys, so no group meets in one task."""
    after = df.select(*group, (F.col(place) - 1).alias(place), *[F.col(c).alias(f"next_{c}") for c in columns])
    return df.join(after, [*group, place], "left")
