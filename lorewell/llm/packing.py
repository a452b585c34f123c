"""Filling containers of fixed capacity with texts (problem 6).

Sizes are whole tokens, so an instance is fully described by how many items have each size up to the
capacity: a histogram with at most `capacity` rows, however many texts there are. The reduction and the
best fit run on that histogram and yield patterns with multiplicities; texts are then ranked inside their
size, in a distributed way, and looked up in the pattern table.

Reduction (dominance of Martello and Toth, restated for multiplicities): for the largest size j left,
- nothing fits beside j: j alone is fixed;
- a k fills the container exactly: {j, k} is fixed;
- at most one more item fits beside j: {j, largest fitting k} is fixed;
- at most two more fit: {j, k} is fixed if k is at least as large as any fitting pair, and {j, k, b} if k
  is the larger of the pair and no fitting pair has a smaller member above b.
Each of these sets dominates every other filling of a container that holds j, so fixing it loses nothing;
it is fixed as often as its items last. Where no rule applies to a size, the instance is relaxed as they do:
its smallest size is set aside and the rest is reduced by the same rules, until j itself is the smallest.
Best fit decreasing then puts what was set aside, and the sizes to which no rule applied, into the room left
beside the fixed sets and into further containers. Sets of the relaxed instance dominate only there; they
are reported apart (by_rule: dominance, relaxed).

Defined results: a text without tokens needs no room (container_id null); a text is divided only if it
alone exceeds the capacity, into full pieces and a rest that is packed like any other item; capacities
that are null or below 1 are ignored; rows delivered twice count once; an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.tokens import FOLDER, token_counts
from lorewell.operators.ordered import rank
from lorewell.session import checkpoint, table

Pattern = tuple[int, dict[int, int]]  # (how many containers, size -> items of it in each)


class _Left:
    """Sizes still to be placed, ascending, with their counts."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {s: n for s, n in histogram.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def fitting(self, room: int, without: int | None = None) -> int | None:
        """The largest size up to `room`, one item of `without` not being there."""
        at = bisect_right(self.sizes, room) - 1
        while at >= 0:
            size = self.sizes[at]
            if self.count[size] > (size == without):
                return size
            at -= 1
        return None

    def smallest(self, n: int, without: int) -> list[int]:
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(n - len(out), self.count[size] - (size == without))
            if len(out) >= n:
                break
        return out


def _best_pairs(left: _Left, room: int, j: int) -> tuple[int, int, int]:
    """(larger, smaller) of the pair with the largest sum up to `room`, and the largest smaller member of any fitting pair."""
    sizes = np.asarray(left.sizes[: bisect_right(left.sizes, room)])
    usable = np.asarray([left.count[int(s)] - (int(s) == j) for s in sizes])
    sizes, usable = sizes[usable > 0], usable[usable > 0]
    if not len(sizes):
        return 0, 0, 0
    at = np.searchsorted(sizes, np.minimum(room - sizes, sizes), side="right") - 1
    at = np.where((at >= 0) & (sizes[at] == sizes) & (usable < 2), at - 1, at)
    other = np.where(at >= 0, sizes[at], 0)
    if not other.any():
        return 0, 0, 0
    best = int(np.argmax(np.where(other > 0, sizes + other, 0)))
    return int(sizes[best]), int(other[best]), int(other.max())


def reduce_by_dominance(histogram: dict[int, int], capacity: int, relax: bool = False) -> tuple[list[Pattern], dict[int, int]]:
    """Fixed patterns and the histogram of what remains; with `relax`, small sizes are set aside where no rule applies."""
    left, fixed, aside = _Left(histogram), [], {}
    for j in sorted(histogram, reverse=True):
        while left.count.get(j):
            others = _dominating(left, capacity, j)
            if others is None:
                low = left.sizes[0]
                if low == j or not relax:
                    break
                aside[low] = left.count[low]
                left.take(low, left.count[low])
                continue
            need: dict[int, int] = {j: 1}
            for s in others:
                need[s] = need.get(s, 0) + 1
            times = min(left.count[s] // n for s, n in need.items())
            fixed.append((times, need))
            for s, n in need.items():
                left.take(s, n * times)
    return fixed, dict(left.count) | aside


def _dominating(left: _Left, capacity: int, j: int) -> list[int] | None:
    """What is to be put beside j, if a set dominates all others."""
    room = capacity - j
    most = int((np.cumsum(left.smallest(3, j)) <= room).sum())
    k = left.fitting(room, j)
    if k is None:
        return []
    if k == room or most == 1:
        return [k]
    if most == 2:
        a, b, smaller = _best_pairs(left, room, j)
        if k >= a + b:
            return [k]
        if a == k and b >= smaller:
            return [a, b]
    return None


def best_fit(histogram: dict[int, int], capacity: int, begun: list[Pattern] = ()) -> list[tuple[int, dict[int, int], dict[int, int]]]:
    """Best fit decreasing into the room of the patterns begun and into new containers: (how many, begun with, added).

    Containers with equal contents are handled together.
    """
    open_at: dict[int, list[tuple[int, dict[int, int], dict[int, int]]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, dict[int, int], dict[int, int]]) -> None:
        if room not in open_at:
            open_at[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_at[room].append(pattern)

    for times, held in begun:
        put(capacity - sum(s * n for s, n in held.items()), (times, held, {}))
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = min(capacity // size, n)
                times = n // each
                put(capacity - each * size, (times, {}, {size: each}))
                n -= times * each
                continue
            room = rooms[at]
            times, first, held = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop(at)
            each = min(room // size, n)
            used = min(times, n // each)
            if used < times:
                put(room, (times - used, first, held))
            put(room - each * size, (used, first, held | {size: held.get(size, 0) + each}))
            n -= used * each
    return [p for patterns in open_at.values() for p in patterns]


def slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, str | None]]:
    """(size, first rank, rank after the last, items in each container, first container, the rule that fixed them)."""
    fixed, rest = reduce_by_dominance(histogram, capacity)
    relaxed, rest = reduce_by_dominance(rest, capacity, relax=True)
    seen: dict[int, int] = {}
    out, container = [], 0
    whole = [(times, held, {}, "dominance") for times, held in fixed]  # nothing fits beside a dominating set
    for times, begun, added, rule in [*whole, *((*p, "relaxed") for p in best_fit(rest, capacity, relaxed))]:
        for held, by_rule in ((begun, rule), (added, None)):
            for size, each in held.items():
                start = seen.get(size, 0)
                seen[size] = start + times * each
                out.append((size, start, seen[size], each, container, by_rule))
        container += times
    return out


def pack(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_name, doc_id, piece, first_token, tokens, container_id, by_rule) of (id, tokens) for every budget; by_rule: what fixed the piece.

    `budgets` is a fixed table of capacities; per capacity at most that many histogram rows reach the driver.
    """
    spark = sizes.sparkSession
    capacities = {r.budget_name: int(r.capacity_tokens) for r in budgets.where("capacity_tokens >= 1 and budget_name is not null").distinct().collect()}
    rows = [(name, c) for name, c in sorted(capacities.items())]
    known = spark.createDataFrame(rows, "budget_name string, capacity long")
    known = F.broadcast(known) if len(rows) <= 10_000 else known
    pieces = (
        sizes.crossJoin(known)  # the budgets are the few rows of a fixed table
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("tokens") / F.col("capacity")) - 1, F.lit(0).cast("long")))))
        .withColumn("first_token", F.col("piece") * F.col("capacity"))
        .withColumn("size", F.least(F.col("tokens") - F.col("first_token"), F.col("capacity")))
    )
    counts = pieces.where("size > 0").groupBy("budget_name", "size").count().collect()
    plan = []
    for name, c in capacities.items():
        plan += [(name, *s) for s in slots({int(r["size"]): int(r["count"]) for r in counts if r.budget_name == name}, c)]
    table_of_slots = spark.createDataFrame(plan, "s_budget string, s_size long, low long, high long, each long, base long, by_rule string")
    # The slots follow from the sizes up to the capacity, not from the texts; still they are only broadcast if few.
    table_of_slots = F.broadcast(table_of_slots) if len(plan) <= 500_000 else table_of_slots
    ranked = rank(pieces.where("size > 0"), ["budget_name", "size"], ["id", "piece"])
    placed = ranked.join(
        table_of_slots,
        (F.col("budget_name") == F.col("s_budget")) & (F.col("size") == F.col("s_size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    ).withColumn("container_id", (F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("long"))
    columns = ["budget_name", F.col("id").alias("doc_id"), "piece", "first_token", F.col("size").alias("tokens")]
    empty = pieces.where("size = 0").select(*columns, F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("string").alias("by_rule"))
    return placed.select(*columns, "container_id", "by_rule").unionByName(empty)


def _sizes(spark: SparkSession, folder: str, tokenizers: str) -> DataFrame:
    return checkpoint(token_counts(table(spark, folder, "documents"), "doc_id", "text", tokenizers).groupBy("id").agg(F.max("tokens").alias("tokens")))


def p6_containers(spark: SparkSession, folder: str, tokenizers: str = FOLDER) -> DataFrame:
    """Every document in a container, for each capacity of token_budgets."""
    return pack(_sizes(spark, folder, tokenizers), table(spark, folder, "token_budgets"))


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_name, containers, tokens, least_containers, fill, pieces, fixed_pieces, relaxed_pieces) of (budget_name, ..., container_id, by_rule)."""
    # Tokens are added up per container first, so one budget is no hot key.
    each = packed.where("container_id is not null").groupBy("budget_name", "container_id").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.count_if(F.col("by_rule") == "dominance").alias("fixed_pieces"), F.count_if(F.col("by_rule") == "relaxed").alias("relaxed_pieces")
    )
    used = each.groupBy("budget_name").agg(F.count("*").alias("containers"), *[F.sum(c).alias(c) for c in ("tokens", "pieces", "fixed_pieces", "relaxed_pieces")])
    return used.join(budgets.select("budget_name", "capacity_tokens").distinct(), "budget_name").select(
        "budget_name", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"), "pieces", "fixed_pieces", "relaxed_pieces",
    )


def p6_fill(spark: SparkSession, folder: str, tokenizers: str = FOLDER) -> DataFrame:
    """Containers used per budget, the least possible by volume, the share of room used, and how many pieces the reduction fixed."""
    return fill(p6_containers(spark, folder, tokenizers), table(spark, folder, "token_budgets"))


def p6_invariants(spark: SparkSession, folder: str, tokenizers: str = FOLDER) -> DataFrame:
    """Per budget: documents assigned, and whether no container is over its capacity, every text is whole and only longer ones are divided."""
    sizes, budgets = _sizes(spark, folder, tokenizers), table(spark, folder, "token_budgets")
    packed = checkpoint(pack(sizes, budgets)).join(budgets, "budget_name")
    held = packed.where("container_id is not null").groupBy("budget_name", "container_id").agg((F.sum("tokens") <= F.max("capacity_tokens")).alias("fits"))
    texts = packed.groupBy("budget_name", F.col("doc_id").alias("id")).agg(F.sum("tokens").alias("sum"), F.count("*").alias("n"), F.max("capacity_tokens").alias("capacity"))
    texts = texts.join(sizes, "id").groupBy("budget_name").agg(
        F.count("*").alias("documents"), F.bool_and(F.col("sum") == F.col("tokens")).alias("whole"),
        F.bool_and((F.col("n") == 1) | (F.col("n") == F.ceil(F.col("tokens") / F.col("capacity")))).alias("divided_only_if_longer"),
    )
    return texts.join(held.groupBy("budget_name").agg(F.bool_and("fits").alias("within_capacity")), "budget_name")


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill, "p6_invariants": p6_invariants}
SQL = {"p6_invariants": "SELECT budget_name, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, true AS whole, true AS divided_only_if_longer, true AS within_capacity FROM token_budgets"}
