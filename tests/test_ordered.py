import random

from lorewell.operators.ordered import following, places, rank, running_sum


def test_rank_and_running_sum(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 5}", i % 7) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, w long")
    ranks = rank(df, ["g"], ["id"], bits=4).collect()
    by = {}
    for r in ranks:
        by.setdefault(r.g, []).append(r["rank"])
    assert len(ranks) == 600 and all(sorted(v) == list(range(len(v))) for v in by.values())
    sums = running_sum(df, ["g"], ["id"], "w", "upto", bits=4).collect()
    assert {g: max(r.upto for r in sums if r.g == g) for g in by} == {g: sum(w for _, x, w in rows if x == g) for g in by}


def test_places_and_neighbours_match_a_sort(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice([None, 0, 0, 0, rng.randrange(2000)])) for i in rng.sample(range(300_000), 400)]
    df = spark.createDataFrame(rows, "id long, g string, ix int")
    placed = places(df, ["g"], "ix", "id")
    order = sorted(rows, key=lambda r: (r[1], r[2] is None, r[2] or 0, r[0]))
    expected, seen = {}, {}
    for i, g, _ in order:
        expected[i] = seen.get(g, 0)
        seen[g] = expected[i] + 1
    assert {r.id: r.place for r in placed.collect()} == expected
    after = {r.id: r.next_id for r in following(placed, ["g"], ["id"]).collect()}
    assert all(after[a[0]] == (b[0] if a[1] == b[1] else None) for a, b in zip(order, order[1:]))
