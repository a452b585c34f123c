import datetime as dt

from lorewell.operators import orphans
from lorewell.operators.orphans import Reference, asof_present, orphan_references, parent_runs

T = lambda d: dt.datetime(2024, 1, d)
REF = Reference("child", "id", "parent_id", "at", "parent", "pid", "made", "parent")
CHILD, PARENT, LOG = "id long, parent_id long, at timestamp, k string", "pid long, made timestamp, at string", "table_name string, record_key string, deleted_at timestamp"


def test_runs_are_cut_at_blocks_and_gaps(spark):
    keys = spark.createDataFrame([(k,) for k in (0, 1, 2, 5, 6, 9, 10, 11, 11, None)], "k long")
    runs = {(r.run_start, r.run_end) for r in parent_runs(keys, "k", block=4).collect()}
    assert runs == {(0, 2), (5, 6), (9, 11)}


def test_asof_against_brute_force(spark):
    parents = [k for k in range(-40, 400) if k % 7 and k % 11 != 3]
    refs = list(range(-60, 430, 1))
    runs = parent_runs(spark.createDataFrame([(k,) for k in parents], "k long"), "k", block=32)
    got = {r.k: r.present for r in asof_present(spark.createDataFrame([(k,) for k in refs], "k long"), runs, block=32).collect()}
    assert got == {k: k in set(parents) for k in refs}


def test_kinds_nulls_repeats_and_clashing_columns(spark):
    child = spark.createDataFrame(
        [(1, 10, T(5), "x"), (1, 10, T(5), "x"), (2, 11, None, "x"), (3, 12, T(2), "x"), (4, 13, T(9), None), (5, None, T(1), "x"), (6, 14, T(1), "x"), (7, 15, T(1), "x")], CHILD
    )
    parent = spark.createDataFrame([(12, T(3), "y"), (12, T(3), "y"), (13, T(3), "y"), (15, None, "y"), (None, T(1), "y")], PARENT)
    log = spark.createDataFrame([("parent", "10", T(1)), ("parent", "10", T(2)), ("other", "11", T(1)), ("parent", None, T(1))], LOG)
    got = sorted((r.row_id, r.kind, r.period) for r in orphan_references(child, parent, log, REF).collect())
    assert got == [(1, "deleted", "2024-01"), (2, "missing", "unknown"), (3, "late", "2024-01"), (6, "missing", "2024-01")]


def test_empty_tables(spark):
    none = orphan_references(spark.createDataFrame([], CHILD), spark.createDataFrame([], PARENT), spark.createDataFrame([], LOG), REF)
    assert none.count() == 0
    all_missing = orphan_references(spark.createDataFrame([(1, 1, None, None)], CHILD), spark.createDataFrame([], PARENT), spark.createDataFrame([], LOG), REF)
    assert [r.kind for r in all_missing.collect()] == ["missing"]


def test_a_hot_key_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(orphans, "ROWS_A_SALT", 100)
    child = spark.range(3000).selectExpr("id", "cast(if(id % 3 = 0, id, -7) as long) as parent_id", "timestamp'2024-02-01' as at", "'' as k")
    parent = spark.range(3000).selectExpr("id as pid", "cast(null as timestamp) as made", "'' as at")
    got = orphan_references(child, parent, spark.createDataFrame([], LOG), REF)
    assert got.count() == 2000 and {r.period for r in got.select("period").distinct().collect()} == {"2024-02"}
