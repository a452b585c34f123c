import numpy as np
import pyarrow as pa

from lorewell.llm import knn

SCHEMA = "rowid long, embedding array<float>, v string"


def _frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [float(a) for a in v], "clash") for i, v in zip(ids or range(len(x)), x)], SCHEMA)


def _clustered(n=900, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, 64))
    return (np.repeat(centres, 6, axis=0) + rng.normal(size=(n // 6 * 6, 64)) * 0.28).astype("float32")


def _true_pairs(x, least=0.9, top=5):
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    near = [sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:top] for i in range(len(x))]
    return {(i, j) for i in range(len(x)) for j in near[i] if i < j and s[i, j] >= least and i in near[j]}


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64)).astype("float32")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = knn.rotation()
    assert np.allclose(turn @ turn.T, np.eye(64), atol=1e-4)
    code, f = knn.encode(x, turn)
    signs = np.unpackbits(code, axis=1).astype("float32") * 2 - 1
    q = x[:50] @ turn
    estimate = q @ (signs / (f * np.sqrt(knn.BITS))[:, None]).T
    error = knn.BOUND * np.sqrt((1 - f**2) / (f**2 * (knn.BITS - 1)))
    assert (np.abs(estimate - x[:50] @ x.T) <= error).mean() > 0.995


def test_linked_pairs_match_brute_force(spark):
    x = _clustered()
    got = {(r.rowid_a, r.rowid_b) for r in knn.linked_pairs(_frame(spark, x), cell_rows=60).collect()}
    true = _true_pairs(x)
    assert len(true) > 200 and len(got & true) >= 0.97 * len(true) and len(got - true) <= 0.03 * len(true)


def test_crowded_cells_are_divided_without_loss(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    monkeypatch.setattr(knn, "QUERY_ROWS", 20)
    x = _clustered(300)
    assert {(r.rowid_a, r.rowid_b) for r in knn.linked_pairs(_frame(spark, x), cell_rows=10_000).collect()} == _true_pairs(x)


def test_k_nearest_recall(spark):
    x = np.random.default_rng(4).normal(size=(1500, 64)).astype("float32")
    got = knn.k_nearest(_frame(spark, x)).collect()
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 20):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:10].tolist()) & {r.neighbour for r in got if r.rowid == q})
    assert len(got) == 750 and hits >= 0.97 * 750


def test_unusable_rows_repeats_and_copies(spark):
    a = np.zeros(64)
    a[0] = 1
    b = a.copy()
    b[1] = 0.2
    rows = [a, b * 7, None, a * 0, a[:3], np.where(a > 0, np.nan, a), np.where(a > 0, np.inf, a), b * 7]
    got = knn.linked_pairs(_frame(spark, rows, [10, 20, 30, 40, 50, 60, 70, 20])).collect()
    assert [(r.rowid_a, r.rowid_b) for r in got] == [(10, 20)]
    copies = knn.linked_pairs(_frame(spark, [a] * 40)).collect()
    assert {(r.rowid_a, r.rowid_b) for r in copies} == {(i, j) for i in range(6) for j in range(i + 1, 6)}
    assert knn.linked_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert knn.k_nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_elements_are_unusable():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([[None] + [1.0] * 63, [2.0] * 64], pa.list_(pa.float32()))], names=["id", "v"])
    ids, x = knn.unit_rows(batch)
    assert ids.tolist() == [2] and abs(np.linalg.norm(x) - 1) < 1e-6


def test_a_dense_ball_stays_linear():
    rng = np.random.default_rng(1)
    ball = (np.ones(64) + rng.normal(size=(4000, 64)) * 1e-4).astype("float32")
    ids = np.arange(4000)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(ball), pa.list_(pa.float32()))], names=["id", "v"])
    cells = knn.Cells(np.zeros((1, 64), "f4"), [ball[:1] / 8], [np.array([4000.0])])
    one = np.ones(1, np.int32)
    routed = pa.Table.from_batches(knn.route_to_cells(iter([batch]), cells, one, one, 5))
    first = knn.nearest_in_block(routed, 5, 0.9)
    assert first.num_rows == 4000 and first.column("other").null_count == 4000
    whole = [knn.route_whole(iter([batch]), cells, one, one, 5, m) for m in (None, np.zeros(1, np.int64))]
    again = knn.exact_in_block(pa.Table.from_batches([b for part in whole for b in part]), 5, 0.9)
    assert again.num_rows == 4000 * 5


def test_balls_of_nearly_equal_and_scaled_vectors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    ball = (np.ones((300, 64)) + rng.normal(size=(300, 64)) * 0.02).astype("float32")
    x = np.concatenate([ball, _clustered(300), [ball[0] * (i + 2) for i in range(100)]]).astype("float32")
    got = {(r.rowid_a, r.rowid_b) for r in knn.linked_pairs(_frame(spark, x[:600]), cell_rows=200).collect()}
    assert got == _true_pairs(x[:600])
    # Copies but for their length: the lowest rowids are one another's nearest.
    got = {(r.rowid_a, r.rowid_b) for r in knn.linked_pairs(_frame(spark, x), cell_rows=200).collect()}
    assert {(0, 600), (0, 601), (600, 601), (603, 604)} <= got and not {p for p in got if p[1] > 605 and p[0] in (0, *range(600, 700))}


def test_cells_of_two_levels(spark):
    x = _clustered(6000, seed=9)
    df = _frame(spark, x).repartition(4)
    cells = knn.fit_cells(knn.usable(df), 6000, 5)
    assert len(cells) > 1000 and len(cells.upper) > 20 and abs(cells.rows.sum() - 6000) < 900
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")
    flat = np.concatenate(cells.lower)
    best = np.argmax(unit @ flat.T - 0.5 * (flat**2).sum(1), axis=1)
    assert (cells.nearest(unit, 1)[:, 0] == best).mean() > 0.97
    got, true = {(r.rowid_a, r.rowid_b) for r in knn.linked_pairs(df, cell_rows=5).collect()}, _true_pairs(x)
    assert len(got & true) >= 0.95 * len(true) and len(got - true) <= 0.05 * len(true)


def test_k_nearest_by_cells(spark):
    x = _clustered(6000, seed=11)
    got = knn.k_nearest(_frame(spark, x), cell_rows=5).collect()
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 20):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & {r.neighbour for r in got if r.rowid == q})
    assert hits >= 0.95 * 5 * 300


def test_rows_delivered_twice_take_one_place(spark):
    x = np.random.default_rng(12).normal(size=(400, 64)).astype("float32")
    twice = _frame(spark, np.concatenate([x, x]), [*range(400), *range(400)])
    once = {(r.rowid, r.rank, r.neighbour) for r in knn.k_nearest(_frame(spark, x), k=3).collect()}
    assert {(r.rowid, r.rank, r.neighbour) for r in knn.k_nearest(twice, k=3).collect()} == once
