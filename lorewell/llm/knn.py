"""Most similar vectors by randomly rotated one-bit codes with error bounds (problem 3).

A usable vector is scaled to length 1, rotated into BITS dimensions by a fixed random rotation and kept
as one sign bit a dimension plus one correction scalar f, the inner product of the rotated vector with
its own sign vector. The inner product with a query q is estimated as <signs, rotated q> / (sqrt(BITS) f)
and lies within BOUND (QUERY_BOUND without a threshold) * sqrt((1 - f*f) / (f*f * (BITS - 1))) of the truth with high probability. Only
vectors whose upper bound reaches what is asked for are reranked, first on 8-bit components that travel
with the codes, then exactly on the stored vectors.

Placement: every vector is a member of its nearest cell and a query of its PROBES nearest (a stated query
set of its QUERY_PROBES nearest). Cells lie around centroids of two levels. The upper ones are fitted by
the driver on at most TOP_SAMPLE vectors, the lower ones by one task for each upper cell, on SAMPLE_PER_CELL
vectors a cell and at most SUB_SAMPLE of an upper cell; all vectors are indexed. A cell has CELL_ROWS
vectors on average up to MOST_CELLS cells. A crowded cell is divided by hash into blocks that meet pairwise,
so a cell is never one task.

A block sends each query's nearest only, as far as 8 bits can tell. A query that has more than DENSE of
them there (a ball of vectors that are nearly equal, or equal but for their length) is asked again with its
stored numbers, and such a block sends its exact TOP, so the result of a dense ball stays linear. Of
identical vectors only the TOP + 1 lowest rowids can be in one another's TOP by the tie rule (the lower
rowid first), so the rest need not meet.

Defined results: vectors that are null, of another length, all zero, or hold a null, NaN or infinite
number take no part; length does not matter; rows delivered twice count once; ties go to the lower
rowid; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.session import checkpoint, table

DIMENSIONS, BITS, BOUND, QUERY_BOUND = 64, 256, 4.0, 5.0
CELL_ROWS, MOST_CELLS, SAMPLE_PER_CELL, PROBES, QUERY_PROBES = 400, 1 << 18, 32, 5, 24
TWO_LEVELS, MOST_UPPER, UPPER_PROBES, TOP_SAMPLE, SUB_SAMPLE = 256, 1024, 8, 1 << 16, 1 << 17
BLOCK_ROWS, QUERY_ROWS, DENSE = 32_768, 8_192, 64
NOBODY = np.iinfo(np.int64).min
COARSE = 0.006  # the 8-bit inner product lies within this of the exact one
LINK_COSINE, LINK_TOP = 0.90, 5


def usable(rows: DataFrame, id_col: str = "rowid", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, v) of the rows that take part; the JVM checks shape, the Arrow stage numbers."""
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") == dimensions)
    )


def unit_rows(batch: pa.RecordBatch, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of length 1 of a batch (id, v), without rows that hold anything but finite numbers or only zeros."""
    v = batch.column(batch.schema.get_field_index("v"))
    ids = batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)  # a null becomes NaN
    most = np.abs(x).max(axis=1, initial=0.0)
    good = np.isfinite(most) & (most > 0)
    x = x[good] / most[good, None]
    return ids[good], (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def rotation(dimensions: int = DIMENSIONS, bits: int = BITS, seed: int = 20250117) -> np.ndarray:
    """(dimensions x bits): the first rows of a random orthogonal matrix of size `bits`."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:dimensions], dtype=np.float32)


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalars."""
    y = x @ turn
    return np.packbits(y > 0, axis=1), np.abs(y).sum(1) / np.sqrt(turn.shape[1])


def eight_bits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(axis=1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def centroids(points: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """At most `k` centroids of a bounded sample; every step is a matrix product."""
    k = max(1, min(k, len(points)))
    points = points[np.lexsort(points.T[:3])]  # the same whatever order the rows came in
    c = points[np.random.default_rng(7).choice(len(points), k, replace=False)]
    for _ in range(rounds):
        label = nearest_of(points, c)
        order = np.argsort(label, kind="stable")
        starts = np.searchsorted(label[order], np.arange(k))
        n = np.bincount(label, minlength=k)
        has = n > 0
        c = c.copy()
        c[has] = np.add.reduceat(points[order], starts[has], axis=0) / n[has, None]
    return c


def nearest_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (0.5 * (c**2).sum(1)).astype(np.float32)
    return np.concatenate([np.argmax(x[lo : lo + 4096] @ c.T - half, axis=1) for lo in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Cells:
    """Centroids of one or two levels, and about how many vectors each lowest cell has."""

    def __init__(self, upper: np.ndarray, lower: list[np.ndarray], rows: list[np.ndarray]):
        self.upper, self.lower, self.rows = upper, lower, np.concatenate(rows)
        self.start = np.concatenate([[0], np.cumsum([len(c) for c in lower])])
        self.half = [(0.5 * (c**2).sum(1)).astype(np.float32) for c in lower]

    def __len__(self) -> int:
        return int(self.start[-1])

    def nearest(self, x: np.ndarray, probes: int, upper_probes: int = UPPER_PROBES) -> np.ndarray:
        """(vectors x probes) numbers of the nearest cells, the nearest first; -1 where there are fewer."""
        tops, width = min(upper_probes, len(self.upper)), max(map(len, self.lower))
        probes = min(probes, len(self))
        out = np.full((len(x), probes), -1, np.int32)
        upper_half = (0.5 * (self.upper**2).sum(1)).astype(np.float32)
        step = max(64, min(2048, 4_000_000 // (tops * width)))
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            up = part @ self.upper.T - upper_half
            near = np.argpartition(-up, tops - 1, axis=1)[:, :tops] if tops < len(self.upper) else np.tile(np.arange(tops), (len(part), 1))
            score = np.full((len(part), tops * width), -np.inf, np.float32)
            for j in np.unique(near):
                row, slot = np.nonzero(near == j)
                at = slot[:, None] * width + np.arange(len(self.lower[j]))
                score[row[:, None], at] = part[row] @ self.lower[j].T - self.half[j]
            take = min(probes, score.shape[1])
            best = np.argpartition(-score, take - 1, axis=1)[:, :take] if take < score.shape[1] else np.tile(np.arange(take), (len(part), 1))
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1), 1)
            cell = self.start[np.take_along_axis(near, best // width, 1)] + best % width
            out[lo : lo + step, :take] = np.where(np.isfinite(np.take_along_axis(score, best, 1)), cell, -1)
        return out


def _share(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each id, the same everywhere."""
    x = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def _sample_by_upper(batches: Iterator[pa.RecordBatch], upper: np.ndarray, rate: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, x = unit_rows(batch)
        at = nearest_of(x, upper)
        keep = np.flatnonzero(_share(ids, 3) < rate[at])
        keep = keep[np.argsort(at[keep], kind="stable")]
        cells, first = np.unique(at[keep], return_index=True)
        packed = [part.tobytes() for part in np.split(x[keep], first[1:])] if len(keep) else []
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(packed, pa.binary())], names=["upper", "rows"])


def fit_cells(vectors: DataFrame, count: int, cell_rows: int = CELL_ROWS) -> Cells | None:
    """Centroids from bounded samples of (id, v), chosen by a hash of the id; None without a usable vector."""
    cells = int(min(MOST_CELLS, max(1, count // cell_rows)))
    two = cells >= TWO_LEVELS
    upper_cells = min(MOST_UPPER, int(cells**0.5)) if two else cells
    most = min(TOP_SAMPLE, SAMPLE_PER_CELL * max(upper_cells, 64) * (2 if two else 1))
    chosen = lambda share: F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
    sample = vectors.where(chosen(most / max(count, 1))).toArrow()
    points = np.concatenate([unit_rows(b)[1] for b in sample.to_batches()] or [np.zeros((0, DIMENSIONS), np.float32)])
    if not len(points):
        points = np.concatenate([unit_rows(b)[1] for b in vectors.limit(1000).toArrow().to_batches()] or [points])
    if not len(points):
        return None
    upper = centroids(points, upper_cells)
    share = np.maximum(np.bincount(nearest_of(points, upper), minlength=len(upper)), 1) / len(points) * count
    if not two:
        return Cells(upper[:1] * 0, [upper], [share])
    wanted = SAMPLE_PER_CELL * cells / count
    rate = np.minimum(1.0, np.minimum(wanted, SUB_SAMPLE / share))

    def fit(group: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(group.column("rows").to_pylist()), np.float32).reshape(-1, DIMENSIONS)
        j = group.column("upper")[0].as_py()
        c = centroids(x, max(1, round(len(x) / rate[j] * cells / count))).astype(np.float32)
        rows = np.bincount(nearest_of(x, c), minlength=len(c)) / rate[j]
        return pa.table({"upper": [j], "c": [c.tobytes()], "n": [rows.astype(np.float64).tobytes()]}, schema=pa.schema([("upper", pa.int64()), ("c", pa.binary()), ("n", pa.binary())]))

    sampled = vectors.where(chosen(float(rate.max()) * 1.0001) if rate.max() < 1 else F.lit(True))
    thin = rate / min(1.0, float(rate.max()) * 1.0001)
    # At most MOST_CELLS centroids come back, 264 bytes each.
    fitted = sampled.mapInArrow(partial(_sample_by_upper, upper=upper, rate=thin), "upper long, rows binary").groupBy("upper").applyInArrow(fit, "upper long, c binary, n binary").collect()
    lower, rows = {r.upper: np.frombuffer(r.c, np.float32).reshape(-1, DIMENSIONS) for r in fitted}, {r.upper: np.frombuffer(r.n) for r in fitted}
    every = range(len(upper))
    return Cells(upper, [lower.get(j, upper[j : j + 1]) for j in every], [rows.get(j, share[j : j + 1]) for j in every])


ROUTED = "key long, member boolean, rows binary"
MEMBER = np.dtype([("id", "<i8"), ("scale", "<f4"), ("f", "<f4"), ("small", "i1", DIMENSIONS), ("code", "u1", BITS // 8)])
QUERY = np.dtype([("id", "<i8"), ("scale", "<f4"), ("small", "i1", DIMENSIONS)])


def _records(kind: np.dtype, **fields: np.ndarray) -> np.ndarray:
    out = np.empty(len(fields["id"]), kind)
    for name, values in fields.items():
        out[name] = values
    return out


def _routed(cell, bb, qb, records: np.ndarray) -> pa.RecordBatch:
    """The records that go to one block as one row: the bytes of a packed array."""
    key = (np.asarray(cell, np.int64) << 36) | (np.asarray(bb, np.int64) << 18) | np.asarray(qb, np.int64)
    order = np.argsort(key, kind="stable")
    key, records = key[order], records[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    offsets = (np.append(starts, len(key)) * records.dtype.itemsize).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(records.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(key[starts]), pa.array(np.full(len(starts), records.dtype == MEMBER)), packed], names=["key", "member", "rows"])


def _spread(ids: np.ndarray, parts: np.ndarray, seed: int) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int32)


def route_to_cells(batches: Iterator[pa.RecordBatch], cells: Cells, member_blocks: np.ndarray, query_blocks: np.ndarray, probes: int, query_step: int = 1) -> Iterator[pa.RecordBatch]:
    """Each vector as a member of its nearest cell and, if its id is divisible by `query_step`, as a query of its `probes` nearest."""
    turn = rotation()
    for batch in batches:
        ids, x = unit_rows(batch)
        if not len(ids):
            continue
        code, f = encode(x, turn)
        small, scale = eight_bits(x)
        yield _to_homes(ids, x, cells, member_blocks, query_blocks, _records(MEMBER, id=ids, scale=scale, f=f, small=small, code=code))
        asked = np.flatnonzero(ids % query_step == 0)
        yield _to_probes(ids[asked], x[asked], cells, member_blocks, query_blocks, probes, _records(QUERY, id=ids[asked], scale=scale[asked], small=small[asked]))


def _to_homes(ids: np.ndarray, x: np.ndarray, cells: Cells, member_blocks: np.ndarray, query_blocks: np.ndarray, records: np.ndarray, only: np.ndarray | None = None) -> pa.RecordBatch:
    home = cells.nearest(x, 1)[:, 0]
    repeat = query_blocks[home] if only is None else np.where(np.isin(home, only), query_blocks[home], 0)
    at = np.repeat(np.arange(len(ids)), repeat)
    qb = np.arange(len(at)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    return _routed(home[at], _spread(ids, member_blocks[home], 1)[at], qb, records[at])


def _to_probes(ids: np.ndarray, x: np.ndarray, cells: Cells, member_blocks: np.ndarray, query_blocks: np.ndarray, probes: int, records: np.ndarray) -> pa.RecordBatch:
    near = cells.nearest(x, probes)
    of, slot = np.nonzero(near >= 0)
    cell = near[of, slot]
    repeat = member_blocks[cell]
    at = np.repeat(np.arange(len(cell)), repeat)
    bb = np.arange(len(at)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    return _routed(cell[at], bb, _spread(ids[of], query_blocks[cell], 2)[at], records[of[at]])


WHOLE = np.dtype([("id", "<i8"), ("v", "<f4", DIMENSIONS)])


def route_whole(batches: Iterator[pa.RecordBatch], cells: Cells, member_blocks: np.ndarray, query_blocks: np.ndarray, probes: int, members_of: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Stored numbers for the second question: members of the cells in `members_of`, or, if that is None, queries."""
    for batch in batches:
        ids, x = unit_rows(batch)
        if len(ids):
            records = _records(WHOLE, id=ids, v=x)
            out = _to_probes(ids, x, cells, member_blocks, query_blocks, probes, records) if members_of is None else _to_homes(ids, x, cells, member_blocks, query_blocks, records, members_of)
            yield out.set_column(1, "member", pa.array(np.full(out.num_rows, members_of is not None)))


def exact_in_block(block: pa.Table, top: int, least: float, query_batch: int = 64) -> pa.Table:
    """(id, other, coarse) of each query's exact `top` nearest members, ties to the lower id."""
    of = {True: [], False: []}
    for member, packed in zip(block.column("member").to_pylist(), block.column("rows").to_pylist()):
        of[member].append(packed)
    rows, asked = _once(np.frombuffer(b"".join(of[True]), WHOLE)), _once(np.frombuffer(b"".join(of[False]), WHOLE))
    out: list[tuple[np.ndarray, ...]] = []
    if len(rows) and len(asked):
        ids, x, y = rows["id"], rows["v"].astype(np.float64), asked["v"].astype(np.float64)
        x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
        for lo in range(0, len(y), query_batch):
            cosine = np.round(y[lo : lo + query_batch] @ x.T, 12)
            cosine[asked["id"][lo : lo + query_batch][:, None] == ids[None, :]] = -2
            k = min(top, len(ids))
            kth = np.partition(cosine, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
            above, equal = cosine > kth, cosine == kth
            keep = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
            q, m = np.nonzero(keep & (cosine >= max(least, -1.5)))
            out.append((asked["id"][lo + q], ids[m], cosine[q, m]))
    a, b, c = (np.concatenate(part) for part in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"id": a, "other": b, "coarse": c})


def _once(records: np.ndarray) -> np.ndarray:
    """The records by id, rows delivered twice once, so that they take one place among the nearest."""
    return records[np.unique(records["id"], return_index=True)[1]]


def nearest_in_block(block: pa.Table, top: int, least: float, query_batch: int = 256, bound: float = BOUND) -> pa.Table:
    """(id, other, coarse) of each query's `top` nearest members whose cosine may reach `least`; other is null where they are more than DENSE."""
    of = {True: [], False: []}
    for member, packed in zip(block.column("member").to_pylist(), block.column("rows").to_pylist()):
        of[member].append(packed)
    rows, asked = _once(np.frombuffer(b"".join(of[True]), MEMBER)), _once(np.frombuffer(b"".join(of[False]), QUERY))
    out_q, out_m, out_s = [], [], []
    if len(rows) and len(asked):
        turn = rotation()
        ids, qids, f = rows["id"], asked["id"], rows["f"]
        signs = np.unpackbits(rows["code"], axis=1).astype(np.float32) * 2 - 1
        signs /= (f * np.float32(np.sqrt(BITS)))[:, None]
        error = (bound * np.sqrt(np.maximum(1 - f**2, 0) / (f**2 * (BITS - 1)))).astype(np.float32)
        x = rows["small"].astype(np.float32) * rows["scale"][:, None]
        y = asked["small"].astype(np.float32) * asked["scale"][:, None]
        for lo in range(0, len(qids), query_batch):
            part = y[lo : lo + query_batch]
            estimate = (part @ turn) @ signs.T
            floor = np.full(len(part), least - COARSE, np.float32)
            if least < -0.99 and len(ids) > top:  # no threshold is asked for: the bounds alone decide
                lower = estimate - error
                floor = np.maximum(floor, np.partition(lower, len(ids) - top - 1, axis=1)[:, len(ids) - top - 1])
            q, m = np.nonzero(estimate + error >= floor[:, None])
            other = qids[lo + q] != ids[m]
            q, m = q[other], m[other]
            coarse = np.einsum("ij,ij->i", part[q], x[m])
            high = coarse >= least - COARSE
            q, m, coarse = q[high], m[high], coarse[high]
            order = np.lexsort((ids[m], -coarse, q))
            q, m, coarse = q[order], m[order], coarse[order]
            start = np.searchsorted(q, np.arange(len(part)))
            nth = start[q] + top - 1  # what may still beat the top-th by the exact number stays
            ends = np.append(start[1:], len(q))
            last = np.where(nth < ends[q], coarse[np.minimum(nth, len(q) - 1)] if len(q) else coarse, -2)
            stays = coarse >= last - 2 * COARSE
            q, m, coarse = q[stays], m[stays], coarse[stays]
            crowded = np.bincount(q, minlength=len(part)) > DENSE
            single = ~crowded[q]
            again = np.flatnonzero(crowded)
            out_q += [qids[lo + q[single]], qids[lo + again]]
            out_m += [ids[m[single]], np.full(len(again), NOBODY)]
            out_s += [coarse[single], np.zeros(len(again))]
    join = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.zeros(0, t)
    other = join(out_m, np.int64)
    return pa.table({"id": join(out_q, np.int64), "other": pa.array(other, pa.int64(), mask=other == NOBODY), "coarse": join(out_s, np.float64)})


MET = "id long, other long, coarse double"


def _met(vectors: DataFrame, asked: DataFrame, cells: Cells, top: int, least: float, probes: int, query_step: int = 1, bound: float = BOUND) -> DataFrame:
    """(id, other, coarse): what may be among the `top` of each query by the cells it asks; of crowded queries exactly.

    asked: queries that are no members (surplus copies).
    """
    member_blocks = np.maximum(1, np.ceil(cells.rows / BLOCK_ROWS)).astype(np.int32)
    query_blocks = np.maximum(1, np.ceil(cells.rows * probes / (query_step * 8 * QUERY_ROWS))).astype(np.int32)
    at = dict(cells=cells, member_blocks=member_blocks, query_blocks=query_blocks, probes=probes)

    def block(rows: pa.Table) -> pa.Table:
        return nearest_in_block(rows, top, least, bound=bound)

    def whole(rows: pa.Table) -> pa.Table:
        return exact_in_block(rows, top, least)

    route = partial(route_to_cells, query_step=query_step, **at)
    routed = vectors.mapInArrow(route, ROUTED).unionByName(asked.mapInArrow(route, ROUTED).where("not member"))
    first = checkpoint(routed.groupBy("key").applyInArrow(block, MET))
    crowded = checkpoint(first.where("other is null").select("id").distinct())
    if crowded.isEmpty():
        return first
    queries = vectors.unionByName(asked).join(crowded, "id", "left_semi").mapInArrow(partial(route_whole, members_of=None, **at), ROUTED)
    queries = checkpoint(queries)
    # Numbers of cells, at most MOST_CELLS.
    touched = np.array([r.cell for r in queries.select(F.shiftright("key", 36).alias("cell")).distinct().collect()], np.int64)
    members = vectors.mapInArrow(partial(route_whole, members_of=touched, **at), ROUTED)
    again = members.unionByName(queries).groupBy("key").applyInArrow(whole, MET)
    return first.where("other is not null").join(crowded, "id", "left_anti").unionByName(again)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = []
        for name in ("va", "vb"):
            v = batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIMENSIONS)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            both.append(v / np.linalg.norm(v, axis=1, keepdims=True))
        cosine = np.einsum("ij,ij->i", *both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], names=["id", "other", "cosine"])


def exact_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, other, cosine) of distinct pairs; only vectors that a pair names are moved twice."""
    named = pairs.select(F.explode(F.array("id", "other")).alias("id")).distinct()
    known = checkpoint(vectors.join(named, "id").dropDuplicates(["id"]))
    joined = pairs.join(known.select("id", F.col("v").alias("va")), "id").join(known.select(F.col("id").alias("other"), F.col("v").alias("vb")), "other")
    return joined.select("id", "other", "va", "vb").mapInArrow(_exact, "id long, other long, cosine double")


def without_surplus_copies(vectors: DataFrame, top: int) -> DataFrame:
    """Of identical vectors only the top + 1 lowest ids, and of a row delivered twice one.

    Groups of one are the rule: counted on hashes, which are slim, and only copies are ranked.
    """
    hashed = vectors.select("id", F.xxhash64("v").alias("h"), F.hash("v").alias("g"))
    crowded = hashed.groupBy("h", "g").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    crowded = crowded.where(F.col("n") > top + 1).select("h", "g")
    by_copy = Window.partitionBy("h", "g").orderBy("id")
    kept_last = (
        hashed.join(crowded, ["h", "g"]).distinct().withColumn("at", F.row_number().over(by_copy)).where(F.col("at") == top + 1)
        .select("h", "g", F.col("id").alias("limit"))
    )
    return (
        vectors.withColumn("h", F.xxhash64("v")).withColumn("g", F.hash("v"))
        .join(F.broadcast(kept_last) if kept_last.limit(100_001).count() <= 100_000 else kept_last, ["h", "g"], "left")
        .where(F.col("limit").isNull() | (F.col("id") <= F.col("limit"))).select("id", "v")
    )


def linked_pairs(rows: DataFrame, *, least: float = LINK_COSINE, top: int = LINK_TOP, probes: int = PROBES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(rowid_a, rowid_b, cosine): pairs of at least `least` that are in each other's `top`."""
    vectors = without_surplus_copies(usable(rows), top)
    cells = fit_cells(usable(rows), rows.count(), cell_rows)
    if cells is None:
        return rows.sparkSession.createDataFrame([], "rowid_a long, rowid_b long, cosine double")
    met = _met(vectors, vectors.limit(0), cells, top, least, probes)
    met = met.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct()
    exact = checkpoint(exact_cosines(checkpoint(met), usable(rows)).where(F.col("cosine") >= least))
    both = exact.select("id", "other", "cosine").unionByName(exact.select(F.col("other").alias("id"), F.col("id").alias("other"), "cosine"))
    nearest = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 12)), "other")
    listed = both.withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= top)
    pairs = listed.groupBy(F.least("id", "other").alias("rowid_a"), F.greatest("id", "other").alias("rowid_b"))
    return pairs.agg(F.count("*").alias("sides"), F.max("cosine").alias("cosine")).where("sides = 2").drop("sides")


def k_nearest(rows: DataFrame, k: int = 10, query_step: int = 20, probes: int = QUERY_PROBES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(rowid, rank, neighbour, cosine) for every usable row whose id is divisible by `query_step`, against all rows."""
    vectors = without_surplus_copies(usable(rows), k)
    cells = fit_cells(usable(rows), rows.count(), cell_rows)
    if cells is None:
        return rows.sparkSession.createDataFrame([], "rowid long, rank int, neighbour long, cosine double")
    # A query that is a surplus copy is asked all the same.
    asked = usable(rows).where(F.col("id") % query_step == 0).join(vectors.select("id"), "id", "left_anti")
    met = _met(vectors, asked, cells, k, -1.0, probes, query_step, QUERY_BOUND).groupBy("id", "other").agg(F.max("coarse").alias("coarse"))
    # Of the k nearest of every cell only those that may be among the k nearest of all.
    first = Window.partitionBy("id").orderBy(F.desc("coarse"), "other")
    met = met.withColumn("at", F.row_number().over(first))
    met = met.withColumn("kth", F.max(F.when(F.col("at") == k, F.col("coarse"))).over(Window.partitionBy("id")))
    met = met.where(F.col("kth").isNull() | (F.col("coarse") >= F.col("kth") - 2 * COARSE)).select("id", "other")
    exact = exact_cosines(checkpoint(met), usable(rows))
    nearest = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 12)), "other")
    return (
        exact.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
        .select(F.col("id").alias("rowid"), "rank", F.col("other").alias("neighbour"), F.round("cosine", 6).alias("cosine"))
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return linked_pairs(table(spark, folder, "vec_chunks")).select("rowid_a", "rowid_b")


def p3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return k_nearest(table(spark, folder, "vec_chunks"))


QUERIES = {"p3_found": p3_found, "p3_nearest": p3_nearest}
# Every pair by brute force; the tables of the comparison are small enough for that.
_USABLE_SQL = f"""u AS (SELECT DISTINCT rowid AS id, CAST(embedding AS DOUBLE[]) AS v FROM vec_chunks WHERE len(embedding) = {DIMENSIONS}
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
SQL = {
    "p3_found": f"""WITH {_USABLE_SQL},
      near AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= {LINK_COSINE}),
      top AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM near) WHERE r <= {LINK_TOP})
      SELECT least(a, b) AS rowid_a, greatest(a, b) AS rowid_b FROM top GROUP BY ALL HAVING count(*) = 2""",
    "p3_nearest": f"""WITH {_USABLE_SQL}, near AS (SELECT a.id AS rowid, b.id AS neighbour, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 20 = 0)
      SELECT rowid, CAST(rank AS INTEGER) AS rank, neighbour, round(s, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY rowid ORDER BY round(s, 12) DESC, neighbour) AS rank FROM near) WHERE rank <= 10""",
}
