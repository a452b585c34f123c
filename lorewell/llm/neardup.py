"""Near-duplicate records by an adaptive forest of MinHash prefix tries, with exact verification (problem 5).

Every distinct text gets TRIES signatures over its word runs. In each trie the texts are sorted by
signature. A text looks for partners under its longest prefix first; the prefix is shortened until the
tries together meet a pair at the threshold with probability TARGET. Every text gets there, however many
texts share its prefixes: the depth follows from threshold, TRIES and TARGET alone (`full_depth`). In SHORT
of the tries it is shortened further where at most BUCKET texts share a still shorter prefix, which costs
little and brings the recall near 1. Texts under one prefix are compared whole, whatever their number.
Pairs must also agree in a 128-bit sketch (2 bits of 64 minima) to within SKETCH_DEVIATIONS deviations of
the threshold; whatever passes is verified on the exact sets of word runs.

Recall: a pair of similarity s shares a prefix of d minima in one trie with probability s**d, so at least
1 - (1 - s**d)**TRIES of the pairs are met, d being the full depth: 0.998 at s = 0.5 with d = 3, 0.9999 at
s = 0.55. The sketch keeps 0.9987 of the pairs at the threshold itself.

Groups: the pairs of a dense family grow with its square, its groups must not. The texts under a prefix
first meet only the least id among them; what is verified is connected. Then only texts of different
groups under one prefix are compared, all of them. So no link between groups is lost, and a family of
copies with small edits costs in proportion to its rows.

Scale: one shuffle of the distinct texts by their hash, one of TRIES slim rows a text by prefix, one of
the candidate pairs, then only the texts met by a candidate are read again. A short prefix shared by very
many texts (found on a sample of the distinct texts, so only prefixes that are not used anyway) is placed
by its longer prefix; a full prefix that many texts share is divided into blocks that meet pairwise in
tasks of their own. Copies of one text are collapsed before, and expanded afterwards by a join.

Defined results: null, blank and short texts take no part; rows delivered twice count once; an empty
table gives an empty result; whole texts are used, however long; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.session import checkpoint, forget, table

TRIES, SHORT, TARGET, BUCKET = 48, 8, 0.998, 64
HEAVY = 50_000
SAMPLE_ONE_IN = 64
SKETCH_DEVIATIONS = 3.0
WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def full_depth(threshold: float, tries: int = TRIES, target: float = TARGET) -> int:
    """The longest prefix with which the tries still meet a pair at the threshold with probability `target`."""
    depth = 1
    while 1 - (1 - threshold ** (depth + 1)) ** tries >= target:
        depth += 1
    return depth


def permutations(n: int) -> np.ndarray:
    """(2 x n) odd multipliers and masks, the same everywhere."""
    return np.random.default_rng(20240229).integers(1, 2**63, size=(n, 2), dtype=np.uint64).T | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, wrapping on overflow."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash for each word, equal on every machine; each different word is hashed once."""
    import xxhash

    known: dict[str, int] = {}
    out = np.empty(len(words), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w)
        out[i] = h
    return out


def shingle_hashes(texts: list[str | None], run: int, least_words: int, least_distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each kept text, offsets, hashes of its runs of `run` words, repeats included).

    A text needs `least_words` words and `least_distinct` different runs.
    """
    rows, lengths, words = [], [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        found = WORD.findall(t.lower())
        if len(found) < max(least_words, run) or (least_distinct > 1 and run == 1 and len(set(found)) < least_distinct):
            continue
        rows.append(i)
        lengths.append(len(found))
        words.extend(found)
    n = np.asarray(lengths, dtype=np.int64)
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    h = word_hashes(words)
    starts = np.concatenate([[0], np.cumsum(n)])
    combined = h.copy()
    for j in range(1, run):  # positions that run over the end of a text are removed below
        shifted = np.concatenate([h[j:], np.zeros(j, np.uint64)])
        combined = _mix(combined * _U(0x9E3779B97F4A7C15) + shifted)
    keep = np.ones(len(h), bool)
    for j in range(1, run):
        keep[starts[1:] - j] = False
    return np.asarray(rows, np.int64), np.concatenate([[0], np.cumsum(n - run + 1)]), _mix(combined[keep])


def minima(hashes: np.ndarray, offsets: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """(texts x permutations) minima of the permutations in `mix`."""
    out = np.empty((len(offsets) - 1, mix.shape[1]), dtype=np.uint64)
    for j in range(mix.shape[1]):
        v = (hashes ^ mix[0, j]) * mix[1, j]
        v ^= v >> _U(31)
        out[:, j] = np.minimum.reduceat(v, offsets[:-1])
    return out


Heavy = tuple[tuple[np.ndarray, np.ndarray], ...]  # for each level: sorted keys, and into how many blocks each is divided


def _prefixes(m: np.ndarray, depth: int) -> list[np.ndarray]:
    """The keys of the prefixes of one, half the and the full depth, each (texts x TRIES)."""
    key = np.broadcast_to(np.arange(1, TRIES + 1, dtype=np.uint64), (len(m), TRIES))
    levels = []
    for d in range(depth):
        key = _mix(key * _U(3) + m[:, d : TRIES * depth : depth])
        levels.append(key)
    return [levels[0], levels[(depth + 1) // 2 - 1], levels[-1]]


def signatures(
    batches: Iterator[pa.RecordBatch], depth: int, run: int, least_words: int, least_distinct: int, heavy: Heavy = (), sample: bool = False, labelled: bool = False
) -> Iterator[pa.RecordBatch]:
    """(key1, key2, key3, s1, s2, id[, label]) for each text and trie; (id, text[, label]) comes in.

    Short prefixes in `heavy` are lengthened at once, full ones divided into blocks that meet pairwise.
    """
    mix = permutations(max(TRIES * depth, 64))
    for batch in batches:
        texts = batch.column(1).to_pylist()
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        labels = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) if labelled else ids
        for lo in range(0, len(texts), 2000):
            rows, offsets, hashes = shingle_hashes(texts[lo : lo + 2000], run, least_words, least_distinct)
            if not len(rows):
                continue
            m = minima(hashes, offsets, mix)
            k1, k2, k3 = _prefixes(m, depth)
            k1, k2 = (np.hstack([k[:, :SHORT], k3[:, SHORT:]]) for k in (k1, k2))
            for level, (found, _) in enumerate(heavy[:2]):
                at = np.isin(k1, found)
                k1 = np.where(at, k2 if level == 0 else k3, k1)
                k2 = np.where(at, k3, k2)
            if sample:
                yield pa.RecordBatch.from_arrays([pa.array(k1.ravel().view(np.int64))], names=["key1"])
                continue
            two = _mix(m[:, :64]) & _U(3)
            shift = (np.arange(32, dtype=np.uint64) * _U(2))[None, :]
            s1, s2 = (two[:, :32] << shift).sum(1, dtype=np.uint64), (two[:, 32:] << shift).sum(1, dtype=np.uint64)
            k1, k2, k3 = k1.ravel(), k2.ravel(), k3.ravel()
            of, full = np.repeat(rows, TRIES), k1
            if len(heavy) == 3 and len(heavy[2][0]) and (np.isin(k3, heavy[2][0])).any():
                keys, blocks = heavy[2]
                place = np.minimum(np.searchsorted(keys, k3), len(keys) - 1)
                parts = np.where(keys[place] == k3, blocks[place], 1).astype(np.int64)
                own = (_mix(ids[lo + of].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
                at = np.repeat(np.arange(len(k1)), parts)
                other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
                cell = np.minimum(own[at], other) * parts[at] + np.maximum(own[at], other)
                k1, k2, k3 = np.where(parts[at] > 1, _mix(k1[at] + cell.astype(np.uint64) + _U(1)), k1[at]), k2[at], k3[at]
                of, full = of[at], full[at]
            back = np.zeros(of.max() + 1, np.int64)
            back[rows] = np.arange(len(rows))
            text_of = back[of]
            columns = [
                pa.array(k1.view(np.int64)),
                pa.array(np.where(full == k3, _U(0), k2).astype(np.uint32).view(np.int32)),  # nothing is left of a prefix that stands under its full key
                pa.array(np.where(full == k3, _U(0), k3).astype(np.uint32).view(np.int32)),
                pa.array(s1.view(np.int64)[text_of]),
                pa.array(s2.view(np.int64)[text_of]),
                pa.array(ids[lo + of]),
            ]
            names = ["key1", "key2", "key3", "s1", "s2", "id"]
            if labelled:
                columns, names = [*columns, pa.array(labels[lo + of])], [*names, "label"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


_EVEN = _U(0x5555555555555555)


def _disagreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return np.bitwise_count((x | (x >> _U(1))) & _EVEN)


def _runs(keys: tuple[np.ndarray, ...], bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the run of sorted rows that each row is compared with."""
    n = len(keys[0])
    starts, ends, settled = np.empty((3, n), np.int64), np.empty((3, n), np.int64), np.full(n, -1)
    new = np.zeros(n, bool)
    new[0] = True
    for d, k in enumerate(keys):
        new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        starts[d], ends[d] = np.repeat(first, size), np.repeat(first + size, size)
        small = np.repeat(size <= bucket, size)
        settled[(settled < 0) & (small | (d == 2))] = d
    # A run that is settled at a short prefix holds only rows settled there, since its size is theirs too.
    return starts[settled, np.arange(n)], ends[settled, np.arange(n)]


def trie_pairs(batches: Iterator[pa.RecordBatch], most_disagreeing: int, bucket: int = BUCKET, mode: str = "all") -> Iterator[pa.RecordBatch]:
    """Candidate pairs from rows sorted by (key1, key2, key3), each key1 within one partition.

    mode `all`: every two texts of a run; `star`: each with the least id of its run; `apart`: every two that
    have different labels.
    """
    width = 7 if mode == "apart" else 6

    def near(s1: np.ndarray, s2: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return _disagreeing(s1[left], s1[right]).astype(np.int64) + _disagreeing(s2[left], s2[right]) <= most_disagreeing

    def batch_of(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["id_a", "id_b"])

    def scan(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k1, k2, k3, s1, s2, ids = cols[:6]
        n = len(k1)
        if n < 2:
            return
        start, end = _runs((k1, k2, k3), bucket)
        s1, s2 = s1.view(np.uint64), s2.view(np.uint64)
        if mode == "star":
            order = np.lexsort((ids, start))  # runs stay where they are, their least id comes first
            s1, s2, ids = s1[order], s2[order], ids[order]
            right = np.flatnonzero(start < np.arange(n))
            left = start[right]
            hit = near(s1, s2, left, right)
            yield batch_of([(ids[left[hit]], ids[right[hit]])])
            return
        first = np.arange(n) + 1  # the first row of its run that a row must meet; the rows before meet it
        if mode == "apart":
            order = np.lexsort((cols[6], start))
            s1, s2, ids, label = s1[order], s2[order], ids[order], cols[6][order]
            change = np.append(np.flatnonzero((label[1:] != label[:-1]) | (start[1:] != start[:-1])) + 1, n)
            first = change[np.searchsorted(change, np.arange(n), side="right")]
        left, step, found, count = np.flatnonzero(end > first), 0, [], 0
        while len(left):
            right = first[left] + step
            hit = near(s1, s2, left, right)
            if hit.any():
                found.append((ids[left[hit]], ids[right[hit]]))
                count += int(hit.sum())
            if count >= 100_000:
                yield batch_of(found)
                found, count = [], 0
            step += 1
            left = left[first[left] + step < end[left]]
        if found:
            yield batch_of(found)

    held: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        held.append(cols)
        count += len(cols[0])
        if count < 200_000 or not len(cols[0]):
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))  # the last key1 may go on in the next batch
        yield from scan([c[:cut] for c in cols])
        held, count = [[c[cut:] for c in cols]], len(cols[0]) - cut
    if held:
        yield from scan([np.concatenate(c) for c in zip(*held)])


def _sets(batches: Iterator[pa.RecordBatch], run: int, least_words: int, least_distinct: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        rows, offsets, hashes = shingle_hashes(batch.column(1).to_pylist(), run, least_words, least_distinct)
        sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), pa.array(sets, pa.binary())], names=["id", "runs"])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, similar = [], []
        for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if min(len(a), len(b)) < threshold * max(len(a), len(b)):
                continue
            common = len(np.intersect1d(a, b, assume_unique=True))
            s = common / (len(a) + len(b) - common)
            if s >= threshold - 1e-12:
                keep.append(i)
                similar.append(s)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), pa.array(similar, pa.float64())],
            names=["id_a", "id_b", "similarity"],
        )


def _heavy_keys(sample: DataFrame, sign: Callable, rows: int) -> Heavy:
    """The prefixes of each level that more than `rows` texts share, by a sample of the distinct texts.

    At most (texts x TRIES) / rows keys of a level come back; they only decide where rows are placed.
    """
    sample = checkpoint(sample)
    found: Heavy = ()
    for _ in range(3):
        keys = sample.mapInArrow(partial(sign, heavy=found, sample=True), "key1 long")
        counts = keys.groupBy("key1").count().where(F.col("count") > max(8, rows // SAMPLE_ONE_IN)).toPandas()
        if counts.empty:
            break
        k = counts["key1"].to_numpy().view(np.uint64)
        order = np.argsort(k)
        found += ((k[order], np.ceil(counts["count"].to_numpy()[order] / max(8, rows // SAMPLE_ONE_IN)).astype(np.int64)),)
    forget(sample)
    return found


class Similar:
    """The similar pairs of a table of records (id, text), in the steps that pairs and groups share.

    texts: (id, text) of the distinct texts, each under the least id that has it; copies: (id, rep) of every
    other record with the very same text, if it is long enough to take part.
    """

    def __init__(self, records: DataFrame, id_col: str, text_col: str, *, run: int, threshold: float, least_words: int = 1, least_distinct: int = 1, heavy_rows: int = HEAVY, partitions: int | None = None):
        self.run, self.threshold, self.least_words, self.least_distinct, self.partitions = run, threshold, least_words, least_distinct, partitions
        rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.rows = rows = rows.where(F.col("id").isNotNull() & (F.length("text") >= 2 * max(least_words, least_distinct) - 1))
        h = F.xxhash64("text", F.reverse("text"))
        self.texts = rows.groupBy(h.alias("h"), F.length("text").alias("n")).agg(F.min(F.struct("id", "text")).alias("r")).select("r.id", "r.text")
        classes = rows.groupBy(h.alias("h"), F.length("text").alias("n")).agg(F.min("id").alias("rep"), F.max("id").alias("last"))
        copies = rows.select(h.alias("h"), F.length("text").alias("n"), "id").join(classes.where("last > rep"), ["h", "n"])
        self.copies = checkpoint(copies.where("id > rep").select("id", "rep").distinct())
        self.sign = partial(signatures, depth=full_depth(threshold), run=run, least_words=least_words, least_distinct=least_distinct)
        # Copies fall into the sample together, and count as one text there, too.
        sample = rows.where(F.pmod(h, F.lit(SAMPLE_ONE_IN)) == 0).withColumn("h", h).withColumn("n", F.length("text")).dropDuplicates(["h", "n"])
        self.heavy = _heavy_keys(sample.select("id", "text"), self.sign, heavy_rows)
        agree = threshold + (1 - threshold) / 4
        self.most = int(64 - (64 * agree - SKETCH_DEVIATIONS * (64 * agree * (1 - agree)) ** 0.5))

    def candidates(self, mode: str = "all", labels: DataFrame | None = None) -> DataFrame:
        """(id_a, id_b) of texts that meet in a trie; labels: (id, label) of the texts that have one other than their id."""
        texts = self.texts if labels is None else self.texts.join(labels, "id", "left").select("id", "text", F.coalesce("label", "id").alias("label"))
        columns = "key1 long, key2 int, key3 int, s1 long, s2 long, id long" + ("" if labels is None else ", label long")
        keyed = texts.mapInArrow(partial(self.sign, heavy=self.heavy, labelled=labels is not None), columns)
        keyed = keyed.repartition(*([self.partitions] if self.partitions else []), "key1").sortWithinPartitions("key1", "key2", "key3")
        met = keyed.mapInArrow(partial(trie_pairs, most_disagreeing=self.most, mode=mode), "id_a long, id_b long")
        return checkpoint(met.where("id_a < id_b").distinct())

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, runs) of the named texts that are long enough."""
        read = partial(_sets, run=self.run, least_words=self.least_words, least_distinct=self.least_distinct)
        return checkpoint(self.rows.join(ids, "id").mapInArrow(read, "id long, runs binary").dropDuplicates(["id"]))

    def verified(self, met: DataFrame, sets: DataFrame) -> DataFrame:
        """(id_a, id_b, similarity) of the candidates that reach the threshold."""
        both = (
            met.join(sets.select(F.col("id").alias("id_a"), F.col("runs").alias("x")), "id_a")
            .join(sets.select(F.col("id").alias("id_b"), F.col("runs").alias("y")), "id_b")
            .select("id_a", "id_b", "x", "y")
        )
        return both.mapInArrow(partial(_verify, threshold=self.threshold), "id_a long, id_b long, similarity double")

    def named(self, met: DataFrame) -> DataFrame:
        """(id) of the texts of candidates and of those with copies, whose length is judged with the rest."""
        return met.select(F.explode(F.array("id_a", "id_b")).alias("id")).unionByName(self.copies.select(F.col("rep").alias("id"))).distinct()


def similar_pairs(records: DataFrame, id_col: str, text_col: str, **rule) -> tuple[DataFrame, DataFrame]:
    """(pairs of different texts, copies): (id_a, id_b, similarity) by the least ids that have the texts, and (id, rep)."""
    found = Similar(records, id_col, text_col, **rule)
    met = found.candidates()
    sets = found.sets(found.named(met))
    return found.verified(met, sets), found.copies.join(sets.select(F.col("id").alias("rep")), "rep", "left_semi")


def similar_groups(records: DataFrame, id_col: str, text_col: str, **rule) -> DataFrame:
    """(id, group_id) of every record that is similar to another, directly or through others; group_id is the least id.

    No pairs of one group are listed: stars first, then only what stars left apart.
    """
    found = Similar(records, id_col, text_col, **rule)
    stars = found.candidates("star")
    sets = found.sets(found.named(stars))
    links = checkpoint(found.verified(stars, sets).select("id_a", "id_b"))
    labels = groups(links).select("id", F.col("group_id").alias("label"))
    apart = found.candidates("apart", labels)
    more = found.verified(apart, found.sets(found.named(apart))).select("id_a", "id_b")
    copies = found.copies.join(sets.select(F.col("id").alias("rep")), "rep", "left_semi").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    return groups(labels.where("id <> label").select(F.col("label").alias("id_a"), F.col("id").alias("id_b")).unionByName(more).unionByName(copies))


def expand(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """All pairs of ids: those of representatives, those of their copies, and the copies among themselves."""
    members = copies.select("rep", "id").unionByName(copies.select("rep", F.col("rep").alias("id")).distinct())
    a, b = members.select(F.col("rep").alias("ra"), F.col("id").alias("ia")), members.select(F.col("rep").alias("rb"), F.col("id").alias("ib"))
    wide = (
        pairs.join(a, F.col("id_a") == F.col("ra"), "left").join(b, F.col("id_b") == F.col("rb"), "left")
        .select(F.coalesce("ia", "id_a").alias("a"), F.coalesce("ib", "id_b").alias("b"))
    )
    same = a.join(b, F.col("ra") == F.col("rb")).where("ia < ib").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    return wide.unionByName(same).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def groups(pairs: DataFrame) -> DataFrame:
    """(id, group_id): connected records, by alternating large-star and small-star rounds on distributed edges until nothing changes."""
    state = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    edges = checkpoint(pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")).distinct())
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        forget(edges)
        edges, now = after, state(after)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct()
    )


CHUNK_RULE = {"run": 3, "threshold": 0.5, "least_words": 20}
NAME_RULE = {"run": 1, "threshold": 0.6, "least_words": 4, "least_distinct": 4}


def _chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("id", F.col("content").alias("text"))


def _file_names(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text): the file name without its folder and without what follows its last dot."""
    name = F.element_at(F.split("file_path", "/"), -1)
    stem = F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), stem.alias("text"))


def _found(texts: DataFrame, rule: dict, entity: str) -> DataFrame:
    pairs, copies = similar_pairs(texts, "id", "text", **rule)
    return expand(pairs, copies).select(F.lit(entity).alias("entity"), "id_a", "id_b")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of near-duplicate chunks and of documents with nearly the same file name."""
    chunks = _found(_chunk_texts(spark, folder), CHUNK_RULE, "chunk")
    return chunks.unionByName(_found(_file_names(spark, folder), NAME_RULE, "document"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """(entity, id, group_id): one row a record that has a near-duplicate, with the least id of its group."""
    chunks = similar_groups(_chunk_texts(spark, folder), "id", "text", **CHUNK_RULE).withColumn("entity", F.lit("chunk"))
    names = similar_groups(_file_names(spark, folder), "id", "text", **NAME_RULE).withColumn("entity", F.lit("document"))
    return chunks.unionByName(names).select("entity", "id", "group_id")


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
_WORDS_SQL = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_NAME_SQL = r"regexp_replace(regexp_extract(file_path, '[^/]*$'), '\.[^.]*$', '')"
# All pairs that share a run, counted; the tables of the comparison are small enough for that.
_PAIRS_SQL = f"""w AS (SELECT DISTINCT id, {_WORDS_SQL.format("content")} AS w FROM chunks WHERE content IS NOT NULL),
      runs AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS r FROM w WHERE len(w) >= 20),
      n AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
      c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM runs a JOIN runs b ON a.r = b.r AND a.id < b.id GROUP BY ALL),
      dw AS (SELECT doc_id AS id, list_distinct({_WORDS_SQL.format(_NAME_SQL)}) AS w FROM documents WHERE file_path IS NOT NULL),
      dr AS (SELECT id, unnest(w) AS r FROM dw WHERE len(w) >= 4), dn AS (SELECT id, count(*) AS n FROM dr GROUP BY id),
      dc AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM dr a JOIN dr b ON a.r = b.r AND a.id < b.id GROUP BY ALL),
      pairs AS (SELECT 'chunk' AS entity, a AS id_a, b AS id_b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 2 * k >= x.n + y.n - k
      UNION ALL SELECT 'document', a, b FROM dc JOIN dn x ON x.id = a JOIN dn y ON y.id = b WHERE 10 * k >= 6 * (x.n + y.n - k))"""
SQL = {
    "p5_found": f"WITH {_PAIRS_SQL} SELECT * FROM pairs",
    "p5_groups": f"""WITH RECURSIVE {_PAIRS_SQL}, ends AS (SELECT entity, id_a AS u, id_b AS v FROM pairs UNION SELECT entity, id_b, id_a FROM pairs),
      walk AS (SELECT DISTINCT entity, u AS id, u AS seen FROM ends UNION SELECT walk.entity, walk.id, ends.v FROM walk JOIN ends ON ends.entity = walk.entity AND ends.u = walk.seen)
      SELECT entity, id, min(seen) AS group_id FROM walk GROUP BY ALL""",
}
