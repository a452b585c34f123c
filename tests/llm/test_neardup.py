import random

import pytest

from lorewell.llm import neardup


def _texts(seed=1, n=250):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(25, 80))]
        out.append(words)
        for _ in range(rng.choice((0, 0, 1, 2))):
            other = list(words)
            for _ in range(rng.randrange(0, 6)):
                i = rng.randrange(len(other))
                rng.choice((lambda: other.pop(i), lambda: other.insert(i, rng.choice(vocabulary)), lambda: other.__setitem__(i, "x")))()
            out.append(other)
    return [" ".join(w) for w in out]


def _brute(texts, run, threshold, least):
    sets = {}
    for i, t in texts:
        w = neardup.WORD.findall((t or "").lower())
        if len(w) >= least:
            sets[i] = {tuple(w[j : j + run]) for j in range(len(w) - run + 1)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def _found(spark, rows, **rule):
    df = spark.createDataFrame(rows, "id long, text string, rep long")
    pairs, copies = neardup.similar_pairs(df, "id", "text", **rule)
    return {(r.id_a, r.id_b) for r in neardup.expand(pairs, copies).collect()}


def test_pairs_match_brute_force(spark):
    rows = [(i, t, 0) for i, t in enumerate(_texts())]
    got, true = _found(spark, rows, **neardup.CHUNK_RULE), _brute([r[:2] for r in rows], 3, 0.5, 20)
    assert len(true) > 100 and got <= true and len(true - got) <= 0.01 * len(true)


def test_nulls_short_texts_copies_and_repeats(spark):
    long = " ".join(f"a{i}" for i in range(30))
    rows = [(1, long, 0), (1, long, 0), (2, long.upper() + "!", 0), (3, long, 0), (4, None, 0), (5, "", 0), (6, "too short", 0), (7, "too short", 0), (None, long, 0), (8, " \n ", 0)]
    assert _found(spark, rows, **neardup.CHUNK_RULE) == {(1, 2), (1, 3), (2, 3)}
    assert _found(spark, [], **neardup.CHUNK_RULE) == set()


def test_large_families_are_compared_whole(spark, monkeypatch):
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[:30] + [f"own{i}"] + base[30:]), 0) for i in range(90)]
    assert len(_found(spark, rows, **neardup.CHUNK_RULE)) == 90 * 89 // 2


def _family(n, common=102, own=50):
    """Texts with common - 2 runs in all of them and `own` of their own; at 102 and 50 every pair has a similarity of exactly 0.5."""
    return [" ".join(f"c{j}" for j in range(common)) + " " + " ".join(f"o{i}x{j}" for j in range(own)) for i in range(n)]


def _met(texts, seed=7):
    """The share of all pairs that the tries meet and the sketch keeps, without Spark."""
    import numpy as np
    import pyarrow as pa

    ids = np.random.default_rng(seed).permutation(len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["id", "text"])
    keyed = pa.Table.from_batches(neardup.signatures(iter([batch]), depth=neardup.full_depth(0.5), run=3, least_words=20, least_distinct=1)).sort_by([(k, "ascending") for k in ("key1", "key2", "key3")])
    pairs = {(a, b) for out in neardup.trie_pairs(iter(keyed.combine_chunks().to_batches()), 35) for a, b in zip(*(c.to_pylist() for c in out.columns)) if a < b}
    return len(pairs) / (len(texts) * (len(texts) - 1) / 2)


def test_full_depth_follows_from_the_target():
    assert neardup.full_depth(0.5) == 3 and neardup.full_depth(0.6) == 4
    for s in (0.5, 0.6, 0.8):
        d = neardup.full_depth(s)
        assert 1 - (1 - s**d) ** neardup.TRIES >= neardup.TARGET > 1 - (1 - s ** (d + 1)) ** neardup.TRIES


@pytest.mark.parametrize("n", [50, 200, 1500])
def test_recall_at_the_threshold_does_not_depend_on_the_size_of_a_family(n):
    assert _met(_family(n)) >= 0.99


def test_recall_where_very_many_texts_share_minima(spark):
    # 10,000 texts with boilerplate in common (similarity 0.16), and pairs at 0.5 among them.
    boiler = [" ".join(f"p{j}" for j in range(30)) + " " + " ".join(f"b{i}x{j}" for j in range(76)) for i in range(10_000)]
    pairs = [(f"{t}", f"{t}") for t in boiler[:150]]
    rows = [(i, t, 0) for i, t in enumerate(boiler)]
    for i in range(150):
        kept = boiler[i].split(" ")[:72]  # 70 of its runs stay, and 35 are new
        rows.append((20_000 + i, " ".join(kept + [f"z{i}x{j}" for j in range(36)]), 0))
    got = _found(spark, rows, heavy_rows=2000, **neardup.CHUNK_RULE)
    true = {(i, 20_000 + i) for i in range(150)}
    sets = {i: neardup.shingle_hashes([t], 3, 20, 1)[2] for i, t, _ in rows if i < 150 or i >= 20_000}
    like = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
    assert all(0.49 < like(a, b) < 0.52 for a, b in true)
    true = {(a, b) for a, b in true if like(a, b) >= 0.5}
    assert len(true - got) <= 0.01 * len(true) and len(pairs) == 150


def test_groups_are_those_of_all_pairs_and_linear_in_rows(spark):
    rows = [(i, t, 0) for i, t in enumerate(_texts(5, 120))] + [(10_000 + i, t, 0) for i, t in enumerate(_family(300, 120, 20))]
    df = spark.createDataFrame(rows, "id long, text string, rep long")
    pairs, copies = neardup.similar_pairs(df, "id", "text", **neardup.CHUNK_RULE)
    expected = {(r.id, r.group_id) for r in neardup.groups(neardup.expand(pairs, copies)).collect()}
    assert {(r.id, r.group_id) for r in neardup.similar_groups(df, "id", "text", **neardup.CHUNK_RULE).collect()} == expected
    found = neardup.Similar(df.where("id >= 10000"), "id", "text", **neardup.CHUNK_RULE)
    stars = found.candidates("star")
    assert stars.count() <= 300 * neardup.TRIES
    labels = spark.createDataFrame([(10_000 + i, 10_000) for i in range(300)], "id long, label long")
    assert found.candidates("apart", labels).count() == 0
    assert neardup.similar_groups(df.limit(0), "id", "text", **neardup.CHUNK_RULE).count() == 0


def test_a_full_prefix_is_divided_into_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SAMPLE_ONE_IN", 1)
    rows = [(i, t, 0) for i, t in enumerate(_family(60, 140, 10))]
    assert len(_found(spark, rows, heavy_rows=9, **neardup.CHUNK_RULE)) == 60 * 59 // 2
    found = neardup.Similar(spark.createDataFrame(rows, "id long, text string, rep long"), "id", "text", heavy_rows=9, **neardup.CHUNK_RULE)
    assert len(found.heavy) == 3 and (found.heavy[2][1] > 1).any()


def test_heavy_prefixes_only_change_the_placement(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SAMPLE_ONE_IN", 1)
    rows = [(i, "a b c d e f g h " * 3 + t, 0) for i, t in enumerate(_texts(3, 60))]
    assert _found(spark, rows, heavy_rows=5, **neardup.CHUNK_RULE) == _found(spark, rows, **neardup.CHUNK_RULE)


def test_copies_of_one_text_make_no_heavy_prefix(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SAMPLE_ONE_IN", 1)
    found, heavy_keys = [], neardup._heavy_keys
    monkeypatch.setattr(neardup, "_heavy_keys", lambda *a: found.append(heavy_keys(*a)) or found[-1])
    text, near = " ".join(f"k{i}" for i in range(60)), " ".join(f"k{i}" for i in range(50))
    rows = [(i, text, 0) for i in range(40)] + [(40, near, 0)]
    assert len(_found(spark, rows, heavy_rows=5, **neardup.CHUNK_RULE)) == 41 * 40 // 2
    assert found == [()]


def test_file_names(spark):
    rows = [(1, "notes duskfell snowhunter cedarbell", 0), (2, "duskfell snowhunter cedarbell notes v2", 0), (3, "duskfell snowhunter other words here", 0), (4, "a b c", 0), (5, "a b c", 0), (6, "one one one two three", 0)]
    assert _found(spark, rows, **neardup.NAME_RULE) == {(1, 2)}


def test_groups_are_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 103), (101, 103), (102, 103)]
    got = {r.id: r.group_id for r in neardup.groups(spark.createDataFrame(edges, "id_a long, id_b long")).collect()}
    assert {i: got[i] for i in range(60)} == {i: i // 20 * 20 for i in range(60)} and {got[i] for i in (100, 101, 102, 103)} == {100}
    assert neardup.groups(spark.createDataFrame([], "id_a long, id_b long")).count() == 0
