import datetime as dt
import random

from lorewell.llm.scans import CONFUSIONS, anagram_hash, corrections, header_form, noisy_lines, page_numbers, paragraphs, word_counts


def test_anagram_hash_changes_by_the_confusion():
    for seen, printed in CONFUSIONS:
        word = "st" + printed + "r"
        assert anagram_hash("st" + seen + "r") + anagram_hash(printed) - anagram_hash(seen) == anagram_hash(word)


def test_page_number_forms():
    for line in ("12", "- 12 -", "— 12 —", "[12]", "(12/40)", "S. 12", "Page 12 of 40", "p. 12", "12 |", "12.", "· 12 ·", "xii", "- xii -", "l2", "Page xii of 40"):
        assert 12 in page_numbers(line), line
    for line in ("2,310", "72 85 91 104", "0.75", "Chapter 3", "of the", "", "12 boxes"):
        assert page_numbers(line) == [], line


def test_header_forms():
    assert header_form("EAST HEAD PLAYBOOK | 13") == header_form("14    East Head Playbook") == "east head playbook"


def test_corrections_are_ranked(spark):
    everything = spark.createDataFrame([("kiln", 90), ("klln", 2), ("bidden", 40), ("hidden", 900), ("modern", 100), ("rnodern", 1), ("rare", 1)], "word string, n long")
    scans = spark.createDataFrame([("klln", 2), ("rnodern", 1), ("rare", 1), ("bidden", 1)], "word string, n long")
    assert {(r.word, r.original) for r in corrections(everything, scans).collect()} == {("klln", "kiln"), ("rnodern", "modern")}


def test_counts_ignore_case_and_keep_hyphens(spark):
    got = {r.word: r.n for r in word_counts(spark.createDataFrame([("Rule-based rule-based x@y",), ("RULE",)], "t string")).collect()}
    assert got["rule-based"] == 2 and got["rule"] == 1


def _book(spark, folder, pages, extra=()):
    now = dt.datetime(2024, 1, 1)
    docs = [(1, "clean " * 30, "en", "books", 0, "kb/books/plain.md", "h", now, "docling"), (2, "", "en", "scan-archive", 0, "kb/scan-archive/x/long-river.pdf", "h", now, "docling_ocr"), (3, None, None, None, None, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, file_path string, file_hash string, indexed_at timestamp, extraction_method string").write.parquet(f"{folder}/documents.parquet")
    rows = [(i + 1, 2, text, i + 1, i, now) for i, text in enumerate(pages)] + list(extra)
    spark.createDataFrame(rows, "id long, document_id long, content string, page int, chunk_index int, created_at timestamp").write.parquet(f"{folder}/chunks.parquet")


def test_a_scanned_book(spark, tmp_path):
    rng = random.Random(5)
    words = "river mountain garden kettle window station market bridge lantern harbour".split()
    body = lambda: " ".join(rng.choice(words) for _ in range(8)) + "."
    pages = []
    for i in range(4):
        head = f"LONG RIVER | {11 + i}\n" + (f"dow stood open {words[i]}.\n" if i else "")
        middle = f"{body()}\n{body()}\nthe kettle stood near the gar-\nden wall and the {'rnarket' if i == 2 else 'market'} was\nsold a well-\nknown lantern {words[i]}.\n\n"
        pages.append(head + middle + f"A new {words[-i - 1]} part, and then the {'win-' if i < 3 else 'end.'}\nSecond impression")
    plain = [(100 + i, 1, "The market by the garden window was a well-known market. " + " ".join(words * 3), None, 0, None) for i in range(20)]
    _book(spark, str(tmp_path), pages, [*plain, (100, 1, plain[0][2], None, 0, None), (300, None, "x-\ny", 1, 0, None), (301, 2, None, 9, 9, None), (302, 2, "", 8, 8, None)])
    got = {(r.id, r.line_no, r.kind) for r in noisy_lines(spark, str(tmp_path)).collect()}
    assert {(i, 1, "header") for i in (1, 2, 3, 4)} <= got
    assert {(i + 1, len(p.split("\n")), "header") for i, p in enumerate(pages)} <= got
    broken = lambda i: [n for n, line in enumerate(pages[i].split("\n"), 1) if line.endswith(("gar-", "win-"))]
    assert {(i + 1, n) for i in range(4) for n in broken(i)} == {(c, n) for c, n, k in got if k == "hyphen"}
    assert {(c, k) for c, _, k in got if k == "ocr"} == {(3, "ocr")}
    texts = [r.text for r in paragraphs(spark, str(tmp_path)).orderBy("paragraph").collect() if r.document_id == 2]
    whole = "\n".join(texts)
    assert "garden wall and the market was sold a well-known lantern" in whole and "then the window stood open" in whole
    assert "LONG RIVER" not in whole and "impression" not in whole and "rnarket" not in whole


def test_page_numbers_follow_the_page(spark, tmp_path):
    pages = [f"Some text line that is quite long here\nand another line of the same text\n{n}\nmore text goes on in this very place\nlast line of the page goes here now\n- {40 + i} -" for i, n in enumerate(("1450", "2,310", "77", "9"))]
    _book(spark, str(tmp_path), pages)
    assert {(r.id, r.line_no) for r in noisy_lines(spark, str(tmp_path)).where("kind = 'page_number'").collect()} == {(i, 6) for i in (1, 2, 3, 4)}


def test_a_long_book_in_chapters_and_parts(spark, tmp_path):
    body = lambda i: "\n".join(f"the {w} number {chr(97 + i % 26)}{chr(97 + i // 26)} was seen by all of them and went on" for w in ("river", "kettle", "garden", "lantern"))
    # Ten chapters of 12 pages with their title as footer; the bare numbers of each part of 20 pages begin anew.
    titles = "saltmarsh orchard viaduct quarry granary boathouse signal weir foundry almshouse".split()
    pages = [f"{1 + i % 20}\n{body(i)}\nof the old {titles[i // 12]} and its keepers in the valley" for i in range(120)]
    _book(spark, str(tmp_path), pages)
    got = {(r.id, r.line_no, r.kind) for r in noisy_lines(spark, str(tmp_path)).collect()}
    assert {(i + 1, 1, "page_number") for i in range(120)} <= got
    assert {(i + 1, 6, "header") for i in range(120)} <= got
    assert not [x for x in got if x[1] in (2, 3, 4, 5) and x[2] in ("header", "page_number")]


def test_a_misread_word_on_a_page_delivered_twice(spark, tmp_path):
    page = "an old stone stood here\nand the rnarket was closed\nfor the rest of the week"
    plain = [(100 + i, 1, "The market was a well-known market.", None, 0, None) for i in range(20)]
    _book(spark, str(tmp_path), [page], [(1, 2, page, 1, 0, None), *plain])
    assert [(r.id, r.line_no) for r in noisy_lines(spark, str(tmp_path)).where("kind = 'ocr'").collect()] == [(1, 2)]


def test_empty_tables(spark, tmp_path):
    _book(spark, str(tmp_path), [])
    assert noisy_lines(spark, str(tmp_path)).count() == 0 and paragraphs(spark, str(tmp_path)).count() == 0


def test_a_broken_word_is_misread_where_its_character_is():
    import pyarrow as pa

    from lorewell.llm.scans import _ocr_lines

    text = "an old ke-\nttlc was here\nand a rn-\narket too"
    broken = [{"line_no": 1, "joined": "kettlc"}, {"line_no": 3, "joined": "rnarket"}]
    fixes = [{"word": "kettlc", "original": "kettle"}, {"word": "rnarket", "original": "market"}]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([None], pa.list_(pa.int32())), pa.array([broken]), pa.array([fixes])], names=["id", "content", "skip", "broken", "fixes"])
    (out,) = _ocr_lines(iter([batch]))
    assert out.column("line_no").to_pylist() == [2, 3]


def test_joined_words_are_corrected_over_lines_and_pages(spark, tmp_path):
    pages = ["an old stone mo-\ndcrn kiln stood here and the rnar-", "ket was closed"]
    plain = [(100 + i, 1, "The market had a modern kiln, a modern market.", None, 0, None) for i in range(20)]
    _book(spark, str(tmp_path), pages, plain)
    assert [r.text for r in paragraphs(spark, str(tmp_path)).collect()] == ["an old stone modern kiln stood here and the market was closed"]
    got = {(r.id, r.line_no, r.kind) for r in noisy_lines(spark, str(tmp_path)).collect()}
    assert {(1, 1, "hyphen"), (1, 2, "hyphen"), (1, 2, "ocr")} <= got


def test_long_and_misread_headers(spark, tmp_path):
    long = "proceedings of the society for the study of tidal mills, weirs and saltmarsh drainage in the northern counties"
    body = lambda i: "\n".join(f"the {w} of {'abcdef'[i] * 9} {'uvwxyz'[i] * 9} was seen by all of them and went on" for w in ("river", "kettle", "garden"))
    pages = [(long.replace("society", "socicty") if i == 3 else long) + "\n" + body(i) for i in range(6)]
    _book(spark, str(tmp_path), pages)
    got = {(r.id, r.line_no) for r in noisy_lines(spark, str(tmp_path)).where("kind = 'header'").collect()}
    assert got == {(i + 1, 1) for i in range(6)}


def test_a_paragraph_without_end_is_divided_by_blocks(spark, tmp_path):
    pages = [f"line {chr(97 + i)} goes on and" for i in range(6)]
    _book(spark, str(tmp_path), pages)
    whole = [(r.page, r.text) for r in paragraphs(spark, str(tmp_path)).orderBy("page").collect()]
    assert len(whole) == 1
    parts = [(r.page, r.text) for r in paragraphs(spark, str(tmp_path), block=3).orderBy("page").collect()]
    assert [p for p, _ in parts] == [1, 3, 6] and " ".join(t for _, t in parts) == whole[0][1]
