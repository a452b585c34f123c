from lorewell.llm.split import cut_points, gap_depths, p1_found, p1_pieces, split_oversized


def _valid(text, limit, overlap):
    pieces = cut_points(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in pieces)
    assert all(c < b and b - c <= overlap and c > a for (a, b), (c, _) in zip(pieces, pieces[1:]))
    return pieces


def test_pieces_cover_the_text_under_the_limit():
    for text in ("a" * 5000, "word " * 1000, "x. " * 3000, "é" * 4000, "\n" * 10 + "a b\n" * 2000, "索引を更新する。" * 600, "👩‍👩‍👧" * 900, "a\n" + "b" * 9000):
        for limit, overlap in ((2048, 200), (300, 40)):
            _valid(text, limit, overlap)


def test_a_topic_boundary_is_a_valley_and_is_cut_at():
    a = "The cat chased another cat around the kitty garden. " * 25
    b = "Markets price option contracts with volatility models. " * 25
    text = (a + b).strip()
    sizes = [text[x:y] for x, y in _valid(text, 2048, 100)]
    assert sizes[0].rstrip().endswith("garden.") and len(sizes[0]) <= len(a)
    depths = gap_depths(["cat dog bird"] * 6 + ["sea sky sun"] * 6)
    assert depths.index(max(depths)) == 5


def test_sentence_ends_are_preferred_to_words():
    text = "Some words make up this plain sentence of medium length. " * 80
    assert all(text[:b].rstrip().endswith(".") for _, b in _valid(text.strip(), 2048, 200))


def test_limits_count_code_points_without_outer_blanks(spark):
    rows = [(1, " \t\r\n" + "x" * 2048 + "\n", 1), (2, "x" * 2049, 1), (2, "x" * 2049, 1), (3, None, None), (4, "", 1), (5, " " * 5000, 1), (6, "😀" * 2049, 1), (None, "y" * 3000, 1)]
    got = split_oversized(spark.createDataFrame(rows, "id long, content string, start int")).collect()
    assert sorted((r.id, r.piece) for r in got) == [(2, 0), (2, 1), (6, 0), (6, 1)]
    assert all(rows[i][1][r.start : r.end].strip() == r.content for r in got for i in [1 if r.id == 2 else 6])


def test_consecutive_indexes(spark, tmp_path):
    long = "One plain sentence. " * 200
    rows = [(1, 9, "a", 1, 0), (2, 9, long, 2, 1), (3, 9, "b", 3, 1), (4, 9, "c", 3, None), (5, 9, long, 4, None), (6, None, long, None, 7), (2, 9, long, 2, 1)]
    spark.createDataFrame(rows, "id long, document_id long, content string, page int, chunk_index int").write.parquet(str(tmp_path / "chunks.parquet"))
    got = sorted(p1_pieces(spark, str(tmp_path)).collect(), key=lambda r: (r.id, r.piece))
    n = len([r for r in got if r.id == 2])
    assert n > 1 and [r.chunk_index for r in got if r.id == 2] == list(range(1, n + 1)) and {r.page for r in got if r.id == 2} == {2}
    assert [r.chunk_index for r in got if r.id == 5][0] == n + 3
    assert [r.chunk_index for r in got if r.id == 6][0] == 7
    assert sorted(r.id for r in p1_found(spark, str(tmp_path)).collect()) == [2, 5, 6]


def test_empty_table(spark):
    assert split_oversized(spark.createDataFrame([], "id long, content string")).count() == 0
