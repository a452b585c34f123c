"""Splitting oversized chunks at natural boundaries (problem 1) by lexical cohesion.

The text is cut into units (sentences, lines, paragraphs). At each gap between units the words of the
BLOCK units before and after are compared (cosine of counts); a gap's depth is how far its similarity lies
below the peaks on either side. Going left to right, a piece ends at the deepest valley among the gaps
that leave it between half the limit and the limit long; with no gap there, at the last gap, blank or, at
worst, character before the limit. The next piece begins up to `overlap` characters before the cut, at the
beginning of a word.

Lengths are in Unicode code points of the content without leading and trailing spaces, tabs, CR and LF.

Defined results: null, blank and short contents have no pieces; rows delivered twice count once; a text
without any boundary is cut hard, but not inside a combined character; pieces of a chunk without document
keep its own chunk_index as the first; a missing chunk_index sorts last, ties go by id; extra columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators.ordered import places
from lorewell.session import checkpoint, table

LIMIT, OVERLAP, BLOCK = 2048, 200, 6
_WORD = re.compile(r"[^\W_]{3,}")
_GAP = re.compile(r"(?:\r?\n[ \t]*){2,}|(?<=[.!?…。！？])[\"'”»)\]]*(?:\s+|(?=[^\x00-\x7f]))|\r?\n")
BLANK = " \t\r\n"


def gap_depths(units: list[str], block: int = BLOCK) -> list[float]:
    """The depth of the similarity valley at each gap; gap i lies before unit i + 1."""
    counts = [Counter(_WORD.findall(u.lower())) for u in units]
    similarity = []
    for i in range(1, len(units)):
        left, right = Counter(), Counter()
        for c in counts[max(0, i - block) : i]:
            left.update(c)
        for c in counts[i : i + block]:
            right.update(c)
        norm = (sum(v * v for v in left.values()) * sum(v * v for v in right.values())) ** 0.5
        similarity.append(sum(v * right[w] for w, v in left.items()) / norm if norm else 0.0)
    up, best = [], 0.0
    for i, s in enumerate(similarity):  # the peak to the left, reached by climbing only
        best = max(best, s) if i and similarity[i - 1] >= s else s
        up.append(best)
    down, best = [0.0] * len(similarity), 0.0
    for i in range(len(similarity) - 1, -1, -1):
        best = max(best, similarity[i]) if i + 1 < len(similarity) and similarity[i + 1] >= similarity[i] else similarity[i]
        down[i] = best
    return [up[i] + down[i] - 2 * s for i, s in enumerate(similarity)]


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text that is longer than the limit."""
    gaps = [(m.start(), m.end()) for m in _GAP.finditer(text) if 0 < m.end() < len(text)]
    bounds = [0, *(g[1] for g in gaps), len(text)]
    depths = gap_depths([text[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
    # A blank line is a boundary of its own rank: between equal valleys it wins.
    valleys = [(g[1], d + (0.25 if text.count("\n", *g) > 1 else 0.0)) for g, d in zip(gaps, depths)]
    pieces, start, first = [], 0, 0
    while len(text) - start > limit:
        low, high = start + max(limit // 2, overlap + 1), start + limit
        while first < len(valleys) and valleys[first][0] <= start + overlap:
            first += 1
        last, chosen, fallback = first, None, None
        while last < len(valleys) and valleys[last][0] <= high:
            at, depth = valleys[last]
            if at >= low and (chosen is None or depth >= chosen[1]):
                chosen = (at, depth)
            fallback = at
            last += 1
        cut = chosen[0] if chosen else fallback
        if cut is None:
            blank = max((text.rfind(b, start + overlap + 1, high) for b in BLANK), default=-1)
            cut = blank + 1 if blank > 0 else high
            while cut == high and cut - 1 > start + overlap and (unicodedata.combining(text[cut]) or text[cut] in "‍️"):
                cut -= 1
        pieces.append((start, cut))
        start = _word_start(text, cut - overlap, cut) if overlap else cut
    pieces.append((start, len(text)))
    return pieces


def _word_start(text: str, at: int, cut: int) -> int:
    """The first beginning of a word from `at` on; `at` itself if there is none before the cut."""
    for i in range(at, cut):
        if not text[i].isspace() and (i == 0 or text[i - 1].isspace()):
            return i
    return at


PIECES = "id long, piece int, start int, end int, content string"


def _split(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            body = text.strip(BLANK)
            shift = len(text) - len(text.lstrip(BLANK))
            n = 0
            for a, b in cut_points(body, limit, overlap):
                content = body[a:b].strip(BLANK)
                if content:
                    out.append((chunk, n, shift + a, shift + b, content))
                    n += 1
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["id", "piece", "start", "end", "content"]
        )


def is_oversized(content: str | Column = "content", limit: int = LIMIT) -> Column:
    return F.length(F.btrim(F.col(content) if isinstance(content, str) else content, F.lit(BLANK))) > limit


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, start, end, content) of each oversized chunk; the filter runs in the scan's stage, only oversized texts reach Python."""
    large = chunks.select(F.col("id").cast("long").alias("id"), "content").where(F.col("id").isNotNull() & is_oversized(limit=limit))
    return large.dropDuplicates(["id"]).mapInArrow(partial(_split, limit=limit, overlap=overlap), PIECES)


def renumbered(chunks: DataFrame, pieces_per_chunk: DataFrame) -> DataFrame:
    """(id, first_index): where a chunk's first piece comes in its document, each chunk counting its pieces.

    A place in the nested sums of `places`, so a document of any size is spread over many tasks.
    """
    rows = chunks.select("id", "document_id", "chunk_index").where("id is not null and document_id is not null").dropDuplicates(["id"])
    rows = rows.join(pieces_per_chunk, "id", "left").withColumn("n", F.coalesce("n", F.lit(1)).cast("long"))
    placed = places(rows, ["document_id"], "chunk_index", "id", "n", "first_index").select("id", "first_index")
    alone = chunks.where("document_id is null").select("id", F.coalesce("chunk_index", F.lit(0)).cast("long").alias("first_index")).dropDuplicates(["id"])
    return placed.unionByName(alone)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that the splitter cuts."""
    return split_oversized(table(spark, folder, "chunks")).where("piece = 1").select("id").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(id, document_id, page, piece, chunk_index, start, end, content): the pieces, with consecutive indexes in their document."""
    chunks = table(spark, folder, "chunks")
    pieces = checkpoint(split_oversized(chunks))
    counts = pieces.groupBy("id").agg(F.count("*").alias("n"))
    touched = chunks.join(counts, "id", "left_semi").select("document_id").distinct()
    own = chunks.join(touched, "document_id", "left_semi").unionByName(chunks.where("document_id is null"))
    first = renumbered(own, counts)
    facts = chunks.select("id", "document_id", "page").dropDuplicates(["id"])
    return pieces.join(first, "id").join(facts, "id").select(
        "id", "document_id", "page", "piece", (F.col("first_index") + F.col("piece")).alias("chunk_index"), "start", "end", "content"
    )


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
SQL = {"p1_found": "SELECT DISTINCT id FROM chunks WHERE length(trim(content, ' ' || chr(9) || chr(13) || chr(10))) > 2048"}
