"""Splitting texts into chunks: fixed windows, sentences, paragraphs, source code; and joining whole-file rows.

Each chunker is a function from a text to (content, start, kind) pieces, applied in Arrow batches inside the
scan's stage: no shuffle, whole texts. Sizes count characters, four to a token; source code is cut by
characters too, never by bytes, so no letter is broken.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import model as m
from lorewell.functions import text as t

Piece = tuple[str, int, str]
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def fixed_pieces(text: str, max_tokens: int = 512, overlap: int = 50) -> list[Piece]:
    """Windows that end, within their last 100 characters, at a blank line, a sentence or a space; with overlap."""
    body, size, back = text.strip(), 4 * max_tokens, 4 * overlap
    out: list[Piece] = []
    start, last = 0, -1
    while start < len(body):
        end = start + size
        if end < len(body):
            end = _window_end(body, max(start, end - 100), end)
        content = body[start:end].strip()
        if content:
            out.append((content, start, "text"))
            last = start
        if end >= len(body):
            break
        following = end - back
        start = following if following > last else end
    return out


def _window_end(body: str, low: int, high: int) -> int:
    for mark, width in (("\n\n", 2), (". ", 2), ("! ", 2), ("? ", 2), (" ", 1)):
        at = body.rfind(mark, low, high)
        if at >= 0:
            return at + width
    return high


_SENTENCES = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def semantic_pieces(text: str, max_tokens: int = 512) -> list[Piece]:
    """Sentences packed up to the limit; a sentence that is longer is cut at its last space before it."""
    limit, room = 4 * max_tokens, -1  # what the last piece still takes; below 0 it takes nothing
    made: list[tuple[list[str], str]] = []
    sentences = (s.strip() for part in _SENTENCES.split(text) for s in part.split("\n\n"))
    for sentence in filter(None, sentences):
        if len(sentence) > limit:
            made += [([part], "split") for part in _at_spaces(sentence, limit)]
            room = -1
            continue
        if len(sentence) < room:
            made[-1][0].append(sentence)
        else:
            made.append(([sentence], "text"))
            room = limit
        room -= len(sentence) + 1
    return [(" ".join(parts), i, kind) for i, (parts, kind) in enumerate(made)]


def _at_spaces(sentence: str, limit: int) -> Iterator[str]:
    start = 0
    while len(sentence) - start > limit:
        space = sentence.rfind(" ", start + 1, start + limit)
        end = space if space > 0 else start + limit
        yield sentence[start:end].strip()
        start = end + len(sentence[end:]) - len(sentence[end:].lstrip())
    if start < len(sentence):
        yield sentence[start:]


def paragraph_pieces(text: str, max_tokens: int = 512) -> list[Piece]:
    """Paragraphs packed up to the limit, separators not counted; a paragraph is never cut."""
    limit, out, held, size = 4 * max_tokens, [], [], 0
    for paragraph in (p.strip() for p in text.split("\n\n")):
        if not paragraph:
            continue
        if held and size + len(paragraph) > limit:
            out.append(("\n\n".join(held), len(out), "text"))
            held, size = [], 0
        held.append(paragraph)
        size += len(paragraph)
    if held:
        out.append(("\n\n".join(held), len(out), "text"))
    return out


_OPENERS = re.compile(
    r"^(?:export\s+|default\s+|public\s+|private\s+|protected\s+|internal\s+|static\s+|abstract\s+|final\s+|async\s+)*"
    r"(?:def|class|interface|enum|struct|record|trait|func|function|fn|type|const|let|var|impl|namespace|module)\b|^(?:public|private|protected|internal)\b",
)


def _python_blocks(code: str) -> list[tuple[int, int, str]] | None:
    """(first line, line after the last, kind) of the top-level statements, decorators included."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    blocks = []
    for node in tree.body:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])
        blocks.append((first - 1, node.end_lineno, type(node).__name__))
    return blocks


def code_pieces(code: str, max_chars: int = 2048, python: bool = True) -> list[Piece]:
    """Definitions, neighbours merged while they fit; a larger one is cut at its blank lines or inner openings."""
    lines = code.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    blocks = _python_blocks(code) if python else None
    if blocks is None:
        heads = [i for i, line in enumerate(lines) if _OPENERS.match(line)] or [0]
        heads = heads if heads[0] == 0 else [0, *heads]
        blocks = [(a, b, "block") for a, b in zip(heads, [*heads[1:], len(lines)])]
    units: list[tuple[int, int, str]] = []
    at = 0
    for a, b, kind in blocks:
        a = min(a, at) if a > at else a  # comments before a definition belong to it
        if starts[min(b, len(lines))] - starts[a] <= max_chars:
            units.append((a, b, kind))
        else:
            units += _divided(lines, starts, a, b, kind, max_chars)
        at = b
    if at < len(lines):
        units.append((at, len(lines), "block"))
    out: list[Piece] = []
    held: list[tuple[int, int, str]] = []

    def flush() -> None:
        if held:
            content = code[starts[held[0][0]] : starts[held[-1][1]]].strip("\n")
            if content.strip():
                out.append((content, starts[held[0][0]], "+".join(dict.fromkeys(k for _, _, k in held))))
            held.clear()

    for unit in units:
        if held and starts[unit[1]] - starts[held[0][0]] > max_chars:
            flush()
        held.append(unit)
    flush()
    return out


def _divided(lines: list[str], starts: list[int], a: int, b: int, kind: str, limit: int) -> list[tuple[int, int, str]]:
    """Line ranges of a too large block, each under the limit where its lines allow it."""
    out, first, natural = [], a, None
    for i in range(a, b):
        if i > first and (not lines[i].strip() or _OPENERS.match(lines[i].lstrip())):
            natural = i
        if starts[i + 1] - starts[first] > limit and i > first:
            cut = natural if natural and natural > first else i
            out.append((first, cut, kind))
            first, natural = cut, None
    out.append((first, b, kind))
    return out


def go_pieces(code: str, max_chars: int = 2048) -> list[Piece]:
    """Declarations, sized by what is not white space; none is cut off: a piece over four times the limit is divided at its lines."""
    dense = lambda s: len(re.sub(r"\s", "", s))
    out, held = [], ""
    for part in re.split(r"(?m)(?=^(?:func|type|var|const|import|package)\b)", code):
        for unit in [part] if dense(part) <= max_chars else re.split(r"(?<=\n)(?=\n)|(?<=\n})\n", part):
            if held and dense(held) + dense(unit) > max_chars:
                out.append(held)
                held = ""
            held += unit
    out.append(held)
    parts = [p for x in out for p in ([x] if len(x.strip("\n")) <= 4 * max_chars else _at_lines(x, max_chars, dense))]
    return [(s.strip("\n"), i, "go") for i, s in enumerate(x for x in parts if x.strip())]


def _at_lines(code: str, limit: int, dense: Callable[[str], int]) -> Iterator[str]:
    """Whole lines packed up to the limit; a single line over four times the limit goes on in further pieces."""
    held, size = "", 0
    for line in code.splitlines(keepends=True):
        for part in (line[i : i + 4 * limit] for i in range(0, len(line), 4 * limit)):
            n = dense(part)
            if held and (size + n > limit or len(held) + len(part) > 4 * limit):
                yield held
                held, size = "", 0
            held, size = held + part, size + n
    yield held


CHUNKERS: dict[str, Callable[[str], list[Piece]]] = {"fixed": fixed_pieces, "semantic": semantic_pieces, "hybrid": paragraph_pieces}


def chunker(name: str) -> Callable[[str], list[Piece]]:
    """A registered chunker; an unknown name means hybrid."""
    return CHUNKERS.get(name, paragraph_pieces)


def _apply(batches: Iterator[pa.RecordBatch], pieces: Callable[[str], list[Piece]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, index, content, start, kind = [], [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for i, (c, s, k) in enumerate(pieces(text)):
                ids.append(key)
                index.append(i)
                content.append(c)
                start.append(s)
                kind.append(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(index, pa.int32()), pa.array(content, pa.string()), pa.array(start, pa.int32()), pa.array(kind, pa.string())],
            names=["doc_id", "chunk_index", "content", "start_char", "kind"],
        )


def chunked(texts: DataFrame, pieces: Callable[[str], list[Piece]], **options) -> DataFrame:
    """(doc_id, chunk_index, content, start_char, kind) of (doc_id, text)."""
    rows = texts.select("doc_id", "text").where("text is not null")
    return rows.mapInArrow(partial(_apply, pieces=partial(pieces, **options)), "doc_id long, chunk_index int, content string, start_char int, kind string")


@query("ch1_fixed")
def fixed(spark: SparkSession, folder: str) -> DataFrame:
    return chunked(m.documents(spark, folder), fixed_pieces)


@query("ch2_semantic")
def semantic(spark: SparkSession, folder: str) -> DataFrame:
    return chunked(m.documents(spark, folder), semantic_pieces)


_PARAGRAPHS = r"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(regexp_replace(p, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')), lambda p: p <> '')"


@query(
    "ch3_hybrid",
    rf"""WITH RECURSIVE p AS (SELECT doc_id, {_PARAGRAPHS} AS ps FROM documents WHERE text IS NOT NULL),
      g AS (SELECT doc_id, ps, 1 AS i, 0 AS chunk, length(ps[1]) AS size FROM p WHERE len(ps) > 0
        UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN size + length(ps[i + 1]) > 2048 THEN chunk + 1 ELSE chunk END, CASE WHEN size + length(ps[i + 1]) > 2048 THEN length(ps[i + 1]) ELSE size + length(ps[i + 1]) END FROM g WHERE i < len(ps))
      SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index, md5(string_agg(ps[i], chr(10) || chr(10) ORDER BY i)) AS digest FROM g GROUP BY ALL""",
)
def hybrid_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraph packing, as digests of the chunks."""
    return chunked(m.documents(spark, folder), paragraph_pieces).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


def _code(spark: SparkSession, folder: str) -> DataFrame:
    return m.documents(spark, folder).where("extraction_method = 'code_ast'")


@query("ch4_code")
def code(spark: SparkSession, folder: str) -> DataFrame:
    d = _code(spark, folder).withColumn("extension", t.extension("file_path"))
    python = chunked(d.where("extension = '.py'"), code_pieces, python=True)
    return python.unionByName(chunked(d.where("extension not in ('.py', '.go')"), code_pieces, python=False))


@query("ch5_go")
def go(spark: SparkSession, folder: str) -> DataFrame:
    return chunked(_code(spark, folder).where(t.extension("file_path") == ".go"), go_pieces)
