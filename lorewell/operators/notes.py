"""Notes and Markdown files as chunks: sections, context from the note graph, whole vaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import model as m
from lorewell.functions import text as t
from lorewell.operators import chunking, graph
from lorewell.operators.relational import EXT_SQL
from lorewell.session import checkpoint
from lorewell.sources.files import FRONTMATTER

# Folders of a vault that hold no notes.
NO_NOTES = (".obsidian", "templates")
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def section_pieces(text: str, max_tokens: int = 512) -> list[chunking.Piece]:
    """Paragraphs packed up to the limit, separators not counted; a heading begins a new piece, a paragraph is never cut."""
    limit, out, held, size = 4 * max_tokens, [], [], 0
    for paragraph in (p.strip() for p in text.split("\n\n")):
        if not paragraph:
            continue
        if held and (paragraph.startswith("#") or size + len(paragraph) > limit):
            out.append(("\n\n".join(held), len(out), "section"))
            held, size = [], 0
        held.append(paragraph)
        size += len(paragraph)
    if held:
        out.append(("\n\n".join(held), len(out), "section"))
    return out


def _pieces_sql(rows: str, heads: bool) -> str:
    """(doc_id, chunk, content) of (doc_id, text) by the rule of section_pieces or, without heads, paragraph_pieces."""
    new = "size + length(ps[i + 1]) > 2048" + (" OR starts_with(ps[i + 1], '#')" if heads else "")
    return rf"""p AS (SELECT doc_id, {chunking._PARAGRAPHS} AS ps FROM {rows}),
      g AS (SELECT doc_id, ps, 1 AS i, 0 AS chunk, length(ps[1]) AS size FROM p WHERE len(ps) > 0
        UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN {new} THEN chunk + 1 ELSE chunk END, CASE WHEN {new} THEN length(ps[i + 1]) ELSE size + length(ps[i + 1]) END FROM g WHERE i < len(ps)),
      pieces AS (SELECT doc_id, chunk, string_agg(ps[i], chr(10) || chr(10) ORDER BY i) AS content FROM g GROUP BY ALL)"""


@query(
    "ex3_markdown_sections",
    "WITH RECURSIVE " + _pieces_sql(f"(SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND {EXT_SQL} IN ('.md', '.markdown'))", True) + " SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index, md5(content) AS digest FROM pieces",
)
def markdown_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files cut at their headings, as digests of the chunks."""
    d = m.documents(spark, folder).where(t.extension("file_path").isin(".md", ".markdown"))
    return chunking.chunked(d, section_pieces).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


def with_context(texts: DataFrame, footers: DataFrame, pieces=chunking.paragraph_pieces) -> DataFrame:
    """(doc_id, chunk_index, content): chunks of notes without frontmatter, each followed by its note's footer.

    The footers travel to the chunks if they are few, else both meet by document.
    """
    body = texts.select("doc_id", F.regexp_replace("text", FRONTMATTER, "").alias("text"))
    cut = chunking.chunked(body, pieces)
    footers = checkpoint(footers.select("doc_id", "footer"))
    few = footers.limit(10_001).count() <= 10_000
    cut = cut.join(F.broadcast(footers) if few else footers, "doc_id", "left")
    return cut.select("doc_id", "chunk_index", F.when(F.col("footer").isNull(), F.col("content")).otherwise(F.concat("content", F.lit("\n\n"), "footer")).alias("content"))


@query(
    "ex7_note_chunks",
    "WITH RECURSIVE "
    + _pieces_sql(rf"(SELECT doc_id, regexp_replace(text, '{FRONTMATTER}', '') AS text FROM {graph._NOTES_SQL})", False)
    + f", f AS ({graph.FOOTER_SQL}) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index, md5(content || chr(10) || chr(10) || footer) AS digest FROM pieces JOIN f USING (doc_id)",
)
def note_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every note from file to chunks: frontmatter off, cut, context appended; as digests."""
    made = with_context(graph.notes(spark, folder), graph.context_footer(spark, folder))
    return made.select("doc_id", "chunk_index", F.md5("content").alias("digest"))


def is_vault_note(path: str | Column) -> Column:
    """Whether a path is a note of a vault: Markdown, outside of the folders of the program and of templates."""
    parts = F.split(t.col(path), "/")
    return (t.extension(path) == ".md") & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in NO_NOTES]))


@query(
    "ex8_vaults",
    rf"""SELECT string_split(file_path, '/')[2] AS vault, count(*) AS notes, CAST(sum(len(regexp_extract_all(text, '\[\[([^\]\|]+)(?:\|([^\]]+))?\]\]', 1))) AS BIGINT) AS links,
      count_if(regexp_matches(text, '(?s)\A---\n(.+?)\n---\n')) AS with_frontmatter FROM documents WHERE text IS NOT NULL AND {EXT_SQL} = '.md' AND len(list_intersect(string_split(file_path, '/'), {list(NO_NOTES)})) = 0 GROUP BY ALL""",
)
def vaults(spark: SparkSession, folder: str) -> DataFrame:
    """The vaults (first folders) with their notes, links and frontmatters."""
    d = m.documents(spark, folder).where(is_vault_note("file_path") & F.col("text").isNotNull())
    facts = d.select(F.element_at(F.split("file_path", "/"), 2).alias("vault"), F.size(F.regexp_extract_all("text", F.lit(graph.WIKILINK), 1)).alias("n"), F.col("text").rlike(FRONTMATTER).alias("front"))
    return facts.groupBy("vault").agg(F.count("*").alias("notes"), F.sum("n").alias("links"), F.count_if("front").alias("with_frontmatter"))


def extract_vault(files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(path, chunk_index, content) of the notes among (path, text); titles are file names unless `nodes` (node_id, title) names them."""
    kept = files.where(is_vault_note("path") & F.col("text").isNotNull()).select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("file_path"), "text")
    made = with_context(kept, graph.footers(kept, nodes))
    return made.join(kept.select("doc_id", F.col("file_path").alias("path")), "doc_id").select("path", "chunk_index", "content")
