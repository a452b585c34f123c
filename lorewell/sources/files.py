"""Files as frames: recursive scans, exclusion, hash lists, notebooks, notes; and routing by format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import model as m
from lorewell.functions import text as t
from lorewell.operators.ordered import places
from lorewell.operators.relational import EXT_SQL

# Supported extensions and what a scan leaves out.
SUPPORTED = (".pdf", ".md", ".markdown", ".docx", ".epub", ".py", ".java", ".ts", ".tsx", ".js", ".jsx", ".cs", ".go", ".ipynb")
EXCLUDED_SUBFOLDERS = ("problematic", "original", ".quarantine")
TEMPORARY = (".tmp.pdf", ".gs_tmp.pdf")
EXCLUDED_FOLDERS = (
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".pytest_cache", ".venv", "venv", "env", ".env", "dist", "build", ".eggs", "*.egg-info",
    ".cache", ".mypy_cache", ".ruff_cache", "target", "bin", "obj", "vendor", ".idea", ".vscode", ".vs", "coverage", "htmlcov", ".coverage",
)
EXCLUDED_NAMES = (
    ".env", ".env.local", ".env.production", "secrets", "credentials", "*.pem", "*.key", "*.crt", ".ds_store", "thumbs.db", "*.pyc", "*.pyo", "*.pyd",
    "*.so", "*.dylib", "*.dll", "*.class", "*.jar", "*.war", "*.exe", "*.min.js", "*.min.css", "__init__.py", "__pycache__.py",
    "package-lock.json", "yarn.lock", "poetry.lock", "go.mod", "go.sum", "go.work", "go.work.sum", ".gitignore", ".dockerignore", ".eslintrc",
)
# How extraction methods that deliver finished chunks are called.
PRE_CHUNKED = ("docling", "docling_hybrid", "docling_markdown", "markdown_docling", "docling_ocr", "code_ast", "jupyter", "obsidian_graph_rag", "epub_pandoc")
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def is_excluded(path: str | Column) -> Column:
    """Whether a scan leaves a path out: by folder, hidden part, temporary or unwanted name."""
    parts, name = F.split(t.col(path), "/"), t.file_name(path)
    folders = F.exists(parts, lambda p: p.isin(*EXCLUDED_SUBFOLDERS, *EXCLUDED_FOLDERS) | (p.startswith(".") & (p != "..") & (p != ".")))
    temporary = reduce(lambda a, b: a | b, [name.contains(x) for x in TEMPORARY])
    low = F.lower(name)
    unwanted = reduce(lambda a, b: a | b, [low.endswith(x[1:]) if x.startswith("*") else low.contains(x) for x in EXCLUDED_NAMES])
    return folders | temporary | unwanted


def is_supported(path: str | Column) -> Column:
    return t.extension(path).isin(*SUPPORTED)


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, size, modified, file_hash) of the supported files below a folder; the listing is Spark's own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kept = files.where(is_supported("path") & ~is_excluded(F.regexp_replace("path", r"^[a-z]+:/+", "")))
    return kept.select("path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("file_hash"))


def hash_list(spark: SparkSession, path: str) -> DataFrame:
    """(file_hash) of a list with comments: trimmed, lower case."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("file_hash"))
    return lines.where((F.col("file_hash") != "") & ~F.col("file_hash").startswith("#")).distinct()


def read_database(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 8) -> DataFrame:
    """A table of another database, read in ranges of an integer key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


NOTEBOOK = "cells array<struct<cell_type:string, source:string>>, metadata struct<kernelspec:struct<language:string>>"
_NOTEBOOK_LINES = "cells array<struct<cell_type:string, source:array<string>>>, metadata struct<kernelspec:struct<language:string>>"


def notebook_cells(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, page, cell_type, text) of notebook files: blank cells are skipped, code is fenced with the kernel's language. Pure SQL."""
    raw = F.col(content).cast("string")
    lines, whole = F.from_json(raw, _NOTEBOOK_LINES), F.from_json(raw, NOTEBOOK)
    joined = F.transform(lines["cells"], lambda c: F.struct(c["cell_type"].alias("cell_type"), F.array_join(c["source"], "").alias("source")))
    plain = F.transform(whole["cells"], lambda c: F.struct(c["cell_type"].alias("cell_type"), c["source"].alias("source")))
    cells = F.zip_with(joined, plain, lambda a, b: F.struct(b["cell_type"].alias("cell_type"), F.coalesce(a["source"], b["source"]).alias("source")))
    language = F.coalesce(whole["metadata"]["kernelspec"]["language"], F.lit("python"))
    filled = F.filter(cells, lambda c: F.length(F.trim(F.coalesce(c["source"], F.lit("")))) > 0)
    rows = files.select(F.col(path).alias("path"), language.alias("language"), F.posexplode(filled).alias("page", "cell"))
    code = F.concat(F.lit("```"), "language", F.lit("\n"), F.col("cell.source"), F.lit("\n```"))
    return rows.select("path", "page", F.col("cell.cell_type").alias("cell_type"), F.when(F.col("cell.cell_type") == "code", code).otherwise(F.col("cell.source")).alias("text"))


_PARTS_SQL = "string_split(file_path, '/')"
_NAME_SQL = "regexp_extract(file_path, '[^/]*$')"
_EXCLUDED_SQL = (
    f"(len(list_filter({_PARTS_SQL}, lambda p: p IN {EXCLUDED_SUBFOLDERS + EXCLUDED_FOLDERS} OR (starts_with(p, '.') AND p <> '..' AND p <> '.'))) > 0 OR "
    + " OR ".join(f"contains({_NAME_SQL}, '{x}')" for x in TEMPORARY) + " OR "
    + " OR ".join(f"ends_with(lower({_NAME_SQL}), '{x[1:]}')" if x.startswith("*") else f"contains(lower({_NAME_SQL}), '{x}')" for x in EXCLUDED_NAMES) + ")"
)


@query("sc2_excluded_paths", f"SELECT doc_id, {_EXCLUDED_SQL} AS excluded FROM documents")
def excluded_paths(spark: SparkSession, folder: str) -> DataFrame:
    return m.documents(spark, folder).select("doc_id", is_excluded("file_path").alias("excluded"))


@query("sc3_supported", f"SELECT {EXT_SQL} AS extension, {EXT_SQL} IN {SUPPORTED} AS supported, count(*) AS files FROM documents GROUP BY ALL")
def supported(spark: SparkSession, folder: str) -> DataFrame:
    return m.documents(spark, folder).groupBy(t.extension("file_path").alias("extension"), is_supported("file_path").alias("supported")).agg(F.count("*").alias("files"))


@query("sc4_content_hash", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return m.documents(spark, folder).where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("sc5_corpus_scan", f"SELECT c.id, c.content, d.file_path FROM {m.CHUNKS_SQL} c JOIN documents d ON d.doc_id = c.document_id")
def corpus_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The texts meet their documents' paths by id, once: the slim side is joined first."""
    d = m.documents(spark, folder).select(F.col("doc_id").alias("document_id"), "file_path")
    paths = m.chunks(spark, folder, "document_id").join(d, "document_id").select("id", "file_path")
    return m.chunks(spark, folder, "content").join(paths, "id").select("id", "content", "file_path")


@query("sc7_id_ranges", "SELECT floor(id / 1000) AS range, count(DISTINCT id) AS chunks, min(id) AS first, max(id) AS last FROM chunks GROUP BY ALL".replace("floor(id / 1000)", "CAST(floor(id / 1000) AS BIGINT)"))
def id_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks by ranges of ids, the unit of a partial rebuild."""
    c = m.table(spark, folder, "chunks").select("id")
    return c.groupBy(F.floor(F.col("id") / 1000).alias("range")).agg(F.count_distinct("id").alias("chunks"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("sc6_pages", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 500 AS page FROM documents")
def pages(spark: SparkSession, folder: str, size: int = 500) -> DataFrame:
    """Each document's page of a scan in the order of ids; nested sums number them, no task sorts them all."""
    d = m.documents(spark, folder).select("doc_id", F.lit(0).alias("all"), F.floor(F.col("doc_id") / 4096).alias("part"))
    return places(d, ["all"], "part", "doc_id").select("doc_id", F.floor(F.col("place") / size).alias("page"))


def id_range(rows: DataFrame, first: int | None = None, last: int | None = None, key: str = "id") -> DataFrame:
    """Rows of a range of ids; the bounds reach the Parquet scan as pushed filters."""
    rows = rows if first is None else rows.where(F.col(key) >= first)
    return rows if last is None else rows.where(F.col(key) <= last)


@query("sc9_groups", f"SELECT {_PARTS_SQL}[2] AS folder, count(*) AS files, count_if({EXT_SQL} = '.pdf') AS pdfs FROM documents GROUP BY ALL")
def groups(spark: SparkSession, folder: str) -> DataFrame:
    """Files per first folder."""
    d = m.documents(spark, folder).groupBy(F.element_at(F.split("file_path", "/"), 2).alias("folder"))
    return d.agg(F.count("*").alias("files"), F.count_if(t.extension("file_path") == ".pdf").alias("pdfs"))


# --- formats


def is_note(text: str | Column) -> Column:
    """A note by its first 1000 characters: a wikilink, two tags, or frontmatter."""
    head = F.substring(t.col(text), 1, 1000)
    return head.rlike(r"\[\[[^\]]+\]\]") | (F.size(F.regexp_extract_all(head, F.lit(r"(#[\w/-]+)"), 1)) >= 2) | head.rlike(r"\A---\n")


@query(
    "ex9_note_detector",
    r"SELECT doc_id, regexp_matches(left(text, 1000), '\[\[[^\]]+\]\]') OR len(regexp_extract_all(left(text, 1000), '(#[\w/-]+)', 1)) >= 2 OR regexp_matches(left(text, 1000), '\A---\n') AS is_note FROM documents WHERE text IS NOT NULL",
)
def note_detector(spark: SparkSession, folder: str) -> DataFrame:
    """The window of 1000 characters is the detector's definition."""
    return m.documents(spark, folder).where("text is not null").select("doc_id", is_note("text").alias("is_note"))


def route(path: str | Column, text: str | Column) -> Column:
    """The extractor of a file, by extension and, for Markdown, by whether it is a note; null if unsupported."""
    e = t.extension(path)
    return (
        F.when(e.isin(".md", ".markdown"), F.when(is_note(text), "note").otherwise("markdown")).when(e.isin(".pdf", ".docx"), "document")
        .when(e == ".epub", "book").when(e == ".ipynb", "notebook").when(e.isin(".py", ".java", ".ts", ".tsx", ".js", ".jsx", ".cs", ".go"), "code")
    )


_NOTE_SQL = r"(regexp_matches(left(text, 1000), '\[\[[^\]]+\]\]') OR len(regexp_extract_all(left(text, 1000), '(#[\w/-]+)', 1)) >= 2 OR regexp_matches(left(text, 1000), '\A---\n'))"


@query(
    "ex1_routes",
    f"""SELECT CASE WHEN {EXT_SQL} IN ('.md', '.markdown') THEN CASE WHEN {_NOTE_SQL} THEN 'note' ELSE 'markdown' END WHEN {EXT_SQL} IN ('.pdf', '.docx') THEN 'document' WHEN {EXT_SQL} = '.epub' THEN 'book'
      WHEN {EXT_SQL} = '.ipynb' THEN 'notebook' WHEN {EXT_SQL} IN ('.py', '.java', '.ts', '.tsx', '.js', '.jsx', '.cs', '.go') THEN 'code' END AS route, count(*) AS files FROM documents WHERE text IS NOT NULL GROUP BY ALL""",
)
def routes(spark: SparkSession, folder: str) -> DataFrame:
    return m.documents(spark, folder).where("text is not null").groupBy(route("file_path", "text").alias("route")).agg(F.count("*").alias("files"))


FRONTMATTER = r"(?s)\A---\n(.+?)\n---\n"


@query(
    "ex10_frontmatter",
    r"SELECT doc_id, regexp_extract(text, '(?s)\A---\n(.+?)\n---\n', 1) AS frontmatter, length(regexp_replace(text, '(?s)\A---\n(.+?)\n---\n', '')) AS body_size FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '(?s)\A---\n(.+?)\n---\n')",
)
def frontmatter(spark: SparkSession, folder: str) -> DataFrame:
    d = m.documents(spark, folder).where(F.col("text").rlike(FRONTMATTER))
    return d.select("doc_id", F.regexp_extract("text", FRONTMATTER, 1).alias("frontmatter"), F.length(F.regexp_replace("text", FRONTMATTER, "")).cast("long").alias("body_size"))


@query("ex6_notebook_cells", r"SELECT doc_id, kind, count(*) AS cells FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|\n)# %% \[(\w+)\]', 1)) AS kind FROM documents WHERE extraction_method = 'jupyter' AND text IS NOT NULL) GROUP BY ALL")
def script_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells by kind of notebooks kept as scripts; JSON notebooks go through notebook_cells."""
    d = m.documents(spark, folder).where("extraction_method = 'jupyter' and text is not null")
    cells = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|\n)# %% \[(\w+)\]"), 1)).alias("kind"))
    return cells.groupBy("doc_id", "kind").agg(F.count("*").alias("cells"))


@query("ex11_enriched_chunks", f"SELECT c.id, {_NAME_SQL} AS source, d.file_path, d.file_hash FROM {m.CHUNKS_SQL} c JOIN documents d ON d.doc_id = c.document_id")
def enriched_chunks(spark: SparkSession, folder: str) -> DataFrame:
    d = m.documents(spark, folder).select(F.col("doc_id").alias("document_id"), t.file_name("file_path").alias("source"), "file_path", "file_hash")
    return m.chunks(spark, folder, "document_id").join(d, "document_id").select("id", "source", "file_path", "file_hash")


@query("ex12_filled_chunks", f"SELECT c.id, coalesce(c.page, 0) AS page, coalesce(d.extraction_method, 'unknown') AS method, coalesce(d.extraction_method IN {PRE_CHUNKED}, false) AS known FROM {m.CHUNKS_SQL} c JOIN documents d ON d.doc_id = c.document_id WHERE trim(c.content) <> ''")
def filled_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that are not blank, with page and method; an unknown method is flagged."""
    d = m.documents(spark, folder).select(F.col("doc_id").alias("document_id"), "extraction_method")
    c = m.table(spark, folder, "chunks").where(F.trim("content") != "").select("id", "document_id", "page").distinct().join(d, "document_id")
    return c.select("id", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("extraction_method", F.lit("unknown")).alias("method"), F.coalesce(F.col("extraction_method").isin(*PRE_CHUNKED), F.lit(False)).alias("known"))
