"""Validation and security rules as columns: each rule is nullable, the first that is set wins.

Rules on file headers work on the first 512 bytes by definition. Rules that need a file's bytes are functions
over (path, content) frames; the queries run them over the stored texts, encoded as UTF-8.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import model as m
from lorewell.functions import text as t
from lorewell.operators.relational import EXT_SQL
from lorewell.session import checkpoint

# File types by extension, harmless empty files, signatures (hexadecimal), limits.
TYPES = {
    ".pdf": "pdf", ".docx": "docx", ".doc": "doc", ".epub": "epub", ".md": "markdown", ".markdown": "markdown", ".py": "python", ".js": "javascript",
    ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".cs": "csharp", ".go": "go", ".rs": "rust", ".ipynb": "ipynb",
}
EMPTY_ALLOWED = ("__init__.py", "__init__.pyi", ".gitkeep", ".keep")
EXECUTABLE = {
    "7F454C46": "ELF executable (Linux)", "4D5A": "Windows PE executable", "CAFEBABE": "Mach-O executable (macOS)", "FEEDFACE": "Mach-O 32-bit executable",
    "FEEDFACF": "Mach-O 64-bit executable", "CEFAEDFE": "Mach-O reverse byte order", "2321": "Shell script",
}
MAGIC = {"pdf": "255044462D", "docx": "504B0304", "epub": "504B0304", "doc": "D0CF11E0A1B11AE1"}
MOST_BYTES, WARN_BYTES = 500 * 1024 * 1024, 100 * 1024 * 1024
MOST_UNPACKED, MOST_RATIO, MOST_NESTED = 1000 * 1024 * 1024, 100, 2
QUARANTINE_CHECKS = ("ExtensionMismatchStrategy", "ArchiveBombStrategy", "ExecutablePermissionStrategy", "ClamAVStrategy", "HashBlacklistStrategy")
HINTS = {("pdf", "Large_Obfuscated_Data"): "PDFs use base64 for embedded images/fonts", ("pdf", "Suspicious_Shellcode"): "Common byte patterns in PDF stream data", ("code", "Suspicious_Archive_Content"): "Code may reference file extensions in strings"}
HINT_CODE = (".py", ".js", ".ts", ".go", ".java")
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def file_type(path: str = "file_path") -> Column:
    return reduce(lambda w, kv: w.when(t.extension(path) == kv[0], kv[1]), TYPES.items(), F.when(F.lit(False), None))


def header_hex(content: str = "content") -> Column:
    """The first 512 bytes in hexadecimal."""
    return F.hex(F.substring(F.col(content), 1, 512))


def empty_file(path: str, content: str) -> Column:
    return F.when((F.length(content) == 0) & ~t.file_name(path).isin(*EMPTY_ALLOWED), "File is empty")


def too_large(size: str | Column) -> Column:
    return F.when(t.col(size) > MOST_BYTES, "reject").when(t.col(size) > WARN_BYTES, "warn").otherwise("ok")


def printable_share(content: str = "content") -> Column:
    """The share of printable ASCII, tab, LF and CR among the first 512 bytes."""
    head = F.decode(F.substring(F.col(content), 1, 512), "ISO-8859-1")
    return F.length(F.regexp_replace(head, r"[^\x20-\x7E\t\n\r]", "")) / F.length(head)


def executable_kind(content: str = "content") -> Column:
    return reduce(lambda w, kv: w.when(header_hex(content).startswith(kv[0]), kv[1]), EXECUTABLE.items(), F.when(F.lit(False), None))


def magic_matches(kind: str | Column, content: str = "content") -> Column:
    """Whether a binary type has its signature; null for text types."""
    return reduce(lambda w, kv: w.when(t.col(kind) == kv[0], header_hex(content).startswith(kv[1])), MAGIC.items(), F.when(F.lit(False), None))


def extension_mismatch(kind: str | Column, content: str = "content") -> Column:
    """Why a document's header belies its extension, or null; a zip header suits docx and epub."""
    head, own = header_hex(content), t.col(kind)
    actual = (
        F.when(reduce(lambda a, b: a | b, [head.startswith(x) for x in ("7F454C46", "4D5A", "CAFEBABE", "FEEDFA")]), "executable")
        .when(head.startswith("255044462D"), "pdf").when(head.startswith("504B0304"), "zip")
    )
    document = own.isin("pdf", "docx", "epub", "markdown", "text")
    compatible = (actual == own) | ((actual == "zip") & own.isin("docx", "epub"))
    return F.when(document & (actual == "executable"), F.concat(F.lit("Executable masquerading as "), own)).when(
        document & actual.isNotNull() & ~compatible, F.concat(F.lit("Extension claims "), own, F.lit(" but file is "), actual)
    )


def pdf_problem(content: str = "content") -> Column:
    """Header at the start, end mark within the last 1024 bytes."""
    tail = F.hex(F.substring(F.col(content), -1024, 1024))
    return F.when(~header_hex(content).startswith("255044462D"), "missing header").when(F.instr(tail, "2525454F46") == 0, "missing end mark")


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for data in batch.column(1).to_pylist():
            problem = None
            try:
                if data[:4] == b"PK\x03\x04":
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        names, unpacked = z.namelist(), sum(i.file_size for i in z.infolist())
                elif data[:2] == b"\x1f\x8b" or data[257:262] == b"ustar":
                    with tarfile.open(fileobj=io.BytesIO(data)) as z:
                        members = z.getmembers()
                        names, unpacked = [i.name for i in members], sum(i.size for i in members)
                else:
                    names, unpacked = [], 0
                nested = sum(n.lower().endswith((".zip", ".tar", ".gz", ".tgz", ".bz2", ".7z", ".rar")) for n in names)
                if unpacked > MOST_UNPACKED:
                    problem = "unpacked size"
                elif unpacked > MOST_RATIO * max(len(data), 1):
                    problem = "compression ratio"
                elif nested > MOST_NESTED:
                    problem = "nested archives"
            except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError):
                problem = "corrupt archive"
            out.append(problem)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "problem"])


def archive_problems(files: DataFrame) -> DataFrame:
    """(path, problem) of (path, content): bombs and damaged archives; only tables of contents are read."""
    return files.select("path", "content").mapInArrow(_archives, "path string, problem string")


def file_facts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, file_path, content, kind): the stored texts as bytes."""
    d = m.documents(spark, folder).where("text is not null").select("doc_id", "file_path", "file_hash", F.encode("text", "UTF-8").alias("content"))
    return d.withColumn("kind", file_type())


_TYPE_SQL = "CASE " + " ".join(f"WHEN {EXT_SQL} = '{e}' THEN '{k}'" for e, k in TYPES.items()) + " END"
_FACTS_SQL = f"(SELECT doc_id, file_path, file_hash, text, encode(text) AS content, hex(encode(text)) AS hx, {_TYPE_SQL} AS kind FROM documents WHERE text IS NOT NULL)"


@query("va1_empty_files", rf"SELECT doc_id FROM documents WHERE length(text) = 0 AND regexp_extract(file_path, '[^/]*$') NOT IN {EMPTY_ALLOWED}")
def empty_files(spark: SparkSession, folder: str) -> DataFrame:
    return file_facts(spark, folder).where(empty_file("file_path", "content").isNotNull()).select("doc_id")


@query("va2_file_types", f"SELECT coalesce({_TYPE_SQL}, 'unknown') AS kind, count(*) AS files FROM documents GROUP BY ALL")
def file_types(spark: SparkSession, folder: str) -> DataFrame:
    return m.documents(spark, folder).groupBy(F.coalesce(file_type(), F.lit("unknown")).alias("kind")).agg(F.count("*").alias("files"))


_BYTES_SQL = "list_transform(range(0, least(octet_length(content), 512)), lambda i: substr(hx, CAST(2 * i + 1 AS INTEGER), 2))"
_SHARE_SQL = f"round(len(list_filter({_BYTES_SQL}, lambda b: (b >= '20' AND b <= '7E') OR b IN ('09', '0A', '0D'))) / CAST(least(octet_length(content), 512) AS DOUBLE), 6)"


@query("va3_text_share", f"SELECT doc_id, {_SHARE_SQL} AS share, {_SHARE_SQL} > 0.9e0 AS is_text FROM {_FACTS_SQL} WHERE octet_length(content) > 0")
def text_share(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose header is hardly printable ASCII."""
    share = file_facts(spark, folder).where(F.length("content") > 0).select("doc_id", F.round(printable_share(), 6).alias("share"))
    return share.withColumn("is_text", F.col("share") > 0.9)


_EXEC_SQL = "CASE " + " ".join(f"WHEN starts_with(hx, '{h}') THEN '{k}'" for h, k in EXECUTABLE.items()) + " END"
_MAGIC_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN starts_with(hx, '{h}')" for k, h in MAGIC.items()) + " END"
_ACTUAL_SQL = "CASE WHEN starts_with(hx, '7F454C46') OR starts_with(hx, '4D5A') OR starts_with(hx, 'CAFEBABE') OR starts_with(hx, 'FEEDFA') THEN 'executable' WHEN starts_with(hx, '255044462D') THEN 'pdf' WHEN starts_with(hx, '504B0304') THEN 'zip' END"
_SIZE_SQL = f"CASE WHEN octet_length(content) > {MOST_BYTES} THEN 'reject' WHEN octet_length(content) > {WARN_BYTES} THEN 'warn' ELSE 'ok' END"
_MISMATCH_SQL = f"""CASE WHEN kind IN ('pdf', 'docx', 'epub', 'markdown', 'text') AND {_ACTUAL_SQL} = 'executable' THEN 'Executable masquerading as ' || kind
  WHEN kind IN ('pdf', 'docx', 'epub', 'markdown', 'text') AND {_ACTUAL_SQL} IS NOT NULL AND NOT ({_ACTUAL_SQL} = kind OR ({_ACTUAL_SQL} = 'zip' AND kind IN ('docx', 'epub'))) THEN 'Extension claims ' || kind || ' but file is ' || {_ACTUAL_SQL} END"""


@query("va4_executables", f"SELECT doc_id, {_EXEC_SQL} AS found FROM {_FACTS_SQL}")
def executables(spark: SparkSession, folder: str) -> DataFrame:
    """What kind of executable each file is by its first bytes; null if none."""
    return file_facts(spark, folder).select("doc_id", executable_kind().alias("found"))


@query("va5_magic", f"SELECT kind, {_MAGIC_SQL} AS matches, count(*) AS files FROM {_FACTS_SQL} WHERE {_MAGIC_SQL} IS NOT NULL GROUP BY ALL")
def magic(spark: SparkSession, folder: str) -> DataFrame:
    return file_facts(spark, folder).select("kind", magic_matches("kind").alias("matches")).where("matches is not null").groupBy("kind", "matches").agg(F.count("*").alias("files"))


@query("va6_sizes", f"SELECT {_SIZE_SQL} AS verdict, count(*) AS files, CAST(sum(octet_length(content)) AS BIGINT) AS bytes FROM {_FACTS_SQL} GROUP BY ALL")
def sizes(spark: SparkSession, folder: str) -> DataFrame:
    return file_facts(spark, folder).groupBy(too_large(F.length("content")).alias("verdict")).agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("bytes"))


@query("va8_extension_mismatch", f"SELECT doc_id, kind, {_MISMATCH_SQL} AS reason FROM {_FACTS_SQL}")
def mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Why each file's header belies its extension; null if it doesn't."""
    return file_facts(spark, folder).select("doc_id", "kind", extension_mismatch("kind").alias("reason"))


@query("va9_scripts", f"SELECT doc_id, starts_with(hx, '2321') AS script, starts_with(hx, '2321') AND kind NOT IN ('python', 'javascript', 'typescript') AS quarantine FROM {_FACTS_SQL} WHERE kind IS NOT NULL")
def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a file begins with an interpreter line; those that are no scripts by extension belong in quarantine."""
    script = header_hex().startswith("2321")
    return file_facts(spark, folder).where("kind is not null").select("doc_id", script.alias("script"), (script & ~F.col("kind").isin("python", "javascript", "typescript")).alias("quarantine"))


def permission_verdict(kind: str | Column, mode: str | Column, content: str = "content") -> Column:
    """What to do about a file's execute bits: quarantine (an interpreter line in no script), remedy (take the bits away) or ok."""
    own, bits = t.col(kind), t.col(mode).bitwiseAND(F.lit(0o111))
    script = own.isin("python", "javascript", "typescript")
    return F.when(header_hex(content).startswith("2321") & ~script, "quarantine").when((bits > 0) & ~script, "remedy").otherwise("ok")


def remedied_mode(mode: str | Column) -> Column:
    """A file mode without its execute bits."""
    return t.col(mode).bitwiseAND(F.lit(0o666))


def is_archive(content: str = "content") -> Column:
    """Whether the first bytes are those of a zip, gzip or tar file."""
    head = header_hex(content)
    return head.startswith("504B0304") | head.startswith("1F8B") | (F.substring(head, 515, 10) == "7573746172")


@query(
    "va7_archives",
    f"SELECT doc_id, starts_with(hx, '504B0304') OR starts_with(hx, '1F8B') OR substr(hx, 515, 10) = '7573746172' AS archive, CAST(NULL AS VARCHAR) AS problem FROM {_FACTS_SQL}",
)
def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Which files are archives, and what is wrong with those; only archives reach Python."""
    f = file_facts(spark, folder).select("doc_id", is_archive().alias("archive"), F.when(is_archive(), F.col("content")).alias("content"))
    bad = archive_problems(f.where("archive").select(F.col("doc_id").cast("string").alias("path"), "content")).select(F.col("path").cast("long").alias("doc_id"), "problem")
    return f.select("doc_id", "archive").join(bad, "doc_id", "left").select("doc_id", "archive", "problem")


@query("va10_pdf_integrity", f"SELECT doc_id, CASE WHEN NOT starts_with(hx, '255044462D') THEN 'missing header' WHEN NOT contains(right(hx, 2048), '2525454F46') THEN 'missing end mark' END AS problem FROM {_FACTS_SQL} WHERE kind = 'pdf'")
def pdf_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with each file that is called a PDF (also CO7); the stored texts are no PDFs, so their header is missing."""
    return file_facts(spark, folder).where("kind = 'pdf'").select("doc_id", pdf_problem().alias("problem"))


@query(
    "va_chain",
    f"""SELECT coalesce(CASE WHEN length(text) = 0 AND regexp_extract(file_path, '[^/]*$') NOT IN {EMPTY_ALLOWED} THEN 'FileExistenceStrategy' END, CASE WHEN {_SIZE_SQL} = 'reject' THEN 'FileSizeStrategy' END,
        CASE WHEN kind IS NULL THEN 'ExtensionStrategy' END, CASE WHEN {_MISMATCH_SQL} IS NOT NULL THEN 'ExtensionMismatchStrategy' END, CASE WHEN {_EXEC_SQL} IS NOT NULL THEN 'ExecutableCheckStrategy' END,
        CASE WHEN NOT {_MAGIC_SQL} THEN 'MagicSignatureStrategy' END, CASE WHEN kind = 'pdf' AND NOT contains(right(hx, 2048), '2525454F46') THEN 'PDFIntegrityStrategy' END,
        CASE WHEN kind NOT IN {tuple(MAGIC)} AND octet_length(content) > 0 AND {_SHARE_SQL} <= 0.9e0 THEN 'TextFileStrategy' END, 'valid') AS verdict, count(*) AS files FROM {_FACTS_SQL} GROUP BY ALL""",
)
def chain(spark: SparkSession, folder: str) -> DataFrame:
    """The first failing check of each file, counted."""
    f = file_facts(spark, folder)
    bad = archive_problems(f.where(is_archive()).select(F.col("doc_id").cast("string").alias("path"), "content")).where("problem is not null")
    bad = checkpoint(bad.select(F.col("path").cast("long").alias("doc_id"), F.lit(True).alias("bomb")))
    few = bad.limit(m.FEW + 1).count() <= m.FEW
    f = f.join(F.broadcast(bad) if few else bad, "doc_id", "left")
    text_like = ~F.col("kind").isin(*MAGIC) & (F.length("content") > 0) & (F.round(printable_share(), 6) <= 0.9)
    first = F.coalesce(
        F.when(empty_file("file_path", "content").isNotNull(), "FileExistenceStrategy"), F.when(too_large(F.length("content")) == "reject", "FileSizeStrategy"),
        F.when(F.col("kind").isNull(), "ExtensionStrategy"), F.when(extension_mismatch("kind").isNotNull(), "ExtensionMismatchStrategy"),
        F.when(executable_kind().isNotNull(), "ExecutableCheckStrategy"), F.when(F.col("bomb"), "ArchiveBombStrategy"), F.when(~magic_matches("kind"), "MagicSignatureStrategy"),
        F.when((F.col("kind") == "pdf") & pdf_problem().isNotNull(), "PDFIntegrityStrategy"), F.when(text_like, "TextFileStrategy"), F.lit("valid"),
    )
    return f.groupBy(first.alias("verdict")).agg(F.count("*").alias("files"))


# --- pattern rules

# Strings of the pattern rules. Each rule: alternatives of conditions, each a list that must hold together.
# A string in a condition: (pattern, ignore case, is a regular expression).
_S = lambda s, nocase=False, regex=False: (s, nocase, regex)
_AUTO = [_S("AutoOpen", True), _S("AutoExec", True), _S("Auto_Open", True), _S("Document_Open", True)]
_RUN = [_S("Shell", True), _S("WScript.Shell", True), _S("CreateObject", True), _S("URLDownloadToFile", True), _S("powershell", True)]
_NC = _S(r"nc\s+-e\s+/bin/(ba)?sh", False, True)
_ASKED = [_S("$_GET", True), _S("$_POST", True), _S("$_REQUEST", True)]
_DANGEROUS = [_S("eval(", True), _S("system(", True), _S("exec(", True), _S("passthru(", True), _S("shell_exec(", True)]
RULES = {
    "Suspicious_VBA_Macros": [[a, b] for a in _AUTO for b in _RUN],
    "Malicious_PDF_JavaScript": [[_S("/JavaScript"), _S("/Launch")], [_S("/JavaScript"), _S("shellcode", True)], [_S("/JavaScript"), _S("eval(", True), _S("fromCharCode", True)]],
    "Cryptocurrency_Miner": [[_S("stratum+tcp://")], [_S("stratum+ssl://")], [_S("xmrig", True), _S("cryptonight", True)], [_S("coinhive", True)]],
    "Suspicious_Script_Download": [[_S(r"curl\s+[^\n]+\|\s*(ba)?sh", True, True)], [_S(r"wget\s+[^\n]+\|\s*(ba)?sh", True, True)], [_S(r"curl\s+[^\n]+\|\s*python", True, True)]],
    "Reverse_Shell": [[_S("bash -i >& /dev/tcp/")], [_NC], [_S("socket.socket"), _S("pty.spawn")], [_S("use Socket"), _NC]],
    "Webshell_Indicators": [[a, b] for a in _ASKED for b in _DANGEROUS] + [[_S("base64_decode($_", True)], [_S("eval(Request", True)]],
}


def _holds(text: Column, low: Column, string: tuple) -> Column:
    pattern, nocase, regex = string
    if regex:
        return text.rlike(("(?i)" if nocase else "") + pattern)
    return low.contains(pattern.lower()) if nocase else text.contains(pattern)


def rule_matches(text: str | Column, low: str | Column | None = None, rules: dict = RULES) -> Column:
    """The names of the rules that a text matches, in order. low: the text in lower case, if it is at hand."""
    c = t.col(text)
    lower = F.lower(c) if low is None else t.col(low)
    both = lambda strings: reduce(lambda a, b: a & b, [_holds(c, lower, s) for s in strings])
    named = [F.when(reduce(lambda a, b: a | b, [both(s) for s in ways]), F.lit(name)) for name, ways in rules.items()]
    return F.array_compact(F.array(*named))


def _holds_sql(string: tuple) -> str:
    pattern, nocase, regex = string
    quoted = pattern.replace("'", "''")
    if regex:
        return f"regexp_matches(text, '{'(?i)' if nocase else ''}{quoted}')"
    return f"contains(lower(text), '{quoted.lower()}')" if nocase else f"contains(text, '{quoted}')"


_RULES_SQL = {name: "(" + " OR ".join("(" + " AND ".join(map(_holds_sql, s)) + ")" for s in ways) + ")" for name, ways in RULES.items()}


_STRINGS = {name: list(dict.fromkeys(s for way in ways for s in way)) for name, ways in RULES.items()}


@query(
    "se2_rule_matches",
    " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count_if({_RULES_SQL[name]}) AS matched, count_if({' OR '.join(map(_holds_sql, strings))}) AS some_string FROM documents WHERE text IS NOT NULL" for name, strings in _STRINGS.items()
    ),
)
def counted_rules(spark: SparkSession, folder: str) -> DataFrame:
    """For each rule the documents that match it and those that hold one of its strings at least, in one pass."""
    d = m.documents(spark, folder).where("text is not null").select("text", F.lower("text").alias("low"))
    some = {name: reduce(lambda a, b: a | b, [_holds(F.col("text"), F.col("low"), s) for s in strings]) for name, strings in _STRINGS.items()}
    flags = d.select(rule_matches("text", "low").alias("rules"), *[some[n].alias(n) for n in RULES])
    each = flags.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.array_contains("rules", n).alias("m"), F.col(n).alias("s")) for n in RULES])).alias("r"))
    return each.groupBy("r.rule").agg(F.count_if("r.m").alias("matched"), F.count_if("r.s").alias("some_string"))


def matched_rules(documents: DataFrame) -> DataFrame:
    """(doc_id, rule) of (doc_id, text)."""
    return documents.where("text is not null").select("doc_id", F.explode(rule_matches("text", F.lower("text"))).alias("rule"))


def false_positive_hint(path: str, rule: str) -> Column:
    group = F.when(t.extension(path) == ".pdf", "pdf").when(t.extension(path).isin(*HINT_CODE), "code")
    return reduce(lambda w, kv: w.when((group == kv[0][0]) & (F.col(rule) == kv[0][1]), f"Likely false positive: {kv[1]}"), HINTS.items(), F.when(F.lit(False), "")).otherwise("")


_LISTED_SQL = "(SELECT file_hash FROM documents GROUP BY file_hash HAVING count(*) > 1)"


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes that more than one document has stand in for a list of known bad files."""
    return m.documents(spark, folder).groupBy("file_hash").count().where("count > 1").select("file_hash", F.lit(True).alias("listed"))


@query("se1_hash_blacklist", f"SELECT doc_id, 'CRITICAL' AS severity FROM documents WHERE file_hash IN {_LISTED_SQL}")
def blacklisted(spark: SparkSession, folder: str) -> DataFrame:
    d = m.documents(spark, folder).select("doc_id", "file_hash")
    return d.join(_listed(spark, folder), "file_hash", "left_semi").select("doc_id", F.lit("CRITICAL").alias("severity"))


def classified(severity: Column, valid: Column, check: Column) -> Column:
    """critical, warning or clean."""
    return F.when((severity == "CRITICAL") | (~valid & check.isin(*QUARANTINE_CHECKS)), "critical").when((severity == "WARNING") | ~valid, "warning").otherwise("clean")


SCANNER = "1"


def scan(files: DataFrame, listed: DataFrame, allowed: DataFrame | None = None, cache: DataFrame | None = None, version: str = SCANNER) -> DataFrame:
    """(doc_id, file_hash, is_valid, severity, validation_check, source, rules) of (doc_id, file_hash, text).

    A hash on the allowlist passes; one that this version of the scanner has seen keeps its result; only the
    texts of the others are read, for the hash list and the rules. listed: (file_hash, listed); allowed:
    (file_hash); cache: (file_hash, is_valid, severity, validation_check, scanner_version).
    """
    keys = files.select("doc_id", "file_hash")
    none = F.array().cast("array<string>")
    passed = keys.join((allowed if allowed is not None else keys.limit(0)).select("file_hash").distinct(), "file_hash", "left_semi")
    rest = keys.join((allowed if allowed is not None else keys.limit(0)).select("file_hash"), "file_hash", "left_anti") if allowed is not None else keys
    parts = [passed.select("doc_id", "file_hash", F.lit(True).alias("is_valid"), F.lit("INFO").alias("severity"), F.lit("").alias("validation_check"), F.lit("allowlist").alias("source"), none.alias("rules"))]
    if cache is not None:
        seen = cache.where(F.col("scanner_version") == version).select("file_hash", "is_valid", "severity", "validation_check")
        parts.append(rest.join(seen, "file_hash").select("doc_id", "file_hash", "is_valid", "severity", "validation_check", F.lit("cache").alias("source"), none.alias("rules")))
        rest = uncached(rest, cache, version)
    todo = checkpoint(rest.join(listed, "file_hash", "left").select("doc_id", "file_hash", F.coalesce("listed", F.lit(False)).alias("bad")))
    few = todo.limit(m.FEW + 1).count() <= m.FEW
    texts = files.select("doc_id", "text").join(F.broadcast(todo.select("doc_id")) if few else todo.select("doc_id"), "doc_id", "left_semi")
    # What leaves the stage of the texts are names of rules.
    found = texts.select("doc_id", rule_matches("text", F.lower("text")).alias("rules"))
    parts.append(
        todo.join(found, "doc_id").select(
            "doc_id", "file_hash", (~F.col("bad")).alias("is_valid"),
            F.when(F.col("bad"), "CRITICAL").when(F.size("rules") > 0, "WARNING").otherwise("INFO").alias("severity"),
            F.when(F.col("bad"), "HashBlacklistStrategy").when(F.size("rules") > 0, "YARAStrategy").otherwise("").alias("validation_check"), F.lit("scan").alias("source"), "rules",
        )
    )
    return reduce(DataFrame.unionByName, parts)


_ANY_SQL = "(" + " OR ".join(_RULES_SQL.values()) + ")"
_ALLOWED_SQL = "(SELECT file_hash FROM documents WHERE source = 'manuals')"
_CACHED_SQL = "(SELECT file_hash FROM documents WHERE doc_id % 9 = 1)"
_SCAN_SQL = f"""(SELECT doc_id, file_hash, NOT (bad AND source = 'scan') AS is_valid, CASE WHEN source <> 'scan' THEN 'INFO' WHEN bad THEN 'CRITICAL' WHEN hit THEN 'WARNING' ELSE 'INFO' END AS severity,
    CASE WHEN source <> 'scan' THEN '' WHEN bad THEN 'HashBlacklistStrategy' WHEN hit THEN 'YARAStrategy' ELSE '' END AS validation_check, source
  FROM (SELECT doc_id, file_hash, file_hash IN {_LISTED_SQL} AS bad, {_ANY_SQL} AS hit, CASE WHEN file_hash IN {_ALLOWED_SQL} THEN 'allowlist' WHEN file_hash IN {_CACHED_SQL} THEN 'cache' ELSE 'scan' END AS source FROM documents WHERE text IS NOT NULL))"""


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    """The stored texts scanned. Hashes of one source stand in for the allowlist, those of every ninth document for what was scanned before."""
    d = m.documents(spark, folder)
    cache = d.where("doc_id % 9 = 1").select("file_hash").distinct().select("file_hash", F.lit(True).alias("is_valid"), F.lit("INFO").alias("severity"), F.lit("").alias("validation_check"), F.lit(SCANNER).alias("scanner_version"))
    return scan(d.where("text is not null").select("doc_id", "file_hash", "text"), _listed(spark, folder), d.where("source = 'manuals'").select("file_hash"), cache)


@query("se5_scan", f"SELECT * FROM {_SCAN_SQL}")
def scan_results(spark: SparkSession, folder: str) -> DataFrame:
    return scanned(spark, folder).drop("rules")


@query("se7_classes", f"SELECT CASE WHEN severity = 'CRITICAL' OR (NOT is_valid AND validation_check IN {QUARANTINE_CHECKS}) THEN 'critical' WHEN severity = 'WARNING' OR NOT is_valid THEN 'warning' ELSE 'clean' END AS class, count(*) AS files FROM {_SCAN_SQL} GROUP BY ALL")
def scan_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Also the summary of a scan (AG19)."""
    return scanned(spark, folder).groupBy(classified(F.col("severity"), F.col("is_valid"), F.col("validation_check")).alias("class")).agg(F.count("*").alias("files"))


def cache_after(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The scan cache after an upsert: per hash the newest row wins."""
    both = cache.unionByName(results)
    rest = [c for c in both.columns if c != "file_hash"]
    return both.groupBy("file_hash").agg(F.max_by(F.struct(*rest), "scanned_at").alias("r")).select("file_hash", *[f"r.{c}" for c in rest])


def uncached(files: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Files that the cache has no result of this scanner version for."""
    return files.join(cache.where(F.col("scanner_version") == version).select("file_hash"), "file_hash", "left_anti")


def without_old(cache: DataFrame, as_of: Column, days: int) -> DataFrame:
    return cache.where(F.col("scanned_at") >= as_of - F.make_dt_interval(F.lit(days)))


@query(
    "se6_cache_statistics",
    """SELECT count(*) AS entries, count_if(valid) AS valid, count_if(NOT valid) AS invalid, min(seen) AS oldest, max(seen) AS newest FROM (
      SELECT file_hash, max_by(extraction_method IS NOT NULL, epoch_us(coalesce(indexed_at, TIMESTAMP '1970-01-01')) + doc_id) AS valid, max(indexed_at) AS seen FROM documents GROUP BY file_hash)""",
)
def cache_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The newest entry per hash, counted (AG10)."""
    when = F.unix_micros(F.coalesce(F.col("indexed_at").cast("timestamp"), F.lit("1970-01-01").cast("timestamp"))) + F.col("doc_id")
    latest = m.documents(spark, folder).groupBy("file_hash").agg(F.max_by(F.col("extraction_method").isNotNull(), when).alias("valid"), F.max("indexed_at").alias("at"))
    return latest.agg(F.count("*").alias("entries"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.min("at").alias("oldest"), F.max("at").alias("newest"))


@query("se9_quarantine", f"SELECT doc_id, 'quarantine/' || file_hash AS kept_at, severity FROM {_SCAN_SQL} WHERE NOT is_valid AND validation_check IN {QUARANTINE_CHECKS}")
def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """What a scan moves to quarantine."""
    s = scanned(spark, folder).where(~F.col("is_valid") & F.col("validation_check").isin(*QUARANTINE_CHECKS))
    return s.select("doc_id", F.concat(F.lit("quarantine/"), "file_hash").alias("kept_at"), "severity")


@query("se10_actions", f"SELECT doc_id, CASE severity WHEN 'CRITICAL' THEN 'reject' WHEN 'WARNING' THEN 'warn' ELSE 'accept' END AS action FROM {_SCAN_SQL}")
def actions(spark: SparkSession, folder: str) -> DataFrame:
    return scanned(spark, folder).select("doc_id", F.when(F.col("severity") == "CRITICAL", "reject").when(F.col("severity") == "WARNING", "warn").otherwise("accept").alias("action"))


def quarantined(results: DataFrame, files: DataFrame, at: Column) -> DataFrame:
    """The records of what goes to quarantine: where it was and is, when and why, and whether it was put back.

    results: of a scan; files: (doc_id, file_path).
    """
    bad = results.where(~F.col("is_valid") & F.col("validation_check").isin(*QUARANTINE_CHECKS)).join(files.select("doc_id", "file_path"), "doc_id")
    return bad.select(
        F.col("file_path").alias("original_path"), F.concat(F.lit("quarantine/"), t.file_name("file_path"), F.lit(".REJECTED")).alias("kept_at"), at.alias("quarantined_at"),
        F.col("severity").alias("reason"), "validation_check", "file_hash", F.lit(False).alias("restored"), F.lit(None).cast("timestamp").alias("restored_at"),
    )


def after_restore(records: DataFrame, paths: DataFrame, at: Column) -> DataFrame:
    """The records after the files named in `paths` (original_path) were put back; what was put back before stays as it is."""
    back = paths.select("original_path", F.lit(True).alias("_back")).distinct()
    now = F.col("_back").isNotNull() & ~F.col("restored")
    both = records.join(back, "original_path", "left")
    return both.withColumn("restored_at", F.when(now, at).otherwise(F.col("restored_at"))).withColumn("restored", F.col("restored") | now).drop("_back")


def after_purge(records: DataFrame, as_of: Column, days: int) -> DataFrame:
    """The records without files that lie in quarantine for more than `days` days; restored ones are kept as a trace."""
    return records.where(F.col("restored") | (F.col("quarantined_at") >= as_of - F.make_dt_interval(F.lit(days))))


@query(
    "se9_after_purge",
    f"""WITH q AS (SELECT d.doc_id, coalesce(d.indexed_at, TIMESTAMP '2020-01-01') AS seen FROM documents d WHERE d.file_hash IN {_LISTED_SQL}), newest AS (SELECT max(seen) AS seen FROM q)
      SELECT count(*) AS records, count_if(doc_id % 2 = 1) AS restored, count_if(doc_id % 2 = 1 OR q.seen >= newest.seen - INTERVAL 30 DAY) AS after_purge FROM q, newest""",
)
def purged(spark: SparkSession, folder: str, days: int = 30) -> DataFrame:
    """A quarantine of all listed files: how many records there are, are put back, and stay after what is older is purged."""
    d = m.documents(spark, folder).select("doc_id", "file_path", "file_hash", F.coalesce(F.col("indexed_at").cast("timestamp"), F.lit("2020-01-01").cast("timestamp")).alias("at"))
    found = d.join(_listed(spark, folder), "file_hash").select("doc_id", "file_path", "file_hash", "at", F.lit(False).alias("is_valid"), F.lit("CRITICAL").alias("severity"), F.lit("HashBlacklistStrategy").alias("validation_check"))
    records = quarantined(found.drop("file_path"), found.select("doc_id", "file_path"), F.col("at"))
    records = after_restore(records, found.where("doc_id % 2 = 1").select(F.col("file_path").alias("original_path")), F.current_timestamp())
    newest = records.agg(F.max("quarantined_at").alias("newest"))
    kept = after_purge(records.crossJoin(F.broadcast(newest)), F.col("newest"), days)  # one row
    count = records.agg(F.count("*").alias("records"), F.count_if("restored").alias("restored"))
    return count.crossJoin(kept.agg(F.count("*").alias("after_purge")))  # single rows
