"""Repairing text from scanned pages (problem 2).

Misread words: every word has an anagram hash, the sum of the fifth powers of its characters. Reading `rn`
for `m` changes the hash by the same amount in every word, so a word's possible originals are found by an
equi-join of its hash plus the change of each known confusion with the hashes of frequent words. A rare
word is corrected to the most frequent original that is OUTWEIGHED times as frequent, unless the word is
used in texts that were never scanned. All counts are over all chunks.

Edge lines: the first and last EDGE lines of a page that are not blank. A running header is a line whose
form (case and numbers aside, a few characters may be misread) returns on pages of the document, or is a
chapter heading, or names the file; the forms that documents repeat count in others too. A page number is
an edge line with nothing but a number whose distance to the page is that of the document's other pages,
or of the pages around it: numbering may restart by part or skip plates. Neither a form nor a distance
needs a share of a long document: OFTEN pages, or pages close to each other, are enough.

A misread header shares its first or its second half with a header of its document, or all letters once
confusable ones are written alike; what then differs by a few characters is one.

Broken words: a line that ends in a hyphen is continued on the next text line, on the next page if needed.
The corpus decides: if the hyphenated spelling is the more frequent one, the hyphen is the word's own.

The corrections are a distributed table. A page (or paragraph) is given those of its own words by a join,
words joined over a line end included, so no list of corrections is held in one place.

Defined results: only documents extracted by OCR or from a scan source have cases; chunks with null
document, page or content take no part in the repair; rows delivered twice count once; an empty page has
no lines; whole pages are used, however long; ties go to the alphabetically first original. A paragraph
that fills a whole block of pages without a break begins anew with the next block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.session import checkpoint, table

EDGE = 3
OFTEN, CLOSE = 5, 2
OUTWEIGHED, LEAST_ORIGINAL = 12, 4
# What a reader of scans may see, and what was printed.
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("ri", "n"), ("5", "s"), ("@", "a"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("0", "o"), ("1", "l"), ("1", "i"),
    ("cl", "d"), ("d", "cl"), ("b", "h"), ("h", "b"), ("n", "u"), ("u", "n"), ("n", "ri"), ("rn", "m"), ("m", "rn"), ("9", "g"), ("6", "b"), ("8", "b"), ("vv", "w"), ("w", "vv"),
    ("ü", "ti"), ("ti", "ü"), ("h", "li"), ("li", "h"), ("ii", "ü"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("q", "g"), ("g", "q"), ("4", "a"), ("3", "e"), ("7", "t"), ("2", "z"),
)
HYPHENS = "-­¬‐"
TOKEN = re.compile(r"[^\W_]+(?:@[^\W_]+)*@?(?:[-‐][^\W_]+(?:@[^\W_]+)*)*|@[^\W_]+(?:-[^\W_]+)*")
_LAST_WORD = re.compile(rf"([^\W\d_](?:[\w@'’-]*[\w@])?)[{HYPHENS}]\s*\Z")
_FIRST_WORD = re.compile(r"\s*([\w@]+(?:-[\w@]+)*)")
# What a chapter is called; one of its letters may be misread.
CHAPTER_WORDS = ("chapter", "kapitel", "chapitre", "capítulo", "capitulo")
_ONE_OFF = "|".join(word[:i] + r"\S{1,2}" + word[i + 1 :] for word in CHAPTER_WORDS for i in range(len(word)))
CHAPTER = rf"(?iu)^\s*(\S{{1,5}}\s{{2,}})?({_ONE_OFF})\s+\S{{1,4}}\s+\S+.{{0,40}}$"


def anagram_hash(word: str) -> int:
    return sum(ord(c) ** 5 for c in word) % (1 << 62)


def scanned_documents(documents: DataFrame) -> DataFrame:
    """(document_id, file_words) of the documents that came from a scanner."""
    source = F.regexp_replace(F.lower(F.trim("source")), r"[_\s]+", "-")
    return (
        documents.where(F.lower("extraction_method").contains("ocr") | source.startswith("scan") | F.col("file_path").rlike("(?i)(^|/)scan-"))
        .select(F.col("doc_id").alias("document_id"), F.lower(F.element_at(F.split("file_path", "/"), -1)).alias("file_name")).dropDuplicates(["document_id"])
    )


# --- counts over the corpus


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            counts.update(TOKEN.findall(text.lower().replace("‐", "-")))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of a single text column."""
    return texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([anagram_hash(w) for w in words], pa.int64())], names=["word", "n", "h"])


def _really_confused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i, (w, o, seen, printed) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(4)))):
            at = w.find(seen)
            while at >= 0:
                if w[:at] + printed + w[at + len(seen) :] == o:
                    keep.append(i)
                    break
                at = w.find(seen, at + 1)
        yield pa.RecordBatch.from_arrays([batch.column(j).take(pa.array(keep, pa.int64())) for j in (0, 1, 4)], names=["word", "original", "n"])


def corrections(all_counts: DataFrame, scan_counts: DataFrame) -> DataFrame:
    """(word, original): ranked corrections of misread words."""
    counts = all_counts.join(scan_counts.withColumnRenamed("n", "n_scan"), "word", "left").select("word", "n", F.coalesce("n_scan", F.lit(0)).alias("n_scan"))
    rare = counts.where((F.length("word") >= 3) & (F.col("n_scan") > 0) & ((F.col("n") - F.col("n_scan")) * 3 <= F.col("n"))).select("word", "n")
    rare = rare.where(F.col("word").rlike(r"\p{L}")).mapInArrow(_hashed, "word string, n long, h long")
    known = all_counts.where((F.col("n") >= LEAST_ORIGINAL) & ~F.col("word").rlike(r"[\d@]")).mapInArrow(_hashed, "word string, n long, h long")
    pairs = F.array([F.struct(F.lit(a).alias("seen"), F.lit(b).alias("printed"), F.lit(anagram_hash(b) - anagram_hash(a)).alias("delta")) for a, b in CONFUSIONS])
    tried = rare.select("word", F.col("n").alias("n_rare"), "h", F.explode(pairs).alias("c")).where(F.expr("contains(word, c.seen)"))
    tried = tried.select("word", "n_rare", (F.col("h") + F.col("c.delta")).alias("h"), "c.seen", "c.printed")
    met = tried.join(known.select("h", F.col("word").alias("original"), "n"), "h").where(F.col("n") >= OUTWEIGHED * F.col("n_rare"))
    met = met.select("word", "original", "seen", "printed", "n").mapInArrow(_really_confused, "word string, original string, n long")
    best = Window.partitionBy("word").orderBy(F.desc("n"), "original")
    return met.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("word", "original")


# --- lines of pages

_PREFIX = r"(?:page|seite|página|pagina|pág\.?|pag\.?|p\.|s\.|f\.|folio|blatt|—|–|-|·|•|\*|\[|\(|\||~)"
_NUMBER = re.compile(rf"\s*(?:{_PREFIX}\s*)*([0-9lioöszbgqdaäe|!@]{{1,4}}|[ivxlcdmj1]{{1,8}})(?:\s*(?:of|von|sur|de|/)\s*[0-9lio|]{{1,5}})?\s*(?:[—–\-·•*\])|.~]\s*)*", re.I)
_AS_DIGIT = str.maketrans({"l": "1", "i": "1", "|": "1", "!": "1", "o": "0", "ö": "0", "s": "5", "z": "2", "b": "6", "g": "9", "q": "9", "@": "4", "a": "4", "e": "3", "d": "0", "ä": "4"})
_ROMAN = re.compile(r"(m{0,3})(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
_BARE = re.compile(r"\s*[0-9]{1,4}\s*")


def page_numbers(line: str) -> list[int]:
    """The numbers that a line with nothing but a page number may stand for; none for other lines."""
    m = _NUMBER.fullmatch(line)
    if not m:
        return []
    word, out = m[1].lower(), []
    digits = word.translate(_AS_DIGIT)
    if digits.isdigit() and (any(c.isdigit() for c in word) or len(word) == 1 and word in "lio"):
        out.append(int(digits))
    roman = word.replace("j", "i").replace("1", "i")
    if (r := _ROMAN.fullmatch(roman)) and roman:
        value = 0
        for part, letters, unit in zip(r.groups(), ("m", "cdm", "xlc", "ivx"), (1000, 100, 10, 1)):
            if unit == 1000:
                value += 1000 * len(part)
                continue
            one, five, ten = letters
            value += unit * {one + five: 4, one + ten: 9}.get(part, 5 * part.count(five) + part.count(one))
        if value not in out:
            out.append(value)
    return out


_LEADING, _TRAILING = re.compile(r"^\W*\S{1,5}\s{2,}|^\W*\d{1,4}\s*[|·—–-]\s*"), re.compile(r"\s*[|·—–-]\s*\S{1,5}\W*$|\s{2,}\S{1,4}\W*$|(?:\s*\.){2,}\s*\S{1,5}\W*$")


def header_form(line: str) -> str:
    """An edge line without its page number and case."""
    text = line.strip()
    short = _TRAILING.sub("", _LEADING.sub("", text)) if len(text) > 8 else text
    return re.sub(r"\s+", " ", re.sub(r"\d+", "#", (short or text).lower())).strip()


EDGES = "document_id long, id long, page int, line_no int, from_top int, from_bottom int, line string, form string, numbers array<int>, width int"



def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("document_id", pa.int64()), ("id", pa.int64()), ("page", pa.int32()), ("line_no", pa.int32()), ("from_top", pa.int32()), ("from_bottom", pa.int32()), ("line", pa.string()), ("form", pa.string()), ("numbers", pa.list_(pa.int32())), ("width", pa.int32())])
    for batch in batches:
        rows = []
        for doc, chunk, page, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            lines = text.split("\n")
            filled = [i for i, line in enumerate(lines) if line.strip()]
            width = sorted(len(lines[i].strip()) for i in filled)[len(filled) // 2] if filled else 0
            for k, i in enumerate(filled):
                if k < EDGE or len(filled) - 1 - k < EDGE:
                    line = lines[i].strip()
                    rows.append({"document_id": doc, "id": chunk, "page": page, "line_no": i + 1, "from_top": k, "from_bottom": len(filled) - 1 - k, "line": line, "form": header_form(line), "numbers": page_numbers(line), "width": width})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def scanned_pages(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, id, page, content) of scanned pages, one row a chunk."""
    pages = chunks.where("content is not null and document_id is not null and page is not null and id is not null")
    # Several rows for one chunk id are deliveries of the same row.
    pages = pages.join(scanned_documents(documents).select("document_id"), "document_id").select("document_id", "id", "page", "content")
    return pages.dropDuplicates(["id"])


def _repeats(lines: DataFrame, key: str) -> DataFrame:
    """(document_id, key, pages, near): pages with that value, and those of them that have another within CLOSE pages."""
    at = Window.partitionBy("document_id", key).orderBy("page")
    steps = lines.select("document_id", key, "page").distinct()
    steps = steps.withColumn("close", (F.col("page") - F.lag("page").over(at) <= CLOSE) | (F.lead("page").over(at) - F.col("page") <= CLOSE))
    return steps.groupBy("document_id", key).agg(F.count("*").alias("pages"), F.count_if("close").alias("near"))


def plain_letters(form: Column) -> Column:
    """A form with letters that are easily taken for one another written alike."""
    form = F.translate(F.lower(form), "e35@47f1il|!68h0u9q2ﬁﬂ", "ccsaattlllllbbbonggzll")
    for seen, written in (("rl", "n"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("tl", "b"), ("ü", "b"), ("ll", "b")):
        form = F.replace(form, F.lit(seen), F.lit(written))
    return form


def _misread_heads(forms: DataFrame, heads: DataFrame) -> DataFrame:
    """(document_id, form) of the distinct forms that differ from a head of their document by a few misread characters.

    Both meet on a half of their words or on their plain letters, so forms are never compared with all heads.
    """
    forms = forms.join(heads.withColumnRenamed("head", "form"), ["document_id", "form"], "left_anti")

    def keyed(df: DataFrame, name: str) -> DataFrame:
        words = F.split(name, " ")
        middle = F.ceil(F.size(words) / 2).cast("int")
        half = lambda tag, part: F.when(F.size(words) >= 2, F.concat(F.lit(tag), F.array_join(part, " ")))
        keys = F.array(half("<", F.slice(words, F.lit(1), middle)), half(">", F.slice(words, middle + 1, F.size(words))), F.concat(F.lit("="), plain_letters(F.col(name))))
        return df.select("document_id", name, F.explode(F.array_compact(keys)).alias("key"))

    met = keyed(forms, "form").join(keyed(heads, "head"), ["document_id", "key"])
    distance = F.levenshtein("form", "head", 4)
    few = (F.abs(F.length("form") - F.length("head")) <= 3) & (distance >= 0) & (distance <= F.greatest(F.lit(1), F.length("head") / 7))
    return met.where(few).select("document_id", "form").distinct()


def edge_kinds(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, line_no, kind): which edge lines are page numbers and which running headers."""
    numbered = edges.where(F.size("numbers") > 0).select("document_id", "id", "page", "line_no", "line", "from_top", "from_bottom", F.explode("numbers").alias("value"))
    numbered = numbered.withColumn("away", F.col("value") - F.col("page")).withColumn("bare", F.col("line").rlike(r"^\s*[0-9]{1,4}\s*$"))
    support = _repeats(numbered, "away")
    sizes = edges.groupBy("document_id").agg(F.countDistinct("page").alias("n_pages"))
    top = support.groupBy("document_id").agg(F.max("pages").alias("most"))
    numbers = (
        numbered.join(support, ["document_id", "away"]).join(top, "document_id").join(sizes, "document_id")
        .where(
            ((F.col("pages") >= 2) & (F.col("pages") == F.col("most")) & (F.col("pages") * 4 >= F.col("n_pages")))
            | (F.col("near") >= OFTEN)
            | ((F.col("near") >= 3) & (F.least("from_top", "from_bottom") == 0))
            | ((F.least("from_top", "from_bottom") == 0) & (~F.col("bare") | ((F.col("most") == 1) & (F.col("n_pages") <= 2) & (F.col("value") < 1000))))
        )
        .select("id", "line_no").distinct()
    )
    numbers = checkpoint(numbers)
    rest = edges.join(numbers, ["id", "line_no"], "left_anti").where((F.length("form") >= 4) & F.col("form").rlike(r"\p{L}"))
    rest = checkpoint(rest)
    repeats = checkpoint(_repeats(rest, "form").join(sizes, "document_id"))
    often = (F.col("pages") >= OFTEN) | (F.col("near") >= 2) | (F.col("pages") >= 0.15 * F.col("n_pages"))
    headed = repeats.where((F.col("pages") >= 2) & often).select("document_id", F.col("form").alias("head"))
    # A form that most documents with several pages repeat is a header where it stands once, too.
    usual = repeats.where("n_pages >= 2").groupBy("form").agg(F.count_if(F.col("pages") >= 2).alias("repeated"), F.count("*").alias("documents"))
    usual = usual.where((F.col("repeated") >= 3) & (2 * F.col("repeated") >= F.col("documents"))).select("form", F.lit(True).alias("is_usual"))
    words = F.expr("filter(split(form, '[^\\\\p{L}\\\\p{N}]+'), w -> length(w) > 2)")
    named = rest.join(scanned_documents(documents), "document_id").where(F.least("from_top", "from_bottom") <= 1).withColumn("words", words)
    in_name = F.expr("size(filter(words, w -> contains(file_name, w)))")
    named = named.where((F.size("words") >= 2) & (in_name >= 2) & (in_name * 3 >= F.size("words") * 2)).select("id", "line_no", "document_id", F.col("form").alias("head"))
    heads = checkpoint(headed.unionByName(named.select("document_id", "head")).distinct())
    alike = rest.join(_misread_heads(rest.select("document_id", "form").distinct(), heads).unionByName(heads.withColumnRenamed("head", "form")).distinct(), ["document_id", "form"]).select("id", "line_no")
    chapters = rest.where(F.col("line").rlike(CHAPTER))
    chapters = chapters.where(F.least("from_top", "from_bottom") <= 1).where(~F.col("line").rlike(r"[.;,:]\s*$")).select("id", "line_no")
    others = rest.join(usual, "form").select("id", "line_no")
    # A first line that is set like a title: capitals throughout, or short of the page's width and without the end of a sentence.
    tokens = F.expr("filter(split(line, '[\\\\s|.·—–-]+'), w -> w rlike '\\\\p{L}')")
    open_end = ~F.col("line").rlike(r"[.,;:!?»”\"\-­¬‐]\s*$") | F.col("line").rlike(r"(\s*\.){2,}\s*\S{1,5}$")
    letters = F.length(F.regexp_replace("line", r"[^\p{L}]", ""))
    lower = F.length(F.regexp_replace("line", r"[^\p{Ll}]", ""))
    below = edges.where("from_top = 0").join(numbers, ["id", "line_no"], "left_semi").select("id", F.lit(1).alias("first"))
    titled = rest.join(below, "id", "left").where(F.col("from_top") == F.coalesce("first", F.lit(0))).withColumn("tokens", tokens).where(open_end & F.size("tokens").between(1, 5) & (letters * 2 > F.length("line")))
    all_titled = F.expr("forall(tokens, w -> w rlike '^[^\\\\p{Ll}]')")
    titled = titled.where((lower <= 1) | ((F.size("tokens") >= 2) & all_titled) | (F.length("form") * 10 <= F.col("width") * 6)).select("id", "line_no")
    others = others.unionByName(titled)
    headers = alike.unionByName(chapters).unionByName(others).distinct()
    return numbers.withColumn("kind", F.lit("page_number")).unionByName(headers.withColumn("kind", F.lit("header")))


def _breaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line that ends in a hyphen with the first word of the next text line of its page (null: look on the next page), and each page's first word."""
    for batch in batches:
        out: list[tuple] = []
        for doc, chunk, page, text, skip in zip(*(batch.column(i).to_pylist() for i in range(5))):
            skipped = set(skip or ())
            body = [(i + 1, line) for i, line in enumerate(text.split("\n")) if line.strip() and i + 1 not in skipped]
            for k, (no, line) in enumerate(body):
                left = _LAST_WORD.search(line)
                if left:
                    right = _FIRST_WORD.match(body[k + 1][1]) if k + 1 < len(body) else None
                    out.append((doc, chunk, page, no, left[1].lower(), right[1].lower() if right else "" if k + 1 < len(body) else None))
            first = _FIRST_WORD.match(body[0][1]) if body else None
            out.append((doc, chunk, page, 0, None, first[1].lower() if first else None))
        cols = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["document_id", "id", "page", "line_no", "left", "right"])


def broken_words(pages: DataFrame, kinds: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, line_no, joined): the lines that end in a word broken off, and that word."""
    skip = kinds.groupBy("id").agg(F.collect_set("line_no").alias("skip"))
    rows = pages.join(skip, "id", "left").select("document_id", "id", "page", "content", "skip").mapInArrow(_breaks, "document_id long, id long, page int, line_no int, left string, right string")
    rows = checkpoint(rows)
    firsts = rows.where("line_no = 0 and right is not null").groupBy("document_id", (F.col("page") - 1).alias("page")).agg(F.min("right").alias("next"))
    ends = rows.where("line_no > 0").join(firsts, ["document_id", "page"], "left").select("id", "line_no", "left", F.coalesce("right", "next").alias("right"))
    ends = ends.where("right <> ''")
    ends = ends.withColumn("joined", F.concat("left", "right")).withColumn("own", F.concat_ws("-", "left", "right"))
    n = lambda key: counts.select(F.col("word").alias(key), F.col("n").alias(f"n_{key}"))
    judged = ends.join(n("joined"), "joined", "left").join(n("own"), "own", "left")
    own = (F.coalesce("n_own", F.lit(0)) > F.coalesce("n_joined", F.lit(0))) | F.col("right").rlike(r"^\d")
    return judged.where(~own).select("id", "line_no", "joined")


def _first_difference(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _ocr_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Body lines with a misread word; a broken word counts for the line that its first misread character is on."""
    for batch in batches:
        ids, nos = [], []
        for chunk, text, skip, broken, fixes in zip(*(batch.column(i).to_pylist() for i in range(5))):
            misread = {f["word"]: f["original"] for f in fixes}
            skipped, joined = set(skip or ()), {b["line_no"]: b["joined"] for b in broken or ()}
            tail, carried = False, False  # the line before ended in a broken word; and the rest of that word is misread
            for i, line in enumerate(text.split("\n"), 1):
                if not line.strip() or i in skipped:
                    continue
                words = TOKEN.findall(line.lower().replace("‐", "-"))
                if tail and words:
                    words = words[1:]
                hit, tail, carried = carried, i in joined, False
                if tail:
                    left = words.pop() if words else ""
                    original = misread.get(joined[i])
                    if original is not None:
                        carried = _first_difference(joined[i], original) >= len(left)
                        hit = hit or not carried
                if hit or not misread.keys().isdisjoint(words):
                    ids.append(chunk)
                    nos.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32())], names=["id", "line_no"])


def _prepared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Scanned pages, kinds of edge lines, broken words, corrections."""
    chunks, documents = table(spark, folder, "chunks"), table(spark, folder, "documents")
    pages = checkpoint(scanned_pages(chunks, documents))
    edges = checkpoint(pages.select("document_id", "id", "page", "content").mapInArrow(_edges, EDGES))
    kinds = checkpoint(edge_kinds(edges, documents))
    # Deliveries of a row are told by its id; rows without one count each.
    filled = chunks.where("content is not null").select("id", "content")
    filled = filled.where("id is not null").dropDuplicates(["id"]).unionByName(filled.where("id is null"))
    counts = checkpoint(word_counts(filled.select("content")))
    broken = checkpoint(broken_words(pages, kinds, counts))
    more = broken.groupBy(F.col("joined").alias("word")).agg(F.count("*").alias("n"))
    scan_counts = word_counts(pages.select("content")).unionByName(more).groupBy("word").agg(F.sum("n").alias("n"))
    all_counts = counts.unionByName(more).groupBy("word").agg(F.sum("n").alias("n"))
    return pages, kinds, broken, checkpoint(corrections(all_counts, scan_counts))


def _marked(pages: DataFrame, kinds: DataFrame, broken: DataFrame) -> DataFrame:
    skip = kinds.groupBy("id").agg(F.collect_set("line_no").alias("skip"))
    ends = broken.groupBy("id").agg(F.collect_list(F.struct("line_no", "joined")).alias("broken"))
    return pages.join(skip, "id", "left").join(ends, "id", "left")


def _page_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ids): each word of a batch, words joined over a line end included, with the pages that hold it."""
    for batch in batches:
        holders: dict[str, list[int]] = {}
        for chunk, text, broken in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for w in {*TOKEN.findall(text.lower().replace("‐", "-")), *(b["joined"] for b in broken or ())}:
                if len(w) >= 3:
                    holders.setdefault(w, []).append(chunk)
        yield pa.RecordBatch.from_arrays([pa.array(list(holders), pa.string()), pa.array(list(holders.values()), pa.list_(pa.int64()))], names=["word", "keys"])


def own_fixes(words: DataFrame, fixes: DataFrame, *key: Column) -> DataFrame:
    """(key, fixes): the corrections (word, original) of the words of each key; words: (word, keys)."""
    held = words.join(fixes, "word").select(F.explode("keys").alias("k"), "word", "original").select(*key, "word", "original")
    return held.groupBy(*[c for c in held.columns if c not in ("word", "original")]).agg(F.collect_set(F.struct("word", "original")).alias("fixes"))


def noisy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(id, line_no, kind): every noisy line of a scanned page."""
    pages, kinds, broken, fixes = _prepared(spark, folder)
    marked = checkpoint(_marked(pages, kinds, broken).select("id", "content", "skip", "broken"))
    own = own_fixes(marked.select("id", "content", "broken").mapInArrow(_page_words, "word string, keys array<long>"), fixes, F.col("k").alias("id"))
    ocr = marked.join(own, "id").select("id", "content", "skip", "broken", "fixes").mapInArrow(_ocr_lines, "id long, line_no int").withColumn("kind", F.lit("ocr"))
    return kinds.unionByName(broken.select("id", "line_no", F.lit("hyphen").alias("kind"))).unionByName(ocr).distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return noisy_lines(spark, folder)


# --- paragraphs

_OPENS = re.compile(r"^(?: {2,}|\t)\S")


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(document_id, page, k, starts, text): the paragraphs of a page; the first may continue the page before."""
    for batch in batches:
        out: list[tuple] = []
        for doc, page, text, skip, broken in zip(*(batch.column(i).to_pylist() for i in range(5))):
            skipped, joined = set(skip or ()), {b["line_no"] for b in broken or ()}
            paragraphs: list[tuple[bool, list[str]]] = []
            fresh, glue = False, ""
            for i, line in enumerate(text.split("\n"), 1):
                if i in skipped:
                    continue
                if not line.strip():
                    fresh = fresh or bool(paragraphs)
                    continue
                words, opens = line.strip(), bool(_OPENS.match(line))
                if i in joined:
                    words = words.rstrip(HYPHENS + " ")
                if paragraphs and not fresh and not opens:
                    paragraphs[-1][1].append(glue + words)
                else:
                    paragraphs.append((bool(paragraphs) or opens, [words]))
                # A word's own hyphen at the end of a line is continued without a blank, too.
                fresh, glue = False, "" if i in joined or _LAST_WORD.search(words) else " "
            for k, (starts, parts) in enumerate(paragraphs):
                out.append((doc, page, k, starts, "".join(parts) + ("" if k == len(paragraphs) - 1 and glue == "" else " ")))
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()))], names=["document_id", "page", "k", "starts", "text"])


_PARAGRAPH_WORDS = pa.schema([("word", pa.string()), ("keys", pa.list_(pa.struct([("document_id", pa.int64()), ("paragraph", pa.int64())])))])


def _paragraph_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, keys): each word of a batch with the paragraphs that hold it."""
    for batch in batches:
        holders: dict[str, list[dict]] = {}
        for doc, paragraph, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for w in set(TOKEN.findall(text.lower().replace("‐", "-"))):
                if len(w) >= 3:
                    holders.setdefault(w, []).append({"document_id": doc, "paragraph": paragraph})
        yield pa.RecordBatch.from_arrays([pa.array(list(holders), pa.string()), pa.array(list(holders.values()), _PARAGRAPH_WORDS.field("keys").type)], schema=_PARAGRAPH_WORDS)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(document_id, paragraph, page, text) with the misread words of each paragraph corrected."""
    for batch in batches:
        out = []
        for text, fixes in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            original = {f["word"]: f["original"] for f in fixes or ()}

            def fix(m: re.Match, original: dict[str, str] = original) -> str:
                word = m.group()
                new = original.get(word.lower().replace("‐", "-"))
                if not new:
                    return word
                return new.upper() if word.isupper() and len(word) > 1 else new[0].upper() + new[1:] if word[0].isupper() else new

            out.append(TOKEN.sub(fix, text) if original else text)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.string())], names=["document_id", "paragraph", "page", "text"])


def paragraphs(spark: SparkSession, folder: str, block: int = 1024) -> DataFrame:
    """(document_id, paragraph, page, text): continuous paragraphs of scanned documents and the page each began on."""
    pages, kinds, broken, fixes = _prepared(spark, folder)
    rows = _marked(pages, kinds, broken).select("document_id", "page", "content", "skip", "broken").mapInArrow(_assembled, "document_id long, page int, k int, starts boolean, text string")
    rows = checkpoint(rows.withColumn("block", F.floor(F.col("page") / block)))
    # The number of a paragraph: starts in earlier blocks of pages, plus those up to here in its own block.
    sums = rows.groupBy("document_id", "block").agg(F.sum(F.col("starts").cast("long")).alias("n"))
    by_block = Window.partitionBy("document_id").orderBy("block")
    # A paragraph that fills a whole block ends with it, so no paragraph grows without bound.
    sums = sums.withColumn("endless", F.coalesce(F.lag("n").over(by_block) == 0, F.lit(False)).cast("long"))
    own = F.col("n") + F.col("endless")
    sums = sums.withColumn("before", F.sum(own).over(by_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n", "endless")
    here = Window.partitionBy("document_id", "block").orderBy("page", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("within", F.sum(F.col("starts").cast("long")).over(here)).join(sums, ["document_id", "block"])
    rows = rows.withColumn("paragraph", F.col("before") + F.col("within"))
    parts = F.sort_array(F.collect_list(F.struct("page", "k", "text")))
    whole = rows.groupBy("document_id", "paragraph").agg(F.min("page").alias("page"), F.trim(F.array_join(F.transform(parts, lambda p: p["text"]), "")).alias("text"))
    whole = checkpoint(whole.select("document_id", "paragraph", "page", "text"))
    words = whole.select("document_id", "paragraph", "text").mapInArrow(_paragraph_words, "word string, keys array<struct<document_id: long, paragraph: long>>")
    own = own_fixes(words, fixes, F.col("k.document_id").alias("document_id"), F.col("k.paragraph").alias("paragraph"))
    repaired = whole.join(own, ["document_id", "paragraph"], "left").select("document_id", "paragraph", "page", "text", "fixes")
    return repaired.mapInArrow(_repaired, "document_id long, paragraph long, page int, text string")


def p2_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs(spark, folder)


QUERIES = {"p2_found": p2_found, "p2_paragraphs": p2_paragraphs}
SQL: dict[str, str] = {}
