"""Personal information inside free text: found, and replaced by typed placeholders (problem 8).

Every text is read through small transducers that undo disguises (full-width and look-alike characters,
at and dot written out or bracketed, spelled-out digits) and keep, for each character they emit, the place
in the source it came from. Identifiers are detected in the normalised text; their spans are mapped back,
so that what is reported and replaced is exactly the source's characters.

Names need no full list: family names are learned from the whole corpus, as the words that stand beside a
listed given name in one of the usual forms; a name is then a learned family name with a given name (listed
or not) or an initial beside it. The learned words are a distributed table: each text is given those of
them that it holds by a join on its words, so no lexicon is held in one place, however large it grows.

Defined results: null and empty texts have no case; rows delivered twice count once; texts are read
whole; spans of one kind that overlap are reported once, the earlier kind in KINDS wins over a later one
where they overlap; an empty list of given names still finds everything but names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.session import checkpoint, table

KINDS = ("email", "identity", "phone", "address", "name")

# Look-alike letters (Cyrillic and Greek) and the Latin letters they imitate.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "aeopcyxijshdqwABEKMHOPCTYXABEZHIKMNOPTYXo"))
_ONE_TO_ONE = {ord(a): b for a, b in LOOKALIKES.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {0xA0: " ", 0x2007: " ", 0x202F: " ", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-"}

_ODD = re.compile("[" + "".join(map(re.escape, map(chr, _ONE_TO_ONE))) + "]")

# The words for the digits 0 to 9 in the languages of the corpus.
DIGIT_WORDS = {
    w: str(n)
    for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
    for n, w in enumerate(words.split())
} | {"oh": "0"}
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:{_DIGIT})(?:[ -](?:{_DIGIT})){{5,}}\b", re.I)
_SPELLED_HINT = re.compile(rf"[ -](?:{_DIGIT})[ -](?:{_DIGIT})[ -]", re.I)
_DIGIT_WORDS = frozenset(DIGIT_WORDS)
_AT_WORDS = frozenset("at ät arroba arobase klammeraffe dot punkt punto point".split())
_AT = r"at|ät|arroba|arobase|klammeraffe"
_DOT = r"dot|punkt|punto|point"
_DISGUISE = re.compile(
    rf"[ ]?[\[({{<][ ]?(?:(?P<at>{_AT})|(?P<dot>{_DOT}))[ ]?[\])}}>][ ]?|[ ](?:(?P<at2>AT|{_AT})|(?P<dot2>DOT|{_DOT}))[ ](?=[\w-]+(?:[ ]?[\[({{]?[ ]?(?:DOT|{_DOT})\b|\.\w|\b))"
)


def normalise(text: str, words: set[str] | None = None) -> tuple[str, list[tuple[int, int]]]:
    """The text without disguises, and (normalised place, shift to the source) of each change, ascending.

    Look-alikes are replaced one for one. A place p of the result lies at p + shift of the last change at or before p.
    """
    plain = text if text.isascii() else _ODD.sub(lambda m: _ONE_TO_ONE[ord(m.group())], text)
    hits: list[tuple[int, int, str]] = []
    words = simple_words(plain) if words is None else words
    if not _AT_WORDS.isdisjoint(words):
        for m in _DISGUISE.finditer(plain):
            hits.append((m.start(), m.end(), "@" if m["at"] or m["at2"] else "."))
    # A lone word between blanks is only a disguise if the whole then reads as an address.
    if hits:
        hits = _addresses_only(plain, hits)
    for m in _SPELLED.finditer(plain) if len(_DIGIT_WORDS & words) > 1 and _SPELLED_HINT.search(plain) else ():
        hits.append((m.start(), m.end(), "".join(DIGIT_WORDS[w] for w in re.split(r"[ -]", m.group().lower()))))
    if not hits:
        return plain, []
    hits.sort()
    out, shifts, at, length = [], [], 0, 0
    for a, b, new in hits:
        if a < at:
            continue
        out += [plain[at:a], new]
        length += a - at + len(new)
        shifts.append((length, b - length))
        at = b
    out.append(plain[at:])
    return "".join(out), shifts


_LOCAL_END, _LABEL = re.compile(r"[\w.+%-]+\Z"), re.compile(r"[\w-]+(?:\.[\w-]+)*")


def _addresses_only(text: str, hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of the possible disguises, those that together make local part, at, label, dot, label."""
    kept = []
    i = 0
    while i < len(hits):
        a, b, new = hits[i]
        i += 1
        if new != "@" and not (kept and kept[-1] == (a, b, new)):
            # a dot counts beside a plain @ only
            before = text[max(0, a - 80) : a]
            if new == "." and re.search(r"[\w.+%-]+@[\w-]+\Z", before) and _LABEL.match(text, b):
                kept.append((a, b, new))
            continue
        if not _LOCAL_END.search(text[max(0, a - 64) : a]):
            continue
        label = _LABEL.match(text, b)
        if not label:
            continue
        chain, dots, end = [(a, b, "@")], "." in label.group().rstrip("."), label.end()
        while i < len(hits) and hits[i][2] == "." and hits[i][0] == end:
            nxt = _LABEL.match(text, hits[i][1])
            if not nxt:
                break
            chain.append(hits[i])
            dots, end = True, nxt.end()
            i += 1
        if dots:
            kept += chain
    return kept


def _source(place: int, shifts: list[tuple[int, int]], start: bool) -> int:
    moved = 0
    for at, shift in shifts:
        if at > place or (not start and at >= place and at != place):
            break
        moved = shift
    return place + moved


def _back(a: int, b: int, shifts: list[tuple[int, int]]) -> tuple[int, int]:
    if not shifts:
        return a, b
    return _source(a, shifts, True), _source(b, shifts, False)


EMAIL = re.compile(r"(?<![\w.+%-])[\w](?:[\w.+%-]*[\w+%-])?@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,24}(?![\w@])")
# Endings of file names that look like an address with an at sign.
FILE_ENDINGS = ("png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js", "py", "md", "pdf")
_S = r"[ .\-/]"
PHONE = re.compile(
    rf"""(?<![\w+.\-/=#])(?:
      (?:\(\+\d{{1,3}}\)|\+\d{{1,3}}|00(?:1|3[0-9]|4[0-9]))[ .\-/]?(?:\(0\)[ ]?)?(?:\(\d{{2,4}}\)[ .\-]?|\d{{1,4}}{_S}?)\d{{2,8}}(?:{_S}\d{{2,8}}){{0,4}}
    | (?:1[ .\-])?\(0?\d{{2,4}}\)[ .\-/]?\d{{3,8}}(?:[ .\-]\d{{3,4}}){{0,2}}
    | (?:1[ .\-])?\d{{3}}(?P<u>[ .\-])\d{{3}}(?P=u)\d{{4}}
    | (?:1[ .\-])?\d{{3}}[ .\-]\d{{7}}
    | 0\d(?P<f>[ .\-]?)\d{{2}}(?P=f)\d{{2}}(?P=f)\d{{2}}(?P=f)\d{{2}}
    | 0\d{{2,4}}[ /\-]\d{{4,8}}(?:[ \-]\d{{3,4}}){{0,1}}
    | 0\d{{2,4}}[ /\-]\d{{3,4}}[ \-]\d{{4}}
    | 0[23]0\d{{8}}
    | [5-8]\d{{2}}(?P<s>[ .\-]?)\d{{3}}(?P=s)\d{{3}}
    )(?![\w]|[.\-/]\d)""",
    re.X,
)
IDENTITY = re.compile(
    r"""(?<![\w+.\-/=#])(?:
      [A-Z]{2}(?P<n>[ \-]?)\d{2}(?P=n)\d{2}(?P=n)\d{2}(?P=n)[A-D]
    | \d{3}(?P<u>[ \-])\d{2}(?P=u)\d{4}
    | 9\d{8}
    | \d{2}(?P<d>\.?)\d{3}(?P=d)\d{3}[ \-]?[A-Z]
    | [XYZ][ \-]?\d{7}[ \-]?[A-Z]
    | [12](?P<f>[ ]?)\d{2}(?P=f)\d{2}(?P=f)\d{2}(?P=f)\d{3}(?P=f)\d{3}(?P=f)\d{2}
    | \d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}
    | (?!0[23]0)\d{11}
    )(?![\w]|[.\-/]\d)""",
    re.X,
)
_PHONE_LABEL = re.compile(r"(?:\btel|\btél|phone|mobile|fax|telefon|teléfono|téléphone)\w*[.:]*\s*\Z", re.I)
_CODE_LABEL = re.compile(r"(?:\border|\bbuild|\bpart|\bticket|\bcatalogue|\binvoice|\bisbn|\bversion|\bretry)\b[\w. ]{0,12}[.:#=]*\s*\Z", re.I)

_CAP = r"[^\W\d_a-zà-öø-ÿ][\w’'-]*"
_TOWN = rf"{_CAP}(?:[ -]{_CAP}){{0,2}}"
# First words of towns of several words. After a postcode a town goes on only behind one of these.
TOWN_STARTS = "Bad Sankt St. Neu San Santa Saint Sainte Le La Les Los Las El New Old Alt Groß Klein Villa Puerto".split()
_AFTER_CODE = rf"(?:(?:{'|'.join(map(re.escape, TOWN_STARTS))})[ ])?{_CAP}(?:-{_CAP}){{0,3}}"
# Words for streets, by language. English and French addresses begin with their number.
EN_STREETS = "Close Terrace Lane Drive Road Street Avenue Crescent Court Square Grove Row Walk Place Way Gardens Hill Mews St Rd Ave Ln Dr".split()
DE_STREETS = "straße strasse str. weg gasse allee platz ring damm ufer steig pfad chaussee Straße Weg Gasse Allee Platz".split()
FR_STREETS = "rue impasse allée avenue boulevard place chemin quai route passage cours square sentier ruelle".split()
ES_STREETS = "Calle Camino Plaza Avenida Paseo Ronda Travesía Carrera Glorieta C/ Avda Avda.".split()
_any = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
_EN = re.compile(
    rf"(?<![\w.,\-])\d{{1,4}}[ ]?[a-zA-Z]?[ ]{_CAP}(?:[ ]{_CAP}){{0,2}}[ ](?:{_any(EN_STREETS)})\b\.?"
    rf"(?:,?[ \n]?[ ]?{_TOWN},?[ ](?:[A-Z]{{2}}[ ]\d{{5}}|[A-Z]{{1,3}}\d[A-Z\d]?[ ]?\d[A-Z]{{2}})\b)?"
)
_FR = re.compile(
    rf"(?<![\w.,\-])\d{{1,4}}(?:[ ](?:bis|ter|quater))?,?[ ](?:{_any(FR_STREETS)})[ ](?:(?:de[ ]la|de[ ]l['’]|du|des|de|d['’]|aux|au|à[ ]la|la|le|les)[ ]?)?"
    rf"{_CAP}(?:[ -](?:(?:de|du|des|la|le|les|aux|au)[ -])?{_CAP}){{0,3}}(?:,?[ \n]?[ ]?(?:F-)?\d{{5}}[ ]{_AFTER_CODE})?"
)
_DE_END = re.compile(rf"(?:{_any(DE_STREETS)})[ ]\d{{1,4}}[ ]?[a-z]?\b(?:,?[ \n]?[ ]?(?:D-)?\d{{5}}[ ]{_AFTER_CODE})?")
_DE_START = re.compile(rf"(?<![\w.,\-])(?:{_CAP}[ ])?[^\W\d_]*\Z")
_ES = re.compile(
    rf"(?<![\w.,\-])(?:{_any(ES_STREETS)})[ ](?:(?:de[ ]la|de[ ]los|de[ ]las|del|de|la|el|los|las)[ ])?{_CAP}(?:[ ](?:(?:de|del|la|los|las|y)[ ])*{_CAP}){{0,3}},?[ ]"
    rf"(?:n\.?[º°][ ]?|núm\.?[ ]|no\.[ ])?\d{{1,4}}(?:[ ]?(?:bis|[a-zA-Z]))?\b(?:,?[ \n]?[ ]?\d{{5}}[ ]{_AFTER_CODE})?"
)
_EN_WORDS, _FR_WORDS = frozenset(w.lower() for w in EN_STREETS), frozenset(FR_STREETS)
_ES_WORDS = frozenset({w.lower().strip("./") for w in ES_STREETS})
_DE_WORDS = tuple({w.lower().rstrip(".") for w in DE_STREETS})


def street_spans(plain: str, words: set[str]) -> Iterator[tuple[int, int]]:
    """Places of street addresses; each language is looked for only where one of its street words occurs."""
    for known, pattern in ((_EN_WORDS, _EN), (_FR_WORDS, _FR), (_ES_WORDS, _ES)):
        if not known.isdisjoint(words):
            for m in pattern.finditer(plain):
                span = m.group().rstrip(" ,\n")
                if not re.search(r"\b(?:St|Rd|Ave|Ln|Dr)\.$", span):
                    span = span.rstrip(".")
                yield m.start(), m.start() + len(span)
    if any(w.endswith(_DE_WORDS) for w in words):
        for m in _DE_END.finditer(plain):
            head = _DE_START.search(plain[max(0, m.start() - 60) : m.start()])
            if head and plain[start := m.start() - len(head.group())].isupper():
                first = head.group().partition(" ")[0]
                own = m.group()[0].isupper()  # "Alte Gasse 3" takes the word before, "Mühlgasse 3" doesn't
                if " " in head.group() and not own or first.lower() in NOT_STREET:
                    start += len(first) + 1
                if plain[start].isupper():
                    yield start, m.end()


NOT_STREET = frozenset("der die das dem den im am in an zur zum".split())
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
# Particles of family names, and words that stand capitalised before a family name without being a given name.
PARTICLES = "von van de der den del della di da du la le los las zu zur zum af y ten ter dos d".split()
NOT_GIVEN = set(
    "mr mrs ms miss dr prof professor sir herr frau fräulein monsieur madame mademoiselle mme mlle señor señora sr sra don doña "
    "ask call called contact thanks dear hello hi to from cc via by for and with we met lists list author maintainer subject tel row that where when "
    "kontakt rückfragen hallo liebe lieber bei mit und von an merci contacto gracias escribe querido querida hola à para por con y "
    "cher chère bonjour et avec chez selon according the der die das le la el los las".split()
)
_PART = rf"(?:(?:{'|'.join(PARTICLES)})[ ]|d['’])"
_GIVEN_LEFT = re.compile(rf"(?<![\w@.+\-])(?P<g>[^\W\d_]\.(?:[ ]?-?[^\W\d_]\.)?|[^\W\d_]+(?:-[^\W\d_]+)*)(?P<m>[ \n][^\W\d_]\.)?[ \n]{_PART}{{0,3}}\Z", re.I)
_GIVEN_AFTER_COMMA = re.compile(rf",[ \n](?P<g>[^\W\d_]\.|[^\W\d_]+(?:-[^\W\d_]+)*)(?![\w@]|[._+\-]\w)")
_GIVEN_RIGHT = re.compile(r"[ \n](?P<g>[^\W\d_]\.|[^\W\d_]+(?:-[^\W\d_]+)*)(?![\w@])")
_PART_LEFT = re.compile(rf"(?<![\w@.+\-]){_PART}{{1,3}}\Z", re.I)


def fold(word: str) -> str:
    """A name without case and accents, so that its capitals and its plain spelling meet."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c)) if not word.isascii() else word.lower()


_FAMILY_RIGHT = re.compile(rf"[ ](?:[^\W\d_]\.[ ])?{_PART}{{0,3}}({WORD.pattern})(?![\w@])", re.I)
_FAMILY_LEFT = re.compile(rf"(?<![\w@.+\-])({WORD.pattern})(,?)[ ]\Z")


def _family_evidence(text: str, givens: frozenset[str], places: list[str]) -> set[str]:
    """Words that stand beside a listed given name in a form that only names have."""
    out: set[str] = set()
    for m in _places(text, places):
        g = m.group()
        if fold(g) not in givens or g.islower():
            continue
        right = _FAMILY_RIGHT.match(text, m.end())
        if right and right[1][0].isupper() and fold(right[1]) not in NOT_GIVEN:
            out.add(fold(right[1]))
            continue
        left = _FAMILY_LEFT.search(text[max(0, m.start() - 40) : m.start()])
        if left and (left[1].isupper() and len(left[1]) > 3 or left[2] and left[1][0].isupper()):
            after = text[m.end() : m.end() + 2]
            if not (after[:1] == " " and after[1:2].isupper() and left[2]):  # "Thane, Ivo Kolb": a list of names
                out.add(fold(left[1]))
    return {w for w in out if len(w) > 2 and w not in givens and w not in NOT_GIVEN}


_SIMPLE = re.compile(r"[^\W\d_]+")


def simple_words(text: str) -> set[str]:
    """The lower-cased runs of letters of a text."""
    return set(_SIMPLE.findall(text.lower()))


def _heads(words: frozenset[str]) -> frozenset[str]:
    """What a text must hold to hold one of the words: their first runs of letters."""
    return frozenset(_SIMPLE.findall(w)[0] for w in words if _SIMPLE.search(w))


def _present(words: set[str], wanted: frozenset[str]) -> list[str]:
    """Those of a text's words (as spelled, lower case) whose folded form is wanted."""
    return [w for w in words if (w if w.isascii() else fold(w)) in wanted]


def _places(text: str, words: list[str]) -> Iterator[re.Match]:
    """Each name-like word of the text that begins with one of `words`, in order."""
    found = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(map(re.escape, sorted(words, key=len, reverse=True)))})(?![^\W\d_])", re.I)
    for m in found.finditer(text):
        if whole := WORD.match(text, m.start()):
            yield whole


def _learn(batches: Iterator[pa.RecordBatch], givens: frozenset[str]) -> Iterator[pa.RecordBatch]:
    heads = _heads(givens)
    for batch in batches:
        found: set[str] = set()
        for text in batch.column(0).to_pylist():
            if text and (places := _present(simple_words(text), heads)):
                found |= _family_evidence(text, givens, places)
        words = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([_SIMPLE.search(w)[0] for w in words], pa.string()), pa.array(words, pa.string())], names=["head", "word"])


def _name_at(text: str, m: re.Match, givens: frozenset[str]) -> tuple[int, int] | None:
    """The span of the name whose family part is `m`, or none."""
    a, b = m.span()
    cased = not m.group().islower()
    before, start = text[max(0, a - 60) : a], max(0, a - 60)
    left = _GIVEN_LEFT.search(before)
    part = _PART_LEFT.search(before)
    family = start + part.start() if part else a
    comma, right = _GIVEN_AFTER_COMMA.match(text, b), _GIVEN_RIGHT.match(text, b)
    listed = lambda g: bool(g) and fold(g["g"]) in givens
    if left and listed(left):
        return start + left.start(), b
    if comma and listed(comma):
        return family, comma.end()
    if right and listed(right) and m.group().isupper():
        return family, right.end()
    if left:
        g = left["g"]
        if g.endswith(".") and g[0].isupper():
            return start + left.start(), b
        ordinary = not g.endswith(".") and (fold(g) in NOT_GIVEN or fold(g) in PARTICLES or (g.islower() and cased))
        if left["m"] and ordinary and left["m"][1].isupper():  # "Ask R. Haldumber": the middle initial is the only one
            return start + left.start("m") + 1, b
        if not g.endswith(".") and fold(g) not in NOT_GIVEN and len(g) > 1 and fold(g) not in PARTICLES:
            if g[0].isupper() and cased:
                return start + left.start(), b
            if not cased and g.islower() and len(g) > 2:  # a learned family name is no ordinary word
                return start + left.start(), b
    if comma and cased and comma["g"][0].isupper() and fold(comma["g"]) not in NOT_GIVEN and (comma["g"].endswith(".") or len(comma["g"]) > 3 or text[comma.end() : comma.end() + 1] != "."):
        return family, comma.end()
    if right and m.group().isupper() and right["g"][0].isupper() and not right["g"].isupper() and fold(right["g"]) not in NOT_GIVEN:
        return family, right.end()
    return None


_DIGITS = re.compile(r"\d[\d .\-/()]{4,}\d")


def find_spans(text: str, givens: frozenset[str], families: frozenset[str], heads: frozenset[str]) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the source, ascending and apart from one another. heads: _heads(families)."""
    words = simple_words(text)
    plain, shifts = normalise(text, words)
    taken: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in taken)

    if "@" in plain:
        for m in EMAIL.finditer(plain):
            if m.group().rsplit(".", 1)[1].lower() not in FILE_ENDINGS:
                taken.append((*m.span(), "email"))
    if _DIGITS.search(plain):
        for m in IDENTITY.finditer(plain):
            before = plain[max(0, m.start() - 24) : m.start()]
            if free(*m.span()) and not _CODE_LABEL.search(before):
                kind = "phone" if m.group().isdigit() and len(m.group()) in (9, 11) and _PHONE_LABEL.search(before) else "identity"
                taken.append((*m.span(), kind))
        for m in PHONE.finditer(plain):
            digits = sum(c.isdigit() for c in m.group())
            if 9 <= digits <= 15 and free(*m.span()) and not _CODE_LABEL.search(plain[max(0, m.start() - 24) : m.start()]):
                taken.append((*m.span(), "phone"))
    for a, b in street_spans(plain, words):
        if free(a, b):
            taken.append((a, b, "address"))
    if places := _present(words, heads):
        for m in _places(plain, places):
            if fold(m.group()) in families and (span := _name_at(plain, m, givens)) and free(*span):
                taken.append((*span, "name"))
    return sorted((*_back(a, b, shifts), kind) for a, b, kind in taken)


def _detect(batches: Iterator[pa.RecordBatch], givens: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Spans of (doc_id, text, the learned family names that it may hold)."""
    for batch in batches:
        ids, starts, ends, kinds, spans = [], [], [], [], []
        for doc, text, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
            families = frozenset(own or ())
            for a, b, kind in find_spans(text, givens, families, _heads(families)):
                ids.append(doc)
                starts.append(a)
                ends.append(b)
                kinds.append(kind)
                spans.append(text[a:b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "start", "end", "kind", "span"],
        )


def learned_families(documents: DataFrame, givens: frozenset[str]) -> DataFrame:
    """(head, word): the family names that the corpus shows beside listed given names, and their first run of letters."""
    return documents.select("text").where("text is not null").mapInArrow(partial(_learn, givens=givens), "head string, word string").distinct()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, ids): each folded word of a batch with the documents that hold it."""
    for batch in batches:
        holders: dict[str, list[int]] = {}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w in {w if w.isascii() else fold(w) for w in simple_words(text)}:
                holders.setdefault(w, []).append(doc)
        yield pa.RecordBatch.from_arrays([pa.array(list(holders), pa.string()), pa.array(list(holders.values()), pa.list_(pa.int64()))], names=["head", "ids"])


def with_families(texts: DataFrame, givens: frozenset[str]) -> DataFrame:
    """(doc_id, text, families): each text with the learned family names whose first run of letters is one of its words."""
    lexicon = checkpoint(learned_families(texts, givens))
    held = texts.select("doc_id", "text").mapInArrow(_words, "head string, ids array<long>").join(lexicon, "head")
    held = held.select(F.explode("ids").alias("doc_id"), "word").groupBy("doc_id").agg(F.collect_set("word").alias("families"))
    return texts.join(held, "doc_id", "left").select("doc_id", "text", "families")


def _givens(given_names: DataFrame) -> frozenset[str]:
    names = given_names.where("given_name is not null").select("given_name").distinct().collect()  # a fixed table
    return frozenset(fold(r.given_name.strip()) for r in names)


def personal_spans(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, span), start and end in characters of the source text."""
    givens = _givens(given_names)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return with_families(texts, givens).mapInArrow(partial(_detect, givens=givens), "doc_id long, start int, end int, kind string, span string")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct piece of personal information of each document."""
    spans = personal_spans(table(spark, folder, "documents"), table(spark, folder, "given_names"))
    return spans.select("doc_id", "kind", "span").distinct()


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with [KIND] in the place of each span; of two that overlap the later one is masked."""
    last = len(text)
    for start, end, kind in sorted(spans, reverse=True):
        if end <= last:
            text = f"{text[:start]}[{kind.upper()}]{text[end:]}"
            last = start
    return text


def _masked(batches: Iterator[pa.RecordBatch], givens: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            families = frozenset(own or ())
            out.append(mask(text, find_spans(text, givens, families, _heads(families))) if text else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def masked_texts(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, text): each whole text with its personal information replaced by [EMAIL], [PHONE], ..."""
    givens = _givens(given_names)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    known = with_families(texts.where("text is not null"), givens).unionByName(texts.where("text is null").withColumn("families", F.lit(None).cast("array<string>")))
    return known.mapInArrow(partial(_masked, givens=givens), "doc_id long, text string")


def p8_masked(spark: SparkSession, folder: str) -> DataFrame:
    return masked_texts(table(spark, folder, "documents"), table(spark, folder, "given_names"))


QUERIES = {"p8_found": p8_found, "p8_masked": p8_masked}
SQL: dict[str, str] = {}
