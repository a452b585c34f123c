import pytest

from lorewell.llm import pii

GIVENS = frozenset(map(pii.fold, ("Rose", "Tomás", "Hélène", "Gesa", "Will", "Mark")))
FAMILIES = frozenset(map(pii.fold, ("Thorlinley", "Haldeño", "Ulverelet", "Lammbacher", "Querumber")))


def _spans(text):
    return [(kind, text[a:b]) for a, b, kind in pii.find_spans(text, GIVENS, FAMILIES, pii._heads(FAMILIES))]


@pytest.mark.parametrize(
    "text, found",
    [
        ("mailto:a.b+c@mail.example.com, ok", "a.b+c@mail.example.com"), ("<x@büro-w.example>.", "x@büro-w.example"), ("to jo (at) example.org now", "jo (at) example.org"),
        ("k [at] post [dot] example [dot] org.", "k [at] post [dot] example [dot] org"), ("m AT valbrune DOT example |", "m AT valbrune DOT example"), ("x＠quarn.invalid", "x＠quarn.invalid"),
        ("аnna@example.org", "аnna@example.org"), ("jo at example dot org", "jo at example dot org"),
    ],
)
def test_email(text, found):
    assert _spans(text) == [("email", found)]


@pytest.mark.parametrize("text", ["icon@2x.png", "ledgerkit@1.6.0 in", "@cached_property wraps", "meet at noon. Then", "wh@t the", "at example", "2024-03-11 14:33:07", "Order no. 4441-7414-630 was", "Part 97-547-38 fits", "Catalogue number 979-9-5052-7146-X", "retry=652415", "192.0.2.55", "2,310 rows", "Ticket QX-9877 blocks 48"])
def test_no_case(text):
    assert _spans(text) == []


@pytest.mark.parametrize(
    "number",
    ["+1 312 555 0124", "+49 30 23125815", "01-99-00-48-65", "+34 555 015 614", "(808) 555-0160", "+44 (0)20 7946-0881", "0034 555-010-097", "617 5550199", "030 23125 977", "(020) 79460358", "030/23125383", "020 7946 0923", "1 (808) 555 0134", "0199003557", "01\xa099\xa000\xa094\xa071", "(+34) 555.016.221", "+49 (0)30 23125-290", "555016709"],
)
def test_phone(number):
    assert _spans(f"Tel. {number}, ok") == [("phone", number)]


def test_spelled_digits_map_back():
    assert _spans("call zero two zero seven nine four six zero nine two three now") == [("phone", "zero two zero seven nine four six zero nine two three")]


@pytest.mark.parametrize("number", ["915-38-2859", "999 44 5749", "980171984", "QQ-40-37-27-B", "QQ 68 91 20 D", "QQ502119B", "99.697.030U", "99521767-U", "99.859.370 U", "1 77 07 00 825 641 44", "265030076571928", "08 186 880 018", "05794729521"])
def test_identity(number):
    assert _spans(f"The form lists {number} for them.") == [("identity", number)]


@pytest.mark.parametrize(
    "address",
    ["120 Harrowstone Close, Pellmoor, ZZ 00451", "49 Tiltmead Terrace\nTillbury, ZZ 00446", "133b Osterley Road, Pellmoor QX8 4QT", "93 Harrowfen Avenue", "Störcheallee 22a\n00038 Wendlach", "Haselsteig 50a", "58 impasse des Loutres, 00278 Querval", "97 bis allée des Vieux Moulins", "Calle de la Encina Gorda, 43\n00864 Valdeorzo", "Camino de la Noria Vieja, n.º 58, 00893 Peñaclara", "Plaza del Almez, 6"],
)
def test_address(address):
    assert _spans(f"we met there: {address}. And left") == [("address", address)]


@pytest.mark.parametrize(
    "text, found",
    [
        ("Thanks to Rose T. Thorlinley for", "Rose T. Thorlinley"), ("| tomás haldeño |", "tomás haldeño"), ("Contact : Ulverelet, Hélène, tél.", "Ulverelet, Hélène"), ("cc THORLINLEY Will now", "THORLINLEY Will"),
        ("Gesa S. von Lammbacher:", "Gesa S. von Lammbacher"), ("R. Haldeño\nCalle", "R. Haldeño"), ("Dr. Mark Querumber signed", "Mark Querumber"), ("Querumber, Thane moved", "Querumber, Thane"), ("Ask Sabra Querumber for", "Sabra Querumber"), ("Ask Querumber, Will for", "Querumber, Will"), ("lists it for R. Querumber. Half", "R. Querumber"),
        ("Mme T. Ulverelet habite", "T. Ulverelet"), ("we met sabra querumber at", "sabra querumber"), ("lists it for Querumber, Odell. If", "Querumber, Odell"), ("Lammbacher, Tel. 5", None), ("Herr Lammbacher kam", None),
    ],
)
def test_name(text, found):
    assert _spans(text) == ([("name", found)] if found else [])


def test_family_names_are_learned(spark):
    texts = ["Thanks to Rose Newby for it", "Ask OLDBY Will now", "Will the cat sit", "Rose\nTel. 5", "mark my words", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.word for r in pii.learned_families(df, GIVENS).collect()} == {"newby", "oldby"}


def test_masking_keeps_the_rest(spark):
    docs = [(1, "Mail Rose Newby <r@x.example>, (at) home.", "x"), (2, None, "x"), (3, "", "x"), (4, "nothing " * 20_000, "x"), (1, "Mail Rose Newby <r@x.example>, (at) home.", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, span string")
    g = spark.createDataFrame([("Rose", "en"), (None, "en")], "given_name string, lang string")
    got = {r.doc_id: r.text for r in pii.masked_texts(d, g).collect()}
    assert got[1] == "Mail [NAME] <[EMAIL]>, (at) home." and got[2] is None and got[3] == "" and got[4] == docs[3][1]
    assert pii.personal_spans(d.limit(0), g).count() == 0
    assert {r.kind for r in pii.personal_spans(d, g.limit(0)).collect()} == {"email"}


def test_each_text_gets_the_learned_names_that_it_holds(spark):
    d = spark.createDataFrame([(i, f"Rose Newby{c} met Will Oldby{c} at r{i}@x.example") for i, c in enumerate("abcdefgh")] + [(9, "sabra newbya, Élan Oldbyc-Thane"), (10, "nobody")], "doc_id long, text string")
    g = spark.createDataFrame([("Rose", "en"), ("Will", "en")], "given_name string, lang string")
    given = pii._givens(g)
    held = {r.doc_id: set(r.families or ()) for r in pii.with_families(d, given).collect()}
    assert held[0] == {"newbya", "oldbya"} and held[9] == {"newbya", "oldbyc"} and held[10] == set()
    lexicon = frozenset(r.word for r in pii.learned_families(d, given).collect())
    whole = {(r.doc_id, a, b, k) for r in d.collect() for a, b, k in pii.find_spans(r.text, given, lexicon, pii._heads(lexicon))}
    assert {(r.doc_id, r.start, r.end, r.kind) for r in pii.personal_spans(d, g).collect()} == whole and len(whole) == 25


def test_recall_per_kind(spark):
    """Every form of each kind, planted in running text, is found whole."""
    given = spark.createDataFrame([("Rose", "en"), ("Gesa", "de")], "given_name string, lang string")
    forms = {
        "email": ["a.b@mail.example.com", "jo (at) example.org", "k [at] post [dot] example [dot] org"],
        "phone": ["+1 312 555 0124", "(808) 555-0160", "030/23125383", "zero two zero seven nine four six zero nine two three"],
        "identity": ["915-38-2859", "QQ-40-37-27-B", "99521767-U"],
        "address": ["93 Harrowfen Avenue", "Haselsteig 50a", "58 impasse des Loutres, 00278 Querval", "Plaza del Almez, 6"],
        "name": ["Rose Thorlinley", "R. Thorlinley", "Thorlinley, Rose", "THORLINLEY Rose"],
    }
    planted = [(kind, form) for kind, some in forms.items() for form in some]
    d = spark.createDataFrame([(i, f"It was noted that {form}, as before. Thanks to Rose Thorlinley!") for i, (_, form) in enumerate(planted)], "doc_id long, text string")
    got = {(r.doc_id, r.kind, r.span) for r in pii.personal_spans(d, given).collect()}
    assert {(i, kind, form) for i, (kind, form) in enumerate(planted)} <= got
