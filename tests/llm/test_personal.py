import pytest

from placeloom.llm import personal as P

NAMES = [("en", "given", f"{a}{b}") for a in ("Bre", "Dor", "Fen") for b in ("min", "lisk", "nulph") if (a, b) != ("Fen", "nulph")]
NAMES += [("en", "family", f"{a}{b}") for a in ("Ash", "Bram", "Corv") for b in ("asby", "etern", "urgh") if (a, b) != ("Corv", "urgh")]
NAMES += [("ru", "given", f"{a}{b}") for a in ("Вел", "Луч") for b in ("бор", "уша")] + [("ru", "family", f"{a}{b}") for a in ("Гнезд", "Дымк") for b in ("унов", "истов")]
NAMES += [("zh", "family", f) for f in "仉璩闞"] + [("zh", "given", a + b) for a in "岑昀棣" for b in "嵐汀舟" if a + b != "棣舟"] + [(None, None, None), ("en", "given", "")]


@pytest.fixture(scope="module")
def book():
    return P.NameBook(NAMES)


def found(text, book):
    return [(text[a:b], k) for a, b, k in P.detect(text, book)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to a.b+c@mail.x.test, soon", [("a.b+c@mail.x.test", "email")]),
        ("<a_b[at]x-post[dot]example> (q (at) z.invalid)", [("a_b[at]x-post[dot]example", "email"), ("q (at) z.invalid", "email")]),
        ("信 q＠z.invalid 。 m @ mail.z.test", [("q＠z.invalid", "email"), ("m @ mail.z.test", "email")]),
        ("Tickets @ 224 coins. Follow @handle for photos. https://a.example/map?id=1298320", []),
        ("Call +1-417-555-0144 after (283) 555-0147 or 446.555.0126", [("+1-417-555-0144", "phone"), ("(283) 555-0147", "phone"), ("446.555.0126", "phone")]),
        ("Звоните 8 (450) 019-4853, +7 (493) 050-01-90", [("8 (450) 019-4853", "phone"), ("+7 (493) 050-01-90", "phone")]),
        ("打 ００８６－１００－６９７１－３１３８，", [("００８６－１００－６９７１－３１３８", "phone")]),
        ("電話：10081112536。", [("10081112536", "phone")]),
        ("ring five five five zero one two three four five six now", [("five five five zero one two three four five six", "phone")]),
        ("Barcode 17182351718235, item 1361558-327, 231 984 people, 12.03.1938, 1683-03-18, 54.3842, 127.1349, v 3.294.294", []),
        ("Passenger document 982134179, checked. 917-51-0155 is written in the guest book", [("982134179", "id_number"), ("917-51-0155", "id_number")]),
        ("записан паспорт 57 02 637214. Личный номер 588-781-012 26 указан", [("57 02 637214", "id_number"), ("588-781-012 26", "id_number")]),
        ("паспорт 3319 № 152860", [("3319 № 152860", "id_number")]),
        ("Oda 978 370 838 91 kimlik numarasıyla, kimlik no 95000865661", [("978 370 838 91", "id_number"), ("95000865661", "id_number")]),
        ("身份證號是 997564 19890826 503X 。", [("997564 19890826 503X", "id_number")]),
        ("Keys at 40A Fetuhushan Road until noon, 109 Tuzaleton Ave.", [("40A Fetuhushan Road", "address"), ("109 Tuzaleton Ave.", "address")]),
        ("House of 150 windows on Mill Street. Değirmen Sokak üzerinde 256 pencereli ev", []),
        ("Ev sahibi Şaçemüsk Cad. No: 36A adresinde", [("Şaçemüsk Cad. No: 36A", "address")]),
        ("живёт: ул. Гора, д. 4а. Техизуэ улица, 114", [("ул. Гора, д. 4а", "address"), ("Техизуэ улица, 114", "address")]),
        ("房東住在 日沙7號渡巷160號 。地址：泉大西特佩巷8A号，", [("日沙7號渡巷160號", "address"), ("泉大西特佩巷8A号", "address")]),
        ("Mr Bremin K. Ashasby rents. Contact: DORLISK BRAMURGH.", [("Bremin K. Ashasby", "person"), ("DORLISK BRAMURGH", "person")]),
        ("Signed, Corvurgh, Fennulph", [("Corvurgh, Fennulph", "person")]),
        ("Велуша Гнездунов-Дымкистов знает", [("Велуша Гнездунов-Дымкистов", "person")]),
        ("Bremin Bay was dredged. Saint Dorlisk Fair. Ashasby sells tickets", []),
        ("聯絡人：麴昀嵐。棣汀廟會1894開始。找璩岑汀，闞棣舟", [("麴昀嵐", "person"), ("璩岑汀", "person"), ("闞棣舟", "person")]),
    ],
)
def test_found(text, want, book):
    assert found(text, book) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("jоhn@example.org, j.smith [at] exаmple.org and s @ mаil.x-poѕt.test", [("jоhn@example.org", "email"), ("j.smith [at] exаmple.org", "email"), ("s @ mаil.x-poѕt.test", "email")]),
        ("請寫信到jоhn@example.org。", [("jоhn@example.org", "email")]),
        ("почта@x.test кот@пример.рф", []),
        ("john AT example DOT com or john dot smith at mail dot example dot org", [("john AT example DOT com", "email"), ("john dot smith at mail dot example dot org", "email")]),
        ("Meet at noon. Dot matrix at the station dot", []),
        ("0l23 456 7890 and 8 (45О) 019-4853", [("0l23 456 7890", "phone"), ("8 (45О) 019-4853", "phone")]),
        ("Room 12 O 34, 2O24-01-01, lO1, Oslo 1234567", []),
        ("her passport number is 512345678; call me at 555-0199", [("512345678", "id_number"), ("555-0199", "phone")]),
        ("Ask the guide: Bremin Quux knows", [("Bremin Quux", "person")]),
        ("the well\nZorblatt Ashasby\n5 Mill Road", [("Zorblatt Ashasby", "person"), ("5 Mill Road", "address")]),
        ("Bremin Quux sells bread. Zorblatt Ashasby too", []),
        ("12 Martin Luther King Boulevard", [("12 Martin Luther King Boulevard", "address")]),
        ("路" + "漢" * 60 + "路16號", [("路" + "漢" * 60 + "路16號", "address")]),
    ],
)
def test_disguises_and_general_signs(text, want, book):
    assert found(text, book) == want


def test_redaction_keeps_the_rest(book):
    text = "Ask​ Bre​min Ashasby\n(q (at) z.invalid)  🚂"
    assert P.redact(text, P.detect(text, book)) == "Ask​ [PERSON]\n([EMAIL])  🚂"


def test_tape_maps_back():
    t = P.undisguised("ａ​b (at) c")
    assert t.text == "ab@c" and t.span(0, 2) == (0, 3) and t.span(2, 3) == (3, 9)


def test_spark(spark):
    docs = spark.createDataFrame([(1, "a@b.test a@b.test"), (2, None), (3, ""), (4, "  "), (5, "x " * 200_000 + "a@b.test")], "doc_id bigint, text string").selectExpr("*", "'k' as found", "'k' as kind")
    names = spark.createDataFrame(NAMES, "lang string, name_kind string, name string")
    assert {tuple(r) for r in P.findings(docs, names).collect()} == {(1, "email", "a@b.test"), (5, "email", "a@b.test")}
    red = {r["doc_id"]: r["redacted"] for r in P.personal_information(docs, names).collect()}
    assert red[1] == "[EMAIL] [EMAIL]" and red[2] is None and red[3] == "" and red[4] == "  "
    assert P.findings(docs.limit(0), names).count() == 0
    assert P.findings(docs, names.limit(0)).count() == 2
