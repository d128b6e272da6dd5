import io
import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.kernels import archive, cfi, folding, fonts, locating, markup, package, paths, prepare, reading, units
from quireflow.kernels.errors import BookError
from tests import books

ROUND_TRIPS = [
    "epubcfi(/6/4[chap01ref]!/4[body01]/10[para05]/3:10)", "epubcfi(/6/4!/4/10/3:1[xx,y])", "epubcfi(/6/4[a^]b]!/4,/2/1:1,/3:4)", "epubcfi(/4/2/1:3[;s=b])", "epubcfi(/4/2~23.5@5.75:97.6)",
    "epubcfi(/4!:10)", "epubcfi(/2/4~0.5)", "epubcfi(/6/4,!/4/2/1:0,!/4/4/1:3)", "epubcfi(/4/2/1:3[,y])", "epubcfi(/0)", "epubcfi(/4/2[a;s=a,b])",
]
REJECTED = [
    "", "/", "epubcfi(/4", "/04", "/4:01", "/4[", "/4[]", "!/4", "/4[a,b]", "/1/2", "/4:5/2", "/4~1.50", "/4@101:2", "/4@1", "/4,/2:5,/2:3", "/4:1,/2,/4", "/4[^a]", "/4!!/2", "/4!", "/4x",
    "/4[;s b=c]", "/4[;s=a;s=b]", "/1234567890123456", "/4~1[a]", "/4[a;]", "/4,/2",
]
ORDERED = ["/2", "/4", "/4/2", "/4/2/1:0", "/4/2/1:3", "/4/2/2", "/4/2~1.5", "/4/2~1.5@2:1", "/4/2~1.5@1:2", "/4/2!/2", "/10", "/10[zz]/2"]


@pytest.mark.parametrize("text", ROUND_TRIPS)
def test_cfi_is_written_as_it_was_read(text):
    assert str(cfi.parse(text)) == text


@pytest.mark.parametrize("text", REJECTED)
def test_cfi_grammar_refuses(text):
    assert cfi.try_parse(text) is None


def test_cfi_order_and_containment():
    keys = [cfi.parse(x).keys() for x in ORDERED]
    assert keys == sorted(keys)
    r = cfi.between(cfi.parse("/4/2/1:3"), cfi.parse("/4/4/1:1"))
    assert str(r) == "epubcfi(/4,/2/1:3,/4/1:1)" and r.contains(cfi.parse("/4/2/2")) and not r.contains(cfi.parse("/4/6"))


def test_cfi_split_and_join():
    package_path, content = cfi.split(cfi.parse("epubcfi(/6/4[ref]!/4/2/1:3)"))
    assert cfi.expression(cfi.Cfi(package_path)) == "/6/4[ref]" and cfi.expression(content) == "/4/2/1:3"
    assert str(cfi.into(package_path, content)) == "epubcfi(/6/4[ref]!/4/2/1:3)"
    assert cfi.expression(cfi.split(cfi.parse("epubcfi(/6/4,!/4/2/1:0,!/4/4/1:3)"))[1]) == "/4,/2/1:0,/4/1:3"


@pytest.mark.parametrize(
    ("query", "text", "found"),
    [("aa", "aaaa", [(0, 2), (2, 4)]), ("CAFÉ", "a café", [(2, 6)]), ("cafe", "cafe\u0301s", [(0, 5)]), ("か", "が", []), ("LODZ", "łódź", [(0, 4)]), ("a b", "a \n\u00a0b", [(0, 5)]), ("σας", "ΣΑΣ", [(0, 3)]), ("ss", "ß", []), ("", "x", []), ("ab", "a\u00adb", [(0, 3)])],
)
def test_folded_matches(query, text, found):
    assert list(folding.matches(query, text)) == found


def test_whole_words_and_astral_offsets():
    assert list(folding.matches("cat", "cat_ scatter cat", whole_word=True)) == [(0, 3), (13, 16)]
    assert list(folding.matches("x", units.to_units("😀x"))) == [(2, 3)]
    assert units.from_units(units.to_units("a😀b")) == "a😀b" and units.length16("a😀b") == 4


@settings(deadline=None)
@given(st.text(alphabet=st.sampled_from("\ud83daBé É\u0301 \n\t\u00ad\u200bßİςΣ😀漢\u3000Łx"), max_size=30), st.booleans(), st.booleans())
def test_both_ways_of_folding_agree(text, case, diacritics):
    rule = folding.Sensitivity(case, diacritics)
    a, b = folding.fold(units.to_units(text), rule), folding._by_spans(units.to_units(text), rule)
    assert (a.text, list(a.starts), list(a.ends)) == (b.text, list(b.starts), list(b.ends))


@given(st.text(max_size=40))
def test_units_round_trip(text):
    clean = text.encode("utf-16", "ignore").decode("utf-16")
    assert units.from_units(units.to_units(clean)) == clean and len(units.to_units(clean)) == units.length16(clean)


def test_paths():
    assert paths.archive_path("a//./b/../c%20") == "a/c%20"
    assert paths.resource_path("../x%20y?q#f", "a/b") == "x y"
    for bad in ("", "/a", "a\\b", "../a", "C:/x", "a\x01"):
        with pytest.raises(BookError):
            paths.archive_path(bad)
    for bad in ("x%2fy", "http://x/y", "%zz", "..", "%C3"):
        with pytest.raises(BookError):
            paths.resource_path(bad)
    notes = []
    assert paths.against("../../x", "a/b", notes) == "x" and notes[0][0] == "url-leaks-container"
    with pytest.raises(BookError):
        paths.against("//host/x", "a")


DOCUMENT = (
    '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en"><head><title> A  title </title></head><body><h1 id="h">Head&nbsp;ing</h1><p>One   two<br/>three</p><blockquote><p>Quoted</p>tail</blockquote>'
    "<ul><li>item<ul><li>nested</li></ul></li></ul><p><ruby>漢<rt>kan</rt></ruby> x</p><pre>\n a\n  b\n</pre><p hidden=''>no</p><div role='heading' aria-level='3' xml:lang='fr'>H3<![CDATA[ & c]]></div><a id='anchor'/><p>😀 end</p></body></html>"
)


def test_reading_text():
    d = reading.parse(DOCUMENT, "application/xhtml+xml")
    assert units.from_units(d.text) == "Head\xa0ing\nOne two\nthree\nQuoted\ntail\nitem\nnested\n漢 x\n a\n  b\nH3 & c\n😀 end"
    assert [(b.kind, b.heading_level, b.list_depth, b.quote_depth, b.language) for b in d.blocks][:6] == [("heading", 1, 0, 0, "en"), ("paragraph", None, 0, 0, "en"), ("paragraph", None, 0, 1, "en"), ("paragraph", None, 0, 1, "en"), ("listItem", None, 1, 0, "en"), ("listItem", None, 2, 0, "en")]
    assert d.title == "A title" and d.offset_of_id("anchor") == 65 and d.block_at(8).start == 9


def test_every_offset_comes_back():
    d = reading.parse(DOCUMENT, "application/xhtml+xml")
    for o in range(len(d.text) + 1):
        for before in (False, True):
            start, end, match = d.resolve(d.cfi_at(o, before))
            assert match == "exact" and (start == o or d.text[min(start, o) : max(start, o)].strip() == "")


def test_assertions_correct_a_path():
    d = reading.parse(DOCUMENT, "application/xhtml+xml")
    assert d.resolve(cfi.parse("/4/98[h]/1:2")) == (2, 2, "corrected")
    assert d.resolve(cfi.parse("/4/2/1:1[,ing]")) == (5, 5, "corrected")
    assert d.resolve(cfi.parse("/4/4/1:500"))[2] == "approximate"
    assert d.resolve(cfi.parse("/4/2/1:1[zz]")) is None and d.resolve(cfi.parse("/4/98")) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<br/>", "<i>x</i>", " ", "\n", "text ", "é", "😀", "<div id='q'>", "</div>", "<pre>", "</pre>", "<li>", "<table><td>"]), max_size=25))
def test_html_offsets_come_back(parts):
    d = reading.parse("".join(parts), "text/html")
    for o in range(len(d.text) + 1):
        start, _, match = d.resolve(d.cfi_at(o))
        assert match == "exact" and (start == o or d.text[min(start, o) : max(start, o)].strip() == "")


def test_html_structure_is_implied():
    d = reading.parse("<p>a<p>b<table><tr><td>c</table>", "text/html")
    assert str(d.cfi_at(4)) == "epubcfi(/4/6/2/2/2/1:0)"
    d = reading.parse("<p><b>bold<p>still", "text/html")
    assert str(d.cfi_at(5)) == "epubcfi(/4/4/2/1:0)"


def test_decoding():
    assert reading.read('<?xml version="1.0" encoding="UTF-16"?><svg xmlns="http://www.w3.org/2000/svg"><text>é</text></svg>'.encode("utf-16"), "image/svg+xml").text == "é"
    assert reading.read(b'<meta charset="latin1"><p>\x93x\x94', "text/html").text == "“x”"
    for bad, kind in ((b"<p>\xff", "text/html"), (b'<!DOCTYPE a [<!ENTITY b "c">]><a/>', "application/xhtml+xml"), (b"<a>", "application/xhtml+xml"), (b"x", "text/plain")):
        with pytest.raises(BookError):
            reading.read(bad, kind)
    with pytest.raises(BookError):
        reading.parse("<a>" * 200 + "</a>" * 200, "application/xhtml+xml")


def test_the_ladder():
    d = reading.parse("<p>one whale</p><p id='f'>two whales here</p>", "text/html")
    ask = lambda **k: (lambda f: (f.match, f.start))(locating.resolve(d, locating.Stored(**k), k.pop("none", None)))
    assert ask(partial_cfi="/4/4/1:4", highlight="whales") == ("cfi", 14)
    assert ask(partial_cfi="/4/4/1:0", highlight="whale") == ("text", 14)
    assert ask(partial_cfi="/4/4/1:0", highlight="shark") == ("cfi", 10)
    assert ask(highlight="whale", progression=0.1) == ("text", 4)
    assert ask(fragments=["f"]) == ("fragment", 10) and ask(progression=0.5) == ("progression", 13) and ask() == ("start", 0)


def test_archives():
    data = books.simple()
    a = archive.Archive.of_bytes(data)
    assert a.read("OEBPS/two.xhtml", 0, 5) == b"<html" and a.read("mimetype", 12, 20) == b"epub+zip"
    with pytest.raises(BookError):
        a.read("OEBPS/two.xhtml", 5, 10**6)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"x" * 1000, zipfile.ZIP_STORED)
        z.writestr("b/c", b"y" * 5000, zipfile.ZIP_DEFLATED)
    raw = out.getvalue()
    assert archive.Archive.of_bytes(raw).read("b/c") == b"y" * 5000
    at = raw.rfind(b"PK\x01\x02", 0, raw.rfind(b"PK\x01\x02"))
    forged = [
        raw[:40] + b"Z" + raw[41:], raw[:-30], raw + b"tail", raw[: at + 8] + struct.pack("<H", 1) + raw[at + 10 :], raw[: at + 16] + b"\0\0\0\0" + raw[at + 20 :], raw[: at + 20] + struct.pack("<L", 999) + raw[at + 24 :],
        raw[: at + 42] + struct.pack("<L", 7) + raw[at + 46 :], raw[: at + 46] + b"/" + raw[at + 47 :], b"", b"PK\x05\x06",
    ]
    for bad in forged:
        with pytest.raises(BookError):
            archive.Archive.of_bytes(bad).read("a")
    with pytest.raises(BookError):
        archive.Archive.of_bytes(raw, archive.Limits(entries=1))


def test_descriptors():
    class Pipe(io.BytesIO):
        def seekable(self):
            return False

        def seek(self, *_):
            raise io.UnsupportedOperation

    out = Pipe()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"hello" * 50)
    assert archive.Archive.of_bytes(out.getvalue()).read("a") == b"hello" * 50


def parse(name):
    return package.parse(archive.Archive.of_bytes(books.BOOKS[name]))


def test_packages():
    b = parse("simple")
    assert [s["cfi_path"] for s in b.spine] == ["/6/2[ref-1]", "/6/4", "/6/6"] and [s["linear"] for s in b.spine] == [True, True, False]
    assert [(n["title"], n["depth"], n["parent"], n["href"]) for n in b.nav] == [("One", 1, None, "OEBPS/ch%201.xhtml"), ("Deep", 2, 0, "OEBPS/ch%201.xhtml#deep"), ("Two", 1, None, "OEBPS/two.xhtml")]
    r = parse("rich")
    m = r.metadata
    assert (m["title"], m["subtitle"], m["identifier"], r.identifier, m["reading_progression"]) == ("Main Title", "Sub", "key 1", " key 1 ", "rtl")
    assert [a["name"] for a in m["authors"]] == ["Ann"] and m["contributors"][0]["roles"] == ["edt"] and m["duration_us"] == 90_500_000
    assert m["accessibility"] == {"accessMode": ["textual", "visual"]} and m["belongs_to"] == [{"name": "Sea", "type": None, "position": 2.5}]
    assert "metadata-invalid-modified" in [w[0] for w in r.warnings] and r.spine[0]["properties"]["layout"] == "fixed" and r.spine[0]["properties"]["page"] == "left"
    n = parse("ncx")
    assert [(x["kind"], x["title"]) for x in n.nav] == [("toc", "Old way"), ("page-list", "1"), ("landmarks", "Start")]
    assert [w[0] for w in parse("clamped").warnings] == ["url-leaks-container", "url-path-absolute"]


@pytest.mark.parametrize(("name", "kind"), [("wrong_mimetype", "package"), ("entity_attack", "security"), ("broken_spine", "package"), ("duplicate_id", "package"), ("cycle", "package"), ("not_linear", "package")])
def test_fatal_packages(name, kind):
    with pytest.raises(BookError) as error:
        parse(name)
    assert error.value.kind == kind


def test_fallbacks():
    r = parse("rich")
    by_href = {i["href"]: i for i in r.manifest}
    shown = lambda i: i["media_type"] == "application/xhtml+xml"
    assert package.fallback("OEBPS/p.psd", by_href, set(), shown) == "OEBPS/ch%201.xhtml"
    assert package.fallback("OEBPS/p.psd", by_href, {"OEBPS/ch%201.xhtml"}, shown) is None


def test_fonts():
    for start, end in ((0, 1300), (1000, 1100), (1039, 1041), (1200, 1300)):
        hidden = bytes(b ^ books.IDPF_KEY[i % 20] if i < 1040 else b for i, b in enumerate(books.FONT))
        assert fonts.reveal(hidden[start:end], "http://www.idpf.org/2008/embedding", " " + books.IDENTIFIER, start) == books.FONT[start:end]
    with pytest.raises(BookError):
        fonts.key_of("http://ns.adobe.com/pdf/enc#RC", "isbn 1")


@pytest.mark.parametrize(("text", "us"), [("1:02:03.5", 3_723_500_000), ("2:30", 150_000_000), ("90min", 5_400_000_000), ("1.5h", 5_400_000_000), ("250ms", 250_000), ("7", 7_000_000), ("1:61", None), ("banana", None), ("1:2:3:4", None), ("", None)])
def test_clock(text, us):
    assert package.clock(text) == us


def test_prepared_documents():
    source = "<html><head><title>t</title></head><body onload='x()'><script id='s'>bad()</script><p id='p'>a <a href='javascript:x' title='k'>b</a></p><img src='../../x.png'><iframe src='y'></iframe></body></html>"
    shown = prepare.prepare(source.encode(), "text/html", "OEBPS/a.html")
    for gone in ("bad()", "javascript:", "onload", "<iframe", "<script"):
        assert gone not in shown
    assert 'id="s"' in shown and 'src="../x.png"' in shown and "viewport" in shown
    a, b = reading.parse(source, "text/html"), reading.parse(shown, "text/html")
    assert a.text == b.text and [str(a.cfi_at(o)) for o in range(len(a.text))] == [str(b.cfi_at(o)) for o in range(len(b.text))]
    x = prepare.prepare(DOCUMENT.encode(), "application/xhtml+xml", "a.xhtml")
    c, d = reading.parse(DOCUMENT, "application/xhtml+xml"), reading.parse(x, "application/xhtml+xml")
    assert c.text == d.text and [str(c.cfi_at(o)) for o in range(len(c.text))] == [str(d.cfi_at(o)) for o in range(len(d.text))]
    with pytest.raises(ValueError):
        prepare.Settings(font_scale=9)


@pytest.mark.parametrize(
    ("source", "tree"),
    [
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"), ("<a>1<div>2<div>3</a>4</div>5</div>", "<a>1</a><div><a>2</a><div><a>3</a>4</div>5</div>"), ("<b><i>x</b>y</i>", "<b><i>x</i></b><i>y</i>"),
        ("<b>1<i>2<p>3</b>4", "<b>1<i>2</i></b><i><p><b>3</b>4</p></i>"), ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<table><b><tr><td>aaa</td></tr>bbb</table>ccc", "<b></b><b>bbb</b><table><tbody><tr><td>aaa</td></tr></tbody></table><b>ccc</b>"), ("<font><p>hello<b>cruel</font>world", "<font></font><p><font>hello<b>cruel</b></font><b>world</b></p>"),
        ("<b><em><foo><foo><foob><foob><foo><aside></b></em>", "<b><em><foo><foo><foob><foob><foo></foo></foob></foob></foo></foo></em></b><aside><b></b></aside>"), ("<b>x<td>y", "<b>xy</b>"), ("x</b>y</p>z", "xy<p></p>z"),
    ],
)
def test_formatting_is_adopted(source, tree):
    def show(node):
        return node if isinstance(node, str) else f"<{node.name}>{''.join(map(show, node.children))}</{node.name}>"

    assert "".join(map(show, markup.parse_html(source).children[1].children)) == tree
