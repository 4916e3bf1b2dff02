import zlib

import pytest
from pyspark.sql import functions as F

from basalt.plans.made import pdf_of
from basalt.sources import pdf

TEXTS = ["Tender 7\n\nThe bidder shall pay 1 000 €.", "", "Žluťoučký kůň (čtyři) \\ <x>\n", "漢字 😀 " * 200]


def plain_pdf(contents: list[bytes], font: bytes = b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>", trailer: bytes = b"", table: bool = True) -> bytes:
    """A page for each content stream, which may be of several, with an indirect length and one font inline."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] /Type /Pages >>", 3: b"<</Kids[%s]/Type/Pages/Parent 2 0 R>>" % b" ".join(b"%d 0 R" % (10 + 3 * k) for k in range(len(contents)))}
    for k, c in enumerate(contents):
        objects[10 + 3 * k] = b"<< /Type /Page /Resources << /Font << /F1 %s /F#32 %s >> >> /Contents [%d 0 R] >>" % (font, font, 11 + 3 * k)
        objects[11 + 3 * k] = b"<< /Length %d 0 R >> stream\r\n%s\r\nendstream" % (12 + 3 * k, c)
        objects[12 + 3 * k] = b"%d" % len(c)
    out, at = bytearray(b"%PDF-1.4\n% a comment\n"), {}
    for n, x in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj %s endobj\n" % (n, x)
    start = len(out)
    if table:
        out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, x) for n, x in at.items())
    return bytes(out) + b"trailer << /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF" % (trailer, start if table else 0)


def read(spark, files: dict) -> dict:
    df = spark.createDataFrame(list(files.items()), "path string, content binary").repartition(3)
    out = {}
    for r in pdf.pages(df).collect():
        out.setdefault(r.path, []).append((r.page_number, r.text, r.error))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_pages_of_good_and_broken_files(spark):
    whole = pdf_of(TEXTS)
    appended = whole + b"6 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 9 0 R >>\nendobj\n" + b"xref\n6 1\n%010d 00000 n \ntrailer << /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (len(whole), int(whole.split(b"startxref\n")[-1].split()[0]), len(whole) + len(b"6 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 9 0 R >>\nendobj\n"))
    packed = pdf_of(TEXTS, packed=True)
    bad = bytearray(whole)
    k = whole.index(zlib.compress(b"x")[:2], whole.index(b"7 0 obj"))
    bad[k : k + 2] = b"zz"
    files = {
        "good.pdf": whole, "packed.pdf": packed, "no xref.pdf": whole.replace(b"startxref", b"startnone"), "shifted.pdf": b"%PDF-1.7 " + whole, "packed lost.pdf": packed.replace(b"startxref", b"startnone"),
        "appended.pdf": appended, "none.pdf": pdf_of([]), "text.pdf": b"no pdf at all", "null.pdf": None, "cut.pdf": whole[: len(whole) // 3], "locked.pdf": plain_pdf([b""], trailer=b"/Encrypt << >>"), "bad stream.pdf": bytes(bad),
    }
    got = read(spark, files)
    want = [(n, t, None) for n, t in enumerate(TEXTS, 1)]
    for name in ("good.pdf", "packed.pdf", "no xref.pdf", "shifted.pdf", "packed lost.pdf"):
        assert got[name] == want, name
    assert got["appended.pdf"] == [(1, TEXTS[1], None), *want[1:]]  # the later page 1 shows what page 2 does
    for name, error in {"none.pdf": "no pages", "text.pdf": "no PDF", "null.pdf": "no PDF", "locked.pdf": "encrypted"}.items():
        assert len(got[name]) == 1 and got[name][0][:2] == (None, None) and error in got[name][0][2], name
    assert got["bad stream.pdf"][1:] == want[1:] and got["bad stream.pdf"][0][1] is None and got["bad stream.pdf"][0][2]
    assert "cut.pdf" in got


def test_operators_of_text(spark):
    shown = {
        b"BT /F1 9 Tf (Price \\(net\\): \\8020) Tj 0 -12 Td (second) Tj 40 0 Td (word) Tj ET": "Price (net): \x008020".replace("\x008020", "8020") + "\nsecond word",
        b"BT /F2 9 Tf [(Kern) -20 (ed ) -300 (wide) -250 (gap)] TJ T* (a\\\nb\\101\\n) ' ET": None,
        b"BT 1 0 0 1 50 700 Tm (one) Tj 1 0 0 1 90 700 Tm (two) Tj 1 0 0 1 50 680 Tm (three) Tj ET BT (four) Tj ET": "one two\nthree\nfour",
        b"q BI /W 1 /H 1 ID (\x01) Tj EI Q BT <48 65 6C6C6F> Tj (\x80 \x93q\x94) Tj ET": "Hello€ “q”",
        b"BT (cut sh": "",
    }
    got = read(spark, {"a.pdf": plain_pdf(list(shown)), "b.pdf": plain_pdf(list(shown), table=False)})
    assert got["a.pdf"] == got["b.pdf"]
    for (n, text, error), want in zip(got["a.pdf"], shown.values(), strict=True):
        assert error is None and (want is None or text == want), (n, text)
    assert got["a.pdf"][1][1] == "Kerned  wide gap\n\nabA\n"


def test_fonts_with_other_glyphs(spark):
    font = b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /one /A /uni20AC 200 /hyphen /odd] >> >>"
    assert read(spark, {"a.pdf": plain_pdf([b"BT /F1 9 Tf (ABCD\\310\\311) Tj ET"], font)})["a.pdf"] == [(1, "1A€D-�", None)]
    found, sizes = pdf.character_map(b"2 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 2 beginbfrange <41> <43> <0061> <8001> <8002> [<0078> <D83DDE00>] endbfrange 1 beginbfchar <20> <00660069> endbfchar")
    assert sizes == (1, 2) and found == {b"A": "a", b"B": "b", b"C": "c", b"\x80\x01": "x", b"\x80\x02": "😀", b" ": "fi"}


@pytest.mark.parametrize("filters", [["ASCIIHexDecode"], ["ASCII85Decode"], ["FlateDecode"], ["ASCIIHexDecode", "FlateDecode"], ["JBIG2Decode"]])
def test_filters(filters):
    import base64

    data = b"some text (of a page)"
    for kind in reversed(filters):
        data = {"ASCIIHexDecode": lambda x: x.hex().encode() + b">", "ASCII85Decode": lambda x: base64.a85encode(x) + b"~>", "FlateDecode": zlib.compress}.get(kind, bytes)(data)
    if filters == ["JBIG2Decode"]:
        with pytest.raises(ValueError, match="JBIG2"):
            pdf.inflate(data, filters)
    else:
        assert pdf.inflate(data, filters) == b"some text (of a page)"


def test_predictors():
    rows = [bytes([10, 20, 30, 40, 50, 60]), bytes([11, 22, 33, 44, 55, 66]), bytes([1, 2, 3, 250, 251, 252]), bytes([9, 9, 9, 9, 9, 9]), bytes([200, 100, 50, 25, 12, 6])]
    made, above = b"", bytes(6)
    for kind, row in enumerate(rows):
        line = []
        for i, x in enumerate(row):
            left, corner, up = (row[i - 3], above[i - 3], above[i]) if i >= 3 else (0, 0, above[i])
            p = left + up - corner
            near = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            line.append((x - (0, left, up, (left + up) // 2, near)[kind]) & 255)
        made += bytes([kind, *line])
        above = row
    assert pdf.unpredict(made, {"Predictor": 15, "Columns": 2, "Colors": 3}) == b"".join(rows)
    assert pdf.unpredict(b"abc", {}) == b"abc"


def test_many_pages_and_no_files(spark):
    texts = [f"page {k}\nof many" for k in range(3000)]
    got = read(spark, {"long.pdf": pdf_of(texts, packed=True)})["long.pdf"]
    assert {n: t for n, t, _ in got} == dict(enumerate(texts, 1))
    assert pdf.pages(spark.createDataFrame([], "path string, content binary")).count() == 0
    assert pdf.pages(spark.createDataFrame([("x.pdf", bytearray(pdf_of(["x"])))], "path string, content binary").withColumn("number", F.lit(1))).first().text == "x"


def test_files_of_a_folder(spark, tmp_path):
    from basalt.sources import providers as pv

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.PDF").write_bytes(pdf_of(["first", "second"]))
    (tmp_path / "two.pdf").write_bytes(b"broken")
    (tmp_path / "three.txt").write_bytes(pdf_of(["not by its name"]))
    got = sorted((r.path.rpartition("/")[2], r.page_number, r.text, r.error is None) for r in pv.pdf_pages(spark, str(tmp_path)).collect())
    assert got == [("one.PDF", 1, "first", True), ("one.PDF", 2, "second", True), ("two.pdf", None, None, False)]
