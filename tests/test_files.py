import zlib

import pytest

from folioquery.errors import EncryptedDocument, ParseError
from folioquery.sources import docx, files, maker, pdf

W = '<w:p><w:pPr><w:pStyle w:val="{0}"/></w:pPr><w:r><w:rPr>{2}</w:rPr><w:t>{1}</w:t></w:r></w:p>'
TABLE = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"


def test_docx():
    styles = '<w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="Big"><w:basedOn w:val="Base"/></w:style><w:style w:styleId="Base"><w:basedOn w:val="Big"/><w:rPr><w:sz w:val="48"/></w:rPr></w:style>'
    body = W.format("Heading2", "First", "") + W.format("x", "text &amp; more", "") + TABLE + W.format("Big", "Large", "") + W.format("x", "• item", "") + W.format("x", "bold", "<w:b/>") + W.format("x", "last", "")
    b = docx.blocks(maker.docx([], styles, body))
    assert [(x["type"], x["content"], x["is_heading"], x.get("heading_level")) for x in b] == [
        ("heading", "First", True, 2), ("text", "text & more", False, 0), ("table", "a | b\nc | ", False, None), ("heading", "Large", True, 1), ("list", "• item", False, 0), ("heading", "bold", True, 6), ("text", "last", False, 0),
    ]
    assert [x["section"] for x in b] == [None, "First", "First", None, "Large", None, "bold"]
    assert docx.markdown([["a", "b"], ["c", ""]]) == "| a | b |\n| --- | --- |\n| c |  |"
    with pytest.raises(ParseError):
        docx.blocks(b"nothing")


@pytest.mark.parametrize("compress", [True, False])
def test_pdf_lines(compress):
    lines = [f"line {i} (of) \\ text é" for i in range(120)]
    b = pdf.blocks(maker.pdf(lines, compress=compress))
    assert " ".join(x["content"] for x in b).split() == " ".join(lines).split()
    assert {x["page"] for x in b} == {1, 2, 3} and b[0]["page_count"] == 3


def test_pdf_operators():
    extra = "q 2 0 0 2 0 0 cm BT /F1 12 Tf 10 100 Td [(Hel) -20 (lo) -400 (there)] TJ T* ET Q BT 3 Tr /F1 9 Tf 1 0 0 1 72 20 Tm (hidden) Tj ET BT /F1 9 Tf 0 Tr 14 TL 1 0 0 1 72 90 Tm <416263> Tj (next) ' ET"
    text = "\n".join(x["content"] for x in pdf.blocks(maker.pdf(["body"], extra=extra)))
    assert "Hello there" in text and "Abc" in text and "next" in text and "hidden" not in text
    big = next(x for x in pdf.blocks(maker.pdf([], extra=extra)) if "Hello" in x["content"])
    assert big["font_size"] == 24 and big["heading_level"] == 1


def test_pdf_damaged_table_and_errors():
    data = maker.pdf(["still here"])
    assert pdf.blocks(data.replace(b"startxref\n", b"startxref\n9"))[0]["content"] == "still here"
    with pytest.raises(EncryptedDocument):
        pdf.blocks(data.replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 1 0 R"))
    with pytest.raises(ParseError):
        pdf.blocks(b"%PD")


def test_pdf_object_streams():
    """Cross-reference stream, object stream, predictor, ToUnicode."""
    parts = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F 4 0 R>>>>/Contents 6 0 R>>", 4: b"<</Type/Font/Subtype/Type0/BaseFont/X/ToUnicode 7 0 R/DescendantFonts[<</DW 500/W[1[600 700]]>>]>>"}
    head, body = b"", b""
    for k, v in parts.items():
        head += b"%d %d " % (k, len(body))
        body += v + b" "
    out, at = bytearray(b"%PDF-1.5\n"), {}

    def put(num, info, raw):
        at[num] = len(out)
        z = zlib.compress(raw)
        out.extend(b"%d 0 obj\n<<%s/Filter/FlateDecode/Length %d>>stream\n%s\nendstream\nendobj\n" % (num, info, len(z), z))

    put(5, b"/Type/ObjStm/N 4/First %d" % len(head), head + body)
    put(6, b"", b"BT /F 20 Tf 1 0 0 1 50 700 Tm <00010002> Tj ET")
    put(7, b"", b"1 beginbfrange <0001> <0002> <0048> endbfrange 1 beginbfchar <0003> <00660069> endbfchar")
    here = len(out)
    rows = [(0, 0, 0)] + [(2, 5, k) for k in range(4)] + [(1, at[k], 0) for k in (5, 6, 7)] + [(1, here, 0)]
    flat = [b"".join(x.to_bytes(n, "big") for x, n in zip(r, (1, 3, 1))) for r in rows]
    up, prev = b"", bytes(5)
    for r in flat:
        up += b"\x02" + bytes((a - b) & 255 for a, b in zip(r, prev))
        prev = r
    put(8, b"/Type/XRef/Size 9/W[1 3 1]/Root 1 0 R/DecodeParms<</Predictor 12/Columns 5>>", up)
    out += b"startxref\n%d\n%%%%EOF" % here
    b = pdf.blocks(bytes(out))
    assert [(x["content"], x["heading_level"]) for x in b] == [("HI", 2)]


def test_filters():
    assert pdf.ascii_hex(b"48 65 6C6c 6F>") == b"Hello" and pdf.ascii_hex(b"4>") == b"@"
    assert pdf.ascii85(b"<~87cURDZ~>") == b"Hello"
    assert pdf.run_length(bytes([2, 65, 66, 67, 254, 88, 128, 9])) == b"ABCXXX"
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert pdf.predicted(bytes([1, 2, 3, 4]), {"Predictor": 2, "Columns": 4}) == bytes([1, 3, 6, 10])
    assert pdf.predicted(bytes([0, 1, 2, 1, 5, 5, 2, 1, 1, 3, 2, 2, 4, 1, 1]), {"Predictor": 15, "Columns": 2}) == bytes([1, 2, 5, 10, 6, 11, 5, 10, 6, 11])


def test_rows(spark, rows):
    f = spark.createDataFrame([("a/x.pdf", bytearray(maker.pdf(["one line"]))), ("b/y.docx", bytearray(maker.docx(["two"]))), ("z.txt", bytearray(b"x")), ("w.pdf", bytearray(b"bad")), ("e.docx", bytearray(maker.docx([])))], "path string, content binary")
    got = {r[0]: r[1:] for r in rows(files.parsed(f), "path", "content", "error")}
    assert got["a/x.pdf"] == ("one line", None) and got["b/y.docx"] == ("two", None)
    assert got["z.txt"][1] == "unsupported format" and got["w.pdf"][1] and got["e.docx"] == (None, None)
    assert rows(files.documents(f).filter("format = 'pdf'"), "name", "source") == [("w.pdf", "pdf"), ("x.pdf", "pdf")]


def test_round_trip(spark, rows):
    texts = [(2, "First line\n\nsecond <tag> & more"), (3, "plain (text)\nAB"), (4, "\x00\x07odd퟿")]
    f = maker.made(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {}
    for path, _, content in rows(files.parsed(f), "path", "sequence", "content"):
        got.setdefault(path, []).append(content)
    assert got["doc_2.docx"] == ["First line", "second <tag> & more"] and got["doc_3.pdf"] == ["plain (text)", "AB"]


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pdf").write_bytes(maker.pdf(["x y"]))
    (tmp_path / "b.txt").write_text("no")
    assert [r["content"] for r in files.parsed(files.files(spark, str(tmp_path))).collect()] == ["x y"]


def test_images(spark, rows):
    import struct

    from folioquery.sources import images

    pdf_data = maker.pdf(["x"]).replace(b"/Font<</F1 3 0 R>>", b"/Font<</F1 3 0 R>>/XObject<</A 90 0 R/B 91 0 R/C 92 0 R>>")
    raw = bytes([255, 0, 0, 0, 255, 0])
    extra = b"90 0 obj\n<</Subtype/Image/Width 2/Height 1/BitsPerComponent 8/ColorSpace/DeviceRGB/Length 6>>stream\n" + raw + b"\nendstream\nendobj\n"
    extra += b"91 0 obj\n<</Subtype/Image/Width 9/Height 1/Filter/DCTDecode/Length 4>>stream\nJPEG\nendstream\nendobj\n"
    extra += b"92 0 obj\n<</Subtype/Image/Width 8/Height 1/BitsPerComponent 1/ColorSpace/DeviceGray/Length 1>>stream\n\xa0\nendstream\nendobj\n"
    data = extra.join([pdf_data[:9], pdf_data[9:]]).replace(b"startxref\n", b"startxref\n9")
    a, b, c = images.of_pdf(data)
    assert (a["format"], a["width"], b["format"], b["data"]) == ("png", 2, "jpeg", b"JPEG")
    at = a["data"].index(b"IDAT")
    size = struct.unpack(">I", a["data"][at - 4 : at])[0]
    assert zlib.decompress(a["data"][at + 4 : at + 4 + size]) == b"\0" + raw
    at = c["data"].index(b"IDAT")
    assert zlib.decompress(c["data"][at + 4 :][: struct.unpack(">I", c["data"][at - 4 : at])[0]]) == bytes([0, 255, 0, 255, 0, 0, 0, 0, 0])
    f = spark.createDataFrame([("a.pdf", bytearray(data)), ("b.docx", bytearray(maker.docx(["no image"]))), ("c.docx", bytearray(b"bad"))], "path string, content binary")
    assert rows(images.extracted(f), "path", "format", "error") == [("a.pdf", "jpeg", None), ("a.pdf", "png", None), ("a.pdf", "png", None), ("c.docx", None, "not a ZIP archive")]
