import io
import zipfile

import pytest

from folioquery import __main__ as cli
from folioquery.errors import PageError, RecordError
from folioquery.operators import embedding, ingest
from folioquery.operators.store import Store
from folioquery.schemas import ENTRIES
from folioquery.sources import docx, files, maker, pdf

NUMBERING = f"""<w:numbering {maker.NS}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>
<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>"""


def item(text, level, number=1):
    return f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def with_parts(data, **parts):
    out = io.BytesIO(data)
    with zipfile.ZipFile(out, "a") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def test_numbering_links_and_dates():
    body = item("first", 0) + item("below", 1) + item("deep", 5) + item("none", 0, 0)
    core = '<c xmlns:d="x"><d:title>T</d:title><d:creator>Ann</d:creator><d:created>2025-01-02T03:04:05Z</d:created></c>'
    data = with_parts(maker.docx(["plain"], body=body), word__numbering=NUMBERING, docProps__core=core)
    rows = docx.blocks(data)
    assert [(r["content"], r["type"], r["list_type"], r["list_prefix"]) for r in rows] == [("plain", "text", None, None), ("first", "list", "decimal", "#."), ("below", "list", "bullet", "◦"), ("deep", "list", "decimal", "#."), ("none", "list", None, None)]
    assert rows[0]["author"] == "Ann" and rows[0]["created"] == "2025-01-02T03:04:05Z" and rows[0]["modified"] is None
    from xml.etree import ElementTree

    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    doc = ElementTree.fromstring(f'<w:document {maker.NS} xmlns:r="{r}"><w:hyperlink r:id="a"><w:r><w:t>here</w:t></w:r></w:hyperlink><w:hyperlink w:anchor="top"/></w:document>')
    rels = ElementTree.fromstring('<R><x Id="a" Target="https://e.example/"/></R>')
    assert docx.hyperlinks(doc, rels) == [{"text": "here", "url": "https://e.example/"}, {"text": "", "url": "#top"}]


def test_pdf_pages_lines_and_widths():
    data = maker.pdf([f"line {i}" for i in range(60)])
    pages = pdf.page_texts(data)
    assert [p for p, _ in pages] == [1, 2] and pages[1][1].startswith("line 50\n")
    about = pdf.described(data)
    assert (about["version"], about["pages"], about["encrypted"], about["rotations"], about["annotations"]) == ("1.4", 2, False, [0, 0], [0, 0])
    spans = [pdf.Span(text=f"a{i}", x=0.0, y=1000.0 - 5 * i, size=4.0, width=5.0, font="F") for i in range(100)] + [pdf.Span(text=f"b{i}", x=300.0, y=1000.0 - 5 * i, size=4.0, width=5.0, font="F") for i in range(100)]
    assert [x.text for x in pdf.lines(spans)] == [f"a{i} b{i}" for i in range(100)]  # a column drawn much later
    assert pdf.standard("ABCDEF+Times-Bold")[0][ord("A") - 32] == 722 and pdf.standard("Courier") == ((), 600.0) and len(pdf.HELVETICA) == len(pdf.TIMES) == 95


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_files(spark, store, rows):
    data = [("/x/a.docx", bytearray(maker.docx(["Pumps move water.", "Valves close."]))), ("/x/b.pdf", bytearray(maker.pdf(["Water is cold here."]))), ("/x/c.pdf", bytearray(b"no file")), ("/x/d.txt", bytearray(b"text"))]
    found = spark.createDataFrame(data, "path string, content binary")
    heard = {}
    o = ingest.IndexOptions(source="box", tags={"k": "v"}, provider=embedding.HashProvider())
    bad = ingest.index_files(store, "1", found, o, heard.__setitem__)
    assert {r[0] for r in rows(bad, "path")} == {"/x/c.pdf", "/x/d.txt"}
    assert heard == {"found": 4, "known": 0, "failed": 2, "saved": 2, "embedded": 3}
    assert rows(store.table("documents"), "name", "source", "page_count") == [("a.docx", "box", 1), ("b.pdf", "box", 1)] and store.table("tags").count() == 2
    assert rows(ingest.index_files(store, "2", found, o, heard.__setitem__), "path") and heard["known"] == 2 and heard["saved"] == 0
    assert {r["document_name"] for r in cli.asked(store, "cold water").collect()} == {"a.docx", "b.pdf"}
    assert rows(files.page_texts(files.parsed(found)), "path", "text") == [("/x/a.docx", "Pumps move water.\nValves close."), ("/x/b.pdf", "Water is cold here.")]


def test_records(spark, store, rows):
    data = [("crm", "one", None, {"a": "b"}, "e1", None, [("", "alpha", None, {"x": "y"})]), ("", "two", None, None, "e2", None, [("", "beta", None, None)])]
    assert rows(ingest.index_records(store, "1", spark.createDataFrame(data, ENTRIES)), "name", "error") == [("two", "missing source")]
    again = [("crm", "one", None, None, "e1", None, [("", "gamma", None, None), ("", "delta", None, None)])]
    ingest.index_records(store, "2", spark.createDataFrame(again, ENTRIES))
    assert rows(store.table("blocks"), "block_id", "content") == [("entry_1", "gamma"), ("entry_2", "delta")] and store.table("tags").count() == 0
    assert store.table("documents").count() == 1
    with pytest.raises(RecordError, match="missing source"):
        ingest.index_records(store, "3", spark.createDataFrame(data, ENTRIES), strict=True)


def test_small_things():
    assert cli.shortened("a  b\nc", 10) == "a b c" and cli.shortened("x" * 20, 10) == "x" * 7 + "..." and cli.shortened(None) == ""
    assert str(PageError("bad", page=3)) == "bad (page=3)" and cli.main(["nonsense"]) == 2
