"""Minimal office files made from texts, for round trips and tests."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
LEGAL = dict.fromkeys([*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF])


def docx(paragraphs: list[str], styles: str = "", body: str = "") -> bytes:
    ps = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p.translate(LEGAL))}</w:t></w:r></w:p>' for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{ps}{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {NS}>{styles}</w:styles>")
    return out.getvalue()


def pdf(lines: list[str], size: float = 10.0, compress: bool = True, extra: str = "") -> bytes:
    """One page per 50 lines; characters beyond Windows-1252 become '?'."""
    pages = [lines[i : i + 50] for i in range(0, len(lines), 50)] or [[]]
    objects: list[bytes] = [b"<</Type/Catalog/Pages 2 0 R>>", b"", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"]
    kids = []
    for page in pages:
        body = []
        for i, x in enumerate(page):
            raw = x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            body.append(b"BT /F1 %g Tf 1 0 0 1 72 %g Tm (%s) Tj ET" % (size, 1380 - i * size * 2.5, raw))
        stream = b"\n".join([*body, extra.encode()])
        if compress:
            stream = zlib.compress(stream)
        objects.append(b"<</Length %d%s>>stream\n%s\nendstream" % (len(stream), b"/Filter/FlateDecode" if compress else b"", stream))
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 1400]/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % len(objects))
        kids.append(len(objects))
    objects[1] = b"<</Type/Pages/Kids[%s]/Count %d>>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    out, at = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at)
    out += b"trailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, table)
    return bytes(out)


def made(texts: DataFrame) -> DataFrame:
    """(path, content): the lines of each (doc_id, text) as a DOCX file for even
    ids and a PDF file for odd ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), 64):
                part = f.iloc[k : k + 64]
                lines = [[x.strip() for x in t.splitlines() if x.strip()] for t in part["text"]]
                yield pd.DataFrame({"path": [f"doc_{i}.{'pdf' if i % 2 else 'docx'}" for i in part["doc_id"]], "content": [pdf(x) if i % 2 else docx(x) for i, x in zip(part["doc_id"], lines)]})

    return texts.mapInPandas(run, "path string, content binary")
