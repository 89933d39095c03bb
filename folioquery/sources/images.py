"""Images inside office files, as rows of bytes."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from folioquery.errors import ParseError
from folioquery.sources import docx
from folioquery.sources.pdf import MAX_STREAM, File, Stream

FOUND = "path string, image_id string, page int, format string, width int, height int, original_name string, data binary, error string"
EMU = 12_700  # per point
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
KINDS = {"jpg": "jpeg", "jpeg": "jpeg", "tif": "tiff"}


def png(width: int, height: int, body: bytes, gray: bool) -> bytes:
    """Eight bits a sample, gray or RGB."""
    step = width * (1 if gray else 3)
    raw = b"".join(b"\0" + body[i * step : (i + 1) * step].ljust(step, b"\0") for i in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0 if gray else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _samples(f: File, s: Stream, width: int, height: int) -> tuple[bytes, bool]:
    """Samples of a decoded image as gray or RGB bytes."""
    body, bits = f.decode(s), int(f.get(s.info.get("BitsPerComponent")) or 1)
    space = f.get(s.info.get("ColorSpace"))
    palette = None
    if isinstance(space, list) and f.get(space[0]) == "Indexed":
        table = f.get(space[3])
        palette, space = f.decode(table) if isinstance(table, Stream) else bytes(table or b""), "Indexed"
    elif isinstance(space, list) and f.get(space[0]) == "ICCBased":
        n = f.get(f.get(space[1]).info.get("N"))
        space = {1: "DeviceGray", 4: "DeviceCMYK"}.get(n, "DeviceRGB")
    per = {"DeviceRGB": 3, "DeviceCMYK": 4, "CalRGB": 3}.get(str(space[0] if isinstance(space, list) else space), 1)
    if bits < 8:
        row, out = (width * per * bits + 7) // 8, bytearray()
        top = 255 // ((1 << bits) - 1) if palette is None else 1
        for y in range(height):
            line = body[y * row : (y + 1) * row]
            out += bytes(((line[k * bits // 8] >> (8 - bits - k * bits % 8)) & ((1 << bits) - 1)) * top for k in range(min(width * per, len(line) * 8 // bits)))
        body = bytes(out)
    elif bits == 16:
        body = body[::2]
    if palette is not None:
        return b"".join(palette[3 * v : 3 * v + 3] for v in body), False
    if per == 4:
        out = bytearray()
        for i in range(0, len(body) - 3, 4):
            k = 255 - body[i + 3]
            out += bytes((255 - v) * k // 255 for v in body[i : i + 3])
        return bytes(out), False
    return body, per == 1


def of_pdf(data: bytes) -> list[dict]:
    f, out, seen = File(data), [], set()
    for number, page in enumerate(f.pages(), 1):
        found = f.get((f.get(page.get("Resources")) or {}).get("XObject")) or {}
        for name, ref in found.items():
            s = f.get(ref)
            if not isinstance(s, Stream) or f.get(s.info.get("Subtype")) != "Image" or id(s) in seen:
                continue
            seen.add(id(s))
            width, height = int(f.get(s.info.get("Width")) or 0), int(f.get(s.info.get("Height")) or 0)
            row = {"page": number, "width": width, "height": height, "original_name": name, "image_id": f"img_{len(out) + 1:05d}"}
            filters = f.get(s.info.get("Filter"))
            last = str(f.get(filters[-1] if isinstance(filters, list) and filters else filters))
            try:
                if width * height * 4 > MAX_STREAM:
                    raise ParseError("image too large")
                if last in ("DCTDecode", "DCT", "JPXDecode"):
                    row |= {"format": "jp2" if last == "JPXDecode" else "jpeg", "data": f.decode(s)}
                else:
                    row |= {"format": "png", "data": png(width, height, *_samples(f, s, width, height))}
            except (ParseError, ValueError, TypeError, IndexError, AttributeError, zlib.error) as e:
                row["error"] = str(e) or type(e).__name__
            out.append(row)
    return out


def of_docx(data: bytes) -> list[dict]:
    """Images in the order in which the document shows them; one that an outside
    link names has no data."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ParseError("not a ZIP archive") from e
    links = docx._part(z, "word/_rels/document.xml.rels")
    target = {x.get("Id"): (x.get("Target", ""), x.get("TargetMode") == "External") for x in links} if links is not None else {}
    root, out = docx._part(z, "word/document.xml"), []
    for shape in root.iter() if root is not None else ():
        if shape.tag not in (f"{WP}inline", f"{WP}anchor"):
            continue
        blip, size = next(shape.iter(f"{A}blip"), None), shape.find(f"{WP}extent")
        if blip is None:
            continue
        name, outside = target.get(blip.get(f"{R}embed") or blip.get(f"{R}link"), ("", True))
        ext = name.rsplit(".", 1)[-1].lower()
        row = {"image_id": f"img_{len(out) + 1:05d}", "page": 1, "format": KINDS.get(ext, ext), "original_name": name.rsplit("/", 1)[-1]}
        if size is not None:
            row |= {"width": int(size.get("cx", 0)) // EMU, "height": int(size.get("cy", 0)) // EMU}
        part = name.lstrip("/") if name.startswith("/") else f"word/{name}"
        if not outside and part in z.namelist() and z.getinfo(part).file_size <= MAX_STREAM:
            row["data"] = z.read(part)
        out.append(row)
    return out


def extracted(found: DataFrame) -> DataFrame:
    """Images of every file of rows (path, content); a file that cannot be read
    gives one row with its error, a file without images none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows = (of_pdf if path.lower().endswith(".pdf") else of_docx)(bytes(content))
                except Exception as e:  # noqa: BLE001 - any fault of a file is the file's
                    rows = [{"error": str(e) or type(e).__name__}]
                if rows:
                    yield pd.DataFrame([{"path": path, **{n: r.get(n) for n in names[1:]}} for r in rows], columns=names).astype({n: "Int32" for n in ("page", "width", "height")})

    return found.select("path", "content").mapInPandas(run, FOUND)
