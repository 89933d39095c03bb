"""Blocks of a DOCX file, in document order, with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from folioquery.errors import ParseError

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAX_PART = 200 * 2**20  # a part larger than this is taken for a bomb
BULLET = re.compile(r"^([•●○■□▪▫\-*‣◦]|\d+[.)]\s|[(]\d+[)]\s|[a-z][.)]\s)")


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        info = z.getinfo(name)
    except KeyError:
        return None
    if info.file_size > MAX_PART:
        raise ParseError(f"{name} is too large")
    return ElementTree.fromstring(z.read(info))


class Styles:
    """Font and heading level of each paragraph style, resolved along basedOn."""

    def __init__(self, root: ElementTree.Element | None):
        self.base: dict[str, str] = {}
        self.own: dict[str, dict] = {}
        self.name: dict[str, str] = {}
        self.default = {"font": "Calibri", "size": 11.0, "bold": False, "italic": False}
        if root is None:
            return
        for rpr in root.iter(f"{W}rPrDefault"):
            self.default |= run_props(rpr.find(f"{W}rPr"))
        for s in root.iter(f"{W}style"):
            sid = s.get(f"{W}styleId", "")
            based, name = s.find(f"{W}basedOn"), s.find(f"{W}name")
            self.base[sid] = based.get(f"{W}val", "") if based is not None else ""
            self.name[sid] = name.get(f"{W}val", "") if name is not None else ""
            self.own[sid] = run_props(s.find(f"{W}rPr")) | outline(s.find(f"{W}pPr"))

    def font(self, sid: str) -> dict:
        chain, seen = [], set()
        while sid and sid not in seen:
            seen.add(sid)
            chain.append(self.own.get(sid, {}))
            sid = self.base.get(sid, "")
        out = dict(self.default)
        for props in reversed(chain):
            out |= props
        return out

    def heading(self, sid: str) -> int:
        """Level by the style's id or name, else 0."""
        for text in (sid, self.name.get(sid, "")):
            low = text.lower()
            if "heading" in low:
                n = re.search(r"\d", low)
                return int(n.group()) if n else 1
            if low in ("title", "subtitle"):
                return 1 if low == "title" else 2
        return 0


def outline(ppr: ElementTree.Element | None) -> dict:
    lvl = ppr.find(f"{W}outlineLvl") if ppr is not None else None
    return {"outline": int(lvl.get(f"{W}val", "9")) + 1} if lvl is not None else {}


def run_props(rpr: ElementTree.Element | None) -> dict:
    if rpr is None:
        return {}
    out: dict = {}
    for tag, key in (("b", "bold"), ("i", "italic")):
        if (x := rpr.find(W + tag)) is not None:
            out[key] = x.get(f"{W}val", "true") not in ("false", "0", "none")
    if (x := rpr.find(f"{W}sz")) is not None:
        out["size"] = float(x.get(f"{W}val", "22")) / 2
    if (x := rpr.find(f"{W}rFonts")) is not None and x.get(f"{W}ascii"):
        out["font"] = x.get(f"{W}ascii")
    return out


def run_text(run: ElementTree.Element) -> str:
    out = []
    for x in run:
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag == f"{W}tab":
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append("\n\n" if x.get(f"{W}type") == "page" else "\n")
        elif x.tag == f"{W}noBreakHyphen":
            out.append("-")
    return "".join(out)


def paragraph(p: ElementTree.Element, styles: Styles, lists: Numbering | None = None) -> dict:
    ppr = p.find(f"{W}pPr")
    style = ppr.find(f"{W}pStyle") if ppr is not None else None
    sid = style.get(f"{W}val", "") if style is not None else ""
    font = styles.font(sid) | outline(ppr)
    texts, first = [], None
    for run in p.iter(f"{W}r"):
        t = run_text(run)
        if t and first is None and t.strip():
            first = run_props(run.find(f"{W}rPr"))
        texts.append(t)
    font |= first or {}
    numbered = ppr is not None and ppr.find(f"{W}numPr") is not None
    kind, prefix = (lists.item(ppr) if lists else None) or (None, None)
    return {"list_type": kind, "list_prefix": prefix, "text": "".join(texts).strip(), "level": styles.heading(sid) or font.get("outline", 0) % 10, "numbered": numbered, **{k: font[k] for k in ("font", "size", "bold", "italic")}}


# What stands before an item of a list, by the format of its level.
PREFIXES = {"decimal": "#.", "lowerLetter": "a.", "upperLetter": "A.", "lowerRoman": "i.", "upperRoman": "I."}
BULLET_SIGNS = ("•", "◦", "▪")


class Numbering:
    """The lists of a document: (number, level) to the format of that level."""

    def __init__(self, root: ElementTree.Element | None):
        val = lambda x, tag: next((c.get(f"{W}val", "") for c in x.findall(W + tag)), "")
        all_of = lambda tag: root.findall(W + tag) if root is not None else []
        forms = {a.get(f"{W}abstractNumId"): {lv.get(f"{W}ilvl", ""): val(lv, "numFmt") for lv in a.findall(f"{W}lvl")} for a in all_of("abstractNum")}
        self.of = {n.get(f"{W}numId"): forms.get(val(n, "abstractNumId")) for n in all_of("num")}

    def item(self, ppr: ElementTree.Element | None) -> tuple[str, str] | None:
        """(type, prefix) of a paragraph that is an item, else null. A level that
        the list lacks has the format of its first."""
        num = ppr.find(f"{W}numPr") if ppr is not None else None
        if num is None:
            return None
        get = lambda tag, none: next((c.get(f"{W}val", none) for c in num.findall(W + tag)), none)
        levels, at = self.of.get(get("numId", "0")), get("ilvl", "0")
        if levels is None or get("numId", "0") == "0":
            return None
        kind = levels.get(at, next(iter(levels.values()), "decimal"))
        deep = int(at) if at.isdigit() and int(at) < len(BULLET_SIGNS) else 0
        return kind, BULLET_SIGNS[deep] if kind in ("bullet", "none") else PREFIXES.get(kind, "#.")


def hyperlinks(root: ElementTree.Element, rels: ElementTree.Element | None) -> list[dict]:
    """The links of a document: their text, and the target that the relationships
    give or the anchor inside the document."""
    rid = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    targets = {r.get("Id"): r.get("Target") for r in rels.iter() if r.get("Id")} if rels is not None else {}
    out = []
    for h in root.iter(f"{W}hyperlink"):
        anchor = h.get(f"{W}anchor")
        out.append({"text": "".join(run_text(r) for r in h.iter(f"{W}r")), "url": targets.get(h.get(rid)) or (f"#{anchor}" if anchor else None)})
    return out


def table_rows(tbl: ElementTree.Element, styles: Styles) -> list[list[str]]:
    rows = [[" ".join(t for p in c.iter(f"{W}p") if (t := paragraph(p, styles)["text"])) for c in r.findall(f"{W}tc")] for r in tbl.findall(f"{W}tr")]
    wide = max(map(len, rows), default=0)
    return [r + [""] * (wide - len(r)) for r in rows]


def markdown(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    line = lambda r: "| " + " | ".join(x.replace("|", "\\|") for x in r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def _looks_like_heading(p: dict) -> bool:
    t, n = p["text"], len(p["text"].encode())
    letters = any(c.isalpha() for c in t)
    return p["size"] >= 14 or p["bold"] and n < 200 or n < 150 and bool(re.match(r"[\d.]+\s+[A-Z]", t)) or 3 < n < 100 and letters and t == t.upper() or bool(re.match(r"(Chapter|Section|Part|CHAPTER|SECTION|PART)\s+\d+", t))


def _level(p: dict) -> int:
    return next((k + 1 for k, s in enumerate((24, 20, 16, 14)) if p["size"] >= s), 5 if p["size"] >= 12 and p["bold"] else 6)


def metadata(z: zipfile.ZipFile) -> dict:
    out: dict = {"page_count": 1, "title": None, "author": None, "created": None, "modified": None}
    if (app := _part(z, "docProps/app.xml")) is not None:
        for x in app.iter():
            if x.tag.endswith("}Pages") and (x.text or "").strip().isdigit():
                out["page_count"] = max(1, int(x.text))
    if (core := _part(z, "docProps/core.xml")) is not None:
        for key, tag in (("title", "title"), ("author", "creator"), ("created", "created"), ("modified", "modified")):
            out[key] = next((x.text for x in core.iter() if x.tag.endswith("}" + tag) and x.text), None)
    return out


def blocks(data: bytes) -> list[dict]:
    """Rows for sources.files.PARSED."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ParseError("not a ZIP archive") from e
    root = _part(z, "word/document.xml")
    body = root.find(f"{W}body") if root is not None else None
    if body is None:
        raise ParseError("no word/document.xml")
    styles, meta, lists = Styles(_part(z, "word/styles.xml")), metadata(z), Numbering(_part(z, "word/numbering.xml"))
    found: list[dict] = []
    for x in _top(body):
        if x.tag == f"{W}tbl":
            rows = table_rows(x, styles)
            text = "\n".join(" | ".join(r) for r in rows)
            if any(c for r in rows for c in r):
                found.append({"type": "table", "content": text})
            continue
        p = paragraph(x, styles, lists)
        if not p["text"]:
            continue
        head = bool(p["level"]) or _looks_like_heading(p)
        kind = "list" if p["numbered"] or BULLET.match(p["text"]) else "heading" if head else "text"
        found.append({"type": kind, "content": p["text"], "list_type": p["list_type"], "list_prefix": p["list_prefix"], "is_heading": head, "heading_level": (p["level"] or _level(p)) if head else 0, "font_name": p["font"], "font_size": p["size"], "bold": p["bold"], "italic": p["italic"]})
    per = max(1, len(found) // meta["page_count"])
    section = None
    for i, b in enumerate(found):
        b |= {"block_id": f"blk_{i + 1:05d}", "sequence": i, "page": min(i // per + 1, meta["page_count"]), "x": 72.0, "y": 720.0 - (i % 46) * 14.0, "width": 468.0, "height": 14.0, "is_heading": b.get("is_heading", False), **meta}
        b["section"] = None if b["is_heading"] else section
        section = b["content"] if b["is_heading"] else section
    return found


def _top(body: ElementTree.Element) -> list[ElementTree.Element]:
    """Paragraphs and tables in order, also those inside content controls."""
    out = []
    for x in body:
        if x.tag in (f"{W}p", f"{W}tbl"):
            out.append(x)
        elif x.tag in (f"{W}sdt", f"{W}sdtContent", f"{W}ins"):
            out += _top(x)
    return out
