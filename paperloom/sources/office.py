"""Office files, archives and simple PDF texts with the standard library: bytes in, (title, Markdown) out."""

from __future__ import annotations

import csv
import html
import io
import json
import posixpath
import re
import zipfile
import zlib
from xml.etree import ElementTree

from ..functions import constants as K
from .html_markdown import html_to_markdown, link_target

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Unsupported(ValueError):
    """A file that no decoder here can read."""


def capped(text: str, limit: int = K.CONTENT_LIMIT) -> str:
    return text if len(text) <= limit else text[:limit] + K.TRUNCATED


def decode_text(data: bytes) -> str:
    return data.decode("utf-8")


def decode_json(data: bytes) -> str:
    return json.dumps(json.loads(data.decode("utf-8")), indent=2, ensure_ascii=False)


def decode_yaml(data: bytes) -> str:
    import yaml

    return yaml.dump(yaml.safe_load(data.decode("utf-8")), allow_unicode=True, default_flow_style=False)


def markdown_rows(rows: list[list[str]]) -> str:
    """Rows as a pipe table: a rule after the first; cells as they are, rows of any length."""
    out = []
    for i, row in enumerate(rows):
        out.append("| " + " | ".join(row) + " |\n")
        if i == 0:
            out.append("|" + "---|" * len(row) + "\n")
    return "".join(out)


def decode_csv(data: bytes) -> str:
    rows = list(csv.reader(io.StringIO(data.decode("utf-8"), newline="")))
    return markdown_rows(rows) if rows else "Empty CSV file"


def _xml(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name))


def _relations(archive: zipfile.ZipFile, name: str) -> dict[str, str]:
    """Targets by id of a part's relations."""
    return {r.get("Id"): r.get("Target") or "" for r in _xml(archive, name)} if name in archive.namelist() else {}


def decode_docx(data: bytes) -> str:
    """Paragraphs with heading styles, emphasis, links, pictures and list items, and tables, in the body's order."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    body = _xml(archive, "word/document.xml").find(f"{_W}body")
    relations = _relations(archive, "word/_rels/document.xml.rels")
    out: list[str] = []

    def run_text(run) -> str:
        text = "".join((t.text or "") if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in run)
        style = run.find(f"{_W}rPr")
        for tag, mark in ((f"{_W}b", "**"), (f"{_W}i", "*")):
            if text.strip() and style is not None and style.find(tag) is not None:
                text = f"{mark}{text}{mark}"
        for picture in run.iter(f"{_A}blip"):
            about = next((x for x in run.iter() if x.tag.endswith("}docPr")), None)
            suffix = posixpath.splitext(relations.get(picture.get(f"{_R}embed"), ""))[1].lower()
            kind = K.IMAGE_TYPES.get(suffix, "image/jpeg")
            text += f"![{(about.get('descr') or '') if about is not None else ''}](data:{kind};base64...)"
        return text

    def paragraph(p) -> str:
        parts = []
        for x in p:
            if x.tag == f"{_W}hyperlink":
                text = "".join(map(run_text, x.iter(f"{_W}r")))
                target = link_target(relations.get(x.get(f"{_R}id"), ""))
                parts.append(f"[{text.strip()}]({target})" if target and text.strip() else text)
            else:
                parts += map(run_text, [x] if x.tag == f"{_W}r" else x.iter(f"{_W}r"))
        return "".join(parts).strip()

    for x in body if body is not None else ():
        if x.tag == f"{_W}p":
            text, style = paragraph(x), x.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            heading = re.fullmatch(r"(?i)heading\s*([1-6])", name)
            if text and heading:
                text = "#" * int(heading[1]) + " " + text
            elif text and name.lower() == "title":
                text = "# " + text
            elif text and x.find(f"{_W}pPr/{_W}numPr") is not None:
                text = "* " + text
            if text:
                out.append(text)
        elif x.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, map(paragraph, c.iter(f"{_W}p")))) for c in r.findall(f"{_W}tc")] for r in x.findall(f"{_W}tr")]
            if rows:
                out.append(markdown_rows(rows).rstrip("\n"))
    return "\n\n".join(out)


def color_hex(value: str | None) -> str | None:
    """A colour as #rrggbb; white, transparent, none and automatic ones are none."""
    if value is None or value.lower() in ("none", "auto", "transparent", "ffffff", "ffffffff", "#ffffff", "00000000"):
        return None
    if m := re.fullmatch(r"RGB\((\d+), (\d+), (\d+)\)", value):
        return "#" + "".join(f"{int(x):02x}" for x in m.groups())
    return "#" + (value[2:] if len(value) == 8 else value).lower().lstrip("#")


def sheet_cells(data: bytes) -> list[dict]:
    """sheet, sheet_no, row, col (from 1), value, bold, italic, underline, font_color, bg_color of every cell with a value."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    names = set(archive.namelist())
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _xml(archive, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    styles: list[dict] = []
    if "xl/styles.xml" in names:
        root = _xml(archive, "xl/styles.xml")
        fonts = list(root.find(f"{_S}fonts") if root.find(f"{_S}fonts") is not None else ())
        fills = list(root.find(f"{_S}fills") if root.find(f"{_S}fills") is not None else ())
        for xf in root.find(f"{_S}cellXfs") if root.find(f"{_S}cellXfs") is not None else ():
            font = fonts[int(xf.get("fontId", 0))] if fonts else None
            fill = fills[int(xf.get("fillId", 0))] if fills else None
            has = lambda tag: font is not None and font.find(f"{_S}{tag}") is not None
            color = font.find(f"{_S}color") if font is not None else None
            ground = fill.find(f"{_S}patternFill/{_S}fgColor") if fill is not None else None
            styles.append({"bold": has("b"), "italic": has("i"), "underline": has("u"), "font_color": color_hex(color.get("rgb")) if color is not None else None, "bg_color": color_hex(ground.get("rgb")) if ground is not None else None})
    links = {r.get("Id"): r.get("Target") for r in _xml(archive, "xl/_rels/workbook.xml.rels")}
    out = []
    for k, sheet in enumerate(_xml(archive, "xl/workbook.xml").find(f"{_S}sheets")):
        target = posixpath.normpath(posixpath.join("xl", links[sheet.get(f"{_R}id")].lstrip("/"))) if not links[sheet.get(f"{_R}id")].startswith("/xl") else links[sheet.get(f"{_R}id")][1:]
        for c in _xml(archive, target).iter(f"{_S}c"):
            kind, v = c.get("t"), c.find(f"{_S}v")
            value = shared[int(v.text)] if kind == "s" and v is not None else "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else v.text if v is not None else None
            if value in (None, ""):
                continue
            letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
            col = 0
            for x in letters:
                col = col * 26 + ord(x) - 64
            style = styles[int(c.get("s", 0))] if styles and int(c.get("s", 0)) < len(styles) else {}
            out.append({"sheet": sheet.get("name"), "sheet_no": k, "row": int(digits), "col": col, "value": value} | style)
    return out


def decode_xlsx(data: bytes) -> str:
    """Each sheet's used range as a table below its name; styled cells in Markdown and spans.

    Rows are written until the content limit is passed, where the text is cut anyway, so that a value in a far cell costs no more.
    """
    archive = zipfile.ZipFile(io.BytesIO(data))
    sheets: dict[int, dict[int, dict[int, dict]]] = {}
    for c in sheet_cells(data):
        sheets.setdefault(c["sheet_no"], {}).setdefault(c["row"], {})[c["col"]] = c

    def written(c: dict) -> str:
        text = c["value"].replace("\n", " ")
        for key, tag in (("underline", "u"), ("italic", "em"), ("bold", "strong")):
            if c.get(key):
                text = f"<{tag}>{text}</{tag}>"
        css = "; ".join(f"{name}: {c[key]}" for key, name in (("font_color", "color"), ("bg_color", "background-color")) if c.get(key))
        return f'<span style="{css}">{text}</span>' if css else text

    out, size = [], 0
    for k, sheet in enumerate(_xml(archive, "xl/workbook.xml").find(f"{_S}sheets")):
        own = sheets.get(k)
        if not own:
            out.append(f"## {sheet.get('name')}\n\nEmpty sheet")
            continue
        widths: dict[int, int] = {}
        for row in own.values():
            for col, c in row.items():
                widths[col] = max(widths.get(col, 5), len(c["value"]) + 2)
        width = [widths.get(col, 5) for col in range(1, max(widths) + 1)]
        blank = "|" + "|".join("  ".ljust(w) for w in width) + "|"
        lines = ["|" + "|".join(" " * w for w in width) + "|", "|" + "|".join(":---:".ljust(w) for w in width) + "|"]
        size += 2 * len(blank)
        for r in range(1, max(own) + 1):
            lines.append("|" + "|".join(f" {written(own[r][c]) if c in own[r] else ''} ".ljust(w) for c, w in enumerate(width, 1)) + "|" if r in own else blank)
            size += len(lines[-1])
            if size > K.CONTENT_LIMIT:
                break
        out.append(f"## {sheet.get('name')}\n\n" + "\n".join(lines))
        if size > K.CONTENT_LIMIT:
            break
    return "\n\n".join(out)


def _slides(archive: zipfile.ZipFile) -> list[str]:
    """The slides in the presentation's order, else in that of their numbers."""
    names = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))
    if "ppt/presentation.xml" in archive.namelist():
        targets = _relations(archive, "ppt/_rels/presentation.xml.rels")
        listed = [posixpath.normpath(posixpath.join("ppt", targets.get(x.get(f"{_R}id"), ""))) for x in _xml(archive, "ppt/presentation.xml").iter(f"{_P}sldId")]
        names = [n for n in listed if n in names] or names
    return names


def decode_pptx(data: bytes) -> str:
    """Each slide's title, texts, pictures, tables and notes after a comment with its number."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    words = lambda x: "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in x.iter(f"{_A}p"))
    text = ""
    for k, name in enumerate(_slides(archive), 1):
        text += f"\n\n<!-- Slide number: {k} -->\n"
        for shape in _xml(archive, name).find(f"{_P}cSld/{_P}spTree"):
            if shape.tag == f"{_P}sp" and shape.find(f"{_P}txBody") is not None:
                kind = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                title = kind is not None and kind.get("type") in ("title", "ctrTitle")
                text += ("# " + words(shape).lstrip() if title else words(shape)) + "\n"
            elif shape.tag == f"{_P}pic":
                about = shape.find(f"{_P}nvPicPr/{_P}cNvPr")
                text += f"\n![{about.get('descr') or about.get('name')}]({re.sub(r'\W', '', about.get('name') or '')}.jpg)\n"
            elif shape.tag == f"{_P}graphicFrame" and (table := shape.find(f".//{_A}tbl")) is not None:
                rows = [[html.escape(words(c)) for c in r.findall(f"{_A}tc")] for r in table.findall(f"{_A}tr")]
                tags = ["".join(f"<{tag}>{c}</{tag}>" for c in row) for row, tag in zip(rows, ["th"] + ["td"] * len(rows), strict=False)]
                text += "\n" + html_to_markdown("<table>" + "".join(f"<tr>{x}</tr>" for x in tags) + "</table>")[1].strip() + "\n"
        text = text.strip()
        notes = f"ppt/notesSlides/notesSlide{re.search(r'(\d+)\.xml$', name)[1]}.xml"
        if notes in archive.namelist():
            body = [words(s) for s in _xml(archive, notes).iter(f"{_P}sp") if (kind := s.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")) is not None and kind.get("type") == "body"]
            text = (text + "\n\n### Notes:\n" + "".join(body[:1])).strip()
    return text.strip()


_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>")


def pdf_pages(data: bytes) -> list[str]:
    """Texts of a PDF's content streams in file order: literal and hexadecimal strings of simple fonts, lines by text moves.

    Enough for generated files with plain encodings; others need a page provider with a PDF library.
    """
    if not data.startswith(b"%PDF"):
        raise Unsupported("not a PDF")
    pages = []
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        raw = m[2]
        if b"/FlateDecode" in m[1]:
            try:
                raw = zlib.decompress(raw)
            except zlib.error:
                continue
        if not re.search(rb"\bBT\b.*?\bET\b", raw, re.S) or b"/Subtype" in m[1]:
            continue
        lines: list[str] = []
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", raw, re.S):
            line = ""
            for token in re.finditer(_STRING.pattern + rb"|\b(?:Td|TD|Tm|T\*)(?=\s|$)", block):
                x = token[0]
                if x[:1] == b"(":
                    line += re.sub(rb"\\([nrtbf()\\])", lambda e: {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(e[1], e[1]), x[1:-1]).decode("latin-1")
                elif x[:1] == b"<":
                    line += bytes.fromhex(re.sub(rb"\s", b"", x[1:-1]).decode()).decode("latin-1")
                elif line:
                    lines.append(line)
                    line = ""
            if line:
                lines.append(line)
        pages.append("\n".join(lines))
    return pages


def decode_zip(data: bytes, depth: int = 3) -> str:
    """Members in the order of their names, each below its path; a member that fails doesn't fail the others."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    out = []
    for info in sorted(archive.infolist(), key=lambda x: x.filename):
        name = posixpath.normpath(info.filename.replace("\\", "/"))
        if info.is_dir() or name.startswith(("..", "/")) or re.match("[A-Za-z]:", name):
            continue
        kind = K.FORMATS.get(posixpath.splitext(name)[1].lower())
        suffix = posixpath.splitext(name)[1].lower()
        try:
            if suffix in (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".mp3", ".mp4", ".wav", ".avi"):
                body = f"[Media file: {name}]"
            elif kind == "zip" and depth:
                body = decode_zip(archive.read(info), depth - 1)
            elif kind is None:
                body = "Unsupported file type"
            else:
                body = decode(kind, archive.read(info))[1]
                if kind in ("text", "json", "yaml"):
                    body = f"```{suffix[1:]}\n{body}\n```"
        except Exception as e:  # noqa: BLE001  a broken member is reported in its place
            body = f"Error: {e}"
        out.append(f"## {name}\n\n{capped(body, K.ZIP_MEMBER_LIMIT)}")
    return "\n\n".join(out)


_DECODERS = {"text": decode_text, "json": decode_json, "yaml": decode_yaml, "csv": decode_csv, "word": decode_docx, "excel": decode_xlsx, "ppt": decode_pptx, "zip": decode_zip}
_CAPPED = {"html", "word", "excel", "ppt", "zip"}


_TITLED = {"html", "word", "ppt"}


def decode(kind: str, data: bytes, path: str | None = None) -> tuple[str | None, str]:
    """(title, Markdown or text) of a file of a known format; some formats without a title take the stem of the path."""
    if kind == "html":
        title, text = html_to_markdown(data.decode("utf-8", "replace"))
    elif kind == "pdf":
        title, text = None, "\n".join(pdf_pages(data))
    elif kind in _DECODERS:
        title, text = None, _DECODERS[kind](data)
    else:
        raise Unsupported(f"no decoder for {kind}")
    if title is None and path and kind in _TITLED:
        title = posixpath.splitext(posixpath.basename(path))[0]
    return title, capped(text) if kind in _CAPPED else text
