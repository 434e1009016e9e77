"""Text of attached files: Word and Excel packages read with zip and XML, other kinds answered with a status."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

#: Limits, statuses, notes and heading styles that other readers of the results expect.
MAX_SHEET_ROWS = 2000
LARGE_BYTES = 5 * 1024 * 1024
KNOWN = ("pdf", "docx", "doc", "xlsx", "xls", "ppt", "pptx")
HEADING = r"^(Heading|heading|标题)\s*\d+$"
PART_KINDS = (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"))
NOTE_UNSUPPORTED = "暂不支持解析 {} 格式的内容"
NOTE_DOC = "未检测到 LibreOffice/soffice，跳过 .doc 内容解析"
NOTE_ROWS = "工作表 {} 超过 {} 行，已截断"
NOTE_LARGE = "大文件以 read_only 模式解析，合并单元格未填充"
NOTE_FAILED = "解析异常: {}: {}"
#: Built-in number formats that show dates.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}

SCHEMA = "fmt string, text string, char_count long, sheet_count long, parse_status string, notes array<string>"


def kind_of(name: str | None, content: bytes) -> str:
    """The leading bytes decide, then the extension; a package with a foreign extension is known by its parts."""
    ext = posixpath.splitext(name or "")[1].lower().lstrip(".")
    if content.startswith(b"%PDF"):
        return "pdf"
    if content.startswith(b"PK\x03\x04"):
        if ext in ("docx", "xlsx", "pptx"):
            return ext
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as package:
                held = set(package.namelist())
        except zipfile.BadZipFile:
            return "unknown"
        return next((kind for part, kind in PART_KINDS if part in held), "unknown")
    if content.startswith(b"\xd0\xcf\x11\xe0"):
        return ext if ext in ("doc", "xls", "ppt") else "unknown"
    return ext if ext in KNOWN else "unknown"


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attr(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _child(e, *path: str):
    for name in path:
        e = next((c for c in e if _tag(c) == name), None) if e is not None else None
    return e


def _inside(e, *path: str) -> list:
    found = _child(e, *path)
    return [] if found is None else list(found)


def _run_text(e) -> str:
    """Text of a paragraph: its runs and those of its links, with tabs and line breaks."""
    out = []
    for c in e:
        name = _tag(c)
        if name == "t":
            out.append(c.text or "")
        elif name in ("tab", "ptab"):
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
        elif name == "noBreakHyphen":
            out.append("-")
        elif name in ("r", "hyperlink"):
            out.append(_run_text(c))
    return "".join(out)


def _table_lines(table) -> Iterator[str]:
    """One line a row; a cell over several columns counts for each, one that goes on from above repeats its text."""
    above: dict[int, str] = {}
    for row in (r for r in table if _tag(r) == "tr"):
        cells, at, now = [], 0, {}
        for cell in (c for c in row if _tag(c) == "tc"):
            span, merge = _child(cell, "tcPr", "gridSpan"), _child(cell, "tcPr", "vMerge")
            text = "\n".join(_run_text(p) for p in cell if _tag(p) == "p").strip()
            if merge is not None and _attr(merge, "val") != "restart":
                text = above.get(at, text)
            for _ in range(int(_attr(span, "val") or 1) if span is not None else 1):
                cells.append(text)
                now[at] = text
                at += 1
        above = now
        if any(cells):
            yield " | ".join(c for c in cells if c)


def word_text(content: bytes, headings: bool = True) -> str:
    """Paragraphs that are not blank, headings marked with ``## `` if wanted, then the rows of all tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = _child(ElementTree.fromstring(package.read("word/document.xml")), "body")
        marked = set()
        if headings and "word/styles.xml" in package.namelist():
            for style in ElementTree.fromstring(package.read("word/styles.xml")):
                name = _child(style, "name")
                if name is not None and re.match(HEADING, _attr(name, "val") or ""):
                    marked.add(_attr(style, "styleId"))
    lines = []
    for p in (c for c in body if _tag(c) == "p"):
        text, style = _run_text(p), _child(p, "pPr", "pStyle")
        if text.strip():
            heading = style is not None and _attr(style, "val") in marked
            lines.append(("## " if heading else "") + text.strip() if headings else text)
    for table in (c for c in body if _tag(c) == "tbl"):
        lines.extend(_table_lines(table))
    return "\n".join(lines).strip()


def _shows_date(code: str) -> bool:
    """Whether a custom number format shows a date or a time: day, month, year, hour or second outside quotes and brackets."""
    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|_.|\[(?![hms]+\])[^\]]*\]', "", code.split(";")[0].lower())))


def _moment(serial: float, from_1904: bool) -> str:
    if 0 <= serial < 1:
        return str((datetime.min + timedelta(seconds=round(serial * 86400))).time())
    if not from_1904 and serial < 60:  # the calendar counts a 29 February 1900 that never was
        serial += 1
    when = (datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)) + timedelta(seconds=round(serial * 86400))
    return when.date().isoformat() if when.time() == datetime.min.time() else when.isoformat()


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref).groups()
    column = 0
    for c in letters.upper():
        column = column * 26 + ord(c) - 64
    return int(digits), column


def _strings(package: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in package.namelist():
        return []
    return [_rich(e) for e in ElementTree.fromstring(package.read("xl/sharedStrings.xml")) if _tag(e) == "si"]


def _rich(e) -> str:
    """Text of a string item: its own, or that of its runs; phonetic hints do not count."""
    return "".join((c.text or "") if _tag(c) == "t" else _rich(c) for c in e if _tag(c) in ("t", "r"))


def _date_styles(package: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in package.namelist():
        return set()
    root = ElementTree.fromstring(package.read("xl/styles.xml"))
    own = {int(_attr(f, "numFmtId")): _attr(f, "formatCode") or "" for f in _inside(root, "numFmts")}
    ids = [int(_attr(x, "numFmtId") or 0) for x in _inside(root, "cellXfs")]
    return {i for i, f in enumerate(ids) if (_shows_date(own[f]) if f in own else f in DATE_FORMATS)}


def _shown(cell, strings: list[str], dates: set[int], from_1904: bool) -> str:
    kind, value = cell.get("t", "n"), _child(cell, "v")
    if kind == "inlineStr":
        inline = _child(cell, "is")
        return _rich(inline).strip() if inline is not None else ""
    raw = value.text if value is not None else None
    if raw is None:
        return ""
    if kind == "s":
        return strings[int(raw)].strip()
    if kind == "b":
        return str(raw.strip() == "1")
    if kind != "n":
        return raw.strip()
    number = float(raw) if re.search("[.eE]", raw) else int(raw)
    return _moment(number, from_1904) if int(cell.get("s", 0)) in dates else str(number)


def _sheet_lines(root, strings, dates, from_1904: bool, fill: bool, most: int) -> tuple[list[str], bool]:
    """Rows as lines and whether some were cut off: blank rows and repeats of the line before are left out, merged areas filled."""
    rows: dict[int, dict[int, str]] = {}
    last = 0
    for row in _inside(root, "sheetData"):
        last = int(row.get("r", last + 1))
        at, cells = 0, rows.setdefault(last, {})
        for cell in row:
            at = _place(cell.get("r"))[1] if cell.get("r") else at + 1
            cells[at] = _shown(cell, strings, dates, from_1904)
    for merged in _inside(root, "mergeCells") if fill else []:
        corners = [_place(x) for x in _attr(merged, "ref").split(":")]
        (top, left), (bottom, right) = corners[0], corners[-1]
        shown = rows.get(top, {}).get(left, "")
        for r in range(top, bottom + 1):
            rows.setdefault(r, {}).update(dict.fromkeys(range(left, right + 1), shown))
    lines: list[str] = []
    for r in sorted(rows):
        filled = [c for c, shown in rows[r].items() if shown]
        line = " | ".join(rows[r].get(c, "") for c in range(1, max(filled) + 1)) if filled else ""
        if not line or lines and lines[-1] == line:
            continue
        if len(lines) == most:
            return lines, True
        lines.append(line)
    return lines, False


def sheet_text(content: bytes, most: int = MAX_SHEET_ROWS, large: int = LARGE_BYTES) -> tuple[str, int, list[str]]:
    """Text, number of sheets and notes of a workbook: a ``## `` line for each sheet with rows, then its rows."""
    fill = len(content) <= large
    blocks, notes = [], [] if fill else [NOTE_LARGE]
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        book = ElementTree.fromstring(package.read("xl/workbook.xml"))
        targets = {_attr(r, "Id"): _attr(r, "Target") for r in ElementTree.fromstring(package.read("xl/_rels/workbook.xml.rels"))}
        setting = _child(book, "workbookPr")
        from_1904 = setting is not None and _attr(setting, "date1904") in ("1", "true")
        strings, dates = _strings(package), _date_styles(package)
        sheets = [(s.get("name"), targets[next(v for k, v in s.attrib.items() if k.startswith("{") and k.endswith("}id"))]) for s in _inside(book, "sheets")]
        for name, target in sheets:
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            lines, more = _sheet_lines(ElementTree.fromstring(package.read(part)), strings, dates, from_1904, fill, most)
            if lines:
                blocks.append("\n".join([f"## {name}", *lines]))
            if more:
                notes.append(NOTE_ROWS.format(name, most))
    return "\n\n".join(blocks).strip(), len(sheets), notes


def parse(name: str | None, content: bytes | None) -> tuple:
    """``fmt, text, char_count, sheet_count, parse_status, notes`` of one file; never raises. Null content is an empty file."""
    content = bytes(content or b"")
    kind, text, sheets, status, notes = "unknown", "", None, "ok", []
    try:
        kind = kind_of(name, content)
        if kind == "docx":
            text = word_text(content)
        elif kind == "xlsx":
            text, sheets, notes = sheet_text(content)
        elif kind == "doc":
            status, notes = "legacy_doc_unparsed", [NOTE_DOC]
        elif kind == "pdf":
            raise NotImplementedError("no reader of PDF pages")
        else:
            status, notes = "unsupported_format", [NOTE_UNSUPPORTED.format(kind)]
    except Exception as error:  # a broken file is a row with a status, not a failed task
        text, status, notes = "", "parse_failed", [*notes, NOTE_FAILED.format(type(error).__name__, error)]
    return kind, text, len(text), sheets, status, notes


def parse_attachments(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """``files`` without its content, with the columns of :data:`SCHEMA`; files are read one at a time in Arrow batches."""
    kept = [f for f in files.schema.fields if f.name != content]
    made = [x.split()[0] for x in SCHEMA.split(", ")]
    if clash := {f.name for f in kept} & set(made):
        raise ValueError(f"rename columns {sorted(clash)}")

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = pd.DataFrame([parse(n, c) for n, c in zip(part[name], part[content], strict=True)], columns=made, index=part.index)
            rows["sheet_count"] = rows["sheet_count"].astype("Int64")
            yield pd.concat([part.drop(columns=content), rows], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return files.mapInPandas(batches, f"{fields}, {SCHEMA}")
