"""Queries of the attachment reader: packages are written from the shared tables by rule and read back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.plans.registry import query
from folioforge.plans.views import table
from folioforge.sources import attachments

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts: dict[str, str]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return held.getvalue()


def _p(text: str, style: str = "") -> str:
    style = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def word_file(title: str, lines: list[str], rows: list[list[str]]) -> bytes:
    """A Word package: a heading, one paragraph a line, one table."""
    cells = "".join("<w:tr>" + "".join(f"<w:tc>{_p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    body = _p(title, "h1") + "".join(map(_p, lines)) + f"<w:tbl>{cells}</w:tbl>"
    styles = f'<w:styles xmlns:w="{WORD}"><w:style w:type="paragraph" w:styleId="h1"><w:name w:val="heading 1"/></w:style></w:styles>'
    return package({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>', "word/styles.xml": styles})


def sheet_file(name: str, rows: list[str], strings: tuple[str, ...] = (), merges: tuple[str, ...] = ()) -> bytes:
    """A workbook with an empty first sheet and one of ``rows``, each the XML of its cells; style 1 shows dates."""
    data = "".join(f'<row r="{i}">{r}</row>' for i, r in enumerate(rows, 1))
    merged = f"<mergeCells>{''.join(f'<mergeCell ref="{m}"/>' for m in merges)}</mergeCells>" if merges else ""
    return package({
        "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets><sheet name="empty" sheetId="1" r:id="a"/><sheet name="{escape(name)}" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="b" Target="worksheets/two.xml"/><Relationship Id="a" Target="/xl/worksheets/one.xml"/></Relationships>',
        "xl/worksheets/one.xml": f'<worksheet xmlns="{SHEET}"><sheetData/></worksheet>',
        "xl/worksheets/two.xml": f'<worksheet xmlns="{SHEET}"><sheetData>{data}</sheetData>{merged}</worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{SHEET}">' + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>",
        "xl/styles.xml": f'<styleSheet xmlns="{SHEET}"><numFmts><numFmt numFmtId="164" formatCode="yyyy/mm/dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
    })


@F.pandas_udf(T.BinaryType())
def _word_files(ids: pd.Series, texts: pd.Series, langs: pd.Series) -> pd.Series:
    return pd.Series([word_file(f" t{i}", (t or "").split("\n"), [["id", str(i)], ["", ""], ["", g or ""]]) for i, t, g in zip(ids, texts, langs, strict=True)])


@query(
    r"""WITH l AS (SELECT doc_id, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
t AS (SELECT doc_id, '## t' || doc_id || chr(10) || CASE WHEN len(l) > 0 THEN array_to_string(l, chr(10)) || chr(10) ELSE '' END || 'id | ' || doc_id || chr(10) || lang AS t FROM l)
SELECT doc_id, 'docx' AS fmt, 'ok' AS parse_status, length(t) AS char_count, sha256(t) AS text_sha256 FROM t"""
)
def s14_word_texts(spark, sf):
    """S-09, S-12, S-14: the extension is foreign, so the parts of the package tell its kind."""
    files = table(spark, sf, "documents").select("doc_id", F.lit("a.bin").alias("name"), _word_files("doc_id", "text", "lang").alias("content"))
    return attachments.parse_attachments(files).select("doc_id", "fmt", "parse_status", "char_count", F.sha2("text", 256).alias("text_sha256"))


@F.pandas_udf(T.BinaryType())
def _sheet_files(ids: pd.Series, sizes: pd.Series) -> pd.Series:
    def one(i: int, n: int) -> bytes:
        pair = f'<c r="A3"><v>{i}</v></c><c r="C3" t="b"><v>{i % 2}</v></c>'
        rows = ['<c r="A1" t="s"><v>1</v></c>', "", pair, pair.replace("3", "4") if "3" not in str(i) else "", f'<c r="A5" s="1"><v>{40000 + i % 1000}</v></c><c r="B5"><v>{n}.5</v></c><c r="C5" t="inlineStr"><is><t> x </t></is></c>']
        return sheet_file(f"s{i}", rows, ("no", "head"), ("A1:B1",))

    return pd.Series([one(int(i), int(n)) for i, n in zip(ids, sizes, strict=True)])


@query(
    """SELECT doc_id, 'xlsx' AS fmt, 'ok' AS parse_status, 2 AS sheet_count, '## s' || doc_id || chr(10) || 'head | head' || chr(10) || doc_id || ' |  | ' || CASE WHEN doc_id % 2 = 1 THEN 'True' ELSE 'False' END
|| chr(10) || strftime(DATE '1899-12-30' + CAST(40000 + doc_id % 1000 AS INT), '%Y-%m-%d') || ' | ' || length(text) || '.5 | x' AS text FROM documents"""
)
def s17_sheet_texts(spark, sf):
    """S-16, S-17, Y-51: merged heads, blank and repeated rows, dates, numbers, flags."""
    files = table(spark, sf, "documents").select("doc_id", F.lit("b.XLSX").alias("name"), _sheet_files("doc_id", F.coalesce(F.length("text"), F.lit(0))).alias("content"))
    return attachments.parse_attachments(files).select("doc_id", "fmt", "parse_status", "sheet_count", "text")


KINDS = (("a.doc", "D0CF11E0"), ("a.xls", "D0CF11E0"), ("a.bin", "D0CF11E0"), ("a.txt", "41"), ("a.pptx", "504B0304"), ("a.docx", "504B0304"), ("a.dat", "504B0304"), ("x", "255044462D"))


@query(
    """SELECT doc_id, ['doc', 'xls', 'unknown', 'unknown', 'pptx', 'docx', 'unknown', 'pdf'][doc_id % 8 + 1] AS fmt, ['legacy_doc_unparsed', 'unsupported_format', 'unsupported_format', 'unsupported_format', 'unsupported_format', 'parse_failed', 'unsupported_format', 'parse_failed'][doc_id % 8 + 1] AS parse_status, '' AS text FROM documents"""
)
def s10_attachment_statuses(spark, sf):
    """S-10, S-11, S-13, S-15: kinds without a reader and broken files become statuses."""
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    files = table(spark, sf, "documents").select("doc_id", pick(0).alias("name"), F.unhex(pick(1)).alias("content"))
    return attachments.parse_attachments(files).select("doc_id", "fmt", "parse_status", "text")
