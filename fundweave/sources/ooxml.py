"""Small XLSX and DOCX files with the standard library: the parts that files.py reads back."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_NOT_XML = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


_ODD = re.compile(f"[&<>\r]|{_NOT_XML.pattern}")


def _said(text: str | None) -> str:
    """Text for an element. Characters that XML has no form for become U+FFFD, and carriage returns references, since a reader turns them into line ends."""
    if not text or not _ODD.search(text):
        return text or ""
    return escape(_NOT_XML.sub("�", text), {"\r": "&#13;"})


def _column(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def _packed(parts: dict[str, str], main: str, kinds: dict[str, str]) -> bytes:
    types = "".join(f'<Override PartName="/{name}" ContentType="application/vnd.openxmlformats-officedocument.{kind}+xml"/>' for name, kind in kinds.items())
    every = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="{main}"/></Relationships>',
    } | parts
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in every.items():
            z.writestr(zipfile.ZipInfo(name), (_HEAD + text).encode())  # a fixed date: the same rows give the same bytes
    return held.getvalue()


def workbook(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """An XLSX file; every cell is an inline string, None is no cell."""
    parts, kinds, listed, rels = {}, {"xl/workbook.xml": "spreadsheetml.sheet.main"}, [], []
    for k, (name, rows) in enumerate(sheets.items(), start=1):
        lines, letters = [], [_column(c) for c in range(max(map(len, rows), default=0))]
        for n, row in enumerate(rows, start=1):
            cells = "".join(f'<c r="{letters[c]}{n}" t="inlineStr"><is><t xml:space="preserve">{_said(v)}</t></is></c>' for c, v in enumerate(row) if v is not None)
            lines.append(f'<row r="{n}">{cells}</row>')
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
        kinds[f"xl/worksheets/sheet{k}.xml"] = "spreadsheetml.worksheet"
        listed.append(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"/>')
        rels.append(f'<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>')
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{"".join(listed)}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{_PACKAGE}/relationships">{"".join(rels)}</Relationships>'
    return _packed(parts, "xl/workbook.xml", kinds)


def _paragraph(text: str | None) -> str:
    return f'<w:p><w:r><w:t xml:space="preserve">{_said(text)}</w:t></w:r></w:p>'


def document(paragraphs: list[str], tables: list[list[list[str | None]]]) -> bytes:
    """A DOCX file: paragraphs, then tables."""
    body = "".join(map(_paragraph, paragraphs))
    for rows in tables:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(v)}</w:tc>" for v in row) + "</w:tr>" for row in rows) + "</w:tbl>"
    return _packed({"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>'}, "word/document.xml", {"word/document.xml": "wordprocessingml.document.main"})
