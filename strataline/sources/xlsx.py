"""Workbooks without a library: inline-string sheets written and read a row at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

#: Limits of the format, sheet names and the columns of overflow sheets.
MAX_ROWS, MAX_COLUMNS, MAX_UNITS = 1_048_576, 16_384, 32_767
DATA_SHEET, TEXT_SHEET = "Dane_{}", "Dlugie_teksty_{}"
OVERFLOW_COLUMNS = ("overflow_id", "data_sheet", "data_row", "source_line", "column", "value_type", "part", "parts", "text")
MARKER = "[[OVERFLOW:{}]]"
MARKED = re.compile(r"\[\[(?:[A-Z]+_)?OVERFLOW:([0-9]+)\]\]")
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_UNSAFE = re.compile(r"[\x00-\x08\x0b-\x1f￾￿]|_x(?=[0-9A-Fa-f]{4}_)")
_CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def column_name(index: int) -> str:
    """A, B, ... of a column from 0."""
    out = ""
    index += 1
    while index:
        index, digit = divmod(index - 1, 26)
        out = chr(65 + digit) + out
    return out


def cell(row: int, column: int, value) -> str:
    """XML of a cell; text is inline and never a formula or link. None is a blank cell only in column 0."""
    at = f"{column_name(column)}{row}"
    if value is None:
        return f'<c r="{at}"/>' if column == 0 else ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    text = _UNSAFE.sub(lambda m: "_x005F_x" if len(m[0]) > 1 else f"_x{ord(m[0]):04X}_", str(value))
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text, {chr(10): "&#10;"})}</t></is></c>'


def row_xml(row: int, values: Iterable) -> str:
    return f'<row r="{row}">' + "".join(cell(row, k, v) for k, v in enumerate(values)) + "</row>"


SHEET_HEAD = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'
SHEET_TAIL = "</sheetData></worksheet>"


def workbook(out, sheets: list[tuple[str, Iterable[bytes]]]) -> None:
    """Writes a workbook of named sheets to a binary file, from chunks of their XML."""
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
    names = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, (n, _) in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    package = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for k, (_, chunks) in enumerate(sheets, 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as f:
                for chunk in chunks:
                    f.write(chunk)


def _plain(text: str) -> str:
    return _CODED.sub(lambda m: chr(int(m[1], 16)), text)


def sheet_names(z: zipfile.ZipFile) -> dict[str, str]:
    """Archive member of each sheet by name."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    rid = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{{{_MAIN}}}sheets")
    return {s.get("name"): "xl/" + links[s.get(rid)].removeprefix("/xl/") for s in sheets}


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return [_plain("".join(t.text or "" for t in si.iter(f"{{{_MAIN}}}t"))) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]


def rows(z: zipfile.ZipFile, member: str, strings: list[str]) -> Iterator[list]:
    """Values of each row; gaps are None."""
    with z.open(member) as f:
        for _, node in ElementTree.iterparse(f, events=("end",)):
            if node.tag != f"{{{_MAIN}}}row":
                continue
            out: list = []
            for c in node:
                letters = re.match("[A-Z]+", c.get("r", "A"))[0]
                place = 0
                for letter in letters:
                    place = place * 26 + ord(letter) - 64
                out += [None] * (place - len(out))
                kind, v = c.get("t"), c.find(f"{{{_MAIN}}}v")
                if kind == "inlineStr":
                    out[place - 1] = _plain("".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t")))
                elif v is not None and v.text is not None:
                    out[place - 1] = strings[int(v.text)] if kind == "s" else v.text == "1" if kind == "b" else _plain(v.text) if kind == "str" else float(v.text) if re.search("[.eEn]", v.text) else int(v.text)
            node.clear()
            yield out


def numbered(names: Iterable[str], pattern: str) -> list[str]:
    """Sheets of a pattern, in the order of their numbers."""
    rx = re.compile(re.escape(pattern).replace(r"\{\}", "([0-9]+)"))
    return sorted(filter(rx.fullmatch, names), key=lambda n: int(rx.fullmatch(n)[1]))


def overflow_texts(z: zipfile.ZipFile, strings: list[str]) -> dict[int, str]:
    """Long texts by id; raises if parts are missing."""
    names, found = sheet_names(z), {}
    for sheet in numbered(names, TEXT_SHEET):
        source = rows(z, names[sheet], strings)
        next(source, None)
        for r in source:
            record = dict(zip(OVERFLOW_COLUMNS, [*r, *[None] * 9], strict=False))
            found.setdefault(int(record["overflow_id"]), {})[int(record["part"])] = (int(record["parts"]), record["text"] or "")
    for number, parts in found.items():
        if sorted(parts) != list(range(1, next(iter(parts.values()))[0] + 1)):
            raise ValueError(f"overflow {number} lacks parts")
    return {number: "".join(parts[k][1] for k in sorted(parts)) for number, parts in found.items()}


def records(source) -> Iterator[dict]:
    """Records of a workbook's data sheets in order, long texts put back; source is a seekable binary file, or bytes."""
    with zipfile.ZipFile(io.BytesIO(source) if isinstance(source, bytes) else source) as z:
        strings, names = shared_strings(z), sheet_names(z)
        texts = overflow_texts(z, strings)
        for sheet in numbered(names, DATA_SHEET):
            source = rows(z, names[sheet], strings)
            head = next(source, [])
            for r in source:
                out = dict(zip(head, [*r, *[None] * (len(head) - len(r))], strict=False))
                for k, v in out.items():
                    if isinstance(v, str) and (m := MARKED.fullmatch(v)):
                        if int(m[1]) not in texts:
                            raise ValueError(f"overflow {m[1]} isn't in the workbook")
                        out[k] = texts[int(m[1])]
                yield out
