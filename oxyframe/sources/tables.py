"""Raw cells of delimited and spreadsheet files, all as text."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

from ..errors import SignalError

Cells = list[list[str | None]]


def delimited(body: bytes) -> Cells:
    """Rows of a text file; a tab in the first ten lines makes it tab-separated, else commas.

    Rows are as wide as the widest; shorter ones are filled with None. Quotes protect separators.
    """
    text = body.decode("utf-8-sig", "replace") if not body.startswith((b"\xff\xfe", b"\xfe\xff")) else body.decode("utf-16")
    lines = [re.sub(r'\s*"\s*', '"', line).strip() for line in text.splitlines()]
    sep = "\t" if any("\t" in line for line in lines[:10]) else ","
    rows = [next(csv.reader([line], delimiter=sep), []) for line in lines]
    width = max([len(r) for r in rows] + [1])
    return [[*(c.strip() if c.strip() else None for c in r), *[None] * (width - len(r))] for r in rows]


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def spreadsheet(body: bytes) -> Cells:
    """Rows of an .xlsx file's first sheet, by the standard library."""
    try:
        z = zipfile.ZipFile(io.BytesIO(body))
    except zipfile.BadZipFile:
        raise SignalError("file cannot be opened as a spreadsheet; only .xlsx is supported", "read_recording") from None
    local = lambda e: e.tag.rpartition("}")[2]
    strings: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
            strings.append("".join(t.text or "" for t in item.iter() if local(t) == "t"))
    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    if not sheets:
        raise SignalError("the spreadsheet has no sheet", "read_recording")
    rows: Cells = []
    for row in (e for e in ElementTree.fromstring(z.read(sheets[0])).iter() if local(e) == "row"):
        at = int(row.get("r", len(rows) + 1)) - 1
        rows += [[] for _ in range(at - len(rows) + 1)]
        for cell in row:
            k = _column(cell.get("r", "")) if cell.get("r") else len(rows[at])
            value = next((e.text for e in cell if local(e) == "v"), None)
            if cell.get("t") == "s" and value is not None:
                value = strings[int(value)]
            elif cell.get("t") == "inlineStr":
                value = "".join(e.text or "" for e in cell.iter() if local(e) == "t")
            elif cell.get("t") == "b" and value is not None:
                value = "TRUE" if value == "1" else "FALSE"
            rows[at] += [None] * (k - len(rows[at]) + 1)
            rows[at][k] = value if value else None
    width = max([len(r) for r in rows] + [1])
    return [r + [None] * (width - len(r)) for r in rows]


def cells(body: bytes, name: str) -> Cells:
    """Rows of a file by its name's ending."""
    if re.search(r"\.(csv|tsv|txt)$", name, re.IGNORECASE):
        return delimited(body)
    if re.search(r"\.xlsx?$", name, re.IGNORECASE):
        return spreadsheet(body)
    raise SignalError(f"unsupported file type: {name}; .csv, .tsv, .txt and .xlsx are read", "read_recording")
