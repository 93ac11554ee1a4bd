"""Fields that hold several values, split into one value per row with its position.

Quoted spans are replaced by indexed placeholders, the rest is split at the delimiters, and the spans return
by lookup. Placeholders are written with private-use characters; where a cell has such characters itself they are
escaped first and restored last, so no text can be taken for a placeholder.

The work is done on Arrow batches in Python: numbering the spans of a cell and telling its value delimiter are
steps in sequence, which Catalyst could only express as nested lambdas, interpreted and evaluated anew for every use.
Nothing shuffles, and a batch is cut into blocks by size, so very long cells do not pile up.

A cell holds listings, a listing holds values. Line breaks, their markup, ';' and '|' end a listing, except that in
a cell whose values are themselves separated by ';' or '|' that character separates values only.

Defined results: null, empty and blank cells give no rows; blank listings are not counted; an unclosed quote is ordinary text;
quotes around a whole listing are taken off; a doubled quote inside quotes is one quote; repeated rows are split each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, OPEN_ENTITY, CLOSE_ENTITY, ESCAPE = "\ue000", "\ue001", "\ue002", "\ue003"
RESERVED = re.compile(f"[{MARK}-{ESCAPE}]")
ESCAPED = re.compile(f"{ESCAPE}([0-3])")
ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|nbsp|amp|lt|gt|quot|apos|ndash|mdash);")
HIDDEN_ENTITY = re.compile(f"{OPEN_ENTITY}([^{CLOSE_ENTITY}]*){CLOSE_ENTITY}")
QUOTED = re.compile(r'"((?:[^"]|"")*)"')
PLACEHOLDER = re.compile(f"{MARK}([0-9]+){MARK}")
ONLY_PLACEHOLDER = re.compile(f"\\s*{MARK}([0-9]+){MARK}\\s*")
LINE_BREAK = re.compile(r"<br\s*/?\s*>|[\r\n]+", re.IGNORECASE)
TWICE = re.compile(r"([;|])[^;|\n]*\1")
STRETCH = re.compile(r"[\n;|]")
LISTING_ENDS = {";": re.compile(r"[\n|]"), "|": re.compile(r"[\n;]")}


class Spans:
    """Quoted spans of one text, hidden behind their indexes."""

    def __init__(self, text: str) -> None:
        self.kept: list[str] = []
        self.hidden = QUOTED.sub(self._hide, text) if '"' in text else text

    def _hide(self, found: re.Match) -> str:
        self.kept.append(found[1])
        return f"{MARK}{len(self.kept) - 1}{MARK}"

    def whole(self, piece: str) -> str | None:
        """The inside of the span that is all of ``piece``; None if it is not one span."""
        found = ONLY_PLACEHOLDER.fullmatch(piece) if self.kept else None
        return self.kept[int(found[1])].replace('""', '"') if found else None

    def show(self, piece: str) -> str:
        if not self.kept or MARK not in piece:
            return piece
        return PLACEHOLDER.sub(lambda found: f'"{self.kept[int(found[1])]}"', piece)


def value_delimiter(spans: Spans) -> str | None:
    """The character between the values of a cell's listings; None if no listing has more than one value.

    A comma or tab outside quotes decides. Otherwise ';' or '|' separates values where it occurs twice around one
    value, unless the quotes enclose whole listings: then the quoted text decides.
    """
    bare = spans.hidden
    if "," in bare:
        return ","
    if "\t" in bare:
        return "\t"
    if spans.kept:
        open_stretches = sum(bool(s.strip()) and not ONLY_PLACEHOLDER.fullmatch(s) for s in STRETCH.split(bare))
        for char in (",", "\t", ";", "|"):
            wide = sum(s.count(char) >= 2 for s in spans.kept)
            if wide and wide >= open_stretches:
                return char
    found = TWICE.search(bare)
    return found[1] if found else None


def plain(value: str) -> str:
    """Entities decoded, runs of white space made one, ends trimmed."""
    if OPEN_ENTITY in value:
        value = HIDDEN_ENTITY.sub(lambda found: html.unescape(f"&{found[1]};"), value)
    if ESCAPE in value:
        value = ESCAPED.sub(lambda found: chr(ord(MARK) + int(found[1])), value)
    return " ".join(value.split())


def split_listing(listing: str, delimiter: str | None, spans: Spans) -> list[str]:
    """Plain values of one listing in order."""
    inside = spans.whole(listing)
    if inside is not None and delimiter and delimiter in inside:
        spans = Spans(inside)
        listing = spans.hidden
    values = []
    for piece in listing.split(delimiter) if delimiter else [listing]:
        inside = spans.whole(piece)
        values.append(plain(spans.show(piece) if inside is None else inside))
    return values


def split_cell(cell: str | None) -> list[list[str]]:
    """The listings of a cell, each as its plain values."""
    if not cell or not cell.strip():
        return []
    cell = RESERVED.sub(lambda found: f"{ESCAPE}{ord(found[0]) - ord(MARK)}", cell)
    if "&" in cell:
        cell = ENTITY.sub(lambda found: f"{OPEN_ENTITY}{found[1]}{CLOSE_ENTITY}", cell)
    spans = Spans(LINE_BREAK.sub("\n", cell))
    delimiter = value_delimiter(spans)
    ends = LISTING_ENDS.get(delimiter, STRETCH)
    return [split_listing(s, delimiter, spans) for s in ends.split(spans.hidden) if s.strip()]


def listings(frame: DataFrame, id_column: str, cell_column: str) -> DataFrame:
    """(id, pos, values): each listing of each cell, counted from 1, and its plain values in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, positions, values, size = [], [], [], 0
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for pos, listing in enumerate(split_cell(cell), 1):
                    ids.append(key)
                    positions.append(pos)
                    values.append(listing)
                size += len(cell or "")
                if size > 4_000_000:
                    yield _block(ids, positions, values)
                    ids, positions, values, size = [], [], [], 0
            if ids:
                yield _block(ids, positions, values)

    return frame.select(frame[id_column].cast("long").alias("id"), frame[cell_column].alias("cell")).mapInArrow(run, "id long, pos int, values array<string>")


def _block(ids: list, positions: list, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(positions, pa.int32()), pa.array(values, pa.list_(pa.string()))], names=["id", "pos", "values"])


def unpacked(frame: DataFrame, id_column: str, cell_column: str) -> DataFrame:
    """(id, pos, at, value): one value per row, with the listing's position in the cell and the value's in the listing, both from 1."""
    return listings(frame, id_column, cell_column).select("id", "pos", F.posexplode("values").alias("at", "value")).select("id", "pos", (F.col("at") + 1).cast("int").alias("at"), "value")


def three_part(frame: DataFrame, id_column: str, cell_column: str, names: tuple[str, str, str]) -> DataFrame:
    """(id, pos, first, middle, last) of each listing that has all three; a middle that was split is joined by ', '."""
    rows = listings(frame, id_column, cell_column).filter(F.size("values") >= 3)
    return rows.select("id", "pos", F.element_at("values", 1).alias(names[0]), _middle().alias(names[1]), F.element_at("values", -1).alias(names[2])).filter(
        (F.col(names[0]) != "") & (F.col(names[1]) != "") & (F.col(names[2]) != "")
    )


def _middle() -> Column:
    return F.array_join(F.array_compact(F.expr("transform(slice(values, 2, size(values) - 2), v -> nullif(v, ''))")), ", ")
