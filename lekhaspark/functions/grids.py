"""Tables of HTML pages as grids: each cell at every place that its row and column spans cover, with its text and links."""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

#: Spans beyond this are mistakes of the page.
MOST_SPAN = 1000

# A whole cell without tags, a whole link without tags and the end of a row with the text after it, which is in no cell, are one token each; what else
# there is comes tag by tag. The groups: cell (tag, attributes, text), link (attributes, text), end of a row, script, tag (closing, name, attributes), text.
_VALUES = r"""((?:"[^"]*"|'[^']*'|[^>"']++)*+)>"""
_TOKEN = re.compile(
    rf"<t([dh])(?![a-zA-Z0-9]){_VALUES}([^<]*+)</t[dh]>[^<]*+|<a(?![a-zA-Z0-9]){_VALUES}([^<]*+)</a>|(?:</t[dh]>[^<]*+)?+(</tr>)[^<]*+"
    rf"|<!--.*?-->|<(script|style)\b.*?</\7\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*+){_VALUES}|([^<]+|<)",
    re.S | re.I,
)
_CELL_TOKEN, _LINK_TOKEN, _ROW_END, _TAG, _TEXT = 3, 5, 6, 10, 11
_ATTRIBUTE = {k: re.compile(rf"""(?i)\b{k}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""") for k in ("colspan", "rowspan", "href")}
_BLOCKS = frozenset("p div li br tr td th ul ol h1 h2 h3 h4 h5 h6".split())

_LINK = StructType([StructField("href", StringType()), StructField("label", StringType())])
_CELL = StructType([StructField("text", StringType()), StructField("links", ArrayType(_LINK))])
_ARROW = pa.list_(pa.struct([("table", pa.int32()), ("row", pa.int32()), ("header", pa.bool_()), ("cells", pa.list_(pa.struct([("text", pa.string()), ("links", pa.list_(pa.struct([("href", pa.string()), ("label", pa.string())])))])))]))
GRID = ArrayType(StructType([StructField("table", IntegerType()), StructField("row", IntegerType()), StructField("header", BooleanType()), StructField("cells", ArrayType(_CELL))]))


def attribute(tag: str, name: str) -> str:
    m = _ATTRIBUTE[name].search(tag)
    return html.unescape(m[m.lastindex]).strip() if m else ""


def _span(value: str) -> int:
    return max(1, min(MOST_SPAN, int(value))) if value.isdigit() else 1


@lru_cache(4096)
def _spans(attributes: str) -> tuple[int, int]:
    return _span(attribute(attributes, "colspan")), _span(attribute(attributes, "rowspan"))


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _lines(text: str) -> str:
    return "\n".join(x for x in map(_one_line, text.split("\n")) if x) if "\n" in text else _one_line(text)


class _Table:
    """A table while it is read. `cell`: its texts, links and attributes; `down`: for each column that a cell above still covers, (rows left, cell)."""

    __slots__ = ("number", "rows", "down", "row", "cell", "anchor", "header", "new", "n_rows")

    def __init__(self, number: int):
        self.number, self.rows, self.down, self.row, self.cell, self.anchor, self.n_rows = number, [], {}, None, None, False, 0

    def start_row(self):
        self.end_row()
        self.row, self.header, self.new = [], True, {}
        if self.down:
            self._cover()

    def start_cell(self, heading: bool, attributes: str):
        if self.row is None:
            self.start_row()
        self.end_cell()
        self.header &= heading
        self.cell, self.anchor = ([], [], attributes), False

    def end_cell(self):
        if self.cell is None:
            return
        parts, links, attributes = self.cell
        self.cell = None
        self.place((_lines("".join(parts)), [(h, _one_line("".join(t))) for h, t in links]), *_spans(attributes))

    def place(self, value, across: int, rows: int):
        """A finished cell at its columns, then what reaches down beside it."""
        for _ in range(across):
            if rows > 1:
                self.new[len(self.row)] = rows - 1, value
            self.row.append(value)
        if self.down:
            self._cover()

    def _cover(self):
        while (held := self.down.pop(len(self.row), None)) is not None:
            if held[0] > 1:
                self.new[len(self.row)] = held[0] - 1, held[1]
            self.row.append(held[1])

    def end_row(self):
        if self.row is None:
            return
        self.end_cell()
        if self.row:
            self.rows.append((self.number, self.n_rows, self.header, self.row))
            self.n_rows += 1
        # columns beyond the last cell of a short row stay covered by what reaches down to them
        if self.down or self.new:
            self.down = {k: (n - 1, v) for k, (n, v) in self.down.items() if n > 1} | self.new
        self.row = None


def _rows(page: str) -> list[tuple]:
    """(table, row, header, cells) of all tables, a cell as (text, links), a link as (href, label)."""
    tables: list[_Table] = []
    open_: list[_Table] = []
    table = None
    for m in _TOKEN.finditer(page):
        kind = m.lastindex
        if kind == _CELL_TOKEN:
            if table is not None:
                tag, attributes, text = m.group(1, 2, 3)
                if table.row is None:
                    table.start_row()
                elif table.cell is not None:
                    table.end_cell()
                if tag in "dD":
                    table.header = False
                table.place((_one_line(html.unescape(text)), []), *_spans(attributes))
        elif kind == _TAG:
            closing, tag, attributes = m.group(8, 9, 10)
            tag = tag.lower()
            if tag == "table" and not closing:
                table = _Table(len(tables))
                open_.append(table)
                tables.append(table)
            elif table is None:
                continue
            elif tag == "table":
                table.end_row()
                open_.pop()
                table = open_[-1] if open_ else None
            elif tag == "tr":
                table.end_row() if closing else table.start_row()
            elif tag in ("td", "th"):
                if closing:
                    table.end_cell()
                else:
                    table.start_cell(tag == "th", attributes)
            elif table.cell is not None:
                if tag == "a":
                    href = "" if closing else attribute(attributes, "href")
                    table.anchor = bool(href)
                    if href:
                        table.cell[1].append((href, []))
                elif tag in _BLOCKS:
                    table.cell[0].append("\n")
        elif table is None:
            continue
        elif kind == _ROW_END:
            table.end_row()
        elif table.cell is None:
            continue
        elif kind == _TEXT or kind == _LINK_TOKEN:
            text = html.unescape(m[kind]).replace("\n", " ")
            if kind == _LINK_TOKEN:
                href = attribute(m[4], "href")
                table.anchor = bool(href)
                if href:
                    table.cell[1].append((href, []))
            table.cell[0].append(text)
            if table.anchor:
                table.cell[1][-1][1].append(text)
                table.anchor = kind == _TEXT
    for table in open_:
        table.end_row()
    return [r for t in tables for r in t.rows]


def read_grids(page: str) -> list[dict]:
    """The rows of all tables in the order in which their tables begin; a table inside a cell is a table of its own and no text of the cell."""
    return [{"table": t, "row": n, "header": h, "cells": [{"text": x, "links": [{"href": u, "label": v} for u, v in links]} for x, links in cells]} for t, n, h, cells in _rows(page)]


# What a tag is to a table, by its name; other tags are 0. A page with scripts or styles is read tag by tag.
_TABLE_TAG, _ROW_TAG, _DATA_TAG, _HEAD_TAG, _LINK_TAG, _BLOCK_TAG, _CODE_TAG, _END = range(1, 9)
_NAMES = {"table": _TABLE_TAG, "tr": _ROW_TAG, "td": _DATA_TAG, "th": _HEAD_TAG, "a": _LINK_TAG, "script": _CODE_TAG, "style": _CODE_TAG} | dict.fromkeys(_BLOCKS - {"tr", "td", "th"}, _BLOCK_TAG)
_KEYS = np.array(sorted(int.from_bytes(k.encode(), "little") for k in _NAMES))
_KINDS = np.array([_NAMES[int(k).to_bytes(8, "little").rstrip(b"\0").decode()] for k in _KEYS], np.int8)
# Letters and digits in lower case, 1 for bytes beyond ASCII, 0 for the rest.
_LOWER = np.array([ord(chr(k).lower()) if k < 128 and chr(k).isalnum() else int(k >= 128) for k in range(256)], np.uint8)
# 1 for a space, 2 for what a text has to be looked at for: other blanks, references, bytes beyond ASCII.
_BLANK = np.array([1 if k == 32 else 2 if k >= 128 or chr(k) == "&" or chr(k).isspace() else 0 for k in range(256)], np.uint8)
#: Pages are read together in parts of so many bytes; a longer page is a part of its own.
PART = 1 << 20


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each range, one range after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _utf8(latin: str) -> str:
    return latin if latin.isascii() else latin.encode("latin-1").decode()


class _Part:
    """Plain pages as arrays over all their bytes. `bad`: pages with comments, scripts, stray signs, nested tables or rows that no tag begins; they are read tag by tag."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        n = len(at) - 1
        self.bad = np.zeros(n, bool)
        self.b = b = np.concatenate([raw, np.zeros(8, np.uint8)])
        self._tags(at)
        self._cells()
        self._texts(raw)
        self._links()

    def _tags(self, at):
        b = self.b
        pos, closes = np.flatnonzero(b == 60), np.flatnonzero(b == 62)
        page = np.searchsorted(at, pos, "right") - 1
        found = np.searchsorted(closes, pos)
        stop = np.append(closes, len(b))[found] + 1
        self.bad[page[stop > np.minimum(np.append(pos[1:], len(b)), at[page + 1])]] = True
        closing = b[pos + 1] == 47
        name = pos + 1 + closing
        key, size, letter = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64), np.ones(len(pos), np.uint8)
        for k in range(7):
            letter = np.where(letter > 0, _LOWER[b[np.minimum(name + k, len(b) - 1)]], 0)
            key |= letter.astype(np.int64) << (8 * k)
            size += letter > 0
            self.bad[page[letter == 1]] = True
        first = key & 255
        self.bad[page[(first < 97) | (first > 122)]] = True
        k = np.minimum(np.searchsorted(_KEYS, key), len(_KEYS) - 1)
        kind = np.where(_KEYS[k] == key, _KINDS[k], 0)
        self.bad[page[kind == _CODE_TAG]] = True
        # a sign > in a value ends no tag: quotes of one kind in pairs
        more = np.flatnonzero(stop - name > size + 1)
        single, double = [np.diff(np.searchsorted(np.flatnonzero(b == q), np.stack([pos[more], stop[more]], 1)), axis=1)[:, 0] for q in (39, 34)]
        self.bad[page[more[(single > 0) & (double > 0) | (single % 2 > 0) | (double % 2 > 0)]]] = True
        table = np.flatnonzero(kind == _TABLE_TAG)
        before = np.append(True, closing[table[:-1]] | (page[table[:-1]] != page[table[1:]])) if len(table) else closing[:0]
        self.bad[page[table[before == closing[table]]]] = True
        # each page ends with a mark
        good = ~self.bad[page]
        pos, stop, kind, closing, page, name = pos[good], stop[good], kind[good], closing[good], page[good], name[good] + size[good]
        ends = at[1:][~self.bad]
        here = np.searchsorted(pos, ends)
        put = lambda x, v: np.insert(x, here, v)
        self.pos, self.stop, self.kind, self.closing, self.page, self.name = put(pos, ends), put(stop, ends), put(kind, _END), put(closing, False), put(page, np.flatnonzero(~self.bad)), put(name, ends)

    def _cells(self):
        """Cells, the tags that hold them and where they end; the rows and tables of cells."""
        kind, closing = self.kind, self.closing
        cell = (kind == _DATA_TAG) | (kind == _HEAD_TAG)
        frame = np.flatnonzero(cell | (kind == _TABLE_TAG) | (kind == _ROW_TAG) | (kind == _END))
        k, shut = kind[frame], closing[frame]
        here = np.arange(len(frame))
        last = lambda held: np.append(-1, np.maximum.accumulate(np.where(held, here, -1))[:-1]) if len(frame) else here
        outer = (k == _TABLE_TAG) | (k == _END)
        table, row = last(outer), last(outer | (k == _ROW_TAG))
        inside = (table >= 0) & (k[table] == _TABLE_TAG) & ~shut[table]
        begins = np.flatnonzero(cell[frame] & ~shut & inside)
        rowless = (k[row[begins]] != _ROW_TAG) | shut[row[begins]]
        self.bad[self.page[frame[begins[rowless]]]] = True
        begins = begins[~self.bad[self.page[frame[begins]]]]
        self.cell, self.cell_end = frame[begins], frame[begins + 1]
        self.row, self.table, self.heading = frame[row[begins]], frame[table[begins]], k[begins] == _HEAD_TAG
        rows = np.flatnonzero((k == _ROW_TAG) & ~shut & inside)
        self.all_rows, self.all_tables = frame[rows], frame[table[rows]]
        opened = np.cumsum((kind == _TABLE_TAG) & ~closing)
        first = np.searchsorted(self.page, self.page)
        # tables of the page before this one
        self.number = opened - opened[first] + ((kind[first] == _TABLE_TAG) & ~closing[first]) - 1 if len(kind) else opened

    def _texts(self, raw):
        """The bytes of all cells one after the other, without tags; a tag of a block is a line end."""
        n = len(self.cell)
        b = np.where(self.b == 10, np.uint8(32), self.b)
        starts, ends = self.stop[self.cell], self.pos[self.cell_end]
        count = self.cell_end - self.cell - 1
        inner = _places(self.cell + 1, count)
        block = self.kind[inner] == _BLOCK_TAG
        b[self.pos[inner[block]]] = 10
        step = np.zeros(len(b) + 1, np.int8)
        step[starts] += 1
        step[ends] -= 1
        step[self.pos[inner] + block] -= 1
        step[self.stop[inner]] += 1
        kept = np.cumsum(step[:-1], dtype=np.int8).view(bool)
        self.text = text = b[kept]
        self.upto = np.append(0, np.cumsum(kept, dtype=np.int32))
        self.offsets = np.append(self.upto[starts], len(text)).astype(np.int32)
        self.inner, self.inner_cell = inner, np.repeat(np.arange(n), count)
        blank = _BLANK[text]
        self.look = np.flatnonzero((blank == 2) | (blank == 1) & (np.append(blank[1:], 1) == 1))
        odd = np.zeros(n, bool)
        odd[np.searchsorted(self.offsets, self.look, "right") - 1] = True
        full = self.offsets[1:] > self.offsets[:-1]
        odd[full] |= (blank[self.offsets[:-1][full]] == 1) | (blank[self.offsets[1:][full] - 1] == 1)
        self.odd = np.flatnonzero(odd)
        # references are read piece by piece, so a text of pieces is left to the other reader
        amp = np.searchsorted(self.offsets, np.flatnonzero(text == 38), "right") - 1
        self.bad[self.page[self.cell[amp[count[amp] > 0]]]] = True

    def _links(self):
        b = self.b
        a = self.kind[self.inner] == _LINK_TAG
        tag, cell = self.inner[a], self.inner_cell[a]
        after = np.minimum(np.append(self.pos[tag[1:]], len(b)), self.pos[self.cell_end[cell]])
        opened = ~self.closing[tag]
        tag, cell, after = tag[opened], cell[opened], after[opened]
        start, stop = self.name[tag], self.stop[tag] - 1
        # most links have one value and nothing else: in quotes, or without blanks
        common, quote = stop - start > 8, b[np.minimum(start + 6, len(b) - 1)]
        for k, c in enumerate(b" href="):
            common &= (b[np.minimum(start + k, len(b) - 1)] | (32 if k in (1, 2, 3, 4) else 0)) == c
        quoted = (quote == 39) | (quote == 34)
        marks = lambda held: (lambda x: np.searchsorted(x, stop) - np.searchsorted(x, start + 6))(np.flatnonzero(held))
        strange = _BLANK > 0
        plain = marks(strange[b]) == 0
        n_quotes = marks((b == 39) | (b == 34))
        common &= plain & np.where(quoted, (n_quotes == 2) & (b[stop - 1] == quote), n_quotes == 0)
        # one character for each byte, so slices of ASCII are right
        raw = b.tobytes().decode("latin-1")
        href = np.empty(len(tag), object)
        first, last = np.where(common, start + 6 + quoted, start), np.where(common, stop - quoted, stop)
        href[:] = [raw[x:y] for x, y in zip(first.tolist(), last.tolist())]
        for k in np.flatnonzero(~common).tolist():
            href[k] = attribute(_utf8(href[k]), "href")
        held = np.flatnonzero(href != "")
        tag, cell, after, self.href = tag[held], cell[held], after[held], href[held].tolist()
        x, y = self.upto[self.stop[tag]], self.upto[after]
        within = lambda places: (lambda n: n[:, 0] < n[:, 1])(np.searchsorted(places, np.stack([x, y], 1)))
        self.bad[self.page[tag[within(np.flatnonzero(self.text == 10))]]] = True
        text, blank = self.text.tobytes().decode("latin-1"), np.append(_BLANK[self.text], 0)
        self.label = [text[i:j] for i, j in zip(x.tolist(), y.tolist())]
        for k in np.flatnonzero(within(self.look) | (x < y) & ((blank[x] > 0) | (blank[y - 1] > 0))).tolist():
            self.label[k] = _one_line(_utf8(self.label[k]))
        self.link_cell = cell

    def spans(self) -> dict[int, tuple[int, int]]:
        """Cells that cover more than their place."""
        held = np.flatnonzero((self.stop[self.cell] - 1 > self.name[self.cell]) & ~self.bad[self.page[self.cell]])
        tag = self.cell[held]
        raw = self.b.tobytes().decode("latin-1")
        found = {c: _spans(_utf8(raw[i:j])) for c, i, j in zip(held.tolist(), self.name[tag].tolist(), (self.stop[tag] - 1).tolist())}
        return {c: v for c, v in found.items() if v != (1, 1)}


def _part(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Rows of each page and the rows."""
    p = _Part(raw, at)
    n = len(p.cell)
    good = ~p.bad[p.page[p.cell]]
    wide = p.spans()
    spanned = np.isin(p.table, p.table[list(wide)]) if wide else np.zeros(n, bool)
    # rows without spans: their cells stand one after the other
    own = np.flatnonzero(good & ~spanned)
    first = np.flatnonzero(np.append(True, p.row[own][1:] != p.row[own][:-1])) if len(own) else own
    start, count = own[first], np.diff(np.append(first, len(own)))
    table = p.table[start]
    place = np.arange(len(start)) - np.searchsorted(table, table)
    header = np.logical_and.reduceat(p.heading[own], first) if len(own) else p.heading[:0]
    page, number = p.page[p.cell[start]], p.number[table]
    texts = _strings(p.offsets, p.text, p.odd)
    links, hrefs, labels = np.bincount(p.link_cell, minlength=n), p.href, p.label
    flat, more = [np.arange(n)], []
    # tables with spans: each row's cells by number
    if wide:
        lines = np.flatnonzero(np.isin(p.all_tables, p.table[list(wide)]) & ~p.bad[p.page[p.all_rows]])
        c0, c1 = np.searchsorted(p.row, p.all_rows[lines]), np.searchsorted(p.row, p.all_rows[lines], "right")
        made, held, heads = [], None, np.append(0, np.cumsum(p.heading)).tolist()
        for t, i, j in zip(p.all_tables[lines].tolist(), c0.tolist(), c1.tolist()):
            if t != held:
                held, one = t, _Table(t)
            one.start_row()
            for c in range(i, j):
                if c in wide:
                    one.place(c, *wide[c])
                else:
                    one.row.append(c)
                    if one.down:
                        one._cover()
            one.header = heads[j] - heads[i] == j - i
            one.end_row()
            if one.rows:
                made.append(one.rows.pop())
        flat.append(np.array([c for r in made for c in r[3]], np.int64))
        own_table = np.array([r[0] for r in made], np.int64)
        more.append((p.page[own_table], p.number[own_table], [r[1] for r in made], [r[2] for r in made], [len(r[3]) for r in made]))
    # other pages, tag by tag
    bad = np.flatnonzero(p.bad)
    if len(bad):
        made = [(k, *r) for k in bad.tolist() for r in _rows(raw[at[k] : at[k + 1]].tobytes().decode())]
        extra = list({id(c): c for r in made for c in r[4]}.values())
        seen = {id(c): k for k, c in enumerate(extra)}
        flat.append(n + np.array([seen[id(c)] for r in made for c in r[4]], np.int64))
        more.append(tuple([r[k] for r in made] for k in range(4)) + ([len(r[4]) for r in made],))
        texts = pa.concat_arrays([texts, pa.array([c[0] for c in extra], pa.string())])
        links = np.append(links, [len(c[1]) for c in extra]).astype(np.int64)
        hrefs, labels = hrefs + [u for c in extra for u, _ in c[1]], labels + [v for c in extra for _, v in c[1]]
    page, number, place, header, sizes = [np.concatenate([x, *[np.asarray(m[k], x.dtype) for m in more]]) for k, x in enumerate((page, number, place, header, count))]
    flat_start = np.append(start, n + np.cumsum(sizes[len(start) :]) - sizes[len(start) :])
    order = np.lexsort((place, number, page))
    cells = np.concatenate(flat)[_places(flat_start[order], sizes[order])]
    ends = lambda x: pa.array(np.append(0, np.cumsum(x)), pa.int32())
    struct = lambda **x: pa.StructArray.from_arrays(list(x.values()), list(x))
    held = pa.ListArray.from_arrays(ends(links), struct(href=pa.array(hrefs, pa.string()), label=pa.array(labels, pa.string())))
    if len(cells) != len(texts) or (cells != np.arange(len(cells))).any():
        texts, held = texts.take(pa.array(cells)), held.take(pa.array(cells))
    out = struct(table=pa.array(number[order], pa.int32()), row=pa.array(place[order], pa.int32()), header=pa.array(header[order]), cells=pa.ListArray.from_arrays(ends(sizes[order]), struct(text=texts, links=held)))
    return np.bincount(page, minlength=len(at) - 1), out


def _strings(offsets: np.ndarray, text: np.ndarray, odd: np.ndarray) -> pa.Array:
    """Texts by their bytes; the odd ones are put in order."""
    found = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text)))
    if not len(odd):
        return found
    raw = text.tobytes().decode("latin-1")
    mended = pa.array([_lines(html.unescape(_utf8(raw[i:j]))) for i, j in zip(offsets[odd].tolist(), offsets[odd + 1].tolist())], pa.string())
    place = np.arange(len(offsets) - 1)
    place[odd] = len(place) + np.arange(len(odd))
    return pa.concat_arrays([found, mended]).take(pa.array(place))


@F.arrow_udf(GRID)
def grids(pages: pa.Array) -> pa.Array:
    """Rows of the tables of a page; a null page has none."""
    pages = pages.fill_null("")
    if not len(pages):
        return pa.array([], _ARROW)
    at = np.frombuffer(pages.buffers()[1], np.int32)[pages.offset : pages.offset + len(pages) + 1].astype(np.int64)
    raw = np.frombuffer(pages.buffers()[2] or b"", np.uint8)
    counts, rows, k = [], [], 0
    while k < len(pages):
        to = max(k + 1, int(np.searchsorted(at, at[k] + PART, "right")) - 1)
        n, found = _part(raw[at[k] : at[to]], at[k : to + 1] - at[k])
        counts.append(n)
        rows.append(found)
        k = to
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(counts))), pa.int32()), pa.concat_arrays(rows))
