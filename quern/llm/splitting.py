"""Splitting oversized items at natural boundaries, with overlap between neighbouring pieces.

Recursive bisection: a segment over the limit is cut at the strongest boundary near its midpoint, and the halves
are cut again while they exceed the limit less the overlap; the overlaps are attached last. Boundaries come from
one scan of the whole text, so the work is linear in its length but for the search of the boundary arrays.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A sentence ends at . ! or ?, with a closing quotation mark if there is one, before white space or the end.
SENTENCE_END = re.compile(r"""[.!?]["'”’»]?(?=\s|\Z)""")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:]', re.DOTALL)
_SPACE = re.compile(r"\s+")
#: The middle part of a segment in which a stronger boundary goes before a nearer one.
MIDDLE = 0.5

Boundaries = tuple[list[int], list[int]]


def sentence_boundaries(text: str) -> Boundaries:
    """Ends of sentences inside the text with their strength: 2 where a blank line follows, else 1."""
    n = len(text)
    at = [m.end() for m in SENTENCE_END.finditer(text) if m.end() < n]
    blank = [m.start() for m in _PARAGRAPH.finditer(text)]
    strength = []
    for x in at:
        i = bisect_left(blank, x)
        strength.append(2 if i < len(blank) and not text[x : blank[i]].strip() else 1)
    return at, strength


def chunk_boundaries(payload: str) -> Boundaries:
    """Starts of the objects of the top-level array ``chunks``; braces inside strings don't count, broken ends are read as far as they go."""
    at: list[int] = []
    depth, name, inside = 0, None, False
    for m in _JSON_TOKEN.finditer(payload):
        token = m.group()
        if token[0] == '"':
            if depth == 1:
                name = token
        elif token in "{[":
            if token == "[" and depth == 1 and name == '"chunks"':
                inside = True
            elif token == "{" and inside and depth == 2:
                at.append(m.start())
            depth += 1
        elif token in "}]":
            depth -= 1
            inside = inside and depth >= 2
    return at, [1] * len(at)


def _forced(text: str, low: int, high: int) -> int:
    """A cut inside an indivisible stretch: white space nearest the midpoint, else the midpoint, never before a combining mark."""
    mid = (low + high) // 2
    reach = (high - low) // 4
    before = [m.end() for m in _SPACE.finditer(text, mid - reach, mid + reach)]
    if before:
        return min(before, key=lambda x: abs(x - mid))
    import unicodedata

    while mid > low + 1 and unicodedata.combining(text[mid]):
        mid -= 1
    return mid


def bisect_cuts(text: str, at: list[int], strength: list[int], limit: int, overlap: int) -> tuple[list[int], bool]:
    """Cuts, in order, and whether any fell inside an indivisible stretch."""
    cuts: list[int] = []
    forced = False
    todo = [(0, len(text))]
    while todo:
        low, high = todo.pop()
        if high - low <= limit - overlap:
            continue
        i, j = bisect_right(at, low), bisect_left(at, high)
        if i == j:
            if high - low <= limit:
                continue  # one stretch that fits as it is, with less overlap
            cut = _forced(text, low, high)
            forced = True
        else:
            mid, reach = (low + high) / 2, (high - low) * MIDDLE / 2
            a, b = bisect_left(at, mid - reach, i, j), bisect_right(at, mid + reach, i, j)
            if a < b:
                k = min(range(a, b), key=lambda x: (-strength[x], abs(at[x] - mid)))
            else:
                k = bisect_left(at, mid, i, j)
                k = min((x for x in (k - 1, k) if i <= x < j), key=lambda x: abs(at[x] - mid))
            cut = at[k]
        cuts.append(cut)
        todo += [(low, cut), (cut, high)]
    return sorted(cuts), forced


def pieces_of(text: str, boundaries: Callable[[str], Boundaries], limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], bool]:
    """(start, core start, end) of every piece, and whether a cut was forced."""
    at, strength = boundaries(text)
    cuts, forced = bisect_cuts(text, at, strength, limit, overlap)
    edges = [0, *cuts, len(text)]
    out = []
    for low, high in zip(edges[:-1], edges[1:]):
        start = low
        room = min(overlap, limit - (high - low), low)
        if low and room > 0:
            i = bisect_left(at, low - room)
            start = at[i] if i < len(at) and at[i] < low else low - room
            if start == low - room and not (i < len(at) and at[i] == start):
                m = _SPACE.search(text, start, low)
                start = m.end() if m and m.end() < low else start
        out.append((start, low, high))
    return out, forced


_KINDS = {"sentences": sentence_boundaries, "chunks": chunk_boundaries}


def split_oversized(df: DataFrame, id_column: str, text_column: str, *, limit: int, overlap: int = 200, kind: str = "sentences", texts: bool = True) -> DataFrame:
    """Pieces of the items of ``text_column`` that are longer than ``limit`` code points.

    Result, one row per piece: the id, piece_no from 1, n_pieces, start_char, core_start, end_char, cut_kind and
    (``texts``) piece_text. Without the overlaps [core_start, end_char) the pieces join to the whole text.
    cut_kind is 'forced' for items in which one indivisible stretch alone is longer than the limit, else
    'natural'. Items of exactly the limit, shorter, empty or null ones give no row. Repeated ids are split one
    by one. ``kind`` is 'sentences' for prose or 'chunks' for JSON payloads with an array of chunks; a payload
    without one is one stretch. Nothing is shuffled; only oversized items leave the JVM.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("the overlap must be less than half the limit")
    find = _KINDS[kind]
    items = df.select(F.col(id_column), F.col(text_column).alias("__text")).where(F.char_length("__text") > limit)
    fields = [T.StructField(id_column, df.schema[id_column].dataType)]
    fields += [T.StructField(n, T.IntegerType()) for n in ("piece_no", "n_pieces", "start_char", "core_start", "end_char")]
    fields += [T.StructField("cut_kind", T.StringType())] + ([T.StructField("piece_text", T.StringType())] if texts else [])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            source: list[int] = []
            for r, text in enumerate(batch.column(1).to_pylist()):
                parts, forced = pieces_of(text, find, limit, overlap)
                for k, (start, core, end) in enumerate(parts, 1):
                    source.append(r)
                    values = [k, len(parts), start, core, end, "forced" if forced else "natural"] + ([text[start:end]] if texts else [])
                    for column, v in zip(rows[1:], values):
                        column.append(v)
            ids = batch.column(0).take(pa.array(source, pa.int32()))
            made = [pa.array(c, pa.string() if n in ("cut_kind", "piece_text") else pa.int32()) for n, c in zip(names[1:], rows[1:])]
            yield pa.RecordBatch.from_arrays([ids, *made], names=names)

    return items.mapInArrow(run, T.StructType(fields))
