"""Several values packed in one field: one value per row, with its position.

The scan works on the bytes of an Arrow string column, a whole batch at a time: masks for delimiters,
quotes and known names are computed with array operations, the parity of the quotes tells what is
quoted, child offsets are derived from the masks, and a list array is built and flattened with the
ordinals of its parents. No text is touched row by row, nothing is shuffled, and a batch needs a few
bytes of memory for each byte of text, so the work per task is bounded by the size of its batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Single-byte delimiters. The word "and" and the ideographic comma are delimiters as well.
DELIMITERS = ",;|/\n\t&"
WORD_DELIMITERS = ("and",)
#: Brackets around a whole list; they never belong to a value.
LIST_BRACKETS = "[]{}"
#: More reference names than this are not shipped to the workers.
MAX_NAMES = 100_000

_OPAQUE = re.compile(r"[,;|/\n\t&、\[\]{}]|\band\b")
_LETTERS = frozenset(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
_WHOLE_QUOTED = r'^\s*"(?:[^"]|"")*""(?:[^"]|"")*"\s*$'


class Protected:
    """Names that hold a delimiter themselves, found in one pass over the bytes whatever their number."""

    def __init__(self, names: Iterable[str]) -> None:
        self.found = ahocorasick.Automaton()
        for n in {n for n in names if n and _OPAQUE.search(n)}:
            key = n.encode().decode("latin-1")  # a character for each byte
            self.found.add_word(key, len(key))
        self.empty = not len(self.found)
        if not self.empty:
            self.found.make_automaton()

    def spans(self, data: bytes) -> Iterator[tuple[int, int]]:
        """Start and end of the names that no letter or digit continues: from left to right, the longest, without overlap."""
        text = data.decode("latin-1")
        hits = ((end + 1 - length, end + 1) for end, length in self.found.iter(text))
        whole = sorted((a, -b) for a, b in hits if not (a and text[a - 1] in _LETTERS) and not text[b : b + 1] in _LETTERS)
        reach = 0
        for a, b in whole:
            if a >= reach:
                yield a, -b
                reach = -b


def protected_pattern(names: Iterable[str]) -> Protected | None:
    """The names that have to be protected; None if there are none."""
    made = Protected(names)
    return None if made.empty else made


def _prepared(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, each ended by NUL, and the start of each row."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    text = pc.replace_substring(text, "\0", " ")
    for mark in "“”«»":
        text = pc.replace_substring(text, mark, '"')
    text = pc.replace_substring(text, "、", ",")
    whole = pc.match_substring_regex(text, _WHOLE_QUOTED)
    if pc.any(whole).as_py():
        # a field of a delimited file kept as it was: one outer pair of quotes, inner quotes doubled
        bare = pc.replace_substring(pc.utf8_slice_codeunits(pc.utf8_trim_whitespace(text), 1, -1), '""', '"')
        text = pc.if_else(whole, bare, text)
    text = pc.binary_join_element_wise(text, pa.scalar("\0", pa.large_string()), pa.scalar("", pa.large_string()))
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _class(chars: str) -> np.ndarray:
    known = np.zeros(256, dtype=bool)
    known[list(chars.encode())] = True
    return known


_IS_DELIMITER, _IS_BRACKET, _IS_SPACE = _class(DELIMITERS), _class(LIST_BRACKETS), _class(" \n\t\r\x0b\x0c")
_IS_EDGE = _class(DELIMITERS + LIST_BRACKETS + " \r\0()\"")


def _shifted(mask: np.ndarray, by: int) -> np.ndarray:
    """mask[i - by], with the value of a text's edge beyond the ends."""
    out = np.ones_like(mask)
    if by > 0:
        out[by:] = mask[:-by]
    else:
        out[:by] = mask[-by:]
    return out


def split_array(column: pa.Array, protect: Protected | None = None) -> pa.ListArray:
    """One list of values per row; null, blank and empty rows give empty lists."""
    rows = len(column)
    if not rows:
        return pa.array([], pa.list_(pa.string()))
    data, starts = _prepared(column)
    n = len(data)
    row_of = np.repeat(np.arange(rows), np.diff(starts))

    # quotes: double ones anywhere, single ones only at the edge of a slot (else they are apostrophes)
    edge = _IS_EDGE[data]
    single = (data == 0x27) & (_shifted(edge, 1) | _shifted(edge, -1))
    quote = (data == 0x22) | single
    if quote.any():
        single_count = np.bincount(row_of, weights=single, minlength=rows)
        single &= (single_count % 2 == 0)[row_of]
        quote = (data == 0x22) | single
        running = np.cumsum(quote)
        before = np.concatenate(([0], running))[starts[:-1]]
        balanced = (np.concatenate(([0], running))[starts[1:]] - before) % 2 == 0
        quoted = ((running - before[row_of]) % 2 == 1) & balanced[row_of]
    else:
        quoted = np.zeros(n, dtype=bool)

    kept = np.zeros(n + 1, dtype=np.int32)
    if protect is not None:
        for a, b in protect.spans(data.tobytes()):
            kept[a] += 1
            kept[b] -= 1
    kept = np.cumsum(kept[:-1]) > 0

    delimiter = _IS_DELIMITER[data]
    space = _IS_SPACE[data]
    nbsp = (data[:-1] == 0xC2) & (data[1:] == 0xA0)
    space[:-1] |= nbsp
    space[1:] |= nbsp
    parted = space | delimiter | quote | (data == 0)
    for word in WORD_DELIMITERS:
        w = np.frombuffer(word.encode(), dtype=np.uint8)
        if n >= len(w):
            hit = np.ones(n, dtype=bool)
            for i, byte in enumerate(w):
                hit &= np.concatenate((data[i:] == byte, np.zeros(i, dtype=bool)))
            hit &= _shifted(parted, 1) & _shifted(parted, -len(w))
            for i in range(len(w)):
                delimiter |= _shifted(hit, i) if i else hit
            if n:
                delimiter[: len(w)] &= hit[0] | _IS_DELIMITER[data[: len(w)]]
    delimiter |= _IS_BRACKET[data]
    delimiter &= ~quoted & ~kept
    delimiter |= (quote & ~kept) | (data == 0)

    # slots lie between delimiters; a value runs from the first to the last visible byte of its slot
    solid = np.flatnonzero(~delimiter & ~space)
    slot = np.cumsum(delimiter)[solid]
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(solid) else solid
    begin, end = solid[first], solid[np.concatenate((first[1:] - 1, [len(solid) - 1]))] + 1 if len(solid) else solid
    length = end - begin
    offsets = np.concatenate(([0], np.cumsum(length)))
    take = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], length)
    values = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[take])))
    child = np.searchsorted(begin, starts).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(child, pa.int32()), values.cast(pa.string()))


def split_packed(df: DataFrame, column: str, *, names: Sequence[str] = (), value: str = "value", position: str = "pos", count: str | None = None) -> DataFrame:
    """One row per value packed in ``column``, with all other columns, the value and its position from 1.

    Slots are parted by ``, ; | /``, line breaks, tabs, ``&``, ``and``, the ideographic comma and the edges
    of quotes; what is quoted is kept whole, and so is an unquoted occurrence of one of ``names`` (the
    reference list, bounded by MAX_NAMES) that holds a delimiter. Surrounding blanks, quotes and list
    brackets are removed. Empty slots are not counted; repeated values keep their own positions.
    Null, empty and blank fields and fields of delimiters alone give no row. Unbalanced quotes are taken
    as plain delimiters. ``count`` names a column for the number of values in the field.
    Columns of the input that are named like an output column are replaced.
    """
    if len(names) > MAX_NAMES:
        raise ValueError(f"{len(names)} names; at most {MAX_NAMES} can be shipped to the workers")
    made = [position, value] + ([count] if count else [])
    source = "__packed_source"
    kept = [c for c in df.columns if c not in made]
    df = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").cast("string").alias(source))
    fields = [f for f in df.schema.fields if f.name != source]
    schema = T.StructType([*fields, T.StructField(position, T.IntegerType(), False), T.StructField(value, T.StringType(), False), *([T.StructField(count, T.IntegerType(), False)] if count else [])])
    listed = tuple(names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        protect = protected_pattern(listed)
        for batch in batches:
            at = batch.schema.get_field_index(source)
            lists = split_array(batch.column(at), protect)
            parent = pc.list_parent_indices(lists)
            child = np.asarray(lists.offsets)
            of = np.asarray(parent).astype(np.int64)
            out = [batch.column(i).take(parent) for i in range(batch.num_columns) if i != at]
            out.append(pa.array((np.arange(len(of)) - child[of] + 1).astype(np.int32)))
            out.append(pc.list_flatten(lists))
            if count:
                out.append(pa.array(np.diff(child)[of].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(out, names=[*kept, *made])

    return df.mapInArrow(scan, schema)
