"""Several values packed in one text field -> one row per value, with its position.

The scan works on whole Arrow string buffers: byte masks of quotes and delimiters, pairing of structural quotes, value
starts and ends as offset arrays, and a flattening by parent ordinals. No Python loop runs over rows or values.

A value starts with ``http://`` or ``https://`` at the begin of the field or behind a delimiter, with or without an opening
quote; such a start elsewhere, as in ``?u=https://...``, belongs to the value around it. Delimiters are white space,
``|``, ``;``, ``,``, ``@!#`` and ``@@!!##``, in any mixture and number. Between paired quotes nothing delimits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_SPACE, _QUOTE, _DELIM, _DIGIT, _MARK = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
for _c in b" \t\n\r\x0b\x0c":
    _CLASS[_c] = _SPACE
for _c in b"\"'":
    _CLASS[_c] = _QUOTE
for _c in b"|;,":
    _CLASS[_c] = _DELIM
for _c in b"0123456789":
    _CLASS[_c] = _DIGIT
#: Bytes that may stand between a url and its count besides ``@!#`` and blanks.
for _c in b":=":
    _CLASS[_c] = _MARK

LINK, POSTING = "link", "posting"


def _find(data: np.ndarray, text: bytes) -> np.ndarray:
    """Positions at which ``text`` begins."""
    n = len(data) - len(text) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at = np.flatnonzero(data[:n] == text[0])
    for k, b in enumerate(text[1:], 1):
        at = at[data[at + k] == b]
    return at


def _last(mask: np.ndarray) -> np.ndarray:
    """For each position the last position up to it at which ``mask`` holds, or -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask), dtype=np.int64), -1))


def split_values(data: np.ndarray, offsets: np.ndarray, kind: str) -> dict[str, np.ndarray]:
    """Values of every row of a string buffer.

    ``data``: bytes of all rows; ``offsets``: row boundaries. Returns arrays with one entry per value: ``row``, ``pos``
    (from 0 in its row), ``start`` and ``end`` of the url, and for postings ``digits`` and ``digits_end`` of the count
    (equal where there is none).
    """
    none = np.empty(0, np.int64)
    rows, size = len(offsets) - 1, len(data)
    starts = np.union1d(_find(data, b"http://"), _find(data, b"https://"))
    if not len(starts):
        return {"row": none, "pos": none, "start": none, "end": none, "digits": none, "digits_end": none}
    cls = _CLASS[data]
    token = np.zeros(size, bool)
    for t in (b"@!#", b"@@!!##"):
        at = _find(data, t)
        for k in range(len(t)):
            token[at + k] = True
    free = ((cls & (_SPACE | _DELIM)) != 0) | token
    row_of = np.searchsorted(offsets, starts, side="right") - 1
    first = offsets[row_of]

    def bounded(before: np.ndarray) -> np.ndarray:
        """Whether the byte at ``before`` is outside of the row or delimits."""
        return (before < first) | free[np.maximum(before, 0)]

    # an opening quote may stand right before a value, blanks between them allowed
    quote_at = starts - 1
    opened = (quote_at >= first) & ((cls[np.maximum(quote_at, 0)] & _QUOTE) != 0)
    opened &= bounded(quote_at - 1)
    ok = opened | bounded(starts - 1)
    starts, row_of, opened = starts[ok], row_of[ok], opened[ok]

    # quote pairs: the closing quote is the first of its kind with a delimiter, mark, count or row end behind it
    close = np.full(len(starts), -1, np.int64)
    if opened.any():
        row_end = offsets[row_of + 1]
        q = np.flatnonzero((cls & _QUOTE) != 0)
        q_end = offsets[np.searchsorted(offsets, q, side="right")]
        nxt = np.minimum(q + 1, size - 1)
        q = q[(q + 1 >= q_end) | free[nxt] | ((cls[nxt] & _MARK) != 0)]
        quotes_open = starts[opened] - 1
        q = q[~np.isin(q, quotes_open)]
        for byte in b"\"'":
            mine = np.flatnonzero(opened & (data[np.maximum(starts - 1, 0)] == byte))
            ends = q[data[q] == byte]
            if len(mine) and len(ends):
                k = np.searchsorted(ends, starts[mine])
                found = ends[np.minimum(k, len(ends) - 1)]
                # a further opening quote before the closing one means that this one was never closed
                following = np.append(quotes_open, size + 1)[np.searchsorted(quotes_open, starts[mine])]
                good = (k < len(ends)) & (found < row_end[mine]) & (found < following)
                close[mine[good]] = found[good]
        # parity: value starts between a pair belong to the value that it encloses
        reach = np.maximum.accumulate(close)
        inside = np.zeros(len(starts), bool)
        inside[1:] = reach[:-1] > starts[1:]
        starts, row_of, close = starts[~inside], row_of[~inside], close[~inside]

    limit = np.minimum(np.append(starts[1:], size), offsets[row_of + 1])
    loose = _last(~(free | ((cls & _QUOTE) != 0)))
    end = np.where(close >= 0, close, np.maximum(loose[limit - 1] + 1, starts))
    new_row = np.append(True, row_of[1:] != row_of[:-1])
    head = np.flatnonzero(new_row)
    pos = np.arange(len(starts)) - np.repeat(head, np.diff(np.append(head, len(starts))))
    out = {"row": row_of, "pos": pos, "start": starts, "digits": end, "digits_end": end}
    if kind == POSTING:
        tail = np.maximum(loose[limit - 1] + 1, starts)
        not_digit = _last((cls & _DIGIT) == 0)
        digits = np.maximum(not_digit[tail - 1] + 1, starts)
        not_space = _last((cls & _SPACE) == 0)
        # back over: blanks, one separator, blanks
        e = np.maximum(not_space[np.maximum(digits - 1, 0)] + 1, starts)
        spaced = e < digits
        is_token = np.zeros(len(e), bool)
        m = e - 3 >= starts
        is_token[m] = (data[e[m] - 3] == 64) & (data[e[m] - 2] == 33) & (data[e[m] - 1] == 35)
        b = np.maximum(e - 1, 0)
        is_byte = ~is_token & (((cls[b] & _MARK) != 0) | (data[b] == 44) | (data[b] == 124))
        e2 = e - np.where(is_token, 3, np.where(is_byte, 1, 0))
        e2 = np.maximum(not_space[np.maximum(e2 - 1, 0)] + 1, starts)
        counted = (digits < tail) & (is_token | is_byte | spaced)
        # a quote that closes right there is not part of the url
        q_end = np.where(counted, e2, end)
        last = np.maximum(q_end - 1, 0)
        q_end = np.where((close >= 0) & (close == last), last, q_end)
        end = np.where(counted, np.maximum(q_end, starts), end)
        end = np.maximum(not_space[np.maximum(end - 1, 0)] + 1, starts)
        out["digits"], out["digits_end"] = np.where(counted, digits, tail), np.where(counted, tail, tail)
    out["end"] = end
    return out


def take_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """A string array of the given byte ranges of ``data``."""
    size = end - start
    offs = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    index = np.repeat(start - offs[:-1], size) + np.arange(offs[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data[index])))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; nulls are rows of no bytes."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offs - offs[0]


def unpack_values(df: DataFrame, column: str, keep: Sequence[str], kind: str = LINK) -> DataFrame:
    """One row per value packed in ``column``: the columns ``keep`` of its record, ``pos`` and ``item``; postings also ``url``, ``count``.

    ``item`` is the value without blanks or quotes around it; for postings it is written ``url@!#count``, whatever separated
    the two. ``pos`` counts values from 0; empty slots take no position.

    Defined results: null, empty and valueless fields give no rows; a posting without a count gives its url as ``item`` and
    a null ``count``; a count beyond 18 digits gives a null ``count`` and stays whole in ``item``; repeated records give
    repeated rows (distinctness is the caller's choice); columns of ``df`` not kept never matter, whatever their names.
    A kept column named like a column of the result comes out with ``_kept`` behind its name.
    """
    new = {"pos", "item"} | ({"url", "count"} if kind == POSTING else set())
    fields = [T.StructField(f"{c}_kept" if c in new else c, df.schema[c].dataType) for c in keep]
    fields += [T.StructField("pos", T.IntegerType()), T.StructField("item", T.StringType())]
    if kind == POSTING:
        fields += [T.StructField("url", T.StringType()), T.StructField("count", T.LongType())]
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(kept))
            v = split_values(data, offs, kind)
            if not len(v["row"]):
                continue
            rows = pa.array(v["row"])
            cols = [batch.column(i).take(rows) for i in range(kept)]
            url = take_ranges(data, v["start"], v["end"])
            item, extra = url, []
            if kind == POSTING:
                digits = take_ranges(data, v["digits"], v["digits_end"])
                size = v["digits_end"] - v["digits"]
                has = pa.array(size > 0)
                item = pc.if_else(has, pc.binary_join_element_wise(url, digits, pa.scalar("@!#", pa.large_string())), url)
                count = pc.if_else(pa.array((size > 0) & (size <= 18)), digits, None).cast(pa.int64())
                extra = [url.cast(pa.string()), count]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(v["pos"].astype(np.int32)), item.cast(pa.string()), *extra],
                names=[f.name for f in fields],
            )

    return df.where(df[column].isNotNull()).select(*[df[c] for c in keep], df[column].alias("__packed")).mapInArrow(run, T.StructType(fields))
