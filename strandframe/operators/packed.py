"""Several values packed in one text field: one row per value, with its place kept.

Method: the Arrow string buffer of a batch is scanned as one byte array. Delimiter masks and
vectorised quote parity (a prefix composition of small state maps over the quote marks only)
give the spans of members; child offsets are derived from them, list arrays are built and
flattened with their parents' ordinals. Runs in mapInArrow: no shuffle, no Python per row.

Two dialects
* list of values: members between any of `, ; |`, blanks and quote marks (quotes are noise);
* list of tagged values: members between any of `; , |` outside a pair of single or double
  quotes; a member is a tag, then blanks and/or one `=`, then a value. A quote opens only at
  the begin of a member or value; one without a partner is an ordinary letter; a quote after
  an odd number of backslashes never opens or closes, nor do two equal marks side by side
  inside quotes; inside a quoted value either is given as the plain mark.

Defined results: null, empty and blank fields give no row; empty members take no place; a tag
without value gives val ''; texts of any length are worked whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.arrowtext import byte_slices, last_true, next_true, spans_to_strings, text_buffers

_DOUBLE, _SINGLE, _BACK, _EQUALS = 34, 39, 92, 61


def _byte_set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars, np.uint8)] = True
    return table


_BLANK = _byte_set(b" \t\r\n\x0b\x0c")
_MEMBER_END = _byte_set(b";,|")
_LIST_END = _byte_set(b";,| \t\r\n\x0b\x0c\"'")
_OPENS_AFTER = _byte_set(b" \t\r\n\x0b\x0c;,|=")

# State maps of the quote scan, coded f(0) + 3 f(1) + 9 f(2); states: 0 outside, 1 in double, 2 in single quotes.
_CODES = np.arange(27)
_MAPS = np.stack([_CODES % 3, _CODES // 3 % 3, _CODES // 9], axis=1)
_THEN = sum((_MAPS[_CODES[None, :, None], _MAPS[:, None, :]][..., s] * 3**s for s in range(3)))  # [first, second]
_ROW_START = 0  # every state goes to 0


def _map(a: int, b: int, c: int) -> int:
    return a + 3 * b + 9 * c


_EVENT = {(True, _DOUBLE): _map(1, 0, 2), (False, _DOUBLE): _map(0, 0, 2), (True, _SINGLE): _map(2, 1, 0), (False, _SINGLE): _map(0, 1, 0)}


def _quote_states(at: np.ndarray, kind: np.ndarray, opens: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The state after each quote mark (prefix composition by doubling, reset at each row)."""
    code = np.empty(len(at), np.int64)
    for (can_open, mark), value in _EVENT.items():
        code[(opens == can_open) & (kind == mark)] = value
    first = np.ones(len(at), bool)
    first[1:] = row[1:] != row[:-1]
    code[first] = _MAPS[code[first], 0] * 13  # a constant map: the row begins outside
    step = 1
    while step < len(at):
        code[step:] = _THEN[code[:-step], code[step:]]
        step *= 2
    return _MAPS[code, 0]


def _quoted(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes inside a pair of quotes, marks included; bytes that only escape the quote mark after them)."""
    n = len(data)
    inside, escaping = np.zeros(n, bool), np.zeros(n, bool)
    at = np.flatnonzero((data == _DOUBLE) | (data == _SINGLE))
    if not len(at):
        return inside, escaping
    row = np.searchsorted(off, at, side="right") - 1
    backs = data == _BACK
    if backs.any():
        plain = last_true(~backs)
        before = np.maximum(np.where(at > 0, plain[np.maximum(at - 1, 0)], -1), off[row] - 1)
        odd = (at - 1 - before) % 2 == 1
        escaping[at[odd] - 1] = True
        at, row = at[~odd], row[~odd]
    if not len(at):
        return inside, escaping
    kind = data[at]
    doubled = np.zeros(len(at), bool)  # the second of two adjacent equal marks
    doubled[1:] = (at[1:] == at[:-1] + 1) & (kind[1:] == kind[:-1]) & (row[1:] == row[:-1])
    opens = (at == off[row]) | _OPENS_AFTER[data[np.maximum(at - 1, 0)]] | doubled
    while len(at):
        state = _quote_states(at, kind, opens, row)
        last = np.ones(len(at), bool)
        last[:-1] = row[1:] != row[:-1]
        left_open = last & (state != 0)
        if not left_open.any():
            break
        # the opening mark without a partner is the last one that left state 0 in its row
        prior = np.concatenate(([0], state[:-1]))
        prior[np.concatenate(([True], row[1:] != row[:-1]))] = 0
        opening = last_true((prior == 0) & (state != 0))[np.flatnonzero(left_open)]
        keep = np.ones(len(at), bool)
        keep[opening] = False
        at, kind, opens, row = at[keep], kind[keep], opens[keep], row[keep]
    # what is left pairs up
    if len(at):
        prior = np.concatenate(([0], state[:-1]))
        prior[np.concatenate(([True], row[1:] != row[:-1]))] = 0
        begin, close = at[(prior == 0) & (state != 0)], at[(prior != 0) & (state == 0)]
        edge = np.zeros(n + 1, np.int8)
        edge[begin] += 1
        edge[close + 1] -= 1
        escaping[np.intersect1d(close + 1, begin, assume_unique=True) - 1] = True  # closed and opened at once: a doubled mark
        inside = np.cumsum(edge[:n]) > 0
    return inside, escaping


def _spans(separator: np.ndarray, blank: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the non-empty members between separators and row borders, blanks trimmed."""
    n = len(separator)
    cuts = np.flatnonzero(separator)
    start = np.concatenate((off[:-1], cuts + 1))
    end = np.concatenate((cuts, off[1:]))
    start.sort()
    end.sort()
    solid = ~blank
    first, last = next_true(solid), last_true(solid)
    start = first[start]
    full = end > 0
    end = np.where(full, last[np.maximum(end - 1, 0)] + 1, 0) if n else end
    ok = start < end
    start, end = start[ok], end[ok]
    return np.searchsorted(off, start, side="right") - 1, start, end


def _places(row: np.ndarray) -> np.ndarray:
    if not len(row):
        return np.zeros(0, np.int32)
    new = np.concatenate(([True], row[1:] != row[:-1]))
    return (np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))).astype(np.int32)


def scan_values(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Plain lists: (row, place, tag '', value) of every value."""
    off, data, _ = text_buffers(texts)
    separator = _LIST_END[data]
    row, start, end = _spans(separator, separator, off)
    return row, _places(row), pa.array([""], pa.string()).take(pa.array(np.zeros(len(row), np.int64))), spans_to_strings(data, start, end)


def scan_tagged(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Tagged lists: (row, place, tag, value) of every member."""
    off, data, _ = text_buffers(texts)
    inside, escaping = _quoted(data, off)
    blank = _BLANK[data]
    row, start, end = _spans(_MEMBER_END[data] & ~inside, blank, off)
    stop, solid = next_true((blank | (data == _EQUALS)) & ~inside), next_true(~blank)
    tag_end = np.minimum(stop[start], end)
    value = np.minimum(solid[tag_end], end)
    at_equals = value < end
    at_equals[at_equals] = data[value[at_equals]] == _EQUALS
    value = np.where(at_equals, np.minimum(solid[np.minimum(value + 1, len(data))], end), value)
    value_end = end.copy()
    long = value_end - value >= 2
    mark = np.zeros(len(value), np.uint8)
    mark[long] = data[value[long]]
    quoted = long & ((mark == _DOUBLE) | (mark == _SINGLE))
    outside = next_true(~inside)
    quoted[quoted] = (data[value_end[quoted] - 1] == mark[quoted]) & (outside[value[quoted]] >= value_end[quoted])
    value, value_end = value + quoted, value_end - quoted
    # blanks just inside the quotes are outer blanks too
    value = np.minimum(solid[value], value_end)
    if len(data):
        value_end = np.maximum(np.where(value_end > value, last_true(~blank)[np.maximum(value_end - 1, 0)] + 1, value), value)
    keep = ~(escaping & inside) if escaping.any() else None
    return row, _places(row), spans_to_strings(data, start, tag_end), spans_to_strings(data, value, value_end, keep)


_SCANS = {"values": scan_values, "tagged": scan_tagged}


def split_packed(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """field, row_id, pos, tag, val of every member of the named text columns.

    `fields` maps a column to its dialect, 'values' or 'tagged'. Repeated input rows repeat
    their values: drop re-delivered rows before.
    """
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for k, name in enumerate(names):
                texts = batch.column(k + 1)
                for a, b in byte_slices(texts):
                    row, pos, tag, val = _SCANS[fields[name]](texts.slice(a, b - a))
                    # list arrays from child offsets, flattened again with the parents' ordinals
                    child = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                    members = pa.ListArray.from_arrays(pa.array(child), pa.StructArray.from_arrays([pa.array(pos), tag, val], ["pos", "tag", "val"]))
                    flat = members.flatten()
                    parent = pc.list_parent_indices(members)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name], pa.string()).take(pa.array(np.zeros(len(flat), np.int64))), ids.slice(a, b - a).take(parent), flat.field(0), flat.field(1), flat.field(2)],
                        ["field", "row_id", "pos", "tag", "val"],
                    )

    return df.select(F.col(id_col).cast("bigint").alias("row_id"), *[F.col(c).alias(f"t{k}") for k, c in enumerate(names)]).mapInArrow(
        run, "field string, row_id bigint, pos int, tag string, val string"
    )
