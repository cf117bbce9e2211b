"""Splitting oversized sequences at natural boundaries, with an exact overlap.

Method: structure-tree packing. A sequence is parsed into a tree of nodes: below its root lie the
runs of one letter class (unknown, soft-masked, everything else), below a run of amino acids the
stretches that each end in a stop (`*`), below those the bare letters. A node is oversized if it
does not fit whole into a piece of its own (with the overlap before it). Only oversized nodes are
opened: an oversized run gives way to its stretches, an oversized stretch to its letters; every
other node stays whole. The nodes left, in order, are then merged bottom-up: siblings, and what an
opened node left over with its next sibling, join one piece as long as it stays within the limit.
So a run that fits is never cut at a stop inside it just to fill the room before it.

A division by natural borders alone exists exactly if no stretch had to be opened into letters
where no border lay in reach: from any later border at least as much is in reach as from an
earlier one, and a node that stays whole fits after the border before it. cut_kinds and pieces
therefore read the same packing.

All nodes of an Arrow batch are built at once (class table, differences, sizes); the merging
advances all sequences of the batch by one piece per step with binary searches. Pieces are sliced
from the byte buffer of the batch, in portions of bounded size, so the parent text is never
copied per piece. Runs in mapInArrow, without a shuffle; the texts never move.

Defined results
* letters are code points; letters beyond ASCII belong to the class 'everything else';
* null or empty sequences and sequences within the limit give one piece (none if null/empty);
* a null, zero or negative tile_size sets no limit; a null or negative overlap counts as 0;
* an overlap of tile_size or more leaves no room: its cut is 'forced' and the pieces overlap
  by tile_size - 1;
* an alphabet other than 'aa' is read as 'dna'; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.arrowtext import byte_slices, spans_to_strings, text_buffers

OTHER, UNKNOWN, LOWER = 0, 1, 2
#: Bytes of pieces that one output batch holds; a longer single piece stands alone.
OUT_BYTES = 8_000_000


@lru_cache(maxsize=2)
def _classes(amino: bool) -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[97:123] = LOWER
    table[[ord(c) for c in ("Xx " if amino else "Nn")]] = UNKNOWN
    return table


class Letters(NamedTuple):
    """Letters of a batch: offsets per row, one small code per letter (ASCII as is, anything else 128), its first byte, all bytes."""

    off: np.ndarray
    codes: np.ndarray
    at: np.ndarray
    data: np.ndarray


def _letters(texts: pa.Array) -> Letters:
    off, data, _ = text_buffers(texts)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    return Letters(np.searchsorted(at, off), np.minimum(data[at], 128), np.append(at, len(data)), data)


class Nodes(NamedTuple):
    """Nodes of one level of all trees of a batch, in text order: their sequence, begin and end."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _level(ends: np.ndarray, row: np.ndarray, off: np.ndarray) -> Nodes:
    """The nodes between the marked letters (the last ones of their nodes) of all rows."""
    last = np.flatnonzero(ends)
    at = row[last]
    start = np.empty(len(last), np.int64)
    start[1:] = last[:-1] + 1
    start[:1] = 0
    return Nodes(at, np.maximum(start, off[at]), last + 1)


def tree(codes: np.ndarray, off: np.ndarray, amino: np.ndarray) -> tuple[Nodes, Nodes]:
    """The two inner levels of all trees: class runs, and the stretches that stops end within them."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    if not len(codes):
        none = Nodes(*[np.zeros(0, np.int64)] * 3)
        return none, none
    is_aa = amino[row]
    kind = np.where(is_aa, _classes(True)[codes], _classes(False)[codes])
    run_end = np.append((kind[:-1] != kind[1:]) | (row[:-1] != row[1:]), True)
    return _level(run_end, row, off), _level(run_end | (is_aa & (codes == 42)), row, off)


def opened(runs: Nodes, stretches: Nodes, off: np.ndarray, limit: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Sorted ends of the nodes that stay whole after every oversized run was opened into its stretches.

    Letters of an oversized stretch need no border of their own: any place inside it may be cut.
    """
    def fits(n: Nodes) -> np.ndarray:
        return (n.end - n.start <= limit[n.row] - np.where(n.start > off[n.row], overlap[n.row], 0))

    whole = fits(runs)
    of = np.searchsorted(runs.end, stretches.end)  # the run that holds a stretch
    ends = np.concatenate((runs.end, stretches.end[~whole[of]] if len(runs.end) else stretches.end))
    return np.unique(ends)


def pack(letters: Letters, amino: np.ndarray, limit: np.ndarray, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece number, start, end, natural end) of every piece; starts and ends count within the row."""
    off = letters.off
    begin, stop = off[:-1], off[1:]
    room = np.where(limit > 0, limit, np.maximum(stop - begin, 1))
    shared = np.where(limit > 0, np.clip(overlap, 0, room - 1), 0)
    borders = opened(*tree(letters.codes, off, amino), off, room, shared)
    rows = np.flatnonzero(stop > begin)
    start = begin[rows]
    cut = begin[rows]  # end of the piece before
    number = 0
    out: list[tuple[np.ndarray, ...]] = []
    while len(rows):
        reach = np.minimum(start + room[rows], stop[rows])
        done = reach == stop[rows]
        # merge nodes as far as they stay in reach; the piece must end beyond the one before and leave room for the overlap
        at = np.searchsorted(borders, reach, side="right") - 1
        border = borders[np.maximum(at, 0)]
        least = np.maximum(cut, begin[rows] + shared[rows] - 1)
        natural = (at >= 0) & (border > least) & ~done
        end = np.where(natural, border, reach)
        out.append((rows, np.full(len(rows), number), start - begin[rows], end - begin[rows], natural | done))
        more = ~done
        rows, cut = rows[more], end[more]
        start = cut - shared[rows]
        number += 1
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, bool)
    row, piece, a, b, ok = (np.concatenate(x) for x in zip(*out))
    by = np.lexsort((piece, row))
    return row[by], piece[by], a[by], b[by], ok[by]


def _batch(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Letters, np.ndarray, np.ndarray, tuple]]:
    for a, b in byte_slices(batch.column(1)):
        part = batch.slice(a, b - a)
        letters = _letters(part.column(1))
        amino = np.asarray(pc.fill_null(pc.equal(part.column(2), "aa"), False))
        limit = pc.fill_null(part.column(3), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        overlap = np.maximum(pc.fill_null(part.column(4), 0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
        yield part, letters, limit, overlap, pack(letters, amino, limit, overlap)


def _given(df: DataFrame, id_col: str, seq_col: str, alphabet_col: str, size_col: str, overlap_col: str) -> DataFrame:
    return df.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(seq_col).cast("string").alias("seq"), F.col(alphabet_col).cast("string").alias("alphabet"),
        F.col(size_col).cast("bigint").alias("size"), F.col(overlap_col).cast("bigint").alias("overlap"),
    )


def cut_kinds(df: DataFrame, id_col: str = "tileable_id", seq_col: str = "seq", alphabet_col: str = "alphabet", size_col: str = "tile_size", overlap_col: str = "tile_overlap") -> DataFrame:
    """id and cut ('natural' or 'forced') of every sequence longer than its limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, letters, limit, overlap, (row, _, _, _, natural) in _batch(batch):
                forced = np.zeros(len(part), bool)
                forced[row[~natural]] = True
                forced |= overlap >= limit
                long = (limit > 0) & (np.diff(letters.off) > limit)
                at = np.flatnonzero(long)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(np.where(forced[at], "forced", "natural").tolist(), pa.string())], ["id", "cut"])

    return _given(df, id_col, seq_col, alphabet_col, size_col, overlap_col).mapInArrow(run, "id bigint, cut string").select(F.col("id").alias(id_col), "cut")


def pieces(df: DataFrame, id_col: str = "tileable_id", seq_col: str = "seq", alphabet_col: str = "alphabet", size_col: str = "tile_size", overlap_col: str = "tile_overlap") -> DataFrame:
    """id, piece_no, piece_start, piece_end, natural_end and piece: every sequence as ordered, overlapping pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, letters, _, _, (row, number, start, end, natural) in _batch(batch):
                base = letters.off[row]
                first, last = letters.at[base + start], letters.at[base + end]
                held = np.cumsum(last - first)
                a = 0
                while a < len(row):
                    b = max(a + 1, int(np.searchsorted(held, (held[a - 1] if a else 0) + OUT_BYTES, side="right")))
                    s = slice(a, b)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(row[s])), pa.array(number[s], pa.int32()), pa.array(start[s]), pa.array(end[s]), pa.array(natural[s]), spans_to_strings(letters.data, first[s], last[s])],
                        ["id", "piece_no", "piece_start", "piece_end", "natural_end", "piece"],
                    )
                    a = b

    given = _given(df, id_col, seq_col, alphabet_col, size_col, overlap_col)
    schema = "id bigint, piece_no int, piece_start bigint, piece_end bigint, natural_end boolean, piece string"
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)
