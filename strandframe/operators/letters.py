"""Letter kernels over Arrow batches: six-frame translation, tiles, k-mers, one-hot letters.

Each kernel reads the texts of a batch as one byte buffer and works on it with a handful of NumPy
passes; what comes out is cut from that buffer by offsets. So the work is linear in the text, no
array of all windows or letters of a text is ever built in a row, and long texts leave in
portions of bounded size. Positions count letters (code points) from 0; null texts give no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.arrowtext import byte_slices, spans_to_strings, text_buffers
from strandframe.functions.seq import CODONS

#: Rows that one output batch of a kernel holds at most, and bytes of text.
OUT_ROWS, OUT_BYTES = 1 << 19, 8_000_000
_BASES = "ACGT"


def _run(df: DataFrame, keep: list[str], seq_col: str, extra: str, kernel: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, list[pa.Array]]]]) -> DataFrame:
    """Applies a kernel to slices of batches; it yields (row of each output row, further columns)."""
    kinds = dict(df.dtypes)
    names = [x.split()[0] for x in extra.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(len(keep)), 2_000_000):
                part = batch.slice(a, b - a)
                off, data, _ = text_buffers(part.column(len(keep)))
                for row, columns in kernel(part, off, data):
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column(i).take(at) for i in range(len(keep))] + columns, keep + names)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + extra
    return df.where(F.col(seq_col).isNotNull()).select(*keep, F.col(seq_col).cast("string").alias("_text")).mapInArrow(run, schema)


def _letters(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letter offsets per row, first byte of each letter and one past the end)."""
    if not len(data) or data.max() < 128:
        return off, np.arange(len(data) + 1)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    return np.searchsorted(at, off), np.append(at, len(data))


def _table(alphabet: str) -> np.ndarray:
    """Byte to place in an alphabet of ASCII letters; anything else comes after the last."""
    table = np.full(256, len(alphabet), np.int64)
    table[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    return table


def _portions(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of rows whose sizes sum to about a limit each; a larger row stands alone."""
    total = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, side="right")))
        yield slice(a, b)
        a = b


def _residues() -> np.ndarray:
    """Residue byte of each codon number (base 5, the fifth letter standing for anything but A, C, G, T); blank if unknown."""
    out = np.full(125, ord(" "), np.uint8)
    for codon, residue in CODONS.items():
        a, b, c = (_BASES.index(x) for x in codon)
        out[25 * a + 5 * b + c] = ord(residue)
    return out


def translations(df: DataFrame, keep: list[str], seq_col: str, frames: list[int]) -> DataFrame:
    """keep columns and residues: the translations of the given frames (0-2 forward, 3-5 of the reverse complement), as an array in their order.

    Codons with letters other than unmasked A, C, G, T give a blank; too short texts give empty ones.
    """

    def kernel(part: pa.RecordBatch, off: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        off, at = _letters(off, data)
        codes = _table(_BASES)[data[at[:-1]]]
        turned = np.array([3, 2, 1, 0, 4])[codes]
        padded, back = np.append(codes, [4, 4]), np.append(turned, [4, 4])
        residue = _residues()
        # residue of the codon that begins at a letter, and of the one that ends there on the other strand
        ahead = residue[25 * padded[:-2] + 5 * padded[1:-1] + padded[2:]]
        behind = residue[25 * back[2:] + 5 * back[1:-1] + back[:-2]]
        both = np.concatenate((ahead, behind))
        n = np.diff(off)
        k = len(frames)
        for s in _portions(n * k // 3 + k, OUT_BYTES):
            rows = np.arange(len(n))[s]
            shift = np.array([f % 3 for f in frames])
            reverse = np.array([f >= 3 for f in frames])
            count = np.maximum((n[rows][:, None] - shift[None, :]) // 3, 0)
            first = np.where(reverse[None, :], len(ahead) + off[rows + 1][:, None] - 3 - shift[None, :], off[rows][:, None] + shift[None, :])
            step = np.where(reverse, -3, 3)[None, :].repeat(len(rows), axis=0)
            count, first, step = count.ravel(), first.ravel(), step.ravel()
            begin = np.concatenate(([0], np.cumsum(count)))
            within = np.arange(begin[-1]) - np.repeat(begin[:-1], count)
            text = both[np.repeat(first, count) + np.repeat(step, count) * within]
            strings = pa.Array.from_buffers(pa.string(), len(count), [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))])
            yield rows, [pa.ListArray.from_arrays(pa.array(np.arange(0, len(count) + 1, k), pa.int32()), strings)]

    return _run(df, keep, seq_col, "residues array<string>", kernel)


def tiles(df: DataFrame, keep: list[str], seq_col: str, size: int, reverse: bool = False) -> DataFrame:
    """keep columns, tile_ord, tile_start and tile of non-overlapping tiles; in reverse they count from the end and the last one is the short one."""

    def kernel(part: pa.RecordBatch, off: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        off, at = _letters(off, data)
        n = np.diff(off)
        count = -(-n // size)
        row = np.repeat(np.arange(len(n)), count)
        order = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = np.maximum(n[row] - (order + 1) * size, 0) if reverse else order * size
        end = n[row] - order * size if reverse else np.minimum((order + 1) * size, n[row])
        first, last = at[off[row] + start], at[off[row] + end]
        for s in _portions(last - first, OUT_BYTES):
            yield row[s], [pa.array(order[s]), pa.array(start[s]), spans_to_strings(data, first[s], last[s])]

    return _run(df, keep, seq_col, "tile_ord bigint, tile_start bigint, tile string", kernel)


def kmer_rows(df: DataFrame, keep: list[str], seq_col: str, k: int, letters: str = _BASES, tile: int | None = None) -> DataFrame:
    """keep columns, pos, kmer of all windows made of the given (unmasked) letters only; with tile also opens, true of the first such window of each tile of so many letters."""

    def kernel(part: pa.RecordBatch, off: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        if len(data) < k:
            return
        foreign = np.concatenate(([0], np.cumsum(_table(letters)[data] == len(letters))))
        row_of = np.repeat(np.arange(len(off) - 1), np.diff(off))
        inside = row_of[: len(data) - k + 1] == row_of[k - 1 :]
        starts = np.flatnonzero(inside & (foreign[k:] == foreign[:-k]))
        ordinal = np.arange(len(data)) if data.max() < 128 else np.cumsum((data & 0xC0) != 0x80) - 1
        base = np.append(ordinal, ordinal[-1] + 1)[np.minimum(off[:-1], len(data))]
        windows = np.lib.stride_tricks.sliding_window_view(data, k)
        pos, opens = ordinal[starts] - base[row_of[starts]], None
        if tile:
            opens = (np.diff(row_of[starts], prepend=-1) != 0) | (np.diff(pos // tile, prepend=-1) != 0)
        for a in range(0, len(starts), OUT_ROWS):
            at = starts[a : a + OUT_ROWS]
            words = np.ascontiguousarray(windows[at])
            ends = np.arange(0, k * (len(at) + 1), k, dtype=np.int32)
            words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(words)])
            yield row_of[at], [pa.array(pos[a : a + OUT_ROWS], pa.int32()), words, *([pa.array(opens[a : a + OUT_ROWS])] if tile else [])]

    return _run(df, keep, seq_col, "pos int, kmer string" + ", opens boolean" * bool(tile), kernel)


def one_hot(df: DataFrame, keep: list[str], seq_col: str, alphabet: str) -> DataFrame:
    """Long one-hot form: keep columns, pos, letter_idx; letters outside the alphabet have no row."""

    def kernel(part: pa.RecordBatch, off: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        off, at = _letters(off, data)
        codes = _table(alphabet)[data[at[:-1]]]
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        known = np.flatnonzero(codes < len(alphabet))
        for a in range(0, len(known), OUT_ROWS):
            i = known[a : a + OUT_ROWS]
            yield row[i], [pa.array(i - off[row[i]], pa.int32()), pa.array(codes[i], pa.int32())]

    return _run(df, keep, seq_col, "pos int, letter_idx int", kernel)
