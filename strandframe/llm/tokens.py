"""Encoding of a whole corpus with a public tokenizer.

Method: overlapping chunk encoding. A long text is cut into chunks that overlap; every chunk is
pre-tokenised on its own, and two neighbours are stitched at a position inside their overlap
where both begin a pre-token: from there on their pre-tokens agree, since the pattern looks only
ahead. Where none exists the left chunk is continued until it meets the right one. The text is
cut at the stitches and the pieces are encoded, so no encoder call sees more than about one
chunk, and the ids are those of the whole text. Decoding concatenates the tokens' raw bytes.

Texts up to one chunk have nothing to stitch. They and texts up to SPREAD letters are encoded where
they lie, in mapInArrow without a shuffle. Longer ones are first divided into rows at places that
begin a pre-token whatever stands around them (a blank or line end after a letter or sign: no
pre-token holds white space but at its begin, and what lies before has no blank at its end), so
that tasks share one text; their ids are put together again by row.

Defined results: null and empty texts give an empty list; strings of special tokens are
ordinary text; repeated documents repeat their rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.arrowtext import byte_slices

#: Where the vocabulary files lie on every node.
TOKENIZERS = "/opt/tokenizers"
CHUNK, OVERLAP = 8192, 256
#: Letters of a text that one row keeps; longer texts are divided.
SPREAD = 1 << 18
LOOK = 4
# Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(name: str, folder: str = TOKENIZERS):
    """The tiktoken encoder of a rank file; kept per worker process."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def pre_tokens():
    import regex

    return regex.compile(PATTERN)


def _apart(text: str, p: int) -> bool:
    """Whether the text before p ends alike without what follows: blanks before a sign would close up."""
    return p == 0 or not text[p - 1].isspace() or text[p].isspace()


def stitches(text: str, pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Positions, in order and including both ends, between which the text may be encoded apart."""
    n = len(text)
    cuts = [0]
    starts = list(range(0, max(n - overlap, 1), chunk - overlap))
    # Begins of pre-tokens per chunk. A token that touches the chunk's end may be cut short, so its end is no begin;
    # the pattern looks at most LOOK letters ahead of a token's begin before that matters, so later begins are unsure.
    begins = []
    for a in starts:
        end = min(a + chunk, n)
        begins.append([p for m in pattern.finditer(text, a, end) if (p := m.start()) <= end - LOOK or end == n or p == a])
    current = begins[0]
    for k in range(1, len(starts)):
        right = set(begins[k])
        meet = next((p for p in current if p >= starts[k] and p in right and _apart(text, p)), None)
        if meet is None:
            # no common begin in the overlap: continue the left scan from its last sure begin until it meets the right one
            at = current[-1] if current else cuts[-1]
            extra = []
            for m in pattern.finditer(text, at):
                p = m.start()
                extra.append(p)
                if p in right and _apart(text, p):
                    meet = p
                    break
                if p >= min(starts[k] + chunk, n):
                    break
            if meet is None:
                current = current[:-1] + extra
                continue
        cuts.append(meet)
        current = [p for p in begins[k] if p >= meet]
    cuts.append(n)
    return [c for i, c in enumerate(cuts) if i == 0 or c > cuts[i - 1]] if n else [0, 0]


def encode_text(text: str | None, enc, pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    if not text:
        return []
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    cuts = stitches(text, pattern, chunk, overlap)
    return [i for a, b in zip(cuts, cuts[1:]) for i in enc.encode_ordinary(text[a:b])]


def _run(column: str, tokenizer: str, folder: str, chunk: int, overlap: int, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pattern = encoder(tokenizer, folder), pre_tokens()
        for batch in batches:
            where = batch.schema.get_field_index(column)
            for a, b in byte_slices(batch.column(where), 1_000_000):
                part = batch.slice(a, b - a)
                ids = [encode_text(t, enc, pattern, chunk, overlap) for t in part.column(where).to_pylist()]
                out = pa.array([len(x) for x in ids], pa.int64()) if counts else pa.array(ids, pa.list_(pa.int32()))
                rest = [(part.schema.names[i], part.column(i)) for i in range(part.num_columns) if i != where]
                yield pa.RecordBatch.from_arrays([c for _, c in rest] + [out], [n for n, _ in rest] + ["n_tokens" if counts else "ids"])

    return run


# A place where a text may be divided: before a blank or line end, after anything that is surely no white space or control sign.
PLACE = re.compile("(?<=[^\\s\x00-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff])[ \n]")


def divide(text: str, size: int = SPREAD) -> list[str]:
    """Parts of about `size` letters that are encoded apart as they are together; longer where no place is found."""
    cuts = [0]
    while len(text) - cuts[-1] > size and (m := PLACE.search(text, cuts[-1] + size)):
        cuts.append(m.start())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def _divided(spread: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                parts = divide(batch.column(2)[i].as_py(), spread)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * n)), batch.column(1).take(pa.array([i] * n)), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], ["row", "id", "part", "text"])

    return run


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """id and ids of every row."""
    given = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    long = F.coalesce(F.length("text") > spread, F.lit(False))
    here = given.where(~long).mapInArrow(_run("text", tokenizer, folder, chunk, overlap, False), "id bigint, ids array<int>")
    rows = given.where(long).select(F.monotonically_increasing_id().alias("row"), "id", "text")  # fixed by the scan's partitions and order
    parts = rows.mapInArrow(_divided(spread), "row bigint, id bigint, part int, text string").repartition("row", "part")
    coded = parts.mapInArrow(_run("text", tokenizer, folder, chunk, overlap, False), "row bigint, id bigint, part int, ids array<int>")
    whole = coded.groupBy("row", "id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("ids"))
    return here.unionByName(whole.select("id", "ids")).withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, keys: dict[str, str], text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The key columns (name to type) and n_tokens of every row."""
    given = df.select(*[F.col(c).cast(t).alias(c) for c, t in keys.items()], F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in keys.items()) + ", n_tokens bigint"
    return given.mapInArrow(_run("_text", tokenizer, folder, CHUNK, OVERLAP, True), schema)


def decode_ids(ids: list[int], tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    """The text of a list of ids: its tokens' raw bytes, joined."""
    enc = encoder(tokenizer, folder)
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8", errors="replace")
