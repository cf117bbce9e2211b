"""Sequences and genomes in JSON, nested to any depth, as linked flat rows.

Records may be objects, arrays of them (a genome) or arrays of arrays (genomes), one value per
file or one per line. All nodes of a batch are indexed at once (see operators.nested); children
are read level by level until none is left, so no schema bounds the depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.arrowtext import arrow_schema, byte_slices, text_buffers
from strandframe.functions.seq import browser_id
from strandframe.operators.nested import ARRAY, OBJECT, NodeStore, _int_text, _path

FIELDS = {"id": "string", "species": "string", "chromosome": "string", "strand": "string", "genome_start": "bigint", "genome_end": "bigint", "length": "bigint", "classname": "string", "sequence": "string", "type": "string"}
CHILDREN = ("genomic_elements", "homology")
SCHEMA = "file string, node string, parent string, kind string, ord int, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", elements_allowed boolean, homology_allowed boolean"


def _flatten(names: pa.Array, texts: pa.Array) -> Iterator[pa.Table]:
    schema = arrow_schema(SCHEMA)
    store = NodeStore()
    off, data, _ = text_buffers(texts)
    node = store.resolve(store.add(data, off))
    doc = np.arange(len(node))
    path = pa.array(["$"] * len(node), pa.string())
    parent, kind, order = pa.nulls(len(node), pa.string()), np.full(len(node), "", object), np.zeros(len(node), np.int64)
    while len(node):
        objects = np.flatnonzero(store.kinds(node) == OBJECT)
        at = pa.array(objects)
        own = node[objects]
        columns: dict[str, pa.Array] = {"file": names.take(pa.array(doc[objects])), "node": path.take(at), "parent": parent.take(at), "kind": pa.array(kind[objects].tolist(), pa.string()), "ord": pa.array(order[objects], pa.int32())}
        for name, t in FIELDS.items():
            got = store.get(own, name)
            columns[name] = store.numbers(got) if t == "bigint" else store.texts(got)
        below = {c: store.get(own, c) for c in CHILDREN}
        columns["elements_allowed"], columns["homology_allowed"] = (pa.array(store.kinds(below[c]) == ARRAY) for c in CHILDREN)
        yield pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema)
        # members of plain arrays, and children of objects
        level = []
        inner, child, n = store.children(np.where(store.kinds(node) == ARRAY, node, -1))
        level.append((doc[inner], _path(path.take(pa.array(inner)), "[", _int_text(n), "]"), path.take(pa.array(inner)), np.full(len(n), "", object), n, store.resolve(child)))
        for c in CHILDREN:
            inner, child, n = store.children(np.where(store.kinds(below[c]) == ARRAY, below[c], -1))
            up = path.take(pa.array(objects[inner]))
            level.append((doc[objects[inner]], _path(up, f".{c}[", _int_text(n), "]"), up, np.full(len(n), c, object), n, store.resolve(child)))
        doc, kind, order, node = (np.concatenate([x[i] for x in level]) for i in (0, 3, 4, 5))
        path, parent = (pa.concat_arrays([x[i] for x in level]) for i in (1, 2))


def flatten_sequences(df: DataFrame, name_col: str, json_col: str) -> DataFrame:
    """file, node, parent, kind ('' or the field it hangs below), ord, the fields of every sequence, and whether children are allowed (a null or missing field means they are not).

    Malformed and null texts give no row; null members keep their number but give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                for out in _flatten(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)):
                    yield from out.to_batches()

    return df.select(F.col(name_col).cast("string"), F.col(json_col).cast("string")).where(F.col(json_col).isNotNull()).mapInArrow(run, SCHEMA)


def id_matches() -> Column:
    """Whether a row's id is the one that its place spells; null where it cannot be told."""
    return F.col("id") == browser_id(F.col("species"), F.col("chromosome"), F.col("genome_start"), F.col("genome_end"))


def read_sequence_json(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Sequences and genomes of JSON files at any depth, with id_matches.

    One value per file is read by one task per file, since JSON has no place to cut it; give
    large collections one value per line (per_line) and they are split like any text.
    """
    rows = spark.read.text(path, wholetext=not per_line).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("json"))
    return flatten_sequences(rows, "file", "json").withColumn("id_matches", id_matches())
