"""Table functions for SQL: six_frames(seq), tiles(seq, size), kmers(seq, k).

They are SQL functions over built-in expressions, so the planner inlines them and they run in the
JVM. Texts meet them row by row; for whole corpora of long texts use the kernels in
`operators.letters`, which never hold all windows of a text at once.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from strandframe.functions.seq import CODONS, DNA_COMPLEMENT, DNA_LETTERS

_TABLE = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in CODONS.items()) + ")"


def _frame(seq: str, shift: int) -> str:
    return f"array_join(transform(regexp_extract_all(substring({seq}, {shift + 1}), '(?s)(...)', 1), c -> coalesce(try_element_at({_TABLE}, c), ' ')), '')"


FUNCTIONS = {
    "six_frames": "(seq STRING) RETURNS TABLE(frame INT, residues STRING) RETURN SELECT f, r FROM (SELECT posexplode(array("
    + ", ".join(_frame(s, k) for s in ("seq", f"reverse(translate(seq, '{DNA_LETTERS}', '{DNA_COMPLEMENT}'))") for k in range(3))
    + ")) AS (f, r)) WHERE r IS NOT NULL",
    "tiles": "(seq STRING, size INT) RETURNS TABLE(tile_ord INT, tile_start INT, tile STRING) RETURN SELECT k, k * size, t FROM (SELECT posexplode(regexp_extract_all(seq, concat('(?s)(.{1,', greatest(size, 1), '})'), 1)) AS (k, t)) WHERE size > 0",
    "kmers": "(seq STRING, k INT) RETURNS TABLE(pos INT, kmer STRING) RETURN SELECT p, w FROM (SELECT posexplode(regexp_extract_all(seq, concat('(?s)(?=(.{', greatest(k, 1), '}))'), 1)) AS (p, w)) WHERE k > 0",
}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to a session's SQL."""
    for name, text in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{text}")
