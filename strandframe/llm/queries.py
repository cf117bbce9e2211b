"""Queries p1, p6, p7 and p8 over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import garble, mix, split, tokens
from strandframe.plans.base import once
from strandframe.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # re-delivered rows agree in everything but the arrival: the small results are made distinct, not the texts
    return split.cut_kinds(table(spark, sf_dir, "tileable_sequences")).distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "tileable_sequences")
    return split.pieces(once(rows.where(F.col("seq") != ""), "tileable_id"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    return mix.sized_documents(table(spark, sf_dir, "documents"), targets), targets


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, targets = _sized(spark, sf_dir)
    return mix.mix(sized, mix.plan_mix(sized, targets))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached with the size of all listed sources as total, and with the greatest total at which every source with documents can meet its share."""
    sized, targets = _sized(spark, sf_dir)
    full, met = mix.plan_mix(sized, targets), mix.plan_mix(sized, targets, meet_shares=True)
    return mix.shares(sized, full).withColumn("total", F.lit("all")).unionByName(mix.shares(sized, met).withColumn("total", F.lit("met")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.repair(table(spark, sf_dir, "documents")).where("garbled").select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.repair(table(spark, sf_dir, "documents")).where("garbled")


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_restored": p8_restored}
# letters, runs and stretches of every text; nodes that stay whole once oversized runs are opened; then one walk over their ends
_NODES = """texts AS (
    SELECT DISTINCT tileable_id AS id, seq, coalesce(alphabet = 'aa', false) AS aa, coalesce(tile_size, 0) AS size, greatest(coalesce(tile_overlap, 0), 0) AS wished, length(seq) AS n FROM tileable_sequences WHERE seq <> ''
), big AS (
    SELECT *, CASE WHEN size > 0 THEN size ELSE n END AS t, CASE WHEN size > 0 THEN least(wished, size - 1) ELSE 0 END AS o FROM texts
), letters AS (
    SELECT id, aa, t, o, n, i, substr(seq, i, 1) AS c FROM big, LATERAL (SELECT unnest(range(1, n + 1)) AS i)
), classed AS (
    SELECT *, CASE WHEN c IN ('N', 'n') AND NOT aa OR c IN ('X', 'x', ' ') AND aa THEN 1 WHEN regexp_full_match(c, '[a-z]') THEN 2 ELSE 0 END AS k FROM letters
), ends AS (
    SELECT id, t, o, n, i AS p, k2 IS NULL OR k <> k2 AS is_run FROM (SELECT *, lead(k) OVER (PARTITION BY id ORDER BY i) AS k2 FROM classed) WHERE k2 IS NULL OR k <> k2 OR aa AND c = '*'
), runs AS (
    SELECT id, p, s, p - s <= t - CASE WHEN s > 0 THEN o ELSE 0 END AS fits FROM (SELECT *, lag(p, 1, 0) OVER (PARTITION BY id ORDER BY p) AS s FROM ends WHERE is_run)
), borders AS (
    SELECT e.id, e.p FROM ends e JOIN runs r ON r.id = e.id AND e.p > r.s AND e.p <= r.p WHERE (e.is_run OR NOT r.fits) AND e.p < e.n
)"""
_WALK = """walk AS (
    SELECT id, t, o, n, CAST(0 AS BIGINT) AS no, CAST(0 AS BIGINT) AS a, CAST(NULL AS BIGINT) AS e0, least(CAST(t AS BIGINT), n) AS reach FROM big
    UNION ALL
    SELECT id, t, o, n, no + 1, e - o, e, least(e - o + t, n) FROM (
        SELECT w.id, t, o, n, no, coalesce(max(p), any_value(reach)) AS e FROM walk w LEFT JOIN borders b ON b.id = w.id AND p <= reach AND p > greatest(coalesce(e0, 0), o - 1) WHERE reach < n GROUP BY w.id, t, o, n, no)
)"""

ORACLE = {
    "p1_found": """WITH RECURSIVE big AS (
    SELECT DISTINCT tileable_id AS id, seq, alphabet = 'aa' AS aa, tile_size AS t, greatest(coalesce(tile_overlap, 0), 0) AS o, length(seq) AS n FROM tileable_sequences WHERE tile_size > 0 AND length(seq) > tile_size
), letters AS (
    SELECT id, aa, i, substr(seq, i, 1) AS c FROM big, LATERAL (SELECT unnest(range(1, n + 1)) AS i)
), classed AS (
    SELECT *, CASE WHEN c IN ('N', 'n') AND NOT aa OR c IN ('X', 'x', ' ') AND aa THEN 1 WHEN regexp_full_match(c, '[a-z]') THEN 2 ELSE 0 END AS k FROM letters
), borders AS (
    SELECT id, i AS p FROM (SELECT *, lead(k) OVER (PARTITION BY id ORDER BY i) AS k2 FROM classed) WHERE k2 IS NOT NULL AND (k <> k2 OR aa AND c = '*')
), walk AS (
    SELECT id, t, o, n, CAST(0 AS BIGINT) AS e, CAST(t AS BIGINT) AS reach FROM big
    UNION ALL
    SELECT w.id, t, o, n, max(p) AS e, max(p) - o + t AS reach FROM walk w JOIN borders b ON b.id = w.id AND p <= reach AND p > greatest(e, o - 1) WHERE reach < n GROUP BY w.id, t, o, n
) SELECT id AS tileable_id, CASE WHEN bool_or(reach >= n) THEN 'natural' ELSE 'forced' END AS cut FROM walk GROUP BY id""",
    "p1_pieces": f"""WITH RECURSIVE {_NODES}, {_WALK}, cuts AS (
    SELECT w.id, no, a, coalesce(lead(e0) OVER (PARTITION BY w.id ORDER BY no), w.n) AS e, w.n FROM walk w
) SELECT id AS tileable_id, CAST(no AS INTEGER) AS piece_no, a AS piece_start, e AS piece_end, e = c.n OR EXISTS (SELECT 1 FROM borders b WHERE b.id = c.id AND b.p = c.e) AS natural_end,
    substr(seq, CAST(a + 1 AS BIGINT), CAST(e - a AS BIGINT)) AS piece FROM cuts c JOIN big USING (id)""",
}
