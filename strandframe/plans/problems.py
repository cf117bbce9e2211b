"""Queries p2 to p5 over the general problems' tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators.nested import flatten_evaluations
from strandframe.operators.packed import split_packed
from strandframe.operators.periods import periods_and_gaps
from strandframe.operators.rejects import load_lines
from strandframe.plans.base import once
from strandframe.session import table

ENTITY = ["gtf_file", "seqname", "strand"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "gtf_features").where(F.col("strand").isin("+", "-"))
    return periods_and_gaps(rows, ENTITY, "start_pos", "end_pos")


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered and uncovered positions of each entity."""
    spans = p2_found(spark, sf_dir).withColumn("n", F.col("to_pos") - F.col("from_pos") + 1)
    return spans.groupBy(*ENTITY).agg(
        F.count_if(F.col("kind") == "period").alias("periods"),
        F.sum(F.when(F.col("kind") == "period", F.col("n")).otherwise(0)).alias("covered"),
        F.sum(F.when(F.col("kind") == "gap", F.col("n")).otherwise(0)).alias("uncovered"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = once(table(spark, sf_dir, "bed_transcripts"), "bed_id")
    tags = once(table(spark, sf_dir, "gtf_features").where(F.col("attribute") != ""), "feature_id")
    return split_packed(lists, "bed_id", {"block_sizes": "values", "block_starts": "values"}).unionByName(split_packed(tags, "feature_id", {"attribute": "tagged"}))


def p3_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tag occurs, and with how many values at most in one row."""
    tags = once(table(spark, sf_dir, "gtf_features").where(F.col("attribute") != ""), "feature_id")
    rows = split_packed(tags, "feature_id", {"attribute": "tagged"})
    per_row = rows.groupBy("tag", "row_id").agg(F.count("*").alias("n"))
    return per_row.groupBy("tag").agg(F.sum("n").alias("n_values"), F.count("*").alias("n_rows"), F.max("n").alias("most_in_a_row"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_lines(table(spark, sf_dir, "annotation_lines")).where(F.col("reason").isNotNull()).select("line_id", "reason")


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid rows in typed columns (block lists joined again, so that both engines print them alike)."""
    rows = load_lines(table(spark, sf_dir, "annotation_lines")).where(F.col("reason").isNull())
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select("line_id", "file_format", "chrom", "start_pos", "end_pos", "strand", "score", "block_count", join("block_sizes").alias("block_sizes"), join("block_starts").alias("block_starts"), "frame", "attribute")


def _evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_evaluations(once(table(spark, sf_dir, "training_evaluations").where(F.col("payload").isNotNull()), "eval_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluations(spark, sf_dir).where(F.col("kind").isin("occurrence", "sequence", "motif")).select("eval_id", "node", "ident")


def p5_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All linked rows with their parents and typed fields."""
    return _evaluations(spark, sf_dir)


QUERIES = {"p2_found": p2_found, "p2_coverage": p2_coverage, "p3_found": p3_found, "p3_tags": p3_tags, "p4_found": p4_found, "p4_loaded": p4_loaded, "p5_found": p5_found, "p5_linked": p5_linked}

_SPANS = """
WITH rows AS (
    SELECT DISTINCT gtf_file, seqname, strand, start_pos AS s, end_pos AS e FROM gtf_features
    WHERE gtf_file IS NOT NULL AND seqname IS NOT NULL AND strand IN ('+', '-') AND start_pos IS NOT NULL AND end_pos >= start_pos
), seen AS (
    SELECT *, max(e) OVER (PARTITION BY gtf_file, seqname, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rows
), marked AS (
    SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY gtf_file, seqname, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM seen
), periods AS (
    SELECT gtf_file, seqname, strand, min(s) AS a, max(e) AS b FROM marked GROUP BY gtf_file, seqname, strand, run
), spans AS (
    SELECT gtf_file, seqname, strand, 'period' AS kind, a AS from_pos, b AS to_pos FROM periods
    UNION ALL
    SELECT gtf_file, seqname, strand, 'gap', lag_b + 1, a - 1 FROM (SELECT *, lag(b) OVER (PARTITION BY gtf_file, seqname, strand ORDER BY a) AS lag_b FROM periods) WHERE lag_b IS NOT NULL
)
"""

# one rule after another, by patterns over whole columns and casts into wide numbers
_LINES = r"""WITH lines AS (
    SELECT line_id, file_format, file_format = 'bed' AS bed, string_split(l, chr(9)) AS c FROM (SELECT line_id, file_format, rtrim(raw_line, chr(13)) AS l FROM annotation_lines WHERE file_format IN ('bed', 'gtf'))
    WHERE trim(l, ' ' || chr(9)) <> '' AND NOT starts_with(l, '#') AND NOT starts_with(l, 'track') AND NOT starts_with(l, 'browser')
), shaped AS (
    SELECT *, len(c) = CASE WHEN bed THEN 12 ELSE 9 END AS whole, CASE WHEN bed THEN [c[2], c[3], c[7], c[8], c[10]] ELSE [c[4], c[5]] END AS numbers, c[CASE WHEN bed THEN 5 ELSE 6 END] AS score,
        c[CASE WHEN bed THEN 6 ELSE 7 END] AS strand FROM lines
), counted AS (
    SELECT *, list_transform(c, lambda x: length(regexp_replace(x, '\\"|[^"]', '', 'g'))) AS marks, list_bool_and(list_transform(numbers, lambda x: regexp_full_match(x, '\d+'))) AS digits FROM shaped
), judged AS (
    SELECT line_id, file_format, bed, c, CASE WHEN NOT whole THEN 'column_count' WHEN list_bool_or(list_transform(marks, lambda x: x % 2 = 1)) THEN 'quoting'
        WHEN NOT digits OR NOT regexp_full_match(score, '\.|[-+]?\d+(\.\d+)?([eE][-+]?\d+)?') OR strand NOT IN ('+', '-', '.') THEN 'value'
        WHEN bed AND (TRY_CAST(c[2] AS HUGEINT) >= TRY_CAST(c[3] AS HUGEINT) OR list_bool_or(list_transform([c[11], c[12]], lambda x:
            NOT regexp_full_match(x, '"(\d+(,\d+)*,?)?"|(\d+(,\d+)*,?)?') OR len(regexp_extract_all(x, '\d+')) <> TRY_CAST(c[10] AS HUGEINT)))) THEN 'value'
        WHEN NOT bed AND (TRY_CAST(c[4] AS HUGEINT) < 1 OR TRY_CAST(c[4] AS HUGEINT) > TRY_CAST(c[5] AS HUGEINT) OR NOT regexp_full_match(c[8], '[012.]')
            OR NOT regexp_full_match(c[9], '\.|(\s*[\pL_]+ +("([^"\\]|\\.)*"|[^;"\s])("([^"\\]|\\.)*"|[^;"])*(;|$))+\s*')) THEN 'value' END AS reason FROM counted
)
"""

_TAGS = r"""
members AS (
    SELECT feature_id, trim(m, ' ' || chr(9)) AS m FROM (
        SELECT feature_id, unnest(regexp_extract_all(attribute, '(?:"(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''|[^;,|"''])+')) AS m
        FROM (SELECT DISTINCT feature_id, attribute FROM gtf_features WHERE attribute IS NOT NULL)
    )
)
"""

def _open(x: str) -> str:
    """A JSON value; one that arrives as JSON text counts as that value."""
    text = f"TRY_CAST({x} ->> '$' AS JSON)"
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_type({text}) IN ('ARRAY', 'OBJECT') THEN {text} ELSE {x} END"


def _items(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [] END"


# one level after the other, by the engine's own JSON functions
_NESTED = f"""WITH RECURSIVE runs AS (
    SELECT eval_id, {_open("CAST(payload AS JSON)")} AS p FROM (SELECT DISTINCT eval_id, payload FROM training_evaluations WHERE json_valid(payload))
), listed AS (SELECT eval_id, {_open("(p -> 'links')")} AS l, {_open("(p -> 'motifs')")} AS m FROM runs),
links AS (SELECT eval_id, i - 1 AS i, {_open("x")} AS x FROM (SELECT eval_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT eval_id, {_items("l")} AS ls FROM listed))),
groups AS (SELECT eval_id, i, j - 1 AS j, {_open("x")} AS x FROM (SELECT eval_id, i, unnest(gs) AS x, generate_subscripts(gs, 1) AS j FROM (SELECT eval_id, i, {_items("o")} AS gs FROM (SELECT eval_id, i, {_open("(x -> 'occs')")} AS o FROM links WHERE json_type(x) = 'OBJECT')))),
members AS (
    SELECT eval_id, i, j, k - 1 AS k, {_open("x")} AS x FROM (SELECT eval_id, i, j, unnest(ms) AS x, generate_subscripts(ms, 1) AS k FROM (
        SELECT eval_id, i, j, CASE WHEN json_type(x) = 'OBJECT' OR json_type(x) = 'ARRAY' AND json_type({_open("(x -> 0)")}) = 'VARCHAR' THEN [x] ELSE {_items("x")} END AS ms FROM groups))
), occs AS (
    SELECT eval_id, 'links[' || i || ']' AS parent, 'links[' || i || '].occs[' || j || '][' || k || ']' AS node, k AS ord, x, CASE json_type(x) WHEN 'ARRAY' THEN x -> 0 WHEN 'OBJECT' THEN {_open("(x -> 'sequence')")} END AS s FROM members WHERE json_type(x) IN ('ARRAY', 'OBJECT')
), tree AS (
    SELECT eval_id, parent, node, ord, x AS occ, CASE json_type(s) WHEN 'OBJECT' THEN s ->> 'id' WHEN 'VARCHAR' THEN s ->> '$' END AS ident, CASE WHEN json_type(s) = 'OBJECT' THEN s END AS s FROM occs
    UNION ALL
    SELECT eval_id, parent, node, ord, NULL, x ->> 'id', x FROM (SELECT eval_id, node AS parent, node || '.' || key || '[' || (n - 1) || ']' AS node, n - 1 AS ord, {_open("x")} AS x FROM (
        SELECT eval_id, node, key, unnest(cs) AS x, generate_subscripts(cs, 1) AS n FROM (SELECT eval_id, node, key, {_items("c")} AS cs FROM (SELECT eval_id, node, key, {_open("(s -> key)")} AS c FROM tree, (VALUES ('genomic_elements'), ('homology')) v(key) WHERE s IS NOT NULL)))) WHERE json_type(x) = 'OBJECT'
), cubes AS (
    SELECT eval_id, {_open("(m -> 'motifs')")} AS c, list_transform({_items("al")}, lambda a: a ->> '$') AS letters FROM (SELECT eval_id, m, {_open("(m -> 'alphabet')")} AS al FROM listed WHERE json_type(m) = 'OBJECT')
), cells AS (
    SELECT eval_id, pos, letters[l] AS letter, l, unnest(vs) AS v, generate_subscripts(vs, 1) - 1 AS u FROM (
        SELECT eval_id, pos, letters, l, CASE WHEN json_type(row_) = 'ARRAY' THEN CAST(row_ AS DOUBLE[]) END AS vs FROM (
            SELECT eval_id, pos, letters, unnest(rows_) AS row_, generate_subscripts(rows_, 1) AS l FROM (
                SELECT eval_id, letters, pos, {_items("x")} AS rows_ FROM (SELECT eval_id, letters, unnest(ps) AS x, generate_subscripts(ps, 1) AS pos FROM (SELECT eval_id, letters, {_items("c")} AS ps FROM cubes)))))
), best AS (SELECT eval_id, u, pos, arg_max(letter, (v, -l)) FILTER (v IS NOT NULL) AS letter FROM cells GROUP BY ALL)
"""

ORACLE = {
    "p2_found": _SPANS + "SELECT * FROM spans",
    "p2_coverage": _SPANS
    + """SELECT gtf_file, seqname, strand, CAST(count(*) FILTER (kind = 'period') AS BIGINT) AS periods,
    CAST(sum(CASE WHEN kind = 'period' THEN to_pos - from_pos + 1 ELSE 0 END) AS BIGINT) AS covered, CAST(sum(CASE WHEN kind = 'gap' THEN to_pos - from_pos + 1 ELSE 0 END) AS BIGINT) AS uncovered
    FROM spans GROUP BY ALL""",
    "p3_tags": "WITH "
    + _TAGS
    + r"""SELECT tag, CAST(sum(n) AS BIGINT) AS n_values, count(*) AS n_rows, max(n) AS most_in_a_row FROM (
        SELECT regexp_extract(m, '^[^\s=]+') AS tag, feature_id, count(*) AS n FROM members WHERE m <> '' GROUP BY 1, 2) GROUP BY tag""",
    "p3_found": "WITH "
    + _TAGS
    + r""", cut AS (
    SELECT feature_id, row_number() OVER (PARTITION BY feature_id ORDER BY place) - 1 AS pos, m FROM (
        SELECT feature_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS place FROM (
            SELECT feature_id, list_filter(list_transform(regexp_extract_all(attribute, '(?:"(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''|[^;,|"''])+'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS ms
            FROM (SELECT DISTINCT feature_id, attribute FROM gtf_features WHERE attribute IS NOT NULL)))
), tagged AS (
    SELECT feature_id, pos, regexp_extract(m, '^[^\s=]+') AS tag, regexp_replace(m, '^[^\s=]+\s*=?\s*', '') AS v FROM cut
), blocks AS (
    SELECT field, bed_id, unnest(vs) AS val, generate_subscripts(vs, 1) - 1 AS pos FROM (
        SELECT field, bed_id, regexp_extract_all(t, '[^,;|\s"'']+') AS vs FROM (
            SELECT DISTINCT 'block_sizes' AS field, bed_id, block_sizes AS t FROM bed_transcripts
            UNION ALL SELECT DISTINCT 'block_starts', bed_id, block_starts FROM bed_transcripts) WHERE t IS NOT NULL)
)
SELECT field, bed_id AS row_id, CAST(pos AS INTEGER) AS pos, '' AS tag, val FROM blocks
UNION ALL
SELECT 'attribute', feature_id, CAST(pos AS INTEGER), tag,
    trim(CASE WHEN regexp_full_match(v, '".*"') THEN replace(replace(substr(v, 2, length(v) - 2), '\"', '"'), '""', '"')
        WHEN regexp_full_match(v, '''.*''') THEN replace(replace(substr(v, 2, length(v) - 2), '\''', ''''), '''''', '''') ELSE v END) FROM tagged""",
    "p5_found": _NESTED + "SELECT eval_id, node, ident FROM tree UNION ALL SELECT eval_id, 'motifs[' || u || ']', string_agg(letter, '' ORDER BY pos) FROM best GROUP BY eval_id, u",
    "p5_linked": _NESTED + """, described AS (
    SELECT eval_id, CASE WHEN occ IS NULL THEN 'sequence' ELSE 'occurrence' END AS kind, node, parent, ident, ord, s ->> 'species' AS species, s ->> 'chromosome' AS chromosome,
        CASE WHEN occ IS NULL THEN s ->> 'strand' WHEN json_type(occ) = 'ARRAY' THEN occ ->> 2 ELSE occ ->> 'strand' END AS strand, TRY_CAST(s ->> 'genome_start' AS BIGINT) AS genome_start, TRY_CAST(s ->> 'genome_end' AS BIGINT) AS genome_end,
        TRY_CAST(CASE WHEN json_type(occ) = 'ARRAY' THEN occ ->> 1 ELSE occ ->> 'position' END AS BIGINT) AS position, TRY_CAST(CASE WHEN json_type(occ) = 'ARRAY' THEN occ ->> 3 ELSE occ ->> 'sitelen' END AS BIGINT) AS sitelen,
        TRY_CAST(CASE WHEN json_type(occ) = 'ARRAY' THEN occ ->> 4 ELSE occ ->> 'profileIdx' END AS BIGINT) AS profile_idx FROM tree
), plain AS (
    SELECT eval_id, 'run' AS kind, '$' AS node, NULL AS parent, p ->> 'runID' AS ident, 0 AS ord, TRY_CAST(p ->> 'nlinks' AS BIGINT) AS n_links, TRY_CAST(p ->> 'nlinksThatHit' AS BIGINT) AS n_links_hit, TRY_CAST(p ->> 'trainingTime' AS DOUBLE) AS training_time FROM runs
    UNION ALL SELECT eval_id, 'link', 'links[' || i || ']', '$', x ->> 'classname', i, NULL, NULL, NULL FROM links WHERE json_type(x) = 'OBJECT'
    UNION ALL SELECT eval_id, 'motif', 'motifs[' || u || ']', '$', string_agg(letter, '' ORDER BY pos), u, NULL, NULL, NULL FROM best GROUP BY eval_id, u
)
SELECT eval_id, kind, node, parent, ident, CAST(ord AS INTEGER) AS ord, species, chromosome, strand, genome_start, genome_end, position, sitelen, profile_idx, CAST(NULL AS BIGINT) AS n_links, CAST(NULL AS BIGINT) AS n_links_hit, CAST(NULL AS DOUBLE) AS training_time FROM described
UNION ALL SELECT eval_id, kind, node, parent, ident, CAST(ord AS INTEGER), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, n_links, n_links_hit, training_time FROM plain""",
    "p4_found": _LINES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_loaded": _LINES + """SELECT line_id, file_format, c[1] AS chrom, CAST(c[CASE WHEN bed THEN 2 ELSE 4 END] AS BIGINT) AS start_pos, CAST(c[CASE WHEN bed THEN 3 ELSE 5 END] AS BIGINT) AS end_pos,
    c[CASE WHEN bed THEN 6 ELSE 7 END] AS strand, TRY_CAST(c[CASE WHEN bed THEN 5 ELSE 6 END] AS DOUBLE) AS score, CASE WHEN bed THEN CAST(c[10] AS BIGINT) END AS block_count,
    CASE WHEN bed THEN array_to_string(list_transform(regexp_extract_all(c[11], '\\d+'), lambda x: CAST(x AS BIGINT)), ',') END AS block_sizes,
    CASE WHEN bed THEN array_to_string(list_transform(regexp_extract_all(c[12], '\\d+'), lambda x: CAST(x AS BIGINT)), ',') END AS block_starts,
    CASE WHEN NOT bed THEN TRY_CAST(c[8] AS INTEGER) END AS frame, CASE WHEN NOT bed THEN c[9] END AS attribute FROM judged WHERE reason IS NULL""",
}
