"""Further queries: writers' rows, audits, schedules and integrity checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.functions import udtf
from strandframe.operators import kmers as K
from strandframe.operators import summaries as R
from strandframe.operators.nested import flatten_evaluations
from strandframe.plans.base import DNA, dna, sql
from strandframe.plans.problems import _NESTED
from strandframe.session import table
from strandframe.sources.formats import fasta_record

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return add


_FIRST = "CASE WHEN species = 'Homo_sapiens' THEN 0 ELSE 1 END"


@query(sql(DNA, query=f"SELECT chromosome, row_number() OVER (PARTITION BY chromosome ORDER BY {_FIRST}, species, seq_id) AS place, '>' || species || chr(10) || upper(seq) AS record FROM seqs"))
def human_first_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined records per group, the first species ahead, unmasked; places are found without the letters."""
    rows = dna(spark, sf_dir)
    narrow = rows.select("chromosome", F.when(F.col("species") == "Homo_sapiens", 0).otherwise(1).alias("first"), "species", "seq_id", F.lit(1).cast("bigint").alias("one"))
    placed = K.running_total(narrow, ["chromosome"], ["first", "species", "seq_id"], "one").select("seq_id", (F.col("before") + 1).alias("place"))
    return rows.join(placed, "seq_id").select("chromosome", "place", fasta_record(F.col("species"), F.upper("seq")).alias("record"))


@query(sql(DNA, query="SELECT seq_id, rpad(species, 20, ' ') || seq AS line, repeat('.', 9) || '|' AS ruler_unit, length(seq) // 10 AS ruler_units, CASE WHEN regexp_matches(substr(seq, length(seq) // 4 + 1, length(seq) // 2 - length(seq) // 4), '[acgtnN]') THEN '_lowercase' ELSE '' END AS suffix FROM seqs"))
def clustal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.substring(F.col("seq"), (F.expr("length(seq) div 4") + 1).cast("int"), (F.expr("length(seq) div 2") - F.expr("length(seq) div 4")).cast("int"))
    return dna(spark, sf_dir).select("seq_id", F.concat(F.rpad("species", 20, " "), "seq").alias("line"), F.concat(F.repeat(F.lit("."), 9), F.lit("|")).alias("ruler_unit"), F.expr("length(seq) div 10").alias("ruler_units"), F.when(inner.rlike("[acgtnN]"), "_lowercase").otherwise("").alias("suffix"))


@query(sql(DNA, query="""SELECT seq_id, to_json({seq_start: g_start, seq_stop: g_start + length(seq), exon_start: g_start + length(seq) // 4, exon_stop: g_start + length(seq) // 2, rel_start: CASE WHEN r THEN length(seq) - length(seq) // 2 ELSE length(seq) // 4 END,
    rel_stop: CASE WHEN r THEN length(seq) - length(seq) // 4 ELSE length(seq) // 2 END, length: length(seq), reverse: r}) AS described FROM (SELECT *, seq_id % 2 = 1 AS r FROM seqs)"""))
def description_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of a sequence and its exon, in the genome and on the strand in use, as one JSON text."""
    n, a, b, r = F.length("seq").cast("bigint"), F.expr("length(seq) div 4"), F.expr("length(seq) div 2"), F.col("seq_id") % 2 == 1
    s = F.struct(
        F.col("g_start").alias("seq_start"), (F.col("g_start") + n).alias("seq_stop"), (F.col("g_start") + a).alias("exon_start"), (F.col("g_start") + b).alias("exon_stop"),
        F.when(r, n - b).otherwise(a).alias("rel_start"), F.when(r, n - a).otherwise(b).alias("rel_stop"), n.alias("length"), r.alias("reverse"),
    )
    return dna(spark, sf_dir).select("seq_id", F.to_json(s).alias("described"))


@query(sql(DNA, query="SELECT chromosome, count(*) AS n, count(DISTINCT sequence_id) = count(*) AS ids_unique, count(DISTINCT species) AS n_species, bool_or(species = 'Homo_sapiens') AS has_home, count(*) >= 2 AND bool_or(species = 'Homo_sapiens') AND count(DISTINCT sequence_id) = count(*) AS kept FROM seqs GROUP BY chromosome"))
def sequence_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = F.count_distinct("sequence_id") == F.count("*")
    home = F.bool_or(F.col("species") == "Homo_sapiens")
    return dna(spark, sf_dir).groupBy("chromosome").agg(F.count("*").alias("n"), unique.alias("ids_unique"), F.count_distinct("species").alias("n_species"), home.alias("has_home"), ((F.count("*") >= 2) & home & unique).alias("kept"))


@query("SELECT event_id % 10 AS purity, count(DISTINCT CASE WHEN value >= 150 THEN user_id END) AS found, count(DISTINCT user_id) AS tried FROM events GROUP BY 1")
def motifs_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy((F.col("event_id") % 10).alias("purity")).agg(F.count_distinct(F.when(F.col("value") >= 150, F.col("user_id"))).alias("found"), F.count_distinct("user_id").alias("tried"))


@query("SELECT event_type AS model, round(avg(value * (event_id % 7) / 6.0), 6) AS mean_loss, round(max(value), 6) AS best_score FROM events GROUP BY 1")
def mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of loss times validity weight per model (no weighted mean)."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg(F.col("value") * (F.col("event_id") % 7) / 6.0), 6).alias("mean_loss"), F.round(F.max("value"), 6).alias("best_score"))


@query("WITH s AS (SELECT species, min(loaded_at) AS seen FROM sequences WHERE species IS NOT NULL GROUP BY species) SELECT species, CAST(dense_rank() OVER (ORDER BY seen, species) - 1 AS BIGINT) AS genome_idx FROM s")
def genome_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species numbered in order of first arrival (one row per species)."""
    seen = table(spark, sf_dir, "sequences").where(F.col("species").isNotNull()).groupBy("species").agg(F.min("loaded_at").alias("seen"))
    return seen.select("species", (F.dense_rank().over(Window.orderBy("seen", "species")) - 1).cast("bigint").alias("genome_idx"))


@query("SELECT DISTINCT t.sequence_id FROM tileable_sequences t WHERE t.sequence_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sequences s WHERE s.sequence_id = t.sequence_id)")
def missing_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "tileable_sequences").where(F.col("sequence_id").isNotNull()).select("sequence_id").distinct()
    return ids.join(table(spark, sf_dir, "sequences").select("sequence_id"), "sequence_id", "left_anti")


@query("SELECT species, count(*) AS n FROM (SELECT DISTINCT s.species, s.sequence_id FROM sequences s WHERE EXISTS (SELECT 1 FROM genomes g WHERE g.species = s.species)) GROUP BY species")
def genome_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sequences").select("species", "sequence_id").distinct()
    return rows.join(table(spark, sf_dir, "genomes").select("species"), "species", "left_semi").groupBy("species").agg(F.count("*").alias("n"))


@query(_NESTED + "SELECT eval_id, count(*) AS n_occs, count(*) FILTER (NOT EXISTS (SELECT 1 FROM sequences q WHERE q.sequence_id = t.ident)) AS n_unknown FROM tree t WHERE node NOT LIKE '%].genomic_elements[%' AND node NOT LIKE '%].homology[%' GROUP BY eval_id")
def occurrence_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each evaluation, and how many of them lie on unknown sequences."""
    once = table(spark, sf_dir, "training_evaluations").where(F.col("payload").isNotNull()).select("eval_id", "payload").dropDuplicates()
    occ = flatten_evaluations(once).where("kind = 'occurrence'").select("eval_id", "node", F.col("ident").alias("sequence_id"))
    known = table(spark, sf_dir, "sequences").select("sequence_id").distinct().withColumn("known", F.lit(True))
    # counted per id first, so that a hot sequence meets the join once per evaluation
    per = occ.groupBy("eval_id", "sequence_id").agg(F.count("*").alias("n")).join(known, "sequence_id", "left")
    return per.groupBy("eval_id").agg(F.sum("n").alias("n_occs"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("n_unknown"))


@query(sql(DNA, query="SELECT seq_id, i AS tile_ord, i * 500 AS tile_start, length(substr(seq, i * 500 + 1, 500)) AS n FROM seqs, LATERAL (SELECT unnest(range(CAST(ceil(length(seq) / 500.0) AS BIGINT))) AS i)"))
def tiles_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function form, as SQL users call it."""
    udtf.register(spark)
    dna(spark, sf_dir).createOrReplaceTempView("_dna_texts")
    return spark.sql("SELECT seq_id, CAST(tile_ord AS BIGINT) AS tile_ord, CAST(tile_start AS BIGINT) AS tile_start, CAST(length(tile) AS BIGINT) AS n FROM _dna_texts, LATERAL tiles(seq, 500)")


@query("""WITH RECURSIVE rows AS (SELECT user_id, event_id, value, row_number() OVER w - 1 AS i, min(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent, lag(value, 5) OVER w AS before
        FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    walk AS (
        SELECT user_id, event_id, i, CAST(2.0 AS DOUBLE) AS rate, -1 AS rest FROM rows WHERE i = 0
        UNION ALL
        SELECT r.user_id, r.event_id, r.i, CASE WHEN w.rest <= 1 AND r.recent >= r.before THEN w.rate * 0.75 ELSE w.rate END, CASE WHEN w.rest <= 1 AND r.recent >= r.before THEN 5 ELSE w.rest - 1 END FROM walk w JOIN rows r ON r.user_id = w.user_id AND r.i = w.i + 1)
    SELECT event_id, round(rate, 9) AS rate FROM walk""")
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate schedule of each run: a fall after 5 epochs without a better loss, then 5 epochs of rest."""
    rows = table(spark, sf_dir, "events").where(F.col("value").isNotNull() & F.col("user_id").isNotNull()).select("user_id", "ts", "event_id", "value")
    return R.learning_rates(rows, "user_id", ["ts", "event_id"], "value", start=2.0, factor=0.75, patience=5).select("event_id", F.round("rate", 9).alias("rate"))
