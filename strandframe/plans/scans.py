"""Queries over the file formats: tables are written in a format, below the shared checkpoint folder, and scanned from there; and the writers' records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.seq import softmask
from strandframe.operators import datasets as D
from strandframe.operators import kmers as K
from strandframe.operators import links as L
from strandframe.operators import profiles as P
from strandframe.plans.annotations import _SEEDS, occurrences
from strandframe.plans.base import DNA, FEATURES, TRANSCRIPTS, dna, features, once, sql, transcripts
from strandframe.plans.models import _LOGITS, _P, logits
from strandframe.session import scratch_path, table
from strandframe.sources import formats, records

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return add


@query(sql(DNA, query="SELECT sequence_id AS id, species, chromosome, seq FROM seqs"))
def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "fasta")
    formats.write_fasta(dna(spark, sf_dir), path, "sequence_id", "seq")
    return formats.read_fasta(spark, path)


@query(sql(FEATURES, query="SELECT 'feature ' || feature_id AS attribute, seqname, s AS start_pos, e AS end_pos, score FROM feats WHERE seqname = 'chr7' AND feature = 'exon' AND strand = '+' AND e >= 100001 AND s + 1 <= 60000000 AND score >= 0.5"))
def gtf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GTF lines read with all kinds of filters, which the scan applies."""
    path = scratch_path(spark, "gtf")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    attribute = F.concat(F.lit("feature "), F.col("feature_id").cast("string"))
    features(spark, sf_dir).select(F.concat_ws("\t", "seqname", dot("source"), dot("feature"), (F.col("s") + 1).cast("string"), F.col("e").cast("string"), dot("score"), "strand", dot("frame"), attribute)).write.text(path)
    out = formats.read_gtf(spark, path, seqname="chr7", feature="exon", strand="+", range_start=100000, range_end=60000000, min_score=0.5)
    return out.select("attribute", "seqname", "start_pos", "end_pos", "score")


@query(sql(TRANSCRIPTS, query="SELECT CAST(bed_id AS VARCHAR) AS name, chrom, chrom_start, chrom_end, block_count, CAST(list_sum(sizes) AS BIGINT) AS covered, list_last(starts) AS last_start FROM tx WHERE chrom_end IS NOT NULL AND block_count > 0"))
def bed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED12 lines read with their block lists as arrays."""
    path = scratch_path(spark, "bed")
    numbers = lambda c: F.concat(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(","))
    text = lambda c: F.col(c).cast("string")
    rows = transcripts(spark, sf_dir).where(F.col("chrom_end").isNotNull() & (F.col("block_count") > 0))
    rows.select(F.concat_ws("\t", "chrom", text("chrom_start"), text("chrom_end"), text("bed_id"), F.lit("0"), F.coalesce("strand", F.lit(".")), text("chrom_start"), text("chrom_end"), F.lit("0"), text("block_count"), numbers("sizes"), numbers("starts"))).write.text(path)
    back = formats.read_bed(spark, path)
    return back.select("name", "chrom", "chrom_start", "chrom_end", "block_count", F.aggregate("block_sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("covered"), F.element_at("block_starts", -1).alias("last_start"))


_PRINTED = "SELECT 'profile' || profile_idx AS motif, pos, letter, CAST(printf('%.6f', value) AS DOUBLE) AS p FROM p"


@query(sql(_LOGITS, _P, query=_PRINTED))
def meme_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "meme")
    formats.write_meme(P.softmax_rows(logits(spark, sf_dir)), path)
    return formats.read_meme(spark, path, alphabet="ACGT")


@query(sql(_LOGITS, _P, query=_PRINTED))
def motif_xml_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motifs of an XML report; letters that it never uses are left out."""
    path = scratch_path(spark, "xml")
    cells = P.softmax_rows(logits(spark, sf_dir)).groupBy("profile_idx", "pos").agg(F.array_sort(F.collect_list(F.struct("letter", F.format_string("%.6f", "value").alias("v")))).alias("c"))
    line = F.concat(F.lit("<pos "), F.array_join(F.transform("c", lambda x: F.concat(x["letter"], F.lit('="'), x["v"], F.lit('"'))), " "), F.lit(' U="0"/>'))
    motifs = cells.groupBy("profile_idx").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("x")))).alias("l"))
    motifs.select(F.concat(F.lit('<motif id="profile'), F.col("profile_idx").cast("string"), F.lit('">'), F.array_join(F.transform("l", lambda x: x["x"]), ""), F.lit("</motif>"))).write.text(path)
    return formats.read_motif_xml(spark, path)


_PLACES = "SELECT DISTINCT sequence_id, species, chromosome, strand, genome_start, genome_end FROM sequences WHERE sequence_id IS NOT NULL AND species IS NOT NULL AND chromosome IS NOT NULL AND genome_start IS NOT NULL AND genome_end IS NOT NULL"


@query(f"""SELECT 'g' || level AS classname, sequence_id || CASE WHEN level = 0 THEN '' ELSE '#' || level END AS id, CASE level WHEN 0 THEN '' WHEN 2 THEN 'homology' ELSE 'genomic_elements' END AS kind, genome_start + level AS genome_start, genome_end,
    level % 2 = 0 AND level < 4 AS elements_allowed, level = 1 OR level = 3 AS homology_allowed, level = 0 AND sequence_id = species || ':' || chromosome || ':' || format('{{:,}}', genome_start) || '-' || format('{{:,}}', genome_end) AS id_matches
    FROM ({_PLACES}) s, range(5) r(level) WHERE level <> 4""")
def sequence_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences as JSON, each with children of children of children, read at any depth."""
    path = scratch_path(spark, "json")
    have = [F.col(c).isNotNull() for c in ("sequence_id", "species", "chromosome", "genome_start", "genome_end")]
    rows = table(spark, sf_dir, "sequences").where(have[0] & have[1] & have[2] & have[3] & have[4]).select("sequence_id", "species", "chromosome", "strand", "genome_start", "genome_end").distinct()

    def record(level: int):
        inner = [F.array(record(level + 1)).alias("genomic_elements" if level % 2 == 0 else "homology")] if level < 3 else [F.array().cast("array<string>").alias("homology")]
        ident = F.concat("sequence_id", F.lit(f"#{level}" if level else ""))
        return F.struct(ident.alias("id"), "species", "chromosome", "strand", (F.col("genome_start") + level).alias("genome_start"), "genome_end", F.lit(f"g{level}").alias("classname"), *inner)

    rows.select(F.to_json(record(0))).write.text(path)
    back = records.read_sequence_json(spark, path, per_line=True)
    return back.select("classname", "id", "kind", "genome_start", "genome_end", "elements_allowed", "homology_allowed", "id_matches")


@query(sql(DNA, _SEEDS, query="SELECT 'MOTIF-' || profile AS motif, sequence_id, pos AS position, CASE WHEN profile % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(CASE WHEN profile % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS frame, CAST(8 AS BIGINT) AS site_len FROM occ JOIN seqs USING (seq_id)"))
def site_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site table of an external finder (1-based, sequences under aliases), joined back to the sequences."""
    path = scratch_path(spark, "sites")
    occ = occurrences(spark, sf_dir).select("profile", "seq_id", "pos")
    name = F.concat(F.lit("MOTIF-"), F.col("profile").cast("string"))
    sites = occ.select(name.alias("motif_ID"), name.alias("motif_ALT_ID"), F.lit("1e-3").alias("motif_P"), F.concat(F.lit("seq"), F.col("seq_id").cast("string")).alias("seq_ID"), (F.col("pos") + 1).alias("site_Start"), (F.col("pos") + 8).alias("site_End"), F.when(F.col("profile") % 2 == 0, "+").otherwise("-").alias("site_Strand"), F.lit(1.5).alias("site_Score"))
    sites.write.option("sep", "\t").option("header", "true").csv(path)
    aliases = dna(spark, sf_dir).select(F.concat(F.lit("seq"), F.col("seq_id").cast("string")).alias("alias"), "sequence_id")
    return formats.read_site_table(spark, path, aliases).withColumnRenamed("motif_ALT_ID", "motif")


@query(sql(DNA, _SEEDS, """told AS (SELECT profile, o.species, seq_id, pos, '["' || sequence_id || '", ' || pos || ', "+", 8, ' || profile || ']' AS t FROM occ o JOIN seqs USING (seq_id))""",
           "grouped AS (SELECT profile, species, string_agg(t, ', ' ORDER BY seq_id, pos) AS g FROM told GROUP BY ALL)",
           query="""SELECT profile, '{"occs": [' || string_agg('[' || g || ']', ', ' ORDER BY species) || '], "singleProfile": true, "classname": "MultiLink"}' AS record FROM grouped GROUP BY profile"""))
def link_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-links as the JSON of an evaluation, their occurrences as tuples."""
    texts = dna(spark, sf_dir).select("seq_id", "sequence_id")
    return L.link_records(occurrences(spark, sf_dir).select("profile", "species", "seq_id", "pos").join(texts, "seq_id"), 8)


@query("""SELECT row_number() OVER (ORDER BY sn DESC NULLS LAST, sp DESC NULLS LAST, experiment) AS place, experiment, round(sn, 9) AS sensitivity, round(sp, 9) AS specificity FROM (
    SELECT experiment, sum(a) / nullif(sum(b), 0) AS sn, sum(d) / nullif(sum(c), 0) AS sp FROM (SELECT DISTINCT eval_id, experiment, TRY_CAST(payload ->> '$.nexonsHit' AS BIGINT) AS a, TRY_CAST(payload ->> '$.nhumanExons' AS BIGINT) AS b, TRY_CAST(payload ->> '$.nhumanOccs' AS BIGINT) AS c, TRY_CAST(payload ->> '$.nhumanOccsThatHit' AS BIGINT) AS d
    FROM training_evaluations WHERE payload IS NOT NULL) GROUP BY experiment)""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments in order of sensitivity, then specificity (one row per experiment)."""
    from pyspark.sql import Window

    from strandframe.plans.annotations import accuracy

    w = Window.orderBy(F.desc_nulls_last("sensitivity"), F.desc_nulls_last("specificity"), "experiment")
    return accuracy(spark, sf_dir).select(F.row_number().over(w).cast("bigint").alias("place"), "experiment", "sensitivity", "specificity")


@query("SELECT event_type AS tool, w AS bin_width, b AS bin, count(*) AS n FROM (SELECT event_type, greatest(pow(10, floor(log10(max(value) OVER () - min(value) OVER ()))) / 10, 1e-9) AS w, CAST(floor((value - min(value) OVER ()) / greatest(pow(10, floor(log10(max(value) OVER () - min(value) OVER ()))) / 10, 1e-9)) AS BIGINT) AS b FROM events WHERE value IS NOT NULL) GROUP BY ALL")
def automatic_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram whose bins are a tenth of the decimal magnitude of the range of all values."""
    rows = table(spark, sf_dir, "events").where(F.col("value").isNotNull())
    low, high = rows.agg(F.min("value"), F.max("value")).first()
    width = F.greatest(F.pow(F.lit(10.0), F.floor(F.log10(F.lit(high) - F.lit(low)))) / 10, F.lit(1e-9)) if low is not None and high > low else F.lit(1e-9)
    return rows.select(F.col("event_type").alias("tool"), width.alias("bin_width"), F.floor((F.col("value") - F.lit(low)) / width).cast("bigint").alias("bin")).groupBy("tool", "bin_width", "bin").agg(F.count("*").alias("n"))


@query("SELECT user_id AS run, event_type AS model, round(min(value), 6) AS best_loss, count(*) AS n_epochs FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY ALL")
def loss_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best loss of every run and model (the long form of the matrix)."""
    return table(spark, sf_dir, "events").where(F.col("user_id").isNotNull() & F.col("value").isNotNull()).groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("model")).agg(F.round(F.min("value"), 6).alias("best_loss"), F.count("*").alias("n_epochs"))


@query(sql(DNA, query="SELECT seq_id, chromosome, CAST(a AS BIGINT) AS exon_start, CAST(b AS BIGINT) AS exon_stop, name FROM (SELECT *, g_start AS a, g_start + length(seq) AS b, 'exon_' || chromosome || '_' || g_start || '_' || (g_start + length(seq)) AS name FROM seqs) WHERE NOT contains(chromosome, '/')"))
def exon_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosome and positions read back from the names of exon folders."""
    from strandframe.operators.exons import parse_directory

    name = F.concat(F.lit("exon_"), F.col("chromosome"), F.lit("_"), F.col("g_start").cast("string"), F.lit("_"), (F.col("g_start") + F.length("seq")).cast("string"))
    rows = dna(spark, sf_dir).where(~F.col("chromosome").contains("/")).select("seq_id", name.alias("name"))
    part = parse_directory(F.concat(F.lit("/data/"), F.col("name"), F.lit("/part")))
    return rows.select("seq_id", "name", part["chromosome"].alias("chromosome"), part["start"].alias("exon_start"), part["stop"].alias("exon_stop"))


# ---- datasets of exons: each chromosome's middle parts stand for an exon and its lifted ranges

_LIFTED = "lifted AS (SELECT chromosome AS item, seq_id, species, chromosome, g_start, seq, g_start + length(seq) // 8 AS a, g_start + length(seq) * 7 // 8 AS b, seq_id % 2 = 1 AS r FROM seqs)"
_CUT = """cut AS (SELECT item, species, seq_id, species || ':' || chromosome || ':' || format('{:,}', a2) || '-' || format('{:,}', b2) AS id, CASE WHEN r THEN '-' ELSE '+' END AS strand, a2 AS genome_start, b2 AS genome_end,
    CASE WHEN r THEN reverse(translate(t, 'ACGTacgtNWSMKRYBDHVNZ ', 'TGCAtgcaNNNNNNNNNNNNN ')) ELSE t END AS seq FROM (
    SELECT *, substr(seq, CAST(a2 - g_start + 1 AS BIGINT), CAST(b2 - a2 AS BIGINT)) AS t FROM (SELECT *, a + CASE WHEN r THEN 6 ELSE 4 END AS a2, b - CASE WHEN r THEN 4 ELSE 6 END AS b2 FROM lifted) WHERE a < b AND a2 < b2)
    WHERE item IN (SELECT item FROM lifted WHERE species = 'Homo_sapiens' AND a + 10 < b))"""


def _lifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = dna(spark, sf_dir)
    a, b = F.col("g_start") + F.expr("length(seq) div 8"), F.col("g_start") + F.expr("length(seq) * 7 div 8")
    # each text holds its own range; the item keeps the text apart where texts of a species overlap
    keyed = texts.withColumn("chromosome", F.concat_ws("/", "chromosome", F.col("seq_id").cast("string")))
    return keyed.select(F.substring_index("chromosome", "/", 1).alias("item"), "species", "chromosome", a.alias("start"), b.alias("stop"), (F.col("seq_id") % 2 == 1).alias("on_reverse")), keyed


@query(sql(DNA, _LIFTED, _CUT, query="SELECT item, species, seq_id, strand, genome_start, genome_end, array_to_string(list_transform(regexp_extract_all(seq, '[a-z]+|[^a-z]+'), lambda r: CASE WHEN regexp_matches(r, '^[a-z]') AND length(r) <= 20 THEN upper(r) ELSE r END), '') AS seq FROM cut"))
def exon_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifted ranges cut from the texts that hold them, oriented, stripped and with short soft-masked runs unmasked."""
    lifted, texts = _lifted(spark, sf_dir)
    out = D.exon_sequences(lifted, texts, "Homo_sapiens", cut_left=4, cut_right=6, short_runs=20)
    number = F.regexp_extract("id", "/([0-9]+):", 1).cast("bigint")
    return out.select("item", "species", number.alias("seq_id"), "strand", "genome_start", "genome_end", "seq")


@query(sql(DNA, _LIFTED, _CUT, query="SELECT item, count(DISTINCT species) AS n_species, count(*) AS n, bool_or(species = 'Homo_sapiens') AS has_home, CAST(sum(length(seq)) AS BIGINT) AS letters FROM cut GROUP BY item"))
def exon_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each exon's dataset as JSON, read back: its species, home first, and its letters."""
    lifted, texts = _lifted(spark, sf_dir)
    sets = D.exon_records(D.exon_sequences(lifted, texts, "Homo_sapiens", cut_left=4, cut_right=6), "Homo_sapiens")
    rows = records.flatten_sequences(sets, "item", "record")
    return rows.groupBy(F.col("file").alias("item")).agg(
        F.count_distinct("species").alias("n_species"), F.count("*").alias("n"), F.bool_or((F.col("node") == "$[0]") & (F.col("species") == "Homo_sapiens")).alias("has_home"), F.sum(F.length("sequence")).alias("letters")
    )


@query(sql(DNA, query="SELECT seq_id AS item, CASE WHEN seq_id % 7 = 0 THEN 'missing' WHEN seq_id % 5 = 0 THEN 'moved' ELSE 'same' END AS verdict FROM seqs WHERE species = 'Homo_sapiens'"))
def self_liftover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The home species lifted onto itself, with faults by id."""
    home = dna(spark, sf_dir).where(F.col("species") == "Homo_sapiens").select(F.col("seq_id").alias("item"), "chromosome", F.col("g_start").alias("start"), (F.col("g_start") + F.length("seq")).alias("stop"))
    back = home.where(F.col("item") % 7 != 0).withColumn("stop", F.col("stop") + F.when(F.col("item") % 5 == 0, 3).otherwise(0))
    return D.self_liftover(home, back)


def _annotation_sql(name: str) -> str:
    from strandframe.plans import annotations

    return annotations.ORACLE[name]


@query(_annotation_sql("exon_stats"))
def exon_stats_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics per exon, written as CSV with semicolons and read back."""
    from strandframe.plans.annotations import exon_stats

    path = scratch_path(spark, "stats")
    rows = exon_stats(spark, sf_dir)
    rows.write.option("sep", ";").option("header", "true").csv(path)
    return spark.read.option("sep", ";").option("header", "true").schema(rows.schema).csv(path)


@query(_annotation_sql("first_splice_form"))
def exon_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected exons, kept as JSON lines and read back."""
    from strandframe.plans.annotations import first_splice_form

    path = scratch_path(spark, "exons")
    rows = first_splice_form(spark, sf_dir)
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)


@query(sql(DNA, "k AS (SELECT DISTINCT species = 'Homo_sapiens' AS home, substr(seq, CAST(i AS BIGINT), 8) AS kmer FROM seqs, LATERAL (SELECT unnest(range(1, greatest(length(seq) - 6, 1))) AS i))",
           query="SELECT kmer, CASE WHEN bool_and(home) THEN 'only_left' ELSE 'only_right' END AS side FROM k WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY kmer HAVING count(*) = 1"))
def kmer_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-mers of the first species alone, and those of the others alone."""
    rows = K.kmer_rows(dna(spark, sf_dir).withColumn("home", F.col("species") == "Homo_sapiens"), ["home"], "seq", 8)
    sides = rows.groupBy("kmer").agg(F.bool_or("home").alias("l"), F.bool_or(~F.col("home")).alias("r")).where(F.col("l") != F.col("r"))
    return sides.select("kmer", F.when(F.col("l"), "only_left").otherwise("only_right").alias("side"))


@query("SELECT DISTINCT tileable_id, substr(seq, 1, length(seq) // 3) || translate(lower(substr(seq, length(seq) // 3 + 1, 30)), '*', ' ') || substr(seq, length(seq) // 3 + 31) AS masked FROM tileable_sequences WHERE alphabet = 'aa' AND seq <> ''")
def softmask_amino(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A soft-masked range of amino acids, whose stops become blanks."""
    rows = once(table(spark, sf_dir, "tileable_sequences").where((F.col("alphabet") == "aa") & (F.col("seq") != "")), "tileable_id")
    return rows.select("tileable_id", softmask(F.col("seq"), F.expr("length(seq) div 3"), F.lit(30), amino=True).alias("masked"))
