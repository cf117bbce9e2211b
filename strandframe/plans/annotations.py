"""Interval, exon, link and run-summary queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import seq as S
from strandframe.operators import exons as X
from strandframe.operators import intervals as I
from strandframe.operators import kmers as K
from strandframe.operators import links as L
from strandframe.operators import summaries as R
from strandframe.plans.base import DNA, FEATURES, TRANSCRIPTS, dna, features, sql, transcripts
from strandframe.plans.sequences import _KMERS
from strandframe.session import shared_checkpoint, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
HOME = "Homo_sapiens"


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return add


# ---- intervals

@query(sql(FEATURES, query="SELECT a.feature_id, count(b.feature_id) AS n_exons, coalesce(sum(least(a.e, b.e) - greatest(a.s, b.s)), 0)::BIGINT AS shared FROM (SELECT * FROM feats WHERE feature = 'CDS') a JOIN (SELECT * FROM feats WHERE feature = 'exon') b ON a.gtf_file = b.gtf_file AND a.seqname = b.seqname AND a.strand = b.strand AND a.s < b.e AND a.e > b.s GROUP BY a.feature_id"))
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    a = f.where(F.col("feature") == "CDS").select("feature_id", "gtf_file", "seqname", "strand", "s", "e")
    b = f.where(F.col("feature") == "exon").select("gtf_file", "seqname", "strand", "s", "e")
    pairs = I.overlap_join(a, b, ["gtf_file", "seqname", "strand"])
    return pairs.groupBy("feature_id").agg(F.count("*").alias("n_exons"), F.sum(F.least("e", "e2") - F.greatest("s", "s2")).alias("shared"))


@query(sql(FEATURES, query="SELECT a.feature_id, count(*) AS n_inside FROM (SELECT * FROM feats WHERE feature = 'transcript') a JOIN (SELECT * FROM feats WHERE feature = 'exon') b ON a.gtf_file = b.gtf_file AND a.seqname = b.seqname AND a.strand = b.strand AND a.s <= b.s AND b.e <= a.e GROUP BY a.feature_id"))
def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    a = f.where(F.col("feature") == "transcript").select("feature_id", "gtf_file", "seqname", "strand", "s", "e")
    b = f.where(F.col("feature") == "exon").select("gtf_file", "seqname", "strand", "s", "e")
    return I.overlap_join(a, b, ["gtf_file", "seqname", "strand"], contained=True).groupBy("feature_id").agg(F.count("*").alias("n_inside"))


@query(sql(FEATURES, query="SELECT feature_id, s, e FROM (SELECT *, max(e) OVER (PARTITION BY gtf_file, seqname, strand ORDER BY s, e DESC, feature_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM feats) WHERE before IS NULL OR before < e"))
def longest_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.drop_contained(features(spark, sf_dir), ["gtf_file", "seqname", "strand"], "feature_id").select("feature_id", "s", "e")


@query(sql(FEATURES, query="SELECT seqname, s, e, strand, feature, feature_id, source FROM (SELECT *, row_number() OVER (PARTITION BY seqname, s, e, strand, feature ORDER BY CASE WHEN source = 'BestCurated' THEN 0 ELSE 1 END, feature_id, source NULLS FIRST) AS r FROM feats WHERE feature IS NOT NULL) WHERE r = 1"))
def dedup_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).where(F.col("feature").isNotNull()).select("seqname", "s", "e", "strand", "feature", "feature_id", "source")
    return I.first_per(rows, ["seqname", "s", "e", "strand", "feature"], [F.when(F.col("source") == "BestCurated", 0).otherwise(1), F.col("feature_id"), F.col("source")])


_PARENTS = "parents AS (SELECT DISTINCT sequence_id, species, chromosome, genome_start AS ps, genome_end AS pe FROM sequences WHERE genome_start < genome_end AND species IS NOT NULL AND chromosome IS NOT NULL)"


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "sequences").where((F.col("genome_start") < F.col("genome_end"))).select("sequence_id", "species", F.col("chromosome").alias("seqname"), F.col("genome_start").alias("s"), F.col("genome_end").alias("e")).distinct()
    child = features(spark, sf_dir).select(F.substring_index("gtf_file", ".", 1).alias("species"), "seqname", "feature_id", "feature", "strand", "s", "e")
    return I.overlap_join(parents, child, ["species", "seqname"])


@query(sql(FEATURES, _PARENTS, query="SELECT sequence_id, feature_id, feature, greatest(s, ps) AS clip_s, least(e, pe) AS clip_e, to_json({feature: feature, s: s, e: e, strand: strand}) AS source FROM parents JOIN feats ON species = split_part(gtf_file, '.', 1) AND chromosome = seqname AND s < pe AND e > ps"))
def annotation_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation rows that overlap a sequence, clipped to it, with the row kept as source."""
    source = F.to_json(F.struct("feature", F.col("s2").alias("s"), F.col("e2").alias("e"), "strand"), {"ignoreNullFields": "false"})
    return _elements(spark, sf_dir).select("sequence_id", "feature_id", "feature", F.greatest("s", "s2").alias("clip_s"), F.least("e", "e2").alias("clip_e"), source.alias("source"))


@query(sql(FEATURES, _PARENTS, query="SELECT sequence_id, feature_id, s - ps AS rel_from, e - ps AS rel_to, pe - e AS rc_from, pe - s AS rc_to FROM parents JOIN feats ON species = split_part(gtf_file, '.', 1) AND chromosome = seqname AND s < pe AND e > ps"))
def relative_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _elements(spark, sf_dir)
    a, b = I.relative(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")), I.relative(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"), rc=True)
    return rows.select("sequence_id", "feature_id", a[0].alias("rel_from"), a[1].alias("rel_to"), b[0].alias("rc_from"), b[1].alias("rc_to"))


@query(sql(FEATURES, query="SELECT feature, count(*) AS n, round(avg(e - s), 6) AS mean, round(stddev_samp(e - s), 6) AS std, min(e - s) AS least, max(e - s) AS most FROM feats GROUP BY feature"))
def site_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("e") - F.col("s")
    return features(spark, sf_dir).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("std"), F.min(n).alias("least"), F.max(n).alias("most"))


@query(sql(FEATURES, query="SELECT feature_id, seqname, s, e FROM feats WHERE seqname = 'chr7' AND feature = 'exon' AND strand = '+' AND s >= 100000 AND e <= 3000000 AND (score IS NULL OR score >= 0.5)"))
def gtf_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return f.where("seqname = 'chr7' AND feature = 'exon' AND strand = '+' AND s >= 100000 AND e <= 3000000 AND (score IS NULL OR score >= 0.5)").select("feature_id", "seqname", "s", "e")


# ---- exons

_INNER = "inner_blocks AS (SELECT *, unnest(range(1, block_count - 1)) AS i FROM tx WHERE block_count >= 3 AND chrom IN (" + ", ".join(f"'{c}'" for c in X.MAIN_CHROMOSOMES) + "))"
_GEO = """geo AS (SELECT bed_id, chrom, strand, i, chrom_start + starts[i + 1] AS exon_start, chrom_start + starts[i + 1] + sizes[i + 1] AS exon_stop, starts[i + 1] - starts[i] - sizes[i] AS left_intron_len,
    starts[i + 2] - starts[i + 1] - sizes[i + 1] AS right_intron_len, sizes[i] AS lsize, sizes[i + 1] AS msize, sizes[i + 2] AS rsize FROM inner_blocks)"""
_FORMS = """forms AS (SELECT *, exon_start - left_intron_len - 15 AS left_anchor_start, exon_start - left_intron_len AS left_anchor_end, exon_stop + right_intron_len AS right_anchor_start, exon_stop + right_intron_len + 15 AS right_anchor_end,
    (exon_start + exon_stop - 15) // 2 AS middle_start FROM (SELECT *, row_number() OVER (PARTITION BY chrom, exon_start, exon_stop ORDER BY bed_id, i) AS r FROM geo
    WHERE msize >= 50 AND lsize >= 20 AND rsize >= 20 AND left_intron_len >= 100 AND right_intron_len >= 100) WHERE r = 1)"""


@query(sql(TRANSCRIPTS, _INNER, _GEO, query="SELECT chrom, exon_start, exon_stop, count(*) AS n_transcripts, min(bed_id) AS first_transcript FROM geo GROUP BY ALL"))
def internal_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.internal_exons(transcripts(spark, sf_dir))


@query(sql(TRANSCRIPTS, _INNER, _GEO, _FORMS, query="SELECT chrom, exon_start, exon_stop, bed_id, strand, left_intron_len, right_intron_len, left_anchor_start, right_anchor_end, right_anchor_start - left_anchor_end AS substring_len, right_anchor_end - left_anchor_start AS total_len FROM forms"))
def first_splice_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.first_splice_forms(transcripts(spark, sf_dir)).select("chrom", "exon_start", "exon_stop", "bed_id", "strand", "left_intron_len", "right_intron_len", "left_anchor_start", "right_anchor_end", "substring_len", "total_len")


@query(sql(TRANSCRIPTS, _INNER, _GEO, _FORMS, "named AS (SELECT *, 'exon_' || exon_start || '_' || exon_stop || '_' || i AS base FROM forms)", query="""SELECT chrom, left_anchor_start AS start, left_anchor_end AS stop, base || '_left' AS name, strand FROM named
    UNION ALL SELECT chrom, right_anchor_start, right_anchor_end, base || '_right', strand FROM named UNION ALL SELECT chrom, middle_start, middle_start + 15, base || '_middle', strand FROM named"""))
def liftover_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.liftover_lines(X.first_splice_forms(transcripts(spark, sf_dir)))


_HITS = """hits AS (SELECT bed_id AS item, label, k AS ord, CASE WHEN bed_id % 17 = 0 AND label = 'right' THEN 'chrZ' ELSE chrom END AS chrom, CASE WHEN bed_id % 7 = 0 AND label = 'right' THEN '.' ELSE strand END AS strand,
    chrom_start + starts[(CASE WHEN bed_id % 5 = 0 THEN 2 - k ELSE k END) % 3 + 1] AS s, chrom_start + starts[(CASE WHEN bed_id % 5 = 0 THEN 2 - k ELSE k END) % 3 + 1] + sizes[(CASE WHEN bed_id % 5 = 0 THEN 2 - k ELSE k END) % 3 + 1] AS e,
    CASE WHEN bed_id % 3 = 0 THEN '-' ELSE '+' END AS home_strand, greatest(chrom_end - chrom_start, 1) AS home_len
    FROM tx, (VALUES (0, 'left'), (1, 'middle'), (2, 'right')) v(k, label) WHERE block_count >= 3 AND strand IS NOT NULL AND chrom_end IS NOT NULL AND NOT (bed_id % 11 = 0 AND label = 'middle'))"""


@query(
    sql(
        TRANSCRIPTS,
        _HITS,
        query="""SELECT item, CASE WHEN l IS NULL OR m IS NULL OR r IS NULL THEN 'missing_label' WHEN l.strand <> r.strand OR l.strand <> m.strand THEN 'strands_differ' WHEN l.chrom <> r.chrom OR l.chrom <> m.chrom THEN 'chromosomes_differ'
    WHEN start >= m.s THEN 'left_after_middle' WHEN m.e >= stop THEN 'middle_after_right' WHEN abs(log10(stop - start) - log10(home_len)) >= 1 THEN 'lengths_differ' ELSE 'ok' END AS verdict, start, stop FROM (
    SELECT *, CASE WHEN l.strand = home_strand THEN l.e ELSE r.e END AS start, CASE WHEN l.strand = home_strand THEN r.s ELSE l.s END AS stop FROM (
    SELECT item, home_strand, home_len, max({s: s, e: e, strand: strand, chrom: chrom}) FILTER (label = 'left') AS l, max({s: s, e: e, strand: strand, chrom: chrom}) FILTER (label = 'middle') AS m, max({s: s, e: e, strand: strand, chrom: chrom}) FILTER (label = 'right') AS r FROM hits GROUP BY ALL))""",
    )
)
def liftover_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation ladder over hits made from transcript blocks, with faults by id."""
    rows = transcripts(spark, sf_dir).where((F.col("block_count") >= 3) & F.col("strand").isNotNull() & F.col("chrom_end").isNotNull())
    rows = rows.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(x).alias("label")) for k, x in enumerate(("left", "middle", "right"))])))
    rows = rows.where(~((F.col("bed_id") % 11 == 0) & (F.col("label") == "middle")))
    i = (F.when(F.col("bed_id") % 5 == 0, 2 - F.col("ord")).otherwise(F.col("ord")) + 1).cast("int")
    s = F.col("chrom_start") + F.element_at("starts", i)
    right = F.col("label") == "right"
    hits = rows.select(
        F.col("bed_id").alias("item"), "label", "ord", F.when((F.col("bed_id") % 17 == 0) & right, "chrZ").otherwise(F.col("chrom")).alias("chrom"), F.when((F.col("bed_id") % 7 == 0) & right, ".").otherwise(F.col("strand")).alias("strand"),
        s.alias("s"), (s + F.element_at("sizes", i)).alias("e"), F.when(F.col("bed_id") % 3 == 0, "-").otherwise("+").alias("home_strand"), F.greatest(F.col("chrom_end") - F.col("chrom_start"), F.lit(1)).alias("home_len"),
    )
    return X.validate_liftover(hits)


@query(sql(DNA, query="""SELECT chromosome, max(CASE WHEN species = 'Homo_sapiens' THEN length(seq) END) AS home_len, round(median(length(seq)), 6) AS median_len, round(avg(length(seq)), 6) AS mean_len, count(*) AS n, bool_or(regexp_matches(seq, '[acgtnN]')) AS ambiguous,
    round(max(CASE WHEN species = 'Homo_sapiens' THEN length(seq) END) / median(length(seq)), 6) AS to_median FROM seqs GROUP BY chromosome"""))
def exon_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, home = F.length("seq"), F.max(F.when(F.col("species") == HOME, F.length("seq")))
    return dna(spark, sf_dir).groupBy("chromosome").agg(home.alias("home_len"), F.round(F.median(n), 6).alias("median_len"), F.round(F.avg(n), 6).alias("mean_len"), F.count("*").alias("n"), F.bool_or(F.col("seq").rlike("[acgtnN]")).alias("ambiguous"), F.round(home / F.median(n), 6).alias("to_median"))


# ---- occurrences and links: hits of the selected seeds

_SEEDS = f"""c AS (SELECT kmer, count(*) AS n, min((seq_id, pos)) AS seen FROM ({_KMERS}) WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY kmer),
seeds AS (SELECT kmer, r AS profile FROM (SELECT kmer, n, rank() OVER (ORDER BY n DESC) AS k, row_number() OVER (ORDER BY n DESC, seen, kmer) AS r FROM c) WHERE (n >= 8 OR k <= 10) AND r <= 200),
occ AS (SELECT profile, species, seq_id, pos, kmer FROM ({_KMERS}) JOIN seeds USING (kmer))"""


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profile, species, chromosome, g_start, seq_id, pos of every hit of the selected seeds (at most 200, so broadcast)."""
    keep = ["species", "chromosome", "g_start", "seq_id"]
    rows = K.kmer_rows(dna(spark, sf_dir), keep, "seq", 8)
    seeds = K.select_kmers(K.count_kmers(rows, ["seq_id", "pos"]), max_u=200, min_occ=8, min_u=10).select("kmer", F.col("place").alias("profile"))
    return rows.join(F.broadcast(seeds), "kmer")


@query(sql(DNA, _SEEDS, query="""SELECT profile, count(*) AS n_occs, count(DISTINCT species) AS n_species, TRY_CAST(round((SELECT product(n) FROM (SELECT count(*) AS n FROM occ o2 WHERE o2.profile = occ.profile GROUP BY o2.species))) AS BIGINT) AS n_links,
    round((SELECT sum(log10(n)) FROM (SELECT count(*) AS n FROM occ o2 WHERE o2.profile = occ.profile GROUP BY o2.species)), 6) AS log10_links FROM occ GROUP BY profile"""))
def unique_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that each profile's occurrences make; beyond 64 bits the count is null and its logarithm remains."""
    return L.multilinks(occurrences(spark, sf_dir)).select("profile", "n_occs", "n_species", F.col("n_links").try_cast("bigint").alias("n_links"), F.round("log10_links", 6).alias("log10_links"))


@query(sql(DNA, _SEEDS, query="SELECT chromosome, count(DISTINCT profile) AS n_profiles, CAST(sum(n) AS BIGINT) AS n_occs, CAST(sum(l) AS BIGINT) AS n_links FROM (SELECT chromosome, profile, sum(n) AS n, round(product(n)) AS l FROM (SELECT chromosome, profile, o.species, count(*) AS n FROM occ o JOIN seqs USING (seq_id) GROUP BY ALL) GROUP BY ALL) GROUP BY chromosome"))
def multi_profile_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of groups of several profiles (here: of each chromosome), the sums over their profiles."""
    out = L.links_of_groups(occurrences(spark, sf_dir), "chromosome")
    return out.select("chromosome", "n_profiles", "n_occs", F.col("n_links").try_cast("bigint").alias("n_links"))


@query(sql(DNA, _SEEDS, query="SELECT profile, species, seq_id, pos FROM occ WHERE profile IN (SELECT profile FROM occ WHERE species = 'Homo_sapiens') ORDER BY ALL"))
def links_with_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the multi-links that hold an occurrence of the first species."""
    return L.with_species(occurrences(spark, sf_dir), [HOME]).select("profile", "species", "seq_id", F.col("pos").cast("bigint").alias("pos"))


@query(sql(DNA, _SEEDS, "turned AS (SELECT profile, o.species, o.seq_id, pos, sequence_id, seq, o.seq_id % 2 = 1 AS r FROM occ o JOIN seqs USING (seq_id))",
           query="""SELECT profile AS link, CAST(row_number() OVER (PARTITION BY profile ORDER BY species) - 1 AS INTEGER) AS line_no, CASE WHEN r THEN reverse(translate(s, 'ACGTacgtNWSMKRYBDHVNZ ', 'TGCAtgcaNNNNNNNNNNNNN ')) ELSE s END || ' - ' || sequence_id || ' at ' || pos || ':' || least(pos + 12, n) AS line
           FROM (SELECT *, substr(seq, CAST(pos + 1 AS BIGINT), 12) AS s, length(seq) AS n FROM turned WHERE (seq_id, pos) IN (SELECT min((t.seq_id, t.pos)) FROM turned t GROUP BY t.profile, t.species) )"""))  # fmt: skip
def link_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first occurrence of each profile in each species as one link, its letters under one another, odd sequences from their reverse strand."""
    occ = occurrences(spark, sf_dir)
    first = occ.groupBy("profile", "species").agg(F.min(F.struct("seq_id", "pos")).alias("m"))
    members = first.select(F.col("profile").alias("link"), "species", "m.seq_id", "m.pos", (F.col("m.seq_id") % 2).cast("int").alias("frame"))
    return L.align(members, dna(spark, sf_dir), 12).withColumn("line_no", F.col("line_no").cast("int"))


@query(
    "WITH RECURSIVE " + DNA + "," + _SEEDS + """, per AS (SELECT profile, species, count(*) AS n FROM occ GROUP BY ALL), good AS (SELECT profile FROM per GROUP BY profile HAVING count(*) > 1 AND round(product(n)) <= 100),
    stepped AS (SELECT profile, product(n) OVER (PARTITION BY profile ORDER BY species) AS l FROM per), over AS (SELECT profile, CAST(round(min(l)) AS BIGINT) AS skipped FROM stepped WHERE round(l) > 100 AND profile IN (SELECT profile FROM per GROUP BY profile HAVING count(*) > 1) GROUP BY profile),
    placed AS (SELECT profile, species || ':' || seq_id || ':' || pos AS name, dense_rank() OVER (PARTITION BY profile ORDER BY species) AS d FROM occ WHERE profile IN (FROM good)),
    grown AS (SELECT profile, name AS members, d FROM placed WHERE d = 1 UNION ALL SELECT g.profile, g.members || '|' || p.name, p.d FROM grown g JOIN placed p ON p.profile = g.profile AND p.d = g.d + 1)
    SELECT profile, members, CAST(NULL AS BIGINT) AS skipped FROM grown WHERE d = (SELECT max(d) FROM placed p WHERE p.profile = grown.profile) UNION ALL SELECT profile, NULL, skipped FROM over"""
)
def link_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.expand_links(occurrences(spark, sf_dir), 100)


@query(sql(DNA, _SEEDS, query="SELECT s.seq_id, s.species, count(o.pos) AS n_sites FROM seqs s LEFT JOIN occ o ON o.seq_id = s.seq_id GROUP BY ALL"))
def site_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = occurrences(spark, sf_dir).groupBy("seq_id").agg(F.count("*").alias("n_sites"))
    return dna(spark, sf_dir).select("seq_id", "species").join(n, "seq_id", "left").fillna(0, ["n_sites"])


@query(sql(DNA, _SEEDS, query="SELECT profile, species, seq_id, count(*) AS n FROM occ GROUP BY ALL"))
def site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(spark, sf_dir).groupBy("profile", "species", "seq_id").agg(F.count("*").alias("n"))


@query(sql(DNA, _SEEDS, query="SELECT species, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 9) AS share_without FROM (SELECT s.seq_id, s.species, count(o.pos) AS n FROM seqs s LEFT JOIN occ o ON o.seq_id = s.seq_id GROUP BY ALL) GROUP BY species"))
def no_site_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_zero_fill(spark, sf_dir).groupBy("species").agg(F.round(F.avg(F.when(F.col("n_sites") == 0, 1.0).otherwise(0.0)), 9).alias("share_without"))


@query(
    sql(
        DNA,
        _SEEDS,
        "sites AS (SELECT profile, CASE WHEN o.seq_id % 2 = 1 THEN reverse(translate(upper(substr(seq, pos + 1, 16)), 'ACGT', 'TGCA')) ELSE upper(substr(seq, pos + 1, 16)) END AS site FROM occ o JOIN seqs USING (seq_id) WHERE pos + 16 <= length(seq))",
        query="SELECT profile, i AS pos, base, round(avg(CASE WHEN substr(site, i + 1, 1) = base THEN 1.0 ELSE 0.0 END), 9) AS share FROM sites, range(16) r(i), (VALUES ('A'), ('C'), ('G'), ('T')) v(base) GROUP BY ALL",
    )
)
def site_pwm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each base at each place of the sites (with the letters after them), reverse ones turned."""
    hits = occurrences(spark, sf_dir).select("profile", "seq_id", "pos")
    sites = hits.join(dna(spark, sf_dir).select("seq_id", "seq"), "seq_id").where(F.col("pos") + 16 <= F.length("seq"))
    site = F.upper(F.substring(F.col("seq"), F.col("pos") + 1, F.lit(16)))
    rows = sites.select("profile", F.when(F.col("seq_id") % 2 == 1, S.reverse_complement(site)).otherwise(site).alias("site"))
    letters = rows.select("profile", F.posexplode(F.split("site", "")).alias("pos", "letter")).groupBy("profile", "pos").agg(*[F.round(F.avg(F.when(F.col("letter") == b, 1.0).otherwise(0.0)), 9).alias(b) for b in "ACGT"])
    return letters.unpivot(["profile", "pos"], list("ACGT"), "base", "share").withColumn("pos", F.col("pos").cast("bigint"))


_HOME_EXONS = "home_exons AS (SELECT DISTINCT seqname, s, e FROM feats WHERE feature = 'exon' AND split_part(gtf_file, '.', 1) = 'Homo_sapiens')"


@query(
    sql(
        DNA, FEATURES, _SEEDS, _HOME_EXONS,
        "placed AS (SELECT o.profile, o.species, o.seq_id, o.pos, s.chromosome, s.g_start + o.pos AS a FROM occ o JOIN seqs s USING (seq_id))",
        "others AS (SELECT profile, CAST(round(product(n)) AS BIGINT) AS others FROM (SELECT profile, species, count(*) AS n FROM occ WHERE species <> 'Homo_sapiens' GROUP BY ALL) GROUP BY profile)",
        "h AS (SELECT p.profile, p.seq_id, p.pos, x.seqname, x.s, x.e FROM placed p JOIN home_exons x ON x.seqname = p.chromosome AND p.a < x.e AND p.a + 8 > x.s WHERE species = 'Homo_sapiens')",
        query="""SELECT (SELECT count(DISTINCT (seqname, s, e)) FROM h JOIN others USING (profile)) AS n_exons_hit, (SELECT count(DISTINCT (profile, seq_id, pos)) FROM h JOIN others USING (profile)) AS n_occs_hit,
        (SELECT coalesce(sum(others), 0) FROM h JOIN others USING (profile))::BIGINT AS n_links_hit, (SELECT sum(l) FROM (SELECT round(product(n)) AS l FROM (SELECT profile, species, count(*) AS n FROM occ GROUP BY ALL) GROUP BY profile))::BIGINT AS n_links,
        (SELECT count(*) FROM occ WHERE species = 'Homo_sapiens') AS n_occs, (SELECT count(*) FROM home_exons) AS n_exons""",
    )
)
def exon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    # four parts of the result read the hits: they are found once and kept in the shared folder
    occ = shared_checkpoint(occurrences(spark, sf_dir).select("profile", "species", "chromosome", "g_start", "seq_id", "pos")).withColumn("occ_id", F.struct("profile", "seq_id", "pos"))
    exons = features(spark, sf_dir).where((F.col("feature") == "exon") & (F.substring_index("gtf_file", ".", 1) == HOME)).select("seqname", "s", "e").distinct()
    home = occ.where(F.col("species") == HOME).select("profile", "occ_id", F.col("chromosome").alias("seqname"), (F.col("g_start") + F.col("pos")).alias("s"), (F.col("g_start") + F.col("pos") + 8).alias("e"))
    hits = I.overlap_join(home, exons, ["seqname"]).withColumn("exon_id", F.struct("seqname", "s2", "e2"))
    out = L.exon_hit_counts(occ, hits, HOME, exons.agg(F.count("*").alias("n_exons")))
    big = lambda c: F.col(c).try_cast("bigint").alias(c)
    return out.select("n_exons_hit", "n_occs_hit", big("n_links_hit"), big("n_links"), "n_occs", "n_exons")


@query(sql(DNA, _SEEDS, query="SELECT o.profile, o.seq_id, o.pos, s.sequence_id, substr(s.seq, o.pos + 1, 8) AS bases FROM occ o JOIN seqs s ON s.seq_id = o.seq_id"))
def occurrence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences joined back to their sequences by id, with the bases under them."""
    hits = occurrences(spark, sf_dir).select("profile", "seq_id", F.col("pos").cast("bigint").alias("pos"))
    return hits.join(dna(spark, sf_dir).select("seq_id", "sequence_id", "seq"), "seq_id").select("profile", "seq_id", "pos", "sequence_id", F.substring(F.col("seq"), F.col("pos").cast("int") + 1, F.lit(8)).alias("bases"))


# ---- run summaries

_RUNS = "runs AS (SELECT DISTINCT eval_id, experiment, " + ", ".join(f"CAST(json_extract_string(payload, '$.{a}') AS BIGINT) AS {b}" for a, b in (("nexonsHit", "exons_hit"), ("nhumanExons", "exons"), ("nhumanOccs", "occs"), ("nhumanOccsThatHit", "occs_hit"), ("nlinks", "links"), ("nlinksThatHit", "links_hit"))) + ", CAST(json_extract_string(payload, '$.trainingTime') AS DOUBLE) AS runtime FROM training_evaluations WHERE payload IS NOT NULL)"


@query(sql(_RUNS, query="""SELECT experiment, n, round(sn, 9) AS sensitivity, round(sp, 9) AS specificity, round(2 * sn * sp / nullif(sn + sp, 0), 9) AS harmonic, round(lsp, 9) AS link_specificity, round(runtime, 6) AS runtime FROM (
    SELECT experiment, count(*) AS n, sum(exons_hit) / nullif(sum(exons), 0) AS sn, sum(occs_hit) / nullif(sum(occs), 0) AS sp, sum(links_hit) / nullif(sum(links), 0) AS lsp, avg(runtime) AS runtime FROM runs GROUP BY experiment)"""))
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"nexonsHit": "exons_hit", "nhumanExons": "exons", "nhumanOccs": "occs", "nhumanOccsThatHit": "occs_hit", "nlinks": "links", "nlinksThatHit": "links_hit"}
    rows = table(spark, sf_dir, "training_evaluations").where(F.col("payload").isNotNull())
    top = F.from_json("payload", ", ".join(f"{k} BIGINT" for k in names) + ", trainingTime DOUBLE")
    runs = rows.select("eval_id", "experiment", top.alias("t")).select("eval_id", "experiment", *[F.col(f"t.{k}").alias(v) for k, v in names.items()], F.col("t.trainingTime").alias("runtime")).distinct()
    out = R.leaderboard(runs, ["experiment"])
    return out.select("experiment", "n", *[F.round(c, 9).alias(c) for c in ("sensitivity", "specificity", "harmonic", "link_specificity")], F.round("runtime", 6).alias("runtime"))


@query("SELECT b::INTEGER AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM events), 9) AS share FROM range(50) r(b) LEFT JOIN (SELECT least(greatest(floor(value / 10), 0), 49)::INTEGER AS k, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) ON k = b")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(table(spark, sf_dir, "events"), "value", 10.0, 50).select("bin", "n", F.round("share", 9).alias("share"))


@query("SELECT event_type AS tool, user_id AS item, round(-log10(min(pow(10, -value / 50.0))), 6) AS score FROM events GROUP BY ALL")
def best_hit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.pow(F.lit(10.0), -F.col("value") / 50.0)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tool"), F.col("user_id").alias("item")).agg(F.round(-F.log10(F.min(p)), 6).alias("score"))


@query("SELECT tool, t::INTEGER AS threshold, round(100 * avg(CASE WHEN score >= t THEN 1.0 ELSE 0.0 END), 6) AS percent FROM (SELECT event_type AS tool, user_id, round(-log10(min(pow(10, -value / 50.0))), 6) AS score FROM events GROUP BY ALL), range(3, 11) r(t) GROUP BY ALL")
def success_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.success_curve(best_hit_score(spark, sf_dir), ["tool"], "score", list(range(3, 11))).withColumn("percent", F.round("percent", 6))


@query("SELECT tool, round(avg(share), 9) AS mean, round(stddev_samp(share), 9) AS std_sample, round(stddev_pop(share), 9) AS std_population, round(min(share), 9) AS least, round(max(share), 9) AS most FROM (SELECT event_type AS tool, event_id % 10 AS iteration, avg(CASE WHEN value >= 250 THEN 1.0 ELSE 0.0 END) AS share FROM events GROUP BY ALL) GROUP BY tool")
def repeat_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tool"), (F.col("event_id") % 10).alias("iteration")).agg(F.avg(F.when(F.col("value") >= 250, 1.0).otherwise(0.0)).alias("share"))
    f = {"mean": F.avg, "std_sample": F.stddev_samp, "std_population": F.stddev_pop, "least": F.min, "most": F.max}
    return per.groupBy("tool").agg(*[F.round(g("share"), 9).alias(n) for n, g in f.items()])


@query("SELECT event_id, (count(*) OVER w = 3) AND (min(event_id % 2) OVER w = max(event_id % 2) OVER w) AND (stddev_pop(value) OVER w <= 60.5) AS plateau FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def plateau_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("best", F.col("event_id") % 2)
    return R.plateaus(rows, "user_id", ["ts", "event_id"], "best", "value", 3, 60.5).select("event_id", "plateau")


@query("SELECT event_id // 100 AS epoch, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean_loss, min_by(event_id % 100, (value, event_id % 100)) AS best FROM events GROUP BY 1")
def epoch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = F.col("event_id") % 100
    return table(spark, sf_dir, "events").groupBy(F.expr("event_id div 100").alias("epoch")).agg(F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"), F.round(F.avg("value"), 6).alias("mean_loss"), F.min_by(profile, F.struct("value", profile)).alias("best"))


_GRID = {"tile": [334, 1000], "k": [12, 20], "s": [0, 2, 6], "gamma": [0.5, 1.0]}


@query("SELECT tile, k, s, gamma FROM (VALUES (334), (1000)) a(tile), (VALUES (12), (20)) b(k), (VALUES (0), (2), (6)) c(s), (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) d(gamma) WHERE NOT (s > 2 AND k > 12)")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grid(spark, _GRID).where("NOT (s > 2 AND k > 12)")


@query("SELECT DISTINCT tile, k, s, gamma FROM (SELECT tile, 12 AS k, 0 AS s, 0.5::DOUBLE AS gamma FROM (VALUES (334), (1000)) a(tile) UNION ALL SELECT 334, k, 0, 0.5 FROM (VALUES (12), (20)) b(k) UNION ALL SELECT 334, 12, s, 0.5 FROM (VALUES (0), (2), (6)) c(s) UNION ALL SELECT 334, 12, 0, g FROM (VALUES (0.5::DOUBLE), (1.0)) d(g))")
def isolated_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.isolated_grid(spark, _GRID)


@query("SELECT l_returnflag AS left_side, count(*) AS n, CAST(sum(CASE WHEN a.l_quantity = b.l_quantity THEN 1 ELSE 0 END) AS BIGINT) AS equal FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r, l_quantity, l_returnflag FROM lineitem) a JOIN (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS r, l_quantity FROM lineitem) b USING (l_orderkey, r) GROUP BY 1")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orderings of the same lists, compared place by place."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    a = rows.withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    b = rows.select("l_orderkey", F.col("l_quantity").alias("q"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*[F.desc(c) for c in order])).alias("r"))
    return a.join(b, ["l_orderkey", "r"]).groupBy(F.col("l_returnflag").alias("left_side")).agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") == F.col("q")).alias("equal"))
