"""Internal exons of transcripts, their anchors, and validation of lifted anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.seq import anchors
from strandframe.operators.intervals import first_per

MAIN_CHROMOSOMES = [f"chr{i}" for i in range(1, 23)] + ["chrX", "chrY", "chrM"]


def inner_blocks(tx: DataFrame) -> DataFrame:
    """One row per inner block (i) of the transcripts with three blocks or more on main chromosomes."""
    rows = tx.where((F.col("block_count") >= 3) & F.col("chrom").isin(MAIN_CHROMOSOMES))
    return rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("block_count") - 2)))


def internal_exons(tx: DataFrame) -> DataFrame:
    """chrom, exon_start, exon_stop, n_transcripts, first_transcript."""
    rows = inner_blocks(tx)
    start = F.col("chrom_start") + F.element_at("starts", F.col("i") + 1)
    return rows.select("chrom", start.alias("exon_start"), (start + F.element_at("sizes", F.col("i") + 1)).alias("exon_stop"), "bed_id").groupBy("chrom", "exon_start", "exon_stop").agg(F.count("*").alias("n_transcripts"), F.min("bed_id").alias("first_transcript"))


def first_splice_forms(tx: DataFrame, min_exon: int = 50, min_neighbour: int = 20, min_intron: int = 100, anchor: int = 15, middle: int = 15) -> DataFrame:
    """Anchor geometry of each internal exon in the first transcript that meets the length limits."""
    rows = inner_blocks(tx)
    geometry = anchors(F.col("chrom_start"), F.col("sizes"), F.col("starts"), F.col("i"), anchor, anchor, middle)
    size = lambda d: F.element_at("sizes", F.col("i") + 1 + d)
    ok = (size(0) >= min_exon) & (size(-1) >= min_neighbour) & (size(1) >= min_neighbour)
    rows = rows.where(ok).select("chrom", "strand", "bed_id", "i", *[c.alias(n) for n, c in geometry.items()])
    rows = rows.where((F.col("left_intron_len") >= min_intron) & (F.col("right_intron_len") >= min_intron))
    return first_per(rows, ["chrom", "exon_start", "exon_stop"], [F.col("bed_id"), F.col("i")])


def liftover_lines(forms: DataFrame) -> DataFrame:
    """Three BED lines (left, right, middle anchor) of each exon."""
    base = F.concat_ws("_", F.lit("exon"), F.col("exon_start").cast("string"), F.col("exon_stop").cast("string"), F.col("i").cast("string"))
    line = lambda label, a, b: F.struct(F.col("chrom"), F.col(a).alias("start"), F.col(b).alias("stop"), F.concat(base, F.lit(f"_{label}")).alias("name"), F.col("strand"))
    return forms.select(F.inline(F.array(line("left", "left_anchor_start", "left_anchor_end"), line("right", "right_anchor_start", "right_anchor_end"), line("middle", "middle_start", "middle_end"))))


def validate_liftover(hits: DataFrame, exon_strand: str = "home_strand", exon_len: str = "home_len", single_hits: bool = False) -> DataFrame:
    """item, verdict and the lifted range, from hits (item, label left/middle/right, chrom, s, e, strand, ord).

    The longest hit per label counts, the first of equals. Verdicts, first that applies:
    too_many_hits (if single_hits), missing_label, strands_differ, chromosomes_differ,
    left_after_middle, middle_after_right, lengths_differ (a factor of ten or more), ok.
    Chromosomes of all three labels are compared.
    """
    longest = first_per(hits, ["item", "label", exon_strand, exon_len], [F.col("s") - F.col("e"), F.col("ord")])
    one = longest.groupBy("item", exon_strand, exon_len).agg(*[F.max(F.when(F.col("label") == x, F.struct("chrom", "s", "e", "strand"))).alias(x) for x in ("left", "middle", "right")])
    n = hits.groupBy("item").agg(F.count("*").alias("n_hits"))
    same = F.col("left.strand") == F.col(exon_strand)
    start = F.when(same, F.col("left.e")).otherwise(F.col("right.e"))
    stop = F.when(same, F.col("right.s")).otherwise(F.col("left.s"))
    rows = one.join(n, "item").withColumn("start", start).withColumn("stop", stop)
    span = F.col("stop") - F.col("start")
    verdict = (
        F.when(F.lit(single_hits) & (F.col("n_hits") != 3), "too_many_hits")
        .when(F.col("left").isNull() | F.col("middle").isNull() | F.col("right").isNull(), "missing_label")
        .when((F.col("left.strand") != F.col("right.strand")) | (F.col("left.strand") != F.col("middle.strand")), "strands_differ")
        .when((F.col("left.chrom") != F.col("right.chrom")) | (F.col("left.chrom") != F.col("middle.chrom")), "chromosomes_differ")
        .when(F.col("start") >= F.col("middle.s"), "left_after_middle")
        .when(F.col("middle.e") >= F.col("stop"), "middle_after_right")
        .when(F.abs(F.log10(span) - F.log10(F.col(exon_len))) >= 1, "lengths_differ")
        .otherwise("ok")
    )
    return rows.select("item", verdict.alias("verdict"), "start", "stop")


def parse_directory(path) -> dict[str, Column]:
    """chromosome, start and stop of an exon folder such as .../exon_chr1_120_180/...; null where a path holds none."""
    pattern = r"(?:^|/)exon_([^/]+)_([0-9]+)_([0-9]+)(?:/|$)"
    part = lambda i: F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))
    return {"chromosome": part(1), "start": part(2).cast("bigint"), "stop": part(3).cast("bigint")}
