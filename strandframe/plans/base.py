"""Common inputs of the sequence queries, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.seq import parse_browser_id
from strandframe.session import measured, table


def once(df: DataFrame, id_col: str, arrival: str = "loaded_at") -> DataFrame:
    """Re-delivered rows once: of the rows of one id the earliest arrival, ties by their place in the files.

    The texts do not move: a narrow scan finds the ids that came more than once and their first
    row; these are measured and, up to a bound, broadcast (see session.measured).
    """
    at = F.col(arrival) if arrival in df.columns else F.lit(None).cast("timestamp")
    rank = F.struct(at.alias("at"), F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row"))
    ranked = df.withColumn("_rank", rank)
    again = ranked.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n"), F.min("_rank").alias("_first")).where("_n > 1").drop("_n")
    kept = ranked.join(measured(again), F.col(id_col).eqNullSafe(F.col("_id")), "left").where(F.col("_first").isNull() | (F.col("_rank") == F.col("_first")))
    return kept.drop("_rank", "_id", "_first")


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, sequence_id, species, chromosome, g_start, seq of the DNA texts, re-delivered rows once."""
    rows = table(spark, sf_dir, "tileable_sequences").where((F.col("alphabet") == "dna") & (F.col("seq") != "") & F.col("sequence_id").isNotNull())
    part = parse_browser_id(F.col("sequence_id"))
    return once(rows, "tileable_id").select(F.col("tileable_id").alias("seq_id"), "sequence_id", part["species"].alias("species"), part["chromosome"].alias("chromosome"), part["start"].alias("g_start"), "seq")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """home (0 for the first species), species, seq_id, frame (0 forward, 1 reverse complement), text: what scans of both strands read, in the order of the first four."""
    from strandframe.functions.seq import reverse_complement

    both = F.posexplode(F.array(F.col("seq"), reverse_complement(F.col("seq")))).alias("frame", "text")
    return dna(spark, sf_dir).select(F.when(F.col("species") == "Homo_sapiens", 0).otherwise(1).alias("home"), "species", "seq_id", both)


DNA = r"""seqs AS (
    SELECT seq_id, sequence_id, split_part(sequence_id, ':', 1) AS species, split_part(sequence_id, ':', 2) AS chromosome,
        CAST(replace(split_part(split_part(sequence_id, ':', 3), '-', 1), ',', '') AS BIGINT) AS g_start, seq
    FROM (SELECT DISTINCT tileable_id AS seq_id, sequence_id, seq FROM tileable_sequences WHERE alphabet = 'dna' AND seq <> '' AND sequence_id IS NOT NULL)
)"""


#: All windows of both strands made of plain letters, and the k-mers that a greedy scan of them admits with their counts.
GREEDY = r"""win AS (
    SELECT CASE WHEN species = 'Homo_sapiens' THEN 0 ELSE 1 END AS home, species, seq_id, frame, i - 1 AS pos, substr(text, CAST(i AS BIGINT), 12) AS kmer
    FROM (SELECT species, seq_id, 0 AS frame, seq AS text FROM seqs UNION ALL SELECT species, seq_id, 1, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) FROM seqs), LATERAL (SELECT unnest(range(1, greatest(length(text) - 10, 1))) AS i)
), plain AS (SELECT *, (home, species, seq_id, frame, pos) AS place FROM win WHERE regexp_full_match(kmer, '[ACGT]{12}')
), admitted AS (
    SELECT kmer, min(place) AS seen FROM (SELECT kmer, place, row_number() OVER (PARTITION BY species, seq_id, frame, pos // 6 ORDER BY pos) AS r FROM plain) WHERE r = 1 GROUP BY kmer
), greedy AS (
    SELECT kmer, count(*) AS n, min(seen) AS seen FROM plain JOIN admitted USING (kmer) WHERE place >= seen GROUP BY kmer
)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GTF rows with valid positions as 0-based half-open intervals, re-delivered rows once."""
    rows = table(spark, sf_dir, "gtf_features").where(F.col("seqname").isNotNull() & F.col("strand").isin("+", "-") & F.col("start_pos").isNotNull() & (F.col("end_pos") >= F.col("start_pos")))
    return rows.select("feature_id", "gtf_file", "seqname", "source", "feature", (F.col("start_pos") - 1).alias("s"), F.col("end_pos").alias("e"), "score", "strand", "frame").dropDuplicates()


FEATURES = """feats AS (
    SELECT DISTINCT feature_id, gtf_file, seqname, source, feature, start_pos - 1 AS s, end_pos AS e, score, strand, frame FROM gtf_features
    WHERE seqname IS NOT NULL AND strand IN ('+', '-') AND start_pos IS NOT NULL AND end_pos >= start_pos
)"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED12 rows whose block lists both hold block_count numbers, as arrays; re-delivered rows once."""
    numbers = lambda c: F.transform(F.regexp_extract_all(F.col(c), F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("bigint"))
    rows = table(spark, sf_dir, "bed_transcripts").select("bed_id", "chrom", "chrom_start", "chrom_end", "tx_name", "strand", "block_count", numbers("block_sizes").alias("sizes"), numbers("block_starts").alias("starts"))
    ok = (F.size("sizes") == F.col("block_count")) & (F.size("starts") == F.col("block_count")) & F.col("chrom").isNotNull() & F.col("chrom_start").isNotNull()
    return rows.where(ok).dropDuplicates(["bed_id"])


TRANSCRIPTS = """tx AS (
    SELECT DISTINCT bed_id, chrom, chrom_start, chrom_end, tx_name, strand, block_count, sizes, starts FROM (
        SELECT bed_id, chrom, chrom_start, chrom_end, tx_name, strand, block_count,
            list_transform(regexp_extract_all(block_sizes, '[0-9]+'), lambda x: CAST(x AS BIGINT)) AS sizes, list_transform(regexp_extract_all(block_starts, '[0-9]+'), lambda x: CAST(x AS BIGINT)) AS starts
        FROM bed_transcripts)
    WHERE len(sizes) = block_count AND len(starts) = block_count AND chrom IS NOT NULL AND chrom_start IS NOT NULL
)"""


def sql(*ctes: str, query: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + query
