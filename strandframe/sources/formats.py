"""Readers and writers of the sequence file formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.seq import parse_browser_id

_XML_LETTERS = "ACDEFGHIKLMNPQRSTUVWY"
SEQUENCE = (
    "id STRING, species STRING, chromosome STRING, strand STRING, genome_start BIGINT, genome_end BIGINT, length BIGINT, classname STRING, sequence STRING, type STRING, source STRING"
)
GTF = "seqname STRING, source STRING, feature STRING, start_pos BIGINT, end_pos BIGINT, score DOUBLE, strand STRING, frame INT, attribute STRING"
BED = "chrom STRING, chrom_start BIGINT, chrom_end BIGINT, name STRING, score STRING, strand STRING, thick_start BIGINT, thick_end BIGINT, item_rgb STRING, block_count INT, block_sizes STRING, block_starts STRING"


def fasta_record(ident: Column, seq: Column, width: int = 0) -> Column:
    body = F.regexp_replace(seq, f"(.{{{width}}})", "$1\n") if width else seq
    return F.concat(F.lit(">"), ident, F.lit("\n"), body)


def read_fasta(spark: SparkSession, path: str, letters: str = "A-Za-z* ", species: str | None = None, chromosome: str | None = None) -> DataFrame:
    """id, species, chromosome and seq of every record; a header without letters gives an empty seq, foreign letters raise.

    Records are split at '>' at a line's begin, so a file is read by many tasks. Where a header is
    a browser id its species and chromosome count, else the given ones.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    cut = rows.select(F.split("value", "\n", 2).alias("p"))
    seq = F.regexp_replace(F.coalesce(F.try_element_at("p", F.lit(2)), F.lit("")), "[\\r\\n]", "")
    out = cut.select(F.trim(F.regexp_replace(F.element_at("p", 1), "\\r$", "")).alias("id"), seq.alias("seq"))
    checked = F.when(F.col("seq").rlike(f"^[{letters}]*$"), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("foreign letters in record "), F.col("id"))))
    part = parse_browser_id(F.col("id"))
    named = lambda c, given: F.coalesce(F.nullif(part[c], F.lit("")), F.lit(given)).alias(c)
    return out.select("id", named("species", species), named("chromosome", chromosome), checked.alias("seq"))


def write_fasta(df: DataFrame, path: str, id_col: str = "id", seq_col: str = "seq", width: int = 60) -> None:
    df.select(fasta_record(F.col(id_col), F.col(seq_col), width)).write.text(path)


def read_gtf(spark: SparkSession, path: str, seqname: str | None = None, source: str | None = None, feature: str | None = None, strand: str | None = None, frame: int | None = None,
             range_start: int | None = None, range_end: int | None = None, min_score: float | None = None, max_score: float | None = None) -> DataFrame:
    """GTF rows as 0-based half-open intervals, filtered by the reader.

    Equality filters and the bounds of positions and scores reach the scan (they stand on its own
    columns, before positions are converted). A range keeps rows that overlap it.
    """
    if range_start is not None and range_end is not None and range_start >= range_end:
        raise ValueError("an empty range")
    if strand not in (None, "+", "-") or frame not in (None, 0, 1, 2):
        raise ValueError("no such strand or frame")
    rows = spark.read.csv(path, sep="\t", comment="#", nullValue=".", schema=GTF, quote="", escape="")
    for c, v in (("seqname", seqname), ("source", source), ("feature", feature), ("strand", strand), ("frame", frame)):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    for c, v, above in (("end_pos", None if range_start is None else range_start + 1, True), ("start_pos", range_end, False), ("score", min_score, True), ("score", max_score, False)):
        if v is not None:
            rows = rows.where(F.col(c) >= v if above else F.col(c) <= v)
    return rows.withColumn("start_pos", F.col("start_pos") - 1)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED rows of 3 to 12 columns with block lists as arrays; lists that do not fit block_count raise."""
    rows = spark.read.csv(path, sep="\t", schema=BED, quote="")
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("bigint"))
    out = rows.withColumn("block_sizes", numbers("block_sizes")).withColumn("block_starts", numbers("block_starts")).withColumn("score", F.col("score").try_cast("double"))
    fits = F.col("block_count").isNull() | ((F.size("block_sizes") == F.col("block_count")) & (F.size("block_starts") == F.col("block_count")))
    return out.withColumn("block_count", F.when(fits, F.col("block_count")).otherwise(F.raise_error(F.lit("block lists do not fit block_count")).cast("int")))


def read_keyed_tsv(spark: SparkSession, path: str, pattern: str, key: str, schema: str) -> DataFrame:
    """Many tables as one, with a key taken from each file's path; lines with # are comments."""
    rows = spark.read.csv(path, sep="\t", header=True, comment="#", schema=schema)
    return rows.withColumn(key, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_meme(spark: SparkSession, path: str, alphabet: str | None = None) -> DataFrame:
    """motif, pos, letter, p of MEME text; the first motif of a name counts within a file. A file of another alphabet than the given one raises."""
    from pyspark.sql import Window

    text = spark.read.text(path, wholetext=True).select(F.monotonically_increasing_id().alias("file"), "value")
    found = F.regexp_extract("value", r"ALPHABET=\s*(\S+)", 1)
    if alphabet is not None:
        found = F.when(found == alphabet, found).otherwise(F.raise_error(F.concat(F.lit("another alphabet: "), found)))
    parts = text.select("file", found.alias("alphabet"), F.posexplode(F.slice(F.split("value", r"(?m)^MOTIF\s+"), 2, 2**30)).alias("no", "body"))
    named = parts.withColumn("motif", F.regexp_extract("body", r"^(\S+)", 1))
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("file", "motif").orderBy("no"))).where("r = 1")
    rows = F.regexp_extract_all(F.regexp_extract("body", r"(?s)letter-probability matrix:[^\n]*\n(.*)", 1), F.lit(r"(?m)^[ \t]*([0-9][0-9.eE+ \t-]*)$"), F.lit(1))
    lines = first.select("alphabet", "motif", F.posexplode(rows).alias("pos", "line"))
    cells = lines.select("alphabet", "motif", "pos", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("i", "p"))
    return cells.select("motif", "pos", F.substring(F.col("alphabet"), F.col("i") + 1, F.lit(1)).alias("letter"), F.col("p").cast("double").alias("p"))


def meme_text(profiles: DataFrame, alphabet: str = "ACGT", name: str = "profile") -> DataFrame:
    """profile_idx, block: the MEME text of each profile (profile_idx, pos, letter, value); letters beyond A-Z are refused."""
    if not alphabet.isalpha():
        raise ValueError("the alphabet must consist of letters")
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.instr(F.lit(alphabet), F.col("letter")).alias("i"), F.format_string("%.6f", "value").alias("v"))))
    rows = profiles.groupBy("profile_idx").agg(ordered.alias("c"), (F.max("pos") + 1).alias("w"))
    line = F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda p: F.array_join(F.transform(F.filter("c", lambda x: x["pos"] == p), lambda x: x["v"]), " "))
    return rows.select("profile_idx", F.concat(F.lit(f"MOTIF {name}"), F.col("profile_idx").cast("string"), F.lit(f"\nletter-probability matrix: alength= {len(alphabet)} w= "), F.col("w").cast("string"), F.lit("\n"), F.array_join(line, "\n"), F.lit("\n")).alias("block"))


def write_meme(profiles: DataFrame, path: str, alphabet: str = "ACGT") -> None:
    head = profiles.sparkSession.createDataFrame([(-1, f"MEME version 5\n\nALPHABET= {alphabet}\n")], "profile_idx int, block string")
    head.unionByName(meme_text(profiles, alphabet).withColumn("profile_idx", F.col("profile_idx").cast("int"))).coalesce(1).sortWithinPartitions("profile_idx").select("block").write.text(path)


def read_motif_xml(spark: SparkSession, path: str, alphabet: str | None = None) -> DataFrame:
    """motif, pos, letter, p of the motifs of an XML report (built-in XML source), each motif a row of its own split.

    Without an alphabet, letters that are 0 everywhere in the report are surplus and left out.
    """
    rows = spark.read.format("xml").option("rowTag", "motif").option("useLegacyXMLParser", "true").schema("_id STRING, _alt STRING, pos ARRAY<STRUCT<" + ", ".join(f"_{c}: DOUBLE" for c in _XML_LETTERS) + ">>").load(path)
    pos = rows.select(F.col("_id").alias("motif"), F.posexplode("pos").alias("pos", "x"))
    cells = pos.select("motif", "pos", F.inline(F.array(*[F.struct(F.lit(c).alias("letter"), F.col(f"x._{c}").alias("p")) for c in _XML_LETTERS]))).where(F.col("p").isNotNull())
    if alphabet is not None:
        return cells.where(F.col("letter").isin(list(alphabet)))
    used = cells.groupBy("letter").agg(F.max("p").alias("top")).where("top > 0").select("letter")  # at most one row per letter
    return cells.join(F.broadcast(used), "letter", "left_semi").select("motif", "pos", "letter", "p")


def read_site_table(spark: SparkSession, path: str, aliases: DataFrame, amino: bool = False) -> DataFrame:
    """Sites of an external motif finder (1-based) as 0-based positions of the aliased sequences.

    aliases has alias, sequence_id (and frame_idx for amino acids). An unknown alias, a strand that does
    not suit the letters ('.' for amino acids, '+' or '-' for DNA) or an odd motif name raises.
    """
    schema = "motif_ID STRING, motif_ALT_ID STRING, motif_P STRING, seq_ID STRING, site_Start BIGINT, site_End BIGINT, site_Strand STRING, site_Score DOUBLE"
    rows = spark.read.csv(path, sep="\t", header=True, comment="#", schema=schema)
    placed = rows.join(aliases, rows["seq_ID"] == aliases["alias"], "left")
    fault = F.when(F.col("alias").isNull(), "unknown alias").when(~F.col("site_Strand").isin(["."] if amino else ["+", "-"]), "unsuitable strand").when(~F.col("motif_ALT_ID").rlike("^[A-Za-z]+-[0-9]+$"), "odd motif name")
    ident = F.when(fault.isNull(), F.col("sequence_id")).otherwise(F.raise_error(F.concat(fault, F.lit(": "), F.coalesce("seq_ID", F.lit("")), F.lit(" "), F.coalesce("motif_ALT_ID", F.lit("")))))
    frame = F.col("frame_idx") if amino else F.when(F.col("site_Strand") == "+", 0).otherwise(1)
    return placed.select("motif_ALT_ID", ident.alias("sequence_id"), (F.col("site_Start") - 1).alias("position"), F.col("site_Strand").alias("strand"), frame.cast("int").alias("frame"), (F.col("site_End") - F.col("site_Start") + 1).alias("site_len"))


def find_runs(spark: SparkSession, root: str, pattern: str, name: str, seed: int | None = None, most: int | None = None) -> DataFrame:
    """path and name (by a pattern on the path) of all files below a root; shuffled by a seed and cut off, if asked.

    The listing is the binary source's own, distributed; nothing of the files is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    named = files.withColumn(name, F.regexp_extract("path", pattern, 1)).where(F.col(name) != "")
    return seeded_cut(named, ["path"], seed, most) if seed is not None else named


def seeded_cut(df: DataFrame, key: list[str], seed: int, most: int | None = None) -> DataFrame:
    """Rows in an order that a seed fixes, whatever the partitions; the first `most` of them, if given (a top-k: each task sends at most that many rows)."""
    order = [F.xxhash64(*key, F.lit(seed)), *[F.col(k) for k in key]]
    rows = df.orderBy(*order)
    return rows if most is None else rows.limit(most)


def merge_new_runs(new: DataFrame, cached: DataFrame, key: str = "id") -> DataFrame:
    """Cached rows plus the new ones whose key is not cached yet."""
    return new.join(cached.select(key), key, "left_anti").unionByName(cached)
