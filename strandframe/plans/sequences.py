"""Sequence, coordinate, tiling and k-mer queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import seq as S
from strandframe.operators import kmers as K
from strandframe.operators import letters as A
from strandframe.plans.base import DNA, GREEDY, dna, frames, sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_RC = f"reverse(translate({{}}, '{S.DNA_LETTERS}', '{S.DNA_COMPLEMENT}'))"
_CODONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.CODONS.items()) + "}"


def _aa(seq: str, frame: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(substr({seq}, {frame} + 1), '...'), lambda c: coalesce({_CODONS}[c], ' ')), '')"


def _n():
    return F.length("seq")


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return add


@query(sql(DNA, query=f"SELECT seq_id, {_RC.format('seq')} AS rc, reverse(translate(seq, '{S.IUPAC_LETTERS}', '{S.IUPAC_COMPLEMENT}')) AS rc_iupac FROM seqs"))
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("seq_id", S.reverse_complement(F.col("seq")).alias("rc"), S.reverse_complement(F.col("seq"), iupac=True).alias("rc_iupac"))


@query(sql(DNA, query=f"SELECT seq_id, CAST(f AS INTEGER) AS frame, {_aa(f'CASE WHEN f < 3 THEN seq ELSE {_RC.format("seq")} END', '(f % 3)')} AS residues FROM seqs, range(6) r(f)"))
def six_frame_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.amino_frames(dna(spark, sf_dir), "seq_id", "seq")


@query(sql(DNA, query=f"SELECT seq_id, {_aa('seq', '0')} AS forward, {_aa(_RC.format('seq'), '0')} AS backward FROM seqs"))
def single_frame_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.translations(dna(spark, sf_dir), ["seq_id"], "seq", [0, 3]).select("seq_id", F.col("residues")[0].alias("forward"), F.col("residues")[1].alias("backward"))


@query(sql(DNA, query=f"SELECT sequence_id || ':f' || f AS id, seq_id, translate({_aa('seq', 'f')}, ' ', 'X') AS residues FROM seqs, range(3) r(f)"))
def translated_view_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.translations(dna(spark, sf_dir), ["sequence_id", "seq_id"], "seq", [0, 1, 2]).select("sequence_id", "seq_id", F.posexplode("residues").alias("f", "t"))
    return rows.select(F.concat("sequence_id", F.lit(":f"), "f").alias("id"), "seq_id", F.translate("t", " ", "X").alias("residues"))


@query(sql(DNA, query=f"SELECT seq_id, substr(seq, length(seq) // 4 + 1, length(seq) // 2 - length(seq) // 4) AS part, {_RC.format('substr(seq, length(seq) // 4 + 1, length(seq) // 2 - length(seq) // 4)')} AS part_rc FROM seqs"))
def local_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.expr("length(seq) div 4"), F.expr("length(seq) div 2")
    return dna(spark, sf_dir).select("seq_id", S.slice_local(F.col("seq"), a, b).alias("part"), S.slice_local(F.col("seq"), a, b, rc=True).alias("part_rc"))


@query(
    sql(
        DNA,
        query="""SELECT seq_id, d, CASE WHEN g_start + d < g_start + length(seq) AND g_start + d + 100 > g_start THEN
    substr(seq, CAST(greatest(d, 0) + 1 AS BIGINT), CAST(least(d + 100, length(seq)) - greatest(d, 0) AS BIGINT)) END AS part FROM seqs, (VALUES (-200), (-50), (10), (300), (1000000)) v(d)""",
    )
)
def genomic_slice_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dna(spark, sf_dir).withColumn("d", F.explode(F.array(*[F.lit(x) for x in (-200, -50, 10, 300, 1000000)])))
    return rows.select("seq_id", "d", S.slice_genomic(F.col("seq"), F.col("g_start"), F.col("g_start") + F.col("d"), F.col("g_start") + F.col("d") + 100).alias("part"))


@query(sql(DNA, query="SELECT seq_id, upper(seq) AS unmasked, array_to_string(list_transform(regexp_extract_all(seq, '[a-z]+|[^a-z]+'), lambda r: CASE WHEN regexp_matches(r, '^[a-z]') AND length(r) <= 20 THEN upper(r) ELSE r END), '') AS short_unmasked FROM seqs"))
def unmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("seq_id", F.upper("seq").alias("unmasked"), S.unmask_short_runs(F.col("seq"), 20).alias("short_unmasked"))


@query(sql(DNA, query="SELECT seq_id, substr(seq, 1, length(seq) // 2) || lower(substr(seq, length(seq) // 2 + 1, 40)) || substr(seq, length(seq) // 2 + 41) AS masked, substr(seq, length(seq) // 2 + 1, 40) AS before FROM seqs"))
def softmask_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("length(seq) div 2")
    return dna(spark, sf_dir).select("seq_id", S.softmask(F.col("seq"), at, F.lit(40)).alias("masked"), S.slice_local(F.col("seq"), at, at + 40).alias("before"))


@query(
    sql(
        DNA,
        query="""SELECT seq_id, substr(seq, 11) AS from_start, g_start + least(10, length(seq)) AS start_after, substr(seq, 1, greatest(length(seq) - 10, 0)) AS from_end, g_start + greatest(length(seq) - 10, 0) AS end_after,
    species || ':' || chromosome || ':' || format('{:,}', g_start + least(10, length(seq))) || '-' || format('{:,}', g_start + length(seq)) AS id_after,
    (g_start + length(seq) // 4 < g_start + length(seq)) AND (g_start + length(seq) // 2 > g_start + least(10, length(seq))) AS element_stays FROM seqs""",
    )
)
def strip_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.least(F.lit(10), _n())
    rest = F.greatest(_n() - 10, F.lit(0))
    start = F.col("g_start") + cut
    return dna(spark, sf_dir).select(
        "seq_id", F.substring("seq", 11, 2**30).alias("from_start"), start.alias("start_after"), F.substring(F.col("seq"), F.lit(1), rest).alias("from_end"), (F.col("g_start") + rest).alias("end_after"),
        S.browser_id(F.col("species"), F.col("chromosome"), start, F.col("g_start") + _n()).alias("id_after"),
        ((F.expr("length(seq) div 4") < _n()) & (F.col("g_start") + F.expr("length(seq) div 2") > start)).alias("element_stays"),
    )


@query("SELECT DISTINCT sequence_id, species || ':' || chromosome || ':' || format('{:,}', genome_start) || '-' || format('{:,}', genome_end) AS rebuilt FROM sequences WHERE species IS NOT NULL AND chromosome IS NOT NULL AND genome_start IS NOT NULL AND genome_end IS NOT NULL")
def browser_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/sequences.parquet").where(F.col("species").isNotNull() & F.col("chromosome").isNotNull() & F.col("genome_start").isNotNull() & F.col("genome_end").isNotNull())
    return rows.select("sequence_id", S.browser_id(F.col("species"), F.col("chromosome"), F.col("genome_start"), F.col("genome_end")).alias("rebuilt")).distinct()


@query(r"SELECT DISTINCT sequence_id, regexp_extract(sequence_id, '^(.*):([^:]*):([0-9,]+)-([0-9,]+)$', 2) AS chromosome, CAST(replace(regexp_extract(sequence_id, '^(.*):([^:]*):([0-9,]+)-([0-9,]+)$', 4), ',', '') AS BIGINT) - CAST(replace(regexp_extract(sequence_id, '^(.*):([^:]*):([0-9,]+)-([0-9,]+)$', 3), ',', '') AS BIGINT) AS span, (genome_start + 20 // 2) - (genome_start + genome_end) // 2 AS centre_offset FROM sequences WHERE sequence_id IS NOT NULL AND genome_start IS NOT NULL AND genome_end IS NOT NULL")
def parsed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.parse_browser_id(F.col("sequence_id"))
    rows = spark.read.parquet(f"{sf_dir}/sequences.parquet").where(F.col("sequence_id").isNotNull() & F.col("genome_start").isNotNull() & F.col("genome_end").isNotNull())
    return rows.select("sequence_id", part["chromosome"].alias("chromosome"), (part["end"] - part["start"]).alias("span"), (F.col("genome_start") + 10 - F.expr("(genome_start + genome_end) div 2")).alias("centre_offset")).distinct()


@query(sql(DNA, query="SELECT letter_idx, count(*) AS n, sum(pos) AS pos_sum FROM (SELECT unnest(string_split(seq, '')) AS letter, generate_subscripts(string_split(seq, ''), 1) - 1 AS pos FROM seqs) JOIN (VALUES ('A', 0), ('C', 1), ('G', 2), ('T', 3)) v(l, letter_idx) ON l = letter GROUP BY 1"))
def one_hot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long one-hot form (text, place, letter index; unknown letters absent), summed per letter."""
    return K.one_hot(dna(spark, sf_dir), "seq_id", "seq", "ACGT").groupBy("letter_idx").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query(sql(DNA, query="SELECT seq_id, regexp_full_match(seq, '[ACGT]+') AS plain_only, regexp_full_match(seq, '[ACGTacgtNn]+') AS no_ambiguity, len(list_distinct(string_split(seq, ''))) AS distinct_letters FROM seqs"))
def alphabet_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.array_distinct(F.split("seq", ""))
    return dna(spark, sf_dir).select("seq_id", F.col("seq").rlike("^[ACGT]+$").alias("plain_only"), F.col("seq").rlike("^[ACGTacgtNn]+$").alias("no_ambiguity"), F.size(letters).cast("bigint").alias("distinct_letters"))


@query(sql(DNA, query=f"SELECT seq_id, CAST(0 AS INTEGER) AS frame, seq AS text FROM seqs UNION ALL SELECT seq_id, 1, {_RC.format('seq')} FROM seqs"))
def frames_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dna_frames(dna(spark, sf_dir), "seq_id", "seq")


@query(sql(DNA, query="SELECT seq_id, repeat('l', CASE WHEN seq_id % 2 = 1 THEN length(seq) - length(seq) // 2 ELSE length(seq) // 4 END) || repeat('E', length(seq) // 2 - length(seq) // 4) || repeat('r', CASE WHEN seq_id % 2 = 1 THEN length(seq) // 4 ELSE length(seq) - length(seq) // 2 END) AS states FROM seqs"))
def state_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.expr("length(seq) div 4"), F.expr("length(seq) div 2")
    return dna(spark, sf_dir).select("seq_id", S.state_string(a, b - a, _n() - b, F.col("seq_id") % 2 == 1).alias("states"))


@query(sql(DNA, query="SELECT seq_id, CASE WHEN length(seq) > 23 THEN left(seq, 10) || '...' || right(seq, 10) ELSE seq END AS shown FROM seqs"))
def display_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("seq_id", F.when(_n() > 23, F.concat(F.left("seq", F.lit(10)), F.lit("..."), F.right("seq", F.lit(10)))).otherwise(F.col("seq")).alias("shown"))


@query(sql(DNA, query="""SELECT seq_id, to_json({id: sequence_id, species: species, chromosome: chromosome, genome_start: g_start, length: length(seq)}) AS described FROM seqs"""))
def sequence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("seq_id", F.to_json(F.struct(F.col("sequence_id").alias("id"), "species", "chromosome", F.col("g_start").alias("genome_start"), _n().alias("length"))).alias("described"))


@query(sql(DNA, query=f"SELECT seq_id, '>' || sequence_id || chr(10) || regexp_replace(seq, '(.{{60}})', '\\1' || chr(10), 'g') AS record FROM seqs"))
def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandframe.sources.formats import fasta_record

    return dna(spark, sf_dir).select("seq_id", fasta_record(F.col("sequence_id"), F.col("seq"), 60).alias("record"))


_POS = """SELECT DISTINCT sequence_id, p, f, seq_length - p - 1 AS flipped, p % 3 AS frame_of, (p - p % 3) // 3 AS amino, 3 * ((p - p % 3) // 3) + f AS dna_again,
    CAST(greatest(floor((p - f) / 3.0), 0) AS BIGINT) AS part_from, CAST(greatest(ceil((p + 25 - f) / 3.0), greatest(floor((p - f) / 3.0), 0)) AS BIGINT) AS part_to,
    CAST(greatest(ceil((p - f) / 3.0), 0) AS BIGINT) AS full_from, CAST(greatest(floor((p + 25 - f) / 3.0), greatest(ceil((p - f) / 3.0), 0)) AS BIGINT) AS full_to
    FROM (SELECT sequence_id, seq_length, f, genome_start % seq_length AS p FROM sequences, range(3) r(f) WHERE seq_length > 0 AND genome_start >= 0)"""


@query(_POS)
def position_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/sequences.parquet").where((F.col("seq_length") > 0) & (F.col("genome_start") >= 0))
    rows = rows.withColumn("f", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint")))).withColumn("p", F.col("genome_start") % F.col("seq_length"))
    p, f = F.col("p"), F.col("f")
    part, full = S.amino_range(f, p, p + 25, partial=True), S.amino_range(f, p, p + 25, partial=False)
    return rows.select(
        "sequence_id", "p", "f", S.flip(p, F.col("seq_length")).alias("flipped"), S.dna_to_frame(p).alias("frame_of"), S.dna_to_amino(p).alias("amino"), S.amino_to_dna(f, S.dna_to_amino(p)).alias("dna_again"),
        part[0].alias("part_from"), part[1].alias("part_to"), full[0].alias("full_from"), full[1].alias("full_to"),
    ).distinct()


@query(
    """WITH x AS (SELECT DISTINCT sequence_id, seq_length AS n, f, genome_start % seq_length AS raw FROM sequences, range(2) r(f) WHERE seq_length > 0 AND genome_start >= 0)
    SELECT sequence_id, f, CASE WHEN f = 0 THEN raw ELSE n - (raw + least(20, n - raw)) END AS position, CASE WHEN f = 0 THEN '+' ELSE '-' END AS strand, least(20, n - raw) AS site_len FROM x"""
)
def site_conversion_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/sequences.parquet").where((F.col("seq_length") > 0) & (F.col("genome_start") >= 0)).select("sequence_id", "seq_length", "genome_start").distinct()
    rows = rows.withColumn("f", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    at = S.site_on_dna(F.col("seq_length"), F.col("f"), F.col("genome_start") % F.col("seq_length"), F.lit(20).cast("bigint"))
    return rows.select("sequence_id", "f", *[c.alias(n) for n, c in at.items()])


@query(
    """WITH x AS (SELECT DISTINCT sequence_id, seq_length AS n, f, f % 3 AS h, genome_start % ((seq_length - 2) // 3) AS raw FROM sequences, range(6) r(f) WHERE seq_length > 5 AND genome_start >= 0),
    y AS (SELECT *, least(7, (n - h) // 3 - raw) AS k FROM x)
    SELECT sequence_id, f, CASE WHEN f < 3 THEN 3 * raw + h ELSE n - (3 * (raw + k) + h) END AS position, CASE WHEN f < 3 THEN '+' ELSE '-' END AS strand, 3 * k AS site_len FROM y"""
)
def site_conversion_aa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/sequences.parquet").where((F.col("seq_length") > 5) & (F.col("genome_start") >= 0)).select("sequence_id", "seq_length", "genome_start").distinct()
    rows = rows.withColumn("f", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))))
    at = S.amino_site_on_dna(F.col("seq_length"), F.col("f"), F.expr("genome_start % ((seq_length - 2) div 3)"), F.lit(7).cast("bigint"))
    return rows.select("sequence_id", "f", *[c.alias(n) for n, c in at.items()])


# ---- tiles, k-mers, background

@query(sql(DNA, query="SELECT seq_id, i AS tile_ord, i * 334 AS tile_start, substr(seq, i * 334 + 1, 334) AS tile FROM seqs, LATERAL (SELECT unnest(range(CAST(ceil(length(seq) / 334.0) AS BIGINT))) AS i)"))
def tiles_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tiles(dna(spark, sf_dir), "seq_id", "seq", 334)


@query(sql(DNA, query="SELECT seq_id, i AS tile_ord, greatest(length(seq) - (i + 1) * 334, 0) AS tile_start, substr(seq, greatest(length(seq) - (i + 1) * 334, 0) + 1, length(seq) - i * 334 - greatest(length(seq) - (i + 1) * 334, 0)) AS tile FROM seqs, LATERAL (SELECT unnest(range(CAST(ceil(length(seq) / 334.0) AS BIGINT))) AS i)"))
def tiles_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tiles(dna(spark, sf_dir), "seq_id", "seq", 334, reverse=True)


@query(sql(DNA, query="SELECT species, seq_id, n_tiles, before, before // 7 AS first_step FROM (SELECT species, seq_id, CAST(ceil(length(seq) / 334.0) AS BIGINT) AS n_tiles, CAST(coalesce(sum(CAST(ceil(length(seq) / 334.0) AS BIGINT)) OVER (PARTITION BY species ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM seqs)"))
def tile_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which training step each sequence's first tile falls in, genomes side by side, 7 tiles a step."""
    return K.tile_steps(dna(spark, sf_dir), "species", "seq_id", "seq", 334, 7)


@query(sql(DNA, query=f"""SELECT letter, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 9) AS freq FROM (
    SELECT letter, CAST(sum(length(t) - length(replace(t, letter, ''))) AS BIGINT) AS n FROM (SELECT seq AS t FROM seqs UNION ALL SELECT {_RC.format('seq')} FROM seqs), (VALUES ('A'), ('C'), ('G'), ('T')) v(letter) GROUP BY letter)"""))
def background_freqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.background(K.dna_frames(dna(spark, sf_dir), "seq_id", "seq"), "text", "ACGT")
    return out.select("letter", "n", F.round("freq", 9).alias("freq"))


_KMERS = "SELECT species, seq_id, substr(seq, CAST(i AS BIGINT), 8) AS kmer, i - 1 AS pos FROM seqs, LATERAL (SELECT unnest(range(1, greatest(length(seq) - 6, 1))) AS i)"


@query(sql(DNA, query=f"SELECT kmer, count(*) AS n, count(DISTINCT species) AS n_species FROM ({_KMERS}) WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY kmer"))
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.kmer_rows(dna(spark, sf_dir), ["species", "seq_id"], "seq", 8)
    return rows.groupBy("kmer").agg(F.count("*").alias("n"), F.count_distinct("species").alias("n_species"))


def greedy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy index of 12-mers over all genomes and both strands, tiles of 6 letters."""
    keep = ["home", "species", "seq_id", "frame"]
    return K.greedy_index(K.kmer_rows(frames(spark, sf_dir), keep, "text", 12, tile=6), [*keep, "pos"], 6)


@query(sql(DNA, GREEDY, query="SELECT kmer, n, CAST(r AS BIGINT) AS place FROM (SELECT kmer, n, rank() OVER (ORDER BY n DESC) AS k, row_number() OVER (ORDER BY n DESC, seen, kmer) AS r FROM greedy) WHERE (n >= 8 OR k <= 10) AND r <= 200"))
def kmer_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of the greedy index: enough occurrences, or within the ties of the least number; at most 200 (that cap is the selection's own)."""
    return K.select_kmers(greedy_counts(spark, sf_dir), max_u=200, min_occ=8, min_u=10)


@query(sql(DNA, GREEDY, query="SELECT kmer, n, CAST(r AS BIGINT) AS place FROM (SELECT kmer, n, row_number() OVER (ORDER BY n DESC, seen, kmer) AS r FROM greedy) WHERE r <= 200"))
def kmer_selection_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly 200 seeds, however rare the last ones are (all there are, where they are fewer)."""
    return K.select_kmers(greedy_counts(spark, sf_dir), max_u=200, enforce_u=True)


@query(sql(DNA, GREEDY, query="SELECT kmer, n FROM greedy"))
def greedy_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-mers admitted by one scan over all genomes, texts and strands, a tile admitting no second new one, with their counts."""
    return greedy_counts(spark, sf_dir).select("kmer", "n")


@query(sql(DNA, f"c AS (SELECT species, kmer, count(*) AS n FROM ({_KMERS}) WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY ALL)",
           query="""SELECT kmer, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, CASE WHEN b.n IS NULL THEN 'only_left' WHEN a.n IS NULL THEN 'only_right' WHEN a.n <> b.n THEN 'differs' ELSE 'same' END AS verdict
           FROM (SELECT kmer, n FROM c WHERE species = 'Homo_sapiens') a FULL JOIN (SELECT kmer, CAST(sum(n) AS BIGINT) AS n FROM c WHERE species <> 'Homo_sapiens' GROUP BY kmer) b USING (kmer)"""))  # fmt: skip
def kmer_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each k-mer in the first species against those in all others."""
    rows = K.kmer_rows(dna(spark, sf_dir), ["species"], "seq", 8)
    n = rows.groupBy("kmer").agg(F.count_if(F.col("species") == "Homo_sapiens").alias("n_left"), F.count_if(F.col("species") != "Homo_sapiens").alias("n_right"))
    verdict = F.when(F.col("n_right") == 0, "only_left").when(F.col("n_left") == 0, "only_right").when(F.col("n_left") != F.col("n_right"), "differs").otherwise("same")
    return n.select("kmer", "n_left", "n_right", verdict.alias("verdict")).where("n_left + n_right > 0")


@query(sql(DNA, query=f"SELECT kmer FROM ({_KMERS}) WHERE regexp_full_match(kmer, '[ACGT]+') AND species = 'Homo_sapiens' EXCEPT SELECT kmer FROM ({_KMERS}) WHERE species <> 'Homo_sapiens'"))
def kmer_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.kmer_rows(dna(spark, sf_dir), ["species"], "seq", 8)
    return rows.groupBy("kmer").agg(F.bool_and(F.col("species") == "Homo_sapiens").alias("own")).where("own").select("kmer")


@query(sql(DNA, query="SELECT species, seq_id, CAST(r AS BIGINT) AS place, 'seq' || r AS alias FROM (SELECT species, seq_id, row_number() OVER (ORDER BY CASE WHEN species = 'Homo_sapiens' THEN 0 ELSE 1 END, species, seq_id) - 1 AS r FROM seqs)"))
def alias_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers in one order over all texts, the first species ahead; numbered per range partition, not in one task, and without their letters."""
    first = F.when(F.col("species") == "Homo_sapiens", 0).otherwise(1)
    out = K.number_rows(dna(spark, sf_dir).select(first.alias("first"), "species", "seq_id"), ["first", "species", "seq_id"])
    return out.select("species", "seq_id", F.col("number").alias("place"), F.concat(F.lit("seq"), F.col("number").cast("string")).alias("alias"))


@query(sql(DNA, query="SELECT species, greatest(1, CAST(floor(total / (1 * 7 * 334)) AS BIGINT)) AS steps, n FROM (SELECT species, sum(length(seq)) AS total, count(*) AS n FROM seqs GROUP BY species)"))
def epoch_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = dna(spark, sf_dir).groupBy("species").agg(F.sum(_n()).alias("total"), F.count("*").alias("n"))
    return g.select("species", F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("total") / (7 * 334)).cast("bigint")).alias("steps"), "n")


@query(sql(DNA, query="SELECT n_seqs, count(*) AS n_genomes FROM (SELECT species, count(*) AS n_seqs FROM seqs GROUP BY species) GROUP BY n_seqs"))
def genome_size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).groupBy("species").agg(F.count("*").alias("n_seqs")).groupBy("n_seqs").agg(F.count("*").alias("n_genomes"))


@query("SELECT sequence_id, n, n_species, unique_id FROM (SELECT sequence_id, count(*) AS n, count(DISTINCT species) AS n_species, count(*) = 1 AS unique_id FROM (SELECT DISTINCT sequence_id, species, chromosome, strand, genome_start, genome_end, seq_length, classname, seq_type, seq_source FROM sequences) GROUP BY sequence_id)")
def sequence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/sequences.parquet").drop("loaded_at").distinct()
    return rows.groupBy("sequence_id").agg(F.count("*").alias("n"), F.count_distinct("species").alias("n_species"), (F.count("*") == 1).alias("unique_id"))


@query("SELECT species, seq_type, count(*) AS n FROM (SELECT DISTINCT sequence_id, species, chromosome, strand, genome_start, genome_end, seq_length, classname, seq_type, seq_source FROM sequences) WHERE classname = 'Sequence' GROUP BY ALL")
def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/sequences.parquet").drop("loaded_at").distinct()
    return rows.where(F.col("classname") == "Sequence").groupBy("species", "seq_type").agg(F.count("*").alias("n"))


