"""Reading frames, tiles, k-mers, background and seed selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import seq as S
from strandframe.operators import letters as A


def dna_frames(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """id, frame (0 forward, 1 reverse complement), text."""
    return df.select(F.col(id_col), F.posexplode(F.array(F.col(seq_col), S.reverse_complement(F.col(seq_col)))).alias("frame", "text"))


def amino_frames(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """id, frame (0-5), residues."""
    return A.translations(df, [id_col], seq_col, list(range(6))).select(F.col(id_col), F.posexplode("residues").alias("frame", "residues"))


def one_hot(df: DataFrame, id_col: str, seq_col: str, alphabet: str) -> DataFrame:
    """Long one-hot form: id, pos, letter_idx; letters outside the alphabet have no row."""
    return A.one_hot(df, [id_col], seq_col, alphabet)


def tiles(df: DataFrame, id_col: str, seq_col: str, size: int, reverse: bool = False) -> DataFrame:
    """Non-overlapping tiles; in reverse they are counted from the end and the last one is the short one."""
    return A.tiles(df, [id_col], seq_col, size, reverse)


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, name: str = "before") -> DataFrame:
    """Adds the sum of `value` over the rows of the same group that come earlier in a total order.

    Rows are range-partitioned by group and order, so a hot group spreads over partitions; sums
    run inside a partition and are completed by one row per partition and group. Give narrow
    rows: they are written to the shared checkpoint folder, which fixes their partitions.
    """
    from strandframe.session import shared_checkpoint

    placed = shared_checkpoint(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    earlier = lambda by, key: Window.partitionBy(*by).orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    inside = F.coalesce(F.sum(value).over(earlier([*group, "_part"], order)), zero)
    sums = placed.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    offsets = sums.select(*group, "_part", F.coalesce(F.sum("_sum").over(earlier(group, ["_part"])), zero).alias("_offset"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*group, "_part"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    p = placed.withColumn("_inside", inside).alias("p")
    return p.join(offsets.alias("o"), on).select(*[F.col(f"p.{c}") for c in df.columns], (F.col("p._inside") + F.col("o._offset")).cast("bigint").alias(name))


def tile_steps(df: DataFrame, genome_col: str, id_col: str, seq_col: str, size: int, per_step: int) -> DataFrame:
    """Running tile number of each sequence within its genome (by id) and the step it begins in; the texts never move."""
    counted = df.select(F.col(genome_col), F.col(id_col), F.ceil(F.length(seq_col) / size).cast("bigint").alias("n_tiles"))
    out = running_total(counted, [genome_col], [id_col], "n_tiles")
    return out.select(genome_col, id_col, "n_tiles", "before", F.floor(F.col("before") / per_step).cast("bigint").alias("first_step"))


def background(frames: DataFrame, text_col: str, alphabet: str) -> DataFrame:
    """letter, n, freq: counts by lengths of text without the letter, so nothing is exploded; combined map-side."""
    letters = [F.sum(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit(c), F.lit("")))).alias(c) for c in alphabet]
    one = frames.agg(*letters)
    total = sum((F.col(c) for c in alphabet[1:]), F.col(alphabet[0]))
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("letter"), F.coalesce(F.col(c), F.lit(0)).alias("n"), F.when(total > 0, F.col(c) / total).otherwise(F.lit(0.0)).alias("freq")) for c in alphabet])))
    return rows


def kmer_rows(df: DataFrame, keep: list[str], seq_col: str, k: int, letters: str = "ACGT", tile: int | None = None) -> DataFrame:
    """keep columns, pos, kmer of all windows made of unmasked letters only; with tile also opens, true of a tile's first."""
    return A.kmer_rows(df, keep, seq_col, k, letters, tile)


def count_kmers(rows: DataFrame, order: list[str]) -> DataFrame:
    """kmer, n, seen: plain counts and the earliest place (a struct of the order columns)."""
    return rows.groupBy("kmer").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("seen"))


def greedy_index(rows: DataFrame, order: list[str], tile: int) -> DataFrame:
    """kmer, n, seen of the k-mers that a greedy scan of all windows in order admits, and how often it counts them.

    The scan: a window whose k-mer is not admitted yet is skipped if its tile of `tile` letters was
    marked by an earlier window; otherwise its k-mer is admitted; windows of admitted k-mers count
    and mark their tile. The last of the order columns is the position, those before name the text.

    The scan looks sequential but is not. The first window of a tile always finds it unmarked, so
    it is always admitted or counted, and marks it; every later window of the tile can then only
    be counted, never admitted. So the admitted k-mers are those that begin some tile, each from
    the earliest such window on, and a k-mer's count is the number of its windows from there on:
    two map-side combined aggregates and one join on the k-mer, over any number of genomes.
    Rows that say which windows are the first of a tile (opens, of texts that come once) need no
    shuffle to find these.
    """
    *text, pos = order
    in_order = F.struct(*order)
    firsts = rows.where("opens") if "opens" in rows.columns else rows.groupBy(*text, F.floor(F.col(pos) / tile).alias("_tile")).agg(F.min_by("kmer", pos).alias("kmer"), F.min(pos).alias(pos))
    admitted = firsts.groupBy("kmer").agg(F.min(in_order).alias("seen"))
    counted = rows.join(admitted, "kmer").where(in_order >= F.col("seen"))
    return counted.groupBy("kmer").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))


def select_kmers(counts: DataFrame, max_u: int, min_occ: int = 8, min_u: int = 10, enforce_u: bool = False) -> DataFrame:
    """kmer, n, place of the seeds among counted k-mers (kmer, n, seen); ties go by first sight.

    With enforce_u exactly the max_u commonest (all, where there are fewer: see random_kmers).
    Otherwise all with min_occ occurrences; where they are fewer than min_u, down to the ties of
    the min_u-th; never more than max_u. Each task sends at most max(min_u, max_u) rows.
    """
    top = counts.orderBy(F.desc("n"), "seen", "kmer").limit(max(min_u, max_u))
    placed = top.withColumn("k", F.rank().over(Window.orderBy(F.desc("n")))).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "seen", "kmer")))
    wanted = F.lit(True) if enforce_u else (F.col("n") >= min_occ) | (F.col("k") <= min_u)
    return placed.where(wanted & (F.col("r") <= max_u)).select("kmer", "n", F.col("r").cast("bigint").alias("place"))


def random_kmers(spark, n: int, k: int, frequencies: dict[str, float], seed: int) -> DataFrame:
    """place, kmer: n random k-mers drawn letter by letter from background frequencies, the same for the same seed; filled up by rows of a range, not on the driver."""
    letters = sorted(frequencies)
    total = sum(frequencies.values()) or 1.0
    edges, at = [], 0.0
    for c in letters[:-1]:
        at += frequencies[c] / total
        edges.append((c, at))

    def letter(j: int):
        u = F.shiftrightunsigned(F.xxhash64("id", F.lit(j), F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
        out = F.lit(letters[-1])
        for c, edge in reversed(edges):
            out = F.when(u < edge, c).otherwise(out)
        return out

    return spark.range(n).select((F.col("id") + 1).alias("place"), F.concat(*[letter(j) for j in range(k)]).alias("kmer"))


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds `number`, dense from 0 in the given total order, without a single-task window.

    Rows are range-partitioned and sorted; each partition's size (one row per partition) gives
    its offset. Give narrow rows: they are written to the shared checkpoint folder.
    """
    from strandframe.session import shared_checkpoint

    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = shared_checkpoint(placed.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn("number", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")
