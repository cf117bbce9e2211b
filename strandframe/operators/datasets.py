"""Datasets of exons: the lifted range of every species, cut from its text, oriented, stripped and put together.

All exons and species are one join and one aggregate: ranges meet the texts that hold them by
an interval join on coordinate bins, so neither an exon nor a chromosome is a unit of work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import seq as S
from strandframe.operators.intervals import overlap_join


def exon_sequences(lifted: DataFrame, texts: DataFrame, home: str, cut_left: int = 0, cut_right: int = 0, short_runs: int = 0, width: int = 1 << 14) -> DataFrame:
    """item, species, id, strand, genome_start, genome_end, seq of every lifted range that a text holds whole, for items whose home species is among them.

    lifted has item, species, chromosome, start, stop, on_reverse; texts has species, chromosome,
    g_start, seq. Ranges on the reverse strand are turned. cut_left and cut_right letters are then
    taken off the ends (places follow), soft-masked runs of up to short_runs letters unmasked.
    Ranges that nothing is left of, and ranges of null or wrong bounds, give no row.
    """
    parents = texts.where(F.col("seq") != "").select("species", "chromosome", F.col("g_start").alias("s"), (F.col("g_start") + F.length("seq")).alias("e"), "seq")
    child = lifted.where(F.col("start") < F.col("stop")).select("item", "species", "chromosome", F.col("start").alias("s"), F.col("stop").alias("e"), "on_reverse")
    rows = overlap_join(parents, child, ["species", "chromosome"], width, contained=True)
    left, right = F.when(F.col("on_reverse"), cut_right).otherwise(cut_left), F.when(F.col("on_reverse"), cut_left).otherwise(cut_right)
    rows = rows.withColumn("a", F.col("s2") + left).withColumn("b", F.col("e2") - right).where("a < b")
    part = S.slice_local(F.col("seq"), F.col("a") - F.col("s"), F.col("b") - F.col("s"))
    part = F.when(F.col("on_reverse"), S.reverse_complement(part)).otherwise(part)
    shown = S.unmask_short_runs(part, short_runs) if short_runs else part
    out = rows.select("item", "species", S.browser_id(F.col("species"), F.col("chromosome"), F.col("a"), F.col("b")).alias("id"), F.when(F.col("on_reverse"), "-").otherwise("+").alias("strand"), F.col("a").alias("genome_start"), F.col("b").alias("genome_end"), shown.alias("seq"))
    with_home = out.where(F.col("species") == home).select("item").distinct()
    return out.join(with_home, "item", "left_semi")


def exon_records(sequences: DataFrame, home: str) -> DataFrame:
    """item, n_species, first_id, record: the dataset of an exon as a JSON array of its sequences, the home species first.

    An item has one sequence per species or few, so what is gathered per item is bounded by the species.
    """
    record = F.to_json(F.struct("id", "species", "strand", "genome_start", "genome_end", F.length("seq").cast("bigint").alias("length"), F.lit("Sequence").alias("classname"), F.col("seq").alias("sequence")))
    ordered = F.array_sort(F.collect_list(F.struct((F.col("species") != home).alias("away"), "species", "id", record.alias("r"))))
    rows = sequences.groupBy("item").agg(F.count_distinct("species").alias("n_species"), ordered.alias("o"))
    return rows.select("item", "n_species", F.col("o")[0]["id"].alias("first_id"), F.concat(F.lit("["), F.array_join(F.transform("o", lambda x: x["r"]), ","), F.lit("]")).alias("record"))


def self_liftover(exons: DataFrame, lifted: DataFrame) -> DataFrame:
    """item and verdict of lifting the home species onto itself, which must give back each range: same, moved or missing."""
    back = lifted.select("item", F.col("chromosome").alias("c2"), F.col("start").alias("a2"), F.col("stop").alias("b2"))
    same = (F.col("chromosome") == F.col("c2")) & (F.col("start") == F.col("a2")) & (F.col("stop") == F.col("b2"))
    verdict = F.when(F.col("c2").isNull(), "missing").when(same, "same").otherwise("moved")
    return exons.join(back, "item", "left").select("item", verdict.alias("verdict"))
