"""Links of occurrences across species and their scores against annotated exons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import seq as S


def _product(counts: Column) -> Column:
    """Exact product of an array of counts as decimal(38, 0); null beyond 38 digits."""
    whole = "decimal(38,0)"
    return F.aggregate(counts, F.lit(1).cast(whole), lambda acc, n: F.try_multiply(acc, n.cast("decimal(19,0)")).cast(whole))


def multilinks(occ: DataFrame, by: str = "profile") -> DataFrame:
    """profile, n_occs, n_species, n_links, log10_links: one occurrence of each species makes a link, so counts multiply.

    n_links is exact up to 38 digits and null beyond; log10_links is always there. What is gathered
    per profile is one count per species.
    """
    per = occ.groupBy(by, "species").agg(F.count("*").alias("n"))
    all_ = per.groupBy(by).agg(F.sum("n").alias("n_occs"), F.count("*").alias("n_species"), F.collect_list("n").alias("_ns"), F.sum(F.log10("n")).alias("log10_links"))
    return all_.select(by, "n_occs", "n_species", _product(F.col("_ns")).alias("n_links"), "log10_links")


def links_of_groups(occ: DataFrame, group: str) -> DataFrame:
    """group, n_profiles, n_occs, n_links, log10_most: a group of several profiles has the sum of its profiles' links (null if that is beyond 38 digits)."""
    keyed = occ.withColumn("_key", F.struct(group, "profile"))
    per = multilinks(keyed, "_key").select(F.col(f"_key.{group}").alias(group), "n_occs", "n_links", "log10_links")
    whole = F.when(F.count("*") == F.count("n_links"), F.try_sum("n_links"))
    return per.groupBy(group).agg(F.count("*").alias("n_profiles"), F.sum("n_occs").alias("n_occs"), whole.alias("n_links"), F.max("log10_links").alias("log10_most"))


def with_species(occ: DataFrame, wanted: list[str]) -> DataFrame:
    """The occurrences of the profiles that have all the wanted species."""
    have = occ.where(F.col("species").isin(wanted)).groupBy("profile").agg(F.count_distinct("species").alias("n")).where(F.col("n") == len(set(wanted)))
    return occ.join(have.select("profile"), "profile", "left_semi")


def expand_links(occ: DataFrame, most: int = 100) -> DataFrame:
    """profile, members, skipped: every link of the profiles in two species or more.

    A profile that would make more than `most` links gives one row instead: no members, and in
    skipped the count at which the multiplication (species in order) first exceeded the limit.
    Counts are multiplied only up to there, so nothing overflows, profiles beyond the limit are
    never expanded, and what is gathered per profile is bounded by it.
    """
    per = occ.groupBy("profile", "species").agg(F.count("*").alias("n"))
    ordered = per.groupBy("profile").agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct("species", "n"))).alias("g")).where("k > 1")
    product = F.aggregate("g", F.lit(1).cast("bigint"), lambda acc, x: F.when(acc > most, acc).otherwise(acc * x["n"]))
    sized = ordered.select("profile", product.alias("links"))
    skipped = sized.where(F.col("links") > most).select("profile", F.lit(None).cast("string").alias("members"), F.col("links").alias("skipped"))
    name = F.concat_ws(":", "species", F.col("seq_id").cast("string"), F.col("pos").cast("string"))
    groups = occ.join(sized.where(F.col("links") <= most).select("profile"), "profile", "left_semi").groupBy("profile", "species").agg(F.array_sort(F.collect_list(name)).alias("g"))
    sets = groups.groupBy("profile").agg(F.transform(F.array_sort(F.collect_list(F.struct("species", "g"))), lambda x: x["g"]).alias("gs"))
    start = F.array(F.lit("")).cast("array<string>")
    product = F.aggregate("gs", start, lambda acc, g: F.flatten(F.transform(acc, lambda a: F.transform(g, lambda x: F.when(a == "", x).otherwise(F.concat(a, F.lit("|"), x))))))
    return sets.select("profile", F.explode(product).alias("members"), F.lit(None).cast("bigint").alias("skipped")).unionByName(skipped)


def link_records(occ: DataFrame, width: int) -> DataFrame:
    """profile, record: each profile's occurrences (profile, species, seq_id, sequence_id, pos) as the JSON of a multi-link, species and places in order."""
    told = F.concat(F.lit("["), F.to_json(F.struct(F.col("sequence_id").alias("x"))), F.lit("]"))
    quoted = F.regexp_extract(told, r"(?s)\{\"x\":(.*)\}", 1)
    text = F.concat(F.lit("["), quoted, F.lit(", "), F.col("pos").cast("string"), F.lit(f', "+", {width}, '), F.col("profile").cast("string"), F.lit("]"))
    groups = occ.groupBy("profile", "species").agg(F.array_sort(F.collect_list(F.struct("seq_id", "pos", text.alias("t")))).alias("g"))
    ordered = groups.select("profile", "species", F.concat(F.lit("["), F.array_join(F.transform("g", lambda x: x["t"]), ", "), F.lit("]")).alias("g"))
    sets = ordered.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("species", "g"))).alias("s"))
    return sets.select("profile", F.concat(F.lit('{"occs": ['), F.array_join(F.transform("s", lambda x: x["g"]), ", "), F.lit('], "singleProfile": true, "classname": "MultiLink"}')).alias("record"))


def align(members: DataFrame, texts: DataFrame, width: int, amino: bool = False) -> DataFrame:
    """link, line_no, line: the letters under each member of a link in order, reverse ones turned, each with its sequence id and range.

    members has link, species, seq_id, pos, frame (0 forward, 1 reverse; pos on the forward strand);
    texts has seq_id, sequence_id, seq. Sites end with their sequence. amino shows translations.
    """
    part = F.substring(F.col("seq"), (F.col("pos") + 1).cast("int"), F.lit(width))
    part = F.when(F.col("frame") == 1, S.reverse_complement(part)).otherwise(part)
    shown = S.translate_frame(part) if amino else part
    end = F.least(F.col("pos") + width, F.length("seq"))
    rows = members.join(texts.select("seq_id", "sequence_id", "seq"), "seq_id")
    line = F.concat(shown, F.lit(" - "), F.col("sequence_id"), F.lit(" at "), F.col("pos").cast("string"), F.lit(":"), end.cast("string"))
    place = F.row_number().over(Window.partitionBy("link").orderBy("species", "seq_id", "pos", "frame")) - 1  # a link has one member per species
    return rows.select("link", place.alias("line_no"), line.alias("line"))


def exon_hit_counts(occ: DataFrame, hits: DataFrame, home: str, n_exons: DataFrame) -> DataFrame:
    """One row of hit metrics. `hits` pairs home occurrences (occ_id) with exons (exon_id); occ has occ_id, profile, species.

    A hit counts if its profile also occurs abroad; linked hits multiply the counts of the other
    species. Link counts are exact up to 38 digits and null beyond.
    """
    abroad = multilinks(occ.where(F.col("species") != home)).select("profile", F.col("n_links").alias("others"))
    linked = hits.join(abroad, "profile")
    sum_of = lambda c: F.when(F.count("*") == F.count(c), F.coalesce(F.try_sum(c), F.when(F.count("*") == 0, 0).cast("decimal(38,0)")))
    one = linked.agg(F.count_distinct("exon_id").alias("n_exons_hit"), F.count_distinct("occ_id").alias("n_occs_hit"), sum_of("others").alias("n_links_hit"))
    total = multilinks(occ).agg(sum_of("n_links").alias("n_links"))
    at_home = occ.where(F.col("species") == home).agg(F.count("*").alias("n_occs"))
    # four one-row aggregates, folded into one row
    parts = one.unionByName(total, allowMissingColumns=True).unionByName(at_home, allowMissingColumns=True).unionByName(n_exons, allowMissingColumns=True)
    joined = parts.agg(*[F.max(c).alias(c) for c in ("n_exons_hit", "n_occs_hit", "n_links_hit", "n_links", "n_occs", "n_exons")])
    return joined.withColumn("sensitivity", F.col("n_exons_hit") / F.nullif("n_exons", F.lit(0))).withColumn("specificity", F.col("n_occs_hit") / F.nullif("n_occs", F.lit(0)))
