"""Continuous covered periods and the gaps between them, per entity.

Method: every interval becomes an event with a row-specific session length, and Spark's
session_window merges overlapping sessions natively. To keep a hot entity out of a single
task, sessions are formed per (entity, coordinate bin of the interval's start); a bin with more
than DENSE rows is halved until its parts hold about as many. The bins are
then stitched by running maxima over one summary row per bin, and touching periods and gaps
are derived with lag/lead inside the bin.

Shuffle volume: the raw rows move once, after equal intervals have been made one in each map
task (the aggregate's partial step); everything else is one row per entity and bin. A task
merges one bin of one entity at a time from a sorted, spillable stream, whatever the skew.

Defined results
* rows with a null entity column, a null bound, or end < start do not count;
* repeated rows and ties change nothing (a union of positions is formed);
* an entity without rows has no period; an empty table gives an empty result;
* columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import measured


#: Rows of one entity that a coordinate bin holds before it is divided.
DENSE = 1 << 22


def divided(rows: DataFrame, keys: list[str], width: int, dense: int) -> DataFrame:
    """Adds _bin, the begin of the row's bin: of the given width, or of a power of two less where rows lie densely.

    A narrow count finds the dense bins; there are at most rows / dense of them, so they are
    measured and broadcast.
    """
    coarse = rows.withColumn("_bin", F.floor(F.col("_s") / F.lit(width)).cast("bigint") * width)
    full = coarse.groupBy(*keys, "_bin").agg(F.count("*").alias("_n")).where(F.col("_n") > dense)
    parts = F.least(F.ceil(F.log2(F.col("_n") / dense)), F.lit(width.bit_length() - 1)).cast("int")
    full = full.select(*keys, "_bin", parts.alias("_halvings"))
    fine = F.floor((F.col("_s") - F.col("_bin")) / F.pow(F.lit(2.0), F.lit(width.bit_length() - 1) - F.col("_halvings")))
    begin = F.col("_bin") + (fine * F.pow(F.lit(2.0), F.lit(width.bit_length() - 1) - F.col("_halvings"))).cast("bigint")
    return coarse.join(measured(full), [*keys, "_bin"], "left").withColumn("_bin", F.when(F.col("_halvings").isNull(), F.col("_bin")).otherwise(begin)).drop("_halvings")


def periods_and_gaps(
    df: DataFrame, entity: list[str], start: str, end: str, bin_width: int = 1 << 20, dense: int = DENSE, from_name: str = "from_pos", to_name: str = "to_pos"
) -> DataFrame:
    """entity columns, kind ('period' or 'gap'), first and last position (both included).

    Positions are closed integers [start, end]. One position is one microsecond on the
    session axis; a session ends where its last position ends, so that touching intervals
    meet. bin_width, a power of two, bounds the number of disjoint periods one task can hold.
    """
    keys = [f"_k{i}" for i in range(len(entity))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(entity, keys)], F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"))
    usable: list[Column] = [F.col(k).isNotNull() for k in keys] + [F.col("_s").isNotNull(), F.col("_e") >= F.col("_s")]
    rows = divided(rows.where(reduce(lambda a, b: a & b, usable)), keys, bin_width, dense)
    # the join below would infer this on one side only, and the two sides would no longer share their exchange
    rows = rows.where(F.col("_bin").isNotNull())

    length = F.make_interval(secs=(F.col("_e") - F.col("_s") + 1).cast("decimal(18,0)") * F.expr("0.000001BD"))
    sessions = (
        rows.withColumn("_t", F.timestamp_micros("_s"))
        .groupBy(*keys, "_bin", F.session_window("_t", length).alias("_w"))
        .agg(F.max("_e").alias("_e"))
        .select(*keys, "_bin", F.unix_micros(F.col("_w.start")).alias("_s"), "_e")
    )

    of_bins = Window.partitionBy(*keys).orderBy("_bin")
    bins = (
        sessions.groupBy(*keys, "_bin")
        .agg(F.max("_e").alias("_bin_end"))
        .select(
            *keys,
            "_bin",
            F.max("_bin_end").over(of_bins.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
            F.max("_bin_end").over(Window.partitionBy(*keys)).alias("_all_end"),
        )
    )
    in_bin = Window.partitionBy(*keys, "_bin").orderBy("_s")
    heads = (
        sessions.join(bins, [*keys, "_bin"])
        .withColumn("_before", F.greatest("_carry", F.lag("_e").over(in_bin)))
        .where(F.col("_before").isNull() | (F.col("_s") > F.col("_before") + 1))
        .withColumn("_ends", F.lead("_before").over(in_bin))
    )

    def span(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    inside = heads.select(*keys, F.explode(F.array(span("gap", F.col("_before") + 1, F.col("_s") - 1), span("period", F.col("_s"), F.col("_ends")))).alias("x")).where(
        F.col("x.a").isNotNull() & F.col("x.b").isNotNull()
    )
    across = (
        heads.groupBy(*keys, "_bin")
        .agg(F.min_by("_before", "_s").alias("_first_before"), F.max("_s").alias("_last_head"), F.max("_all_end").alias("_all_end"))
        .withColumn("_ends", F.coalesce(F.lead("_first_before").over(of_bins), F.col("_all_end")))
        .select(*keys, span("period", F.col("_last_head"), F.col("_ends")).alias("x"))
    )
    return inside.unionByName(across).select(
        *[F.col(k).alias(c) for c, k in zip(entity, keys)], F.col("x.kind").alias("kind"), F.col("x.a").alias(from_name), F.col("x.b").alias(to_name)
    )
