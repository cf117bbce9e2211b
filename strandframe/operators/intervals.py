"""Interval joins and filters over 0-based half-open intervals.

Range conditions are turned into equi-joins on coordinate bins, so the planner hashes on
(keys, bin) and a hot chromosome spreads over its bins. Intervals are told apart by length into
LEVELS classes, and each pair of classes is joined on bins as wide as the longer one, so an
interval is copied into two bins at most for each class of the other side, however long it is;
only classes that occur are joined. A pair that shares two bins is reported in the first of them
only, so nothing has to be made distinct afterwards. Within a dense bin the planner splits the
task (adaptive skew join). Rows with null keys or bounds pair with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Classes of length, each 64 times as wide as the one before.
LEVELS = 4


def _level(s: Column, e: Column, width: int) -> Column:
    """Class of an interval: the first whose bins are at least as wide as it is long."""
    out = F.lit(LEVELS - 1)
    for i in range(LEVELS - 2, -1, -1):
        out = F.when(e - s <= (width << (6 * i)), i).otherwise(out)
    return out


def _bins(s: Column, e: Column, width: Column) -> Column:
    return F.sequence(F.floor(s / width).cast("bigint"), F.floor(F.greatest(e - 1, s) / width).cast("bigint"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = 1 << 14, contained: bool = False) -> DataFrame:
    """Pairs of rows that overlap (or: right inside left); both have columns s and e, right's come as s2 and e2.

    Columns of the right side must otherwise have other names than the left's.
    """
    a = left.withColumn("_a", _level(F.col("s"), F.col("e"), width))
    b = right.withColumnsRenamed({"s": "s2", "e": "e2"}).withColumn("_b", _level(F.col("s2"), F.col("e2"), width))
    # at most LEVELS rows each
    in_a, in_b = (sorted(r[0] for r in x.select(c).distinct().collect() if r[0] is not None) or [0] for x, c in ((a, "_a"), (b, "_b")))
    wide = F.element_at(F.array(*[F.lit(width << (6 * i)).cast("bigint") for i in range(LEVELS)]), F.greatest("_a", "_b") + 1)
    a = a.withColumn("_b", F.explode(F.array(*[F.lit(x) for x in in_b]))).withColumn("_bin", F.explode(_bins(F.col("s"), F.col("e"), wide)))
    b = b.withColumn("_a", F.explode(F.array(*[F.lit(x) for x in in_a]))).withColumn("_bin", F.explode(_bins(F.col("s2"), F.col("e2"), wide)))
    pairs = a.join(b, [*keys, "_a", "_b", "_bin"])
    meets = (F.col("s") <= F.col("s2")) & (F.col("e2") <= F.col("e")) if contained else (F.col("s2") < F.col("e")) & (F.col("e2") > F.col("s"))
    first = F.col("_bin") == F.floor(F.greatest("s", "s2") / wide)
    return pairs.where(meets & first).drop("_bin", "_a", "_b")


def with_reach_before(df: DataFrame, keys: list[str], order: list[Column], width: int = 1 << 20) -> DataFrame:
    """Adds reach_before: the greatest e among rows of the same keys that come earlier by (s, order).

    The running maximum is taken inside coordinate bins of s and completed by one summary row
    per bin, so no task holds a whole key.
    """
    rows = df.withColumn("_bin", F.floor(F.col("s") / width).cast("bigint"))
    of_bins = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, "_bin").agg(F.max("e").alias("_top")).select(*keys, "_bin", F.max("_top").over(of_bins).alias("_carry"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("s", *order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(carry, [*keys, "_bin"]).withColumn("reach_before", F.greatest("_carry", F.max("e").over(inside))).drop("_bin", "_carry")


def drop_contained(df: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Rows that lie inside no longer row of the same keys; of equal ones the first by `tie` stays."""
    return with_reach_before(df, keys, [F.desc("e"), F.col(tie)]).where(F.col("reach_before").isNull() | (F.col("reach_before") < F.col("e"))).drop("reach_before")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order (a map-side combined min_by over structs)."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_x")).select(*keys, "_x.*")


def relative(parent_s: Column, parent_e: Column, s: Column, e: Column, rc: bool = False) -> tuple[Column, Column]:
    """Place of [s, e) within a parent, counted from its other end for the reverse strand; may be negative."""
    return (parent_e - e, parent_e - s) if rc else (s - parent_s, e - parent_s)
