"""Summaries of runs: histograms, success curves, plateaus, grids, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, width: float, n_bins: int, low: float = 0.0) -> DataFrame:
    """bin, n, share for n_bins equal bins, empty ones included; nulls and NaN are skipped in n, share divides by all rows."""
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    counts = df.groupBy(F.when(ok, F.least(F.greatest(F.floor((F.col(value) - low) / width), F.lit(0)), F.lit(n_bins - 1)).cast("int")).alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    filled = counts.join(spine.withColumn("wanted", F.lit(True)), "bin", "full").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "wanted")
    # one row per bin: the total is formed over them
    return filled.select("bin", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), "wanted").where("wanted").drop("wanted")


def success_curve(scores: DataFrame, by: list[str], score: str, thresholds: list[int]) -> DataFrame:
    """Per group and threshold the percentage of rows that reach it (missing scores fail)."""
    shares = [F.struct(F.lit(t).alias("threshold"), (100 * F.avg(F.when(F.col(score) >= t, 1.0).otherwise(0.0))).alias("percent")) for t in thresholds]
    return scores.groupBy(*by).agg(F.array(*shares).alias("x")).select(*by, F.inline("x"))


def plateaus(history: DataFrame, run: str, order: list[str], best: str, loss: str, length: int, deviation: float) -> DataFrame:
    """Adds plateau: the last `length` rows share the best profile and their losses deviate little (population)."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(-(length - 1), 0)
    full = F.count("*").over(w) == length
    return history.withColumn("plateau", full & (F.min(best).over(w) == F.max(best).over(w)) & (F.stddev_pop(loss).over(w) <= deviation))


def learning_rates(history: DataFrame, run: str, order: list[str], loss: str, start: float, factor: float, patience: int) -> DataFrame:
    """Adds rate: it falls by `factor` at an epoch whose last `patience` losses are all no better than the one before them, and not again within `patience` epochs.

    Which epochs might bring a fall is a window; only these few per run are folded, in the JVM.
    """
    w = Window.partitionBy(run).orderBy(*order)
    rows = history.withColumn("_i", F.row_number().over(w) - 1)
    stuck = F.min(loss).over(w.rowsBetween(1 - patience, 0)) >= F.lag(loss, patience).over(w)
    rows = rows.withColumn("_stuck", F.coalesce(stuck, F.lit(False)))
    may = rows.where("_stuck").groupBy(run).agg(F.array_sort(F.collect_list("_i")).alias("_may"))
    none = F.array().cast("array<int>")
    falls = F.aggregate("_may", none, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.try_element_at(acc, F.lit(-1)) >= patience), F.concat(acc, F.array(x))).otherwise(acc))
    rows = rows.join(may.select(run, falls.alias("_falls")), run, "left")
    n = F.coalesce(F.size(F.filter("_falls", lambda x: x <= F.col("_i"))), F.lit(0))
    return rows.withColumn("rate", start * F.pow(F.lit(factor), n)).drop("_i", "_stuck", "_falls")


def grid(spark: SparkSession, parameters: dict[str, list]) -> DataFrame:
    """All combinations of a few short parameter lists, exploded one after the other from one row."""
    out = spark.range(1).select()
    for name, values in parameters.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def isolated_grid(spark: SparkSession, parameters: dict[str, list]) -> DataFrame:
    """One parameter varied at a time, the others at their first value; repeats once."""
    first = {k: v[0] for k, v in parameters.items()}
    rows = {tuple({**first, k: x}.values()) for k, v in parameters.items() for x in v}
    return spark.createDataFrame(sorted(rows), list(parameters))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0).cast("bigint"))


def leaderboard(runs: DataFrame, by: list[str]) -> DataFrame:
    """Micro-averaged sensitivity and specificity, their harmonic mean, link specificity and mean runtime per group."""
    s = runs.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("exons_hit", "exons", "occs", "occs_hit", "links", "links_hit")], F.count("*").alias("n"), F.avg("runtime").alias("runtime"))
    sn, sp = ratio(F.col("exons_hit"), F.col("exons")), ratio(F.col("occs_hit"), F.col("occs"))
    return s.select(*by, "n", sn.alias("sensitivity"), sp.alias("specificity"), (2 * sn * sp / F.nullif(sn + sp, F.lit(0.0))).alias("harmonic"), ratio(F.col("links_hit"), F.col("links")).alias("link_specificity"), "runtime")
