"""Mixing sources to target weights by capped Poisson replication.

Method: each document gets a seeded hash as a uniform number u; its count is the inverse of a
Poisson distribution at u, whose mean is its source's repetition rate, capped at the source's
max_repeats. Documents are exploded by their counts and shuffled globally by a second hash.

The rate of a source is set so that its size comes to target_share of the total. It starts at
the rate whose capped mean gives the target and is then calibrated on the documents' own hashes:
one pass evaluates the size at every rate of a grid (counts grow with the rate, so sizes do), a
second refines between its neighbours. A source whose target exceeds max_repeats times its size
is too small: it is used max_repeats times in full, and its reached share is reported.

Only one row per source ever reaches the driver; sources are those of the target table, whose
size is checked against MAX_SOURCES. Sizes are counted once and cut off by a checkpoint in the
shared folder, so a lost executor costs no new encoding. All per-source work is a map-side
combined sum: a hot source is never gathered in one task.

Defined results: documents of unlisted or null sources take no part; null and empty texts have
size 0 and are never used; rows repeated under the same id count once; a source without sizeable
documents reaches 0; null or non-positive shares and repeats count as 0; an empty table gives an
empty mix. The total defaults to the size of all documents of listed sources.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm.tokens import TOKENIZERS, count_tokens
from strandframe.session import shared_checkpoint

MAX_SOURCES = 10_000
GRID = 24


def _terms(rate: float, cap: int) -> Iterator[float]:
    """Poisson probabilities of 0..cap-1; by logarithms where exp(-rate) would vanish."""
    if rate > 700:
        for k in range(cap):
            yield math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        return
    term = math.exp(-rate)
    for k in range(cap):
        yield term
        term *= rate / (k + 1)


def capped_mean(rate: float, cap: int) -> float:
    """Mean of min(Poisson(rate), cap)."""
    below, mean = 0.0, 0.0
    for term in _terms(rate, cap):
        below += term
        mean += 1 - below
    return mean


def rate_for_mean(mean: float, cap: int) -> float:
    """The rate whose capped mean is `mean`, by bisection; infinity where the cap is needed in full."""
    if mean <= 0 or cap <= 0:
        return 0.0
    if mean >= cap:
        return math.inf
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < mean:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < mean else (low, mid)
    return (low + high) / 2


def steps(rate: float, cap: int) -> list[float]:
    """Distribution function at 0..cap-1: a uniform u at or above the k-th step has a count above k."""
    if math.isinf(rate):
        return [0.0] * cap
    below, out = 0.0, []
    for term in _terms(rate, cap):
        below += term
        out.append(min(below, 1.0))
    return out


def _uniform(id_col: str, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


def sized_documents(docs: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source, n_tokens of the documents of listed sources, each id once."""
    if targets.select("source").distinct().count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    listed = docs.join(F.broadcast(targets.select("source").where(F.col("source").isNotNull()).distinct()), "source", "left_semi")
    sizes = count_tokens(listed, {"doc_id": "bigint", "source": "string"}, tokenizer=tokenizer, folder=folder)
    return shared_checkpoint(sizes.where((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min_by("source", F.struct("n_tokens", "source")).alias("source"), F.min("n_tokens").alias("n_tokens")))


def _reached(sized: DataFrame, trial: dict[str, list[float]], caps: dict[str, int], seed: int) -> dict[str, list[int]]:
    """Size of each source at each of its trial rates, in one pass with map-side sums."""
    spark = sized.sparkSession
    rows = [(s, [steps(r, caps[s]) for r in rates]) for s, rates in trial.items()]
    table = F.broadcast(spark.createDataFrame(rows, "source string, grid array<array<double>>"))
    counted = sized.join(table, "source").withColumn("_u", _uniform("doc_id", seed))
    n = max(len(r) for r in trial.values())
    sums = [F.sum(F.col("n_tokens") * F.size(F.filter(F.col("grid")[i], lambda c: F.col("_u") >= c))).alias(f"s{i}") for i in range(n)]
    return {r[0]: list(r[1:]) for r in counted.groupBy("source").agg(*sums).collect()}


def plan_mix(sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, meet_shares: bool = False) -> list[dict]:
    """One record per source: its rate, its cap and whether it is too small for its share.

    With meet_shares the total is lowered until no source with documents is too small.
    """
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).where(F.col("source").isNotNull())
    rows = wanted.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    have = {r["source"]: int(r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    total = sum(have.values()) if total is None else total
    wanted = [(r["source"], max(r["share"] or 0.0, 0.0), max(r["cap"] or 0, 0), have.get(r["source"], 0)) for r in rows]
    if meet_shares:
        total = min([total, *(cap * n / share for _, share, cap, n in wanted if share > 0 and n > 0)])
    plan = []
    for source, share, cap, n in wanted:
        goal = share * total
        if meet_shares and n and cap:
            goal = min(goal, cap * n)  # the source that sets the total needs its cap in full, whatever the rounding
        plan.append({"source": source, "share": share, "cap": cap, "size": n, "goal": goal, "rate": rate_for_mean(goal / n, cap) if n else 0.0, "too_small": share > 0 and share * total > cap * n * (1 + 1e-9)})
    open_ = {p["source"]: p for p in plan if 0 < p["rate"] < math.inf}
    width = 0.5
    for _ in range(3):
        if not open_:
            break
        trial = {s: [p["rate"] * (1 + width * (2 * i / (GRID - 1) - 1)) for i in range(GRID)] for s, p in open_.items()}
        got = _reached(sized, trial, {s: p["cap"] for s, p in open_.items()}, seed)
        for s, p in open_.items():
            p["rate"] = min(zip(trial[s], got.get(s, [0] * GRID)), key=lambda x: abs(x[1] - p["goal"]))[0]
        width /= GRID / 3
    return plan


def mix(sized: DataFrame, plan: list[dict], seed: int = 7) -> DataFrame:
    """doc_id, source, copy_no, n_tokens in a globally shuffled order (mix_order)."""
    spark = sized.sparkSession
    table = spark.createDataFrame([(p["source"], steps(p["rate"], p["cap"])) for p in plan if p["rate"] > 0 and p["cap"] > 0], "source string, steps array<double>")
    counted = sized.join(F.broadcast(table), "source").withColumn("_u", _uniform("doc_id", seed)).withColumn("_n", F.size(F.filter("steps", lambda c: F.col("_u") >= c)))
    copies = counted.where(F.col("_n") > 0).select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("copy_no"), "n_tokens")
    return copies.withColumn("mix_order", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1))).repartitionByRange(F.col("mix_order")).sortWithinPartitions("mix_order")


def shares(sized: DataFrame, plan: list[dict], seed: int = 7) -> DataFrame:
    """Per source: target and reached share, sizes, rate and whether it was too small (one without documents always is)."""
    spark = sized.sparkSession
    facts = spark.createDataFrame(
        [(p["source"], p["share"], p["cap"], p["size"], None if math.isinf(p["rate"]) else p["rate"], p["too_small"]) for p in plan],
        "source string, target_share double, max_repeats int, available_tokens bigint, rate double, too_small boolean",
    )
    got = mix(sized, plan, seed).groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"), (F.max("copy_no") + 1).alias("m"))
    filled = facts.join(got, "source", "left").fillna(0, ["t", "c", "m"])
    total = F.sum("t").over(Window.partitionBy())  # one row per source
    return filled.select(
        "source", "target_share", (F.col("t") / F.when(total > 0, total)).alias("reached_share"), F.col("t").alias("reached_tokens"), F.col("c").alias("n_copies"), F.col("m").cast("int").alias("most_repeats"),
        "max_repeats", "available_tokens", (F.col("t") / F.lit(float(sum(p["size"] for p in plan) or 1))).alias("share_of_goal"), "rate", "too_small",
    )
