import math

import pytest

from strandframe.llm import mix

DOCS = "doc_id bigint, text string, source string, n_tokens string"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark):
    rows = [(i, f"word{i} " * (1 + i % 40), "hot", "x") for i in range(1500)] + [(10_000 + i, "some text here " * (1 + i % 9), "mid", "x") for i in range(600)] + [(20_000 + i, "tiny text", "tiny", "x") for i in range(4)]
    rows += [(30_000, None, "hot", "x"), (30_001, "", "mid", "x"), (30_002, "no source", None, "x"), (30_003, "other", "unlisted", "x"), (None, "no id", "hot", "x"), rows[0], rows[1600]]
    return spark.createDataFrame(rows, DOCS)


def test_shares_caps_and_order(spark):
    targets = spark.createDataFrame([("hot", 0.5, 1), ("mid", 0.3, 4), ("tiny", 0.1, 5), ("absent", 0.1, 2), (None, 0.0, 1)], TARGETS)
    sized = mix.sized_documents(corpus(spark), targets)
    total = sized.agg({"n_tokens": "sum"}).first()[0]
    plan = mix.plan_mix(sized, targets, total=total // 2)
    out = mix.mix(sized, plan).collect()
    assert len({(r["doc_id"], r["copy_no"]) for r in out}) == len(out)
    size, most = {}, {}
    for r in out:
        size[r["source"]] = size.get(r["source"], 0) + r["n_tokens"]
        most[r["source"]] = max(most.get(r["source"], 0), r["copy_no"] + 1)
    assert abs(size["hot"] / (0.5 * (total // 2)) - 1) < 0.02 and abs(size["mid"] / (0.3 * (total // 2)) - 1) < 0.02
    assert most["hot"] == 1 and most["mid"] <= 4 and most["tiny"] == 5
    assert size["tiny"] == 5 * sized.where("source = 'tiny'").agg({"n_tokens": "sum"}).first()[0]
    report = {r["source"]: r for r in mix.shares(sized, plan).collect()}
    assert report["tiny"]["too_small"] and report["absent"]["too_small"] and not report["hot"]["too_small"] and report["absent"]["reached_tokens"] == 0
    assert math.isclose(sum(r["reached_share"] for r in report.values()), 1.0)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mix.mix(sized, plan).collect()))


def test_total_lowered_until_shares_are_met(spark):
    targets = spark.createDataFrame([("hot", 0.6, 2), ("mid", 0.3, 4), ("tiny", 0.002, 50), ("absent", 0.098, 2)], TARGETS)
    sized = mix.sized_documents(corpus(spark), targets)
    plan = mix.plan_mix(sized, targets, meet_shares=True)
    report = {r["source"]: r for r in mix.shares(sized, plan).collect()}
    assert not any(report[s]["too_small"] for s in ("hot", "mid", "tiny")) and report["absent"]["too_small"]
    for s in ("hot", "mid", "tiny"):  # what the absent source leaves over is shared in proportion
        assert abs(report[s]["reached_share"] / (report[s]["target_share"] / 0.902) - 1) < 0.05
    assert all(r["most_repeats"] <= r["max_repeats"] for r in report.values())


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    sized = mix.sized_documents(corpus(spark).limit(0), targets)
    plan = mix.plan_mix(sized, targets)
    assert mix.mix(sized, plan).count() == 0
    assert [r["reached_tokens"] for r in mix.shares(sized, plan).collect()] == [0]


@pytest.mark.parametrize("cap", [1, 3, 8])
def test_inversion(cap):
    for mean in (0.1, 0.5 * cap, 0.95 * cap):
        rate = mix.rate_for_mean(mean, cap)
        assert math.isclose(mix.capped_mean(rate, cap), mean, rel_tol=1e-6)
        n = 20_000
        assert abs(sum(sum((i + 0.5) / n >= s for s in mix.steps(rate, cap)) for i in range(n)) / n - mean) < 1e-3
    assert mix.rate_for_mean(cap, cap) == math.inf and mix.rate_for_mean(0, cap) == 0


def test_large_means_keep_a_finite_rate():
    for mean, cap in [(600, 5000), (4000, 5000), (990, 1000)]:
        rate = mix.rate_for_mean(mean, cap)
        assert rate < float("inf") and abs(mix.capped_mean(rate, cap) - mean) < 1e-3
        assert abs(sum(1 - x for x in mix.steps(rate, cap)) - mean) < 1e-3
