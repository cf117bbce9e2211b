import random

from strandframe.operators.periods import periods_and_gaps

SCHEMA = "gtf_file string, seqname string, strand string, start_pos bigint, end_pos bigint, kind string, _s bigint, from_pos string"


def brute(rows):
    out = set()
    for key in {r[:3] for r in rows}:
        spans = sorted(r[3:5] for r in rows if r[:3] == key)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(*key, "period", a, b) for a, b in merged}
        out |= {(*key, "gap", x[1] + 1, y[0] - 1) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows, width, **more):
    data = [(*r[:5], "x", 0, "y") for r in rows]
    df = spark.createDataFrame(data, SCHEMA)
    got = [tuple(r) for r in periods_and_gaps(df, ["gtf_file", "seqname", "strand"], "start_pos", "end_pos", bin_width=width, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_against_brute_force(spark):
    rng = random.Random(5)
    for width in (8, 50, 1 << 20):
        rows = []
        for _ in range(300):
            s = rng.randrange(-20, 400)
            rows.append((rng.choice("ab"), rng.choice(["c1", "c2"]), "+", s, s + int(rng.expovariate(0.2)) + (300 if rng.random() < 0.01 else 0)))
        rows += rows[:20]
        assert run(spark, rows, width) == brute(rows)


def test_dense_bins_are_divided(spark):
    rng = random.Random(6)
    rows = [("a", "c", "+", s, s + rng.randrange(4)) for s in (rng.choice([rng.randrange(64), rng.randrange(10_000)]) for _ in range(800))]
    for dense in (1, 7, 60):
        assert run(spark, rows, 256, dense=dense) == brute(rows)


def test_touching_nested_and_long_over_many_bins(spark):
    rows = [("f", "c", "+", 1, 1000), ("f", "c", "+", 5, 6), ("f", "c", "+", 990, 995), ("f", "c", "+", 1001, 1001), ("f", "c", "+", 1003, 1003), ("f", "c", "-", 7, 7)]
    assert run(spark, rows, 10) == {("f", "c", "+", "period", 1, 1001), ("f", "c", "+", "gap", 1002, 1002), ("f", "c", "+", "period", 1003, 1003), ("f", "c", "-", "period", 7, 7)}


def test_nulls_wrong_order_and_empty(spark):
    rows = [("f", "c", "+", 5, 4), ("f", None, "+", 1, 2), (None, "c", "+", 1, 2), ("f", "c", None, 1, 2), ("f", "c", "+", None, 2), ("f", "c", "+", 1, None)]
    assert run(spark, rows, 10) == set()
    assert run(spark, [], 10) == set()
