import bisect
import random

from strandframe.llm import split

SCHEMA = "tileable_id bigint, seq string, alphabet string, tile_size int, tile_overlap int, cut string, id int"


def kind(c, amino):
    return 1 if c in ("Xx " if amino else "Nn") else 2 if "a" <= c <= "z" else 0


def borders(seq, amino):
    return [i for i in range(1, len(seq)) if kind(seq[i - 1], amino) != kind(seq[i], amino) or (amino and seq[i - 1] == "*")]


def brute(seq, amino, size, overlap):
    """Reachability over all borders, without taking the farthest."""
    overlap, n, inner = max(overlap or 0, 0), len(seq), borders(seq, amino)
    reach = {x for x in [*inner, n] if x <= size}
    for x in [*inner, n]:
        for p in inner[bisect.bisect_left(inner, max(overlap, x - size + overlap)) : bisect.bisect_left(inner, x)]:
            if p in reach:
                reach.add(x)
    return "natural" if n in reach else "forced"


def cases():
    rng = random.Random(2)
    for _ in range(600):
        amino = rng.random() < 0.5
        letters = "".join(rng.choice(["A", "C", "a", "g", "X" if amino else "N", "*", "é", "𝄞"]) * rng.randrange(1, 5) for _ in range(rng.randrange(25)))
        yield letters, "aa" if amino else "dna", rng.choice([1, 2, 3, 5, 8, 13]), rng.choice([0, 0, 1, 2, 4, None, -1])


def test_cut_kinds(spark):
    rows = [(i, *c, "clash", 3) for i, c in enumerate(cases())] + [(9001, None, "dna", 3, 0, "", 0), (9002, "", "dna", 3, 0, "", 0), (9003, "ACGT", "dna", None, 0, "", 0), (9004, "ACGT", "dna", -2, 0, "", 0), (9005, "ACGT", None, 3, None, "", 0)]
    got = {r["tileable_id"]: r["cut"] for r in split.cut_kinds(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {r[0]: brute(r[1], r[2] == "aa", r[3], r[4]) for r in rows if r[1] and r[3] and r[3] > 0 and len(r[1]) > r[3]}
    assert got == want


def test_pieces_hold_their_promises(spark):
    rows = [(i, *c, "clash", 3) for i, c in enumerate(cases())] + [(9003, "ACGT", "dna", None, 0, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out: dict = {}
    for r in split.pieces(df).collect():
        out.setdefault(r["tileable_id"], []).append(r)
    for i, seq, alphabet, size, overlap, *_ in rows:
        if not seq:
            assert i not in out
            continue
        got = sorted(out[i], key=lambda r: r["piece_no"])
        assert [r["piece_no"] for r in got] == list(range(len(got)))
        assert got[0]["piece_start"] == 0 and got[-1]["piece_end"] == len(seq)
        limit = size or len(seq)
        shared = min(max(overlap or 0, 0), limit - 1)
        inner = set(borders(seq, alphabet == "aa"))
        for r in got:
            assert r["piece"] == seq[r["piece_start"] : r["piece_end"]] and len(r["piece"]) <= limit
            if r is not got[-1]:
                assert r["natural_end"] == (r["piece_end"] in inner)
        for a, b in zip(got, got[1:]):
            assert b["piece_start"] == a["piece_end"] - shared and b["piece_end"] > a["piece_end"]


def test_very_long_and_empty(spark):
    df = spark.createDataFrame([(1, "ACGTn" * 1_000_000, "dna", 334, 30, "", 0)], SCHEMA)
    assert [r["cut"] for r in split.cut_kinds(df).collect()] == ["natural"]
    assert split.cut_kinds(df.limit(0)).count() == 0 and split.pieces(df.limit(0)).count() == 0


def packed(spark, *rows):
    df = spark.createDataFrame([(i, *r, "", 0) for i, r in enumerate(rows)], SCHEMA)
    out = {}
    for r in split.pieces(df).orderBy("tileable_id", "piece_no").collect():
        out.setdefault(r["tileable_id"], []).append(r["piece"])
    return [out[i] for i in range(len(rows))]


def test_whole_runs_before_stops(spark):
    # the second run fits a piece of its own, so it is not cut at its stop to fill the room left
    assert packed(spark, ("XXXXXMMM*MM", "aa", 10, 0)) == [["XXXXX", "MMM*MM"]]
    # an oversized run is opened: its stretches fill the room left, and what remains joins the next sibling
    assert packed(spark, ("XXXXXMMM*MMMMM*MM*xx", "aa", 10, 0)) == [["XXXXXMMM*", "MMMMM*MM*", "xx"]]
    assert packed(spark, ("XXXXXMMM*MMMM*MM*xx", "aa", 10, 0)) == [["XXXXXMMM*", "MMMM*MM*xx"]]
    # siblings merge up to the limit, overlap included; only a stretch beyond it is cut between letters
    assert packed(spark, ("AAnnAAnnAA", "dna", 6, 2), ("AAAAAAAAnn", "dna", 4, 1)) == [["AAnnAA", "AAnnAA"], ["AAAA", "AAAA", "AAnn"]]


def test_one_very_long_text_with_small_pieces(spark):
    n = 2_000_000
    df = spark.createDataFrame([(1, "ACGTN" * (n // 5), "dna", 1000, 10, "", 0)], SCHEMA)
    got = split.pieces(df).selectExpr("count(*) AS c", "sum(length(piece)) AS s", "max(piece_end) AS e", "max(length(piece)) AS m").first()
    assert got["e"] == n and got["m"] <= 1000 and got["s"] == n + 10 * (got["c"] - 1)
