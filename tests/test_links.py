import itertools
import random

from strandframe.operators import links as L

SCHEMA = "profile int, species string, seq_id int, pos int"


def occurrences(spark, counts):
    """counts: {profile: occurrences per species}"""
    return spark.createDataFrame([(p, f"s{k:03d}", k, i) for p, ns in counts.items() for k, n in enumerate(ns) for i in range(n)], SCHEMA)


def test_counts_do_not_overflow(spark):
    occ = occurrences(spark, {1: [10] * 24, 2: [3, 4], 3: [5], 4: [10] * 40})
    got = {r["profile"]: r for r in L.multilinks(occ).collect()}
    assert int(got[1]["n_links"]) == 10**24 and int(got[2]["n_links"]) == 12 and int(got[3]["n_links"]) == 5
    assert got[4]["n_links"] is None and abs(got[4]["log10_links"] - 40) < 1e-9
    out = {r["profile"]: (r["members"], r["skipped"]) for r in L.expand_links(occ, 100).where("skipped IS NOT NULL").collect()}
    assert out == {1: (None, 1000), 4: (None, 1000)}
    row = L.exon_hit_counts(occ.selectExpr("*", "struct(profile, seq_id, pos) AS occ_id"), spark.createDataFrame([(1, (1, 0, 0), 7)], "profile int, occ_id struct<profile:int,seq_id:int,pos:int>, exon_id int"), "s000", spark.createDataFrame([(3,)], "n_exons bigint")).first()
    assert int(row["n_links_hit"]) == 10**23 and row["n_links"] is None and row["n_occs"] == 10 + 3 + 5 + 10


def test_expansion_equals_the_product(spark):
    rng = random.Random(3)
    counts = {p: [rng.randrange(0, 4) for _ in range(rng.randrange(1, 5))] for p in range(40)}
    got = {}
    for r in L.expand_links(occurrences(spark, counts), 9).collect():
        got.setdefault(r["profile"], []).append(r["members"] if r["skipped"] is None else r["skipped"])
    want = {}
    for p, ns in counts.items():
        sets = [[f"s{k:03d}:{k}:{i}" for i in range(n)] for k, n in enumerate(ns) if n]
        links = ["|".join(x) for x in itertools.product(*sets)]
        if len(sets) > 1:
            size = 1
            for s in sets:
                size *= len(s)
                if size > 9:
                    break
            want[p] = sorted(links) if len(links) <= 9 else [size]
    assert {p: sorted(x) if isinstance(x[0], str) else x for p, x in got.items()} == want


def test_groups_filters_and_alignment(spark):
    occ = spark.createDataFrame([("g", 1, "a", 1, 0), ("g", 1, "a", 1, 4), ("g", 1, "b", 2, 0), ("g", 2, "a", 1, 1), ("h", 2, "b", 2, 3)], "grp string, " + SCHEMA)
    got = {r["grp"]: (r["n_profiles"], r["n_occs"], int(r["n_links"])) for r in L.links_of_groups(occ, "grp").collect()}
    assert got == {"g": (2, 4, 3), "h": (1, 1, 1)}
    assert {r["profile"] for r in L.with_species(occ.where("grp = 'g'"), ["a", "b"]).collect()} == {1}
    texts = spark.createDataFrame([(1, "a:c:1-9", "ACGTTACG"), (2, "b:c:1-5", "GGATC")], "seq_id int, sequence_id string, seq string")
    members = spark.createDataFrame([(7, "a", 1, 4, 0), (7, "b", 2, 1, 1)], "link int, species string, seq_id int, pos int, frame int")
    lines = [r["line"] for r in L.align(members, texts, 6).orderBy("line_no").collect()]
    assert lines == ["TACG - a:c:1-9 at 4:8", "GATC - b:c:1-5 at 1:5"]
    assert [r["line"][:3] for r in L.align(members, texts, 3, amino=True).orderBy("line_no").collect()] == ["Y -", "I -"]
    assert L.expand_links(occ.limit(0).drop("grp")).count() == 0 and L.multilinks(occ.limit(0)).count() == 0
