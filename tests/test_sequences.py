import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.functions import seq as S
from strandframe.operators import intervals as I
from strandframe.operators import kmers as K
from strandframe.operators import profiles as P
from strandframe.operators import trees as T
from strandframe.sources import formats


def test_translation_examples(spark):
    df = spark.createDataFrame([("",), ("AC",), ("ACG",), ("ACGTA",), ("ACGTAC",), ("ATG",), ("ATGAA",), ("ATGANN",), (None,)], "seq string")
    got = {r[0]: (r[1], r[2], r[3]) for r in df.select("seq", S.translate_frame(F.col("seq")), S.translate_frame(S.reverse_complement(F.col("seq"))), S.six_frames(F.col("seq"))).collect()}
    assert got[""][:2] == ("", "") and got["AC"][0] == "" and got["ACG"][:2] == ("T", "R") and got["ACGTA"][1] == "Y" and got["ACGTAC"][:2] == ("TY", "VR")
    assert got["ATG"][2] == ["M", "", "", "H", "", ""] and got["ATGAA"][2] == ["M", "*", "E", "F", "S", "H"] and got["ATGANN"][2] == ["M ", "*", " ", " H", " ", "S"]
    assert got[None][0] is None


def test_reverse_complement_is_its_own_inverse(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("".join(rng.choice("ACGTacgtN") for _ in range(rng.randrange(60))),) for _ in range(200)], "s string")
    assert df.where(S.reverse_complement(S.reverse_complement(F.col("s"))) != F.col("s")).count() == 0


def test_sites_turn_back_to_their_text(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("ACGT") for _ in range(rng.randrange(40, 90))), f, rng.randrange(8)) for f in range(6) for _ in range(40)]
    df = spark.createDataFrame(rows, "seq string, f int, raw int").withColumn("n", F.length("seq"))
    at = S.amino_site_on_dna(F.col("n"), F.col("f"), F.col("raw"), F.lit(4))
    df = df.select("*", *[c.alias(k) for k, c in at.items()])
    part = F.substring(F.col("seq"), F.col("position").cast("int") + 1, F.col("site_len").cast("int"))
    amino = S.translate_frame(F.when(F.col("strand") == "+", part).otherwise(S.reverse_complement(part)))
    frame = F.element_at(S.six_frames(F.col("seq")), F.col("f") + 1)
    assert df.where(amino != F.substring(frame, F.col("raw") + 1, F.lit(4))).count() == 0


def test_interval_truth_table(spark):
    parent = spark.createDataFrame([("c", 42, 66)], "k string, s bigint, e bigint")
    kids = spark.createDataFrame([("before", "c", 0, 42), ("left", "c", 0, 43), ("inside", "c", 43, 65), ("both", "c", 41, 67), ("right", "c", 65, 420), ("after", "c", 66, 420), ("other", "d", 42, 66), ("null", None, 42, 66)], "name string, k string, s bigint, e bigint")
    pairs = I.overlap_join(parent, kids, ["k"], width=8)
    a, b = I.relative(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")), I.relative(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"), rc=True)
    got = {r[0]: tuple(r[1:]) for r in pairs.select("name", *a, *b).collect()}
    assert got == {"left": (-42, 1, 23, 66), "inside": (1, 23, 1, 23), "both": (-1, 25, -1, 25), "right": (23, 378, -354, 1)}
    assert pairs.count() == 4
    assert [r["name"] for r in I.overlap_join(parent, kids, ["k"], width=8, contained=True).collect()] == ["inside"]


def test_overlaps_of_all_lengths(spark):
    rng = random.Random(12)
    sides = []
    for n in (120, 150):
        rows = []
        for i in range(n):
            s = rng.randrange(-50, 40_000)
            rows.append((i, rng.choice("cd"), s, s + rng.choice([0, 1, 5, 60, 700, 20_000, 10**9])))
        sides.append(rows)
    a = spark.createDataFrame(sides[0], "i int, k string, s bigint, e bigint")
    b = spark.createDataFrame(sides[1], "j int, k string, s bigint, e bigint")
    pairs = [(r["i"], r["j"]) for r in I.overlap_join(a, b, ["k"], width=4).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(x[0], y[0]) for x in sides[0] for y in sides[1] if x[1] == y[1] and y[2] < x[3] and y[3] > x[2]}
    inside = {(r["i"], r["j"]) for r in I.overlap_join(a, b, ["k"], width=4, contained=True).collect()}
    assert inside == {(x[0], y[0]) for x in sides[0] for y in sides[1] if x[1] == y[1] and x[2] <= y[2] and y[3] <= x[3]}


def test_containment_over_bins(spark):
    rng = random.Random(3)
    rows = [(i, "c", s, s + rng.randrange(1, 120)) for i in range(300) for s in [rng.randrange(0, 2000)]]
    df = spark.createDataFrame(rows, "id int, k string, s bigint, e bigint")
    got = {r["id"] for r in I.with_reach_before(df, ["k"], [F.desc("e"), F.col("id")], width=64).where("reach_before IS NULL OR reach_before < e").collect()}
    want = {i for i, _, s, e in rows if not any(j != i and a <= s and b >= e and (b - a > e - s or j < i) for j, _, a, b in rows)}
    assert got == want


def test_tiles_join_to_the_text(spark):
    df = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "AC"), (3, "")], "id int, seq string")
    for reverse in (False, True):
        rows = K.tiles(df, "id", "seq", 4, reverse).orderBy("id", "tile_start").collect()
        assert "".join(r["tile"] for r in rows if r["id"] == 1) == "ACGTACGTAC"
        assert all(len(r["tile"]) <= 4 for r in rows) and {r["id"] for r in rows} == {1, 2}


def greedy_by_loop(texts, k, tile):
    """The scan as it is told, one window after the other."""
    counts, marked = {}, set()
    for *text, seq in sorted(texts):
        for i in range(len(seq) - k + 1):
            word, at = seq[i : i + k], (*text, i // tile)
            if set(word) <= set("ACGT") and (word in counts or at not in marked):
                counts[word] = counts.get(word, 0) + 1
                marked.add(at)
    return counts


@pytest.mark.parametrize("seed, k, tile", [(1, 3, 2), (2, 2, 5), (3, 4, 3), (4, 3, 6), (5, 1, 4)])
def test_greedy_index_equals_the_loop(spark, seed, k, tile):
    rng = random.Random(seed)
    texts = [(g, s, f, "".join(rng.choice("ACGTACGTACGTaN") for _ in range(rng.randrange(70)))) for g in "ab" for s in range(25) for f in (0, 1)]
    rows = K.kmer_rows(spark.createDataFrame(texts, "g string, s int, f int, t string"), ["g", "s", "f"], "t", k)
    counts = K.greedy_index(rows, ["g", "s", "f", "pos"], tile)
    assert {r["kmer"]: r["n"] for r in counts.collect()} == greedy_by_loop(texts, k, tile)
    want = sorted(greedy_by_loop(texts, k, tile).values(), reverse=True)
    exact = [r["n"] for r in K.select_kmers(counts, max_u=7, enforce_u=True).orderBy("place").collect()]
    assert exact == want[:7]
    ties = [r["n"] for r in K.select_kmers(counts, max_u=50, min_occ=10**6, min_u=3).orderBy("place").collect()]
    assert ties == [n for n in want if n >= want[min(2, len(want) - 1)]][:50]


def test_random_kmers_follow_the_background(spark):
    rows = K.random_kmers(spark, 400, 12, {"A": 6.0, "C": 2.0, "G": 2.0, "T": 0.0}, 5)
    got = [r["kmer"] for r in rows.orderBy("place").collect()]
    assert got == [r["kmer"] for r in rows.orderBy("place").collect()] and len(got) == 400 and all(len(x) == 12 for x in got)
    text = "".join(got)
    assert abs(text.count("A") / len(text) - 0.6) < 0.03 and "T" not in text


def test_letter_kernels(spark):
    from strandframe.operators import letters as A

    rng = random.Random(9)
    seqs = ["", "A", "ACG", "é", "ACGTé𝄞ACGTNacgtACGATT"] + ["".join(rng.choice("ACGTACGTNacé") for _ in range(rng.randrange(50))) for _ in range(60)]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(seqs)] + [(999, None, "x")], "id int, seq string, residues string")
    frames = {r["id"]: r["residues"] for r in A.translations(df, ["id"], "seq", [0, 1, 2, 3, 4, 5]).collect()}
    assert frames == {r["id"]: r["t"] for r in df.where("seq IS NOT NULL").select("id", S.six_frames(F.col("seq")).alias("t")).collect()}
    words = {(r["id"], r["pos"], r["kmer"]) for r in A.kmer_rows(df, ["id"], "seq", 3).collect()}
    assert words == {(i, p, s[p : p + 3]) for i, s in enumerate(seqs) for p in range(len(s) - 2) if set(s[p : p + 3]) <= set("ACGT")}
    hot = {(r["id"], r["pos"], r["letter_idx"]) for r in A.one_hot(df, ["id"], "seq", "ACGT").collect()}
    assert hot == {(i, p, "ACGT".index(c)) for i, s in enumerate(seqs) for p, c in enumerate(s) if c in "ACGT"}
    for reverse in (False, True):
        cut = {(r["id"], r["tile_ord"], r["tile_start"], r["tile"]) for r in A.tiles(df, ["id"], "seq", 7, reverse).collect()}
        want = set()
        for i, s in enumerate(seqs):
            for k in range(-(-len(s) // 7)):
                a, b = (max(len(s) - 7 * (k + 1), 0), len(s) - 7 * k) if reverse else (7 * k, min(7 * k + 7, len(s)))
                want.add((i, k, a, s[a:b]))
        assert cut == want


def test_tiles_are_linear_in_long_texts(spark):
    df = spark.createDataFrame([(1, "ACGTacgtNN" * 200_000)], "id int, seq string")
    got = K.tiles(df, "id", "seq", 334).selectExpr("count(*) AS c", "sum(length(tile)) AS n").first()
    assert (got["c"], got["n"]) == (-(-2_000_000 // 334), 2_000_000)


def test_running_total(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, v bigint")
    got = {r["i"]: r["before"] for r in K.running_total(df, ["g"], ["i"], "v").collect()}
    assert got == {i: sum(v for g2, j, v in rows if g2 == g and j < i) for g, i, _ in rows}


def test_kernel_against_loops():
    rng = np.random.default_rng(0)
    codes, cube = rng.integers(0, 5, 60), rng.normal(size=(3, 7, 4))
    z = P.window_scores(codes, cube)
    for p in range(3):
        for s in range(54):
            assert abs(z[p, s] - sum(cube[p, j, codes[s + j]] for j in range(7) if codes[s + j] < 4)) < 1e-4


def test_scores_and_sites(spark):
    rng = random.Random(5)
    rows = [(i, "g" + str(i % 2), "".join(rng.choice("ACGTa") for _ in range(n))) for i, n in enumerate([0, 3, 80, 400])]
    df = spark.createDataFrame(rows, "id bigint, g string, t string")
    cube = np.random.default_rng(2).normal(size=(4, 6, 4))
    ids = np.array([3, 5, 8, 9])
    best = {(r["id"], r["profile_idx"]): (r["score"], r["start"]) for r in P.best_scores(df, "id", "t", ids, cube).collect()}
    assert len(best) == 8
    for i, _, t in rows[2:]:
        z = P.window_scores(P.encode_letters(np.frombuffer(t.encode(), np.uint8), "ACGT"), cube)
        for k, p in enumerate(ids):
            assert abs(best[i, p][0] - z[k].max()) < 1e-4 and best[i, p][1] == z[k].argmax()
        sites = P.match_sites(df.where(F.col("id") == i), "id", "t", ids, cube, np.full(4, 2.0)).count()
        assert sites == int((z >= 2.0).sum())


def test_both_strands_are_scored(spark, tmp_path):
    from strandframe.plans import models

    word, rng = "AACCGATTACAGGTCA", random.Random(7)
    back = word[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seq = "".join(rng.choice("ACGT") for _ in range(30)) + back + "".join(rng.choice("ACGT") for _ in range(20))
    spark.createDataFrame([(4, "Homo_sapiens:chr1:1-66", "dna", seq)], "tileable_id bigint, sequence_id string, alphabet string, seq string").write.parquet(str(tmp_path / "tileable_sequences.parquet"))
    spark.createDataFrame([(3, [8.0 if c == a else 0.0 for c in word for a in "ACGT"])], "vec_id bigint, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [tuple(r) for r in models.match_sites(spark, str(tmp_path)).select("seq_id", "frame", "profile_idx", "start").collect()] == [(4, 1, 3, 20)]
    best = {r["frame"]: (r["score"], r["start"]) for r in models.profile_scores(spark, str(tmp_path)).collect()}
    assert best[1][1] == 20 and best[1][0] > best[0][0]
    seen = models.both_strands(spark, str(tmp_path)).select("species", "frame", "text").orderBy("frame").collect()
    assert [tuple(r) for r in seen] == [("Homo_sapiens", 0, seq), ("Homo_sapiens", 1, seq[::-1].translate(str.maketrans("ACGT", "TGCA")))]


def test_smoothing():
    rates = np.array([[-1.0, 1.0], [2.0, -2.0]])
    m = P.smoothing_matrix(rates, 0.7)
    e = np.exp(-2.1)
    assert np.allclose(m, [[(2 + e) / 3, (1 - e) / 3], [(2 - 2 * e) / 3, (1 + 2 * e) / 3]])
    assert P.best_subwindow([3, 1, 2], 1) is None and P.best_subwindow([1, 3, 2], 1) == 1 and P.best_subwindow([3.0], 0) == 0


def test_trees():
    tree = T.parse_newick("((a:1,b:2)x:1,(c:4,d:1)y:3,e:1)r;")
    leaf = {n.name: n for n in tree.leaves()}
    assert T.distance(leaf["a"], leaf["c"]) == 9 and T.distance(leaf["a"], leaf["b"], topological=True) == 2
    assert T.far_leaves(tree, 2) == ["c", "b"] and len(set(T.far_leaves(tree, 4))) == 4 and set(T.far_leaves(tree, 5)) == set("abcde")
    assert ("x", "r", 1.0) in T.edges(tree)
    with pytest.raises(ValueError):
        T.far_leaves(tree, 1)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 40), st.integers(1, 40))
def test_partial_range_covers_the_full_one(start, length):
    for f in range(3):
        part = (max((start - f) // 3, 0), max(-((f - start - length) // 3), 0))
        full = (max(-((f - start) // 3), 0), max((start + length - f) // 3, 0))
        assert part[0] <= full[0] and (full[1] <= part[1] or full[1] <= full[0])


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 x\nACGT\nAC\n>s2\n\n>s3\r\nNNN\r\n")
    assert [(r["id"], r["seq"]) for r in formats.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("id").collect()] == [("s1 x", "ACGTAC"), ("s2", ""), ("s3", "NNN")]
    df = spark.createDataFrame([("q", "ACGTACGT" * 20)], "id string, seq string")
    formats.write_fasta(df, str(tmp_path / "out"))
    assert formats.read_fasta(spark, str(tmp_path / "out")).select("id", "seq").collect() == df.collect()
    (tmp_path / "a.gtf").write_text('#c\nchr1\tx\texon\t5\t9\t.\t+\t.\tgene_id "a";\nchr2\tx\tCDS\t1\t2\t0.5\t-\t0\tb\n')
    rows = formats.read_gtf(spark, str(tmp_path / "a.gtf"), seqname="chr1").collect()
    assert [(r["start_pos"], r["end_pos"], r["score"], r["frame"], r["attribute"]) for r in rows] == [(4, 9, None, None, 'gene_id "a";')]
    (tmp_path / "a.bed").write_text("chr1\t1\t9\nchr1\t1\t9\tn\t0\t+\t1\t9\t0\t2\t3,4,\t0,4\n")
    assert sorted((r["block_sizes"] or []) for r in formats.read_bed(spark, str(tmp_path / "a.bed")).collect()) == [[], [3, 4]]
    prof = spark.createDataFrame([(0, p, c, 0.25) for p in range(12) for c in "ACGT"], "profile_idx int, pos int, letter string, value double")
    formats.write_meme(prof, str(tmp_path / "meme"))
    back = formats.read_meme(spark, str(tmp_path / "meme"))
    assert back.count() == 48 and back.where("p != 0.25 or motif != 'profile0'").count() == 0
    new = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert sorted(map(tuple, formats.merge_new_runs(new, spark.createDataFrame([("a", 9)], "id string, v int")).collect())) == [("a", 9), ("b", 2)]


def test_streaming_ingest(spark, tmp_path):
    from strandframe.streaming.ingest import append_unseen

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", 1), ("b", 2), ("a", 1)], [("b", 5), ("c", 3)]):
        spark.createDataFrame(rows, "id string, v int").coalesce(1).write.mode("append").parquet(source)
        append_unseen(spark.readStream.schema("id string, v int").parquet(source), target, "id", str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(target).select("id", "v").collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_first_windows_of_tiles_are_known_without_a_shuffle(spark):
    """The kernel marks them, beyond masked letters and signs of several bytes too; the greedy index is the same by either way."""
    rng = random.Random(8)
    texts = [("g", i, 0, "".join(rng.choice("ACGTn" if i % 2 else "AC") for _ in range(rng.randrange(0, 90)))) for i in range(30)] + [("h", 40, 0, "é" * 7 + "ACGTACGTAC"), ("h", 41, 1, None)]
    df = spark.createDataFrame(texts, "g string, s int, f int, t string").repartition(3)
    rows = K.kmer_rows(df, ["g", "s", "f"], "t", 4, tile=6)
    firsts = {(r["s"], r["pos"] // 6): r["pos"] for r in sorted(rows.collect(), key=lambda r: -r["pos"])}
    assert {(r["s"], r["pos"]) for r in rows.where("opens").collect()} == {(s, pos) for (s, _), pos in firsts.items()}
    order = ["g", "s", "f", "pos"]
    marked, plain = (K.greedy_index(x, order, 6) for x in (rows, rows.drop("opens")))
    assert sorted(marked.collect()) == sorted(plain.collect())
    assert str(marked._jdf.queryExecution().optimizedPlan()).count("Aggregate") < str(plain._jdf.queryExecution().optimizedPlan()).count("Aggregate")
