import json

import pytest
from pyspark.sql import functions as F

from strandframe.functions import config, udtf
from strandframe.operators.exons import parse_directory
from strandframe.sources import formats, records
from strandframe.streaming import ingest


def chain(depth, top="a"):
    out = {"id": f"{top}{depth}", "species": "s", "chromosome": "c", "genome_start": depth, "genome_end": 99, "source": {"x": [1, {"y": 2}]}}
    if depth:
        out["homology" if depth % 2 else "genomic_elements"] = [chain(depth - 1, top), None]
    return out


def test_sequences_of_any_depth(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([chain(7), {"id": "s:c:1,200-1,300", "species": "s", "chromosome": "c", "genome_start": 1200, "genome_end": 1300, "genomic_elements": []}]))
    (tmp_path / "genomes.json").write_text(json.dumps([[chain(0, "g"), chain(1, "h")], [], [{"id": "k"}]]))
    (tmp_path / "bad.json").write_text('{"id": ')
    rows = records.read_sequence_json(spark, str(tmp_path / "*.json")).collect()
    one = {r["node"]: r for r in rows if r["file"] == "one.json"}
    assert sorted(r["id"] for r in one.values()) == sorted([f"a{d}" for d in range(8)] + ["s:c:1,200-1,300"])
    deepest = next(n for n in one if one[n]["id"] == "a0")
    assert deepest == "$[0].homology[0].genomic_elements[0].homology[0].genomic_elements[0].homology[0].genomic_elements[0].homology[0]" and one[deepest]["parent"] == deepest.rsplit(".", 1)[0]
    assert one["$[1]"]["elements_allowed"] and not one["$[1]"]["homology_allowed"] and one["$[1]"]["id_matches"] and one["$[0]"]["id_matches"] is False
    assert {r["node"]: r["id"] for r in rows if r["file"] == "genomes.json"} == {"$[0][0]": "g0", "$[0][1]": "h1", "$[0][1].homology[0]": "h0", "$[2][0]": "k"}
    assert not [r for r in rows if r["file"] == "bad.json"]


def test_fasta_defaults_and_foreign_letters(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">Homo_sapiens:chr1:1-9 x\nAC\nGT\n>Homo_sapiens:chr2:1-4\r\nAC>GT\n>plain\n")
    with pytest.raises(Exception, match="foreign letters"):
        formats.read_fasta(spark, str(tmp_path / "a.fa")).collect()
    (tmp_path / "b.fa").write_text(">Homo_sapiens:chr2:1-4\nACGT\n>plain\nAC\n")
    got = {tuple(r) for r in formats.read_fasta(spark, str(tmp_path / "b.fa"), species="sp", chromosome="ch").collect()}
    assert got == {("Homo_sapiens:chr2:1-4", "Homo_sapiens", "chr2", "ACGT"), ("plain", "sp", "ch", "AC")}


def test_gtf_filters_reach_the_scan(spark, tmp_path):
    lines = ["chr1\ta\texon\t5\t9\t0.5\t+\t0\tx", "chr1\ta\texon\t9\t20\t.\t+\t.\tx", "chr1\tb\tCDS\t30\t40\t2\t-\t1\tx", "chr2\ta\texon\t5\t9\t1\t+\t0\tx"]
    (tmp_path / "a.gtf").write_text("#c\n" + "\n".join(lines) + "\n")
    read = lambda **k: sorted((r["seqname"], r["start_pos"]) for r in formats.read_gtf(spark, str(tmp_path / "a.gtf"), **k).collect())
    assert read(seqname="chr1", range_start=9, range_end=30) == [("chr1", 8), ("chr1", 29)] and read(range_start=8, range_end=9) == [("chr1", 4), ("chr1", 8), ("chr2", 4)]
    assert read(min_score=0.6) == [("chr1", 29), ("chr2", 4)] and read(max_score=0.6, frame=0) == [("chr1", 4)] and read(source="b", feature="CDS", strand="-") == [("chr1", 29)]
    plan = formats.read_gtf(spark, str(tmp_path / "a.gtf"), seqname="chr1", min_score=0.1)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(seqname,chr1)" in plan and "GreaterThanOrEqual(score,0.1)" in plan
    for bad in ({"range_start": 5, "range_end": 5}, {"strand": "x"}, {"frame": 4}):
        with pytest.raises(ValueError):
            formats.read_gtf(spark, str(tmp_path / "a.gtf"), **bad)


def test_bed_with_unfitting_lists_raises(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t1\t9\tn\t0\t+\t1\t9\t0\t2\t3,4,5\t0,4\n")
    with pytest.raises(Exception, match="do not fit"):
        formats.read_bed(spark, str(tmp_path / "a.bed")).collect()


def test_motif_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<r><motifs><motif id="m1" alt="x"><pos A="1" C="0" G="0" T="0" U="0"/><pos A="0" C="0.5" G="0.25" T="0.25"/></motif>\n<motif id="m2"><pos A="0" C="1" G="0" T="0"/></motif></motifs></r>')
    got = {(r["motif"], r["pos"], r["letter"]): r["p"] for r in formats.read_motif_xml(spark, str(tmp_path / "a.xml")).collect()}
    assert len(got) == 12 and got["m1", 1, "C"] == 0.5 and got["m2", 0, "C"] == 1.0 and not any(k[2] == "U" for k in got)
    assert formats.read_motif_xml(spark, str(tmp_path / "a.xml"), alphabet="AC").count() == 6
    (tmp_path / "a.meme").write_text("MEME version 5\n\nALPHABET= AC\n\nMOTIF x y\nletter-probability matrix: alength= 2 w= 2\n 0.25 0.75\n 1 0\n\nMOTIF x\nletter-probability matrix: alength= 2 w= 1\n 0 1\n")
    assert sorted(map(tuple, formats.read_meme(spark, str(tmp_path / "a.meme"), alphabet="AC").collect())) == [("x", 0, "A", 0.25), ("x", 0, "C", 0.75), ("x", 1, "A", 1.0), ("x", 1, "C", 0.0)]
    with pytest.raises(Exception, match="another alphabet"):
        formats.read_meme(spark, str(tmp_path / "a.meme"), alphabet="ACGT").collect()


def test_site_table(spark, tmp_path):
    head = "motif_ID\tmotif_ALT_ID\tmotif_P\tseq_ID\tsite_Start\tsite_End\tsite_Strand\tsite_Score\n"
    (tmp_path / "sites.tsv").write_text(head + "AC\tM-1\t1e-3\ts0\t3\t7\t-\t1.5\n# c\n")
    aliases = spark.createDataFrame([("s0", "id0", 4)], "alias string, sequence_id string, frame_idx int")
    assert [tuple(r) for r in formats.read_site_table(spark, str(tmp_path / "sites.tsv"), aliases).collect()] == [("M-1", "id0", 2, "-", 1, 5)]
    for line, fault in (("AC\tM-1\t1\tother\t3\t7\t-\t1", "unknown alias"), ("AC\tM-1\t1\ts0\t3\t7\t.\t1", "unsuitable strand"), ("AC\todd\t1\ts0\t3\t7\t+\t1", "odd motif name")):
        (tmp_path / "bad.tsv").write_text(head + line + "\n")
        with pytest.raises(Exception, match=fault):
            formats.read_site_table(spark, str(tmp_path / "bad.tsv"), aliases).collect()
    (tmp_path / "aa.tsv").write_text(head + "AC\tM-1\t1e-3\ts0\t3\t7\t.\t1.5\n")
    assert formats.read_site_table(spark, str(tmp_path / "aa.tsv"), aliases, amino=True).first()["frame"] == 4


def test_keyed_tables_and_run_discovery(spark, tmp_path):
    for run in "abc":
        (tmp_path / f"run_{run}").mkdir()
        (tmp_path / f"run_{run}" / "hits.tsv").write_text(f"p\tn\n0.5\t{ord(run)}\n#x\n")
    (tmp_path / "other.tsv").write_text("p\tn\n1\t1\n")
    got = formats.read_keyed_tsv(spark, str(tmp_path / "run_*/hits.tsv"), "run_([a-z]+)/", "run", "p DOUBLE, n INT").collect()
    assert {(r["run"], r["n"]) for r in got} == {("a", 97), ("b", 98), ("c", 99)}
    runs = formats.find_runs(spark, str(tmp_path), "run_([a-z]+)/", "run")
    assert {r["run"] for r in runs.collect()} == {"a", "b", "c"}
    first = [r["run"] for r in formats.find_runs(spark, str(tmp_path), "run_([a-z]+)/", "run", seed=3, most=2).collect()]
    assert len(first) == 2 and first == [r["run"] for r in formats.find_runs(spark, str(tmp_path), "run_([a-z]+)/", "run", seed=3).collect()][:2]


def test_seeded_cut_does_not_depend_on_partitions(spark):
    df = spark.range(200)
    a, b, c = ([r["id"] for r in formats.seeded_cut(df.repartition(n), ["id"], seed, 20).collect()] for n, seed in ((1, 5), (7, 5), (3, 6)))
    assert a == b != c and len(set(a)) == 20 and a != sorted(a)


def test_exon_directories(spark):
    df = spark.createDataFrame([("/x/exon_chr1_12_40/y.fa",), ("exon_chrUn_1v1_3_9",), ("/x/none",), (None,)], "p string")
    part = parse_directory(F.col("p"))
    assert [tuple(r) for r in df.select(part["chromosome"], part["start"], part["stop"]).collect()] == [("chr1", 12, 40), ("chrUn_1v1", 3, 9), (None, None, None), (None, None, None)]


def test_settings_and_rates(tmp_path):
    with pytest.warns(UserWarning, match="unknown setting z"):
        assert config.layered({"a": 1, "b": 2}, {"a": 3, "z": 1}, {"b": None}) == {"a": 3, "b": 2}
    (tmp_path / "rates").write_text("1\n2 3\n\n0.2 0.3 0.5\n")
    rates = {(a, b): r for a, b, r in config.read_exchangeabilities(str(tmp_path / "rates"), "ABC", "CA")}
    assert rates == {("C", "C"): 0.0, ("C", "A"): 2.0, ("A", "C"): 2.0, ("A", "A"): 0.0}
    assert config.read_frequencies(str(tmp_path / "rates"), "ABC") == {"A": 0.2, "B": 0.3, "C": 0.5}
    with pytest.raises(ValueError):
        config.read_exchangeabilities(str(tmp_path / "rates"), "ABCDEFGH")


def test_table_functions(spark):
    udtf.register(spark)
    spark.createDataFrame([(1, "ACGTTAC"), (2, ""), (3, None), (4, "AC")], "id int, s string").createOrReplaceTempView("texts")
    rows = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert rows("SELECT id, tile_ord, tile_start, tile FROM texts, LATERAL tiles(s, 3) ORDER BY 1, 2") == [(1, 0, 0, "ACG"), (1, 1, 3, "TTA"), (1, 2, 6, "C"), (4, 0, 0, "AC")]
    assert rows("SELECT id, pos, kmer FROM texts, LATERAL kmers(s, 5) ORDER BY 1, 2") == [(1, 0, "ACGTT"), (1, 1, "CGTTA"), (1, 2, "GTTAC")]
    assert rows("SELECT frame, residues FROM texts, LATERAL six_frames(s) WHERE id = 1 ORDER BY 1") == [(0, "TL"), (1, "RY"), (2, "V"), (3, "VT"), (4, "*R"), (5, "N")]


def test_streams(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, at timestamp, loss double"
    data = lambda *ids: spark.createDataFrame([(i, None, 1.0) for i in ids], schema).withColumn("at", F.to_timestamp(F.lit("2026-01-01 00:10:00")))
    data("a", "b", "a").write.mode("append").parquet(source)
    for _ in range(2):
        ingest.append_unseen(ingest.new_runs(spark, source, schema, "id", "at"), target, "id", str(tmp_path / "cp")).awaitTermination()
    data("b", "c").write.mode("append").parquet(source)
    ingest.append_unseen(ingest.new_runs(spark, source, schema, "id", "at"), target, "id", str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]
    windows = ingest.loss_windows(spark.readStream.schema(schema).parquet(source), "at", "loss")
    q = windows.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    row = spark.table("windows").first()
    assert (row["n"], row["mean"], row["least"]) == (5, 1.0, 1.0)
