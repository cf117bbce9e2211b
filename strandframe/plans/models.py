"""Profile model queries, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import kmers as K
from strandframe.operators import profiles as P
from strandframe.operators import training as T
from strandframe.operators.trees import edges, far_leaves, newick, parse_newick, prune
from strandframe.plans.base import DNA, GREEDY, dna, sql
from strandframe.plans.sequences import greedy_counts
from strandframe.session import table
from strandframe.sources.formats import meme_text

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return add


_LOGITS = "logits AS (SELECT vec_id AS profile_idx, CAST(i // 4 AS INTEGER) AS pos, substr('ACGT', i % 4 + 1, 1) AS letter, CAST(embedding[i + 1] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))"
_P = "p AS (SELECT profile_idx, pos, letter, exp(value) / sum(exp(value)) OVER (PARTITION BY profile_idx, pos) AS value FROM logits)"
_Q = "q AS (SELECT letter, n / CAST(sum(n) OVER () AS DOUBLE) AS freq FROM (SELECT letter, sum(length(t) - length(replace(t, letter, ''))) AS n FROM (SELECT seq AS t FROM seqs UNION ALL SELECT reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) FROM seqs), (VALUES ('A'), ('C'), ('G'), ('T')) v(letter) GROUP BY letter))"
_R = "r AS (SELECT profile_idx, pos, letter, ln(greatest(value / freq, 1e-6)) AS value FROM p JOIN q USING (letter))"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profiles_from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.background(K.dna_frames(dna(spark, sf_dir), "seq_id", "seq"), "text", "ACGT")


def both_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, species, frame (0 forward, 1 reverse complement), text: what the background, scores, sites and training cover."""
    once = dna(spark, sf_dir).select(F.struct("seq_id", "species").alias("of"), "seq")
    return K.dna_frames(once, "of", "seq").select("of.seq_id", "of.species", "frame", "text")


def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.log_odds(P.softmax_rows(logits(spark, sf_dir)), background(spark, sf_dir))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumn("value", F.round("value", places))


@query(sql(_LOGITS, _P, query="SELECT profile_idx, pos, letter, round(value, 6) AS value FROM p"))
def profile_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.softmax_rows(logits(spark, sf_dir)))


@query(sql(DNA, _LOGITS, _P, _Q, _R, query="SELECT profile_idx, pos, letter, round(value, 6) AS value FROM r"))
def log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(odds(spark, sf_dir))


@query(sql(DNA, GREEDY, _Q, "seeds AS (SELECT kmer, r AS profile FROM (SELECT kmer, n, rank() OVER (ORDER BY n DESC) AS k, row_number() OVER (ORDER BY n DESC, seen, kmer) AS r FROM greedy) WHERE (n >= 8 OR k <= 10) AND r <= 200)",
           query="""SELECT profile AS profile_idx, CAST(pos AS INTEGER) AS pos, letter, round(freq + CASE WHEN pos >= 4 AND pos < 16 AND substr(kmer, CAST(pos - 4 + 1 AS BIGINT), 1) = letter THEN 4.0 ELSE 0.0 END, 9) AS value FROM seeds, range(20) t(pos), q"""))
def seed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_seeded(spark, sf_dir, 200), 9)


def _seeded(spark: SparkSession, sf_dir: str, max_u: int) -> DataFrame:
    seeds = K.select_kmers(greedy_counts(spark, sf_dir), max_u=max_u, min_occ=8, min_u=min(10, max_u))
    return P.seed_logits(seeds, background(spark, sf_dir), 20)


def _scan(width: int) -> str:
    """Scores z of all windows of both strands for all profiles of r: four letters at a time, looked up in lists over the profiles."""
    assert width % 4 == 0
    quads = width // 4
    return f"""texts AS (SELECT seq_id, species, 0 AS frame, seq AS text FROM seqs UNION ALL SELECT seq_id, species, 1, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) FROM seqs),
    cells AS (SELECT profile_idx, pos, instr('ACGT', letter) - 1 AS a, value FROM r UNION ALL SELECT DISTINCT profile_idx, pos, 4, 0.0 FROM r),
    quads AS (SELECT w.pos // 4 AS g, ((w.a * 5 + x.a) * 5 + y.a) * 5 + z.a AS code, list(w.value + x.value + y.value + z.value ORDER BY w.profile_idx) AS v
        FROM cells w JOIN cells x ON x.profile_idx = w.profile_idx AND x.pos = w.pos + 1 JOIN cells y ON y.profile_idx = w.profile_idx AND y.pos = w.pos + 2 JOIN cells z ON z.profile_idx = w.profile_idx AND z.pos = w.pos + 3 WHERE w.pos % 4 = 0 GROUP BY ALL),
    coded AS (SELECT seq_id, species, frame, length(text) AS n, list_transform(string_split(text, ''), lambda c: CASE c WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END) AS h FROM texts),
    wins AS (SELECT seq_id, species, frame, i AS start, list_transform(range({quads}), lambda k: ((h[i + 4 * k + 1] * 5 + h[i + 4 * k + 2]) * 5 + h[i + 4 * k + 3]) * 5 + h[i + 4 * k + 4]) AS k
        FROM coded, LATERAL (SELECT unnest(range(greatest(n - {width - 1}, 0))) AS i)),
    ids AS (SELECT list(DISTINCT profile_idx ORDER BY profile_idx) AS ps FROM r),
    scored AS (SELECT seq_id, species, frame, start, unnest(ps) AS profile_idx, {" + ".join(f"unnest(q{g}.v)" for g in range(quads))} AS z FROM wins w {" ".join(f"JOIN quads q{g} ON q{g}.g = {g} AND q{g}.code = w.k[{g + 1}]" for g in range(quads))}, ids)"""


@query(sql(DNA, _LOGITS, _P, _Q, _R, _scan(16), query="SELECT seq_id, frame, profile_idx, round(max(z), 6) AS score, arg_max(start, (z, -start)) AS start FROM scored GROUP BY ALL"))
def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best window of every text and strand for every profile; starts on the reverse strand (frame 1) count from its own beginning."""
    ids, cube = P.to_cube(odds(spark, sf_dir), "ACGT")
    out = P.best_scores(both_strands(spark, sf_dir), "seq_id", "text", ids, cube, frame_col="frame", places=6)
    return out.withColumnRenamed("id", "seq_id")


@query(sql(DNA, _LOGITS, _P, _Q, _R, _scan(16), "least AS (SELECT profile_idx, 0.9 * sum(top) AS need FROM (SELECT profile_idx, pos, max(value) AS top FROM r GROUP BY ALL) GROUP BY profile_idx)",
           query="SELECT seq_id, frame, s.profile_idx, start, round(z, 6) AS score FROM scored s JOIN least USING (profile_idx) WHERE z >= need"))
def match_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of both strands within nine tenths of the highest score that a profile can reach; starts as in profile_scores."""
    ids, cube = P.to_cube(odds(spark, sf_dir), "ACGT")
    out = P.match_sites(both_strands(spark, sf_dir), "seq_id", "text", ids, cube, 0.9 * cube.max(axis=2).sum(axis=1), frame_col="frame", places=6)
    return out.withColumnRenamed("id", "seq_id")


# ---- losses and training of the seeded profiles, on tiles of both strands

_TILE, _PER_STEP, _WIDTH = T.DEFAULTS["tile_size"], T.DEFAULTS["tiles_per_step"], T.DEFAULTS["k"]
_SEEDED = """seeds AS (SELECT kmer, r AS profile FROM (SELECT kmer, n, rank() OVER (ORDER BY n DESC) AS k, row_number() OVER (ORDER BY n DESC, seen, kmer) AS r FROM greedy) WHERE (n >= 8 OR k <= 10) AND r <= 200),
logits AS (SELECT profile AS profile_idx, CAST(pos AS INTEGER) AS pos, letter, freq + CASE WHEN pos >= 4 AND pos < 16 AND substr(kmer, CAST(pos - 4 + 1 AS BIGINT), 1) = letter THEN 4.0 ELSE 0.0 END AS value FROM seeds, range(20) t(pos), q)"""
# tiles of both strands as texts of full length, their genome and step
_TILED = f"""counted AS (SELECT *, CAST(coalesce(sum(nt) OVER (PARTITION BY species ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT species, seq_id, seq, CAST(ceil(length(seq) / {_TILE}.0) AS BIGINT) AS nt FROM seqs)),
cut AS (SELECT species, seq_id, frame, (before + t) // {_PER_STEP} AS step, substr(text, 1 + CASE WHEN frame = 0 THEN t * {_TILE} ELSE greatest(length(text) - (t + 1) * {_TILE}, 0) END,
    CASE WHEN frame = 0 THEN {_TILE} ELSE length(text) - t * {_TILE} - greatest(length(text) - (t + 1) * {_TILE}, 0) END) AS tile
    FROM (SELECT species, seq_id, 0 AS frame, seq AS text, before, nt FROM counted UNION ALL SELECT species, seq_id, 1, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')), before, nt FROM counted), LATERAL (SELECT unnest(range(nt)) AS t)),
shape AS (SELECT species, step, count(*) AS have FROM cut GROUP BY ALL)"""


def training_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.place(T.step_tiles(both_strands(spark, sf_dir), "species", "seq_id", "frame", "text", _TILE, _PER_STEP))


def _seed_matrix(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, logits, background) of the seeded profiles, at most 200 of 20 places."""
    ids, cube = P.to_cube(_seeded(spark, sf_dir, T.DEFAULTS["U"]), "ACGT")
    q = {r["letter"]: r["freq"] for r in background(spark, sf_dir).collect()}
    return ids, cube, np.maximum([q[c] for c in "ACGT"], 1e-9)


_STEP_LOSS = sql(
    DNA, GREEDY, _Q, _SEEDED, _P, _R, _TILED,
    _scan(20).replace("SELECT seq_id, species, 0 AS frame, seq AS text FROM seqs UNION ALL SELECT seq_id, species, 1, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) FROM seqs", f"SELECT step AS seq_id, species, frame, rpad(tile, {_TILE}, 'N') AS text FROM cut"),
    f"grown AS (SELECT species, seq_id AS step, profile_idx, max(z) AS best, sum(exp(z)) AS mass, max(z * exp(z)) AS num FROM scored GROUP BY ALL)",
    f"filled AS (SELECT g.species, g.step, profile_idx, best, mass, num, ({2 * _PER_STEP} - have) * {_TILE - _WIDTH + 1} AS zeros FROM grown g JOIN shape s ON s.species = g.species AND s.step = g.step)",
    query="SELECT species AS genome, step, profile_idx, round(CASE WHEN zeros > 0 THEN -greatest(num, 0) ELSE -num END / (mass + zeros), 6) + 0.0 AS loss, round(CASE WHEN zeros > 0 THEN greatest(best, 0) ELSE best END, 6) + 0.0 AS score FROM filled",
)


@query(_STEP_LOSS)
def profile_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and best score of every seeded profile in every genome and step, empty slots counted as windows of score 0 (gamma 1)."""
    ids, cube, q = _seed_matrix(spark, sf_dir)
    odds_ = np.log(np.maximum(T._softmax(cube) / q, T.DEFAULTS["epsilon"]))
    out = T.step_losses(training_tiles(spark, sf_dir), ids, odds_, _TILE, _PER_STEP, 2, 1.0)
    return out.select("genome", "step", "profile_idx", (F.round("loss", 6) + 0.0).alias("loss"), (F.round("score", 6) + 0.0).alias("score"))


@query(sql(DNA, _TILED, query="SELECT species AS genome, step, count(*) AS n_tiles, CAST(sum(length(tile)) AS BIGINT) AS n_letters, round(sum(count(*)) OVER (PARTITION BY step) / (14.0 * (SELECT count(DISTINCT species) FROM seqs)), 9) AS weight FROM cut GROUP BY species, step"))
def step_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches: tiles and letters of every genome in every step, and the share of the step's slots that hold a text."""
    tiles = T.step_tiles(both_strands(spark, sf_dir), "species", "seq_id", "frame", "text", _TILE, _PER_STEP)
    return tiles.groupBy("genome", "step").agg(F.count("*").alias("n_tiles"), F.sum(F.length("tile")).alias("n_letters"), F.round(F.max("weight"), 9).alias("weight"))


# A public model of equal rates between four letters, after time 0.3.
_EQUAL_STEP = P.smoothing_matrix(np.ones((4, 4)) - 4 * np.eye(4), 0.3)


@query(sql(_LOGITS, _P, "a(letter, to_letter, w) AS (VALUES " + ", ".join(f"('{x}', '{y}', {_EQUAL_STEP[i, j]!r}::DOUBLE)".replace("np.float64(", "").replace("):", ":") for i, x in enumerate("ACGT") for j, y in enumerate("ACGT")) + ")",
           query="SELECT profile_idx, pos, to_letter AS letter, round(sum(value * w), 6) AS value FROM p JOIN a USING (letter) GROUP BY ALL"))
def smoothed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter shares after a substitution step of a continuous-time model."""
    rows = [(x, y, float(_EQUAL_STEP[i, j])) for i, x in enumerate("ACGT") for j, y in enumerate("ACGT")]
    return _rounded(P.smooth(P.softmax_rows(logits(spark, sf_dir)), spark.createDataFrame(rows, "letter string, to_letter string, p double")))


@query()
def random_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of 200 random profiles around the background."""
    return P.random_logits(spark, background(spark, sf_dir), 200, _WIDTH, seed=1)


@query()
def sampled_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of 200 profiles seeded from places drawn from the texts of both strands."""
    rows = both_strands(spark, sf_dir).withColumn("id", F.struct("seq_id", "frame"))
    return P.sampled_logits(rows, "id", "text", background(spark, sf_dir), 200, _WIDTH, seed=1, rho=4.0)


@query(sql(_LOGITS, _P, query="SELECT profile_idx, 'MOTIF profile' || profile_idx || chr(10) || 'letter-probability matrix: alength= 4 w= 16' || chr(10) || string_agg(line, chr(10) ORDER BY pos) || chr(10) AS block FROM (SELECT profile_idx, pos, string_agg(printf('%.6f', value), ' ' ORDER BY letter) AS line FROM p GROUP BY ALL) GROUP BY profile_idx"))
def meme_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meme_text(P.softmax_rows(logits(spark, sf_dir)))


def _trained(spark: SparkSession, sf_dir: str) -> dict:
    _, cube, q = _seed_matrix(spark, sf_dir)
    if not len(cube):
        return {"history": [], "reports": [], "sites": []}
    return T.train(training_tiles(spark, sf_dir), cube, q)


@query()
def train_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of a run from the commonest k-mers to two reported profiles, on both strands of all DNA texts."""
    history = _trained(spark, sf_dir)["history"]
    return spark.createDataFrame([(h["epoch"], round(h["loss"], 6), h["best"], round(h["best_mean_loss"], 6), h["rate"]) for h in history], "epoch int, loss double, best int, best_mean_loss double, rate double")


@query()
def reported_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of the reported profiles of the same run; those of a later report never lie in letters masked before."""
    sites = _trained(spark, sf_dir)["sites"]
    empty = spark.createDataFrame([], "genome string, seq bigint, frame int, tile_start bigint, tile_pos bigint, profile_idx bigint, score double, report int")
    for s in sites:
        empty = empty.unionByName(s)
    return empty.select("report", "profile_idx", "genome", "seq", "frame", (F.col("tile_start") + F.col("tile_pos")).alias("start"), F.round("score", 6).alias("score"))


@query()
def reported_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reported profiles of the same run: epoch, threshold, least loss, number of sites and letter shares."""
    rows = []
    for i, r in enumerate(_trained(spark, sf_dir)["reports"]):
        head = (i, r["epoch"], r["profile"], round(r["threshold"], 6), round(r["min_loss"], 6), r["n_sites"])
        rows += [(*head, p, c, round(float(r["profile_matrix"][p, a]), 6)) for p in range(len(r["profile_matrix"])) for a, c in enumerate("ACGT")]
    return spark.createDataFrame(rows, "report int, epoch int, profile_idx int, threshold double, min_loss double, n_sites bigint, pos int, letter string, share double")


@query()
def far_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species spread over a star tree by their branch lengths (one row per genome: at most a few hundred)."""
    rows = table(spark, sf_dir, "genomes").orderBy("genome_idx").collect()
    tree = parse_newick("(" + ",".join(f"{r['species']}:{r['branch_length']}" for r in rows) + ")root;")
    chosen = far_leaves(tree, min(len(rows), len(rows) // 10 + 2))
    lengths = {name: x for name, _, x in edges(tree)}
    return spark.createDataFrame([(i, s, lengths[s]) for i, s in enumerate(chosen)], "place int, species string, branch_length double")


@query()
def far_species_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species spread over a tree of two levels (by first letter), equal distances by the number of their sequences; with the tree that is left."""
    rows = table(spark, sf_dir, "genomes").orderBy("genome_idx").collect()
    known = {r["species"] for r in rows}
    counts = {r["species"]: float(r["n"]) for r in table(spark, sf_dir, "sequences").groupBy("species").agg(F.count_distinct("sequence_id").alias("n")).collect() if r["species"] in known}
    groups: dict[str, list[str]] = {}
    for r in rows:
        groups.setdefault(r["species"][0], []).append(f"{r['species']}:{r['branch_length']}")
    tree = parse_newick("(" + ",".join(f"({','.join(g)}){k}:0.1" for k, g in sorted(groups.items())) + ")root;")
    chosen = far_leaves(tree, min(len(rows), len(rows) // 10 + 2), counts)
    left = newick(prune(tree, set(chosen)))
    return spark.createDataFrame([(i, s, counts.get(s, 0.0), left) for i, s in enumerate(chosen)], "place int, species string, score double, tree string")
