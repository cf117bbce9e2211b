import random

from hypothesis import given, settings
from hypothesis import strategies as st

from strandframe.llm import tokens

ENC, PATTERN = tokens.encoder("byte_bpe_50k"), tokens.pre_tokens()
SIGNS = st.sampled_from(["a", "b", " ", "  ", "\n", "'", "'ll", "1", "22", "é", "日本", "…", "!", "\t", "re", "　", "👩‍🔬"])


@settings(max_examples=300, deadline=None)
@given(st.lists(SIGNS, max_size=120).map("".join), st.sampled_from([(8, 3), (16, 8), (40, 39), (25, 5)]))
def test_chunks_change_nothing(text, shape):
    chunk, overlap = shape
    assert tokens.encode_text(text, ENC, PATTERN, chunk, overlap) == ENC.encode_ordinary(text)


def test_long_runs_and_round_trip():
    rng = random.Random(4)
    for text in ("a" * 30_000 + " b" * 20_000, " " * 20_000 + "x", "\n" * 9000 + "日" * 9000, "".join(rng.choice("ab 1\n'sé") for _ in range(50_000))):
        ids = tokens.encode_text(text, ENC, PATTERN)
        assert ids == ENC.encode_ordinary(text)
        assert tokens.decode_ids(ids) == text


def test_operator(spark):
    df = spark.createDataFrame([(1, "a b", "z"), (2, "", "z"), (3, None, "z"), (4, "<|endoftext|>", "z"), (4, "<|endoftext|>", "z"), (None, "x", "z")], "doc_id bigint, text string, ids string")
    got = sorted([(r["doc_id"] or 0, list(r["ids"])) for r in tokens.encode(df).collect()])
    assert got == [(0, ENC.encode_ordinary("x")), (1, ENC.encode_ordinary("a b")), (2, []), (3, []), (4, ENC.encode_ordinary("<|endoftext|>")), (4, ENC.encode_ordinary("<|endoftext|>"))]
    assert 50256 not in got[4][1]
    assert tokens.encode(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(SIGNS, st.sampled_from(["\x1c", "​", " ", "\x85", ".", "-x"])), max_size=120).map("".join), st.sampled_from([1, 4, 17]))
def test_divided_texts_are_encoded_alike(text, size):
    parts = tokens.divide(text, size)
    assert "".join(parts) == text
    assert [i for p in parts for i in ENC.encode_ordinary(p)] == ENC.encode_ordinary(text)


def test_tasks_share_one_text(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["word ", "x\n", " ", "été", "12", "'s ", "日本"]) for _ in range(3000)) for _ in range(3)] + ["a" * 3000, "", None]
    rows = [(i % 5, t) for i, t in enumerate(texts + texts[:2])]
    got = sorted((r["doc_id"], list(r["ids"])) for r in tokens.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), spread=500).collect())
    assert got == sorted((i, ENC.encode_ordinary(t or "")) for i, t in rows)
