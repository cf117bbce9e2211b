import random

import pytest

from strandframe.llm import garble

CLEAN = {
    "de": "Außerdem überlappen die Fenster, schließlich wählte die Gruppe höhere Werte für später und prüfte die Länge.",
    "fr": "Même réglé à zéro, le seuil élimine déjà des sites vérifiés ; l’écart observé gêne la région masquée.",
    "es": "La señal más débil está en la posición siguiente, también eliminó el tamaño según la revisión.",
    "ru": "Порог слишком высок, и мы теряем позиции после нескольких эпох обучения модели.",
    "ja": "閾値は高すぎるため、部位が失われた。もう一度確認してください。",
    "en": "The “left anchor” costs £4 or ½ of that; a naïve café résumé weighs 3 µg ± 0.1, Ångström units…",
}
WAYS = [("utf_8", "cp1252", "de"), ("utf_8", "latin_1", "fr"), ("utf_8", "mac_roman", "es"), ("utf_8", "cp437", "de"), ("utf_8", "cp850", "fr"), ("utf_8", "cp1251", "ru"), ("cp1251", "latin_1", "ru"), ("cp866", "cp1251", "ru"), ("cp1252", "mac_roman", "de"), ("euc_jp", "latin_1", "ja"), ("utf_8", "cp1250", "es")]


def misread(text, real, read):
    table = {}
    for b in range(256):
        try:
            table[b] = bytes([b]).decode(read)
        except UnicodeDecodeError:
            table[b] = chr(b)
    return "".join(table[b] for b in text.encode(real, "ignore"))


def documents(spark):
    rng = random.Random(6)
    rows, truth, doc = [], {}, 0
    for _ in range(60):
        for text in CLEAN.values():
            words = text.split(" ")
            cut = rng.randrange(len(words))
            rows.append((doc, " ".join(words[cut:] + words[:cut]), "x"))
            doc += 1
    for real, read, lang in WAYS:
        good = CLEAN[lang].replace("’", "'") if real != "utf_8" else CLEAN[lang]
        bad = misread(good, real, read)
        truth[doc] = f"{CLEAN['en']} {good}"
        rows.append((doc, f"{CLEAN['en']} {bad}", "x"))
        doc += 1
    twice = misread(misread(CLEAN["fr"], "utf_8", "cp1252"), "utf_8", "cp1252")
    truth[doc] = CLEAN["fr"]
    rows.append((doc, twice, "x"))
    rows += [(doc + 1, "gen�gt", "x"), (doc + 2, None, "x"), (doc + 3, "", "x"), (doc + 4, "plain", "x"), (doc + 5, "┌── ok", "x"), (doc + 6, "é", "x"), (doc + 6, "é", "x"), (None, "ü", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, restored string"), truth, doc


@pytest.fixture(scope="module")
def repaired(spark):
    df, truth, last = documents(spark)
    return {r["doc_id"]: r for r in garble.repair(df).collect()}, truth, last, df.count()


def test_finds_all_and_only_garbled(repaired):
    got, truth, last, n = repaired
    assert {i for i, r in got.items() if r["garbled"]} == {*truth, last + 1}
    assert got[last + 1]["lost"] and got[last + 2]["restored"] is None and got[last + 3]["restored"] == ""


def test_restores(repaired):
    got, truth, *_ = repaired
    same = [i for i, t in truth.items() if got[i]["restored"] == t]
    assert len(same) == len(truth), [(got[i]["restored"], t) for i, t in truth.items() if i not in same]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert garble.repair(df).count() == 0


def test_long_text(spark):
    text = "schließlich " * 100_000 + "schlieÃŸlich"
    around = [(10 + i, f"{t} {i:c<{i % 7}}") for i, t in enumerate(list(CLEAN.values()) * 10)]
    df = spark.createDataFrame([(1, text), *around], "doc_id bigint, text string")
    row = garble.repair(df).where("doc_id = 1").first()
    assert row["restored"] == "schließlich " * 100_000 + "schließlich"


def test_copies_do_not_vouch_for_themselves(spark):
    good = [(i, t) for i, t in enumerate([t for t in CLEAN.values()] * 10)]
    rows = [(i, f"{t} {i:c<{i % 7}}") for i, t in good]
    bad = misread("für", "utf_8", "cp1252")
    dropped = "".join(c for c in misread(CLEAN["ru"], "utf_8", "latin_1") if not 0x80 <= ord(c) < 0xA0)
    same = {1000 + i: bad for i in range(60)}
    changed = {2000 + i: f"{bad} {chr(97 + i % 26) * (i // 26 + 1)}" for i in range(60)}
    lost = {3000 + i: dropped for i in range(60)}
    rows += [*same.items(), *changed.items(), *lost.items()]
    got = {r["doc_id"]: r for r in garble.repair(spark.createDataFrame(rows, "doc_id bigint, text string")).where("garbled").collect()}
    assert set(got) == {*same, *changed, *lost}
    assert all(got[i]["restored"].startswith("für") for i in (*same, *changed))


def test_restoration_of_planted_texts(spark, tmp_path):
    """Whole texts, misread in many ways into a corpus of clean ones."""
    from tests.llm import restoration

    rng = random.Random(11)
    rows, i = [], 0
    for _ in range(160):
        for text in CLEAN.values():
            words = text.split(" ")
            rng.shuffle(words)
            rows.append((i, " ".join(words)))
            i += 1
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = restoration.measure(spark, str(tmp_path), 4)
    assert sum(n for _, n, _, _ in got) >= 50
    assert sum(found for _, _, found, _ in got) >= 0.95 * sum(n for _, n, _, _ in got), got
    assert sum(same for *_, same in got) >= 0.9 * sum(n for _, n, _, _ in got), got


def test_references_that_stand_for_garbled_signs(spark):
    good = [(i, f"{t} {i:c<{i % 7}}") for i, t in enumerate(list(CLEAN.values()) * 10)]
    rows = [(900, "f&Atilde;&frac14;r &amp; more"), (901, "f&uuml;r &amp; &lt;b&gt;"), (902, "a &amp; b; c & d"), (903, "&#195;&#188;ber")]
    got = {r["doc_id"]: r for r in garble.repair(spark.createDataFrame(good + rows, "doc_id bigint, text string")).collect()}
    assert got[900]["garbled"] and got[900]["restored"] == "für &amp; more" and got[903]["restored"] == "über"
    assert not any(got[i]["garbled"] for i in (901, 902)) and all(got[i]["restored"] == dict(rows)[i] for i in (901, 902))
