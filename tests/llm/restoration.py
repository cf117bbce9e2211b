"""How many misread texts are found and restored exactly: python -m tests.llm.restoration [SF_DIR].

Clean documents beyond ASCII of the table (those not found garbled) are misread, PER_WAY for each
pair of charsets, in whole; the rest of the corpus stays as it is. Prints one line per pair.
"""

import random
import sys

from strandframe.llm import garble

PER_WAY = 30
# (charset the bytes are in, charset they were read in), after each other where texts were misread twice
WAYS = [
    [("utf_8", "cp1252")], [("utf_8", "latin_1")], [("utf_8", "mac_roman")], [("utf_8", "cp437")], [("utf_8", "cp850")], [("utf_8", "cp1250")], [("utf_8", "cp1251")],
    [("cp1251", "cp1252")], [("koi8_r", "cp1251")], [("cp866", "cp1251")], [("cp1252", "mac_roman")], [("cp850", "cp1252")], [("euc_jp", "latin_1")], [("cp932", "cp1252")],
    [("utf_8", "cp1252"), ("utf_8", "cp1252")], [("utf_8", "latin_1"), ("utf_8", "cp1252")],
]


def misread(text: str, real: str, read: str) -> str:
    """Bytes of a text in one charset, read in another; bytes it leaves undefined become control signs."""
    table = []
    for b in range(256):
        try:
            table.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            table.append(chr(b))
    return "".join(table[b] for b in text.encode(real))


def misread_all(text: str, way: list[tuple[str, str]]) -> str | None:
    try:
        for real, read in way:
            text = misread(text, real, read)
    except UnicodeEncodeError:
        return None
    return text


def plant(texts: dict[int, str], per_way: int, seed: int = 1) -> tuple[dict[int, str], dict[int, int]]:
    """(texts with some misread, which way each of these was misread)."""
    rng = random.Random(seed)
    open_, out, way_of = sorted(texts), dict(texts), {}
    rng.shuffle(open_)
    for w, way in enumerate(WAYS):
        n = 0
        for i in list(open_):
            if n == per_way:
                break
            if sum(c > "\x7f" for c in texts[i]) >= 3 and (bad := misread_all(texts[i], way)) is not None and bad != texts[i]:
                out[i], way_of[i] = bad, w
                open_.remove(i)
                n += 1
    return out, way_of


def measure(spark, sf_dir: str, per_way: int = PER_WAY) -> list[tuple[str, int, int, int]]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    garbled = {r["doc_id"] for r in garble.repair(docs).where("garbled").select("doc_id").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.where("text <> ''").collect()}
    clean = {i: t for i, t in texts.items() if i not in garbled}
    planted, way_of = plant({i: t for i, t in clean.items() if not t.isascii()}, per_way)
    corpus = spark.createDataFrame(list({**texts, **planted}.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in garble.repair(corpus).where("garbled").collect()}
    out = []
    for w, way in enumerate(WAYS):
        ids = [i for i, x in way_of.items() if x == w]
        out.append((" then ".join(f"{a} as {b}" for a, b in way), len(ids), sum(i in got for i in ids), sum(i in got and got[i]["restored"] == clean[i] for i in ids)))
    return out


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    rows = measure(session, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
    for name, n, found, same in rows:
        print(f"{name:45} {n:4} misread, {found:4} found, {same:4} restored exactly")
    print(f"{'all':45} {sum(r[1] for r in rows):4} misread, {sum(r[2] for r in rows):4} found, {sum(r[3] for r in rows):4} restored exactly")
