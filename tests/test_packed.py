import random
import re

import pyarrow as pa
import pytest

from strandframe.operators import packed


def plain_tagged(text):
    """The rules, letter by letter."""
    marks, i, n = {}, 0, len(text)

    def scan(skip):
        state, opened, inside, escape, at = "", -1, [False] * n, set(), 0
        opening = None
        while at < n:
            c = text[at]
            if c in "\"'" and at not in skip:
                back = 0
                while at - back - 1 >= 0 and text[at - back - 1] == "\\":
                    back += 1
                if back % 2:
                    escape.add(at - 1)
                elif state == c:
                    if at + 1 < n and text[at + 1] == c and at + 1 not in skip:
                        escape.add(at)
                        at += 2
                        continue
                    for k in range(opening, at + 1):
                        inside[k] = True
                    state = ""
                elif not state and (at == 0 or text[at - 1] in " \t;,|="):
                    state, opening = c, at
            at += 1
        return inside, escape, opening if state else None

    skip = set()
    while True:
        inside, escape, left = scan(skip)
        if left is None:
            break
        skip.add(left)
    members, cur = [], []
    for k, c in enumerate(text):
        if c in ";,|" and not inside[k]:
            members.append(cur)
            cur = []
        else:
            cur.append(k)
    members.append(cur)
    out = []
    for m in members:
        while m and text[m[0]] in " \t":
            m = m[1:]
        while m and text[m[-1]] in " \t":
            m = m[:-1]
        if not m:
            continue
        k = 0
        while k < len(m) and not (text[m[k]] in " \t=" and not inside[m[k]]):
            k += 1
        tag, rest = m[:k], m[k:]
        while rest and text[rest[0]] in " \t":
            rest = rest[1:]
        if rest and text[rest[0]] == "=":
            rest = rest[1:]
            while rest and text[rest[0]] in " \t":
                rest = rest[1:]
        if len(rest) > 1 and text[rest[0]] in "\"'" and text[rest[0]] == text[rest[-1]] and all(inside[x] for x in rest):
            rest = rest[1:-1]
        value = "".join(text[x] for x in rest if not (x in escape and inside[x])).strip(" \t")
        out.append((len(out), "".join(text[x] for x in tag), value))
    return out


def tagged(texts):
    row, pos, tag, val = packed.scan_tagged(pa.array(texts, pa.string()))
    return [(int(r), int(p), t, v) for r, p, t, v in zip(row, pos, tag.to_pylist(), val.to_pylist())]


CASES = [
    'gene_id "G1"; note "5\\" probe"; x \'a;b\' ;; k=v|z = "p|q",u "partial, 3\' side"',
    "note 5' end; y 3' side", 'q "unclosed; r 2', 'the "a ""b, c"""; e ""; f " x "', "", "  ", ";;", "lone", ";a=1,b", 'n "a=b"', 'n="k, l"', 'w "x" "y"; z 1', "a \\\"b; c",
]


@pytest.mark.parametrize("text", CASES)
def test_tagged_cases(text):
    assert tagged([text]) == [(0, *x) for x in plain_tagged(text)]


def test_tagged_random_rows_do_not_leak_into_each_other():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b ", '"', "'", ";", ",", "|", " ", "=", "\\"]) for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts = [t for t in texts if not re.search(r"[^ ;,|=]\"\"|[^ ;,|=]''|\"\"\"\"|''''", t) and '""' not in t and "''" not in t]
    want = [(i, *x) for i, t in enumerate(texts) for x in plain_tagged(t)]
    assert tagged(texts) == want


def test_values():
    texts = ['"0,5860,"', None, " 1 ; 2|3,,4", "'1', '22'", "", "7"]
    row, pos, tag, val = packed.scan_values(pa.array(texts, pa.string()))
    assert list(zip(row.tolist(), pos.tolist(), val.to_pylist())) == [(0, 0, "0"), (0, 1, "5860"), (2, 0, "1"), (2, 1, "2"), (2, 2, "3"), (2, 3, "4"), (3, 0, "1"), (3, 1, "22"), (5, 0, "7")]
    assert set(tag.to_pylist()) == {""}


def test_operator_nulls_long_texts_clashing_columns_and_empty(spark):
    long = ";".join(f"t{i} {i}" for i in range(200_000))
    df = spark.createDataFrame([(1, long, "9"), (2, None, None), (3, "a 1", "")], "feature_id bigint, attribute string, pos string")
    got = packed.split_packed(df, "feature_id", {"attribute": "tagged", "pos": "values"})
    assert got.where("row_id = 1 and field = 'attribute'").count() == 200_000
    assert sorted(map(tuple, got.where("row_id > 1 or field = 'pos'").collect())) == [("attribute", 3, 0, "a", "1"), ("pos", 1, 0, "", "9")]
    assert packed.split_packed(df.limit(0), "feature_id", {"attribute": "tagged"}).count() == 0
