import json
import random

from strandframe.operators.nested import flatten_evaluations


def value(x):
    while isinstance(x, str) and x.strip()[:1] in ("[", "{"):
        try:
            x = json.loads(x)
        except ValueError:
            break
    return x


def brute(eid, payload):
    out = []
    try:
        top = value(json.loads(payload))
    except (TypeError, ValueError):
        return out
    if not isinstance(top, dict):
        return out

    def below(node, seq):
        for key in ("genomic_elements", "homology"):
            for m, x in enumerate(value(seq.get(key)) or []):
                x = value(x)
                if isinstance(x, dict):
                    out.append((eid, f"{node}.{key}[{m}]", x.get("id")))
                    below(f"{node}.{key}[{m}]", x)

    def occurrence(node, o):
        s = value(o.get("sequence") if isinstance(o, dict) else o[0])
        out.append((eid, node, s.get("id") if isinstance(s, dict) else s))
        if isinstance(s, dict):
            below(node, s)

    items = lambda x: x if isinstance(x, list) else []
    for i, link in enumerate(items(value(top.get("links")))):
        link = value(link)
        for j, g in enumerate(items(value(link.get("occs"))) if isinstance(link, dict) else []):
            g = value(g)
            if isinstance(g, dict) or isinstance(g, list) and g and isinstance(g[0], str) and g[0][:1] not in ("[", "{"):
                occurrence(f"links[{i}].occs[{j}][0]", g)
            elif isinstance(g, list):
                for k, o in enumerate(g):
                    o = value(o)
                    if o:
                        occurrence(f"links[{i}].occs[{j}][{k}]", o)
    motifs = value(top.get("motifs"))
    if isinstance(motifs, dict) and value(motifs.get("motifs")):
        cube, letters = value(motifs["motifs"]), value(motifs["alphabet"])
        for u in range(len(cube[0][0])):
            out.append((eid, f"motifs[{u}]", "".join(letters[max(range(len(p)), key=lambda a: (p[a][u], -a))] for p in cube)))
    return out


def random_payload(rng):
    def seq(depth):
        s = {"id": rng.choice(['a:1-2', 'quo"te', "back\\slash", "é日", "x,}]{["]), "species": "s"}
        for key in ("genomic_elements", "homology"):
            r = rng.random()
            if r < 0.2:
                s[key] = rng.choice([None, []])
            elif r < 0.5 and depth:
                v = [None if rng.random() < 0.2 else seq(depth - 1) for _ in range(rng.randrange(3))]
                s[key] = json.dumps(v) if rng.random() < 0.3 else v
        return s

    def occ():
        r = rng.random()
        if r < 0.4:
            return ["sp:chr1:1-2", rng.randrange(9), "+", 3, -1]
        o = {"sequence": seq(3) if r < 0.8 else "plain:id", "position": 4, "strand": "-"}
        return json.dumps(o) if rng.random() < 0.1 else o

    links = []
    for _ in range(rng.randrange(4)):
        if rng.random() < 0.4:
            occs = [occ() for _ in range(rng.randrange(4))]
        else:
            occs = [[None if rng.random() < 0.1 else occ() for _ in range(rng.randrange(4))] for _ in range(rng.randrange(4))]
        links.append(rng.choice([{"occs": occs, "singleProfile": True}, {"classname": "Link", "occs": occs}]))
    top = {"runID": "r", "nlinks": 3, "links": json.dumps(links) if rng.random() < 0.2 else links}
    if rng.random() < 0.7:
        k, u = rng.randrange(1, 5), rng.randrange(1, 4)
        top["motifs"] = {"motifs": [[[rng.choice([0.0, 0.25, 1.0, 1e-3]) for _ in range(u)] for _ in "ACGT"] for _ in range(k)], "alphabet": list("ACGT"), "metadata": None}
    items = list(top.items())
    rng.shuffle(items)
    return json.dumps(dict(items), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]), separators=rng.choice([(",", ":"), (", ", ": ")]))


BAD = [None, "", "  ", "{", '{"links": [}', "[1]", "null", '{"a": "unclosed', "}{", '{"links": {"occs": 3}}', '{"links": null, "motifs": null}', '{"links": [null, 4, {"occs": null}, {}]}', "[[[]]", '"{}"']


def test_random_against_json(spark):
    rng = random.Random(11)
    rows = [(i, random_payload(rng), "clash") for i in range(400)] + [(1000 + i, b, "clash") for i, b in enumerate(BAD)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "eval_id bigint, payload string, node string")
    got = sorted((r["eval_id"], r["node"], str(r["ident"])) for r in flatten_evaluations(df).where("kind in ('occurrence', 'sequence', 'motif')").collect())
    want = sorted((e, n, str(x)) for i, p, _ in rows for e, n, x in brute(i, p))
    assert got == want


def test_links_parents_and_fields(spark):
    payload = json.dumps({"runID": "q", "nlinks": 7, "trainingTime": 1.5, "links": [{"occs": [[["a", 5, "-", 3, 2]], [{"sequence": {"id": "b", "species": "z", "genome_start": 4, "homology": [{"id": "c", "genome_end": 9}]}, "position": 8}]]}]})
    df = spark.createDataFrame([(1, payload), (1, payload)], "eval_id bigint, payload string")
    rows = flatten_evaluations(df).distinct().collect()
    by = {r["node"]: r for r in rows}
    assert by["$"]["n_links"] == 7 and by["$"]["training_time"] == 1.5 and by["$"]["ident"] == "q"
    a = by["links[0].occs[0][0]"]
    assert (a["position"], a["strand"], a["sitelen"], a["profile_idx"], a["parent"]) == (5, "-", 3, 2, "links[0]")
    assert by["links[0].occs[1][0]"]["species"] == "z" and by["links[0].occs[1][0]"]["genome_start"] == 4
    assert by["links[0].occs[1][0].homology[0]"]["parent"] == "links[0].occs[1][0]" and by["links[0].occs[1][0].homology[0]"]["genome_end"] == 9
    assert all(r["parent"] is None or r["parent"] in by for r in rows)


def test_deep_and_empty(spark):
    node = {"id": "leaf"}
    for i in range(150):
        node = {"id": f"n{i}", "homology": [node]}
    df = spark.createDataFrame([(1, json.dumps({"links": [{"occs": [[{"sequence": node}]]}]}))], "eval_id bigint, payload string")
    assert flatten_evaluations(df).where("kind = 'sequence'").count() == 150
    assert flatten_evaluations(df.limit(0)).count() == 0
