"""Deeply nested evaluation records as flat, linked rows.

Method: vectorised structural indexing. The JSON texts of a batch form one byte array; the
positions of its unescaped quotes, brackets and delimiters are found in bulk, marks inside
strings are masked by quote parity, and nesting depth is a prefix sum over the brackets. A
stable sort by depth pairs every bracket with its partner and every delimiter with its
container, which yields a table of nodes (parent, ordinal, key, kind, span). Tables are then
read off level by level, all rows of the batch at a time, and come out as linked rows, each
with its own path and its parent's. Values that arrive as JSON text are indexed in turn.

Runs in mapInArrow without a shuffle of its own; depth is not bounded by a schema.

Defined results: a null, empty or malformed record gives no row; null members keep their
number but give no row; missing fields are null; repeated records repeat their rows (drop
re-delivered ones before); of a repeated key in one object the last counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.arrowtext import arrow_schema, byte_slices, last_true, next_true, spans_to_strings, text_buffers

OBJECT, ARRAY, STRING, SCALAR, NULL = 1, 2, 3, 4, 5

_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\r\n", np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b'"{}[]:,', np.uint8))
_OPEN, _CLOSE = np.isin(np.arange(256), (91, 123)), np.isin(np.arange(256), (93, 125))

SCHEMA = (
    "eval_id bigint, kind string, node string, parent string, ident string, ord int, species string, chromosome string, strand string, genome_start bigint, "
    "genome_end bigint, position bigint, sitelen bigint, profile_idx bigint, n_links bigint, n_links_hit bigint, training_time double"
)


class _Index:
    """Nodes of a batch of JSON documents, as parallel arrays; -1 is 'none'."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = data
        n_docs = len(off) - 1
        self.roots = np.full(n_docs, -1, np.int64)
        self.kind = np.zeros(0, np.int8)
        self.start = self.end = self.parent = self.ordinal = self.key_start = self.key_end = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.order = np.zeros(0, np.int64)
        if len(data):
            self._build(data, off, n_docs)

    def _build(self, data: np.ndarray, off: np.ndarray, n_docs: int) -> None:
        at = np.flatnonzero(_MARK[data])
        doc = np.searchsorted(off, at, side="right") - 1
        quote = data[at] == 34
        if (backs := data == 92).any():
            plain = last_true(~backs)
            q = np.flatnonzero(quote)
            before = np.maximum(np.where(at[q] > 0, plain[np.maximum(at[q] - 1, 0)], -1), off[doc[q]] - 1)
            drop = q[(at[q] - 1 - before) % 2 == 1]
            keep = np.ones(len(at), bool)
            keep[drop] = False
            at, doc, quote = at[keep], doc[keep], quote[keep]
        parity = self._per_doc(quote, doc, n_docs)
        outside = quote | (parity % 2 == 0)
        broken = np.zeros(n_docs, bool)
        np.logical_or.at(broken, doc[np.concatenate((doc[1:] != doc[:-1], [True]))] if len(doc) else doc, (parity[np.concatenate((doc[1:] != doc[:-1], [True]))] % 2 == 1) if len(doc) else quote)
        at, doc, quote = at[outside], doc[outside], quote[outside]
        ch = data[at]
        # brackets must balance; a document where they do not is left out whole
        delta = _OPEN[ch].astype(np.int64) - _CLOSE[ch]
        depth = self._per_doc(delta, doc, n_docs)
        level = depth + _CLOSE[ch]  # a close belongs to the level it closes
        if len(at):
            last = np.concatenate((doc[1:] != doc[:-1], [True]))
            broken[doc[last & (depth != 0)]] = True
            broken[doc[depth < 0]] = True
        if broken.any():
            ok = ~broken[doc]
            at, doc, quote, ch, level = at[ok], doc[ok], quote[ok], ch[ok], level[ok]
        # pairs and containers through a stable sort by level
        opening = _OPEN[ch]
        by = np.argsort(level, kind="stable")
        holder = last_true(opening[by])
        holder = np.where(holder >= 0, by[np.maximum(holder, 0)], -1)  # in sorted order: the last open bracket of this level
        container = np.empty(len(at), np.int64)
        container[by] = holder
        container[level == 0] = -1
        close_of = np.full(len(at), -1, np.int64)
        closing = np.flatnonzero(_CLOSE[ch])
        close_of[container[closing]] = closing
        if len(closing) and not (data[at[closing]] - data[at[container[closing]]] == 2).all():
            wrong = np.unique(doc[closing[data[at[closing]] - data[at[container[closing]]] != 2]])
            broken[wrong] = True
        commas = np.cumsum((ch[by] == 44))
        rank = np.empty(len(at), np.int64)
        rank[by] = commas
        # a value follows each '[', each ',' of an array, each ':' and each document's begin
        in_array = (container >= 0) & (ch[np.maximum(container, 0)] == 91)
        slot = (ch == 91) | ((ch == 44) & in_array) | (ch == 58)
        slots = np.flatnonzero(slot)
        own = np.where(ch[slots] == 91, slots, container[slots])
        ordinal = np.where(ch[slots] == 91, 0, rank[slots] - rank[np.maximum(own, 0)])
        docs = np.flatnonzero(~broken & (np.diff(off) > 0))
        solid = next_true(~_BLANK[data])
        begin = solid[np.concatenate((at[slots] + 1, off[docs]))]
        limit = off[np.concatenate((doc[slots], docs)) + 1]
        follower = np.concatenate((slots + 1, np.searchsorted(at, off[docs])))
        stop = np.where(follower < len(at), at[np.minimum(follower, max(len(at) - 1, 0))] if len(at) else limit, limit)
        stop = np.minimum(stop, limit)
        head = np.where(begin < limit, data[np.minimum(begin, len(data) - 1)], 93)
        is_string, is_open = head == 34, _OPEN[head]
        empty = _CLOSE[head] | (head == 44) | (head == 58)
        end = np.where(is_open, 0, stop)
        f = np.minimum(follower, max(len(at) - 1, 0))
        if len(at):
            end = np.where(is_open, at[np.maximum(close_of[f], 0)] + 1, end)
            end = np.where(is_string, at[np.minimum(f + 1, len(at) - 1)] + 1, end)
        scalar = ~is_string & ~is_open
        solid_before = last_true(~_BLANK[data])
        end = np.where(scalar, np.maximum(solid_before[np.maximum(end - 1, 0)] + 1, begin), end)
        kind = np.select([head == 123, head == 91, is_string, head == 110], [OBJECT, ARRAY, STRING, NULL], SCALAR).astype(np.int8)
        own = np.concatenate((own, np.full(len(docs), -1)))
        ordinal = np.concatenate((ordinal, np.zeros(len(docs), np.int64)))
        colon = np.concatenate((ch[slots] == 58, np.zeros(len(docs), bool)))
        key_close = np.where(colon, np.concatenate((slots - 1, np.zeros(len(docs), np.int64))), 1) if len(at) else np.zeros(len(docs), np.int64)
        key_start = np.where(colon, at[np.maximum(key_close - 1, 0)] + 1 if len(at) else 0, -1)
        key_end = np.where(colon, at[np.maximum(key_close, 0)] if len(at) else 0, -1)
        doc_of = np.concatenate((doc[slots], docs))
        good = ~empty & ~broken[doc_of]
        number = np.cumsum(good) - 1
        # the parent of a value is the node of the bracket that holds it
        node_of_open = np.full(len(at) + 1, -1, np.int64)
        node_of_open[follower[good & is_open]] = number[good & is_open]
        self.parent = np.where(own >= 0, node_of_open[np.maximum(own, 0)], -1)[good]
        self.kind, self.start, self.end, self.ordinal = kind[good], begin[good], end[good], ordinal[good]
        self.key_start, self.key_end = key_start[good], key_end[good]
        tops = np.flatnonzero(good & (np.arange(len(good)) >= len(slots)))
        self.roots[doc_of[tops]] = number[tops]
        self.order = np.argsort(self.parent, kind="stable")
        self.first = np.searchsorted(self.parent[self.order], np.arange(len(self.parent) + 1))

    @staticmethod
    def _per_doc(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Prefix sums that begin anew in every document."""
        total = np.cumsum(values)
        first = np.searchsorted(doc, np.arange(n_docs))
        base = np.where(first > 0, total[np.minimum(np.maximum(first - 1, 0), max(len(total) - 1, 0))] if len(total) else 0, 0)
        return total - base[doc]


class NodeStore:
    """All indexed documents of one pass; nodes are global numbers."""

    def __init__(self) -> None:
        self.parts: list[_Index] = []
        self.base = [0]

    def add(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        part = _Index(data, off)
        roots = np.where(part.roots >= 0, part.roots + self.base[-1], -1)
        self.parts.append(part)
        self.base.append(self.base[-1] + len(part.kind))
        return roots

    def _each(self, nodes: np.ndarray) -> Iterator[tuple[_Index, int, np.ndarray, np.ndarray]]:
        where = np.searchsorted(self.base, nodes, side="right") - 1
        for k in np.unique(where[nodes >= 0]):
            at = np.flatnonzero((where == k) & (nodes >= 0))
            yield self.parts[k], self.base[k], at, nodes[at] - self.base[k]

    def kinds(self, nodes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(nodes), np.int8)
        for part, _, at, local in self._each(nodes):
            out[at] = part.kind[local]
        return out

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `nodes`, child, its ordinal), in order of place and ordinal."""
        place, child, ordinal = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part, base, at, local in self._each(nodes):
            lo, n = part.first[local], part.first[local + 1] - part.first[local]
            skip = np.concatenate(([0], np.cumsum(n)))[:-1]
            got = part.order[np.arange(n.sum()) - np.repeat(skip - lo, n)]
            place.append(np.repeat(at, n))
            child.append(got + base)
            ordinal.append(part.ordinal[got])
        p, c, o = np.concatenate(place), np.concatenate(child), np.concatenate(ordinal)
        by = np.lexsort((o, p))
        return p[by], c[by], o[by]

    def get(self, nodes: np.ndarray, key: str) -> np.ndarray:
        """The member `key` of each object, resolved; -1 where there is none."""
        name = np.frombuffer(key.encode(), np.uint8)
        out = np.full(len(nodes), -1, np.int64)
        place, child, _ = self.children(np.where(self.kinds(nodes) == OBJECT, nodes, -1))
        for part, _, at, local in self._each(child):
            ks = part.key_start[local]
            ok = part.key_end[local] - ks == len(name)
            ks = np.where(ok, ks, 0)
            for i, c in enumerate(name):
                ok &= part.data[np.minimum(ks + i, len(part.data) - 1)] == c
            out[place[at[ok]]] = child[at[ok]]
        return self.resolve(out)

    def texts(self, nodes: np.ndarray) -> pa.Array:
        """Strings without quotes and escapes, scalars as written, null for other kinds."""
        out: list[pa.Array] = []
        spots: list[np.ndarray] = []
        for part, _, at, local in self._each(nodes):
            kind = part.kind[local]
            ok = (kind == STRING) | (kind == SCALAR)
            at, local, kind = at[ok], local[ok], kind[ok]
            quoted = (kind == STRING).astype(np.int64)
            values = spans_to_strings(part.data, part.start[local] + quoted, part.end[local] - quoted)
            escaped = pc.and_(pc.match_substring(values, "\\"), pa.array(kind == STRING))
            if pc.any(escaped).as_py():
                values = pc.replace_with_mask(values, escaped, pa.array([_unescape(x) for x in values.filter(escaped).to_pylist()], pa.string()))
            out.append(values)
            spots.append(at)
        where = np.full(len(nodes), -1, np.int64)
        if spots:
            flat = np.concatenate(spots)
            where[flat] = np.arange(len(flat))
        pool = pa.concat_arrays(out) if out else pa.array([], pa.string())
        return pool.take(pa.array(where, pa.int64(), mask=where < 0))

    def numbers(self, nodes: np.ndarray, integer: bool = True) -> pa.Array:
        got = self.texts(nodes)
        # whole numbers of 19 digits fit up to the greatest of 64 bits
        ok = pc.fill_null(pc.match_substring_regex(got, r"^[+-]?0*([0-9]{1,18}|[1-8][0-9]{18}|9[01][0-9]{17}|92[01][0-9]{16}|922[0-2][0-9]{15})$" if integer else r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), False)
        return pc.cast(pc.if_else(ok, got, pa.scalar(None, pa.string())), pa.int64() if integer else pa.float64())

    def resolve(self, nodes: np.ndarray) -> np.ndarray:
        """Nodes whose string is itself a JSON array or object are replaced by that value."""
        for _ in range(64):
            text = np.flatnonzero(self.kinds(nodes) == STRING)
            if not len(text):
                return nodes
            values = self.texts(nodes[text])
            inner = np.asarray(pc.fill_null(pc.match_substring_regex(values, r"^\s*[\[{]"), False))
            if not inner.any():
                return nodes
            off, data, _ = text_buffers(values.filter(pa.array(inner)))
            roots = self.add(data, off)
            nodes = nodes.copy()
            at = text[inner]
            nodes[at[roots >= 0]] = roots[roots >= 0]
            if (roots < 0).all():
                return nodes
        return nodes


def _unescape(x: str) -> str:
    try:
        return json.loads(f'"{x}"', strict=False)
    except ValueError:
        return x


def _path(parent: pa.Array, *parts: object) -> pa.Array:
    return pc.binary_join_element_wise(parent, *[p if isinstance(p, (pa.Array, pa.ChunkedArray)) else pa.scalar(p, pa.string()) for p in parts], "")


def _int_text(x: np.ndarray) -> pa.Array:
    return pc.cast(pa.array(x, pa.int64()), pa.string())


def _motifs(store: NodeStore, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """(document, motif number, letters of the largest value at each position, joined)."""
    holder = store.get(roots, "motifs")
    cube = store.get(holder, "motifs")
    alphabet = store.get(holder, "alphabet")
    doc, position, pos = store.children(np.where(store.kinds(cube) == ARRAY, cube, -1))
    p_place, letter, let = store.children(np.where(store.kinds(r := store.resolve(position)) == ARRAY, r, -1))
    l_place, value, motif = store.children(np.where(store.kinds(r := store.resolve(letter)) == ARRAY, r, -1))
    number = store.numbers(value, integer=False).to_numpy(zero_copy_only=False)
    d, p, a = doc[p_place[l_place]], pos[p_place[l_place]], let[l_place]
    ok = ~np.isnan(number)
    d, p, a, m, number = d[ok], p[ok], a[ok], motif[ok], number[ok]
    by = np.lexsort((a, -number, p, m, d))  # ties: the first letter
    d, p, a, m = d[by], p[by], a[by], m[by]
    top = np.ones(len(d), bool)
    top[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (p[1:] != p[:-1])
    d, a, m = d[top], a[top], m[top]
    a_doc, a_node, a_ord = store.children(np.where(store.kinds(alphabet) == ARRAY, alphabet, -1))
    letters = store.texts(a_node)
    single = store.texts(np.where(store.kinds(alphabet) == STRING, alphabet, -1))  # an alphabet given as one text
    spelled = [(i, k, c) for i, x in enumerate(single.to_pylist()) if x for k, c in enumerate(x)]
    a_doc = np.concatenate((a_doc, np.array([x[0] for x in spelled], np.int64)))
    a_ord = np.concatenate((a_ord, np.array([x[1] for x in spelled], np.int64)))
    letters = pa.concat_arrays([letters, pa.array([x[2] for x in spelled], pa.string())])
    width = int(max(a_ord.max(initial=-1), a.max(initial=-1))) + 1
    code = a_doc * width + a_ord
    by = np.argsort(code, kind="stable")
    want = d * width + a
    hit = np.searchsorted(code[by], want)
    found = hit < len(code)
    found[found] = code[by][hit[found]] == want[found]
    spots = np.where(found, by[np.minimum(hit, max(len(by) - 1, 0))] if len(by) else -1, -1)
    drawn = letters.take(pa.array(spots, pa.int64(), mask=spots < 0))
    head = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (m[1:] != m[:-1])))) if len(d) else np.zeros(0, np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate((head, [len(d)])), pa.int32()), drawn), pa.scalar("", pa.string()))
    return d[head], m[head], joined


def flatten_batch(ids: pa.Array, payloads: pa.Array) -> Iterator[pa.Table]:
    """The linked tables of one batch of records, one Arrow table per kind of row."""
    store = NodeStore()
    off, data, _ = text_buffers(payloads)
    roots = store.resolve(store.add(data, off))
    real = np.flatnonzero(store.kinds(roots) == OBJECT)
    roots = roots[real]
    ids = ids.take(pa.array(real))

    def rows(kind: str, doc: np.ndarray, node: pa.Array, parent: pa.Array, ident: pa.Array, order: np.ndarray, **more: pa.Array) -> pa.Table:
        n = len(doc)
        have = {"eval_id": ids.take(pa.array(doc)), "kind": pa.array([kind], pa.string()).take(pa.array(np.zeros(n, np.int64))), "node": node, "parent": parent, "ident": ident, "ord": pa.array(order, pa.int32()), **more}
        return pa.table([have[f.name].cast(f.type) if f.name in have else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)

    def described(seq: np.ndarray) -> dict[str, pa.Array]:
        return {
            "species": store.texts(store.get(seq, "species")), "chromosome": store.texts(store.get(seq, "chromosome")), "strand": store.texts(store.get(seq, "strand")),
            "genome_start": store.numbers(store.get(seq, "genome_start")), "genome_end": store.numbers(store.get(seq, "genome_end")),
        }

    every = np.arange(len(roots))
    top = pa.array(["$"], pa.string()).take(pa.array(np.zeros(len(roots), np.int64)))
    yield rows("run", every, top, pa.nulls(len(roots), pa.string()), store.texts(store.get(roots, "runID")), every * 0,
               n_links=store.numbers(store.get(roots, "nlinks")), n_links_hit=store.numbers(store.get(roots, "nlinksThatHit")), training_time=store.numbers(store.get(roots, "trainingTime"), integer=False))

    links = store.get(roots, "links")
    doc, link, i = store.children(np.where(store.kinds(links) == ARRAY, links, -1))
    link = store.resolve(link)
    ok = store.kinds(link) == OBJECT
    doc, link, i = doc[ok], link[ok], i[ok]
    link_path = _path(pa.array(["links["] * len(i), pa.string()), _int_text(i), "]")
    yield rows("link", doc, link_path, top.take(pa.array(doc)), store.texts(store.get(link, "classname")), i)

    occs = store.get(link, "occs")
    lp, group, j = store.children(np.where(store.kinds(occs) == ARRAY, occs, -1))
    group = store.resolve(group)
    kind = store.kinds(group)
    # an array is one occurrence (a tuple) if it holds a number or a plain text, else a group
    gp, member, k = store.children(np.where(kind == ARRAY, group, -1))
    member = store.resolve(member)
    mk = store.kinds(member)
    is_tuple = np.zeros(len(group), bool)
    is_tuple[gp[(mk == SCALAR) | (mk == STRING)]] = True
    single = (kind == OBJECT) | is_tuple
    grouped = ~is_tuple[gp] & ((mk == OBJECT) | (mk == ARRAY))
    occ = np.concatenate((group[single], member[grouped]))
    at_link = np.concatenate((lp[single], lp[gp[grouped]]))
    at_j = np.concatenate((j[single], j[gp[grouped]]))
    at_k = np.concatenate((np.zeros(int(single.sum()), np.int64), k[grouped]))
    occ_doc = doc[at_link]
    occ_parent = link_path.take(pa.array(at_link))
    occ_path = _path(occ_parent, ".occs[", _int_text(at_j), "][", _int_text(at_k), "]")
    # fields of objects by key, of tuples by place
    place, item, o = store.children(np.where(store.kinds(occ) == ARRAY, occ, -1))

    def field(key: str, spot: int) -> np.ndarray:
        out = store.get(occ, key)
        out[place[o == spot]] = item[o == spot]
        return out

    seq = store.resolve(field("sequence", 0))
    seq_is_object = store.kinds(seq) == OBJECT
    seq_id = store.get(seq, "id")
    ident = store.texts(np.where(seq_is_object, seq_id, seq))
    info = described(seq)
    info["strand"] = store.texts(field("strand", 2))
    yield rows("occurrence", occ_doc, occ_path, occ_parent, ident, at_k, position=store.numbers(field("position", 1)), sitelen=store.numbers(field("sitelen", 3)), profile_idx=store.numbers(field("profileIdx", 4)), **info)

    doc_of, path, node = occ_doc[seq_is_object], occ_path.filter(pa.array(seq_is_object)), seq[seq_is_object]
    while len(node):
        level: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        for key in ("genomic_elements", "homology"):
            below = store.get(node, key)
            at, child, m = store.children(np.where(store.kinds(below) == ARRAY, below, -1))
            child = store.resolve(child)
            ok = store.kinds(child) == OBJECT
            at, child, m = at[ok], child[ok], m[ok]
            parent = path.take(pa.array(at))
            own = _path(parent, f".{key}[", _int_text(m), "]")
            yield rows("sequence", doc_of[at], own, parent, store.texts(store.get(child, "id")), m, **described(child))
            level.append((doc_of[at], own, child))
        doc_of, path, node = np.concatenate([x[0] for x in level]), pa.concat_arrays([x[1] for x in level]), np.concatenate([x[2] for x in level])

    m_doc, m_no, m_text = _motifs(store, roots)
    yield rows("motif", m_doc, _path(pa.array(["motifs["] * len(m_no), pa.string()), _int_text(m_no), "]"), top.take(pa.array(m_doc)), m_text, m_no)


_ARROW = arrow_schema(SCHEMA)


def flatten_evaluations(df: DataFrame, id_col: str = "eval_id", payload_col: str = "payload") -> DataFrame:
    """Rows of kind run, link, occurrence, sequence and motif, each with its path and its parent's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                for out in flatten_batch(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)):
                    yield from out.to_batches()

    return df.select(F.col(id_col).cast("bigint").alias("eval_id"), F.col(payload_col).cast("string").alias("payload")).mapInArrow(run, SCHEMA)
