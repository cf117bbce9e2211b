"""Texts decoded with a wrong character encoding: found, and restored where possible.

Method: best-first graph search. A state is a text; an edge encodes it with the charset it was
wrongly read in and decodes the bytes with another one (or unescapes character references). The
search expands the cheapest state first, keeps a hash set of visited states, and ends at the
cheapest text within reach. The cost of a text is the implausibility of its neighbouring
characters: minus the logarithm of how many distinct texts of the whole corpus hold each pair with
a character beyond ASCII, smoothed by a prior over letter classes (script, case, symbols inside
words, control signs). Words are searched one by one, so partly garbled texts are found too; then
the path that makes the words of a text most plausible together decides for each of them between
that path, a repair of its own and none, since one misreading usually went over a whole text.

Bounds of the search for one word: MAX_EXPANSIONS states are expanded, of paths of up to MAX_STEPS
steps. A word without unnatural pairs never follows states dearer than itself (but for those out
of UTF-8); of others all states are queued, and UPHILL_EXPANSIONS dearer ones are expanded. A word
whose best remaining state could not become a better result even at no cost ends earlier.

A garbled text must not vouch for itself: however often it is delivered it counts once, that one is
taken out for the unnatural pairs of a word that has several of them, and where a word's bytes are valid UTF-8
these count as seen in one other text at most, so that slightly changed copies do not vouch for each
other either.

Two passes over the corpus: pair counts go into a table of fixed size (PAIRS hashed cells, one
partial row per cell and task, combined map-side), which is broadcast, as are the results of the
COMMON_WORDS commonest words, searched once; then the rest is searched in mapInArrow with a
bounded memo per task. Only the distinct texts beyond ASCII are shuffled for the
counts (of plain ones a hash), copies combined map-side; nothing is gathered but the table.

A document is garbled if one of its words gains enough plausibility by leaving the state it is
in, or if character references of a plain word stand for such signs. Where no path helps, it still
is if it holds a replacement sign, or a word most of whose
pairs are unnatural and all but unseen (bytes were lost); such places stay as they are.

Defined results: null and empty texts are never garbled, plain ASCII ones only by their character
references; every input row gives one row; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import codecs
import heapq
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.arrowtext import byte_slices
from strandframe.session import shared_checkpoint

PAIRS = 1 << 18
PRIOR_DOCS = 2.0
#: Least gain in plausibility (decimal orders of magnitude) of a repair into UTF-8, and between other charsets.
GAIN_UTF8, GAIN_OTHER = 1.5, 4.0
#: Repairs of several words of one text by the same path count together: least gain of each and in all.
GAIN_WORD, GAIN_TEXT = 2.0, 6.0
STEP_COST = 0.5
#: A word without a repair is garbled if so many of its pairs are unnatural and rarer than this share of documents.
WILD_PAIRS, WILD_SHARE, WILD_PRIOR = 5, 2e-3, 1e-5
#: Texts that an unnatural pair counts as seen in if only the judged text holds it.
UNSEEN = 0.01
#: What a word gains by the operations that suit its text best; four times that against another repair of its own, where they suit at least four words.
TOGETHER = 2.0
#: Bounds of the search for one word: states expanded, those dearer than the start among them (only for words with unnatural pairs), and steps of a path.
MAX_EXPANSIONS, UPHILL_EXPANSIONS, MAX_STEPS = 16, 3, 4
MEMO_WORDS = 200_000
#: Words searched once for all tasks and broadcast with their results (the commonest ones, none longer than LONG); a task searches the others itself.
COMMON_WORDS, LONG = 1 << 15, 64

# Charsets a text may have been read in, and those its bytes may really be in.
READ_AS = ["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866", "koi8_r", "iso8859_2", "iso8859_5", "cp1253", "cp1254", "cp775", "cp852"]
REALLY = ["utf_8", "cp1252", "mac_roman", "cp850", "cp437", "cp1251", "cp866", "koi8_r", "iso8859_5", "cp1250", "iso8859_2", "euc_jp", "cp932"]

# A word: a run of East Asian signs, or a run of anything else without ASCII blanks.
EAST = "⺀-鿿가-힯豈-﫿＀-￯\U00020000-\U0003ffff"
WORD = re.compile(f"[^\x00-\x20{EAST}]*[^\x00-\x7f{EAST}][^\x00-\x20{EAST}]*")
# What stands between blanks and holds a sign beyond ASCII; tried only where such a stretch begins, so in linear time.
TOKEN = re.compile("(?<![^\x00-\x20])[\x21-\x7f]*+[^\x00-\x7f][^\x00-\x20]*")
# A word of plain letters that holds a character reference.
REFERENCE = re.compile("[^\x00-\x20&]*(?:&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{2,7}|#[xX][0-9A-Fa-f]{2,6});[^\x00-\x20&]*)+")
_DIGITS = re.compile("[0-9]")


@lru_cache(maxsize=200_000)
def _keys(token: str) -> tuple[str, ...]:
    """The words of what stands between blanks, their digits folded into one."""
    return tuple({_DIGITS.sub("0", w) for w in WORD.findall(token)})


def _classes(codes: np.ndarray) -> np.ndarray:
    """Code points folded for counting: digits, blanks and large scripts into one sign each."""
    x = codes.astype(np.int64)
    x = np.where((x >= 48) & (x <= 57), 48, x)
    x = np.where(x <= 32, 32, x)
    x = np.where((x >= 0x3041) & (x <= 0x309F), 0x3042, x)
    x = np.where((x >= 0x30A0) & (x <= 0x30FF), 0x30A2, x)
    x = np.where((x >= 0x3400) & (x <= 0x9FFF) | (x >= 0x20000) & (x < 0x40000), 0x4E00, x)
    return np.where((x >= 0xAC00) & (x <= 0xD7AF), 0xAC00, x)


def _cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * 0x9E3779B1 + b * 0x85EBCA6B + ((a * b) ^ (b << 7))) & 0xFFFFFFFF
    return ((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 14


@lru_cache(maxsize=65536)
def _class(c: str) -> int:
    return int(_classes(np.array([ord(c)]))[0])


def _cell(a: int, b: int) -> int:
    """_cells for one pair, without the overhead of arrays."""
    h = (a * 0x9E3779B1 + b * 0x85EBCA6B + ((a * b) ^ (b << 7))) & 0xFFFFFFFF
    return ((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 14


def tally(df: DataFrame, text_col: str = "text") -> DataFrame:
    """cell, word, n: distinct texts per hashed pair (cell -1: all distinct texts), and of the commonest words of each task.

    At most PAIRS cells and COMMON_WORDS words leave a task. The word counts only choose what is
    searched ahead; a task that meets too many words forgets the rarest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs, words = np.zeros(PAIRS, np.int64), 0, Counter()
        for batch in batches:
            column = batch.column(0)
            for i, j in byte_slices(column, 1_000_000):
                texts = [t for t in column.slice(i, j - i).to_pylist() if t]
                docs += len(texts)
                texts = [t for t in texts if not t.isascii()]
                if not texts:
                    continue
                for t in texts:
                    words.update({w for x in set(TOKEN.findall(t)) for w in _keys(x) if len(w) <= LONG})
                if len(words) > MEMO_WORDS:
                    words = Counter(dict(words.most_common(COMMON_WORDS)))
                texts = [f" {t} " for t in texts]
                codes = _classes(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
                doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
                a, b = codes[:-1], codes[1:]
                ok = ((a > 127) | (b > 127)) & (doc[:-1] == doc[1:])
                total += np.bincount(np.unique(doc[:-1][ok] * PAIRS + _cells(a[ok], b[ok])) % PAIRS, minlength=PAIRS)
        at = np.flatnonzero(total)
        common = words.most_common(COMMON_WORDS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array([-1]), pa.array(at), pa.nulls(len(common), pa.int64())]), pa.concat_arrays([pa.nulls(len(at) + 1, pa.string()), pa.array([w for w, _ in common], pa.string())]),
                pa.concat_arrays([pa.array([docs]), pa.array(total[at]), pa.array([n for _, n in common], pa.int64())]),
            ],
            ["cell", "word", "n"],
        )

    text = F.col(text_col).cast("string")
    once = df.where(text != "").select(F.when(F.octet_length(text) == F.length(text), F.hex(F.xxhash64(text))).otherwise(text).alias("text")).distinct()
    # a few rows, read twice: written to the shared folder
    return shared_checkpoint(once.mapInArrow(run, "cell bigint, word string, n bigint").groupBy("cell", "word").agg(F.sum("n").alias("n")))


def pair_counts(tallied: DataFrame) -> tuple[np.ndarray, int]:
    """(distinct texts per hashed pair, distinct texts); PAIRS cells at most reach the driver."""
    rows = tallied.where(F.col("cell").isNotNull()).select("cell", "n").toArrow()
    cell, n = rows["cell"].to_numpy(), rows["n"].to_numpy()
    counts = np.zeros(PAIRS, np.int64)
    counts[cell[cell >= 0]] = n[cell >= 0]
    return counts, int(n[cell < 0].sum())


@lru_cache(maxsize=65536)
def _kind(c: str) -> str:
    """Letter class of a sign: script and case, or what else it is."""
    o = ord(c)
    if o < 128:
        return "Ll" if c.islower() else "Lu" if c.isupper() else "0" if c.isdigit() else " " if o <= 32 else "p"
    category = unicodedata.category(c)
    if o < 0xA0 or o == 0xFFFD or category in ("Cn", "Co", "Cs"):
        return "bad"
    if category[0] in "LM":
        name = unicodedata.name(c, "").split(" ")[0]
        if name in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "IDEOGRAPHIC", "FULLWIDTH", "HALFWIDTH", "KATAKANA-HIRAGANA"):
            return "east"
        if category == "Mn":
            return "mark"
        script = {"CYRILLIC": "C", "GREEK": "G", "LATIN": "X"}.get(name, "O")
        return script + ("u" if category == "Lu" else "l")
    if category in ("Pi", "Pf", "Pd", "Ps", "Pe", "Po") or c == "…":
        return "quote"
    if 0x3000 <= o <= 0x30FF:
        return "east"
    return "emoji" if o >= 0x1F000 or 0x2600 <= o <= 0x27BF or o in (0x200D, 0xFE0F) else "sign"


def _member(c: str) -> float:
    """Implausibility of one sign of a script that the counts fold into one: about the logarithm of the script's size."""
    o = ord(c)
    if 0x3041 <= o <= 0x30FF:
        return 1.5
    return 2.8 if 0x3400 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7AF or 0x20000 <= o < 0x40000 else 0.0


@lru_cache(maxsize=65536)
def _prior(a: str, b: str) -> float:
    """Share of documents that a pair of signs may be expected in, before counting."""
    x, y = _kind(a), _kind(b)
    if "bad" in (x, y):
        return 1e-9
    if x[0] in "LXCGO" and y[0] in "LXCGO" and len(x) == 2 and len(y) == 2:
        same = x[0] == y[0] or {x[0], y[0]} == {"L", "X"}
        if not same:
            return 1e-6
        if x[1] == "l" and y[1] == "u":
            return 1e-5
        return 1e-5 if x[0] == y[0] == "X" else 1e-3
    if "sign" in (x, y):
        other = y if x == "sign" else x
        return 1e-3 if other in (" ", "0", "p") else 1e-5 if other == "sign" else 1e-6
    return 1e-3


class Plausibility:
    """Cost of a text: the implausibility of its neighbouring signs beyond ASCII."""

    def __init__(self, counts: np.ndarray, docs: int):
        self.counts, self.docs = counts, docs
        self.memo: dict[tuple[str, str], float] = {}
        self.before: dict[str, float] = {}

    def pair(self, a: str, b: str) -> float:
        got = self.memo.get((a, b))
        if got is None:
            got = -math.log10((int(self.counts[_cell(_class(a), _class(b))]) + PRIOR_DOCS * _prior(a, b)) / (self.docs + PRIOR_DOCS))
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[a, b] = got
        return got

    def wild(self, word: str) -> bool:
        """Whether most pairs of a word are both unnatural and all but unseen in the corpus."""
        word = f" {word} "
        pairs = [(a, b) for a, b in zip(word, word[1:]) if a > "\x7f" or b > "\x7f"]
        rare = WILD_SHARE * self.docs
        bad = sum(1 for a, b in pairs if _prior(a, b) <= WILD_PRIOR and 10 ** -self.pair(a, b) * (self.docs + PRIOR_DOCS) <= max(rare, 1))
        return bad >= WILD_PAIRS and bad >= 0.5 * len(pairs)

    def cost(self, word: str, held: dict[tuple[str, str], float] | None = None, most: float = math.inf) -> float:
        """Sum over the pairs of a word; infinite as soon as it exceeds `most`."""
        total, a, memo = 0.0, " ", self.memo
        for c in word + " ":
            if a > "\x7f" or c > "\x7f":
                got = memo.get((a, c))
                total += self.pair(a, c) if got is None else got
                if held and (a, c) in held:
                    total += held[a, c]
                if c > "\u2fff":
                    total += _member(c)
                if total > most:
                    return math.inf
            a = c
        return total

    def as_is(self, word: str) -> float:
        """Cost of a word where it stands, its own text taken out; remembered."""
        got = self.before.get(word)
        if got is None:
            if len(self.before) > MEMO_WORDS:
                self.before.clear()
            got = self.before[word] = self.cost(word, self.held(word)[0])
        return got

    def held(self, word: str) -> tuple[dict[tuple[str, str], float], dict[tuple[str, str], float]]:
        """By how much each unnatural pair of a word costs more: without the word's own text, and seen in one other text at most.

        The own text is taken out where several pairs speak; of one or two rare signs it is all there is to know.
        """
        padded, out = f" {word} ", ({}, {})
        pairs = [(a, b) for a, b in zip(padded, padded[1:]) if (a > "\x7f" or b > "\x7f") and _prior(a, b) <= WILD_PRIOR]
        for a, b in pairs:
            n = int(self.counts[_cell(_class(a), _class(b))])
            if len(pairs) >= WILD_PAIRS:
                n = max(n - 1, UNSEEN)
            for more, seen in zip(out, (n, min(n, 1))):
                more[a, b] = -math.log10((seen + PRIOR_DOCS * _prior(a, b)) / (self.docs + PRIOR_DOCS)) - self.pair(a, b)
        return out


@lru_cache(maxsize=None)
def _bytes_of(charset: str) -> dict[int, int]:
    """Sign to byte of a charset; bytes that it leaves undefined were read as control signs."""
    table: dict[int, int] = {}
    for b in range(256):
        try:
            table[ord(bytes([b]).decode(charset))] = b
        except UnicodeDecodeError:
            table[b] = b
    if charset in ("cp1252", "cp1254", "cp1250", "cp1251", "cp1253"):
        for b in range(128, 160):
            table.setdefault(b, b)
    return table


def _lost_byte(raw: bytes, scorer: Plausibility) -> str | None:
    """UTF-8 in which a continuation byte was lost (an invisible sign, dropped on the way)."""
    out, i = "", 0
    while i < len(raw):
        b = raw[i]
        n = 1 if b < 128 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        if not n:
            return None
        try:
            out += raw[i : i + n].decode()
            i += n
        except UnicodeDecodeError:
            if b != 0xC3:
                return None
            after = chr(raw[i + 1]) if i + 1 < len(raw) and raw[i + 1] < 128 else " "
            before = out[-1:] or " "
            out += min((chr(0x40 + 0x80 + k) for k in (*range(0x20), 0x20, 0x2D)), key=lambda c: scorer.pair(before, c) + scorer.pair(c, after))
            i += 1
    return out


def _in_part(word: str, table: dict[int, int]) -> str | None:
    """UTF-8 read from the runs that a charset covers; signs outside it were never garbled."""
    out, run, changed = "", bytearray(), False
    try:
        for c in word:
            if (b := table.get(ord(c))) is not None:
                run.append(b)
                continue
            changed |= any(x > 127 for x in run)
            out += run.decode() + c
            run.clear()
        changed |= any(x > 127 for x in run)
        return out + run.decode() if changed else None
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=65536)
def _cover(c: str) -> tuple[int, int, int]:
    """Bits of the charsets in READ_AS that hold a sign, that hold it as a byte leading a UTF-8 sequence, and as a continuing one."""
    held = lead = follow = 0
    for i, read in enumerate(READ_AS):
        if (b := _bytes_of(read).get(ord(c))) is not None:
            held |= 1 << i
            lead |= (0xC2 <= b < 0xF5) << i
            follow |= (0x80 <= b < 0xC0) << i
    return held, lead, follow


def neighbours(word: str, scorer: Plausibility) -> Iterator[tuple[str, str, bool]]:
    """(operation, text, whether UTF-8 bytes came out) of every edge that leaves a state."""
    if "&" in word and (plain := html.unescape(word)) != word:
        yield "unescape", plain, False
    whole, utf8, before = -1, 0, 0
    for c in word:
        held, lead, follow = _cover(c)
        whole &= held
        utf8 |= before & follow  # some sequence may be UTF-8 only if a leading byte meets a continuing one
        before = lead
    seen: set[bytes] = set()
    for i, read in enumerate(READ_AS):
        table, bit = _bytes_of(read), 1 << i
        if not whole & bit:
            if utf8 & bit and (text := _in_part(word, table)) is not None:
                yield f"{read}>utf_8", text, True
            continue
        raw = codecs.charmap_encode(word, "strict", table)[0]
        if raw in seen:  # another charset gave the same bytes
            continue
        seen.add(raw)
        for real in REALLY:
            if real == read or real == "utf_8" and not utf8 & bit and 0xC3 not in raw:
                continue
            try:
                text = raw.decode(real)
            except UnicodeDecodeError:
                if real == "utf_8" and read in ("cp1252", "mac_roman") and 0xC3 in raw and (guess := _lost_byte(raw, scorer)):
                    yield f"{read}>lost", guess, False
                continue
            if text != word:
                yield f"{read}>{real}", text, real == "utf_8"


def _need(op: str, state: str, utf8: bool, steps: int = 0) -> float:
    """Least gain of an edge; many byte pairs are some East Asian sign, so those must gain with every sign, and more after earlier steps."""
    if op.endswith((">euc_jp", ">cp932")):
        return max(GAIN_OTHER, 1.2 * (1 + steps) * sum(c > "\x7f" for c in state))
    return GAIN_UTF8 if utf8 else 0.0 if op == "unescape" else GAIN_OTHER


def search(word: str, scorer: Plausibility) -> tuple[str, str, float, float]:
    """(cheapest text within reach, path of operations, gain, gain that its path needs).

    The queue gives the cheapest state first. A state dearer than the start may still lead to a
    cheap text: of a word with unnatural pairs all states are queued, and up to UPHILL_EXPANSIONS
    dearer ones are expanded; of a natural word dearer states lead nowhere that could be believed, and
    only those that came out of UTF-8 are queued. The search ends early where the least cost that
    a further step could reach would no longer be a better result.
    """
    held = ({}, *scorer.held(word))  # after several steps, after the first one, and once UTF-8 came out
    starts = tuple(scorer.cost(word, h) for h in held)
    unnatural = bool(held[1])
    best = (word, "", 0.0, 0.0)
    queue: list[tuple[float, int, str, str, float, int]] = [(starts[0], 0, word, "", 0.0, 0)]
    visited = {hash(word)}
    order = uphill = 0
    for _ in range(MAX_EXPANSIONS):
        if not queue:
            break
        cost, _, state, path, need, was = heapq.heappop(queue)
        gain = starts[was] - cost
        if path and gain > 0 and gain - need > best[2] - best[3]:
            best = (state, path, gain, need)
        elif path and not best[1] and gain > best[2]:
            best = (state, path, gain, need)
        steps = path.count("|") + bool(path)
        if steps >= MAX_STEPS:
            continue
        if path and max(starts) - STEP_COST * steps - need <= best[2] - best[3]:  # even a text that costs nothing would be no better
            continue
        if path and gain < 0:
            if was != 2:
                if uphill >= UPHILL_EXPANSIONS:
                    continue
                uphill += 1
        for op, text, utf8 in neighbours(state, scorer):
            if (h := hash(text)) in visited:
                continue
            visited.add(h)
            now = 2 if utf8 or was == 2 else 0 if path else 1
            price = scorer.cost(text, held[now], math.inf if unnatural or utf8 else starts[now]) + STEP_COST * steps
            order += 1
            if price < starts[now] or utf8 or unnatural and price < math.inf:
                heapq.heappush(queue, (price, order, text, f"{path}|{op}" if path else op, max(need, _need(op, state, utf8, steps)), now))
    if (not best[1] or best[2] < best[3]) and scorer.wild(word):
        return word, best[1] if best[1] and best[2] >= GAIN_WORD else "wild", best[2], -1.0
    return best


@lru_cache(maxsize=200_000)
def walk(word: str, path: str) -> str | None:
    """The text at the end of a path from a word; None where the path does not lead."""
    for op in path.split("|"):
        if op == "unescape":
            word = html.unescape(word)
            continue
        read, real = op.split(">")
        if real == "lost":
            return None
        table = _bytes_of(read)
        try:
            word = codecs.charmap_encode(word, "strict", table)[0].decode(real)
        except UnicodeEncodeError:
            part = _in_part(word, table) if real == "utf_8" else None
            if part is None:
                return None
            word = part
        except UnicodeDecodeError:
            return None
    return word


def coherent(words: list[str], paths: set[str], scorer: Plausibility) -> tuple[str, dict[str, str]]:
    """(the path that makes the words of a text most plausible together, what it makes of each word that it improves)."""
    best: tuple[float, str, dict[str, str]] = (0.0, "", {})
    before = {w: scorer.as_is(w) for w in words}
    for path in sorted(paths):
        total, texts = 0.0, {}
        for w in words:
            text = walk(w, path)
            # almost any bytes are some East Asian signs: each of them must gain
            need = _need(path, w, False) if path.endswith((">euc_jp", ">cp932")) else 0.0
            if text is not None and text != w and (gain := before[w] - scorer.cost(text) - need) > -TOGETHER:
                total += max(gain, 0.0)
                texts[w] = text
        if total > best[0]:
            best = (total, path, texts)
    return best[1], best[2]


def repair_references(text: str, scorer: Plausibility, memo: dict[str, tuple[str, str, float, float]]) -> tuple[str, set[str]]:
    """(text, operations): words whose character references stand for garbled signs, repaired; other references stay as they are."""
    ops: set[str] = set()

    def fix(m: re.Match) -> str:
        plain = html.unescape(m[0])
        if plain.isascii() or not m[0].isascii():
            return m[0]
        got = memo.get(plain)
        if got is None:
            got = memo[plain] = search(plain, scorer)
        state, path, gain, need = got
        if not path or path == "wild" or need < 0 or gain < need or ">" not in path:
            return m[0]
        ops.add(f"unescape|{path}")
        return state

    return REFERENCE.sub(fix, text), ops


def repair_text(text: str, scorer: Plausibility, memo: dict[str, tuple[str, str, float, float]]) -> tuple[bool, str, str]:
    """(garbled, restored text, operations used)."""
    if "&" in text and REFERENCE.search(text):
        text, ops = repair_references(text, scorer, memo)
        if ops:
            _, text, more = repair_text(text, scorer, memo)
            return True, text, ", ".join(sorted({*ops, *more.split(", ")} - {""}))
    if text.isascii():
        return False, text, ""
    found: dict[str, tuple[str, str, float, float]] = {}
    # a word never spans blanks: only the distinct tokens beyond ASCII are looked into
    for key in {w for t in set(TOKEN.findall(text)) for w in _keys(t)}:
        if (got := memo.get(key)) is None:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            got = memo[key] = search(key, scorer)
        found[key] = got
    gains: dict[str, list[float]] = {}
    for _, path, gain, _ in found.values():
        if path and gain >= GAIN_WORD:
            gains.setdefault(path, []).append(gain)
    trusted = {p for p, x in gains.items() if p not in ("wild", "unescape") and len(x) > 1 and sum(x) >= GAIN_TEXT}
    ops: set[str] = set()
    fixes: set[str] = set()
    for key, (_, path, gain, need) in found.items():
        if need < 0:
            ops.add("wild")
        elif path and path != "unescape" and (gain >= need or path in trusted and gain >= GAIN_WORD):
            ops.add(path)
            fixes.add(key)
    if not fixes:
        return bool(ops) or "\ufffd" in text, text, ", ".join(sorted(ops))

    # one misreading usually went over the whole text: the path that suits its words best together decides for each of them
    shared, improved = coherent(list(found), {found[k][1] for k in fixes}, scorer)
    against = TOGETHER * min(len(improved), 4)

    def fix(m: re.Match) -> str:
        key = _DIGITS.sub("0", m[0])
        if key in improved and (key not in fixes or found[key][1] == shared or scorer.cost(improved[key]) - against <= scorer.cost(found[key][0])):
            return walk(m[0], shared) or m[0]
        if key not in fixes:
            return m[0]
        return found[key][0] if key == m[0] else search(m[0], scorer)[0]

    return True, WORD.sub(fix, text), ", ".join(sorted(ops))


def repair(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, garbled, lost (a replacement sign remains), operations and restored text of every row."""
    spark = df.sparkSession
    tallied = tally(df, text_col)
    shared = spark.sparkContext.broadcast(pair_counts(tallied))

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Plausibility(*shared.value)
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = [search(w, scorer) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.float64())))], ["word", "state", "path", "gain", "need"])

    # the commonest words, spread over the tasks; what comes back is bounded by COMMON_WORDS and LONG
    common = tallied.where(F.col("word").isNotNull()).orderBy(F.desc("n"), "word").limit(COMMON_WORDS).select("word").repartition(max(spark.sparkContext.defaultParallelism, 1))
    searched = common.mapInArrow(ahead, "word string, state string, path string, gain double, need double").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(searched["word"].to_pylist(), zip(*(searched[c].to_pylist() for c in ("state", "path", "gain", "need"))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, memo = Plausibility(*shared.value), dict(known.value)
        for batch in batches:
            for i, j in byte_slices(batch.column(1), 1_000_000):
                part = batch.slice(i, j - i)
                out = [repair_text(t, scorer, memo) if t and (not t.isascii() or "&" in t) else (False, t, "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in out], pa.bool_()), pa.array([x[1] is not None and "\ufffd" in x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())],
                    ["id", "garbled", "lost", "operations", "restored"],
                )

    given = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "id bigint, garbled boolean, lost boolean, operations string, restored string").withColumnRenamed("id", id_col)
