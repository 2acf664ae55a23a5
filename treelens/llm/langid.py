"""Languages of mixed text: scripts narrow the candidates, Viterbi labels the words.

Words are runs of letters. A language is learnt as the frequencies of the
letter n-grams of its words, and as the scripts that it uses. Each distinct
word of a batch gets a score for each language that uses its script; the best
sequence of languages, with a penalty for each switch, labels the words. All
documents of a batch are one sequence in which a switch between documents is
free, so that blocks of it are worked through side by side.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.session import Shared

from .common import by_bytes, col, pieces, remainder, row_of, unpacked, with_fields

#: First and last code point of the letters of each script (fixed values).
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("arabic", 0x8A0, 0x8FF), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F),
    ("gujarati", 0xA80, 0xAFF), ("oriya", 0xB00, 0xB7F), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F),
    ("sinhala", 0xD80, 0xDFF), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x323AF),
]
NAMES = ["other", *dict.fromkeys(name for name, *_ in SCRIPTS)]
#: No letter and no mark lies beyond, but for variation selectors.
TOP = 0x32400
#: Letters of a word; a longer run is several.
LONGEST = 64
#: A script belongs to a language if this share of its letters is written in it.
SHARE = 0.01
ORDERS = (1, 2, 3, 4)
#: Added to the share of each n-gram, so that an unseen one counts alike for all languages.
FLOOR = 2e-6
#: Score of a language that does not use the script of a word.
NEVER = -1000.0
#: Positions of a block of the sequence.
BLOCK = 128


def code_points() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind (1 letter, 2 mark, 0 other), lower case and script of each code point."""
    kind, lower, script = np.zeros(TOP, np.uint8), np.arange(TOP, dtype=np.uint32), np.zeros(TOP, np.uint8)
    for i in range(TOP):
        c = chr(i)
        k = unicodedata.category(c)[0]
        kind[i] = 1 if k == "L" else 2 if k == "M" else 0
        if k == "L" and len(low := c.lower()) == 1:
            lower[i] = ord(low)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = NAMES.index(name)
    return kind, lower, script


@dataclass
class Model:
    languages: list[str]
    bits: int
    #: n-gram slot x language, log of the share and FLOOR
    table: np.ndarray
    #: script x language: whether it is used
    uses: np.ndarray
    kind: np.ndarray
    lower: np.ndarray
    script: np.ndarray
    penalty: float = 6.0
    #: n-grams of several orders overlap; a word's score is the sum over them, times this
    temper: float = 0.4


@dataclass
class Words:
    """Words of a text: distinct ones by number, with code points one after the other; where each word starts, and how long it is."""

    ids: np.ndarray
    start: np.ndarray
    length: np.ndarray
    codes: np.ndarray
    sizes: np.ndarray
    script: np.ndarray


def words(text: str, kind: np.ndarray, lower: np.ndarray, script: np.ndarray) -> Words:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < TOP, c, 0)
    k = kind[c]
    inside = k > 0
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    first, last = edge[::2], edge[1::2]
    if len(first) and (last - first).max(initial=0) > LONGEST:
        n = -(-(last - first) // LONGEST)
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first, last = np.repeat(first, n) + part * LONGEST, np.minimum(np.repeat(last, n), np.repeat(first, n) + (part + 1) * LONGEST)
    if len(first):
        # marks without a letter are no word
        letters = np.concatenate([[0], np.cumsum(k == 1)])
        some = letters[last] > letters[first]
        first, last = first[some], last[some]
    size = (last - first).astype(np.int64)
    if not len(first):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint32), none, none)
    at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    low = lower[c[at]]
    begin = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(begin, size)
    # a hash of each word stands for it
    power = np.cumprod(np.full(LONGEST, 0x9E3779B97F4A7C15, np.uint64))
    mixed = (low.astype(np.uint64) + np.uint64(0x632BE5AB)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    key = np.add.reduceat(mixed * power[place], begin)
    _, one, ids = np.unique(key, return_index=True, return_inverse=True)
    sizes = size[one]
    pick = np.repeat(begin[one], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes = low[pick]
    heads = codes[np.cumsum(sizes) - sizes]
    return Words(ids.reshape(-1), first, size, codes, sizes, script[heads])


def grams(codes: np.ndarray, sizes: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of the n-grams of words with their edges, and the word of each, by order."""
    wide = sizes + 2
    end = np.cumsum(wide)
    begin = end - wide
    c = np.ones(int(wide.sum()), np.uint64)
    c[end - 1] = 2
    inner = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)) * 2 + 1, sizes)
    c[inner] = codes
    word = np.repeat(np.arange(len(sizes)), wide)
    left = end[word] - np.arange(len(c))
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > len(c):
            return
        h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
        ok = left[: len(h)] >= n
        x = (h[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        yield ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64), word[: len(h)][ok]


def word_scores(m: Model, w: Words, step: int = 1 << 14) -> np.ndarray:
    """Distinct word x language: how much likelier than the best it is, at most 0; alike for all where no language uses the script."""
    out = np.zeros((len(w.sizes), len(m.languages)), np.float32)
    ends = np.cumsum(w.sizes)
    for a in range(0, len(w.sizes), step):
        b = min(a + step, len(w.sizes))
        codes = w.codes[ends[a] - w.sizes[a] : ends[b - 1]]
        for slots, word in grams(codes, w.sizes[a:b], m.bits):
            # every word has an n-gram of each order up to its length with its edges, in order of words
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            if len(starts):
                out[a + word[starts]] += np.add.reduceat(m.table[slots], starts, axis=0)
    out *= m.temper
    uses = m.uses[w.script]
    out = np.where(uses, out, NEVER).astype(np.float32)
    out[~uses.any(1)] = 0
    return np.maximum(out - out.max(1, keepdims=True), NEVER)


def viterbi(score: np.ndarray, ids: np.ndarray, start: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each position: sums of scores, less ``penalty`` for each switch that is at no ``start``."""
    n, size = len(ids), score.shape[1]
    if not n or size == 1:
        return np.zeros(n, np.int64)
    blocks = -(-n // BLOCK)
    score = np.vstack([score, np.zeros((1, size), np.float32)])
    at = np.full(blocks * BLOCK, len(score) - 1)
    at[:n] = ids
    cost = np.full(blocks * BLOCK, penalty, np.float32)
    cost[:n][start] = 0
    at, cost = at.reshape(blocks, BLOCK).T.copy(), cost.reshape(blocks, BLOCK).T.copy()
    # from each language before a block to each at its end
    through = np.where(np.eye(size, dtype=bool), 0, -np.inf).astype(np.float32) + np.zeros((blocks, 1, 1), np.float32)
    for j in range(BLOCK):
        best = through.max(2, keepdims=True) - cost[j][:, None, None]
        through = np.maximum(through, best) + score[at[j]][:, None, :]
    entry = np.zeros((blocks, size), np.float32)
    v = np.zeros(size, np.float32)
    for b in range(blocks):
        entry[b] = v
        v = (v[:, None] + through[b]).max(0)
        v -= v.max()
    back = np.empty((BLOCK, blocks, size), np.int16)
    now, own = entry, np.arange(size, dtype=np.int16)
    for j in range(BLOCK):
        top = now.argmax(1)
        best = np.take_along_axis(now, top[:, None], 1) - cost[j][:, None]
        back[j] = np.where(now >= best, own, top[:, None])
        now = np.maximum(now, best) + score[at[j]]
    came = np.broadcast_to(own, (blocks, size)).astype(np.int64)
    for j in reversed(range(BLOCK)):
        came = np.take_along_axis(back[j], came, 1).astype(np.int64)
    state, exits = int(now[-1].argmax()), np.empty(blocks, np.int64)
    for b, row in zip(range(blocks - 1, -1, -1), came[::-1].tolist()):
        exits[b] = state
        state = row[state]
    path, state, every = np.empty((BLOCK, blocks), np.int64), exits, np.arange(blocks)
    for j in reversed(range(BLOCK)):
        path[j] = state
        state = back[j][every, state]
    return path.T.ravel()[:n]


def label(m: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Language, score and spans of each text."""
    size = len(m.languages)
    if not size:
        return ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
    ids, start, length, owner, scores, total = [], [], [], [], [], 0

    def add(text: str, docs: np.ndarray, offsets: np.ndarray, shift: int) -> None:
        nonlocal total
        w = words(text, m.kind, m.lower, m.script)
        own = np.searchsorted(offsets, w.start, "right") - 1
        ids.append(w.ids + total)
        start.append(w.start - offsets[own] + shift)
        length.append(w.length)
        owner.append(docs[own])
        scores.append(word_scores(m, w))
        total += len(w.sizes)

    long = [i for i, t in enumerate(texts) if t and len(t) > 1 << 22]
    short = np.array([i for i, t in enumerate(texts) if t and len(t) <= 1 << 22], np.int64)
    if len(short):
        add("\n".join(texts[i] for i in short), short, np.cumsum([0, *[len(texts[i]) + 1 for i in short[:-1]]]), 0)
    for i in long:
        shift = 0
        for p in pieces(texts[i]):
            add(p, np.array([i]), np.zeros(1, np.int64), shift)
            shift += len(p)
    out = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
    if not total:
        return out
    ids, start, length, owner, scores = map(np.concatenate, (ids, start, length, owner, scores))
    fresh = np.diff(owner, prepend=-1) != 0
    path = viterbi(scores, ids, fresh, m.penalty)
    letters = np.bincount(owner * size + path, length, len(texts) * size).reshape(len(texts), size)
    chosen, whole = letters.argmax(1), letters.sum(1)
    mine = path == chosen[owner]
    evidence = np.stack([np.bincount(owner[mine], scores[ids[mine], j].astype(float), len(texts)) for j in range(size)], 1)
    evidence -= evidence.max(1, keepdims=True)
    sure = np.exp(evidence)
    sure = np.take_along_axis(sure, chosen[:, None], 1)[:, 0] / sure.sum(1)
    first = np.flatnonzero(fresh | (np.diff(path, prepend=-1) != 0))
    last = np.append(first[1:], len(path)) - 1
    for i in np.flatnonzero(whole):
        out[0][i] = m.languages[chosen[i]]
        out[1][i] = letters[i, chosen[i]] / whole[i] * sure[i]
    for d, a, b, lang in zip(owner[first].tolist(), start[first].tolist(), (start[last] + length[last]).tolist(), path[first].tolist()):
        out[2][d].append({"start": a, "end": b, "lang": m.languages[lang]})
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", divisor: int = 3, held_out: int = 1, per_language: int = 4000, languages: int = 512, bits: int = 17) -> Model:
    """A model from the documents that have a language and whose id is not held out.

    Bounds of the fit: about ``per_language`` documents of each language, by a
    hash of their id (those of one id come together), and the ``languages``
    that have the most. The n-grams are counted by the tasks; what comes to
    the driver is one number for each slot, language and script.
    """
    spark = docs.sparkSession
    lang = col(lang_col).cast("string")
    rows = docs.select(col(id_col).alias("id"), lang.alias("lang"), col(text_col).cast("string").alias("text")).where("lang is not null")
    rows = rows.where(remainder("id", divisor) != held_out)
    counted = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    names = sorted(counted)
    points = code_points()
    if not names:
        return Model([], bits, np.zeros((1 << bits, 0), np.float32), np.zeros((len(NAMES), 0), bool), *points)
    shares = spark.createDataFrame([(name, i, per_language / counted[name]) for i, name in enumerate(names)], "lang string, number int, share double")
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = rows.join(F.broadcast(shares), "lang").where(chance < F.col("share")).select("number", "text")
    shared, slots = Shared(spark, points), 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, counts, scripts = shared.value, {}, {}
        for whole in batches:
            for b in by_bytes(whole, 1, 4 << 20):
                of: dict[int, list[str]] = {}
                for number, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for p in pieces(text):
                        of.setdefault(number, []).append(p)
                for number, texts in of.items():
                    w = words("\n".join(texts), *tables)
                    often = np.bincount(w.ids, minlength=len(w.sizes)).astype(float)
                    here = counts.setdefault(number, np.zeros(slots))
                    for found, word in grams(w.codes, w.sizes, bits):
                        here += np.bincount(found, often[word], slots)
                    scripts[number] = scripts.get(number, 0) + np.bincount(w.script, often * w.sizes, len(NAMES))
        for number, here in counts.items():
            every = np.concatenate([here, scripts[number]])
            at = np.flatnonzero(every)
            yield pa.record_batch([pa.array(np.full(len(at), number, np.int32)), pa.array(at), pa.array(every[at].astype(np.int64))], ["number", "slot", "n"])

    found = chosen.mapInArrow(run, "number int, slot long, n long").groupBy("number", "slot").agg(F.sum("n").alias("n")).toArrow()
    grid = np.zeros((slots + len(NAMES), len(names)))
    grid[found["slot"].to_numpy(), found["number"].to_numpy()] = found["n"].to_numpy()
    seen, scripts = grid[:slots], grid[slots:]
    share = seen / np.maximum(seen.sum(0), 1)
    uses = scripts > SHARE * scripts.sum(0)
    return Model(names, bits, np.log(share + FLOOR).astype(np.float32), uses, *points)


SPANS = "array<struct<start: long, `end`: long, lang: string>>"


def identify(docs: DataFrame, model: Model, carry: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``carry`` (all columns, if None) of every row, with lang_pred, score and spans.

    lang_pred has most letters of the text (of equal ones the first by code
    point); ``und``, with score 0, for null texts and those without a letter,
    and wherever no language was learnt. score is the share of the letters
    labelled so, times how likely that label is for them. spans are ranges of code points with the language of
    their words, in order. A script that no learnt language uses tells nothing
    of the language. Repeated rows, null ids and other columns stay; columns
    named like ours give way.
    """
    names = ["lang_pred", "score", "spans"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in names]
    rows = docs.select(col(text_col).cast("string").alias("text"), row_of(carry))
    shared = Shared(docs.sparkSession, model)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for whole in batches:
            for x in by_bytes(whole, 0, 4 << 20):
                lang, score, found = label(m, x.column(0).to_pylist())
                yield pa.record_batch([x.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(found, spans)], ["row", *names])

    return rows.mapInArrow(run, with_fields(rows.schema.fields[1:], f"lang_pred string, score double, spans {SPANS}")).select(*unpacked(carry), *names)


def held_out(column: str = "doc_id", divisor: int = 3, rest: int = 1):
    return remainder(column, divisor) == rest
