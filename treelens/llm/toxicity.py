"""Toxicity by the nearest labelled examples: exact TF-IDF cosine, distance-weighted votes.

At most ``per_class`` examples of each label are indexed (a documented bound of
the fit). Terms are all words and word beginnings of the examples; their
document frequencies are counted over all documents. A term weighs its inverse
document frequency, times one more than its dependence on the label among the
examples: no term is left out, and those that tell the labels apart count for
more. Examples lie in blocks of
like ones. A query first sums the postings of its rarer terms; for the frequent
ones each block keeps the largest weight, so what a block can still add has a
bound. Only blocks that can reach the neighbours found so far are completed,
for all queries of a batch together, hence the neighbours are exactly the
nearest.

Votes of neighbours weigh by closeness and by how many documents of its label an
example stands for. Scores are calibrated on the examples, each left out in turn.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.session import Shared

from .common import by_bytes, col, examples, give_back, labelled, pieces, remainder, row_of, tidy, unpacked, with_fields, written

WORD = re.compile(r"\w+")
#: The same words of ASCII text: letters become small, what is in no word becomes a space.
ASCII = bytes(c + 32 if 65 <= c <= 90 else c if c == 95 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(128)) + bytes(128)
#: Beginnings of longer words that are terms too.
PREFIXES = (4, 5)
BLOCK = 32
#: Blocks of a query with the largest bounds, which are completed before the others.
FIRST = 4
#: Neighbouring blocks that are completed for the queries that need any of them.
SIDE_BY_SIDE = 8
#: Terms whose weights stand in full rows beside the postings, and queries that are searched together.
FREQUENT, TOGETHER = 1536, 256
#: Above the error of sums in single precision, which only choose what is summed in double.
MARGIN = 1e-5
#: Terms of examples, about, that the fit works on at once.
PART = 1 << 18
Vector = tuple[np.ndarray, np.ndarray]


def words(text: str | None) -> Iterator[list[str]]:
    """Lower-cased words, by pieces of the text."""
    for piece in pieces(text):
        yield piece.encode().translate(ASCII).decode().split() if piece.isascii() else WORD.findall(piece.lower())


def terms(text: str | None) -> set[str]:
    """All terms of a text; a beginning is written with ^."""
    own = {w for part in words(text) for w in part}
    return own | {"^" + w[:k] for w in own for k in PREFIXES if len(w) > k}


class Terms(dict):
    """Ids of terms. A word that is none has the id of its longest beginning that is one, else -1."""

    def __missing__(self, word: str) -> int:
        for k in reversed(PREFIXES):
            if len(word) > k and (n := self.get("^" + word[:k])) is not None:
                return n
        return -1


class Vocabulary:
    """All terms by id; ``table`` has for each the ids that a word with it counts for: its own and those of its beginnings, or -1."""

    def __init__(self, names: list[str], table: np.ndarray | None = None):
        self.names, self.table, self._ids = names, table, None
        if table is None:
            get, n = self.ids.get, len(names)
            self.table = np.full((n + 1, 1 + len(PREFIXES)), -1, np.int32)
            self.table[:-1, 0] = np.fromiter((-1 if t[0] == "^" else i for i, t in enumerate(names)), np.int32, n)
            for column, k in enumerate(PREFIXES, 1):
                self.table[:-1, column] = np.fromiter((-1 if len(t) <= k else get(t[: k + 1] if t[0] == "^" else "^" + t[:k], -1) for t in names), np.int32, n)
            self._ids = None

    @property
    def ids(self) -> Terms:
        """Ids by term, made where they are looked up: the driver needs them for the table only."""
        if self._ids is None:
            self._ids = Terms((t, i) for i, t in enumerate(self.names))
        return self._ids

    def __reduce__(self):
        return _vocabulary, ("\n".join(self.names), self.table)

    def count(self, text: str | None) -> Vector:
        """Terms of a text that are in the vocabulary, in order, and how often."""
        found = []
        for part in words(text):
            own = Counter(part)
            # id and count in one number, below 0 for no term
            ids = self.table.take(np.fromiter(map(self.ids.__getitem__, own), np.int64, len(own)), 0).astype(np.int64)
            both = ((ids << 32) | np.fromiter(own.values(), np.int64, len(own))[:, None]).ravel()
            found.append(both[both >= 0])
        both = found[0] if len(found) == 1 else np.concatenate(found)
        both.sort()
        ids, n = both >> 32, both & 0xFFFFFFFF
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else ids
        return ids[first], np.add.reduceat(n, first) if len(ids) else n

    def count_all(self, texts: list[str | None]) -> list[Vector]:
        """``count`` of each; texts that are equal are read once."""
        held: dict[str | None, Vector] = {}
        return [held[t] if t in held else held.setdefault(t, self.count(t)) for t in texts]


def _vocabulary(names: str, table: np.ndarray) -> Vocabulary:
    return Vocabulary(names.split("\n") if names else [], table)


def dependence(term: np.ndarray, label: np.ndarray, n_terms: int, pos: int, neg: int) -> np.ndarray:
    """How many standard errors the log odds of each term between the labels are from 0; ``term`` and ``label`` go over the terms of all examples."""
    a, b = np.full(n_terms, 0.5), np.full(n_terms, 0.5)
    for i in range(0, len(term), PART):
        t, y = term[i : i + PART], label[i : i + PART] == 1
        a += np.bincount(t[y], minlength=n_terms)
        b += np.bincount(t[~y], minlength=n_terms)
    return np.abs(np.log(a / (pos + 1)) - np.log(b / (neg + 1))) / np.sqrt(1 / a + 1 / b)


def weights(ids: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vector, by the weight of each term."""
    w = (1 + np.log(counts)) * weight[ids]
    return w / np.sqrt(w @ w) if len(w) else w


def _by_example(edge: np.ndarray, term: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``weights`` of the examples from edge[i] to edge[i + 1], in single precision; about PART terms are held in double at once."""
    out, i = np.empty(len(term), np.float32), 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + PART, side="right")) - 1)
        at, row = slice(edge[i], edge[j]), np.repeat(np.arange(j - i), np.diff(edge[i : j + 1]))
        w = (1 + np.log(counts[at])) * weight[term[at]]
        out[at] = w / np.sqrt(np.bincount(row, w * w, j - i))[row]
        i = j
    return out


def _unpacked(posting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and weights of postings (the bits of the weight come first in memory)."""
    return posting >> 32, posting.view(np.float32)[::2]


def _ranges(begin: np.ndarray, size: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and each range's value at them."""
    at = np.repeat(begin - np.cumsum(size) + size, size)
    at += np.arange(len(at))
    return at, np.repeat(value, size)


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, 0 at least."""
    return np.maximum(np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k], 0) if k <= x.shape[1] else np.zeros(len(x))


class BlockMaxIndex:
    """Examples by term, in blocks of BLOCK entries. Examples with one vector are one entry.

    Example weights are kept in single precision; sums are in double.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, edge: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, frequent: int = FREQUENT):
        """``term`` and ``weight`` of example i are those from edge[i] to edge[i + 1]."""
        weight = weight.astype(np.float32, copy=False)
        same: dict[bytes, list[int]] = {}
        for i in np.argsort(ids, kind="stable").tolist():
            at = slice(edge[i], edge[i + 1])
            same.setdefault(xxhash.xxh3_128_digest(term[at].tobytes() + weight[at].tobytes()), []).append(i)
        one = np.array([of[0] for of in same.values()], np.int64)
        length = edge[one + 1] - edge[one]
        at, row = _ranges(edge[one], length, np.arange(len(one), dtype=np.int32))
        term, weight = term[at].astype(np.int32, copy=False), weight[at]
        del at
        posted = np.bincount(term, minlength=n_terms)
        often = np.argsort(-posted, kind="stable")[:frequent]
        often = often[posted[often] > 1]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        # entries with the same strongest of the most frequent terms lie together, by length: their weights are alike
        group = np.full(len(one), -1)
        for i, (a, b) in enumerate(zip(np.cumsum(length) - length, np.cumsum(length))):
            c = self.column[term[a:b]]
            if len(top := np.flatnonzero((c >= 0) & (c < 64))):
                group[i] = c[top[np.argmax(weight[a:b][top])]]
        place = np.empty(len(one), np.int32)
        place[by := np.lexsort((length, group))] = np.arange(len(one))
        members = list(same.values())
        members = [members[i] for i in by]
        self.first = np.r_[0, np.cumsum([len(of) for of in members])].astype(np.int64)
        self.order = np.array([i for of in members for i in of], np.int64)
        self.ids, self.labels = ids[self.order], labels[self.order]
        self.blocks = max(1, -(-len(one) // BLOCK))
        row = place[row]
        # a posting is one number: its entry, and the bits of its weight
        self.posting = row.astype(np.int64)
        del row
        self.posting <<= 32
        self.posting |= weight.view(np.uint32)
        del weight
        self.posting = self.posting[np.argsort(term, kind="stable")]
        self.of = np.r_[0, np.cumsum(posted)]
        self.dense = None

    def _fill(self) -> None:
        """Full rows of the frequent terms and, for each block, the largest weight of each; only where queries are searched."""
        often = np.flatnonzero(self.column >= 0)
        self.dense = np.zeros((self.blocks * BLOCK, len(often)), np.float32)
        for t in often:
            row, weight = _unpacked(self.posting[self.of[t] : self.of[t + 1]])
            self.dense[row, self.column[t]] = weight
        self.most = self.dense.reshape(self.blocks, BLOCK, -1).max(1)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None, "most": None}

    def search(self, queries: list[Vector], k: int, without: list[int] | None = None) -> list[Vector]:
        """For each query the k examples of largest cosine above 0: (cosines, examples), nearest first, ties by id.

        ``without`` leaves the examples of one id out of each query's.
        """
        if self.dense is None:
            self._fill()
        out = []
        for i in range(0, len(queries), TOGETHER):
            out += self._search(queries[i : i + TOGETHER], k, without[i : i + TOGETHER] if without else None)
        return out

    def _search(self, queries: list[Vector], k: int, without: list[int] | None) -> list[Vector]:
        q, width = len(queries), self.blocks * BLOCK
        part, often, columns = np.zeros((q, width)), np.zeros((q, self.dense.shape[1])), []
        for i, (t, w) in enumerate(queries):
            c = self.column[t]
            frequent = c >= 0
            columns.append(c[frequent])
            often[i, columns[i]] = w[frequent]
            t = t[~frequent]
            at, times = _ranges(self.of[t], self.of[t + 1] - self.of[t], w[~frequent])
            row, weight = _unpacked(self.posting[at])
            times *= weight
            part[i] = np.bincount(row, times, width)
            if without:
                own, n = np.unique(np.searchsorted(self.first, np.flatnonzero(self.ids == without[i]), side="right") - 1, return_counts=True)
                part[i, own[n == self.first[own + 1] - self.first[own]]] = -np.inf
        # low: no more than the k-th largest cosine of a query; first the largest of its blocks, then all of its best blocks
        single, largest = often.astype(np.float32), part.reshape(q, self.blocks, BLOCK).max(2)
        bound, low, full = largest + single @ self.most.T, _kth(largest, k), np.full((q, width), -np.inf, np.float32)
        first = np.argpartition(bound, max(0, self.blocks - FIRST), axis=1)[:, -FIRST:]
        best = np.zeros(bound.shape, bool)
        np.put_along_axis(best, first, True, 1)
        for now, step in ((best, 1), (~best, SIDE_BY_SIDE)):
            now &= (bound > 0) & (bound >= low[:, None] - MARGIN)
            for b in range(0, self.blocks, step):
                rows, at = np.flatnonzero(now[:, b : b + step].any(1)), slice(b * BLOCK, (b + step) * BLOCK)
                if len(rows):
                    full[rows, at] = part[rows, at] + single[rows] @ self.dense[at].T
            if now is best:
                low = np.maximum(low, _kth(np.take_along_axis(full.reshape(q, self.blocks, BLOCK), first[:, :, None], 1).reshape(q, -1), k))
        out = []
        for i in range(q):
            near = np.flatnonzero(full[i] >= max(low[i] - MARGIN, 1e-30))
            if len(near) > 2 * k:
                near = near[full[i, near] >= np.partition(full[i, near], len(near) - k)[len(near) - k] - MARGIN]
            score = part[i, near] + (self.dense[np.ix_(near, columns[i])] * often[i, columns[i]]).sum(1)
            score = np.minimum(np.round(score, 12), 1.0)
            size = np.minimum(self.first[near + 1] - self.first[near], k + (len(self.ids) if without else 0))
            at, score = _ranges(self.first[near], size, score)
            if without:
                at, score = at[self.ids[at] != without[i]], score[self.ids[at] != without[i]]
            by = np.lexsort((self.ids[at], -score))[:k]
            out.append((score[by], at[by]))
        return out


@dataclass
class Model:
    vocabulary: Vocabulary
    idf: np.ndarray
    weight: np.ndarray  # of each term: its idf, more if it depends on the label
    index: BlockMaxIndex
    stands_for: tuple[float, float]  # documents of each label that one example stands for
    prior: float
    k: int
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, near: Vector) -> float:
        """Share of the weighted votes for label 1; the prior counts as a faint vote."""
        s, y = near[0], self.index.labels[near[1]]
        w = s * s / (1.05 - s) * np.where(y > 0, self.stands_for[1], self.stands_for[0])
        return float(np.clip((0.02 * self.prior + w @ y) / (0.02 + w.sum()), 1e-6, 1 - 1e-6))

    def score(self, near: Vector) -> float:
        p = self.raw(near)
        return float(1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift))))

    def neighbours(self, texts: list[str | None], without: list[int] | None = None) -> list[Vector]:
        out = []
        for i in range(0, len(texts), TOGETHER):
            vectors = [(ids, weights(ids, n, self.weight)) for ids, n in map(self.vocabulary.count, texts[i : i + TOGETHER])]
            out += self.index.search(vectors, self.k, without[i : i + TOGETHER] if without else None)
        return out

    def calibrate(self, own: DataFrame) -> None:
        """Slope and shift of the log odds, by Newton steps over the examples (doc_id, label, text), each left out in turn, with smoothed labels."""
        if not len(self.index.ids) or self.index.labels.min() == self.index.labels.max():
            return
        shared = Shared(own.sparkSession, self)

        def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m: Model = shared.value
            for whole in batches:
                for x in by_bytes(whole, 2):
                    near = m.neighbours(x.column(2).to_pylist(), x.column(0).to_pylist())
                    yield pa.record_batch([*x.columns[:2], pa.array([m.raw(v) for v in near], pa.float64())], ["id", "label", "raw"])

        found = own.select("doc_id", "label", "text").mapInArrow(tidy(left_out), "id long, label int, raw double").toArrow().sort_by([("id", "ascending"), ("raw", "ascending")])
        shared.unpersist()
        x, y = found.column("raw").to_numpy(), found.column("label").to_numpy().astype(int)
        x = np.log(x / (1 - x))
        w = np.array(self.stands_for)[y]
        w = w / w.sum() * len(x)
        up, down = y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g, h = w * (p - t), w * p * (1 - p)
            grad = np.array([g @ x + 0.01 * (a - 1), g.sum()])
            hess = np.array([[h @ (x * x) + 0.01, h @ x], [h @ x, h.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            step *= min(1.0, 2.0 / max(abs(step).max(), 1e-9))
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-7:
                break
        if np.isfinite([a, b]).all() and a > 0:
            self.slope, self.shift = float(a), float(b)


def _frequencies(docs: DataFrame, vocabulary: Vocabulary, text_col: str) -> tuple[int, np.ndarray]:
    """Number of rows, and of those whose text holds each term: sums of one partial count from each task."""
    shared = Shared(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        own, rows = np.zeros(len(v.names) + 1, np.int64), 0
        for whole in batches:
            for x in by_bytes(whole, 0):
                own[-1] += x.num_rows
                for ids, _ in v.count_all(x.column(0).to_pylist()):
                    own[ids] += 1
        at = np.flatnonzero(own)
        yield pa.record_batch([pa.array(at), pa.array(own[at])], ["term", "n"])

    found = docs.select(col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    out = np.zeros(len(vocabulary.names) + 1, np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return int(out[-1]), out[:-1]


def all_terms(own: DataFrame) -> Vocabulary:
    """Every term of the examples (text), those of most examples first: what is looked up most lies together."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in by_bytes(whole, 0, 1 << 20):
                n = Counter(t for text in x.column(0).to_pylist() for t in terms(text))
                yield pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    found = own.select("text").mapInArrow(tidy(seen), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    return Vocabulary(found.sort_by([("n", "descending"), ("term", "ascending")]).column("term").to_pylist())


def _counted(own: DataFrame, vocabulary: Vocabulary) -> pa.Table:
    """doc_id, label, ids and counts of the examples."""
    shared = Shared(own.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        for whole in batches:
            for x in by_bytes(whole, 2):
                both = v.count_all(x.column(2).to_pylist())
                lists = [pa.array([p[i] for p in both], pa.list_(pa.int32())) for i in (0, 1)]
                yield pa.record_batch([*x.columns[:2], *lists], ["doc_id", "label", "ids", "counts"])

    return own.select("doc_id", "label", "text").mapInArrow(tidy(run), "doc_id long, label int, ids array<int>, counts array<int>").toArrow()


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label: str = "toxic", divisor: int = 5, held_out: int = 0, per_class: int = 4096, k: int = 15) -> Model:
    """A model from ``labels`` (doc_id, label), leaving out ids whose remainder is ``held_out``.

    Without examples of both labels every score is the share of label 1, or 0
    if there are no labels.
    """
    rows = written(labelled(labels, label, divisor, held_out), "labels")
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    own = written(examples(docs, rows, per_class, text_col), "examples")
    vocabulary = all_terms(own)
    total, df = _frequencies(docs, vocabulary, text_col)
    idf = np.log((1 + total) / (1 + df)) + 1
    found = _counted(own, vocabulary).combine_chunks()
    ids, ys = (found.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "label"))
    edge = np.r_[0, np.cumsum(pa.compute.list_value_length(found.column("ids")).to_numpy())].astype(np.int64)
    term, counts = (pa.compute.list_flatten(found.column(c)).to_numpy() for c in ("ids", "counts"))
    pos, neg, all_labels = int(ys.sum()), int((1 - ys).sum()), sum(n.values())
    per_term = idf * (1 + dependence(term, np.repeat(ys.astype(np.int8), np.diff(edge)), len(idf), pos, neg))
    weight = _by_example(edge, term, counts, per_term)
    del found, counts
    index = BlockMaxIndex(ids, ys, edge, term, weight, len(vocabulary.names))
    del term, weight
    give_back()
    stands = [n.get(y, 0) / max(h, 1) / max(all_labels, 1) * max(pos + neg, 1) for y, h in ((0, neg), (1, pos))]
    model = Model(vocabulary, idf, per_term, index, (stands[0], stands[1]), n.get(1, 0) / all_labels if all_labels else 0.0, k)
    model.calibrate(own)
    give_back()
    return model


EVIDENCE = "array<struct<doc_id: long, label: int, similarity: double>>"


def _scored(rows: DataFrame, model: Model, field: str | None, threshold: float) -> DataFrame:
    """``row`` of each row with score, predicted and evidence; the text is the column ``text``, or a field of ``row``."""
    shared = Shared(rows.sparkSession, model)
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for whole in batches:
            column = whole.column(0).field(field) if field else whole.column(1)
            for x in by_bytes(pa.record_batch([whole.column(0), column], ["row", "text"]), 1):
                texts = x.column(1).to_pylist()
                place = {t: i for i, t in enumerate(dict.fromkeys(texts))}  # equal texts have the same neighbours
                found = m.neighbours(list(place))
                p = np.array([m.score(v) for v in found])
                at = np.array([place[t] for t in texts])
                s, i = (np.concatenate([found[j][n] for j in at]) for n in (0, 1))
                shown = pa.StructArray.from_arrays([pa.array(m.index.ids[i]), pa.array(m.index.labels[i].astype(np.int32)), pa.array(s)], ["doc_id", "label", "similarity"])
                shown = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(found[j][0]) for j in at])].astype(np.int32), shown)
                yield pa.record_batch([x.column(0), pa.array(p[at]), pa.array((p[at] >= threshold).astype(np.int32)), shown], ["row", "score", "predicted", "evidence"])

    return rows.mapInArrow(tidy(run), with_fields(rows.schema.fields[:1], f"score double, predicted int, evidence {EVIDENCE}"))


def score(docs: DataFrame, model: Model, carry: list[str] | None = None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns ``carry`` (all, if None) of every row with score, predicted and evidence, the nearest examples of its whole text.

    A null or empty text has no terms, hence no neighbours; its score is the
    calibrated prior. Columns of those names give way.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "predicted", "evidence")]
    rows = docs.select(row_of(carry), col(text_col).cast("string").alias("text"))
    return _scored(rows, model, None, threshold).select(*unpacked(carry), "score", "predicted", "evidence")


def held_out(column: str = "doc_id", divisor: int = 5, rest: int = 0):
    return remainder(column, divisor) == rest


def classify(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, threshold: float = 0.5, text_col: str = "text", **how) -> DataFrame:
    """``score`` of every row by a model fitted on ``docs`` and ``labels``."""
    return score(docs, fit(docs, labels, text_col, **how), carry, text_col, threshold)


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5, **how) -> DataFrame:
    """``docs`` without those predicted toxic."""
    model = fit(docs, labels, text_col, **how)
    if dict(docs.dtypes)[text_col] == "string" and docs.columns.count(text_col) == 1:  # the text goes to the workers once
        rows, field = docs.select(row_of(docs.columns)), text_col
    else:
        rows, field = docs.select(row_of(docs.columns), col(text_col).cast("string").alias("text")), None
    out = _scored(rows, model, field, threshold)
    del model
    give_back()  # the executors have it by broadcast
    return out.where("predicted = 0").select(*unpacked(docs.columns))
