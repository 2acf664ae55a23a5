"""Quality by a generalised additive model with pairwise interactions.

Features of a whole text are binned at quantiles. Trees of few leaves are
boosted on one feature at a time, in cycles, and added to that feature's lookup
table; then the same for the pairs that gain most on what is left. A score is
the logistic of a sum of table entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.session import Shared

from .common import as_bytes, by_bytes, col, examples, labelled, remainder, row_of, unpacked, with_fields

#: Byte classes: 0 space, 1 small letter, 2 capital letter, 3 digit, 4 sentence mark, 5 other ASCII, 6 beyond ASCII (continuing: 7).
CLASS = np.array([0 if c in b" \t\n\r\x0b\x0c" else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in b".,;:!?'\"()-" else 5 if c < 128 else 7 if c < 192 else 6 for c in range(256)], np.uint8)
NAMES = (
    "log_words mean_length sd_length log_longest spaces capitals digits marks symbols beyond_ascii distinct top_word repeated_pairs same_as_before "
    "log_lines log_line_length repeated_lines ends_in_mark ends_in_symbol without_letters capitalised short_words mark_runs entropy"
).split()
#: Bytes looked at together; what is counted in the pieces of a longer text is added up, so its features are those of the whole.
PIECE = 4 << 20
SPACES = [bytes([c]) for c in b" \t\n\r\x0b\x0c"]


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes, each but the last up to a white space."""
    start = 0
    while len(text) - start > PIECE:
        end = max(text.rfind(c, start, start + PIECE) for c in SPACES) + 1
        if end <= start:
            end = min((x for c in SPACES if (x := text.find(c, start + PIECE)) >= 0), default=len(text) - 1) + 1
        yield text[start:end]
        start = end
    yield text[start:]


def features(text: bytes | None) -> np.ndarray:
    """The features of a whole text; one without words has zeros."""
    text = text or b""
    count, bytes_ = np.zeros(8), np.zeros(256, np.int64)
    n = total = squares = longest = same = in_mark = in_symbol = no_letters = capitalised = short = runs = n_lines = 0
    seen: Counter = Counter()
    pairs, lines, before, open_line = set(), set(), None, b""
    for piece in _pieces(text):
        raw = np.frombuffer(piece, np.uint8)
        kind = CLASS[raw]
        edge = np.diff(np.r_[True, kind == 0, True].astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        count += np.bincount(kind, minlength=8)
        bytes_ += np.bincount(raw, minlength=256)
        *whole, open_line = (open_line + piece).split(b"\n")
        full = [x for x in whole if x.strip()]
        n_lines += len(full)
        lines.update(full)
        if not len(first):
            continue
        words = piece.split()
        length, z = last - first, kind[last - 1]
        lower, marks = np.cumsum(np.r_[0, (kind == 1) | (kind == 2) | (kind >= 6)]), kind == 4
        n, total, squares, longest = n + len(first), total + int(length.sum()), squares + int((length * length).sum()), max(longest, int(length.max()))
        same += sum(map(bytes.__eq__, words, words[1:])) + (before == words[0])
        seen.update(words)
        pairs.update(zip(words, words[1:]), [(before, words[0])] if before is not None else [])
        before = words[-1]
        in_mark, in_symbol, no_letters = in_mark + (z == 4).sum(), in_symbol + (z == 5).sum(), no_letters + (lower[last] == lower[first]).sum()
        capitalised, short, runs = capitalised + (kind[first] == 2).sum(), short + (length <= 3).sum(), runs + (marks[1:] & marks[:-1]).sum()
    if open_line.strip():
        n_lines += 1
        lines.add(open_line)
    if not n:
        return np.zeros(len(NAMES))
    chars, letters, share = count.sum() - count[7], count[1] + count[2] + count[6], bytes_[bytes_ > 0] / len(text)
    return np.array((
        np.log1p(n), total / n, np.sqrt(max(n * squares - total * total, 0)) / n, np.log1p(longest), count[0] / chars, count[2] / max(letters, 1), count[3] / chars, count[4] / chars, count[5] / chars, count[6] / chars,
        np.log1p(len(seen)) / np.log1p(n), max(seen.values()) / n, 1 - len(pairs) / max(n - 1, 1), same / n,
        np.log1p(n_lines), np.log1p(len(text) / n_lines), 1 - len(lines) / n_lines,
        in_mark / n, in_symbol / n, no_letters / n, capitalised / n, short / n, runs / n, -(share * np.log(share)).sum(),
    ), float)


def _leaves(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values of a tree over ordered bins: the best splits first, up to ``leaves``."""
    value = lambda G, H: G * G / (H + 1)
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]

    def best(a: int, b: int):
        k = np.arange(a + 1, b)
        if not len(k):
            return 0.0, a
        gl, hl, gr, hr = cg[k] - cg[a], ch[k] - ch[a], cg[b] - cg[k], ch[b] - ch[k]
        gain = np.where((hl >= least) & (hr >= least), value(gl, hl) + value(gr, hr) - value(cg[b] - cg[a], ch[b] - ch[a]), 0)
        i = int(gain.argmax())
        return float(gain[i]), int(k[i])

    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, i = max((*best(*p), i) for i, p in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts.pop(i)
        parts += [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """The tree over two features that splits one and then, on either side, the other: its gain and values."""
    best, out = 0.0, np.zeros(g.shape)
    for turned in (False, True):
        G, H = (g.T, h.T) if turned else (g, h)
        cg, ch = G.cumsum(0), H.cumsum(0)
        for i in range(G.shape[0] - 1):
            gain, value = 0.0, np.zeros(G.shape)
            for rows, x, y in ((slice(0, i + 1), cg[i], ch[i]), (slice(i + 1, None), cg[-1] - cg[i], ch[-1] - ch[i])):
                if y.sum() < least:
                    break
                v = _leaves(x, y, 2, least)
                gain -= (v * x).sum()
                value[rows] = v
            else:
                if gain > best:
                    best, out = gain, value.T if turned else value
    return best, out


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: int = 4  # bins of a feature in one bin of a pair

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def total(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[bins[:, j]]
        for i, j, t in self.pairs:
            out += t[bins[:, i] // self.coarse, bins[:, j] // self.coarse]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.total(self.bins(x))))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, bins: int = 32, rounds: int = 200, rate: float = 0.1, leaves: int = 3, n_pairs: int = 6, patience: int = 20) -> Model:
    """Boosting in cycles, with the number of cycles set on every sixth row, which is left out for that."""
    n, d = len(y), x.shape[1] if len(x) else len(NAMES)
    weight = np.ones(n) if weight is None else weight
    share = float(weight @ y / weight.sum()) if n else 0.5
    start = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], start)
    if n < 20 or y.min() == y.max():
        return model
    b = model.bins(x)
    test = np.arange(n) % 6 == 5
    fit, f = ~test, np.full(n, start)
    least = max(1.0, 0.002 * fit.sum() * share * (1 - share))

    def loss() -> float:
        return float(np.average(np.logaddexp(0, np.where(y[test] > 0, -f[test], f[test])), weights=weight[test]))

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return np.where(fit, weight * (p - y), 0), np.where(fit, weight * p * (1 - p), 0)

    def cycles(step, keep) -> None:
        nonlocal f
        best, since, kept = loss(), 0, (keep(), f.copy())
        for _ in range(rounds):
            step()
            now = loss()
            if now < best - 1e-6:
                best, since, kept = now, 0, (keep(), f.copy())
            elif (since := since + 1) >= patience:
                break
        restore(kept[0])
        f = kept[1]

    def restore(tables) -> None:
        model.tables, model.pairs = tables

    def copy():
        return [t.copy() for t in model.tables], [(i, j, t.copy()) for i, j, t in model.pairs]

    def mains() -> None:
        for j in range(d):
            if not len(edges[j]):
                continue
            g, h = slopes()
            v = rate * _leaves(np.bincount(b[:, j], g, len(edges[j]) + 1), np.bincount(b[:, j], h, len(edges[j]) + 1), leaves, least)
            model.tables[j] += v
            f[:] += v[b[:, j]]

    cycles(mains, copy)
    q = b // model.coarse
    wide = [len(e) // model.coarse + 1 for e in edges]

    def grid(i: int, j: int):
        g, h = slopes()
        cell = q[:, i] * wide[j] + q[:, j]
        return [np.bincount(cell, s, wide[i] * wide[j]).reshape(wide[i], wide[j]) for s in (g, h)]

    gains = sorted(((_quarters(*grid(i, j), least)[0], i, j) for i, j in combinations(range(d), 2) if wide[i] > 1 and wide[j] > 1), reverse=True)
    model.pairs = [(i, j, np.zeros((wide[i], wide[j]))) for gain, i, j in gains[:n_pairs] if gain > 0]

    def both() -> None:
        for i, j, t in model.pairs:
            v = rate * _quarters(*grid(i, j), least)[1]
            t += v
            f[:] += v[q[:, i], q[:, j]]

    if model.pairs:
        cycles(both, copy)
    return model


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label: str = "quality", divisor: int = 4, held_out: int = 2, per_class: int = 10_000) -> Model:
    """A model from at most ``per_class`` labelled documents of each label (a documented bound), each standing for as many as there are.

    With fewer than 20 of them, or one label only, every score is the share of label 1.
    """
    rows = labelled(labels, label, divisor, held_out)
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    own = examples(docs, rows, per_class, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in by_bytes(whole, 2):
                yield pa.record_batch([x.column(0), x.column(1), pa.array([features(t).tolist() for t in as_bytes(x.column(2))], pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    found = sorted(own.mapInArrow(run, "doc_id long, label int, x array<double>").collect(), key=lambda r: (hash((r.doc_id, 7)), r.x))
    y = np.array([r.label for r in found], float)
    have = Counter(int(v) for v in y)
    weight = np.array([n[int(v)] / have[int(v)] for v in y])
    return train(np.array([r.x for r in found]), y, weight / weight.mean() if len(weight) else weight)


def score(docs: DataFrame, model: Model, carry: list[str] | None = None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The columns ``carry`` (all, if None) of every row, with score and predicted; columns of those names give way.

    Null texts count as empty ones and are scored too.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "predicted")]
    rows = docs.select(col(text_col).cast("string").alias("text"), row_of(carry))
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for whole in batches:
            for x in by_bytes(whole, 0):
                p = m.score(np.array([features(t) for t in as_bytes(x.column(0))]).reshape(-1, len(NAMES)))
                yield pa.record_batch([x.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["row", "score", "predicted"])

    return rows.mapInArrow(run, with_fields(rows.schema.fields[1:], "score double, predicted int")).select(*unpacked(carry), "score", "predicted")


def held_out(column: str = "doc_id", divisor: int = 4, rest: int = 2):
    return remainder(column, divisor) == rest
