"""What the driver's Python holds of the fits of the pipeline's first two stages, by tracemalloc."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from treelens.llm import jaccard, toxicity


def most(f):
    """The result of ``f`` and the most bytes that Python and numpy held for it."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_order_of_shingles_is_held_in_few_bytes(spark):
    rng = random.Random(3)
    words = [str(rng.randrange(10**9)) for _ in range(60000)]
    # not equal texts, which would count once; some shingles are in three
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(words[:500])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    (h, n), held = most(lambda: jaccard._order(docs, F.col("text"), 5))
    expected, times = np.unique(np.concatenate([jaccard.shingles(t.encode()) for t in texts]), return_counts=True)
    assert (h == expected[times > 1]).all() and (n == times[times > 1]).all() and h.dtype == np.uint64
    assert n.max() == 3 and held < 100 * len(h)


def test_words_of_the_vocabulary_are_not_indexed_where_nothing_is_looked_up():
    v = toxicity.Vocabulary(["ab", "abcde", "^abcd"])
    assert v._ids is None and v.ids["abcde"] == 1 and v.ids["abcdxy"] == 2 and v.ids["zz"] == -1
    assert v.table[1].tolist() == [1, 2, -1]


def test_fit_weighs_and_indexes_in_few_bytes_a_term(monkeypatch):
    rng, n_terms = np.random.default_rng(4), 5000
    size = rng.integers(0, 900, 1500)
    edge = np.r_[0, np.cumsum(size)].astype(np.int64)
    term = np.concatenate([np.sort(rng.choice(n_terms, n, replace=False)) for n in size]).astype(np.int32)
    counts, ys = rng.integers(1, 9, len(term)).astype(np.int32), rng.integers(0, 2, len(size))
    per_term = rng.random(n_terms) + 1
    monkeypatch.setattr(toxicity, "PART", 5000)

    def fitted():
        label = np.repeat(ys.astype(np.int8), size)
        depends = toxicity.dependence(term, label, n_terms, int(ys.sum()), int((1 - ys).sum()))
        weight = toxicity._by_example(edge, term, counts, per_term)
        return depends, weight, toxicity.BlockMaxIndex(np.arange(len(size)), ys, edge, term, weight, n_terms)

    (depends, weight, index), held = most(fitted)
    assert held < 45 * len(term)
    a, b = (np.bincount(term, np.repeat(ys, size) == y, n_terms) + 0.5 for y in (1, 0))
    assert (depends == np.abs(np.log(a / (ys.sum() + 1)) - np.log(b / ((1 - ys).sum() + 1))) / np.sqrt(1 / a + 1 / b)).all()
    for i in range(len(size)):
        at = slice(edge[i], edge[i + 1])
        w = toxicity.weights(term[at], counts[at], per_term)
        assert np.allclose(weight[at], w, rtol=1e-6, atol=0)
    # every term of every example is posted once, by term, with its weight
    entry, held_weight = toxicity._unpacked(index.posting)
    example = index.order[index.first[entry]]
    own = {(int(t), int(i)): float(w) for t, i, w in zip(term, np.repeat(np.arange(len(size)), size), weight)}
    posted = {(int(t), int(i)): float(w) for t, i, w in zip(np.repeat(np.arange(n_terms), np.diff(index.of)), example, held_weight)}
    assert posted == own
