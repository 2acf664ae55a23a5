import random

import numpy as np
import pytest
import xxhash

from treelens.llm import simhash


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, radius=4):
    """Component number of each fingerprint, by comparing all of them."""
    fps = np.array(fps, np.uint64)
    comp, n = [-1] * len(fps), 0
    for i in range(len(fps)):
        if comp[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if comp[j] < 0:
                comp[j] = n
                todo += np.flatnonzero(np.bitwise_count(fps ^ fps[j]) <= radius).tolist()
        n += 1
    return comp


def expected(rows):
    comp = groups([brute(t) for _, t in rows])
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, brute(t), least.get(c)) for (i, t), c in zip(rows, comp)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in df.collect()), key=str)


def some_texts(n=150):
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        rows.append((i * 3, " ".join(text)))
        for j in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = "x"
            rows.append((1000 + i * 3 + j, "\t".join(text)))
    return rows


@pytest.mark.parametrize("segments", [1, 2])
def test_matches_brute_force(spark, segments):
    rows = some_texts() + [(7, None), (8, ""), (9, " \n"), (None, "a b"), (None, None), (11, "A b"), (11, "A b"), (12, "long " * 70000 + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as root", "3 as _k1")
    assert got(simhash.clusters(df, segments=segments)) == expected(rows)


def test_large_buckets_are_refined_exactly(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = set()
    for b in base:
        for _ in range(200):
            flips = rng.choice(64, rng.integers(0, 9), replace=False)
            fps.add(int(b) ^ sum(1 << int(f) for f in flips))
    fps = sorted(fps)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    truth = groups(fps)
    for bucket in (8, 4096):
        edges = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in simhash.links(df, bucket=bucket).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in edges)
        parent = {f: f for f in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        first = {}
        assert all(first.setdefault(c, find(f)) == find(f) for f, c in zip(fps, truth))
        assert len({find(f) for f in fps}) == len(set(truth))


def test_deduplicate_keeps_one_whole_row_of_each_group(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text, "a"), (2, text, "b"), (2, text, "b"), (9, "something else entirely", "c"), (None, None, "d"), (3, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as row", "2 as _own", "3 as `a.b`", "4 as _k1", "5 as fp")
    out = simhash.deduplicate(df)
    assert out.columns == df.columns
    assert sorted((tuple(r)[:3] for r in out.collect()), key=str) == sorted([(2, text, "b"), (9, "something else entirely", "c"), (3, "", "e")], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.clusters(df).count() == 0
    assert simhash.deduplicate(df).count() == 0
