import random
import zlib

import numpy as np

from treelens.llm import quality


def corpus(n=500, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        good = rng.random() < 0.7
        if not good:
            how = rng.randrange(3)
            text = [w + "***" for w in text] if how == 0 else [w.upper() + "!!" for w in text] if how == 1 else [text[0]] * len(text)
        docs.append((i, " ".join(text)))
        labels.append((i, int(good)))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0.5D as score", "1 as x", "2 as row")
    return d, spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, lab = frames(spark, docs, labels)
    out = quality.score(d, quality.fit(d, lab), carry=["doc_id"]).collect()
    truth = dict(labels)
    rest = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(rest) > 50 and sum(r.predicted != truth[r.doc_id] for r in rest) <= 0.03 * len(rest)
    assert all(r.predicted == (r.score >= 0.7) for r in out)


def test_pairs_are_learnt():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.train(x, y)
    new = rng.random((1000, 5))
    right = (model.score(new) > 0.5) == ((new[:, 1] > 0.5) ^ (new[:, 3] > 0.5))
    assert right.mean() > 0.93 and (1, 3) in [(i, j) for i, j, _ in model.pairs]


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.random((300, 4))
    model = quality.train(x, (x[:, 0] + 0.2 * rng.random(300) > 0.6).astype(float))
    b = model.bins(x)
    for i in range(20):
        total = model.intercept + sum(t[b[i, j]] for j, t in enumerate(model.tables))
        total += sum(t[b[i, p] // model.coarse, b[i, q] // model.coarse] for p, q, t in model.pairs)
        assert abs(1 / (1 + np.exp(-total)) - model.score(x[i : i + 1])[0]) < 1e-12


def test_odd_rows(spark):
    docs, labels = corpus(120)
    odd = [(None, "a b"), (900, None), (901, ""), (902, " \n"), (903, "x" * 5_000_000), (904, "word " * 1_000_000), (1, docs[1][1])]
    d, lab = frames(spark, docs + odd, labels + [(None, 1), (900, None), (5, 3), (901, 0)])
    out = quality.score(d, quality.fit(d, lab)).collect()
    assert len(out) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in out)
    assert quality.score(d.limit(0), quality.fit(d, lab)).count() == 0
    assert quality.score(d, quality.fit(d, lab.limit(0))).count() == len(out)


def test_features():
    f = dict(zip(quality.NAMES, quality.features(b"Ab cd, cd cd\n12 cd, x!!\n12 cd, x!!")))
    assert abs(f["log_words"] - np.log1p(10)) < 1e-12 and abs(f["repeated_lines"] - 1 / 3) < 1e-12
    assert abs(f["same_as_before"] - 0.1) < 1e-12 and abs(f["top_word"] - 0.3) < 1e-12 and abs(f["without_letters"] - 0.2) < 1e-12
    assert not quality.features(b"").any() and not quality.features(None).any()
    long = b"one two three " * 700_000
    f = dict(zip(quality.NAMES, quality.features(long)))
    expected = {"log_words": np.log1p(2_100_000), "mean_length": 11 / 3, "sd_length": np.std([3, 3, 5]), "log_longest": np.log1p(5), "spaces": 3 / 14, "top_word": 1 / 3, "repeated_pairs": 1 - 3 / 2_099_999}
    assert all(abs(f[k] - v) < 1e-12 for k, v in expected.items())


def test_features_of_a_long_text_are_those_of_the_whole(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "Bc", "é", "!!", "7", " ", "  ", "\n", "\t", "the ", "x\r\n"]) for _ in range(rng.randint(0, 300))).encode() for _ in range(60)]
    texts += [b"", b" \n ", b"x" * 500, b"word " * 90 + b"y" * 200 + b"\n" + b"word " * 9]
    whole = [quality.features(t) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(quality, "PIECE", size)
        for t, w in zip(texts, whole):
            assert b"".join(quality._pieces(t)) == t
            assert np.array_equal(quality.features(t), w)
    assert not quality.features(None).any()
