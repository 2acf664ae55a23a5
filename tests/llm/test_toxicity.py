import random
import zlib

import numpy as np

from treelens.llm import toxicity

BAD = ["idiot", "scum", "trash", "loser", "stinkade", "stinkodo", "stinkura"]


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = [rng.choice(plain) for _ in range(rng.randint(10, 60))]
        if bad:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0.5D as score", "1 as ids", "2 as row", "3 as `c.d`")
    return d, spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "1 as quality")


def test_held_out_accuracy_and_exact_neighbours(spark):
    docs, labels = corpus()
    d, lab = frames(spark, docs, labels)
    model = toxicity.fit(d, lab)
    out = toxicity.score(d, model, ["doc_id"]).collect()
    truth = dict(labels)
    rest = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert not rest & set(model.index.ids.tolist())
    wrong = sum(r.predicted != truth[r.doc_id] for r in out if r.doc_id in rest)
    assert wrong <= 0.05 * len(rest)
    # all cosines, the plain way
    v = [model.vocabulary.count(t) for _, t in docs]
    dense = np.zeros((len(docs), len(model.idf)))
    for i, (ids, counts) in enumerate(v):
        dense[i, ids] = toxicity.weights(ids, counts, model.weight)
    place = {i: j for j, (i, _) in enumerate(docs)}
    index = dense[[place[int(i)] for i in model.index.ids]]
    for r in out:
        cos = np.minimum(index @ dense[place[r.doc_id]], 1.0)
        order = np.lexsort((model.index.ids, -np.round(cos, 10)))[: model.k]
        best = [(int(model.index.ids[j]), cos[j]) for j in order if cos[j] > 0]
        got = [(e.doc_id, e.similarity) for e in r.evidence]
        assert np.allclose([c for _, c in got], [c for _, c in best], atol=1e-7)
        assert {i for i, c in got if c > got[-1][1] + 1e-7} == {i for i, c in best if c > best[-1][1] + 1e-7}


def test_document_frequencies_are_of_all_documents(spark):
    docs, labels = corpus(200)
    docs += [(10_000 + i, f"idiot number {i}") for i in range(50)]
    model = toxicity.fit(*frames(spark, docs, labels))
    j = model.vocabulary.ids["idiot"]
    df = sum("idiot" in t.split() for _, t in docs)
    assert abs(model.idf[j] - (np.log((1 + len(docs)) / (1 + df)) + 1)) < 1e-12


def test_every_term_of_the_examples_counts(spark):
    docs, labels = corpus(200)
    docs += [(i, f"only{i} here{i}") for i in range(1000, 1020)]  # words of one text
    labels += [(i, 0) for i in range(1000, 1020)]
    d, lab = frames(spark, docs, labels)
    model = toxicity.fit(d, lab)
    own = [t for i, t in docs if i in set(model.index.ids.tolist())]
    assert set(model.vocabulary.ids) == {w for t in own for w in toxicity.terms(t)}
    near = {r.doc_id: r.evidence for r in toxicity.score(d, model, ["doc_id"]).collect()}
    for i in set(model.index.ids.tolist()) & set(range(1000, 1020)):
        assert near[i][0].doc_id == i and near[i][0].similarity > 1 - 1e-6


def test_odd_rows(spark):
    docs, labels = corpus(150)
    odd = [(None, "idiot scum trash loser"), (9000, None), (9001, ""), (9002, "x " * 300_000 + "idiot scum trash loser " * 20), (1, "idiot scum trash"), (1, "idiot scum trash")]
    labels += [(None, 1), (9001, None), (3, 5), (1, 0), (1, 1)]
    d, lab = frames(spark, docs + odd, labels)
    out = toxicity.classify(d, lab).collect()
    assert len(out) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in out)
    by = {(r.doc_id, (r.text or "")[:5]): r for r in out}
    assert by[(None, "idiot")].predicted == 1 and by[(9000, "")].predicted == 0 and by[(9002, "x x x")].predicted == 1
    assert sum((r.doc_id, r.text) == (1, "idiot scum trash") for r in out) == 2
    kept = toxicity.accepted(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted == 0 for r in out)


def test_without_labels_and_empty(spark):
    d, lab = frames(spark, [(1, "a"), (2, None)], [])
    assert [r.predicted for r in toxicity.classify(d, lab).collect()] == [0, 0]
    d, lab = frames(spark, [], [(1, 1)])
    assert toxicity.classify(d, lab).count() == 0


def test_text_in_pieces():
    from treelens.llm.common import pieces

    text = "ab cd ef " * 100 + "x" * 80 + " yz"
    for n in (1, 7, 50, 10_000):
        parts = list(pieces(text, n))
        assert "".join(parts) == text and all(p.endswith(" ") for p in parts[:-1])
    assert list(pieces(None)) == [""] == list(pieces(""))


def test_terms_of_a_text_the_plain_way():
    import re

    texts = ["Idiot's under_score x1 9", "Grüße, “stinkender” Straßen Ärger", "", None, "abcd abcde abcdef ABCDEFG abcdxyz", "word " * 50 + "wörter"]
    names = sorted(set().union(*map(toxicity.terms, texts[:5])))
    v = toxicity.Vocabulary(names)
    for text in [*texts, "abcdzzzz unknown abcdefzz"]:
        plain = {}
        for w in re.findall(r"\w+", (text or "").lower()):
            for t in (w, *("^" + w[:k] for k in toxicity.PREFIXES if len(w) > k)):
                if t in names:
                    plain[t] = plain.get(t, 0) + 1
        ids, counts = v.count(text)
        assert {names[i]: n for i, n in zip(ids, counts)} == plain


def test_index_in_blocks_with_repeats_and_one_left_out(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    monkeypatch.setattr(toxicity, "TOGETHER", 7)
    rng = np.random.default_rng(5)
    vectors = []
    for i in range(90):
        if i % 3 == 2:
            vectors.append(vectors[-1 - i % 2])  # repeats
            continue
        ids = np.sort(rng.choice(60, rng.integers(0, 12), replace=False, p=(p := 1 / np.arange(1, 61)) / p.sum()))
        w = rng.random(len(ids)) + 0.1
        vectors.append((ids, w / np.sqrt(w @ w) if len(w) else w))
    doc = rng.permutation(90) * 10
    edge = np.r_[0, np.cumsum([len(t) for t, _ in vectors])]
    index = toxicity.BlockMaxIndex(doc, np.arange(90) % 2, edge, *(np.concatenate([v[i] for v in vectors]) for i in (0, 1)), 60, frequent=9)
    dense = np.zeros((90, 60))
    for i, j in enumerate(index.order):
        dense[i, vectors[j][0]] = vectors[j][1]
    for without in (None, doc.tolist()):
        for i, (s, who) in enumerate(index.search(vectors, 6, without)):
            q = np.zeros(60)
            q[vectors[i][0]] = vectors[i][1]
            cos = np.round(dense @ q, 6)
            if without:
                cos[index.ids == doc[i]] = 0
            by = np.lexsort((index.ids, -cos))[:6]
            by = by[cos[by] > 0]
            assert np.allclose(s, cos[by], atol=2e-6) and len(who) == len(by)
            assert len(set(who.tolist())) == len(who) and np.allclose(cos[who], s, atol=2e-6)


def test_terms_weigh_more_the_more_they_depend_on_the_label(spark):
    docs, labels = corpus(300)
    model = toxicity.fit(*frames(spark, docs, labels))
    more = model.weight / model.idf
    own = [(t, dict(labels)[i]) for i, t in docs if i in set(model.index.ids.tolist())]
    for j in (model.vocabulary.ids["idiot"], 0, len(more) - 1):
        a, b = (sum(model.vocabulary.names[j] in toxicity.terms(t) for t, y in own if y == k) + 0.5 for k in (1, 0))
        n = [sum(y == k for _, y in own) + 1 for k in (1, 0)]
        z = abs(np.log(a / n[0]) - np.log(b / n[1])) / np.sqrt(1 / a + 1 / b)
        assert abs(more[j] - 1 - z) < 1e-9
    assert more.min() >= 1
