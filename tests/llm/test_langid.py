import random
import zlib

import numpy as np
import pytest

from treelens.llm import langid

LETTERS = {"aa": "abcdefgh", "bb": "efghijkl", "gr": "αβγδεζηθ", "cy": "абвгдежз"}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [(i, sentence(rng, lang := rng.choice(sorted(LETTERS)), rng.randint(5, 60)), lang) for i in range(400)]


@pytest.fixture(scope="module")
def model(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    return langid.fit(docs)


def test_held_out_accuracy(spark, corpus, model):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string").selectExpr("*", "1 as score", "2 as row")
    out = langid.identify(docs, model).collect()
    truth = {i: lang for i, _, lang in corpus}
    rest = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(rest) > 80 and sum(r.lang_pred != truth[r.doc_id] for r in rest) <= 0.02 * len(rest)
    assert out[0].row == 2 and all(0 <= r.score <= 1 for r in out)


def test_labels_beyond_the_training_rows_do_not_matter(spark, corpus, model):
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in corpus] + [(None, "abc", None)]
    again = langid.fit(spark.createDataFrame(wrong, "doc_id long, text string, lang string"))
    assert again.languages == model.languages and np.array_equal(again.table, model.table)


def brute(score, ids, start, penalty):
    n, size = len(ids), score.shape[1]
    best, back = [score[ids[0]].astype(float)], []
    for t in range(1, n):
        cost = 0 if start[t] else penalty
        prev = best[-1]
        options = prev[:, None] - cost * (1 - np.eye(size))
        back.append(options.argmax(0))
        best.append(options.max(0) + score[ids[t]])
    path = [int(best[-1].argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return best[-1].max(), path[::-1]


def value(path, score, ids, start, penalty):
    total = score[ids[0], path[0]]
    for t in range(1, len(path)):
        total += score[ids[t], path[t]] - (penalty if path[t] != path[t - 1] and not start[t] else 0)
    return total


@pytest.mark.parametrize("n", [1, 5, 127, 128, 129, 700])
def test_viterbi_is_the_best_path(n):
    rng = np.random.default_rng(n)
    score = -rng.random((50, 3)).astype(np.float32) * 5
    ids, start = rng.integers(0, 50, n), rng.random(n) < 0.05
    start[0] = True
    found = langid.viterbi(score, ids, start, 3.0)
    best, _ = brute(score, ids, start, 3.0)
    assert abs(value(found, score.astype(float), ids, start, 3.0) - best) < 1e-3


def test_spans_of_mixed_text(spark, model):
    rng = random.Random(9)
    a, b, c = sentence(rng, "aa", 30), sentence(rng, "gr", 12), sentence(rng, "bb", 20)
    text = f"{a} 12, {b} -- {c}"
    row = langid.identify(spark.createDataFrame([(text,)], "text string"), model).first()
    assert [s.lang for s in row.spans] == ["aa", "gr", "bb"]
    assert text[row.spans[1].start : row.spans[1].end] == b and row.spans[0].start == 0 and row.spans[2].end == len(text)
    assert row.lang_pred == "aa" and 0.4 < row.score < 0.6


def test_scripts_narrow_the_candidates(model):
    lang, score, spans = langid.label(model, ["ѠѠѠ ԱԲ", "жжжжж"])
    # a script that nobody uses tells nothing, but the text has a learnt language
    assert lang[0] in model.languages and lang[1] == "cy" and score[1] > 0.9


def test_null_empty_long_and_odd_texts(spark, model):
    rng = random.Random(2)
    long = " ".join([sentence(rng, "bb", 200)] * 4000)
    texts = [(1, None), (2, ""), (3, "12 ² ½ _ ... 'ʹ'"), (4, "́́ ́"), (5, long), (5, long), (None, "abcdef ghaabb"), (6, "x" * 500), (7, "ä\U0001f600 fgh")]
    rows = langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    by = [(r.doc_id, r.lang_pred) for r in rows]
    assert by[0] == (1, "und") and by[1] == (2, "und") and by[3] == (4, "und") and by[4] == by[5] == (5, "bb") and by[6] == (None, "aa")
    assert rows[0].score == 0 and rows[0].spans == [] and rows[4].score > 0.99 and rows[4].spans[-1].end == len(long)
    assert rows[4].spans == rows[5].spans and all(r.lang_pred in model.languages for r in rows[6:])


def test_long_texts_are_as_in_pieces(model):
    rng = random.Random(4)
    text = " ".join(sentence(rng, "aa", 3000) if i % 2 else sentence(rng, "bb", 3000) for i in range(80))
    whole = langid.label(model, [text] * 3)
    one = langid.label(model, [text])
    assert whole[0] == one[0] * 3 and whole[2][2] == one[2][0]


def test_words_are_cut_and_numbered():
    w = langid.words("Ab ab, 1ab" + "q" * 150, *langid.code_points())
    assert w.ids[0] == w.ids[1] and w.length.tolist() == [2, 2, 64, 64, 24] and w.start.tolist() == [0, 3, 8, 72, 136]


def test_nothing_learnt_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    m = langid.fit(docs)
    assert langid.identify(docs, m).first().lang_pred == "und"
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).count() == 0
