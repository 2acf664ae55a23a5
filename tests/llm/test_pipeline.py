import random

import pytest

import corpus_pipeline
from treelens.llm import mixing

BAD = ["idiot", "scum", "trash", "loser"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables, and which documents of it are toxic, copies, contaminated or clean."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(30))) for i in range(5)]
    docs, labels, kind = [], [], {}
    for i in range(400):
        what = rng.choices(["clean", "toxic", "copy", "near", "dirty"], [6, 2, 1, 1, 1])[0]
        body = text(rng.randint(60, 150))
        if what == "toxic":
            for _ in range(6):
                body[rng.randrange(len(body))] = rng.choice(BAD)
        if what == "dirty":
            body[10:10] = items[i % 5][1].split()
        if what in ("copy", "near"):
            sources = [d for d in docs if kind[d[0]][0] == "clean"]
            if sources:
                first = rng.choice(sources)
                body = first[1].split()
                if what == "near":
                    body = [*body, ""]  # other white space, the same words
                kind[i] = ("copy", first[0])
        kind.setdefault(i, (what if what not in ("copy", "near") else "clean", None))
        docs.append((i, " ".join(body), "en", f"s{i % 4}", len(" ".join(body))))
        labels.append((i, 1, int(what == "toxic")))
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs, kind


def test_each_stage_keeps_what_it_should(spark, corpus):
    at, docs, kind = corpus
    rows = spark.read.parquet(f"{at}/documents.parquet")
    names = rows.columns
    expected = {i for i, (what, _) in kind.items() if what != "toxic"}
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:3], ("toxic", "copy", "dirty")):
        rows = stage(spark, rows, at).cache()
        assert rows.columns == names, name
        got = {r.doc_id for r in rows.collect()}
        expected = {i for i in expected if kind[i][0] != gone}
        # one toxic document in fifty may slip through, no clean one may be lost
        assert expected <= got, name
        assert len(got - expected) <= 0.02 * len(docs), name
    kept = rows.collect()
    text = {r.doc_id: r.text for r in kept}
    assert all(text[d[0]] == d[1] for d in docs if d[0] in text)
    plan = mixing.mix(rows).collect()
    mixed = corpus_pipeline.STAGES[3][1](spark, rows, at)
    assert mixed.columns == names
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in plan)


def test_run_is_all_stages(spark, corpus):
    at, _, kind = corpus
    out = corpus_pipeline.run(spark, at).collect()
    assert len({(r.shard, r.slot) for r in out}) == len(out) and {r.shard for r in out} == set(range(8))
    ids = {r.doc_id for r in out}
    assert not any(kind[i][0] in ("copy", "dirty") for i in ids)
    size = [sum(r["size"] for r in out if r.shard == s) for s in range(8)]
    assert max(size) - min(size) <= max(r["size"] for r in out)


def test_empty_and_null_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", None, None, 0), (2, "a b " * 50, "en", None, 200)]
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
