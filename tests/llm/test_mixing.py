import random
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from treelens.llm import mixing


def seat_by_seat(votes, seats, caps):
    out = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if votes[i] > 0 and out[i] < caps[i]]
        if not open_:
            break
        out[max(open_, key=lambda i: (Fraction(votes[i]) / (2 * out[i] + 1), -i))] += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 60)), min_size=1, max_size=9), st.integers(0, 120))
def test_apportionment_equals_seat_by_seat(parties, seats):
    votes, caps = [p[0] for p in parties], [p[1] for p in parties]
    assert mixing.sainte_lague(votes, seats, caps) == seat_by_seat(votes, seats, caps)


def test_targets_reshare_until_none_is_above():
    sizes = {"a": 100, "b": 1000, "c": 10, None: 400}
    t = mixing.targets(sizes)
    assert abs(sum(t.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(t[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert t["a"] == 200 and t["c"] == 20
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def table(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        rows.append((i, " ".join("w" for _ in range(rng.randint(0, 90))), rng.choice(["s1", "s2", "s3", "s4", None, "é"])))
    rows += [(500, None, "s1"), (501, "", "none"), (7, rows[7][1], rows[7][2]), (None, "a b c", "s2"), (None, "a b c", "s2"), (502, "w " * 30000, "s4")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_is_near_its_targets_and_reruns_agree(spark):
    rows, df = table(spark)
    df = df.selectExpr("*", "1 as size", "2 as taken", "3 as shard", "4 as row", "5 as key", "6 as s")
    for shard_tokens in (1_000_000, 2_000):
        out = mixing.mix(df, shard_tokens=shard_tokens).collect()
        assert len(out) == len(rows)
        size, target, taken = {}, {}, {}
        for r in out:
            assert 0 <= r.taken <= 2 * r["size"]
            size[r.source] = size.get(r.source, 0) + r["size"]
            taken[r.source] = taken.get(r.source, 0) + r.taken
            target[r.source] = r.target
            assert r.taken == r.times * r["size"] + sum(x.end - x.start for x in r.runs)
        expected = mixing.targets(size)
        for s in size:
            assert abs(target[s] - expected[s]) < 1e-6
            # half a block for the source, and what rounding to blocks costs in each of its shards
            assert abs(taken[s] - target[s]) <= mixing.BLOCK * (1 + 0.5 * -(-size[s] // shard_tokens)), s
        again = mixing.mix(df.repartition(7), shard_tokens=shard_tokens)
        key = lambda r: (str(r.doc_id), r["size"], r.taken)
        assert sorted(map(key, out)) == sorted(map(key, again.collect()))


def test_apply_gives_the_words_taken(spark):
    rows, df = table(spark)
    taken = sum(r.taken for r in mixing.mix(df).collect())
    out = mixing.apply(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sum(len((r.text or "").split()) for r in got) == taken
    texts = {(r[0], r[1]) for r in rows}
    whole = sum((r.doc_id, r.text) in texts for r in got)
    assert whole >= 0.9 * len(got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.apply(df).count() == 0


def test_apply_keeps_white_space_of_what_it_cuts(spark):
    lines = "".join(f"line {i}\n    indented\ttext {i}\n\n" for i in range(400))
    df = spark.createDataFrame([(i, f"  {lines}", "abc"[i % 3]) for i in range(7)], "doc_id long, text string, source string")
    got = mixing.apply(df).collect()
    part = [r.text for r in got if r.text != f"  {lines}"]
    assert part and all(t.rstrip() in f"  {lines}" or "\n    indented\ttext" in t for t in part)
    assert sum(len(r.text.split()) for r in got) == sum(r.taken for r in mixing.mix(df).collect())
