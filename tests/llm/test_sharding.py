import random
import zlib

from treelens.llm import sharding


def check(rows, out, n=8, spread=None):
    assert len(out) == len(rows)
    by_text, slots, size = {}, {}, [0] * n
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {i: t or "" for i, t in rows}
    for r in out:
        t = text[r.doc_id]
        assert r["size"] == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
        assert by_text.setdefault(t, r.shard) == r.shard
    if spread is not None:
        assert max(size) - min(size) <= spread, size
    return size


def test_groups_stay_together_and_bytes_are_even(spark):
    rng = random.Random(4)
    rows = [(i, "é" * rng.randint(0, 400)) for i in range(900)]
    rows += [(1000 + i, "the same text again") for i in range(300)] + [(2000, None), (2001, ""), (2002, "z" * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as slot", "'a' as item", "4 as row", "5 as key")
    check(rows, sharding.shards(df).collect(), spread=40)


def test_repeated_rows_null_ids_and_ties(spark):
    rows = [(None, "a"), (None, "a"), (1, "a"), (1, "a"), (2, "b"), (None, None)]
    out = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 6 and len({(r.shard, r.slot) for r in out}) == 6
    assert len({r.shard for r in out if r["size"] == 2 and r.text_crc32 == zlib.crc32(b"a")}) == 1


def test_one_group_above_its_part(spark):
    rows = [(i, "x" * 1000) for i in range(50)] + [(100 + i, f"{i}") for i in range(70)]
    size = check(rows, sharding.shards(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sorted(size)[-1] == 50 * 1001 and max(sorted(size)[:-1]) - min(size) <= 4


def test_differencing_of_vectors():
    rng = random.Random(0)
    parts = [[rng.randint(0, 1000) for _ in range(4)] for _ in range(200)]
    where = sharding.differencing(parts)
    assert all(sorted(w) == [0, 1, 2, 3] for w in where)
    total = [0] * 4
    for p, w in zip(parts, where):
        for j, s in enumerate(w):
            total[s] += p[j]
    assert max(total) - min(total) <= 20
    # the textbook case: 8 7 6 5 4 in two parts leaves a difference of 2
    two = sharding.differencing([[v, 0] for v in (8, 7, 6, 5, 4)])
    sums = [0, 0]
    for v, w in zip((8, 7, 6, 5, 4), two):
        sums[w[0]] += v
    assert abs(sums[0] - sums[1]) == 2
    assert sharding.differencing([]) == []


def test_write_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    sharding.write(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and back.select("_shard").distinct().count() == 4
    assert sharding.shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
