import hashlib
import random
import re
import zlib

from treelens.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        paths[c] = own.get(base, [])[:h] + turns[h:]
    nodes: dict = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    saved = {k: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0 for k, m in nodes.items()}
    children = {k: sum(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes) for k in nodes}
    out = []
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        ended = ",".join(str(c) for c in sorted(c for c in members if len(paths[c]) == len(k)))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], sum(children[x] == 0 for x in below), sum(saved[x] for x in below), hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in trie.prefixes(df).collect()), key=str)


def rows(seed, n=60, spread=200):
    rng = random.Random(seed)
    texts = ["hi", "how are you", "ok then", "", None, "a  b\tc"]
    out = []
    for c in rng.sample(range(-40, spread), n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 7])):
            out.append((c, t if t else rng.choice([0, None]), rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else ["user", "assistant"][t % 2], rng.choice(texts)))
    rng.shuffle(out)
    return out


def test_as_brute_force(spark):
    for seed in (1, 2):
        some = rows(seed) + [(None, 0, "user", "lost")]
        assert found(spark.createDataFrame(some, SCHEMA).selectExpr("*", "1 as depth", "2 as c")) == brute(some)


def test_turnless_conversations(spark):
    # all turns of 5 are its model's, and there is no model
    c = next(i for i in range(1, 400) if i % 20 and zlib.crc32(str(i).encode()) % 4 >= 2)
    alone = [(c, 0, "user", "x")]
    assert found(spark.createDataFrame(alone, SCHEMA)) == brute(alone) and brute(alone)[0][5] == 1
    more = alone + [(1000, 0, "user", "x"), (1000, 1, "user", "y")]
    assert found(spark.createDataFrame(more, SCHEMA)) == brute(more)


def test_copies_and_repeats(spark):
    some = [(c, t, "user", f"same {t}") for c in range(3000, 3400, 7) for t in range(4)] + [(3001, 0, "user", "z")] * 3
    df = spark.createDataFrame(some, SCHEMA)
    assert found(df) == found(df.repartition(7)) == brute(some)


def test_long_conversation_over_stretches(spark):
    some = [(21, t, "user", f"t{t % 5} w") for t in range(-5, 2600)] + [(22, t, "user", f"t{t % 5} w") for t in range(-5, 1500)] + [(20, None, "user", "first")]
    got = {(r[0], r[1]): r for r in trie.prefixes(spark.createDataFrame(some, SCHEMA)).collect()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in (21, 22)}
    n = {c: (2605 if c == 21 else 1505) - h[c] + min(1, h[c]) for c in h}
    assert max(d for c, d in got if c == 21) == n[21] and len([1 for _, d in got if d == 0]) == 1
    # the root's subtree has every node once
    assert sum(r[4] for r in got.values()) == len(got) - 1


def test_empty_table(spark):
    assert trie.prefixes(spark.createDataFrame([], SCHEMA)).count() == 0
