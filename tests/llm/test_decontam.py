import random
import re

from treelens.llm import decontam

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    wanted = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in wanted}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wanted:
                    hit |= set(range(i, i + n))
                    found |= wanted[tuple(w[i : i + n])]
        out.append((doc_id, len(w), sorted(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def got(df):
    rows = []
    for r in df.collect():
        rows.append((r.doc_id, r.n_words, [p for s in r.spans for p in range(s.start, s.end)], list(r["items"])))
    return sorted(rows, key=str)


def cases():
    rng = random.Random(1)
    vocab = ["the", "of", "é", "w1", "w2", "w3", "X9"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 7, 12, 13, 14, 30]))) for i in range(3, 25)]
    items += [(100, None), (101, ""), (None, text(20)), (5, text(15)), (102, items[4][1]), (103, "...")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    for i in range(40):
        a = rng.choice(items)[1] or ""
        docs.append((i, f"{text(5)}, {a.upper()}; {text(rng.randint(0, 200))}"))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, "?!"), (3, docs[3][1]), (203, "x " * 100000 + items[10][1])]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as `_text`", "3 as row", "4 as `c.d`", "5 as _k1")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as spans")
    truth = brute(docs, items)
    assert got(decontam.overlaps(d, b, carry=["doc_id"])) == truth
    # the same in blocks of a few items
    assert got(decontam.overlaps(d, b, carry=["doc_id"], block_bytes=600)) == truth


def test_long_text_in_pieces():
    from treelens.llm.common import alnum_words, word_ids

    text = ("Ab c9, é " * 500 + "x" * 300 + " ").encode()
    ids = {b"ab": 0, b"c9": 1, "é".encode(): 2, b"x" * 300: 3}
    whole = [ids.get(w, -1) for w in alnum_words(text)]
    for piece in (50, 97, 10**6):
        assert word_ids(text, ids, piece).tolist() == whole


def test_rule_and_columns(spark):
    passage = " ".join(f"a{i}" for i in range(13))
    docs = [(1, passage, "s"), (2, f"{passage} {'b ' * 247}", "s"), (3, f"{passage} {'b ' * 248}", None), (4, "clean", "s"), (5, None, "s")]
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    kept = decontam.remove(df, items)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontam.overlaps(docs, one.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert got(decontam.overlaps(one, items)) == [(1, 2, [], [])]


def test_blocks_keep_their_bound_and_cut_long_items(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(3000))
    items = [("long", long), ("short", "only four words here"), (None, "a b c d e f g h i j k l m n"), ("none", "  "), ("twice", long[:400]), ("twice", long[:400])]
    own = spark.createDataFrame([(i, t.encode()) for i, t in items], "item_id string, text binary")
    each = 4 * 13 + decontam.OWNER
    parts = list(decontam.blocks(own, 13, 20_000))
    sizes = [sum(max(1, len(t.split()) - 12) * each for _, t in p) for p in parts]
    assert len(parts) > 5 and max(sizes) <= 20_000
    cut = lambda texts: {(i, tuple(w[k : k + 13])) for i, t in texts for w in [t.split()] for k in range(max(1, len(w) - 12)) if w}
    assert cut((i, t) for p in parts for i, t in p) == cut((i, t.encode()) for i, t in items)
    # what is held takes about what was reckoned
    block = decontam.Block.build(parts[0], 13)
    held = sum(w.nbytes for w in block.windows.values()) + sum(e.nbytes + o.nbytes for e, o in block.owners.values())
    assert held <= sizes[0]
    words = long.split()
    docs = [(1, " ".join(words[500:900])), (2, "x " + " ".join(words[1000:1013])), (3, " ".join(words[1000:1012])), (4, "Only, four words HERE."), (5, None), (6, "a b c d e f g h i j k l m n")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    whole = got(decontam.overlaps(d, b, carry=["doc_id"]))
    assert whole == got(decontam.overlaps(d, b, carry=["doc_id"], block_bytes=20_000))
    assert [(r[0], r[1], r[3]) for r in whole] == [(1, 400, ["long"]), (2, 14, ["long"]), (3, 12, []), (4, 4, ["short"]), (5, 0, []), (6, 14, [])]
