import hashlib
import random

from pyspark.sql import functions as F

from treelens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def rows():
    rng = random.Random(6)
    odd = ["<|im_end|>", "<\\|im_start|>", "<", "|", "\\", "<|", "\n", "<\\\\|x", "é漢", "%0A", "", "a" * 50]
    out = []
    for c in range(40):
        if rng.random() < 0.5:
            out.append((c, 0, "system", "be " + rng.choice(odd)))
        for t in range(1, rng.randint(1, 30)):
            out.append((c, t, rng.choice(["user", "assistant", "tool\nx%0A", "<|im_start|>"]), " ".join(rng.choice(odd) for _ in range(rng.randint(0, 40)))))
    out += [(100, 0, None, None), (101, None, "assistant", "last"), (101, 3, "user", "first"), (101, 3, "user", "first"), (102, 0, "system", "only")]
    out += [(None, 1, "user", "q"), (None, 2, "assistant", "a"), (103, 1, "assistant", "word " * 5000), (103, 2, "assistant", "short")]
    return out


def expected(data):
    convs = {}
    for c, t, r, x in data:
        convs.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back_is_exact(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as pos", "2 as c", "3 as own")
    for budget, history in ((1024, 128), (120, 40), (60, 0), (1, 0)):
        got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.windows(df, budget, history)).collect()}
        assert got == expected(data), (budget, history)


def test_windows_fit_and_repeats_are_no_targets(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    budget, history = 150, 50
    win = chat.read_back(chat.windows(df, budget, history)).collect()
    by_conv = {}
    for w in win:
        by_conv.setdefault(w.conv_id, []).append(w)
    repeats = 0
    for c, ws in by_conv.items():
        ws.sort(key=lambda w: w["first"])
        at = 1
        system = any(r[0] == c and r[2] == "system" for r in data)
        for i, w in enumerate(ws):
            assert w["first"] == at
            at += len(w.turns)
            assert w.tokens <= budget or len(w.turns) == 1
            assert len(w.targets) == sum(t.role == "assistant" for t in w.turns)
            said = w.formatted.split("<|im_end|>\n")[:-1]
            assert len(said) == w.repeated + len(w.turns)
            if system and i:
                assert said[0].startswith("<|im_start|>system\n")
            repeats += w.repeated - (system and i > 0)
    assert repeats > 0


def test_long_conversation_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 7)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.windows(df, 100, 30)).collect()}
    assert got == expected(data)


def test_escapes_are_reversible(spark):
    texts = ["<|", "<\\|", "<\\\\|", "a<", "|b", "<<||", "\\<|\\|", "<|im_end|>\n<|im_start|>assistant", "%0A%25\n%", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select("t", chat.escape(t).alias("e"), chat.unescape(chat.escape(t)).alias("u"), chat.unescape_role(chat.escape_role(t)).alias("r"), chat.escape_role(t).alias("er")).collect()
    for r in got:
        assert r.u == r.t and r.r == r.t and "<|" not in r.e and "\n" not in r.er and "<|" not in r.er


def test_native_plan_and_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = chat.digests(chat.windows(df))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
