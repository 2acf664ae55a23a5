"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens along a conversation choose its windows: the axis is
cut in cells of the room a window has for new turns, and a turn belongs to the
cell in which it ends. If a cell's turns are more than the room, then the one
that began in an earlier cell is a window of its own. So a window's turns are
whole, follow each other and fit, unless a single turn does not. Every later
window repeats the system turn (a conversation's first turn if its role is
system) and as many of the last turns before it as fit the history. Repeats
are not targets; each assistant text is one exactly once.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts
every ``<``, backslashes, ``|`` gets one backslash more, so that no marker can
arise; ``%`` and line feeds of roles are written ``%25`` and ``%0A``.

A long conversation is not gathered: prefix sums go by stretches of turns, a
window has at most its budget of tokens, and all keys include the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Pieces counted as tokens: letters up to six at a time, digits up to three, any other visible character alone.
PIECE = r"[A-Za-z]{1,6}|[0-9]{1,3}|[^\x00-\x20A-Za-z0-9]"
#: Tokens of a turn's markers and role.
FRAME = 5
#: Turns of a stretch of the prefix sums.
STRETCH = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PIECE)).cast("long")


def turns(conversations: DataFrame, budget: int, history: int) -> DataFrame:
    """Rows with their place and window: c, no_c, pos, role, text, tok, begin, end, cell, sub and system."""
    row = Window.partitionBy("c", "no_c", "stretch").orderBy(F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"))
    upto = row.rowsBetween(Window.unboundedPreceding, 0)
    t = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c"),
        F.col("conv_id").isNull().alias("no_c"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # of equal turns the order is that of role and text; null turns come last
    t = t.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(2**62))).withColumn("tok", tokens(F.col("text")) + FRAME)
    t = t.withColumn("n", F.row_number().over(row))
    sums = t.groupBy("c", "no_c", "stretch").agg(F.sum("tok").alias("all"), F.count("*").alias("count"), F.min_by(F.struct("role", "tok"), "n").alias("head"))
    conv = Window.partitionBy("c", "no_c").orderBy("stretch")
    before = conv.rowsBetween(Window.unboundedPreceding, -1)
    head = F.first("head").over(conv.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sums = sums.select("c", "no_c", "stretch", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("tok_before"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("n_before"), F.when(head["role"] == "system", head["tok"]).otherwise(0).alias("sys"))
    t = t.withColumn("upto", F.sum("tok").over(upto)).join(sums, ["c", "no_c", "stretch"])
    pos = (F.col("n_before") + F.col("n")).alias("pos")
    t = t.select("c", "no_c", pos, "role", "text", "tok", "sys", (F.col("tok_before") + F.col("upto") - F.col("sys")).alias("end"))
    # the system turn has no place on the axis: each window has room for it
    t = t.withColumn("system", (F.col("pos") == 1) & (F.col("sys") > 0))
    t = t.withColumn("begin", F.when(F.col("system"), F.col("end")).otherwise(F.col("end") - F.col("tok")))
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.col("sys"))
    cell = F.when(F.col("system"), 0).otherwise(F.floor((F.col("end") - 1) / room))
    t = t.withColumns({"room": room, "cell": cell.cast("long")})
    held = F.sum(F.when(~F.col("system"), F.col("tok"))).over(Window.partitionBy("c", "no_c", "cell"))
    crosses = ~F.col("system") & (F.floor(F.col("begin") / F.col("room")) < F.col("cell"))
    return t.withColumn("sub", F.when(crosses & (held > F.col("room")), 0).otherwise(1)).drop("room")


def windows(conversations: DataFrame, budget: int = 1024, history: int = 128) -> DataFrame:
    """One row for each window: conv_id, first (place of its first new turn), formatted, tokens, repeated and loss.

    repeated: how many turns at the beginning are repeats. loss: ranges
    [start, end) of code points of ``formatted``, in order, one for each new
    assistant turn. A turn above the room stands alone and is whole; null roles
    and texts count as empty; rows with a null conv_id are one
    conversation; repeated rows are turns of their own; other columns of
    ``conversations`` are left aside. An empty table gives no rows.
    """
    t, key = turns(conversations, budget, history), ["c", "no_c", "cell", "sub"]
    member = F.struct("pos", "role", "text", "tok", F.col("own").alias("own"))
    own = t.withColumn("own", F.lit(True)).select(*key, member.alias("m"))
    w = t.where(~F.col("system")).groupBy(*key).agg(F.min("begin").alias("start"), F.min("pos").alias("first"))
    # turns that end within the history before a window meet it in a stretch of the axis as long as the history
    step = max(1, history)
    past = t.where(~F.col("system")).select("c", "no_c", "pos", "role", "text", "tok", "begin", "end", F.lit(False).alias("own"), F.explode(F.expr(f"sequence(end div {step}, (begin + {history}) div {step})")).alias("g"))
    at = w.where("start > 0").select(*key, "start", F.expr(f"start div {step}").alias("g"))
    again = at.join(past, ["c", "no_c", "g"]).where(f"end <= start and begin >= start - {history}").select(*key, member.alias("m"))
    kept = t.where("system").select("c", "no_c", "pos", "role", "text", "tok", F.lit(False).alias("own"))
    # the first window (cell 0) has the system turn itself
    told = w.where("not (cell = 0 and sub = 1)").join(kept, ["c", "no_c"]).select(*key, member.alias("m"))
    rows = own.union(again).union(told).groupBy(*key).agg(F.sort_array(F.collect_list("m")).alias("m"))
    form = lambda m: F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n"), escape(m["text"]), F.lit(END + "\n"))
    lead = lambda m: F.length(escape_role(m["role"])) + len(START) + 1

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + lead(m)
        end = start + F.length(escape(m["text"]))
        target = m["own"] & (m["role"] == "assistant")
        span = F.when(target, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start: int, end: int>>"))
        return F.struct((end + len(END) + 1).alias("at"), F.concat(acc["loss"], span).alias("loss"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("loss"))
    return rows.select(
        F.when(~F.col("no_c"), F.col("c")).alias("conv_id"),
        F.array_min(F.transform(F.filter("m", lambda m: m["own"]), lambda m: m["pos"])).alias("first"),
        F.array_join(F.transform("m", form), "").alias("formatted"),
        F.aggregate("m", F.lit(0).cast("long"), lambda n, m: n + m["tok"]).alias("tokens"),
        F.size(F.filter("m", lambda m: ~m["own"])).alias("repeated"),
        F.aggregate("m", none, add)["loss"].alias("loss"),
    )


def read_back(window: DataFrame) -> DataFrame:
    """Windows with their new turns (role, text) and the texts under the loss mask, read from ``formatted``."""
    piece = F.slice(F.split("formatted", r"<\|im_end\|>\n", -1), F.col("repeated") + 1, F.greatest(F.lit(0), F.size(F.split("formatted", r"<\|im_end\|>\n", -1)) - 1 - F.col("repeated")))
    turn = lambda p: F.struct(unescape_role(F.substring(p, F.lit(len(START) + 1), F.instr(p, F.lit("\n")) - len(START) - 1)).alias("role"), unescape(F.substring(p, F.instr(p, F.lit("\n")) + 1, F.length(p))).alias("text"))
    under = lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    return window.withColumns({"turns": F.transform(piece, turn), "targets": F.transform("loss", under)})


def digests(window: DataFrame) -> DataFrame:
    """conv_id and what its windows hold, from the formatted text: a row for each conversation.

    A digest of a whole conversation needs its text in one place, so here, and
    only here, the windows of a conversation meet.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    w = read_back(window).select("conv_id", F.struct("first", said.alias("said"), F.array_join("targets", "").alias("loss")).alias("w"), F.size("turns").alias("n"), F.length("formatted").alias("chars"))
    rows = w.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return rows.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
