"""Chat formatting in budgeted windows.

Running sums of turn tokens cut a conversation into turn-aligned windows: a turn belongs to window
floor(tokens before it / budget).  Each window is one training text: the system turn, then as many
of the last turns before the window as fit into the history allowance, then its own turns.  The
loss mask covers the texts of assistant turns in the window they belong to; repeated turns and the
system turn carry none.

Template of a turn: ``<|turn|>role\\ntext<|end|>\\n``.  Control strings inside a role or a text are
escaped with character references (``&`` itself first), so the texts can be read back exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake.llm.common import SPACE, text_of
from siftlake.operators.prefix import number_within
from siftlake.session import cut

BUDGET = 256  # tokens (words) of own turns per window, but for the turn that passes it
HISTORY = 64  # tokens of repeated turns per window
TURN, END = "<|turn|>", "<|end|>\n"
# What opens a control string of this and other public chat templates.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TURN_KEY = ("key", "tkey", "role", "md5")
_MARKS = {"<": "&#60;", "[": "&#91;"}


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(_MARKS[control[0]] + control[1:]))
    return text


def unescape(text: Column) -> Column:
    for char, mark in _MARKS.items():
        text = F.replace(text, F.lit(mark), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window (from 0), n_turns, repeated (how many turns at its head
    are repeats), formatted, loss_spans array<struct<start, length>> in code points from 1.

    Rows follow ``turn`` (null first), equal turns role and the MD5 of the text; repeated rows are
    repeated turns.  Null roles and texts are empty, a null conversation is one of its own.  Only a
    system turn at the head of a conversation is retained; a later one is an ordinary turn.  A turn
    without words counts as one word.

    The running sums are taken over narrow rows and range-sorted partitions, so one conversation
    may hold any share of all turns; texts are joined to their windows once."""
    body = text_of(text)
    said = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), text_of(role).alias("role"),
                        body.alias("text"), F.md5(body.cast("binary")).alias("md5"))
    said = (said.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
            .withColumn("tkey", F.coalesce(F.concat(F.lit("="), F.col("turn").cast("string")), F.lit(""))))
    # a turn without words counts as one, so that a window has a bounded number of turns
    words = F.greatest(F.regexp_count("text", F.lit(f"[^{SPACE[1:-1]}]+")).cast("long"), F.lit(1))
    texts = said.groupBy(*_TURN_KEY).agg(F.first("text").alias("text"), F.first("conv_id").alias("conv_id"))
    narrow = said.select(*_TURN_KEY, "turn", words.alias("tokens"))
    rows = number_within(narrow, ["key"], ["turn", "role", "md5"], name="n", value="tokens")
    rows = cut(rows.select(*_TURN_KEY, "n", F.col("before").cast("long"), F.floor(F.col("before") / budget).cast("long").alias("window"),
                           ((F.col("n") == 1) & (F.col("role") == "system")).alias("system")), "turns")
    return _formatted(texts.join(_placed(rows, history), list(_TURN_KEY)))


def _placed(rows: DataFrame, history: int) -> DataFrame:
    """Each turn in its own window; besides, with ``repeat``, in the windows that repeat it."""
    spans = cut(number_within(rows.groupBy("key", "window").agg(F.min("before").alias("start")),
                              ["key"], ["window"], name="nth"), "spans")
    after = spans.select("key", (F.col("nth") - 1).alias("nth"), F.col("window").alias("later"), "start")
    nexts = spans.drop("start").join(after, ["key", "nth"])
    late = (rows.where(~F.col("system")).join(nexts, ["key", "window"])
            .where(F.col("start") - F.col("before") <= history))
    head = rows.where("system").join(spans.where("nth > 1").select("key", F.col("window").alias("later")), "key")
    columns = [*_TURN_KEY, "n"]
    own = rows.select(*columns, "window", F.lit(False).alias("repeat"))
    for more in (late, head):
        own = own.unionByName(more.select(*columns, F.col("later").alias("window"), F.lit(True).alias("repeat")))
    return own


def _formatted(rows: DataFrame) -> DataFrame:
    lead = F.concat(F.lit(TURN), _escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    loss = (F.col("role") == "assistant") & ~F.col("repeat")
    pieces = rows.select("key", "conv_id", "window", F.struct(
        "n", "repeat", lead.alias("lead"), body.alias("body"), loss.alias("loss")).alias("p"))
    whole = (pieces.groupBy("key", "conv_id", "window").agg(F.sort_array(F.collect_list("p")).alias("ps"))
             .withColumn("lengths", F.transform("ps", lambda p: F.char_length(p.lead) + F.char_length(p.body) + len(END))))
    starts = F.aggregate("lengths", F.array(F.lit(1).cast("long")), lambda a, x: F.concat(
        a, F.array(F.element_at(a, -1) + x)))
    spans = F.transform("ps", lambda p, i: F.when(p.loss, F.struct(
        (F.get("starts", i) + F.char_length(p.lead)).cast("long").alias("start"),
        F.char_length(p.body).cast("long").alias("length"))))
    return whole.withColumn("starts", starts).select(
        "conv_id", "window", F.size("ps").alias("n_turns"),
        F.size(F.filter("ps", lambda p: p.repeat)).alias("repeated"),
        F.array_join(F.transform("ps", lambda p: F.concat(p.lead, p.body, F.lit(END))), "").alias("formatted"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(texts: DataFrame) -> DataFrame:
    """Per conversation, from the formatted texts: conv_id, n_turns, turns (role, line feed, text,
    line feed, for each turn once), loss (all text under the mask) and formatted_chars."""
    turn = F.transform(
        F.slice(F.split(F.col("formatted"), r"<\|turn\|>"), F.lit(2), F.col("n_turns")),
        lambda piece: F.substring(piece, F.lit(1), F.char_length(piece) - len(END)))
    fresh_turns = F.slice(turn, F.col("repeated") + 1, F.greatest(F.col("n_turns") - F.col("repeated"), F.lit(0)))
    plain = F.transform(fresh_turns, lambda t: F.concat(
        _unescape_role(F.substring_index(t, "\n", 1)), F.lit("\n"),
        unescape(F.substring(t, F.instr(t, F.lit("\n")) + 1, F.char_length(t))), F.lit("\n")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(
        F.col("formatted"), s.start.cast("int"), s.length.cast("int")))), "")
    read = texts.select("conv_id", "window", F.array_join(plain, "").alias("turns"), loss.alias("loss"),
                        (F.col("n_turns") - F.col("repeated")).alias("n"), F.char_length("formatted").alias("chars"))
    whole = read.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"))
    return whole.select("conv_id", "n_turns", F.array_join(F.col("w.turns"), "").alias("turns"),
                        F.array_join(F.col("w.loss"), "").alias("loss"), "formatted_chars")
