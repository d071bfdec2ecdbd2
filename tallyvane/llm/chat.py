"""Chat formatting with a grammar round trip (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role -> (opening, closing) control string; any other role is written between the three ROLE strings.
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
CONTROL = r"\[/?INST\]|</?s>|<</?SYS>>|<</?ROLE>>|<<TEXT>>"
TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|<<ROLE>>.*?<<TEXT>>.*?<</ROLE>>"
#: Escaped text has a backslash only before 0, 1 or 2, which stand for backslash, [ and <.
ESCAPES = (("\\1", "["), ("\\2", "<"), ("\\0", "\\"))


def escape(text: Column, level: int) -> Column:
    """Level 0: as it is. 1: backslashes, and the first character of control strings. 2: every backslash, [ and <."""
    if level == 0:
        return text
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    if level == 1:
        out = F.regexp_replace(out, r"\[(?=/?INST\])", r"\\1")
        return F.regexp_replace(out, r"<(?=/?s>|</?SYS>>|</?ROLE>>|<TEXT>>)", r"\\2")
    return F.replace(F.replace(out, F.lit("["), F.lit("\\1")), F.lit("<"), F.lit("\\2"))


def unescape(text: Column) -> Column:
    for mark, plain in ESCAPES:
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def _affix(role: Column, k: int, level: int) -> Column:
    other = F.concat(F.lit(OTHER[0]), escape(role, level), F.lit(OTHER[1])) if k == 0 else F.lit(OTHER[2])
    out = F.when(role == "user", TURNS["user"][k])
    for name in ("assistant", "system"):
        out = out.when(role == name, TURNS[name][k])
    return out.otherwise(other)


def _render(turns: Column, level: int) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(_affix(t["role"], 0, level), escape(t["text"], level), _affix(t["role"], 1, level))), ""
    )


def _inside(turn: Column, opening: str, closing: str) -> Column:
    return F.substr(turn, F.lit(len(opening) + 1), F.length(turn) - len(opening) - len(closing))


def _read(turn: Column) -> Column:
    """The raw role and text of one rendered turn."""
    out = None
    for role, (opening, closing) in TURNS.items():
        found = F.struct(F.lit(role).alias("role"), _inside(turn, opening, closing).alias("text"))
        out = (F if out is None else out).when(turn.startswith(opening), found)
    body = _inside(turn, OTHER[0], OTHER[2])
    at = F.instr(body, OTHER[1])
    return out.otherwise(
        F.struct(F.substr(body, F.lit(1), at - 1).alias("role"), F.substr(body, at + len(OTHER[1]), F.length(body)).alias("text"))
    )


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, as array<struct<role, text>>.

    Null if the text is not a gapless sequence of turns, or a turn holds a control string that is not escaped.
    """
    found = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    raw = F.transform(found, _read)
    sound = (F.array_join(found, "") == formatted) & ~F.exists(raw, lambda t: F.concat_ws("\n", t["role"], t["text"]).rlike(CONTROL))
    return F.when(sound, F.transform(raw, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))))


def format_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, escape_level, turns (reparsed), loss_spans.

    Turns come in the order of turn (nulls first), then role and text, so repeated turn numbers have a fixed order; null
    role and text are empty. Rows whose conv_id is null form one conversation. A conversation is rendered as it is,
    reparsed and compared with its source; if they differ, its contents are escaped one level further, until they are
    identical (level 2 leaves no control character, so it always is). loss_spans holds (start, stop) of every assistant
    text in formatted, in code points. Other columns are left out. A conversation is one group: its formatted text is
    one value and must fit in memory.
    """
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    source = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source")
    )
    tried = source.withColumn("f0", _render(F.col("source"), 0)).withColumn("ok0", F.coalesce(parse(F.col("f0")) == F.col("source"), F.lit(False)))
    tried = tried.withColumn("f1", F.when(~F.col("ok0"), _render(F.col("source"), 1)))
    tried = tried.withColumn("ok1", F.coalesce(parse(F.col("f1")) == F.col("source"), F.lit(False)))
    level = F.when(F.col("ok0"), 0).when(F.col("ok1"), 1).otherwise(2)
    done = tried.select("conv_id", level.alias("escape_level"), F.when(F.col("ok0"), F.col("f0")).when(F.col("ok1"), F.col("f1")).otherwise(_render(F.col("source"), 2)).alias("formatted"))
    found = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0))
    opening, closing = TURNS["assistant"]

    def step(state: Column, piece: Column) -> Column:
        stop = state["at"] + F.length(piece)
        span = F.struct((state["at"] + len(opening)).alias("start"), (stop - len(closing)).alias("stop"))
        return F.struct(stop.alias("at"), F.when(piece.startswith(opening), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"))
    return done.select(
        "conv_id", "formatted", "escape_level", parse(F.col("formatted")).alias("turns"), F.aggregate(found, begin, step, lambda s: s["spans"]).alias("loss_spans")
    )


def turn_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from format_conversations' output: its turns, and all text under its loss mask."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))), "")
    return formatted.withColumn("loss_text", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
