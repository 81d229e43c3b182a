"""Chat formatting in budgeted windows, by DataFrame functions alone.

Template: each turn is `### <role>: <text></turn>` and a line feed. Inside texts and roles the backslash, `<` and `#` (and in
roles `:`) are written as backslash and a letter, so no control string can occur in a text and the change is reversible.

Windows: prefix sums of turn tokens choose turn-aligned spans. With a stride of half the free budget, a turn belongs to
span floor(prefix sum / stride); a turn longer than the stride starts a span of its own. So a span has at most the free
budget, unless a single turn is longer. Each window holds the system turn (the first turn, if its role is system), the last
turns of the span before it up to `history` tokens, and its own span. The loss mask covers texts of assistant turns
in the own span; repeated targets are masked out.

Cases: null text is empty, null role an empty role; a null conv_id is a conversation of its own; turns are ordered by turn
(nulls first), then role and text, so repeated rows are turns of their own. A system turn over the budget leaves a stride of 1,
so every other turn has a window of its own, with the system turn repeated in each. A turn of any length is kept whole. Empty tables give no windows. Extra columns
are ignored. One conversation is put together in one task, as its digest needs it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import only

TURN_END = "</turn>"
#: What stands for a control character: written with a backslash before it.
CODES = (("\\", "b"), ("<", "l"), ("#", "h"))
TOKEN = r"[\p{L}\p{N}]+|[^ \t\n\r\f\p{L}\p{N}]"


def escaped(text: Column, more: tuple = ()) -> Column:
    for char, code in (*CODES, *more):
        text = F.replace(text, F.lit(char), F.lit("\\" + code))
    return text


def unescaped(text: Column, more: tuple = ()) -> Column:
    for char, code in reversed((*CODES, *more)):
        text = F.replace(text, F.lit("\\" + code), F.lit(char))
    return text


def tokens(text: Column) -> Column:
    """Words and marks, and two for the turn's own frame."""
    return (F.regexp_count(text, F.lit(TOKEN)) + 2).cast("long")


def chat_windows(conversations: DataFrame, budget: int = 512, history: int = 96) -> DataFrame:
    """One row per window: conv_id, window (0, 1, ...), n_repeated (turns that stood in an earlier window), formatted, and
    loss (array of struct start, length: 0-based code points of formatted). budget and history count tokens()."""
    rows = only(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("ordinal", F.row_number().over(order)).withColumn("tokens", tokens(F.col("text")))
    by_turn = Window.partitionBy("conv_id").orderBy("ordinal")
    rows = rows.withColumn("system", (F.col("ordinal") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn(
        "stride",
        F.greatest(F.lit(1), F.floor((budget - history - F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(whole)) / 2)),
    )
    rows = rows.withColumn("sum", F.sum(F.when(F.col("system"), 0).otherwise(F.col("tokens"))).over(by_turn))
    span = F.struct(F.floor(F.col("sum") / F.col("stride")).alias("k"), F.when(F.col("tokens") > F.col("stride"), 0).otherwise(1).alias("short"))
    rows = rows.withColumn("span", F.when(F.col("system"), F.struct(F.lit(-1).cast("long").alias("k"), F.lit(0).alias("short"))).otherwise(span))
    # the system turn shares the first window
    rows = rows.withColumn(
        "new",
        F.when(F.col("system"), 0).otherwise(F.coalesce(
            (F.lag("span").over(by_turn) != F.col("span")) & ~F.coalesce(F.lag("system").over(by_turn), F.lit(False)),
            F.lit(False),
        ).cast("int")),
    )
    rows = rows.withColumn("window", F.sum("new").over(by_turn))
    rows = rows.withColumn("last", F.max("window").over(whole))
    # tokens from this turn to the end of its span
    rows = rows.withColumn("after", F.max("sum").over(Window.partitionBy("conv_id", "window")) - F.col("sum") + F.col("tokens"))
    last, after = F.col("last"), F.col("after")
    own = F.array(F.col("window"))
    again = F.when(
        F.col("system"),
        F.when(last > 0, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<bigint>")),
    ).when((after <= history) & (F.col("window") < last), F.array(F.col("window") + 1)).otherwise(F.array().cast("array<bigint>"))
    placed = rows.select("conv_id", "ordinal", "role", "text", F.col("window").alias("own"), F.explode(F.concat(own, again)).alias("window"))
    piece = F.concat(F.lit("### "), escaped(F.col("role"), ((":", "c"),)), F.lit(": "))
    placed = placed.select(
        "conv_id",
        "window",
        F.struct(
            "ordinal",
            (F.col("own") < F.col("window")).alias("repeated"),
            F.col("role").alias("role"),
            piece.alias("head"),
            escaped(F.col("text")).alias("body"),
        ).alias("t"),
    )
    windows = placed.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    formatted = F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END + "\n"))), "")
    empty = F.array().cast("array<struct<start:bigint,length:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(s: Column, t: Column) -> Column:
        at = s["at"] + F.length(t["head"])
        n = F.length(t["body"]).cast("long")
        spans = F.when(
            (t["role"] == "assistant") & ~t["repeated"],
            F.array_append(s["spans"], F.struct(at.alias("start"), n.alias("length"))),
        ).otherwise(s["spans"])
        return F.struct((at + n + len(TURN_END) + 1).alias("at"), spans.alias("spans"))

    loss = F.aggregate("ts", start, step, lambda s: s["spans"])
    return windows.select(
        "conv_id",
        "window",
        F.size(F.filter("ts", lambda t: t["repeated"])).alias("n_repeated"),
        formatted.alias("formatted"),
        loss.alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Back from formatted windows: one row per window with its new turns (array of struct role, text) and loss_texts."""
    # slice(-1) drops what follows the last turn end
    chunks = F.split("formatted", TURN_END + "\n")
    chunks = F.slice(chunks, F.col("n_repeated") + 1, F.size(chunks) - 1 - F.col("n_repeated"))

    def turn(c: Column) -> Column:
        at = F.instr(c, ": ")
        return F.struct(unescaped(F.substring(c, F.lit(5), at - 5), ((":", "c"),)).alias("role"), unescaped(F.substring(c, at + 2, F.length(c))).alias("text"))

    texts = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.select(
        "conv_id",
        "window",
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.transform(chunks, turn).alias("turns"),
        texts.alias("loss_texts"),
    )


def chat_digest(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    w = read_windows(windows)
    texts = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    w = w.select(
        "conv_id",
        "formatted_chars",
        F.size("turns").alias("n"),
        F.struct("window", texts.alias("turns"), F.array_join("loss_texts", "").alias("loss")).alias("w"),
    )
    w = w.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sum("formatted_chars").cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list("w")).alias("ws"),
    )
    turns = F.array_join(F.transform("ws", lambda x: x["turns"]), "")
    loss = F.array_join(F.transform("ws", lambda x: x["loss"]), "")
    return w.select(
        "conv_id",
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
