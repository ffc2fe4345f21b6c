"""Conversations as budgeted training windows with a loss mask; Column expressions and windows only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.common import word_count

#: Control strings of the template: a turn is OPEN role TEXT text CLOSE.
OPEN, TEXT, END_TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
CLOSE = END_TEXT + END
CONTROL = r"([<\[])(/?s>|/?INST\])"
TARGET, SYSTEM = "assistant", "system"
#: Tokens that the template adds to a turn.
TURN_TOKENS = 4


def escaped(text: Column) -> Column:
    """The text with no control string in it: a backslash goes into each, and before its own."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def words_as_tokens(text: Column) -> Column:
    return word_count(text)


def chat_windows(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = 512,
    history_tokens: int = 128,
    history_turns: int = 2,
    tokens: Callable[[Column], Column] = words_as_tokens,
) -> DataFrame:
    """Rows `(conv_id, window, formatted, mask, repeated, tokens)`, windows numbered from 1.

    A conversation is cut into spans of whole turns by the prefix sums of their tokens. Each
    window holds the system turn (a first turn of that role), then up to `history_turns`
    turns before the span that have `history_tokens` tokens together at most, then the span.
    Each turn is in one span only. `repeated` counts the turns that an earlier window had as
    its own; they come first. `mask` has the code points `(start, end)` of the escaped texts
    of the span's own assistant turns, so a repeated target is masked out.

    The room for a span is the budget less history and system turn, a quarter of the budget
    at least. With blocks of half the room, a span is the turns whose prefix sums end in one
    block, and a turn of more than a block is a span alone. The first turn of a span begins
    less than a block before its block, so no window exceeds the budget but for a single turn
    or a system turn that does.

    Windows are built by conversation and window number, so none gathers more than its budget;
    the prefix sums of one conversation run in one task, row by row with spill.

    Turns are ordered by turn (null last), role, text; repeated rows are turns each. Null
    roles and texts are empty; a null id is a conversation; an empty table has no windows.
    Columns of other names are ignored.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("tokens", tokens(F.col("text")) + TURN_TOKENS)
    conversation = Window.partitionBy("conv_id")
    order = conversation.orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("is_system", (F.col("n") == 1) & (F.col("role") == SYSTEM))
    rows = rows.withColumn(
        "system_tokens", F.first(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(order)
    )
    room = F.greatest(F.lit(budget - history_tokens) - F.col("system_tokens"), F.lit(budget // 4))
    own = F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("tokens"))
    rows = (
        rows.withColumn("block", F.floor(room / 2))
        .withColumn("end", F.sum(own).over(order))
        .withColumn("start", F.col("end") - own)
        .withColumn(
            "place",
            F.when(
                ~F.col("is_system"),
                F.struct(F.ceil(F.col("end") / F.col("block")), F.col("tokens") > F.col("block")),
            ),
        )
    )
    before = F.lag("place").over(order)
    opens = F.col("place").isNotNull() & (before.isNull() | (F.col("place") != before))
    rows = rows.withColumn("opens", opens.cast("int"))
    rows = rows.withColumn("span", F.greatest(F.lit(1), F.sum("opens").over(order)))
    uses = [F.array(F.struct(F.col("span").alias("window"), F.lit(False).alias("repeated")))]
    for ahead in range(1, history_turns + 1):
        later = conversation.orderBy("span").rangeBetween(ahead, ahead)
        rows = rows.withColumn(f"n_{ahead}", F.min("n").over(later))
        rows = rows.withColumn(f"start_{ahead}", F.min("start").over(later))
        near = (F.col(f"n_{ahead}") - F.col("n") <= history_turns) & (
            F.col(f"start_{ahead}") - F.col("start") <= history_tokens
        )
        use = F.struct((F.col("span") + ahead).alias("window"), F.lit(True).alias("repeated"))
        uses.append(F.when(near & ~F.col("is_system"), F.array(use)))
    rows = rows.withColumn("spans", F.max("span").over(conversation))
    everywhere = F.when(
        F.col("is_system") & (F.col("spans") > 1),
        F.transform(
            F.sequence(F.lit(2).cast("long"), F.greatest("spans", F.lit(2))),
            lambda window: F.struct(window.alias("window"), F.lit(True).alias("repeated")),
        ),
    )
    nothing = F.array().cast("array<struct<window:bigint,repeated:boolean>>")
    uses = F.concat(*(F.coalesce(use, nothing) for use in [*uses, everywhere]))
    turn = F.struct("n", "use.repeated", "role", "text", "tokens")
    windows = (
        rows.select("conv_id", "n", "role", "text", "tokens", F.explode(uses).alias("use"))
        .groupBy("conv_id", F.col("use.window").alias("window"))
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )
    return windows.withColumns(_rendered(F.col("turns"))).drop("turns")


def _rendered(turns: Column) -> dict[str, Column]:
    """Template, mask, and counts of an array of turns in one pass over it."""
    start = F.struct(
        F.lit("").alias("formatted"),
        F.array().cast("array<struct<start:int,end:int>>").alias("mask"),
    )

    def add(done: Column, turn: Column) -> Column:
        head = F.concat(done["formatted"], F.lit(OPEN), escaped(turn["role"]), F.lit(TEXT))
        text = escaped(turn["text"])
        at = F.struct(F.length(head).alias("start"), (F.length(head) + F.length(text)).alias("end"))
        counts = (turn["role"] == TARGET) & ~turn["repeated"]
        return F.struct(
            F.concat(head, text, F.lit(CLOSE)).alias("formatted"),
            F.when(counts, F.array_append(done["mask"], at)).otherwise(done["mask"]).alias("mask"),
        )

    rendered = F.aggregate(turns, start, add)
    return {
        "formatted": rendered["formatted"],
        "mask": rendered["mask"],
        "repeated": F.size(F.filter(turns, lambda turn: turn["repeated"])),
        "tokens": F.aggregate(turns, F.lit(0).cast("long"), lambda a, turn: a + turn["tokens"]),
    }


def read_turns(formatted: Column) -> Column:
    """The turns `(role, text)` of a formatted window."""
    pieces = F.filter(F.split(formatted, f"\\Q{CLOSE}\\E", -1), lambda piece: piece != "")

    def parsed(piece: Column) -> Column:
        role = F.substring_index(piece, TEXT, 1)
        return F.struct(
            unescaped(F.substring(role, len(OPEN) + 1, F.length(role))).alias("role"),
            unescaped(
                F.substring(piece, F.length(role) + len(TEXT) + 1, F.length(piece))
            ).alias("text"),
        )

    return F.transform(pieces, parsed)


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(
        mask, lambda at: unescaped(F.substring(formatted, at["start"] + 1, at["end"] - at["start"]))
    )


def written_turns(turns: Column) -> Column:
    """Role, line feed, text, line feed of each turn."""
    parts = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return F.array_join(parts, "")

