from collections import defaultdict

from pyspark.sql import functions as F

from pagelode.llm import chat
from tests.llm.tables import clashing, prose, rows

ODD = "\\ \\\\ <s> </s> [INST] [/INST] <\\s> <<s>> [[/INST]] \n </s>[INST] ok [/INST] \U0001f600"


def turns():
    out = [(1, 0, "system", "be kind " * 5)]
    out += [(1, i, ["assistant", "user"][i % 2], prose(i, 20 + 37 * (i % 5))) for i in range(1, 40)]
    out += [(2, 0, "user", ODD), (2, 1, "assistant", ODD), (2, 2, ODD, None), (2, 3, None, "")]
    out += [(3, None, "user", "x"), (3, 1, "assistant", "y"), (3, 1, "assistant", "y"), (3, 1, "assistant", "z")]
    out += [(None, 0, "user", "a"), (None, 1, "assistant", "b")]
    out += [(4, 0, "user", prose(50, 4000)), (4, 1, "assistant", prose(51, 30)), (5, 0, "system", prose(52, 900)), (5, 1, "user", "u"), (5, 2, "assistant", prose(53, 100))]
    out += [(6, 0, "system", "alone"), (7, 0, "assistant", "only")]
    return out


def table(spark, data=None):
    data = turns() if data is None else data
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def by_conversation():
    whole = defaultdict(list)
    for conv, turn, role, text in turns():
        whole[conv].append((turn is None, turn, role or "", text or ""))
    return {conv: [t[2:] for t in sorted(own)] for conv, own in whole.items()}


def windows(df, **options):
    out = chat.chat_windows(df, **options)
    out = out.withColumn("turns", chat.read_turns(F.col("formatted")))
    return out.withColumn("loss", chat.masked_texts(F.col("formatted"), F.col("mask")))


def test_windows_read_back(spark):
    wanted, found = by_conversation(), defaultdict(list)
    for row in sorted(windows(table(spark)).collect(), key=lambda r: r["window"]):
        found[row["conv_id"]].append(row)
    assert found.keys() == wanted.keys()
    for conv, own in found.items():
        assert [r["window"] for r in own] == list(range(1, len(own) + 1))
        read = [tuple(t) for r in own for t in r["turns"][r["repeated"] :]]
        assert read == wanted[conv]
        assert [t for r in own for t in r["loss"]] == [t for role, t in wanted[conv] if role == "assistant"]


def test_budget_system_turn_and_history(spark):
    wanted, cost = by_conversation(), lambda turn: len(turn[1].split()) + chat.TURN_TOKENS
    for row in windows(table(spark), budget=200, history_tokens=60, history_turns=2).collect():
        own, turns = wanted[row["conv_id"]], [tuple(t) for t in row["turns"]]
        has_system = own[0][0] == "system"
        if has_system:
            assert turns[0] == own[0]
        fresh, before = turns[row["repeated"] :], turns[has_system and row["window"] > 1 : row["repeated"]]
        assert row["tokens"] == sum(map(cost, turns))
        assert len(before) <= 2 and sum(map(cost, before)) <= 60
        assert row["tokens"] <= 200 or len([t for t in fresh if t[0] != "system"]) == 1
        if before:
            place = own.index(fresh[0])
            assert own[place - len(before) : place] == before
    assert any(r["repeated"] > 1 for r in windows(table(spark), budget=200).collect())


def test_escaped_texts_hold_no_control_string(spark):
    out = spark.createDataFrame([(ODD,)], "text string").select(
        chat.escaped(F.col("text")).alias("safe"), chat.unescaped(chat.escaped(F.col("text"))).alias("back")
    )
    row = out.first()
    assert row["back"] == ODD
    assert not any(mark in row["safe"] for mark in (chat.OPEN, chat.TEXT, chat.END_TEXT, chat.END))


def test_extra_columns_and_empty_table(spark):
    assert rows(chat.chat_windows(clashing(table(spark)))) == rows(chat.chat_windows(table(spark)))
    assert rows(chat.chat_windows(table(spark, []))) == []
