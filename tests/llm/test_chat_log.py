import pytest
from pyspark.sql import functions as F

from rasterlake.llm import chat


def read(df):
    return {r.conv_id: r for r in chat.parse(chat.render(chat.reconstruct(df))).collect()}


def test_a_shuffled_log_folds_into_the_rows(spark):
    texts = ["", None, "a", "ab", "abc", "one two <|im_end|>\n three", "~0~1", "x" * 50_000, "é𝄞" * 7, "plain", "<|im_start|>assistant ok"] * 3
    rows = [(k % 4, k // 4, ["user", "assistant", "sys\ntem", None][k % 4 if k % 5 else 3], t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.conversation_events(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert log.count() > 2 * len(rows)
    got = read(log.repartition(7, F.rand(3)))
    for c in range(4):
        want = [(r or "", t or "") for i, _, r, t in rows if i == c]
        assert [(t.role, t.text) for t in got[c].turns] == want
        assert got[c].loss_text == "".join(t for r, t in want if r == "assistant")


def test_ties_repeated_rows_and_clashing_names(spark):
    rows = [(1, 0, "user", "b", 9), (1, 0, "user", "a", 9), (1, 0, "user", "a", 9), (1, None, "user", "first", 9), (None, 3, None, None, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, msg int").withColumn("seq", F.lit(1)).withColumn("kind", F.lit("x"))
    got = read(chat.conversation_events(df))
    assert [t.text for t in got[1].turns] == ["first", "a", "a", "b"]
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")] and got[None].loss_text == ""


def test_nulls_and_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read(chat.conversation_events(none)) == {}
    rendered = chat.render(spark.createDataFrame([(1, 1, None, None), (1, 2, "assistant", None)], "conv_id long, position int, role string, text string"))
    assert [(t.role, t.text) for t in chat.parse(rendered).first().turns] == [("", ""), ("assistant", "")]
    blank = spark.createDataFrame([(1, None, None), (2, "", [])], "conv_id long, formatted string, mask array<struct<begin:int,end:int>>")
    rows = {r.conv_id: r for r in chat.parse(blank).collect()}
    assert rows[1].turns is None and rows[2].turns == [] and rows[2].loss_text == ""


@pytest.mark.parametrize("n", [1, 300])
def test_many_turns(spark, n):
    df = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(n)], "conv_id long, turn long, role string, text string")
    assert [t.text for t in read(chat.conversation_events(df))[1].turns] == [f"turn {k}" for k in range(n)]
