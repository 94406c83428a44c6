from emberline.llm import chat_format as c
from pyspark.sql import functions as F

SCHEMA = "pair_id long, turn long, role string, text string"


def rendered(spark, chosen, rejected):
    pairs = c.preference_pairs(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA))
    return {
        row.pair_id: row
        for row in pairs.select("pair_id", "prefix_turns", "prompt", c.text_of(F.col("chosen")).alias("good"), c.text_of(F.col("rejected")).alias("bad"),
                                c.loss_chars(F.col("chosen")).alias("loss"), "chosen").collect()
    }


def turn(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_common_prefix_is_the_prompt(spark):
    start = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    row = rendered(spark, [*start, (1, 2, "user", "r"), (1, 3, "assistant", "good")], [*start, (1, 2, "user", "r"), (1, 3, "assistant", "bad")])[1]
    assert row.prefix_turns == 3
    assert row.prompt == turn("user", "q") + turn("assistant", "a") + turn("user", "r")
    assert (row.good, row.bad) == (turn("assistant", "good"), turn("assistant", "bad"))
    assert row.loss == len("good<|im_end|>")
    assert [piece.text for piece in row.chosen if piece.loss] == ["good", "<|im_end|>"]


def test_sides_of_unequal_length_nulls_and_repeats(spark):
    rows = rendered(
        spark,
        [(1, 0, "user", "q"), (2, None, None, None), (3, 0, "user", "x"), (3, 0, "user", "x"), (None, 0, "user", "lost")],
        [(1, 0, "user", "q"), (1, 1, "assistant", "more"), (3, 0, "user", "x"), (4, 0, "user", "only")],
    )
    assert (rows[1].prompt, rows[1].good, rows[1].bad) == (turn("user", "q"), "", turn("assistant", "more"))
    assert rows[2].prefix_turns == 0 and rows[2].good == turn("", "")
    assert rows[3].good == turn("user", "x") * 2 and rows[3].bad == turn("user", "x")
    assert rows[4].good == "" and None not in rows


def test_equal_conversations_and_markers(spark):
    rows = rendered(spark, [(1, 0, "user", "a <|im_end|> b")], [(1, 0, "user", "a <|im_end|> b")])
    assert rows[1].prompt == turn("user", "a < |im_end|> b") and rows[1].good == ""


def test_empty_tables(spark):
    assert rendered(spark, [], []) == {}


def test_no_python_in_the_plan(spark, sf, plan_of):
    from emberline.llm.queries import QUERIES

    assert not [word for word in ("Python", "Arrow", "Pandas") if word in plan_of(QUERIES["op2_chat_format"](spark, sf))]
