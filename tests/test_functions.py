"""Column functions on edge cases."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracequarry.functions import parsing, resolve, scalar
from tracequarry.functions import text as X


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_"))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "limit", "want"),
    [
        (None, 10, ""),
        (" a \t\n b c ", 0, "a b c"),
        ("abcdefghijklmnopqrstuvwxyz", 10, "abcdefghij"),
        ("x" * 40, 30, "x" * 15 + " ...[truncated]"),
        ("short", 30, "short"),
    ],
)
def test_shorten(spark, text, limit, want):
    assert one(spark, X.shorten(F.col("t").cast("string"), limit), t=text) == want


def test_clip_and_compact(spark):
    assert one(spark, X.clip("t", -1), t="abc") == ""
    assert one(spark, X.compact("t", -1), t="abc") == "abc"
    assert one(spark, X.compact("t", None), t="abc") == "abc"
    assert one(spark, X.compact("t", 2), t="éèç") == "éè"


def test_slugs(spark):
    assert one(spark, X.slug("t", "skill"), t="a/b/GPT_5.4 Mini") == "gpt54_mini"
    assert one(spark, X.slug("t", "skill"), t="  ") == "skill"
    assert one(spark, X.model_slug("t", "m"), t="org/Model..v1.5-x") == "model.v1.5_x"
    assert one(spark, X.safe_part("t"), t="a b/c:d") == "a_b_c_d"


def test_families(spark):
    assert one(spark, X.task_type("t"), t=" Pick_Two ") == "pick_two_obj_and_place"
    assert one(spark, X.task_type("t"), t="unknown") is None
    assert one(spark, X.science_family("t"), t="task-12-Boil Water") == "boil_water"
    assert one(spark, X.science_family("t"), t="") is None
    assert one(spark, X.described_family("t"), t="Look at the clean mug") == "look_at_obj_in_light"


def test_tags_and_actions(spark):
    assert one(spark, X.tagged("t", "action"), t="x <ACTION> go\n north </action> <action>b</action>") == "go\n north"
    assert one(spark, X.tagged("t", "action"), t="none") == ""
    actions = F.array(F.lit("go north"), F.lit("look"), F.lit("take mug"))
    assert one(spark, X.match_action("t", actions), t="Go  North") == "go north"
    assert one(spark, X.match_action("t", actions), t="I will take mug now") == "take mug"
    assert one(spark, X.match_action("t", actions), t="take mug and look") == "take mug and look"


@pytest.mark.parametrize(("task", "want"), [("a_b_2", ("a_b", 2)), ("a_4", None), ("plain", None), ("_1", None), ("a_x", None)])
def test_variant_id(spark, task, want):
    got = one(spark, X.variant_id("t"), t=task)
    assert (tuple(got) if got else None) == want


def test_regions(spark):
    doc = one(spark, X.with_region("t", F.lit("  memo ")), t="# Title\ntext\n\n")
    assert doc == f"# Title\ntext\n\n{X.REGION_START}\nmemo\n{X.REGION_END}\n"
    assert one(spark, X.region("t"), t=doc) == "memo"
    assert one(spark, X.without_regions("t"), t=f"a {X.REGION_START} b").strip() == "a  b"
    assert one(spark, X.in_region(F.col("t"), "memo"), t=doc) is True
    assert one(spark, X.in_region(F.col("t"), "Title"), t=doc) is False
    appended = one(spark, X.append_before_region(F.col("t"), F.lit("new")), t=doc)
    assert appended.index("new") < appended.index(X.REGION_START)
    assert one(spark, X.append_before_region(F.col("t"), F.lit("new")), t="a\n") == "a\n\nnew\n"


def test_redact(spark):
    got = one(spark, X.redact("t"), t='my_token = "abc" and Bearer a.b-c and password: \'x\'')
    assert got == "my_token = \"[REDACTED]\" and Bearer [REDACTED] and password: '[REDACTED]'"
    assert parsing.redact_value({"api_key": "k", "a": [{"otp": 1}, '{"secret": "s"}'], "b": None})["a"][0] == {"otp": "[REDACTED]"}


def test_errors(spark):
    assert one(spark, X.error_summary("t"), t="<html><title> 502 Bad\n Gateway</title>x</html>") == "502 Bad Gateway"
    assert one(spark, X.error_summary("t"), t="") == "no response body"
    assert one(spark, X.error_summary("t", 5), t="<b>abcdefgh</b>") == "abcde..."


@pytest.mark.parametrize(("value", "want"), [("x", 0.0), ("50", 0.5), ("0.4", 0.4), ("-3", 0.0), ("1000", 1.0), (None, 0.0)])
def test_score(spark, value, want):
    assert one(spark, scalar.score_0_1(F.col("t").cast("string")), t=value) == want


def test_arrays(spark):
    a = F.array(*(F.lit(i) for i in range(3)))
    assert one(spark, scalar.last_n(a, 8)) == [0, 1, 2]
    assert one(spark, scalar.last_n(a, 2)) == [1, 2]
    assert one(spark, scalar.last_n(a, 0)) == []
    assert one(spark, scalar.rotated(a, 4)) == [1, 2, 0]
    assert one(spark, scalar.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, scalar.unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]


def test_reports(spark):
    passed = F.array(F.lit("a"), F.lit("b"))
    got = one(spark, scalar.test_report(F.lit(True), F.lit(3), passed, F.array().cast("array<string>")))
    assert tuple(got) == (False, 3, 2, 1)
    assert one(spark, scalar.test_report(F.lit(True), F.lit(0), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")))["success"] is False


def test_replay_key_keeps_null_apart(spark):
    a = scalar.replay_key(F.lit("d"), [F.lit("append"), F.lit(None).cast("string")], F.lit("E1"), F.lit(0), [F.lit("t")])
    b = scalar.replay_key(F.lit("d"), [F.lit("append"), F.lit("")], F.lit("E1"), F.lit(0), [F.lit("t")])
    assert one(spark, a) != one(spark, b)


def test_success_has_three_meanings(spark):
    df = spark.createDataFrame([Row(task_id="a", success=None, score=None, final_reward=1.0)], "task_id string, success boolean, score double, final_reward double")
    got = df.select(resolve.succeeded(df).alias("a"), resolve.scored_success(df).alias("b"), resolve.flagged(df).alias("c")).first()
    assert tuple(got) == (True, False, False)


def test_missing_differs_from_null(spark):
    df = spark.createDataFrame([('{"score_delta": null, "reward": 2}',), ('{"reward": 2}',), ("{}",)], "j string").select(F.parse_json("j").alias("v"))
    assert [r[0] for r in df.select(resolve.variant_step_reward(F.col("v"))).collect()] == [0.0, 2.0, 0.0]


def test_json_in_prose(spark):
    assert parsing.first_object('say {bad} then {"a": 1} end') == '{"a": 1}'
    assert parsing.first_object("```json\n{\"a\": [1]}\n```") == '{"a": [1]}'
    assert parsing.first_object("[1]") is None
    assert parsing.first_object(None) is None
    assert parsing.code_of("```python\nx = 1\n```") == "x = 1"
    assert parsing.code_of("not code at all ((") == parsing.FALLBACK_CODE
    assert parsing.code_of("<Action>\n```py\ny = 2") == "y = 2" and parsing.code_of('```json\n{"code": " z = 3 "}\n```') == "z = 3"
    assert parsing.code_of("w = 4") == "w = 4" and parsing.code_of(None) == parsing.FALLBACK_CODE
    df = spark.createDataFrame([("ok {\"decision\": \"keep\", \"reason\": \"r\"}",), ("no",)], "raw string")
    good, bad = parsing.parse_contract(df, F.col("raw"), "judge")
    assert good.first()["parsed"]["decision"] == "keep"
    assert bad.count() == 1


def test_choice_text(spark):
    said = ['{"choices":[{"message":{"content":"a"}}]}', '{"choices":[{"message":{"content":[{"type":"text","text":"b"},{"type":"text","text":"c"}]}}]}', '{"choices":[{"message":{"content":"","refusal":"no"}}]}', '{"choices":[{"text":"t"}]}', "bad"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    assert [r[0] for r in df.orderBy("i").select(parsing.choice_text(F.col("s"))).collect()] == ["a", "bc", "no", "t", None]


def test_places_are_those_of_c(spark):
    xs = [i / 200 for i in range(-401, 402)] + [i / 1000 for i in range(1001)] + [-0.0, -0.001, 0.125, 0.375, 1e-300, 2.675, 99.995, 123456.785, 1e9 + 0.125, 1e12]
    rows = spark.createDataFrame([(x,) for x in xs], "x double")
    for places in (2, 4):
        got = rows.select("x", scalar.fixed(F.col("x"), places).alias("t")).collect()
        assert [r["t"] for r in got] == [f"{x:.{places}f}" for x in xs]
    assert one(spark, scalar.fixed(F.lit(None).cast("double"))) is None
