"""JSON, tool calls, masks, maths answers, cards and cursors on values chosen by hand."""

import pytest
from pyspark.sql import functions as F

from trajlake.functions import maths, structured
from trajlake.functions.text import collapse_counters
from trajlake.operators import replay
from trajlake.sources.cursor import Cursor


@pytest.mark.parametrize("text, found", [
    (None, None), ("", None), ("no {object", None), ("[1]", None),
    ('{"a": 1} then {"b": {"c": 2}} end', {"b": {"c": 2}}),
    ('{"a": 1} then {\n"b": bare words,\n"c": 2\n"d": [1,\n]\n}', {"b": "bare words", "c": 2, "d": [1]}),
    ('{\n"a": {\n"b": 1\n}\n"c": x\n}', {"a": {"b": 1}, "c": "x"}),
    ("{'a': True}", {"a": True}),
    ('{"a": 1,}', {"a": 1}),
    ('{"a": 1} and {broken', {"a": 1}),
    ('{\n"a": say "hi"\n}', {"a": 'say "hi"'}),
])
def test_last_object(text, found):
    assert structured.last_object(text) == found


def test_tool_calls(spark):
    call = "<tool_call> <function={}><parameter=a> 1\n</parameter><parameter=a>2</parameter></function></tool_call>"
    rows = [(0, f"x{call.format('run')}y{call.format('none')}z"), (1, "plain"), (2, None), (3, ""), (4, call.format("edit") * 2)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r.f for r in df.select("id", structured.tool_calls(F.col("t"), ["run", "edit"]).alias("f")).collect()}
    assert got[0].text == f"xy{call.format('none')}z" and [(c.name, c.input) for c in got[0].calls] == [("run", {"a": "2"})]
    assert (got[1].text, got[1].calls, got[3].text, got[3].calls) == ("plain", [], "", [])
    assert got[2].text is None and not got[2].calls
    assert got[4].text == "" and len(got[4].calls) == 2


def test_chat_mask(spark):
    chats = [([("user", [1, 2], None), ("assistant", [3, 4, 5], None), ("assistant", [6, 7], 0), ("assistant", None, 1)],), ([],)]
    df = spark.createDataFrame(chats, "m array<struct<role:string,ids:array<int>,train:int>>")
    got = [r[0] for r in df.select(structured.chat_mask(F.col("m"), 1)).collect()]
    assert (got[0].tokens, got[0].mask) == ([1, 2, 3, 4, 5, 6, 7], [0, 0, 0, 1, 1, 0, 0])
    assert (got[1].tokens, got[1].mask) == ([], [])
    df = spark.createDataFrame([([1, 2, 3], [0, 1, 0]), ([1], [0])], "t array<int>, m array<int>")
    got = [r[0] for r in df.select(structured.response_part(F.col("t"), F.col("m"))).collect()]
    assert [(g.response_length, g.mask) for g in got] == [(2, [1, 0]), (0, [])]


GRADES = [
    (r"so \boxed{\frac{1}{2}}", "0.5", True), (r"\boxed{2/4}", "1/2", False), (r"\boxed{7}", "7", True), (r"\boxed{7.0}", "7", False),
    (r"\boxed{1} \boxed{\dfrac34}", r"\boxed{\frac{3}{4}}", True), (r"\boxed{(1, 2)}", "(1,2)", True), (r"\boxed{[1,2)}", "(1,2)", False),
    (r"\boxed{x=5}", "5", True), (r"\boxed{50\%}", "50", True), (r"\boxed{3\text{ cm}}", "3", True), (r"\boxed{\sqrt2}", r"\sqrt{2}", True),
    ("7", "7", False), (r"\boxed{7", "7", False), (None, "7", False), (r"\boxed{7}", None, False), (r"\boxed{7}", "", False), (r"\boxed{}", "7", False),
    (r"\boxed{0.25}", "0.250", True), (r"\boxed{.5}", r"\frac12", True),
]


def test_grades(spark):
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(GRADES)], "i int, r string, t string, w boolean")
    wrong = [(r.r, r.t) for r in df.withColumn("g", maths.grade(F.col("r"), F.col("t"))).where("g IS NULL OR g <> w").collect()]
    assert wrong == []


def test_plain_form(spark):
    rows = [("x = 1,234", "1234"), (r"\text{cm} 5", "5"), (r"\frac12", r"\frac{1}{2}"), (r"\sqrt3", r"\sqrt{3}"), ("$a$ and $b$", "a"), (r"5^\circ", "5"), ("", "")]
    df = spark.createDataFrame(rows, "t string, w string")
    assert [r[0] for r in df.select(maths.plain_form(F.col("t"))).collect()] == [w for _, w in rows]


def test_only_generated_counters_collapse(spark):
    df = spark.createDataFrame([("python apply_fix_v12.py", ), ("page9.py test_3.py.bak  7",), ("latest1.py Try2.py",)], "t string")
    got = [r[0] for r in df.select(collapse_counters(F.col("t"))).collect()]
    assert got == ["python apply_fix_v#.py", "page9.py test_#.py.bak 7", "latest1.py Try#.py"]


def test_cards(spark):
    bank = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("u", "a")], "scope string, experience_id string")
    results = spark.createDataFrame([("s", 0.5, ["a", "b"]), ("s", 0.0, ["b"]), ("s", 1.0, [])], "scope string, pairwise double, retrieved array<string>")
    got = {(r.scope, r.experience_id): (r.keep, r.reason, r.retrieval_count) for r in replay.card_decisions(bank, results).collect()}
    assert got == {
        ("s", "a"): (True, "kept", 1), ("s", "b"): (False, "mean_judge_pairwise_accuracy_below_0.5", 2),
        ("s", "c"): (False, "never_retrieved", 0), ("u", "a"): (True, "scope_not_evaluated", 0),
    }
    assert replay.filter_bank(bank, replay.card_decisions(bank, results)).count() == 2
    with pytest.raises(Exception, match="whole bank of scope s"):
        replay.filter_bank(bank, replay.card_decisions(bank, results, 0.9)).collect()
    records = [("s", "a", ["X", "y "], ["x", None, "z"], ["Y", "y"]), ("s", "b", None, None, [" "])]
    rows = spark.createDataFrame(records, "scope string, experience_id string, base_keywords array<string>, model_keywords array<string>, keywords array<string>")
    one = replay.keyword_bank(rows.where("experience_id = 'a'")).first()
    assert (one.generated_keywords, one.selected_keywords) == (["X", "y", "z"], ["Y"])
    with pytest.raises(Exception, match="nonempty"):
        replay.keyword_bank(rows).collect()


def test_cursor(spark, tmp_path):
    rows = spark.range(5).withColumnRenamed("id", "rank")
    out, at = Cursor(offset=3).take(rows, "rank", 5, 8)
    assert [(r.epoch, r["rank"]) for r in out.orderBy("group_index").collect()] == [(0, 3), (0, 4), *((1, i) for i in range(5)), (2, 0)]
    assert at == Cursor(offset=1, epoch=2, groups=8, samples=8)
    at = at.mark_validated(4, 5)
    at.save(spark, str(tmp_path / "cursor"))
    assert Cursor.load(spark, str(tmp_path / "cursor")) == at
    assert at.mark_validated(2, 5).validated == 4
    with pytest.raises(ValueError):
        at.mark_validated(6, 5)
    assert at.take(rows, "rank", 5, 0)[0].count() == 0
