"""JSON documents, rubric records, cards, graders and run folders on values chosen by hand."""

import base64
import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from trajlake.functions import documents as j
from trajlake.functions import maths, text
from trajlake.operators import cards, contexts
from trajlake.sources import runs
from trajlake.streaming import ledger


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_flat_and_markdown():
    value = {"a": None, "b": {"c": [1, "x"], "d": ""}, "e": [], "f": True, "g": "l1\nl2"}
    assert j.flat_text(value) == "b: c: 1\nx\nf: True\ng: l1\nl2"
    assert j.markdown({"a": None, "b": {"c": [1, {"k": False}]}, "g": "l1\nl2", "h": {}}).split("\n") == [
        "- **a**: None", "- **b**:", "  - **c**:", "    - 1", "    -", "      - **k**: false", "- **g**:", "  l1", "  l2", "- **h**:", "  None"]
    assert j.markdown([]) == "None" and j.markdown(["", "a\nb"]) == "- \n- a\n  b"


def test_keys(spark):
    rubric = {"title": "t", "polarity": "positive", "description": "d", "scale": {"1": "é"}, "weight": 3}
    contract = {"title": "t", "direction": "positive", "description": "d", "scale": {"1": "é"}, "metadata": {}}
    text_ = json.dumps(contract, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert one(spark, j.contract_key, json.dumps(rubric), "[1]", "{oops", None) == [hashlib.blake2b(text_.encode(), digest_size=16).hexdigest(), None, None, None]
    assert one(spark, j.stable_id, '{"b": 1, "a": "é"}') == [hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()]


def test_rubric_records():
    item = {"Type": " Positive ", "Name": "t", "criterion": "d ", "importance": "2.5", "Scale": ["a", "b", "c", "d", "e"], "metadata": {"k": 1}}
    got = j.rubric_record("task", item)
    assert (got["direction"], got["title"], got["description"], got["weight"], got["scale"]["5"], got["metadata"]) == ("positive", "t", "d", 2.5, "e", {"k": "1"})
    assert len(got["rubric_id"]) == 12
    for change in ({"importance": "0"}, {"importance": None}, {"Type": "both"}, {"Name": " "}, {"Scale": {"1": "a"}}, {"metadata": [1]}, {"Scale": {**{f"Score {i}": "x" for i in range(1, 5)}, "5": 7}}):
        assert j.rubric_record("task", item | change) is None
    assert j.rubric_record("task", item | {"Scale": {f"score_{i}": "x" for i in range(1, 6)}}) is not None
    assert j.rubric_record("task", [1]) is None


def test_state_names_ints_and_rows(spark):
    state = j.state_record(["open_points", "plan"])
    assert one(spark, state, 'so {"summary": {"Open Points": ["a"], "other": 1}}', '{"x": 1}', None) == ['{"open_points":"- a"}', None, None]
    assert one(spark, j.test_names, '["a", 3, ""]', "('x',)", " one ", "", None) == [["a", "3"], ["x"], ["one"], [], []]
    packed = base64.b64encode(struct.pack("<4i", 1, -2, 2**31 - 1, -(2**31))).decode()
    assert one(spark, j.unpacked_ints, packed, "", None) == [[1, -2, 2**31 - 1, -(2**31)], [], None]
    assert one(spark, j.document_rows, '[{"a": 1}]', '{"items": [2]}', '{"no": 1}') == [['{"a":1}'], ["2"], None]
    assert one(spark, j.whole_json, "x {{\"a\": 1}}", "{bad} {\"b\": 2} tail", "none", None) == ['{"a":1}', '{"b":2}', None, None]


def test_observations_and_sections(spark):
    long = "x" * 2000
    got = one(spark, j.short_observation, "short", long, f"<exception>{'e' * 400}</exception>\n<returncode> 2 </returncode><output>\n{long}</output>", None)
    assert got[0] == "short" and len(got[1]) == 512 and got[3] is None
    assert got[2].startswith("<exception>e") and "<returncode>2</returncode>" in got[2] and got[2].count("[... Observation truncated") == 2 and len(got[2]) <= 600
    marks = {"question": "## Question:\n", "parent": "## Parent:\n"}
    found = one(spark, lambda c: j.view_sections(c, marks), "a ## Question:\nq1\n## Parent:\np", "nothing")
    assert (found[0].question, found[0].parent, found[1].question) == ("q1", "p", None)


def test_graders(spark):
    rows = [("x </think> so \\boxed{2}", "2", 1), ("\\boxed{2}", "2", 0), ("###Response \\boxed{3} ###Response \\boxed{4}", "3", 1), (None, "2", 0), ("</think> \\boxed{2}", None, 0)]
    df = spark.createDataFrame(rows, "r string, t string, w int")
    assert df.where(maths.thought_reward(F.col("r"), F.col("t")) != F.col("w")).count() == 0
    df = spark.createDataFrame([("yes", "no", 0.0), ("yes", "Yes.", 1.0), ("a b b", "b b c", 0.8), (None, "x", 0.0), ("", "", 0.0)], "p string, t string, w double")
    assert [round(r[0], 6) for r in df.select(text.f1(F.col("p"), F.col("t"))).collect()] == [0.0, 1.0, 0.8, 0.0, 0.0]
    asked = [("The answer is B", "b", None, 1.0), ("B is correct", "A", None, 0.0), ("<think>A</think> it is beta", "Beta!", ["alpha", "beta"], 1.0), ("final option: C", "c", None, 1.0), (None, "A", None, 0.0), ("gamma", "gamma ray", None, 0.0)]
    df = spark.createDataFrame(asked, "r string, t string, c array<string>, w double")
    assert [r[0] for r in df.select(text.choice_reward(F.col("r"), F.col("t"), F.col("c"))).collect()] == [w for *_, w in asked]
    df = spark.createDataFrame([("other", "x", "y")], "k string, r string, t string")
    with pytest.raises(Exception, match="no rule-based grader"):
        df.select(maths.reward_by_kind(F.col("k"), F.col("r"), F.col("t"), F.lit(None).cast("array<string>"))).collect()


def test_cards_that_repeat(spark):
    body = " ".join(f"word{i}" for i in range(24))
    rows = [("a", 0, "Title", body), ("b", 1, " title ", "other"), ("c", 2, "third", body.replace("word10", "wordx")), ("d", 3, "fourth", "nothing alike"), ("e", 4, "fifth", "")]
    df = spark.createDataFrame(rows, "experience_id string, pos int, title string, body string")
    got = {r.experience_id: r.error for r in cards.duplicate_cards(df).collect()}
    assert got == {"b": "duplicate title: a", "c": "near-duplicate content: a"}


def test_keyword_candidates(spark):
    df = spark.createDataFrame([("Parse config files", "see src/a/b.py, raise ValueError from os.path.join and call parse(x)", "running parsers of configs in src/a/b.py the reward")], "t string, p string, q string")
    named, shared = df.select(cards.named_candidates(F.col("t"), F.col("p"), F.array(F.lit("code"), F.lit("R"))), cards.overlap_candidates(F.concat_ws(" ", "t", "p"), F.col("q"))).first()
    assert named == ["Parse config files", "src/a/b.py", "b.py", "ValueError", "os.path.join", "parse"]
    assert "src/a/b.py" in shared and "configs" in shared and "the" not in shared


def test_contexts_that_fail(spark):
    shape = "context_id string, node_ids array<string>, gt_rewards map<string,double>, continuations array<string>"
    good = ("a", ["x", "y"], {"x": 2.0, "y": 0.5}, ["x", "y"])
    flat = ("b", ["x", "y"], {"x": 1.0, "y": 0.5}, ["x", "y"])
    assert [r.context_id for r in contexts.load_contexts(spark.createDataFrame([good, good, flat], shape)).collect()] == ["a"]
    for bad, why in (("a", ["x", "y"], {"x": 2.0, "y": 0.0}, ["x", "y"]), "conflicting"), (("c", ["x", "x"], {"x": 2.0}, ["x"]), "unique"), (("c", None, {"x": 2.0}, ["x"]), "missing"):
        with pytest.raises(Exception, match=why):
            contexts.load_contexts(spark.createDataFrame([good, bad], shape)).collect()
    rows = spark.createDataFrame([("n", None, {"n": 2.0}), (None, True, {"n": 0.0}), ("n", None, {"n": 1.0})], "s string, k boolean, r map<string,double>")
    assert [r[0] for r in rows.select(contexts.selection_error(F.col("s"), F.col("k"), F.col("r"))).collect()] == [False, False, True]
    for s, k, r in ((None, None, {"n": 2.0}), ("n", False, {"n": 2.0}), ("z", None, {"n": 2.0})):
        with pytest.raises(Exception):
            spark.createDataFrame([(s, k, r)], rows.schema).select(contexts.selection_error(F.col("s"), F.col("k"), F.col("r"))).collect()


def test_run_folders(spark, tmp_path):
    for name in ("single_run/i1/i1.traj.json", "naive_out/rollout_1/a/b/task-0/rollouts/rollout_0/messages.json", "lane_out/rollout_1/a/b/task-0/groups/group_0/branches/branch_1/summary.json"):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text('{"contexts": [{"k": 1}, {"k": 2}]}')
    assert len(runs.find_trajectories(spark, str(tmp_path))) == 1
    assert [k for k, _ in runs.find_rollouts(spark, str(tmp_path))] == ["naive", "lane"]
    assert len(runs.expand_runs(spark, [f"{tmp_path}/*", f"{tmp_path}/naive*"])) == 3
    docs = runs.read_documents(spark, runs.find_trajectories(spark, str(tmp_path)))
    assert sorted(r.row for r in runs.context_rows(docs).collect()) == ['{"k":1}', '{"k":2}']
    assert [r["instance_id"] for r in runs.run_records(None, spark, f"{tmp_path}")] == ["lane_out", "naive_out", "single_run"]
    for plan, root in ((None, None), ([], None), ([{"instance_id": "a", "run_dir": "x"}] * 2, None)):
        with pytest.raises(ValueError):
            runs.run_records(plan, spark, root)


def test_dumps_ledger_and_versions(spark, tmp_path):
    template = str(tmp_path / "dump_{rollout_id}.parquet")
    runs.save_dump(spark.range(3), template, 0)
    assert runs.load_dump(spark, template, 7).count() == 3
    with pytest.raises(FileNotFoundError):
        runs.resolve_dump(spark, template, 7, evaluation=True)
    at = str(tmp_path / "ledger")
    runs.record_disposition(spark, at, "g1", "dropped", "stale")
    offset = runs.ledger_offset(spark, at)
    runs.append_events(spark.createDataFrame([("e", 2.0, "request"), ("e", 1.0, "earlier")], "event_id string, timestamp double, event_type string"), at)
    rows = runs.ledger_events(spark, at).collect()
    assert len(rows) == 2 and [r.event_type for r in rows if r.event_id == "e"] == ["earlier"]
    assert [r.disposition for r in runs.ledger_events(spark, at, offset).collect()] == ["dropped"]
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.json").write_text('{"policy_version": "policy-3"}\n')
    assert runs.committed_version(spark, str(tmp_path / "v")) == "policy-3"
    (tmp_path / "s.jsonl").write_text('{"index": 1, "odd": {"a": 1}}\n\n')
    row = runs.read_samples(spark, str(tmp_path / "s.jsonl"), spark.createDataFrame([], "index int").schema).first()
    assert (row["index"], row.rest) == (1, {"odd": '{"a":1}'})
    both = runs.dataset_rows({"x": (spark.createDataFrame([("1", "p")], "id string, problem string"), {"instance_id": "id"}), "y": (spark.createDataFrame([("2",)], "instance_id string"), {})})
    assert sorted((r.dataset, r.instance_id, r.problem) for r in both.collect()) == [("x", "1", "p"), ("y", "2", None)]
    ledger.save_buffer(both, str(tmp_path / "buffer"))
    assert ledger.load_buffer(spark, str(tmp_path / "buffer")).count() == 2


def test_media(spark):
    messages = [{"role": "user", "content": "see <image> and <image>!"}]
    got = j.place_media(messages, {"<image>": ("image", ["a.png", {"type": "image", "image": "b"}])})
    assert got[0]["content"] == [{"type": "text", "text": "see "}, {"type": "image", "image": "a.png"}, {"type": "text", "text": " and "}, {"type": "image", "image": "b"}, {"type": "text", "text": "!"}]
    for items in (["a"], ["a", "b", "c"]):
        with pytest.raises(ValueError):
            j.place_media(messages, {"<image>": ("image", items)})
    df = spark.createDataFrame([("a <v>", '{"video": ["x"]}'), (None, None), ("plain", None)], "p string, m string")
    got = [r[0] for r in df.select(j.media_messages(F.col("p"), F.col("m"), {"video": "<v>"})).collect()]
    assert json.loads(got[0])[0]["content"][1] == {"type": "video", "video": "x"} and got[1] is None and json.loads(got[2])[0]["content"] == "plain"


def test_span_stack(spark):
    from trajlake.operators.events import stack_parents

    rows = [("t", 0, "span_start", "a"), ("t", 1, "event", None), ("t", 2, "span_start", "b"), ("t", 3, "span_end", "a"), ("t", 4, "event", None), ("t", 5, "span_end", "b"), ("t", 6, "event", None)]
    got = stack_parents(spark.createDataFrame(rows, "t string, o int, k string, s string"), "t", "o", "k", "s").orderBy("o").collect()
    assert [r.parent for r in got] == [None, "a", "a", "b", "b", "b", None]
