import pytest
from pyspark.sql import functions as F

from trajlake import plugins
from trajlake.plugins import Generators, apply_column, apply_frame, load, register, resolve, roll_out
from trajlake.sources.ledger_source import FORMAT, ledger_lines

HERE = "trajlake.hooks.words."


def drops_column(samples):
    return samples.drop("reward")


def not_a_frame(samples):
    return 1


not_callable = 3


def test_names_and_contracts(spark):
    me = __name__ + "."
    assert resolve(HERE + "overlap").__name__ == "overlap"
    for bad, kind in (("overlap", ValueError), (HERE + "nothing", ValueError)):
        with pytest.raises(kind):
            resolve(bad)
    for kind, path in (("rollout", "overlap"), ("source", "run_rollout"), ("reward", "counts")):
        with pytest.raises(TypeError):
            load(kind, HERE + path)
    with pytest.raises(TypeError):
        load("filter", me + "not_callable")
    with pytest.raises(ValueError):
        load("unknown", HERE + "overlap")
    rows = spark.createDataFrame([(1, 0.5)], "group long, reward double")
    for name in ("drops_column", "not_a_frame"):
        with pytest.raises(TypeError):
            apply_frame(rows, "filter", me + name)
    with pytest.raises(TypeError):
        apply_column("reward", me + "two", F.lit(1), F.lit(1))
    with pytest.raises(ValueError):
        register(spark, "filter", "x", HERE + "varied")
    assert set(plugins.KINDS) >= {"rollout", "filter", "reward", "source"}


def two(response, label):
    return 2


def test_rollout_filter_reward_and_log(spark):
    docs = spark.createDataFrame([(1, "a bb ccc dddd"), (2, "same"), (3, None), (4, "")], "group long, text string")
    samples = roll_out(docs, HERE + "run_rollout", "text", F.lit(3), size=2).drop("text")
    assert sorted(map(tuple, samples.collect())) == [(1, 0, "a bb", 2), (1, 1, "ccc dddd", 2), (2, 0, "same", 1)]
    scored = samples.withColumn("reward", apply_column("reward", HERE + "overlap", F.col("response"), F.lit("ccc same")))
    kept = apply_frame(scored, "filter", HERE + "varied")
    out = kept.withColumn("advantage", apply_column("advantage", HERE + "centred", F.col("reward")))
    assert sorted((r.sample, r.reward, r.advantage) for r in out.collect()) == [(0, 0.0, -0.25), (1, 0.5, 0.25)]
    assert tuple(apply_frame(scored, "log", HERE + "counts").first()) == (3, 0.388888889)
    register(spark, "rollout", "spans_of", HERE + "run_rollout")
    got = spark.sql("SELECT d.group, s.response FROM {d} d, LATERAL spans_of(d.text, 1, 1) s", d=docs).collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "same")]


def test_source_and_generators(spark, tmp_path):
    (tmp_path / "x").write_text("one\n")
    register(spark, "source", FORMAT, "trajlake.sources.ledger_source.LedgerLines")
    assert spark.read.format(FORMAT).option("path", str(tmp_path)).load().count() == ledger_lines(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError):
        register(spark, "source", "other", "trajlake.sources.ledger_source.LedgerLines")
    known = Generators()
    assert known.add("trajlake.hooks.words") == "words"
    assert known.hook("words", "is_valid_group") is resolve(HERE + "is_valid_group") and known.hook("words", "missing", len) is len
    with pytest.raises(ValueError):
        known.add("trajlake.hooks.words")
    with pytest.raises(TypeError):
        known.add("trajlake.plugins")
    with pytest.raises(KeyError):
        known.hook("maths", "run_rollout")
