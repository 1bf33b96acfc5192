"""Plans whose tasks must not hold more than their share."""

from pyspark.sql import functions as F

from trajlake import plans
from trajlake.operators import rubrics

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if " Exchange " in x]


def test_score_weights_deals_lines_by_order_alone(spark):
    found = [x for x in exchanges(plans.queries()["score_weights"](spark, SF)) if "hashpartitioning" in x]
    assert any("hashpartitioning(l_orderkey" in x for x in found)
    assert not any("hashpartitioning(weight_id" in x and "pair" in x for x in found)


def test_spreads_meet_weights_once_a_rubric(spark):
    scores = spark.createDataFrame([(g, n, k, (n * k + g) % 5 + 1) for g in range(3) for n in range(4) for k in range(2)] + [(0, 0, 9, 77)], "g int, node int, rubric int, raw int")
    weights = spark.createDataFrame([(g, k, "positive", 1.0 + k) for g in range(3) for k in range(2)], "g int, rubric int, direction string, weight double")
    out = rubrics.weighted_scores(scores, weights)[1]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Scores are aggregated below the join.
    assert plan.rindex("Aggregate [g") > plan.index("Join")
    want = {}
    for g in range(3):
        seen = [[rubrics.MAPPING[(n * k + g) % 5] for n in range(4)] for k in range(2)]
        want[g] = round(sum((max(v) - min(v)) / 7 * (1 + k) for k, v in enumerate(seen)) / 3, 9)
    assert {r.g: round(r.weighted_range, 9) for r in out.collect()} == want
    bad = rubrics.weighted_scores(scores.withColumn("raw", F.when(F.col("node") == 0, None).otherwise(F.col("raw"))), weights)[1]
    try:
        bad.collect()
    except Exception as error:
        assert "invalid raw judge score" in str(error)
    else:
        raise AssertionError("a null score passed")


def test_rare_grams_are_chosen_where_a_body_lies(spark):
    from trajlake.operators.cards import near_bodies

    bodies = spark.createDataFrame([("a", "one two three four five six"), ("b", "one two three four five sex"), ("c", "nothing of this kind here")], "key string, body string")
    out = near_bodies(bodies, 0.94)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()  # before, all grams were dealt out to be ranked
    assert ("a", "b") in {tuple(r) for r in out.collect()}
