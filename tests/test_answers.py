from trajlake.operators.answers import f1_table


def test_words_are_counted_where_a_row_lies(spark):
    rows = [(1, "The b b, c!", "b c c d"), (2, "yes", "no yes"), (3, None, "x"), (4, "", ""), (5, "No", "no"), (6, "w " * 30000 + "x", "w " * 20000)]
    out = f1_table(spark.createDataFrame(rows, "id int, p string, t string").repartition(2), "id", "p", "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan  # that of the test's own repartition
    got = {r.id: (round(r.f1, 6), round(r.precision, 6), round(r.recall, 6)) for r in out.collect()}
    assert got == {1: (0.571429, 0.666667, 0.5), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (1, 1, 1), 6: (round(40000 / 50001, 6), round(20000 / 30001, 6), 1)}
