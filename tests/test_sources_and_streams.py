import json

import pytest
from pyspark.sql import functions as F

from trajlake.operators import packing
from trajlake.sources import readers
from trajlake.streaming import ledger


def test_slices_and_bad_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text("\n".join([json.dumps({"i": i}) for i in range(10)] + ["{bad", ""]))
    schema = spark.createDataFrame([], "i long").schema
    ids = lambda s: sorted(r.i for r in readers.read_table(spark, f"{p}{s}", schema, "i").collect())
    assert ids("") == list(range(10)) and ids("@[2:5]") == [2, 3, 4] and ids("@[-3:]") == [7, 8, 9] and ids("@[:2]") == [0, 1]
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "a.csv"))
    with pytest.raises(Exception):
        readers.read_json_lines(spark, str(p), schema).collect()
    readers.write_table(spark.range(4).withColumn("k", F.col("id") % 2), str(tmp_path / "o.parquet"), ["k"])
    assert readers.read_table(spark, str(tmp_path / "o.parquet")).count() == 4


def test_contexts_merge_or_conflict(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert readers.unique_contexts([a, a], "k").count() == 2
    b = spark.createDataFrame([(1, "z")], "k long, v string")
    with pytest.raises(Exception):
        readers.unique_contexts([a, b], "k").collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i // 2, i % 3, float(i)) for i in range(60)]
    for k in range(3):
        part = spark.createDataFrame(rows[k::3], "event_id long, g long, v double").withColumn("ts", F.timestamp_seconds(F.col("event_id") + 9000))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    events = ledger.tail(spark, str(tmp_path / "in"), schema, "parquet")
    q = ledger.deduplicated(events).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 30
    groups = ledger.complete_groups(events, "g", "v", 20)
    q = groups.writeStream.format("memory").queryName("done").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.g: (r.n, r["mean"]) for r in spark.table("done").collect()}
    assert got == {g: (20, sum(v for _, k, v in rows if k == g) / 20) for g in range(3)}


def test_packing():
    assert packing.first_fit([5, 4, 3, 9, 1], 8) == [0, 1, 0, 2, 1]
    assert packing.in_order_greedy([5, 1, 1, 1], 2) == [0, 1, 1, 1]
    assert packing.greedy_chunks([3, 3, 3, 9, 1], 7) == [0, 0, 1, 2, 3]
    bins = packing.largest_differencing([8, 7, 6, 5, 4], 2)
    sums = [sum(n for n, b in zip([8, 7, 6, 5, 4], bins) if b == k) for k in (0, 1)]
    assert sorted(sums) == [14, 16] and packing.largest_differencing([], 3) == []
