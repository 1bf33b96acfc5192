import time

import pytest
from pyspark.sql import Row

from trajlake.streaming import buffer


def rows_of(df):
    return sorted((r.g, r.k, r.reward, r.text, r.status) for r in df.collect())


def feed(spark, path, rows):
    spark.createDataFrame(rows, "g long, k long, reward double, text string").coalesce(1).write.mode("append").parquet(str(path))


def test_groups_complete_with_their_items_over_restarts(spark, tmp_path):
    feed(spark, tmp_path / "in", [(1, 1, 0.5, "a"), (1, 2, None, "b"), (2, 2**60 + 1, 1.0, "c"), (3, 4, 0.0, None), (3, 5, 1.0, " "), (3, 6, 1.0, "x"), (None, 7, 1.0, "n")])
    samples = spark.readStream.schema("g long, k long, reward double, text string").parquet(str(tmp_path / "in"))
    run = lambda: buffer.run_once(buffer.buffered_groups(samples, "g", buffer.of_size(3)), str(tmp_path / "out"), "file://" + str(tmp_path / "ck"))
    assert rows_of(run()) == [(3, 4, 0.0, None, "complete"), (3, 5, 1.0, " ", "complete"), (3, 6, 1.0, "x", "complete")]
    held = buffer.held_items(spark, "file://" + str(tmp_path / "ck"))
    assert sorted(r.k for r in held.collect()) == [1, 2, 7, 2**60 + 1]
    meta = buffer.interval_meta(held, "g", "reward").first()
    assert tuple(meta) == (4, 3, 4 / 3, 2.5 / 3)
    # Started again, group 1 completes with the items held since the first run; group 3 begins anew.
    feed(spark, tmp_path / "in", [(1, 8, 0.25, "d"), (1, 9, 0.75, "e"), (3, 10, 0.0, "y")])
    got = [r for r in rows_of(run()) if r[0] == 1]
    assert got == [(1, 1, 0.5, "a", "complete"), (1, 2, None, "b", "complete"), (1, 8, 0.25, "d", "complete"), (1, 9, 0.75, "e", "complete")]
    assert sorted(r.k for r in buffer.held_items(spark, "file://" + str(tmp_path / "ck")).collect()) == [7, 10, 2**60 + 1]
    assert tuple(buffer.interval_meta(held.limit(0), "g", "reward").first()) == (0, 0, 0.0, 0.0)


def test_validity_and_transform(spark, tmp_path):
    feed(spark, tmp_path / "in", [(1, k, float(k), " " if k % 2 else "t") for k in range(4)] + [(2, k, 1.0, "t") for k in range(2)])
    samples = spark.readStream.schema("g long, k long, reward double, text string").parquet(str(tmp_path / "in"))
    half = lambda items: [Row(**(r.asDict() | {"reward": r.reward / len(items)})) for r in items]
    out = buffer.buffered_groups(samples, "g", buffer.of_size(2, "text"), transform=half)
    got = rows_of(buffer.run_once(out, str(tmp_path / "out"), "file://" + str(tmp_path / "ck")))
    assert [(r[0], r[2]) for r in got] == [(1, 0.0), (1, 0.25), (1, 0.5), (1, 0.75), (2, 0.5), (2, 0.5)]
    with pytest.raises(ValueError):
        buffer.of_size(0)


def test_timeout(spark, tmp_path):
    feed(spark, tmp_path / "in", [(1, 1, 1.0, "a"), (2, 2, 1.0, "b"), (2, 3, 1.0, "c")])
    samples = spark.readStream.schema("g long, k long, reward double, text string").parquet(str(tmp_path / "in"))
    before = spark.conf.get(buffer.PROVIDER[0], None)
    spark.conf.set(*buffer.PROVIDER)
    q = buffer.buffered_groups(samples, "g", buffer.of_size(2), patience=300).writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for _ in range(120):
            if spark.table("timed").count() == 3:
                break
            time.sleep(0.5)
    finally:
        q.stop()
        spark.conf.set(buffer.PROVIDER[0], before) if before else spark.conf.unset(buffer.PROVIDER[0])
    assert rows_of(spark.table("timed")) == [(1, 1, 1.0, "a", "timed_out"), (2, 2, 1.0, "b", "complete"), (2, 3, 1.0, "c", "complete")]
