import json
import random

import pytest
from pyspark.sql import functions as F

from trajlake.sources import ledger_source as ls


def drain(df, name, place):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(place)).start()
    q.processAllAvailable()
    return q


def lines(df):
    return [r.line for r in df.orderBy("path", "at").collect()]


def test_whole_lines_by_ranges(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(ls, "BLOCK_BYTES", 7)
    for name in ("a.jsonl", "b.jsonl", "_hidden"):
        body = ["x" * rng.choice([0, 1, 5, 40]) + "é" for _ in range(50)]
        (tmp_path / name).write_text("\n".join(body) + ("\n" if name[0] == "a" else "\nunfinished"))
    want = (tmp_path / "a.jsonl").read_text().splitlines() + (tmp_path / "b.jsonl").read_text().split("\n")[:-1]
    for split in (1, 3, 17, 10**6):
        assert lines(ls.ledger_lines(spark, str(tmp_path), split_bytes=split)) == want
    store = ls.ledger_offsets(str(tmp_path / "b.jsonl"))
    assert list(store.values()) == [(tmp_path / "b.jsonl").read_bytes().rindex(b"\n") + 1]
    assert ls.ledger_lines(spark, "file://" + str(tmp_path)).count() == len(want)
    assert ls.ledger_lines(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "c").write_bytes(b"\xff\xfe\n{}\n")
    assert lines(ls.ledger_lines(spark, str(tmp_path / "c"))) == [None, "{}"]


def test_line_written_in_two_parts(spark, tmp_path):
    ledger = tmp_path / "l.jsonl"
    ledger.write_text('{"event_id":"1"}\n{"event')
    q = drain(ls.ledger_stream(spark, str(ledger)), "parted", tmp_path / "c")
    assert lines(spark.table("parted")) == ['{"event_id":"1"}']
    with ledger.open("a") as f:
        f.write('_id":"2"}')
    q.processAllAvailable()
    assert spark.table("parted").count() == 1
    with ledger.open("a") as f:
        f.write('\n{"event_id":"3"}\n')
    q.processAllAvailable()
    q.stop()
    assert lines(spark.table("parted")) == ['{"event_id":"1"}', '{"event_id":"2"}', '{"event_id":"3"}']
    # A query started again from its checkpoint goes on behind the last whole line.
    with ledger.open("a") as f:
        f.write("last\n")
    sink = ls.ledger_stream(spark, str(ledger)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c3"))
    q = sink.trigger(availableNow=True).start()
    q.awaitTermination()
    with ledger.open("a") as f:
        f.write("more\n")
    q = sink.trigger(availableNow=True).start()
    q.awaitTermination()
    assert lines(spark.read.parquet(str(tmp_path / "out"))) == ledger.read_text().splitlines()


def test_first_events_and_batch_equal_to_stream(spark, tmp_path):
    rows = [{"event_id": "duplicate", "event_type": "request", "timestamp": 1.0}] * 2 + [{"event_id": "d", "event_type": "group_disposition", "group_id": "g", "disposition": "filtered"}]
    body = [json.dumps(r) for r in rows] + ["{bad", "", "[]", '{"event_id":""}', '{"event_id":null}', '{"event_id":5}', '{"event_id":"duplicate","event_type":"late"}']
    (tmp_path / "l.jsonl").write_text("\n".join(body) + "\n")
    batch = ls.first_events(ls.events_of(ls.ledger_lines(spark, str(tmp_path / "l.jsonl"))))
    got = {r.event_id: r.event_type for r in batch.collect()}
    assert got == {"duplicate": "request", "d": "group_disposition", "5": None}
    drain(ls.first_events(ls.events_of(ls.ledger_stream(spark, str(tmp_path / "l.jsonl")))), "firsts", tmp_path / "c").stop()
    assert sorted(map(tuple, spark.table("firsts").select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_resume_skips_what_was_given_up(spark, tmp_path):
    ledger = tmp_path / "l.jsonl"
    event = lambda k: json.dumps({"event_id": k}) + "\n"
    ledger.write_text(event("kept"))
    checkpoint = ls.ledger_offsets(str(ledger))
    with ledger.open("a") as f:
        f.write(event("orphan"))
    history, stream = ls.resume_window(spark, str(ledger), checkpoint)
    assert [r.event_id for r in ls.events_of(history).collect()] == ["kept"]
    q = drain(ls.events_of(stream), "resumed", tmp_path / "c")
    with ledger.open("a") as f:
        f.write(event("after"))
    q.processAllAvailable()
    q.stop()
    assert [r.event_id for r in spark.table("resumed").collect()] == ["after"]
    for bad in ({str(ledger): -1}, {str(ledger): 0.5}, {str(ledger): True}):
        with pytest.raises(ValueError):
            ls.resume_window(spark, str(ledger), bad)


def test_streamed_totals(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_text("".join(json.dumps({"event_id": f"{k}-{i % 40}", "group_id": f"g{i % 3}"}) + "\n" for i in range(100)))
    batch = ls.first_events(ls.events_of(ls.ledger_lines(spark, str(tmp_path), split_bytes=500))).groupBy("group_id").agg(F.count("*").alias("n"))
    assert {r.group_id: r.n for r in batch.collect()} == {"g0": 42, "g1": 39, "g2": 39}
