"""Spans of traces: starts and ends paired, open ones clipped where the tree around them shows that they are over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import remove, written


def paired(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, orphan ends) of events (trace, ord, ts, kind, span, parent, name).

    A start is closed by the next event of its span in the trace if that is an
    end; one that is started again before is lost, the last one stays open. An
    end without such a start is an orphan.
    """
    marks = events.where("kind in ('span_start', 'span_end')")
    named = marks.where("span is not null and span <> ''")
    by = Window.partitionBy("trace", "span").orderBy("ts", "ord")
    near = named.withColumns({"_next": F.lead("kind").over(by), "_end": F.lead("ts").over(by), "_last": F.lag("kind").over(by)})
    starts = near.where("kind = 'span_start' and (_next is null or _next = 'span_end')")
    spans = starts.select("trace", "ord", "span", "parent", "name", F.col("ts").alias("start"), F.when(F.col("_next") == "span_end", F.col("_end")).alias("end"))
    lone = near.where("kind = 'span_end' and (_last is null or _last = 'span_end')").select(events.columns)
    return spans, lone.unionByName(marks.where("kind = 'span_end' and (span is null or span = '')").select(events.columns))


def ancestor_ends(spans: DataFrame) -> DataFrame:
    """(trace, span, ancestor_end) of open spans: the end of the nearest ancestor that is closed; null without one.

    Chains of open ancestors are followed by pointer doubling, so a chain takes
    as many rounds as its length has bits; spans on a cycle have no such ancestor.
    """
    ids = spans.groupBy("trace", "span").agg(F.max_by(F.struct("parent", "end"), F.struct(F.col("end").isNull(), "ord")).alias("s")).select("trace", "span", "s.*")
    above = ids.select("trace", F.col("span").alias("parent"), F.col("end").alias("_end"), F.lit(True).alias("_there"))
    open_ = ids.where("end is null and coalesce(parent, '') <> ''").drop("end").join(above, ["trace", "parent"], "left")
    # up: the next open ancestor to ask; done where it is null.
    jump = open_.select("trace", "span", F.when(F.col("_there") & F.col("_end").isNull(), F.col("parent")).alias("up"), F.col("_end").alias("found"))
    spark, old = spans.sparkSession, []
    jump, path = written(jump, "ancestors")
    rounds = int(jump.count()).bit_length() + 1
    for _ in range(rounds):
        if jump.where("up is not null").isEmpty():
            break
        old.append(path)
        more = jump.select("trace", F.col("span").alias("up"), F.col("up").alias("_up"), F.col("found").alias("_found"))
        rest = jump.where("up is not null").join(more, ["trace", "up"], "left").select("trace", "span", F.col("_up").alias("up"), F.col("_found").alias("found"))
        jump, path = written(rest.unionByName(jump.where("up is null")), "ancestors")
        remove(spark, *old[:-1])
        old = old[-1:]
    return jump.select("trace", "span", F.col("found").alias("ancestor_end"))


def clipped_spans(events: DataFrame) -> DataFrame:
    """(trace, span, parent, name, state, start, end, display_end, clipped_by) of events (trace, ord, ts, kind, span, parent, name).

    ``state`` is closed_span, open_span or orphan_end (start and end: its
    time). An open span is shown to the earliest of the trace's last event
    (row_end), the first start of a sibling after its own (next_sibling_start)
    and the end of its nearest closed ancestor if that is after its start
    (ancestor_end), in this order on ties; to its own start (self) if that is
    not later. Siblings have the same parent, or none. Nulls in ``parent`` and
    ``span`` count as none. Every window is over one span or one parent.
    """
    events = events.select("trace", "ord", "ts", "kind", "span", F.nullif("parent", F.lit("")).alias("parent"), "name")
    spans, orphans = paired(events)
    last = events.groupBy("trace").agg(F.max("ts").alias("_row"))
    starts = spans.select("trace", "parent", "start").distinct()
    following = starts.withColumn("_sibling", F.lead("start").over(Window.partitionBy("trace", "parent").orderBy("start")))
    following = following.select(F.col("trace").alias("_t"), F.col("parent").alias("_p"), F.col("start").alias("_s"), "_sibling")
    same = F.col("trace").eqNullSafe(F.col("_t")) & F.col("parent").eqNullSafe(F.col("_p")) & (F.col("start") == F.col("_s"))
    open_ = spans.where("end is null").join(following, same, "left").drop("_t", "_p", "_s")
    open_ = open_.join(ancestor_ends(spans), ["trace", "span"], "left").join(last, "trace", "left")
    ends = [("row_end", F.col("_row")), ("next_sibling_start", F.col("_sibling")), ("ancestor_end", F.when(F.col("ancestor_end") > F.col("start"), F.col("ancestor_end")))]
    best = F.array_min(F.filter(F.array(*(F.struct(t.alias("at"), F.lit(k).alias("rank"), F.lit(n).alias("by")) for k, (n, t) in enumerate(ends))), lambda c: c["at"].isNotNull()))
    open_ = open_.withColumn("_best", best).withColumn("_late", F.coalesce(F.col("_best.at") > F.col("start"), F.lit(False)))
    shown = open_.select(
        "trace", "span", "parent", "name", F.lit("open_span").alias("state"), "start", F.lit(None).cast(spans.schema["end"].dataType).alias("end"),
        F.when(F.col("_late"), F.col("_best.at")).otherwise(F.col("start")).alias("display_end"), F.when(F.col("_late"), F.col("_best.by")).otherwise("self").alias("clipped_by"),
    )
    closed = spans.where("end is not null").select("trace", "span", "parent", "name", F.lit("closed_span").alias("state"), "start", "end", F.col("end").alias("display_end"), F.lit(None).cast("string").alias("clipped_by"))
    lone = orphans.select("trace", "span", "parent", "name", F.lit("orphan_end").alias("state"), F.col("ts").alias("start"), F.col("ts").alias("end"), F.col("ts").alias("display_end"), F.lit(None).cast("string").alias("clipped_by"))
    return closed.unionByName(shown).unionByName(lone)
