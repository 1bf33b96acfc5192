"""Operator 1: mixing sources to target weights by Pfair scheduling, with DataFrame functions only."""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, scratch

#: Rows of a block at least, and blocks at about most: a block grows with the table, its schedule doesn't. A source's last block may be shorter.
BLOCK_ROWS, MOST_BLOCKS = 64, 2**20
#: Slots that one step and one job of the exact schedule place.
CHUNK_SLOTS = 64
EPOCH_SLOTS = 2**17
#: Rows of a source that one task ranks, about.
RANKED_ROWS = 2**16


def rows_of_a_block(n: int) -> int:
    """BLOCK_ROWS, or as many rows as cut ``n`` into MOST_BLOCKS blocks."""
    return max(BLOCK_ROWS, -(-n // MOST_BLOCKS))


def _sources(docs: DataFrame, weights: dict[str, float] | None, slots: int | None, block_rows: int) -> DataFrame:
    """(source, n, blocks, w) and with ``slots`` quota: one row a source."""
    src = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.sqrt(F.col("n").cast("double"))
    else:
        pairs = [x for name, w in sorted(weights.items()) for x in (F.lit(name), F.lit(float(w)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("source")] if pairs else F.lit(0.0), F.lit(0.0))
    src = src.withColumn("w", weight).withColumn("blocks", F.ceil(F.col("n") / block_rows))
    if slots is None:
        return src.select("source", "n", "blocks", "w")
    total = F.sum("w").over(Window.partitionBy())
    quota = F.greatest(F.lit(1), F.round(F.lit(slots) * F.try_divide("w", total)).cast("int"))
    return src.select("source", "n", "blocks", "w", F.coalesce(quota, F.lit(1)).cast("long").alias("quota"))


def _patterns(src: DataFrame) -> DataFrame:
    """(lasts, own, source, local, slot): the slots of each kind of round.

    Round r of a source holds its blocks r * quota to (r + 1) * quota - 1; its
    last round may hold fewer. Rounds differ only by which sources are in it
    whole, end in it or have ended, so there is one pattern for each distinct
    last round and one for the rounds between two of them. Within a round a
    block is released when the ideal fluid share reaches it and due when that
    share has completed it; earliest deadline first then meets each deadline.
    """
    last = F.expr("(blocks - 1) div quota")
    src = src.withColumn("ends", last).withColumn("rest", F.expr("blocks - ((blocks - 1) div quota) * quota"))
    ends = src.select("ends").distinct()
    kinds = ends.select(F.col("ends").alias("lasts"), F.explode(F.array(F.lit(True), F.lit(False))).alias("own"))
    # Few rows: distinct last rounds by sources.
    held = kinds.join(F.broadcast(src), F.col("ends") >= F.col("lasts"))
    count = F.when(F.col("own") & (F.col("ends") == F.col("lasts")), F.col("rest")).otherwise(F.col("quota"))
    held = held.select("lasts", "own", "source", "quota", count.alias("c"))
    every = held.groupBy("lasts", "own").agg(F.collect_list(F.struct("quota", "c")).alias("all"))
    jobs = held.join(every, ["lasts", "own"]).withColumn("local", F.explode(F.expr("sequence(0L, c - 1)")))

    def share(at: str) -> Column:
        """Fluid work of the round, times quota, when the source has had ``at`` blocks."""
        return F.expr(f"aggregate(all, 0L, (s, o) -> s + least(o.c * quota, o.quota * ({at})))")

    jobs = jobs.select(
        "lasts", "own", "source", "local", (share("local + 1") + F.col("quota") - 1).alias("up"), share("local").alias("down"), "quota"
    ).selectExpr("lasts", "own", "named_struct('due', up div quota, 'release', down div quota, 'source', source, 'local', local) AS job")
    lists = jobs.groupBy("lasts", "own").agg(F.sort_array(F.collect_list("job")).alias("jobs"))
    edf = """
        aggregate(
          sequence(0, size(jobs) - 1),
          named_struct('rest', jobs, 'out', slice(jobs, 1, 0)),
          (acc, t) -> transform(array(filter(acc.rest, j -> j.release <= t)[0]), p -> named_struct(
            'rest', filter(acc.rest, j -> not (j.source <=> p.source and j.local = p.local)),
            'out', concat(acc.out, array(p))))[0]
        ).out"""
    placed = lists.select("lasts", "own", F.posexplode(F.expr(edf)).alias("slot", "job"))
    return placed.select("lasts", "own", "job.source", "job.local", F.col("slot").cast("long").alias("slot"))


def schedule(src: DataFrame) -> DataFrame:
    """(source, block, slot) for every block of every source."""
    src = src.withColumn("ends", F.expr("(blocks - 1) div quota"))
    known = src.agg(
        F.sort_array(F.collect_set("ends")).alias("ends"), F.collect_list(F.struct("blocks", "quota")).alias("all")
    )
    blocks = src.select("source", "quota", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    blocks = blocks.selectExpr("source", "block", "block div quota AS turn", "block % quota AS local", "1 AS one")
    blocks = blocks.join(F.broadcast(known.withColumn("one", F.lit(1))), "one")
    blocks = blocks.select(
        "source", "block", "local",
        F.expr("filter(ends, e -> e >= turn)[0]").alias("lasts"),
        F.expr("array_contains(ends, turn)").alias("own"),
        F.expr("aggregate(all, 0L, (s, o) -> s + least(o.blocks, o.quota * turn))").alias("before"),
    )
    found = _patterns(src.drop("ends")).withColumnRenamed("source", "src")
    same = (
        F.col("source").eqNullSafe(F.col("src"))
        & (blocks["local"] == found["local"]) & (blocks["lasts"] == found["lasts"]) & (blocks["own"] == found["own"])
    )
    return blocks.join(found, same).select("source", "block", (F.col("before") + F.col("slot")).alias("slot"))


def _windows(src: DataFrame) -> DataFrame:
    """(release, due, key, source, block) of every block, from the exact weights; key numbers the sources.

    A weight is the fraction that its double stands for. Sources of weight 0
    have no share before the others have ended, and equal shares then.
    """
    rows = sorted(src.select("source", "blocks", "w").collect(), key=lambda r: (r.source is not None, r.source or ""))
    exact = [Fraction(r.w) if math.isfinite(r.w) and r.w > 0 else Fraction(0) for r in rows]
    scale = math.lcm(*(x.denominator for x in exact))
    whole = [int(x * scale) for x in exact]
    common = math.gcd(*whole) or 1
    first = sum(r.blocks for r, x in zip(rows, whole, strict=True) if x)
    table = [
        (k, r.source, r.blocks, Decimal(x // common or 1), x > 0, 0 if x else first)
        for k, (r, x) in enumerate(zip(rows, whole, strict=True))
    ]
    schema = "key int, source string, blocks long, w decimal(38,0), weighted boolean, ahead long"
    table = src.sparkSession.createDataFrame(table, schema)
    every = table.groupBy("weighted").agg(F.collect_list(F.struct(F.col("blocks").cast("decimal(20,0)").alias("blocks"), "w")).alias("all"))
    jobs = table.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).repartition("key", "block")
    jobs = jobs.join(F.broadcast(every), "weighted")

    def share(at: str) -> str:
        """Fluid work of all sources, times w, when the source has had ``at`` blocks."""
        term = f"least(cast(o.blocks * w as decimal(38,0)), cast(o.w * cast({at} as decimal(20,0)) as decimal(38,0)))"
        return f"aggregate(all, cast(0 as decimal(38,0)), (s, o) -> cast(s + {term} as decimal(38,0)))"

    return jobs.selectExpr(
        f"ahead + ({share('block')} div w) AS release", f"ahead + (({share('block + 1')} + w - 1) div w) AS due", "key", "source", "block"
    )


def exact_schedule(src: DataFrame) -> DataFrame:
    """(source, block, slot) for every block of every source: earliest deadline first in the windows of ``_windows``.

    A block is released in the slot in which the ideal fluid share reaches it
    and due when that share has completed it. Each slot depends on the ones
    before, so one task places up to EPOCH_SLOTS blocks and hands the released
    ones that are left, one a source at most, to the next job.
    """
    jobs = scratch(_windows(src), "windows")
    spark, total = src.sparkSession, jobs.count()
    job = "named_struct('due', due, 'key', key, 'block', block, 'release', release)"
    empty = "cast(array() AS array<struct<due: bigint, key: int, block: bigint, release: bigint>>)"
    carry = spark.range(1).selectExpr(f"{empty} AS rest")
    placed = []
    for at in range(0, total, EPOCH_SLOTS):
        end = min(at + EPOCH_SLOTS, total)
        new = jobs.where((F.col("release") >= at) & (F.col("release") < end)).selectExpr(f"release div {CHUNK_SLOTS} AS id", f"{job} AS job")
        new = new.groupBy("id").agg(F.collect_list("job").alias("jobs"))
        chunks = spark.range(at // CHUNK_SLOTS, -(-end // CHUNK_SLOTS)).join(new, "id", "left")
        chunks = chunks.selectExpr(f"struct(id, coalesce(jobs, {empty}) AS jobs) AS chunk")
        # The released blocks that are left, one a source at most, are a value of the plan.
        chunks = chunks.agg(F.sort_array(F.collect_list("chunk")).alias("chunks")).withColumn("rest", carry.scalar())
        edf = f"""
            aggregate(
              chunks,
              named_struct('rest', rest, 'out', array({empty})),
              (acc, c) -> transform(array(aggregate(
                sequence(c.id * {CHUNK_SLOTS}, least((c.id + 1) * {CHUNK_SLOTS}, {end}L) - 1),
                named_struct('rest', concat(acc.rest, c.jobs), 'out', {empty}),
                (a, t) -> transform(array(array_min(filter(a.rest, j -> j.release <= t))), p -> named_struct(
                  'rest', filter(a.rest, j -> j.key <> p.key or j.block <> p.block),
                  'out', concat(a.out, array(p))))[0]
              )), x -> named_struct('rest', x.rest, 'out', concat(acc.out, array(x.out))))[0]
            )"""
        done = scratch(chunks.select(F.expr(edf).alias("d")).select("d.rest", F.expr("flatten(d.out)").alias("out")), "epoch")
        carry = done.select("rest")
        placed.append(done.select(F.posexplode("out").alias("slot", "j")).selectExpr("j.key", "j.block", f"slot + {at}L AS slot"))
    if not placed:
        return jobs.selectExpr("source", "block", "release AS slot")
    names = jobs.select("key", "source").distinct()
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.join(F.broadcast(names), "key").select("source", "block", "slot")


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    slots: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """(doc_id, source, block, slot, position) of every row: the order of the mix, from position 0.

    Each source's rows are shuffled by hash of id and cut into blocks of
    ``block_rows`` (without it, of ``rows_of_a_block``). At any slot, a source is less than one block from its
    ideal share, that of its exact weight (without ``weights``, the root of
    its row count). When it has no more blocks, the others go on in
    proportion, so every row has one place and none is dropped or repeated.
    Sources that ``weights`` don't name, or of weight 0, follow the others.

    With ``slots``, weights are rounded to a quota of whole blocks in each
    round of about so many slots, one at least (a source that ``weights``
    don't name has one): the ideal share is then that of the quotas, and all
    kinds of rounds are placed at once.

    Rows without source are one source of their own; null ids sort first
    within the same hash; rows that repeat an id stand side by side. Other
    columns are ignored. Tables by source and by kind of round reach one
    task: their size depends on the number of sources only. Without ``slots``,
    blocks are placed one after another, EPOCH_SLOTS in a task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    if block_rows is None:
        block_rows = rows_of_a_block(rows.count())
    src = scratch(_sources(rows, weights, slots, block_rows), "sources")
    most = src.agg(F.max("n")).first()[0] or 1
    bits = max(10, min(20, math.ceil(math.log2(most / RANKED_ROWS))))
    plan = scratch(exact_schedule(src) if slots is None else schedule(src), "schedule")
    keyed = rows.withColumn("h", F.xxhash64("doc_id", F.lit("mix")))
    keyed = keyed.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    sizes = keyed.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("ahead")
    )
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id")
    ranked = keyed.withColumn("r", F.row_number().over(within))
    ranked = ranked.join(sizes, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    place = F.col("ahead") + F.col("r") - 1
    ranked = ranked.select("doc_id", "source", place.alias("place"))
    ranked = ranked.selectExpr("doc_id", "source", f"place div {block_rows} AS block", f"place % {block_rows} AS inside")
    # One short block a source: their slots and gaps are a list as long as the sources are many, folded once a block.
    short = src.select("source", (F.col("blocks") - 1).alias("block"), (F.col("blocks") * block_rows - F.col("n")).alias("gap"))
    short = short.where("gap > 0").withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    short = plan.join(short, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    gaps = short.agg(F.collect_list(F.struct("slot", "gap")).alias("gaps"))
    begin = F.expr(f"slot * {block_rows} - aggregate(gaps, 0L, (s, g) -> s + if(g.slot < slot, g.gap, 0L))")
    plan_s = plan.withColumn("gaps", gaps.scalar()).select(F.col("source").alias("s"), F.col("block").alias("b"), "slot", begin.alias("begin"))
    out = ranked.join(plan_s, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return out.select("doc_id", "source", "block", "slot", (F.col("begin") + F.col("inside")).alias("position"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every row of ``documents`` in the mix of its sources."""
    return mix(read(spark, sf_dir, "documents"))
