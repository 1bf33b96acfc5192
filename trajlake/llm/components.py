"""Distributed connected components by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Each round hooks every current root to its smallest neighbour, jumps the
    pointers until they are flat and contracts the graph, so edges shrink from
    round to round. Nothing but row counts reaches the driver; each round's
    tables are written to the shared folder. Null ends and self links are
    ignored; no edges give no rows. Ids may be of any orderable type.
    """
    spark = edges.sparkSession
    e = scratch(
        edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
        .where("a < b")
        .distinct(),
        "edges",
    )
    labels = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = scratch(labels.withColumn("root", F.col("node")), "labels")
    while not e.isEmpty():
        hook = scratch(e.groupBy(F.col("b").alias("c")).agg(F.min("a").alias("p")), "hook")
        while True:
            up = hook.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = hook.join(up, "p", "left").select("c", F.coalesce("pp", "p").alias("q"), "pp")
            jumped = scratch(jumped, "jump")
            moved = not jumped.where("pp is not null").isEmpty()
            old, hook = hook if hasattr(hook, "scratch_path") else jump_table, jumped.select("c", F.col("q").alias("p"))
            release(old)
            jump_table = jumped
            if not moved:
                break
        root_of = hook.select(F.col("c").alias("root"), "p")
        moved_to = labels.join(root_of, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        old_labels, labels = labels, scratch(moved_to, "labels")
        ends = e
        for end in ("a", "b"):
            ends = ends.join(hook.select(F.col("c").alias(end), F.col("p").alias(f"p_{end}")), end, "left")
        x, y = F.coalesce("p_a", "a"), F.coalesce("p_b", "b")
        old_edges, e = e, scratch(
            ends.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a < b").distinct(), "edges"
        )
        release(old_labels, old_edges, jump_table)
    release(e)
    return labels
