"""Connected components and maximal independent sets as DataFrame rounds.

No adjacency list is ever gathered: a round is an aggregate with map-side
combine and a join, so a vertex that holds a third of all edges is a skewed
join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.scratch import drop_written, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)``: the smallest node that a chain of edges reaches.

    Alternating large-star and small-star contraction, O(log n) rounds. Edges
    with a null end are ignored; a self-loop makes its node a component.
    Nodes may be of any orderable type. Raises RuntimeError if ``max_rounds``
    do not reach the fixpoint, rather than return wrong labels.
    """
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct()
    base = written(clean, "cc-edges")
    nodes = base.select(F.col("u").alias("node")).union(base.select("v")).distinct()
    now = base.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    last, kept = None, None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("a"), "m").where("a <> m").union(down.select("u", "m"))
        step = written(small.select(F.col("a").alias("u"), F.col("m").alias("v")).distinct(), "cc-round")
        mark = step.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if kept is not None:
            drop_written(kept)
        now, kept = step, step
        if last == (mark.n, mark.h):
            found = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
            return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        last = (mark.n, mark.h)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def priority_independent_set(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(node, role, representative)`` of the lexicographically first maximal independent set.

    ``nodes``: ``node``, ``rank`` (unique, smaller is better), ``eligible``.
    ``edges``: ``src``, ``dst``, undirected. Rounds: a live eligible node that
    has no better live eligible neighbour becomes a representative, its live
    neighbours become losers. Losers are given their best adjacent
    representative after the fixpoint. Nodes that are neither (isolated or
    without an eligible neighbour) have role ``'kept'``.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    rank = nodes.select("node", "rank", "eligible")
    arcs = written(
        both.join(rank.select(F.col("node").alias("src"), F.col("rank").alias("sr"), F.col("eligible").alias("se")), "src").join(
            rank.select(F.col("node").alias("dst"), F.col("rank").alias("dr"), F.col("eligible").alias("de")), "dst"
        ),
        "mis-arcs",
    )
    live, reps = arcs, None
    for _ in range(max_rounds):
        best = live.where("se").groupBy("src", "sr").agg(F.min(F.when(F.col("de"), F.col("dr"))).alias("b"))
        new = best.where("b is null or sr < b").select(F.col("src").alias("rep"))
        reps = written(new if reps is None else reps.union(new), "mis-reps")
        gone = live.join(reps.withColumnRenamed("rep", "src"), "src", "left_semi").select(F.col("dst").alias("g")).union(reps.select("rep")).distinct()
        live = written(
            live.join(gone.withColumnRenamed("g", "src"), "src", "left_anti").join(gone.withColumnRenamed("g", "dst"), "dst", "left_anti"), "mis-live"
        )
        if live.where("se").isEmpty():
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    lost = (
        arcs.join(reps.withColumnRenamed("rep", "dst"), "dst", "left_semi")
        .join(reps.withColumnRenamed("rep", "src"), "src", "left_anti")
        .groupBy(F.col("src").alias("node"))
        .agg(F.min_by("dst", "dr").alias("representative"))
    )
    heads = lost.select(F.col("representative").alias("node")).distinct().withColumn("head", F.lit(True))
    return (
        nodes.select("node")
        .join(lost, "node", "left")
        .join(heads, "node", "left")
        .select(
            "node",
            F.when(F.col("representative").isNotNull(), "loser").when(F.col("head"), "representative").otherwise("kept").alias("role"),
            "representative",
        )
    )
