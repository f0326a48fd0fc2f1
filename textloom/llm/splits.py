"""Splits that keep related records together: component swap search.

Books are tied by their authors (however spelled) into components; a component
goes to one split as a whole. The search starts from hashed assignment and
moves or exchanges components to lower

    sum over splits of (size deviation)^2 + (label deviation)^2

by annealing, several seeds in parallel, and the best is kept.

Scale: components with at least ``big_share`` of all rows number at most
``1 / big_share``, whatever the input; they are placed first, by one task a
seed. The rest is dealt by hash into blocks of a few thousand components, each
annealed by its own task towards the targets that the big ones leave. Only the
splits' sums come to the driver.

Defined results: rows with a null book follow their author's component, and
without a named author stand alone; repeated rows count as often as they come;
splits with a null or negative share get nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.names import author_clusters
from textloom.operators.graph import connected_components
from textloom.scratch import written

LABELS = ("continuation", "infilling", "restoration", "")


def book_groups(cases: DataFrame, book: str = "source_id", author: str = "source_author", clusters: DataFrame | None = None) -> DataFrame:
    """``(source_id, root_source_id)``: books tied by a chain of shared authors; ``clusters``: what ``author_clusters`` gave, if it is known."""
    pairs = written(
        cases.select(F.col(book).alias("source_id"), F.col(author).alias("spelling")).where("source_id is not null").distinct(), "split-books"
    )
    clusters = written(author_clusters(cases, author, book), "split-authors") if clusters is None else clusters
    named = pairs.join(clusters, "spelling").select("source_id", "author_key").distinct()
    # A star around an author's smallest book: as many edges as rows, not pairs.
    low = named.groupBy("author_key").agg(F.min("source_id").alias("low"))
    edges = named.join(low, "author_key").select(F.col("source_id").alias("src"), F.col("low").alias("dst"))
    loops = pairs.select(F.col("source_id").alias("src"), F.col("source_id").alias("dst")).distinct()
    comp = connected_components(edges.union(loops))
    return comp.select(F.col("node").alias("source_id"), F.col("component").alias("root_source_id"))


def related_books(cases: DataFrame) -> DataFrame:
    """``(root_source_id, source_id)`` for each book that isn't the smallest of its group."""
    return book_groups(cases).where("source_id <> root_source_id").select("root_source_id", "source_id")


def clean_task(col: str = "task"):
    """The task label, lower-cased and trimmed; '' where it is null or unknown."""
    t = F.lower(F.trim(F.col(col)))
    return F.when(t.isin(*LABELS[:-1]), t).otherwise(F.lit(""))


def anneal(
    weights: list[list[int]], start: list[int], target: list[float], labels: list[float], seed: int, steps: int
) -> tuple[list[int], float]:
    """Place items so that splits meet their targets; returns the best assignment and its cost.

    ``weights[i]``: rows of item i by label; ``target[s]``: rows wanted in
    split s; ``labels[k]``: share of label k in all rows. A step moves an item
    to another split or exchanges two items of different splits.
    """
    rng = random.Random(seed)
    n, k, m = len(weights), len(labels), len(target)
    total = max(1.0, float(sum(map(sum, weights))))
    load = [[0.0] * k for _ in range(m)]
    for w, s in zip(weights, start):
        for j in range(k):
            load[s][j] += w[j]

    def part(s: int, add: list[float]) -> float:
        size = sum(add)
        scale = total * 0.01 + max(target[s], 0.0)
        return ((size - target[s]) / scale) ** 2 + 0.25 * sum(((add[j] - labels[j] * size) / scale) ** 2 for j in range(k))

    cost = [part(s, load[s]) for s in range(m)]
    now, best_cost = list(start), sum(cost)
    best, heat = list(start), max(1e-6, 0.1 * best_cost)
    if n == 0 or m < 2:
        return best, best_cost
    cool = 1e-4 ** (1 / max(1, steps))
    for _ in range(steps):
        i = rng.randrange(n)
        a = now[i]
        if rng.random() < 0.5:
            b, j = rng.randrange(m), -1
        else:
            j = rng.randrange(n)
            b = now[j]
        if a != b:
            back = weights[j] if j >= 0 else [0] * k
            la = [load[a][q] - weights[i][q] + back[q] for q in range(k)]
            lb = [load[b][q] + weights[i][q] - back[q] for q in range(k)]
            ca, cb = part(a, la), part(b, lb)
            delta = ca + cb - cost[a] - cost[b]
            if delta <= 0 or rng.random() < math.exp(-delta / heat):
                load[a], load[b], cost[a], cost[b], now[i] = la, lb, ca, cb, b
                if j >= 0:
                    now[j] = a
                if sum(cost) < best_cost - 1e-15:
                    best, best_cost = list(now), sum(cost)
        heat *= cool
    return best, best_cost


def _hashed(keys: list[int], shares: list[float]) -> list[int]:
    out = []
    for key in keys:
        u, s = (key & 0xFFFFFFFF) / 2**32, 0
        while s < len(shares) - 1 and u >= shares[s]:
            u -= shares[s]
            s += 1
        out.append(s)
    return out


def assign_components(components: DataFrame, targets: list[tuple[str, float]], big_share: float = 0.0005, block: int = 2000, seeds: int = 4, sweeps: int = 40) -> DataFrame:
    """``(component, split_name)`` for components with label counts ``n0 .. nk``.

    The objective of a seed is summed over blocks and the best seed is kept.
    """
    spark = components.sparkSession
    names = [n for n, s in targets if s is not None and s > 0]
    shares = [s for _, s in targets if s is not None and s > 0]
    shares = [s / sum(shares) for s in shares] if shares else []
    counts = [f"n{j}" for j in range(len(LABELS))]
    size = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))
    base = written(components.select("component", *counts, size.alias("size"), F.xxhash64("component").alias("h")), "split-components")
    sums = base.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], F.count("*").alias("n")).first()
    total = sum(sums[c] for c in counts)
    empty = spark.createDataFrame([], f"component {dict(base.dtypes)['component']}, split_name string")
    if not total or not names:
        return empty
    labels = [sums[c] / total for c in counts]
    # At most 1 / big_share components hold that share of the rows: a proven bound of what a task gets.
    least = max(1, total * big_share)
    want = [s * total for s in shares]
    kind = dict(base.dtypes)["component"]
    trial = f"component {kind}, size bigint, seed int, split int, cost double"

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "component"], ascending=[False, True])
        w, seed = pdf[counts].astype("int64").values.tolist(), int(pdf["seed"].iloc[0])
        found, cost = anneal(w, _hashed(pdf["h"].tolist(), shares), want, labels, seed, sweeps * 50 + sweeps * len(w))
        return pd.DataFrame({"component": pdf["component"].values, "size": pdf["size"].values, "seed": seed, "split": _place_big(w, want, found), "cost": cost})

    big = base.where(F.col("size") >= least).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    placed = written(big.groupBy("seed").applyInPandas(place, trial), "split-big")
    first = placed.groupBy("seed").agg(F.max("cost").alias("c")).orderBy("c", "seed").select("seed").limit(1)
    placed = placed.join(F.broadcast(first), "seed").select("component", "size", "split")
    filled = {r["split"]: (r["size"], r["n"]) for r in placed.groupBy("split").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}  # a row per split
    left = [max(0.0, x - filled.get(k, (0, 0))[0]) for k, x in enumerate(want)]
    rest_total = max(1e-9, sum(left))
    rest = [x / rest_total for x in left]
    small = base.where(F.col("size") < least)
    n_small = sums["n"] - sum(n for _, n in filled.values())
    blocks = max(1, -(-n_small // block))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component")
        w = pdf[counts].astype("int64").values.tolist()
        mine = float(sum(map(sum, w)))
        outs = []
        for seed in range(seeds):
            found, cost = anneal(w, _hashed(pdf["h"].tolist(), rest), [s * mine for s in rest], labels, seed, sweeps * max(50, len(w)))
            outs.append(pd.DataFrame({"component": pdf["component"].values, "seed": seed, "split": found, "cost": cost / len(w)}))
        return pd.concat(outs)

    tried = written(
        small.withColumn("block", F.pmod(F.shiftright("h", 7), F.lit(blocks))).groupBy("block").applyInPandas(search, f"component {kind}, seed int, split int, cost double"),
        "split-trials",
    )
    best = tried.groupBy("seed").agg(F.sum("cost").alias("c")).orderBy("c", "seed").select("seed").limit(1)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("split") + 1)
    return placed.select("component", label.alias("split_name")).union(tried.join(F.broadcast(best), "seed").select("component", label.alias("split_name")))


def _place_big(weights: list[list[int]], want: list[float], found: list[int]) -> list[int]:
    """Move a big component out of a split that it overfills, where another has room for it."""
    load = [0.0] * len(want)
    for w, s in zip(weights, found):
        load[s] += sum(w)
    out = list(found)
    for i in sorted(range(len(out)), key=lambda i: -sum(weights[i])):
        s, w = out[i], sum(weights[i])
        if load[s] > want[s]:
            to = max(range(len(want)), key=lambda q: want[q] - load[q])
            if to != s and max(load[to] + w - want[to], 0) < load[s] - want[s]:
                load[s] -= w
                load[to] += w
                out[i] = to
    return out


def split_cases(cases: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """``(id, source_id, component, label, split_name)``, a row per row of ``cases``."""
    clusters = written(author_clusters(cases), "split-names")
    groups = written(book_groups(cases, clusters=clusters), "split-groups")
    rows = cases.select("id", "source_id", F.col("source_author").alias("spelling"), clean_task().alias("label"))
    by_book = rows.join(groups, "source_id", "left")
    lone = clusters.join(rows.where("source_id is not null").select("source_id", "spelling").distinct(), "spelling").join(groups, "source_id")
    of_author = lone.groupBy("author_key").agg(F.min("root_source_id").alias("author_root"))
    spell = clusters.join(of_author, "author_key", "left").select("spelling", F.coalesce(F.col("author_root").cast("string"), F.concat(F.lit("author:"), "author_key")).alias("by_author"))
    placed = written(
        by_book.join(spell, "spelling", "left").select(
            "id",
            "source_id",
            "label",
            F.coalesce(F.col("root_source_id").cast("string"), F.col("by_author"), F.concat(F.lit("row:"), F.coalesce("id", F.lit("")))).alias("component"),
        ),
        "split-rows",
    )
    sums = placed.groupBy("component").agg(*[F.count(F.when(F.col("label") == x, 1)).alias(f"n{j}") for j, x in enumerate(LABELS)])
    wanted = [(r["split_name"], r["target_share"]) for r in targets.orderBy("split_name").collect()]
    chosen = assign_components(sums, wanted, **options)
    return placed.join(chosen, "component", "left").select("id", "source_id", "component", "label", "split_name")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """``(split_name, rows, components, share, target_share, label_deviation)`` of an assignment.

    ``label_deviation``: the greatest difference of a label's share in the split
    from its share in all rows; 0 for an empty split.
    """
    per = written(assigned.groupBy("split_name", "label").agg(F.count("*").alias("n")), "split-labels")
    whole = per.groupBy("label").agg(F.sum("n").alias("all_n"))
    size = per.groupBy("split_name").agg(F.sum("n").alias("size"))
    total = per.agg(F.sum("n").alias("total"))
    # Labels and splits are a few fixed values.
    cells = size.join(F.broadcast(whole), F.lit(True)).join(F.broadcast(total), F.lit(True)).join(per, ["split_name", "label"], "left")
    off = F.max(F.abs(F.coalesce("n", F.lit(0)) / F.col("size") - F.col("all_n") / F.col("total"))).alias("label_deviation")
    got = assigned.groupBy("split_name").agg(F.count("*").alias("rows"), F.countDistinct("component").alias("components"))
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy(F.lit(1)))
    zero = F.lit(0)
    return (
        targets.select("split_name", "target_share")
        .join(got, "split_name", "left")
        .join(cells.groupBy("split_name").agg(off), "split_name", "left")
        .select(
            "split_name",
            F.coalesce("rows", zero).alias("rows"),
            F.coalesce("components", zero).alias("components"),
            F.coalesce(share, F.lit(0.0)).alias("share"),
            "target_share",
            F.coalesce("label_deviation", F.lit(0.0)).alias("label_deviation"),
        )
    )
