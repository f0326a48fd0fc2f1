import random

from pyspark.sql import functions as F

from textloom.operators.graph import connected_components, priority_independent_set
from textloom.operators.prefix import running_sum


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "src bigint, dst bigint")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == {x: find(x) for x in root}
    assert connected_components(df.limit(0)).count() == 0


def test_star_of_one_hub(spark):
    df = spark.range(1, 500).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    assert {r["component"] for r in connected_components(df).collect()} == {0}


def greedy(nodes, edges):
    near = {n: set() for n, _, _ in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    rank = {n: r for n, r, _ in nodes}
    reps, gone = set(), set()
    for n, _, ok in sorted(nodes, key=lambda x: x[1]):
        if ok and n not in gone:
            reps.add(n)
            gone |= near[n]
    return {n: min((m for m in near[n] if m in reps), key=lambda m: rank[m]) for n, _, _ in nodes if n not in reps and near[n] & reps}


def test_independent_set_is_the_greedy_one(spark):
    rng = random.Random(3)
    nodes = [(i, r, rng.random() < 0.7) for i, r in enumerate(rng.sample(range(40), 40))]
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(50)]
    got = priority_independent_set(spark.createDataFrame(nodes, "node bigint, rank bigint, eligible boolean"), spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert {r["node"]: r["representative"] for r in got.where("role = 'loser'").collect()} == greedy(nodes, edges)


def test_no_transitive_loss(spark):
    """A chain a-b-c: the best end takes its neighbour, the other end stays."""
    nodes = spark.createDataFrame([(1, 1, True), (2, 2, True), (3, 3, True)], "node bigint, rank bigint, eligible boolean")
    got = priority_independent_set(nodes, spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint"))
    assert {r["node"]: r["role"] for r in got.collect()} == {1: "representative", 2: "loser", 3: "kept"}


def test_running_sum_over_hot_group(spark):
    rows = [("a", i, i % 7) for i in range(300)] + [("b", i, 1) for i in range(5)] + [(None, 1, None)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {(r["g"], r["k"]): r["s"] for r in running_sum(df, ["g"], ["k"], "v", "s", per_task=50).collect()}
    want, acc = {}, {}
    for g, k, v in rows:
        want[g, k] = acc.get(g, 0)
        acc[g] = acc.get(g, 0) + (v or 0)
    assert got == want
    assert running_sum(df.limit(0), ["g"], ["k"], "v", "s").count() == 0
