import pytest
from pyspark.sql import functions as F

from textloom.operators import cases as C
from textloom.operators import mixing as X


def test_schedules_parse_and_reject(spark):
    assert X.parse_schedule(spark, "mix-a").count() == 2
    assert X.parse_schedule(spark, '{"a": 1, "b": 3}').count() == 2
    assert X.parse_schedule(spark, '[[0, {"a": 1, "b": 0}], [1, {"a": 0, "b": 1}]]').count() == 4
    for bad in ("nonsense", '{"a": -1}', '[[2, {"a": 1}]]', '{"a": 0}', '[[0, {"a": 1}], [1, {"b": 1}]]', "[]"):
        with pytest.raises(ValueError):
            X.parse_schedule(spark, bad)


def test_allocation_sums_and_does_not_drift(spark):
    sch = X.parse_schedule(spark, "cooldown-ramp").withColumn("schedule_name", F.lit("x"))
    st = spark.range(200).select(F.col("id").alias("step"), (F.col("id") / 200).alias("progress"))
    w = X.weights_at(sch, st)
    a = X.cursors(X.allocation(w, 13))
    assert {r["c"] for r in a.groupBy("step").agg(F.sum("count").alias("c")).collect()} == {13}
    assert a.where("abs(carry) > 1.0000001 or count < 0").count() == 0
    want, got = w.where("slice = 'register'").agg(F.sum("weight")).first()[0] * 13, a.where("slice = 'register'").agg(F.sum("count")).first()[0]
    assert abs(want - got) <= 1
    # Resuming is filtering the plan by step.
    assert a.where("step = 120 and slice = 'register'").first()["cursor_before"] == a.where("step < 120 and slice = 'register'").agg(F.sum("count")).first()[0]


def test_interleave_spreads(spark):
    c = spark.createDataFrame([("x", 0, "a", 6), ("x", 0, "b", 3), ("x", 0, "z", 0)], "schedule_name string, step int, slice string, count int")
    order = "".join(r["slice"] for r in X.interleave(c).orderBy("slot").collect())
    assert sorted(order) == list("aaaaaabbb") and "bb" not in order


def test_pool_plan_crosses_shards_and_refuses_long_blocks(spark):
    shards = spark.createDataFrame([("a", 0, 10), ("a", 1, 8)], "slice string, shard bigint, n_tokens bigint")
    counts = spark.createDataFrame([("x", k, "a", n) for k, n in enumerate([2, 1, 2, 3])], "schedule_name string, step bigint, slice string, count int")
    got = {r["step"]: (r["epoch"], r["shard"], r["pos"]) for r in X.pool_plan(counts, shards, 3).collect()}
    assert got == {0: (0, 0, 0), 1: (0, 0, 6), 2: (0, 1, 0), 3: (1, 0, 0)}
    long = spark.createDataFrame([("x", 0, "a", 9)], counts.schema)
    assert X.pool_plan(long, shards, 3).first()["pos"] is None


def test_pack_documents_fills_ranks(spark):
    d = spark.createDataFrame([(0, 0, 7), (0, 7, 9), (0, 9, 30), (0, 30, 31)], "shard bigint, start bigint, stop bigint")
    got = [(r["rank"], r["start"], r["stop"]) for r in X.pack_documents(d, 9, 5).orderBy("rank", "seq_no").collect()]
    assert got == [(0, 0, 5), (0, 7, 9), (0, 9, 12)]


def test_overlap_of_edges(spark):
    rows = [("a b c d", "a b c d", "infilling"), ("a b", "", "continuation"), (None, "a", "x"), ("The Cat sat!", "the cat (sat)", "restoration")]
    r = C.overlap_scores(spark.createDataFrame(rows, "p string, t string, k string"), "p", "t", "k").collect()
    assert r[0]["reward"] == 1.0 and r[1]["reward"] == 0.0 and r[2]["reward"] == 0.0
    assert r[3]["word_overlap"] == 1.0 and r[3]["recall"] == 0.0


@pytest.mark.parametrize(
    "text,plain",
    [
        ("He paused: The night fell; Nothing moved.", "He paused. the night fell. nothing moved."),
        ("Verily; He came, who knew it. Twas (a joke) Nigh! The end: so  it   goes — Fine. A b.", "truly. he came. it was near! the end. so it goes. fine. a b."),
        ("Perchance (a\nb) Stop.\n\nÉtoile. Mayhap.", "maybe (a\nb) Stop. Étoile. maybe."),
        (None, None), ("", ""),
    ],
)
def test_degraded(spark, text, plain):
    assert spark.createDataFrame([(text,)], "t string").select(C.degraded(F.col("t"))).first()[0] == plain


def test_allocation_where_a_slice_owes():
    # b and c would get 3 each, a owes 1.8: one each in turn is taken back.
    assert X.allocate([-0.9, 1.7, 1.7], ["a", "b", "c"], 2, [0.0, 0.0, 0.0])[0] == [0, 1, 1]
    counts, carry = X.allocate([0.5, 0.5], ["a", "b"], 3, [-4.0, 4.0])
    assert counts == [0, 3] and carry == [-2.5, 2.5]


def test_pool_plan_can_refuse(spark):
    shards = spark.createDataFrame([("a", 0, 10)], "slice string, shard bigint, n_tokens bigint")
    counts = spark.createDataFrame([("x", 0, "a", 9), ("x", 0, "none", 1)], "schedule_name string, step bigint, slice string, count int")
    assert X.pool_plan(counts, shards, 3).count() == 1
    with pytest.raises(Exception, match="longer than every shard"):
        X.pool_plan(counts, shards, 3, strict=True).collect()


def test_passages_merge_greedily(spark):
    p = " ".join(["w"] * 50)
    text = "\n\n".join([p, p, "short one", p, " ".join(["v"] * 250), p])
    got = spark.createDataFrame([(text,), (None,)], "t string").select(C.extract_passages(F.col("t"))).collect()
    assert [len(x.split()) for x in got[0][0]] == [150, 250] and got[1][0] == []


def test_student_t():
    assert abs(C.t_lower_p(-2.015, 5) - 0.05) < 1e-4 and abs(C.t_lower_p(2.228, 10) - 0.975) < 1e-4 and C.t_lower_p(0.0, 3) == 0.5


def test_covariance_of_tasks_joins_exactly(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(1000.0, [1.0, 2.0, 0.5], (60, 3))
    df = spark.createDataFrame([(v.tolist(), 1) for v in x] + [(None, 1)], "v array<double>, i int").repartition(7)
    got = {(r["i"], r["j"]): r["cov"] for r in C.covariance(df, "v").collect()}
    want = np.cov(x.T)
    assert len(got) == 6 and all(abs(got[i, j] - want[i, j]) < 1e-9 for i, j in got)
    assert C.covariance(df.limit(0), "v").count() == 0
