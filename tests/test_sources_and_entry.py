import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.operators import bpe as B
from textloom.operators import manifest as M
from textloom.operators import runs as R
from textloom.sources import shards, texts
from textloom.streaming.trajectories import StepStream


def test_shard_round_trip(spark, tmp_path):
    shards.register(spark)
    df = spark.createDataFrame([(0, [1, 2, 65535]), (1, list(range(100)))], "shard bigint, tokens array<int>")
    df.write.format("token_shard").mode("append").save(str(tmp_path / "s"))
    r = spark.read.format("token_shard").option("chunk", 30).load(str(tmp_path / "s"))
    got = {x["name"]: x["t"] for x in r.groupBy("name").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tokens"))), lambda s: s["tokens"])).alias("t")).collect()}
    assert got == {"train_000000.bin": [1, 2, 65535], "train_000001.bin": list(range(100))}
    with pytest.raises(ValueError):
        shards.check_header(shards.header(5), 1024 + 8)
    with pytest.raises(ValueError):
        shards.check_header(b"\0" * 1024, 1024)


def test_rows_of_a_shard_follow_one_another(spark, tmp_path):
    shards.register(spark)
    rows = spark.createDataFrame([(0, [1, 2, 3]), (0, [9]), (0, None), (1, [7])], "shard bigint, tokens array<int>").coalesce(1)
    rows.write.format("token_shard").mode("append").save(str(tmp_path / "s"))
    got = {r["name"]: (r["n_tokens"], r["tokens"]) for r in spark.read.format("token_shard").load(str(tmp_path / "s")).collect()}
    assert got == {"train_000000.bin": (4, [1, 2, 3, 9]), "train_000001.bin": (1, [7])}
    apart = spark.createDataFrame([(0, [1]), (1, [2]), (0, [3])], rows.schema).coalesce(1)
    for bad in (apart, apart.repartition(3), spark.createDataFrame([(5, [1, 70000])], rows.schema)):
        with pytest.raises(Exception):
            bad.write.format("token_shard").mode("append").save(str(tmp_path / "t"))
    assert not [f for f in (tmp_path / "t").iterdir() if f.name.endswith(".bin")]


def test_shards_cut_documents(spark):
    t = spark.createDataFrame([(1, [9, 1, 2]), (2, [9, 3, 4, 5, 6]), (3, [9])], "doc_id bigint, tokens array<int>")
    got = {r["shard"]: r["tokens"] for r in B.to_shards(t, 4).collect()}
    assert got == {0: [9, 1, 2, 9], 1: [3, 4, 5, 6], 2: [9]}


def test_merges(spark):
    w = spark.createDataFrame([(list("aab"), 5), (list("ab"), 2), (list("aaa"), 1)], "pieces array<string>, n bigint")
    assert B.learn_merges(w, 2) == [("a", "a", 7), ("aa", "b", 5)] or B.learn_merges(w, 2)[0] in [("a", "b", 7), ("a", "a", 7)]
    assert spark.createDataFrame([(list("aaab"),)], "p array<string>").select(B.merged(F.col("p"), "a", "a")).first()[0] == ["aa", "a", "b"]


def test_sections(spark):
    t = "preamble\n## one\nText a\n# note\nmore\n---\nignored\n## two\nB\n## one\nlast wins\n"
    got = {r["id"]: r["text"] for r in texts.parse_sections(spark.createDataFrame([("f", t), ("g", "")], "name string, text string")).collect()}
    assert got == {"one": "last wins", "two": "B"}


def test_result_rows(spark):
    lines = ["| # | steps | d | e | date | log | by |", "| - | - | - | - | - | - | - |", "| 4 | 3,600 steps | x | n=8 | 2026 | l | me |", "| 5 | too few |"]
    r = texts.result_rows(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert len(r) == 1 and r[0]["number"] == 4 and r[0]["log"] == "l"


def test_manifest_last_wins_before_filter(spark):
    rows = [(1, 1, "downloaded", None), (2, 1, "downloaded", False), (3, 2, "downloaded", True), (4, 3, "downloaded", None), (5, 3, "failed", None), (6, 4, "downloaded", None), (7, 4, "downloaded", True)]
    m = spark.createDataFrame(rows, "line_no bigint, gutenberg_id bigint, status string, copyright boolean").withColumn("written_at", F.current_timestamp())
    assert [(r["gutenberg_id"], r["line_no"]) for r in M.last_wins(m).collect()] == [(1, 2)]
    assert {r["gutenberg_id"]: r["line_no"] for r in M.first_wins(m).collect()} == {1: 1, 2: 3, 3: 4, 4: 6}
    assert spark.createDataFrame([("C:\\a\\b.bin",)], "p string").select(M.base_name(F.col("p"))).first()[0] == "b.bin"


def test_log_lines(spark):
    lines = [("r", "step:10/100 val_loss:3.5 x"), ("r", "step:20/100 val_loss:nan"), ("r", "noise step:1/2 val_loss:1")]
    assert [tuple(x) for x in R.parse_log(spark.createDataFrame(lines, "run_id string, value string")).collect()] == [("r", 10, "3.5")]


def test_step_stream_replays(spark, tmp_path):
    spark.dataSource.register(StepStream)

    def run(steps):
        q = spark.readStream.format("step_stream").option("steps", steps).option("per_batch", 50).load().writeStream.format("parquet")
        q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o"))
        q.awaitTermination()
        return sorted(r["step"] for r in spark.read.parquet(str(tmp_path / "o")).collect())

    first = run(100)
    assert first == list(range(len(first))) and first
    again = run(200)
    assert again == list(range(len(again))) and len(again) > len(first)


def test_last_readings_of_equal_times(spark, tmp_path):
    """Readings of one step at the same times, in every order, and values that end in half a unit, against the SQL."""
    from textloom.plans import registry

    at = "to_timestamp(1700000000)"
    same = [(k, v) for k, order in enumerate(("3.5 2.5 NULL", "NULL 3.5 2.5", "2.5 NULL 3.5", "4.5 'nan'", "'nan' 4.5", "8.1131745", "0.5044715", "'inf'", "1e303", "NULL")) for v in order.split()]
    rows = [f"('a', {k}, {v}::double, {t}, {r})" for t, r in ((at, at), (at, "NULL"), ("NULL", "NULL")) for k, v in same]
    rows = [x.replace("'a'", f"'{'abc'[i // len(same)]}'") for i, x in enumerate(rows)] + [f"('d', 0, 2.5, {at}, {at} + INTERVAL 1 SECOND)", f"('d', 0, 3.5, {at}, {at})", "('d', 0, 9.5, NULL, NULL)"]
    c = duckdb.connect()
    c.sql(f"copy (select run_id, step::bigint as step, val_loss, l::timestamptz as logged_at, r::timestamptz as received_at from (values {', '.join(rows)}) as t(run_id, step, val_loss, l, r)) to '{tmp_path}/run_steps.parquet' (format parquet)")
    c.sql(f"create view run_steps as select * from '{tmp_path}/run_steps.parquet'")
    got = registry.queries()["stream_last_readings"](spark, str(tmp_path)).collect()
    want = c.sql(registry.oracle_sql()["stream_last_readings"]).fetchall()
    assert len(got) == 31 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_queries_agree_with_sql(spark, small):
    """A sample of the registered queries on the smallest tables, by row count and column names."""
    import os
    from pathlib import Path

    from textloom.plans import registry

    if not os.path.isdir(small):
        pytest.skip("no fixtures here")
    c = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    q, sql = registry.queries(), registry.oracle_sql()
    for name in ("quality_verdict", "manifest_last_wins", "slice_summary", "mix_weights", "seed_band", "case_reward", "contamination_hits"):
        df, r = q[name](spark, small), c.sql(sql[name])
        assert sorted(df.columns) == sorted(r.columns) and df.count() == len(r.fetchall()), name


def test_entry_has_rows(spark, small):
    import os

    import __spark_entry__ as e

    if not os.path.isdir(small):
        pytest.skip("no fixtures here")
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
