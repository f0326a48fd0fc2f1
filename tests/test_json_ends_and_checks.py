import math

import pytest
from pyspark.sql import functions as F

from textloom.operators import cases as C
from textloom.operators import dedup as D
from textloom.operators import mixing as X
from textloom.operators import runs as R
from textloom.sources import jsonl as J
from textloom.sources import shards as S
from textloom.tables import spread


def test_append_guards_what_json_cannot_hold(spark, tmp_path):
    at = str(tmp_path / "j")
    df = spark.createDataFrame([(1, math.nan, None, "a\"b"), (2, math.inf, 1.5, None), (3, 0.5, 2.0, "é\n")], "k int, x double, y float, s string")
    J.append_jsonl(df, at)
    J.append_jsonl(df.where("k = 3"), at)
    J.append_jsonl(df.limit(0), at)
    lines = sorted(r["value"] for r in spark.read.text(at).collect())
    assert lines[0] == '{"k":1,"x":null,"y":null,"s":"a\\"b","x_nonfinite":true}' and len(lines) == 4
    back = spark.read.schema("k int, x double, x_nonfinite boolean, y_nonfinite boolean, s string").json(at)
    assert {(r["k"], r["x"], r["x_nonfinite"], r["y_nonfinite"]) for r in back.collect()} == {(1, None, True, None), (2, None, True, None), (3, 0.5, None, None)}


def test_run_records_stand_without_an_index(spark, tmp_path):
    at, kind = str(tmp_path / "r"), "run_id string, loss double"
    J.write_run_records(spark.createDataFrame([("a", 1.0), ("b", math.nan)], kind), at)
    assert {tuple(r) for r in J.read_run_records(spark, at, kind).select("run_id", "loss").collect()} == {("a", 1.0), ("b", None)}
    J.append_jsonl(spark.createDataFrame([("a", 9.0), ("c", 3.0)], kind), f"{at}/index")
    got = [tuple(r) for r in J.read_run_records(spark, at, kind).select("run_id", "loss").collect()]
    assert sorted(got, key=str) == [("a", 1.0), ("b", None), ("c", 3.0)]


def test_shard_manifest(spark, tmp_path):
    at = str(tmp_path / "m")
    rows = [("train", None, "t0", 10), ("val", None, "v0", 5), ("train", "a", "a0", 7), ("train", "a", "a1", 3), ("train", "b", "b0", 2)]
    df = spark.createDataFrame(rows, "split string, slice string, name string, n_tokens bigint")
    J.write_shard_manifest(df, at, tokenizer="x", vocab_size=10, eot_token=1)
    assert {tuple(r) for r in J.load_slice_manifest(spark, at).collect()} == {("a", "a0", 7, 10), ("a", "a1", 3, 10), ("b", "b0", 2, 2)}
    J.check_manifest(spark, at, tokenizer="x", eot_token=1)
    with pytest.raises(ValueError, match="vocab_size"):
        J.check_manifest(spark, at, vocab_size=11)
    (tmp_path / "old.json").write_text('{"shards": {}}')
    with pytest.raises(ValueError, match="slice_shards"):
        J.load_slice_manifest(spark, str(tmp_path / "old.json"))


def test_inspection_tells_what_is_wrong(spark, tmp_path):
    good = S.header(5) + b"".join(x.to_bytes(2, "little") for x in (50256, 1, 2, 50256, 3))
    (tmp_path / "a.bin").write_bytes(good)
    (tmp_path / "b.bin").write_bytes(good[:-3])
    (tmp_path / "c.bin").write_bytes(b"xy")
    (tmp_path / "d.bin").write_bytes(b"\1" * 1030)
    got = {r["name"]: r for r in S.inspect_shards(spark, str(tmp_path)).collect()}
    assert got["a.bin"]["document_starts"] == 2 and got["a.bin"]["problem"] is None and got["a.bin"]["n_tokens"] == 5
    assert all(got[k]["problem"] for k in ("b.bin", "c.bin", "d.bin")) and got["c.bin"]["magic"] is None
    found = S.inspect_shards(spark, str(tmp_path)).where("name < 'c'")
    listed = spark.createDataFrame([("a.bin", 6), ("z.bin", 1)], "name string, n_tokens bigint")
    assert {tuple(r) for r in S.compared(found, listed).collect()} == {("a.bin", True, True, True), ("b.bin", False, True, False), ("z.bin", True, False, False)}


def test_logs_leave_out_mixed_and_resumed(spark):
    logs = {
        "a": ["init_seed=1", "step:10/20 val_loss:3.5", "step:20/20 val_loss:3.25"],
        "b": ["init_seed=1", "step:10/20 val_loss:3.0", "step:20/20 val_loss:nan"],
        "mix": ["init_seed=2", "[mix] spec=flat slices=[]", "step:20/20 val_loss:3"],
        "res": ["init_seed=3", "Resumed from x", "step:20/20 val_loss:3"],
        "old": ["step:20/20 val_loss:3"],
        "nan": ["init_seed=4", "step:20/20 val_loss:nan"],
        "long": ["init_seed=1", "step:40/40 val_loss:2.5"],
    }
    df = spark.createDataFrame([(k, v) for k, vs in logs.items() for v in vs], "run_id string, value string")
    assert {tuple(r) for r in R.scan_logs(df).collect()} == {(20, 1, "a", 20, 3.25), (40, 1, "long", 40, 2.5)}
    assert {tuple(r) for r in R.scan_logs(df, 40).collect()} == {(40, 1, "long", 40, 2.5)}
    reg = spark.createDataFrame([(20, 1, "z", 20, 9.0), (20, 7, "y", 20, 8.0)], "train_steps bigint, seed bigint, run_id string, last_step bigint, final_loss double")
    assert {(r["run_id"], r["origin"]) for r in R.logs_over_registry(R.scan_logs(df, 20), reg).collect()} == {("a", "log"), ("y", "registry")}
    assert R.scan_logs(df.limit(0)).count() == 0


def test_clean_items_pass_the_guard(spark):
    c = spark.createDataFrame([(1, "one two three four five")], "doc_id int, text string")
    D.assert_clean(spark.createDataFrame([("a", "one two four")], "id string, text string"), c, 3)
    with pytest.raises(RuntimeError, match="item 'b' at 1 in document 1 at 1"):
        D.assert_clean(spark.createDataFrame([("b", "x two three four")], "id string, text string"), c, 3)


def test_strided_and_skipped(spark):
    z = spark.createDataFrame([(0, 17), (1, 16), (2, 25)], "shard bigint, n_tokens bigint")
    got = [(r["shard"], r["batch"], r["rank"], r["pos"]) for r in X.strided_batches(z, 2, 4).orderBy("shard", "batch", "rank").collect()]
    assert got == [(0, 0, 0, 0), (0, 0, 1, 4), (0, 1, 0, 8), (0, 1, 1, 12), (1, 0, 0, 0), (1, 0, 1, 4)] + [(2, b, r, (2 * b + r) * 4) for b in range(3) for r in range(2)]
    pool = spark.createDataFrame([("a", 0, 5), ("a", 1, 3)], "slice string, shard bigint, n_tokens bigint")
    skips = spark.createDataFrame([(k,) for k in (0, 5, 6, 8, 9)], "skipped bigint")
    assert {(r["skipped"], r["epoch"], r["shard"], r["pos"]) for r in X.pool_skip(pool, skips).collect()} == {(0, 0, 0, 0), (5, 0, 0, 5), (6, 0, 1, 1), (8, 0, 1, 3), (9, 1, 0, 1)}


def test_choice_tasks(spark):
    t = spark.createDataFrame([("a", 0, 3, [2, 1, 1, 1]), ("b", 1, 1, [1, 1, 1, 1]), ("c", 2, 2, [2, 2, 2, 2])], "item string, at bigint, ctx int, ends array<int>")
    got = {r["item"]: (r["rank"], r["sequence"], r["offset"], r["tokens"], r["first_span_start"], r["first_span_end"]) for r in X.pack_choices(t, 2, 34).collect()}
    # Four endings of a: 4 + 3 + 3 + 3 tokens and three separators.
    assert got == {"a": (0, 0, 0, 16, 2, 4), "b": (1, 0, 0, 7, 0, 1), "c": (0, 0, 16, 16, 18, 20)}
    assert X.pack_choices(t, 2, 20).where("item = 'c'").first()["sequence"] == 1 and X.pack_choices(t.limit(0), 2, 9).count() == 0


def test_few_partitions_are_spread(spark):
    one, many = spark.range(10).coalesce(1), spark.range(10).repartition(16)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(many) is many
    assert spread(one).agg(F.sum("id")).first()[0] == 45 and C.sample_cases(spark.createDataFrame([], "book bigint, doc_id bigint, part int, passage string"), 3).count() == 0
