"""JSON ends: append-only JSONL, run records with their index, shard manifests.

Writers append files to a folder, so that nothing written is touched again and
a failed job leaves no half line. Values that JSON has no form for (NaN and the
infinities) become null, with a flag ``<column>_nonfinite`` beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_safe(df: DataFrame) -> DataFrame:
    """The columns, each float or double one finite or null, and a flag beside it where it wasn't finite (else null)."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("float", "double"):
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            out += [F.when(~bad, c).alias(name), F.when(bad, F.lit(True)).alias(f"{name}_nonfinite")]
        else:
            out.append(c.alias(name))
    return df.select(*out)


def append_jsonl(df: DataFrame, folder: str) -> None:
    """Append ``df`` to a folder of JSONL files; nulls but those of flags are written out."""
    safe = json_safe(df)
    flags = [c for c in safe.columns if c not in df.columns]
    text = lambda names, nulls: F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": nulls})
    if not flags:
        safe.select(text(df.columns, "false").alias("value")).write.mode("append").text(folder)
        return
    both = safe.select(text(df.columns, "false").alias("p"), text(flags, "true").alias("f"))
    joined = F.when(F.col("f") == "{}", F.col("p")).otherwise(F.expr("left(p, length(p) - 1) || ',' || substring(f, 2)"))
    both.select(joined.alias("value")).write.mode("append").text(folder)


def write_run_records(runs: DataFrame, folder: str) -> None:
    """Each run's own record first (``records/run_id=...``), then the common index; the index can be rebuilt from the records.

    ``runs``: run_id (one row each) and what is told of it.
    """
    json_safe(runs).write.mode("append").partitionBy("run_id").option("ignoreNullFields", "false").json(f"{folder}/records")
    append_jsonl(runs, f"{folder}/index")


def read_run_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The records, with the index for runs that have none; a missing index counts as empty."""
    own = spark.read.schema(schema).json(f"{folder}/records")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/index")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return own
    index = spark.read.schema(schema).json(f"{folder}/index")
    return own.unionByName(index.join(own.select("run_id"), "run_id", "left_anti"))


def write_shard_manifest(shards: DataFrame, folder: str, **facts: str | int) -> None:
    """One JSON document: shards by split and by slice, totals and ``facts``.

    ``shards``: split, slice (null: of no slice), name, n_tokens. Shards are
    listed by name; their number is the corpus over a fixed shard size.
    """
    one = F.struct(F.col("name").alias("shard_name"), F.col("n_tokens").alias("num_tokens"))
    split = shards.where("slice is null").groupBy("split").agg(F.array_sort(F.collect_list(one)).alias("l"), F.sum("n_tokens").alias("t"))
    slices = shards.where("slice is not null").groupBy("slice").agg(F.array_sort(F.collect_list(one)).alias("l"), F.sum("n_tokens").alias("t"))
    pairs = lambda k, v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v))))
    a = split.agg(pairs("split", "l").alias("shards"), pairs("split", "t").alias("total_tokens"))
    b = slices.agg(pairs("slice", "l").alias("slice_shards"), pairs("slice", "t").alias("slice_pool_tokens"))
    whole = a.crossJoin(b).select(*[F.lit(v).alias(k) for k, v in facts.items()], "*")  # a row each
    whole.select(F.to_json(F.struct(*whole.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(folder)


SHARD_LIST = "array<struct<shard_name string, num_tokens bigint>>"
SHARD_MANIFEST = f"shards map<string, {SHARD_LIST}>, total_tokens map<string, bigint>, slice_shards map<string, {SHARD_LIST}>, slice_pool_tokens map<string, bigint>, tokenizer string, vocab_size int, eot_token int"


def load_slice_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``(slice, shard_name, num_tokens, pool_tokens)`` of a shard manifest; ValueError if it has no section of slices."""
    m = spark.read.schema(SHARD_MANIFEST).option("mode", "FAILFAST").json(folder)
    if m.where("slice_shards is null").limit(1).count():
        raise ValueError(f"{folder}: no section slice_shards")
    s = m.select(F.explode("slice_shards").alias("slice", "l"), "slice_pool_tokens")
    return s.select("slice", F.explode("l").alias("x"), F.element_at("slice_pool_tokens", F.col("slice")).alias("pool_tokens")).select("slice", "x.shard_name", "x.num_tokens", "pool_tokens")


def check_manifest(spark: SparkSession, folder: str, **wanted: str | int) -> None:
    """ValueError if the manifest says otherwise than ``wanted`` (tokenizer, vocab_size, eot_token); the shards win."""
    m = spark.read.schema(SHARD_MANIFEST).option("mode", "FAILFAST").json(folder).first()
    bad = [f"{k}: {v!r} is wanted, the shards have {m[k]!r}" for k, v in wanted.items() if m[k] != v]
    if bad:
        raise ValueError("; ".join(bad))
