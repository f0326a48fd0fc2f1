"""Run logs: curves, seed bands, restarts, log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The forms of log lines.
VAL_LINE = r"^step:(\d+)/(\d+)\s+val_loss:([0-9.]+|nan)"
SEED_LINE = r"^init_seed=(\d+)"
MIX_LINE = r"^\[mix\] spec=(\S+)"
RESUMED_LINE = r"^Resumed from "


def curve(steps: DataFrame) -> DataFrame:
    """The last finite reading of each (run, step); NaN, null and keyless readings are dropped."""
    ok = steps.where(F.col("val_loss").isNotNull() & ~F.isnan("val_loss") & F.col("run_id").isNotNull() & F.col("step").isNotNull())
    w = Window.partitionBy("run_id", "step").orderBy(F.desc("logged_at"), F.desc("received_at"), F.desc("val_loss"))
    return ok.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def final_loss(curves: DataFrame) -> DataFrame:
    """The reading of each run's last step."""
    last = curves.groupBy("run_id").agg(F.max("step").alias("step"))
    return curves.join(last, ["run_id", "step"])


def seed_runs(curves: DataFrame) -> DataFrame:
    """``(mix, seed, run_id, last_step)``: of the runs of a seed the longest, the first of equals."""
    m = curves.groupBy("run_id").agg(F.max("step").alias("last_step"), F.min("init_seed").alias("seed"), F.max("mix_spec").alias("mix")).where("seed is not null")
    w = Window.partitionBy(F.coalesce("mix", F.lit("")), "seed").orderBy(F.desc("last_step"), "run_id")
    return m.withColumn("k", F.row_number().over(w)).where("k = 1").select(F.coalesce("mix", F.lit("")).alias("mix"), "seed", "run_id", "last_step")


def seed_band(curves: DataFrame) -> DataFrame:
    """``(mix, step, seeds, mean, low, high, sd)`` at the steps that all seeds of a mix have, two seeds at least."""
    s = seed_runs(curves).select("mix", "run_id")
    n = s.groupBy("mix").agg(F.count("*").alias("seeds")).where("seeds >= 2")
    c = curves.join(s, "run_id").groupBy("mix", "step").agg(F.count("*").alias("k"), F.avg("val_loss").alias("mean"), F.min("val_loss").alias("low"), F.max("val_loss").alias("high"), F.stddev_samp("val_loss").alias("sd"))
    return c.join(n, "mix").where("k = seeds").drop("k")


def sessions(steps: DataFrame) -> DataFrame:
    """``(run_id, step, logged_at, part)``: a new part begins where the step doesn't rise."""
    o = steps.select("run_id", "step", "logged_at").where("step is not null and logged_at is not null").distinct()
    w = Window.partitionBy("run_id").orderBy("logged_at", "step")
    p = o.withColumn("prev", F.lag("step").over(w))
    return p.withColumn("part", F.sum(F.when(F.col("prev").isNull() | (F.col("step") <= F.col("prev")), 1).otherwise(0)).over(w)).drop("prev")


def log_lines(curves: DataFrame) -> DataFrame:
    """``(run_id, value)``: readings as log lines."""
    return curves.select("run_id", F.format_string("step:%d/1000 val_loss:%.4f train_time:0s", "step", "val_loss").alias("value"))


def parse_log(lines: DataFrame) -> DataFrame:
    """``(run_id, step, val_loss_text)`` of the validation lines; other lines and nan are passed over."""
    m = lines.where(F.col("value").rlike(VAL_LINE))
    out = m.select("run_id", F.regexp_extract("value", VAL_LINE, 1).cast("bigint").alias("step"), F.regexp_extract("value", VAL_LINE, 3).alias("val_loss_text"))
    return out.where("val_loss_text <> 'nan'")


def scan_logs(lines: DataFrame, train_steps: int | None = None) -> DataFrame:
    """``(train_steps, seed, run_id, last_step, final_loss)`` of the replicates among logs (run_id, value: a line each).

    A log counts if it has a seed, is of no mixture, wasn't resumed and has a
    finite reading; of the logs of a seed and length the most complete counts,
    the first of equals. ``value`` is split into what each line tells, so no log
    is gathered.
    """
    at = lambda k: F.regexp_extract("value", VAL_LINE, k)
    val = F.col("value").rlike(VAL_LINE)
    seen = lines.groupBy("run_id").agg(
        F.min(F.when(F.col("value").rlike(SEED_LINE), F.regexp_extract("value", SEED_LINE, 1).cast("bigint"))).alias("seed"),
        F.max(F.col("value").rlike(MIX_LINE)).alias("mixed"),
        F.max(F.col("value").rlike(RESUMED_LINE)).alias("resumed"),
        F.max(F.when(val, at(2).cast("bigint"))).alias("train_steps"),
        F.max(F.when(val & (at(3) != "nan"), F.struct(at(1).cast("bigint").alias("step"), at(3).cast("double").alias("loss")))).alias("last"),
    )
    ok = seen.where("seed is not null and not mixed and not resumed and last is not null")
    if train_steps is not None:
        ok = ok.where(F.col("train_steps") == train_steps)
    w = Window.partitionBy("train_steps", "seed").orderBy(F.desc("last.step"), "run_id")
    return ok.withColumn("k", F.row_number().over(w)).where("k = 1").select("train_steps", "seed", "run_id", F.col("last.step").alias("last_step"), F.col("last.loss").alias("final_loss"))


def logs_over_registry(logs: DataFrame, registry: DataFrame) -> DataFrame:
    """Both, of the form of :func:`scan_logs`; where they tell of one seed and length, the logs win."""
    missing = registry.join(logs.select("train_steps", "seed"), ["train_steps", "seed"], "left_anti")
    return logs.withColumn("origin", F.lit("log")).unionByName(missing.select(*logs.columns).withColumn("origin", F.lit("registry")))
