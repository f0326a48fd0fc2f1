"""Mixing sources to target weights along a time-varying curriculum.

Each source has a demand of tokens, its target share of the total. The total
is the largest that no source exceeds its capped repetitions for (or a given
one; then sources may fall short, and the report says so). Documents are drawn
whole epoch by whole epoch, and once more in hashed order until the demand is
met.

The order: a source's weight at progress t follows the schedule of the slices
its tokens are in, w(t) = (1 - r) B(t) / mean B + r R(t) / mean R with r the
register share of the source, so that each integrates to its target whatever
the schedule. A draw in the middle of which the source has spent the share u
of its demand is put where the integral of w reaches u (inverted in closed
form, for w is piecewise linear), and all draws are range-sorted by position.

Defined results: sources without a target, or with a target of null or 0, give
nothing; targets without documents are reported with 0; null and empty texts
have 0 tokens and are not drawn; repeated rows are documents of their own;
empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.packing import token_counts
from textloom.operators.prefix import running_sum
from textloom.scratch import written

REGISTER = "register"


def invert(u: np.ndarray, r: np.ndarray, frames: list[tuple[float, float, float]]) -> np.ndarray:
    """Progress at which a source with register share r has spent the share u of its demand.

    ``frames``: (progress, weight of other slices, weight of register), ascending;
    held constant before the first and after the last.
    """
    p = np.array([f[0] for f in frames], float)
    w = np.array([f[1:] for f in frames], float)
    if p[0] > 0:
        p, w = np.r_[0.0, p], np.vstack([w[:1], w])
    if p[-1] < 1:
        p, w = np.r_[p, 1.0], np.vstack([w, w[-1:]])
    d = np.diff(p)
    mean = ((w[1:] + w[:-1]) / 2 * d[:, None]).sum(0)
    w = np.where(mean > 0, w / np.where(mean > 0, mean, 1), 1.0)
    f = (1 - r)[:, None] * w[:, 0] + r[:, None] * w[:, 1]
    area = np.c_[np.zeros(len(u)), np.cumsum((f[:, 1:] + f[:, :-1]) / 2 * d, axis=1)]
    u = np.clip(u, 0.0, 1.0) * area[:, -1]
    k = np.clip((area[:, 1:] < u[:, None]).sum(1), 0, len(d) - 1)
    i = np.arange(len(u))
    f0, slope, rest = f[i, k], (f[i, k + 1] - f[i, k]) / d[k], u - area[i, k]
    root = np.sqrt(np.maximum(f0 * f0 + 2 * slope * rest, 0.0))
    return np.clip(p[k] + np.where(rest > 0, 2 * rest / np.maximum(f0 + root, 1e-12), 0.0), 0.0, 1.0)


def _frames(schedule: DataFrame, name: str) -> list[tuple[float, float, float]]:
    """The keyframes of a schedule: a small fixed table."""
    rows = schedule.where((F.col("schedule_name") == name) & F.col("weight").isNotNull()).groupBy("progress").agg(
        F.sum(F.when(F.col("slice") != REGISTER, F.col("weight"))).alias("b"), F.sum(F.when(F.col("slice") == REGISTER, F.col("weight"))).alias("r")
    )
    got = sorted((float(x["progress"]), float(x["b"] or 0), float(x["r"] or 0)) for x in rows.collect())
    return got or [(0.0, 1.0, 1.0)]


def _order(col: str) -> Column:
    return F.xxhash64(F.lit(1930), F.col(col))


def source_demands(counted: DataFrame, targets: DataFrame, total_tokens: float | None) -> DataFrame:
    """``(source, target_share, max_repeats, available, register_share, demand)``, a row per target."""
    have = counted.groupBy("source").agg(
        F.sum("n_tokens").alias("available"), F.sum(F.when(F.col("slice") == REGISTER, F.col("n_tokens")).otherwise(0)).alias("reg")
    )
    t = targets.select("source", "target_share", "max_repeats").where("target_share > 0 and source is not null").distinct().join(have, "source", "left")
    t = t.select("source", "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("reg", F.lit(0)).alias("reg"))
    most = F.lit(float(total_tokens)) if total_tokens is not None else F.min(F.when(F.col("available") > 0, F.col("max_repeats") * F.col("available") / F.col("target_share")))
    total = t.agg(most.alias("total"))
    return t.join(F.broadcast(total), F.lit(True)).select(
        "source",
        "target_share",
        "max_repeats",
        "available",
        F.when(F.col("available") > 0, F.col("reg") / F.col("available")).otherwise(0.0).alias("register_share"),
        F.coalesce(F.least(F.col("target_share") * F.col("total"), (F.col("max_repeats") * F.col("available")).cast("double")), F.lit(0.0)).alias("demand"),
    )


def draws(
    documents: DataFrame, targets: DataFrame, schedule: DataFrame, name: str = "ramp", vocabulary: str | None = None, total_tokens: float | None = None, per_task: int = 200_000
) -> DataFrame:
    """``(doc_id, source, draw_no, n_tokens, progress, token_offset)``, sorted by position.

    ``draw_no`` counts a document's draws from 0; ``progress`` is the position
    in [0, 1]; ``token_offset`` the tokens of all earlier draws.
    """
    named = documents.where("source is not null")
    counted = written(token_counts(named, vocabulary, keep=("source", "slice")).where("n_tokens > 0"), "mix-tokens")
    demand = written(source_demands(counted, targets, total_tokens), "mix-demand")  # a row per target
    frames = _frames(schedule, name)
    ours = counted.join(F.broadcast(demand.select("source")), "source", "left_semi").withColumn("h", _order("doc_id"))
    before = running_sum(ours, ["source"], ["h", "doc_id"], "n_tokens", "before", per_task, "mix-prefix")
    d = before.join(F.broadcast(demand), "source")
    epochs = F.floor(F.col("demand") / F.col("available"))
    rest = F.col("demand") - epochs * F.col("available")
    once_more = (F.col("before") + F.col("n_tokens") / 2 <= rest) & (epochs < F.col("max_repeats"))
    times = (epochs + once_more.cast("int")).cast("int")
    drawn = d.withColumn("times", times).where("times > 0").withColumn("draw_no", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    spent = (F.col("draw_no") * F.col("available") + F.col("before") + F.col("n_tokens") / 2) / F.col("demand")

    @F.pandas_udf("double")
    def position(u: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(invert(u.to_numpy(float), r.to_numpy(float), frames))

    placed = drawn.select("doc_id", "source", "draw_no", "n_tokens", position(spent, "register_share").alias("progress"))
    return running_sum(placed, [], ["progress", "doc_id", "draw_no"], "n_tokens", "token_offset", per_task, "mix-order")


def reached_shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, documents, draws, tokens, share, most_repeats)``, a row per target."""
    per = drawn.groupBy("source", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("t"))
    got = per.groupBy("source").agg(F.count("*").alias("documents"), F.sum("k").alias("draws"), F.sum("t").alias("tokens"), F.max("k").alias("most_repeats"))
    total = got.agg(F.sum("tokens").alias("all_tokens"))
    zero = F.lit(0)
    return (
        targets.select("source", "target_share", "max_repeats")
        .join(got, "source", "left")
        .join(F.broadcast(total), F.lit(True))
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce("documents", zero).alias("documents"),
            F.coalesce("draws", zero).alias("draws"),
            F.coalesce("tokens", zero).alias("tokens"),
            F.coalesce(F.round(F.col("tokens") / F.col("all_tokens"), 6), F.lit(0.0)).alias("share"),
            F.coalesce("most_repeats", zero).alias("most_repeats"),
        )
    )


def slice_progress(drawn: DataFrame, documents: DataFrame, steps: int = 10) -> DataFrame:
    """``(step, tokens, register_share)``: how the slices run over the course of the draws."""
    s = documents.select("doc_id", "slice").distinct()
    at = F.least(F.floor(F.col("progress") * steps), F.lit(steps - 1)).cast("int").alias("step")
    return drawn.join(s, "doc_id").groupBy(at).agg(F.sum("n_tokens").alias("tokens"), F.round(F.sum(F.when(F.col("slice") == REGISTER, F.col("n_tokens")).otherwise(0)) / F.sum("n_tokens"), 6).alias("register_share"))
