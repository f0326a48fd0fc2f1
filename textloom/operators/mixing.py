"""Mixture schedules: weights by step, integer allocation with carry, cursors, interleaving."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The named schedules, as (progress, slice, weight).
PRESETS = {
    "corpus": [(0.0, "backbone", 0.913), (0.0, "register", 0.087)],
    "cooldown-ramp": [
        (0.0, "backbone", 0.913), (0.0, "register", 0.087), (0.7, "backbone", 0.913), (0.7, "register", 0.087), (1.0, "backbone", 0.75), (1.0, "register", 0.25),
    ],
    "mix-a": [(0.0, "backbone", 0.80), (0.0, "register", 0.20)],
    "mix-b": [(0.0, "backbone", 0.60), (0.0, "register", 0.40)],
    "mix-c": [(0.0, "backbone", 0.40), (0.0, "register", 0.60)],
}


def parse_schedule(spark: SparkSession, spec: str) -> DataFrame:
    """``(progress, slice, weight)`` of a preset name, a JSON object of constant weights, or a JSON array of keyframes.

    Raises ValueError if the spec is none of them or breaks a rule of :func:`violations`.
    """
    if spec in PRESETS:
        rows = PRESETS[spec]
    else:
        try:
            got = json.loads(spec)
        except ValueError as e:
            raise ValueError(f"neither a preset nor JSON: {spec!r}") from e
        frames = [(0.0, got)] if isinstance(got, dict) else got
        if not isinstance(frames, list) or not all(isinstance(f, (list, tuple)) and len(f) == 2 and isinstance(f[1], dict) for f in frames):
            raise ValueError(f"not a schedule: {spec!r}")
        rows = [(float(p), str(n), float(w)) for p, ws in frames for n, w in ws.items()]
    df = spark.createDataFrame(rows, "progress double, slice string, weight double") if rows else spark.createDataFrame([], "progress double, slice string, weight double")
    bad = violations(df.withColumn("schedule_name", F.lit(spec))).where("n > 0").collect()  # one row per rule
    if bad or not rows:
        raise ValueError(f"invalid schedule {spec!r}: {[r['rule'] for r in bad] or 'empty'}")
    return df


def violations(schedule: DataFrame) -> DataFrame:
    """``(schedule_name, rule, n)``: how often each rule of schedules is broken."""
    per = schedule.groupBy("schedule_name", "progress").agg(F.sum("weight").alias("total"), F.countDistinct("slice").alias("slices"), F.count("*").alias("rows"))
    all_ = schedule.groupBy("schedule_name").agg(F.countDistinct("slice").alias("wanted"))
    rows = schedule.groupBy("schedule_name").agg(
        F.count(F.when(F.col("weight") < 0, 1)).alias("negative_weight"), F.count(F.when((F.col("progress") < 0) | (F.col("progress") > 1), 1)).alias("progress_range")
    )
    frames = per.join(all_, "schedule_name").groupBy("schedule_name").agg(
        F.count(F.when(F.col("total") <= 0, 1)).alias("zero_total"),
        F.count(F.when(F.col("slices") < F.col("wanted"), 1)).alias("missing_slice"),
        F.count(F.when(F.col("rows") > F.col("slices"), 1)).alias("repeated_slice"),
    )
    names = ["negative_weight", "progress_range", "zero_total", "missing_slice", "repeated_slice"]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in names])).alias("x")
    return rows.join(frames, "schedule_name").select("schedule_name", pairs).select("schedule_name", "x.rule", "x.n")


def weights_at(schedule: DataFrame, steps: DataFrame) -> DataFrame:
    """``(schedule_name, step, slice, weight)`` for ``steps`` (step, progress).

    Linear between keyframes, held at the ends, normalised after interpolation.
    The keyframes are a small fixed table, sent to the tasks as intervals.
    """
    w = Window.partitionBy("schedule_name", "slice").orderBy("progress")
    iv = schedule.select(
        "schedule_name", "slice", F.col("progress").alias("p0"), F.col("weight").alias("w0"), F.lead("progress").over(w).alias("p1"), F.lead("weight").over(w).alias("w1"), F.row_number().over(w).alias("k")
    )
    low = (F.col("progress") >= F.col("p0")) | (F.col("k") == 1)
    high = F.col("p1").isNull() | (F.col("progress") < F.col("p1"))
    j = steps.join(F.broadcast(iv), low & high)
    t = F.greatest(F.lit(0.0), (F.col("progress") - F.col("p0")) / (F.col("p1") - F.col("p0")))
    raw = F.when(F.col("p1").isNull(), F.col("w0")).otherwise(F.col("w0") + (F.col("w1") - F.col("w0")) * t)
    x = j.select("schedule_name", "step", "slice", raw.alias("raw"))
    return x.select("schedule_name", "step", "slice", (F.col("raw") / F.sum("raw").over(Window.partitionBy("schedule_name", "step"))).alias("weight"))


def allocate(weights: list[float], names: list[str], n: int, carry: list[float]) -> tuple[list[int], list[float]]:
    """Whole counts that sum to n, and what is carried on: largest remainders first, ties by name.

    Where a slice owes more than the step can take back, the others give one
    each in turn, least remainder first, so that the counts still sum to n.
    """
    desired = [w * n + c for w, c in zip(weights, carry)]
    counts = [max(0, int(x // 1)) for x in desired]
    left = n - sum(counts)
    order = sorted(range(len(names)), key=lambda i: (-(desired[i] - counts[i]), names[i]))
    k = 0
    while left > 0:
        counts[order[k % len(order)]] += 1
        left, k = left - 1, k + 1
    order = sorted(range(len(names)), key=lambda i: (desired[i] - counts[i], names[i]))
    while left < 0:
        for i in order:
            if left < 0 and counts[i] > 0:
                counts[i] -= 1
                left += 1
    return counts, [d - c for d, c in zip(desired, counts)]


def allocation(weights: DataFrame, n: int) -> DataFrame:
    """``(schedule_name, step, slice, count, carry)``: the fold over the steps of each schedule.

    A schedule's steps are one group: their number is the length of a run, not
    the size of the corpus.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["slice"].unique())
        wide = pdf.pivot(index="step", columns="slice", values="weight").sort_index()[names]
        carry, rows = [0.0] * len(names), []
        for step, ws in zip(wide.index, wide.to_numpy().tolist()):
            counts, carry = allocate(ws, names, n, carry)
            rows += [(pdf["schedule_name"].iloc[0], int(step), s, c, r) for s, c, r in zip(names, counts, carry)]
        return pd.DataFrame(rows, columns=["schedule_name", "step", "slice", "count", "carry"])

    return weights.groupBy("schedule_name").applyInPandas(run, "schedule_name string, step bigint, slice string, count int, carry double")


def cursors(counts: DataFrame) -> DataFrame:
    """The counts with ``cursor_before``: the sequences of the slice taken by earlier steps."""
    w = Window.partitionBy("schedule_name", "slice").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("cursor_before", F.coalesce(F.sum("count").over(w), F.lit(0)))


def interleave(counts: DataFrame) -> DataFrame:
    """``(schedule_name, step, slot, slice, ordinal)``: low-discrepancy placement in closed form.

    The k-th pick of a slice with c of T places scores c - k (T - c); higher
    scores come first, ties by slice name.
    """
    t = Window.partitionBy("schedule_name", "step")
    x = counts.withColumn("total", F.sum("count").over(t)).where("count > 0").withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    score = F.col("count") - F.col("ordinal") * (F.col("total") - F.col("count"))
    slot = F.row_number().over(t.orderBy(score.desc(), "slice", "ordinal")) - 1
    return x.select("schedule_name", "step", slot.alias("slot"), "slice", "ordinal")


def pool_plan(counts: DataFrame, shards: DataFrame, seq: int, strict: bool = False) -> DataFrame:
    """``(schedule_name, slice, step, count, epoch, shard, pos)``: where each step reads its contiguous block.

    ``shards``: slice, shard, n_tokens. A block of n sequences needs n seq + 1
    tokens; if the shard has fewer left, reading goes on with the next shard,
    wrapping around. One fold per slice over the steps of a run, to which the
    slice's shards are sent once; a slice without shards has no plan. A block
    longer than every shard is an error if ``strict``, and has null positions
    otherwise.
    """

    def run(steps: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        files = files.sort_values("shard")
        names, lengths = files["shard"].tolist(), files["n_tokens"].astype("int64").tolist()
        return pd.DataFrame(
            [(slice_, name, *at) for (slice_, name), own in steps.groupby(["slice", "schedule_name"]) if names for at in follow(own, names, lengths)],
            columns=["slice", "schedule_name", "step", "count", "epoch", "shard", "pos"],
        )

    def follow(own: pd.DataFrame, names: list, lengths: list[int]) -> Iterator[tuple]:
        pos = shard = epoch = 0
        for step, n in sorted(zip(own["step"], own["count"])):
            need = int(n) * seq + 1
            if not n:
                continue
            if need > max(lengths):
                if strict:
                    raise ValueError(f"step {step}: a block of {need} tokens is longer than every shard of the slice")
                yield step, n, None, None, None
                continue
            while pos + need > lengths[shard]:
                shard, pos = shard + 1, 0
                if shard == len(lengths):
                    shard, epoch = 0, epoch + 1
            yield step, n, epoch, names[shard], pos
            pos += int(n) * seq

    plan = "slice string, schedule_name string, step bigint, count int, epoch bigint, shard bigint, pos bigint"
    grouped = counts.select("slice", "schedule_name", "step", "count").groupBy("slice")
    return grouped.cogroup(shards.select("slice", "shard", "n_tokens").groupBy("slice")).applyInPandas(run, plan).select("schedule_name", "slice", "step", "count", "epoch", "shard", "pos")


def pack_documents(docs: DataFrame, per_rank: int, max_len: int) -> DataFrame:
    """``(shard, rank, seq_no, start, stop)``: documents packed to ``per_rank`` + 1 tokens a rank.

    ``docs``: shard, start, stop (token offsets of whole documents). Each rank
    takes documents in order, cut at ``max_len`` and at its remaining room; the
    rest of a cut document is skipped; a batch that the shard's tail can't fill
    is left out. One fold per shard, whose size is fixed.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, rank, seq, room, rows = [], 0, 0, per_rank + 1, []
        for a, b in sorted(zip(pdf["start"], pdf["stop"])):
            take = min(b - a, max_len, room)
            rows.append((rank, seq, int(a), int(a + take)))
            room, seq = room - take, seq + 1
            if not room:
                out += rows
                rank, seq, room, rows = rank + 1, 0, per_rank + 1, []
        return pd.DataFrame(out, columns=["rank", "seq_no", "start", "stop"]).assign(shard=pdf["shard"].iloc[0])

    return docs.groupBy("shard").applyInPandas(run, "shard bigint, rank int, seq_no int, start bigint, stop bigint")


def pack_tasks(tasks: DataFrame, seq_len: int) -> DataFrame:
    """``(rank, item, sequence, offset)``: tasks of ``length`` tokens put into sequences in order of ``item``.

    A sequence is closed before a task that would bring it to ``seq_len`` or more.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, used, seq = [], 0, 0
        for item, n in sorted(zip(pdf["item"], pdf["length"])):
            if used and used + n >= seq_len:
                used, seq = 0, seq + 1
            rows.append((item, seq, used))
            used += n
        return pd.DataFrame(rows, columns=["item", "sequence", "offset"]).assign(rank=pdf["rank"].iloc[0])

    return tasks.groupBy("rank").applyInPandas(fold, "rank int, item string, sequence int, offset bigint")


def strided_batches(shards: DataFrame, ranks: int, row: int) -> DataFrame:
    """``(shard, batch, rank, pos)`` of a loader whose ranks read ``row`` tokens each, side by side.

    ``shards``: shard, n_tokens. A step needs ranks * row + 1 tokens; what is
    left of a shard then is passed over, and a shard shorter than a step gives
    nothing. A closed form, a row per shard before it is exploded.
    """
    step = ranks * row
    b = shards.where(F.col("n_tokens") >= step + 1).select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / step) - 1)).alias("batch"))
    r = b.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
    return r.select("shard", "batch", "rank", ((F.col("batch") * ranks + F.col("rank")) * row).alias("pos"))


def pool_skip(shards: DataFrame, skips: DataFrame) -> DataFrame:
    """``(slice, skipped, epoch, shard, pos)``: where each slice's pool stands after ``skipped`` tokens, without reading.

    ``shards``: slice, shard, n_tokens, none of them empty; ``skips``: a small
    table of ``skipped``. A position at a shard's end stays there until the next
    reading moves on.
    """
    w = Window.partitionBy("slice").orderBy("shard")
    c = shards.select("slice", "shard", "n_tokens", (F.sum("n_tokens").over(w) - F.col("n_tokens")).alias("before"), F.sum("n_tokens").over(Window.partitionBy("slice")).alias("total"))
    j = c.join(F.broadcast(skips), F.lit(True))
    none = F.col("skipped") == 0
    at = F.when(none, 0).otherwise(F.pmod(F.col("skipped") - 1, F.col("total")) + 1)
    epoch = F.when(none, 0).otherwise(F.floor((F.col("skipped") - 1) / F.col("total")))
    here = (F.col("at") <= F.col("before") + F.col("n_tokens")) & ((F.col("at") > F.col("before")) | ((F.col("at") == 0) & (F.col("before") == 0)))
    return j.withColumn("at", at).withColumn("epoch", epoch).where(here).select("slice", "skipped", "epoch", "shard", (F.col("at") - F.col("before")).alias("pos"))


def pack_choices(tasks: DataFrame, ranks: int, seq_len: int) -> DataFrame:
    """``(rank, sequence, item, offset, tokens, first_span_start, first_span_end)`` of tasks with one context and several endings.

    ``tasks``: item, at (its place), ctx, ends (lengths). Rank r takes every
    ``ranks``-th task; a task is each ending after its own copy of the context,
    shifted by one, with a separator before every one but a sequence's first;
    a sequence is closed before a task that would bring it to ``seq_len``. A
    span is where the targets of an ending lie. A rank's share of an evaluation
    set, whose size is fixed, is one group.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, used, seq = [], 0, 0
        for _, item, ctx, ends in sorted(zip(pdf["at"], pdf["item"], pdf["ctx"], pdf["ends"]), key=lambda x: x[0]):
            lengths = [int(e) for e in ends]
            if used and used + len(lengths) * ctx + sum(lengths) >= seq_len:
                used, seq = 0, seq + 1
            begin = used
            for k, n in enumerate(lengths):
                used += bool(used)
                if k == 0:
                    span = used + int(ctx) - 1
                used += int(ctx) + n - 1
            rows.append((seq, item, begin, used - begin, span, span + lengths[0]))
        out = pd.DataFrame(rows, columns=["sequence", "item", "offset", "tokens", "first_span_start", "first_span_end"])
        return out.assign(rank=pdf["rank"].iloc[0])

    t = tasks.withColumn("rank", F.pmod("at", F.lit(ranks)).cast("int"))
    return t.groupBy("rank").applyInPandas(fold, "rank int, sequence int, item string, offset bigint, tokens bigint, first_span_start bigint, first_span_end bigint")
