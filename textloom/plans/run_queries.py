"""Run logs, seed bands, significance and registry queries over run_steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import cases as C
from textloom.operators import runs as R
from textloom.plans.registry import query
from textloom.tables import table

CURVE = """
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY logged_at DESC, received_at DESC, val_loss DESC NULLS LAST) AS k FROM run_steps WHERE val_loss IS NOT NULL AND NOT isnan(val_loss) AND run_id IS NOT NULL AND step IS NOT NULL) WHERE k = 1),
m AS (SELECT run_id, max(step) AS last_step, min(init_seed) AS seed, max(mix_spec) AS mix FROM r GROUP BY run_id)
"""


def steps(s, d):
    return table(s, d, "run_steps")


@query(f"WITH {CURVE} SELECT run_id, step, round(val_loss, 6) AS val_loss FROM r")
def val_curve(s, d):
    return R.curve(steps(s, d)).select("run_id", "step", F.round("val_loss", 6).alias("val_loss"))


@query(f"WITH {CURVE}, g AS (SELECT *, row_number() OVER (PARTITION BY coalesce(mix, ''), seed ORDER BY last_step DESC, run_id) AS k FROM m WHERE seed IS NOT NULL) SELECT coalesce(mix, '') AS mix, seed, run_id, last_step FROM g WHERE k = 1")
def seed_runs(s, d):
    return R.seed_runs(R.curve(steps(s, d)))


BAND = f"""
WITH {CURVE}, g AS (SELECT *, row_number() OVER (PARTITION BY coalesce(mix, ''), seed ORDER BY last_step DESC, run_id) AS k FROM m WHERE seed IS NOT NULL), s AS (SELECT coalesce(mix, '') AS mix, run_id FROM g WHERE k = 1),
n AS (SELECT mix, count(*) AS seeds FROM s GROUP BY mix), c AS (SELECT s.mix, r.step, count(*) AS k, avg(val_loss) AS mean, min(val_loss) AS low, max(val_loss) AS high, stddev_samp(val_loss) AS sd FROM s JOIN r ON r.run_id = s.run_id GROUP BY 1, 2)
"""


@query(BAND + "SELECT c.mix, step, CAST(seeds AS BIGINT) AS seeds, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(high - low, 6) AS range, round(sd, 5) AS sd FROM c JOIN n ON n.mix = c.mix WHERE k = seeds AND seeds >= 2")
def seed_band(s, d):
    b = R.seed_band(R.curve(steps(s, d)))
    return b.select("mix", "step", "seeds", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], F.round(F.col("high") - F.col("low"), 6).alias("range"), F.round("sd", 5).alias("sd"))


@query(BAND + "SELECT c.mix, max(step) AS last_common_step FROM c JOIN n ON n.mix = c.mix WHERE k = seeds AND seeds >= 2 GROUP BY c.mix")
def seed_band_last(s, d):
    return R.seed_band(R.curve(steps(s, d))).groupBy("mix").agg(F.max("step").alias("last_common_step"))


@query(f"""WITH {CURVE}, n AS (SELECT coalesce(mix_spec, '') AS mix, step, count(*) AS n, avg(val_loss) AS mean FROM r GROUP BY 1, 2)
SELECT mix, step, n, round(mean, 6) AS mean, round((3.28 - mean) * sqrt(n), 5) AS sig, (3.28 - mean) * sqrt(n) >= 0.004 AS pass, CASE WHEN mean < 3.28 THEN CAST(ceil(power(0.004 / (3.28 - mean), 2)) AS BIGINT) END AS n_req FROM n""")
def claim_stats(s, d):
    """Significance of being under the target loss, by mix and step; no n_req where it isn't."""
    g = R.curve(steps(s, d)).groupBy(F.coalesce("mix_spec", F.lit("")).alias("mix"), "step").agg(F.count("*").alias("n"), F.avg("val_loss").alias("mean"))
    margin = 3.28 - F.col("mean")
    sig = margin * F.sqrt("n")
    return g.select("mix", "step", "n", F.round("mean", 6).alias("mean"), F.round(sig, 5).alias("sig"), (sig >= 0.004).alias("pass"), F.when(margin > 0, F.ceil((0.004 / margin) ** 2)).alias("n_req"))


@query(f"WITH {CURVE} SELECT r.run_id, step, round(val_loss, 6) AS val_loss FROM r JOIN m ON m.run_id = r.run_id AND r.step = m.last_step")
def submission_loss(s, d):
    return R.final_loss(R.curve(steps(s, d))).select("run_id", "step", F.round("val_loss", 6).alias("val_loss"))


def by_mix(s, d):
    f = R.final_loss(R.curve(steps(s, d)))
    return f.groupBy(F.coalesce("mix_spec", F.lit("")).alias("mix")).agg(F.count("*").alias("n"), F.avg("val_loss").alias("mean"), F.stddev_samp("val_loss").alias("sd"))


@query()
def significance(s, d):
    """One-sample t and z of the final losses against 3.28."""
    g = by_mix(s, d).where("n >= 2 and sd > 0")
    t, z = (F.col("mean") - 3.28) / (F.col("sd") / F.sqrt("n")), (F.col("mean") - 3.28) / (0.0013 / F.sqrt("n"))
    return g.select("mix", "n", "mean", "sd", t.alias("t"), z.alias("z")).withColumn("p_t", C.t_p(F.col("t"), (F.col("n") - 1).cast("double"))).withColumn("p_z", C.z_p(F.col("z")))


@query()
def welch(s, d):
    """Welch's test between each two mixes."""
    g = by_mix(s, d).where("n >= 2")
    a, b = g.select(*[F.col(c).alias(f"{c}_a") for c in g.columns]), g.select(*[F.col(c).alias(f"{c}_b") for c in g.columns])
    j = a.join(b, F.col("mix_a") < F.col("mix_b"))  # a handful of mixes
    va, vb = F.col("sd_a") ** 2 / F.col("n_a"), F.col("sd_b") ** 2 / F.col("n_b")
    w = j.select("mix_a", "mix_b", ((F.col("mean_a") - F.col("mean_b")) / F.sqrt(va + vb)).alias("t"), ((va + vb) ** 2 / (va**2 / (F.col("n_a") - 1) + vb**2 / (F.col("n_b") - 1))).alias("df"))
    return w.withColumn("p", C.t_p(F.col("t"), F.col("df")))


SUM = f"WITH {CURVE}, f AS (SELECT coalesce(mix_spec, '') AS mix, val_loss, step FROM r JOIN m ON m.run_id = r.run_id AND r.step = m.last_step)"


@query(SUM + " SELECT mix, count(*) AS n, round(avg(val_loss), 6) AS mean, round(coalesce(stddev_samp(val_loss), 0), 5) AS sd, round(avg(step), 4) AS mean_step FROM f GROUP BY mix")
def sweep_summary(s, d):
    f = R.final_loss(R.curve(steps(s, d)))
    return f.groupBy(F.coalesce("mix_spec", F.lit("")).alias("mix")).agg(F.count("*").alias("n"), F.round(F.avg("val_loss"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("val_loss"), F.lit(0.0)), 5).alias("sd"), F.round(F.avg("step"), 4).alias("mean_step"))


@query(SUM + """, g AS (SELECT mix, count(*) AS n, avg(val_loss) AS mean, avg(step) AS st FROM f GROUP BY mix)
SELECT a.mix AS mix_a, b.mix AS mix_b, round((b.mean - a.mean + (b.st - a.st) / 100 * 0.0045) / sqrt(1 / a.n + 1 / b.n), 6) AS sig FROM g a JOIN g b ON a.mix <> b.mix""")
def pairwise_significance(s, d):
    f = R.final_loss(R.curve(steps(s, d)))
    g = f.groupBy(F.coalesce("mix_spec", F.lit("")).alias("mix")).agg(F.count("*").alias("n"), F.avg("val_loss").alias("mean"), F.avg("step").alias("st"))
    a, b = g.select(*[F.col(c).alias(f"{c}_a") for c in g.columns]), g.select(*[F.col(c).alias(f"{c}_b") for c in g.columns])
    sig = (F.col("mean_b") - F.col("mean_a") + (F.col("st_b") - F.col("st_a")) / 100 * 0.0045) / F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b"))
    return a.join(b, F.col("mix_a") != F.col("mix_b")).select("mix_a", "mix_b", F.round(sig, 6).alias("sig"))


SPLIT = """
WITH o AS (SELECT *, lag(step) OVER w AS prev FROM (SELECT DISTINCT run_id, step, logged_at FROM run_steps WHERE step IS NOT NULL AND logged_at IS NOT NULL) WINDOW w AS (PARTITION BY run_id ORDER BY logged_at, step)),
p AS (SELECT *, sum(CASE WHEN prev IS NULL OR step <= prev THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY logged_at, step) AS part FROM o)
"""


@query(SPLIT + "SELECT run_id, CAST(part AS BIGINT) AS part, min(step) AS first_step, max(step) AS last_step, count(*) AS rows FROM p GROUP BY 1, 2")
def split_runs(s, d):
    """A run begins anew where its step doesn't rise."""
    return R.sessions(steps(s, d)).groupBy("run_id", "part").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count("*").alias("rows"))


@query(f"WITH {CURVE} SELECT step, count(*) AS runs, round(avg(val_loss), 6) AS mean FROM r GROUP BY step")
def average_curve(s, d):
    return R.curve(steps(s, d)).groupBy("step").agg(F.count("*").alias("runs"), F.round(F.avg("val_loss"), 6).alias("mean"))


@query(f"WITH {CURVE}, t AS (SELECT run_id, min(step) AS target FROM r WHERE val_loss <= 3.5 GROUP BY run_id) SELECT r.run_id, t.target, count(*) AS points, round(min(val_loss) - 0.01, 6) AS low, round(max(val_loss) + 0.01, 6) AS high FROM r JOIN t ON t.run_id = r.run_id AND r.step <= t.target GROUP BY 1, 2")
def curve_to_target(s, d):
    """The curve up to the first step at the target, with the bounds of its plot."""
    c = R.curve(steps(s, d))
    t = c.where("val_loss <= 3.5").groupBy("run_id").agg(F.min("step").alias("target"))
    return c.join(t, "run_id").where("step <= target").groupBy("run_id", "target").agg(F.count("*").alias("points"), F.round(F.min("val_loss") - 0.01, 6).alias("low"), F.round(F.max("val_loss") + 0.01, 6).alias("high"))


@query("""SELECT run_id, step, epoch_us(logged_at) AS logged_us FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY logged_at DESC, received_at DESC) AS k FROM run_steps) WHERE k = 1""")
def dedupe_trajectory(s, d):
    w = Window.partitionBy("run_id", "step").orderBy(F.desc("logged_at"), F.desc("received_at"))
    return steps(s, d).withColumn("k", F.row_number().over(w)).where("k = 1").select("run_id", "step", F.unix_micros("logged_at").alias("logged_us"))


@query("""WITH a AS (SELECT run_id, max(init_seed) AS seed, max(mix_spec) AS mix FROM run_steps GROUP BY 1), b AS (SELECT run_id, min(init_seed) AS seed, min(mix_spec) AS mix FROM run_steps WHERE step = 25 GROUP BY 1)
SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(b.seed, a.seed) AS seed, coalesce(b.mix, a.mix, '') AS mix FROM a FULL JOIN b ON a.run_id = b.run_id""")
def registry_rebuild(s, d):
    """The record a run wrote first wins over the index."""
    r = steps(s, d)
    a = r.groupBy("run_id").agg(F.max("init_seed").alias("sa"), F.max("mix_spec").alias("ma"))
    b = r.where("step = 25").groupBy("run_id").agg(F.min("init_seed").alias("sb"), F.min("mix_spec").alias("mb"))
    return a.join(b, "run_id", "full").select("run_id", F.coalesce("sb", "sa").alias("seed"), F.coalesce("mb", "ma", F.lit("")).alias("mix"))


@query("SELECT run_id, count(*) AS rows, max(step) AS last_step FROM run_steps WHERE step <= 500 GROUP BY run_id")
def trajectory_through(s, d):
    return steps(s, d).where("step <= 500").groupBy("run_id").agg(F.count("*").alias("rows"), F.max("step").alias("last_step"))


@query("""WITH p AS (SELECT run_id, 'ckpt_' || printf('%06d', step) || '.pt' AS path, logged_at FROM run_steps WHERE step % 125 = 0), q AS (SELECT *, CAST(regexp_extract(path, 'ckpt_(\\d+)\\.pt', 1) AS BIGINT) AS step FROM p)
SELECT run_id, path, step FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY logged_at DESC, step DESC, path DESC) AS k FROM q) WHERE k = 1""".replace("\\\\", "\\"))
def latest_checkpoint(s, d):
    p = steps(s, d).where("step % 125 = 0").select("run_id", F.format_string("ckpt_%06d.pt", "step").alias("path"), "logged_at")
    q = p.withColumn("step", F.regexp_extract("path", r"ckpt_(\d+)\.pt", 1).cast("bigint"))
    w = Window.partitionBy("run_id").orderBy(F.desc("logged_at"), F.desc("step"), F.desc("path"))
    return q.withColumn("k", F.row_number().over(w)).where("k = 1").select("run_id", "path", "step")


@query(f"WITH {CURVE} SELECT a.run_id AS run_a, b.run_id AS run_b, a.seed <> b.seed AS seed_differs, coalesce(a.mix, '') <> coalesce(b.mix, '') AS mix_differs FROM m a JOIN m b ON b.run_id = (SELECT min(run_id) FROM m) AND a.run_id <> b.run_id")
def metadata_diff(s, d):
    """Each run's metadata against the first run's."""
    m = R.curve(steps(s, d)).groupBy("run_id").agg(F.min("init_seed").alias("seed"), F.max("mix_spec").alias("mix"))
    b = m.orderBy("run_id").limit(1).select(F.col("run_id").alias("run_b"), F.col("seed").alias("sb"), F.coalesce("mix", F.lit("")).alias("mb"))
    j = m.join(F.broadcast(b), F.col("run_id") != F.col("run_b"))
    return j.select(F.col("run_id").alias("run_a"), "run_b", (F.col("seed") != F.col("sb")).alias("seed_differs"), (F.coalesce("mix", F.lit("")) != F.col("mb")).alias("mix_differs"))


@query("""SELECT run_id, step, CASE WHEN isnan(val_loss) OR isinf(val_loss) THEN NULL ELSE round(val_loss, 6) END AS val_loss, coalesce(isnan(val_loss) OR isinf(val_loss), FALSE) AS val_loss_nonfinite, sha256(run_id || ':' || CAST(coalesce(init_seed, -1) AS VARCHAR) || ':' || coalesce(mix_spec, '')) AS config_hash
FROM (SELECT DISTINCT run_id, step, init_seed, mix_spec, val_loss FROM run_steps)""")
def run_outcome(s, d):
    """Non-finite values as null with a flag, and an identity hash of the configuration."""
    r = steps(s, d).select("run_id", "step", "init_seed", "mix_spec", "val_loss").distinct()
    v = F.col("val_loss")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    key = F.sha2(F.concat_ws(":", "run_id", F.coalesce("init_seed", F.lit(-1)).cast("string"), F.coalesce("mix_spec", F.lit(""))), 256)
    return r.select("run_id", "step", F.when(~bad, F.round(v, 6)).alias("val_loss"), F.coalesce(bad, F.lit(False)).alias("val_loss_nonfinite"), key.alias("config_hash"))


@query(f"WITH {CURVE} SELECT run_id, step, val_loss_text FROM (SELECT run_id, step, printf('%.4f', val_loss) AS val_loss_text FROM r)")
def log_lines(s, d):
    """Curves written as log lines, and parsed again."""
    return R.parse_log(R.log_lines(R.curve(steps(s, d))))


@query("""WITH o AS (SELECT run_id, step, min(received_at) AS at FROM run_steps GROUP BY 1, 2) SELECT run_id, count(*) AS kept FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.run_id = a.run_id AND b.step > 500 AND b.at <= a.at) GROUP BY run_id""")
def log_through(s, d):
    """A log cut before its first block of a later step, in the order received."""
    o = steps(s, d).groupBy("run_id", "step").agg(F.min("received_at").alias("at"))
    cut = o.where("step > 500").groupBy("run_id").agg(F.min("at").alias("cut"))
    return o.join(cut, "run_id", "left").where("cut is null or at < cut").groupBy("run_id").agg(F.count("*").alias("kept"))


_SCAN = f"""WITH {CURVE}, q AS (SELECT run_id, max(part) AS parts FROM (SELECT run_id, sum(CASE WHEN prev IS NULL OR step <= prev THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY logged_at, step) AS part
 FROM (SELECT *, lag(step) OVER (PARTITION BY run_id ORDER BY logged_at, step) AS prev FROM (SELECT DISTINCT run_id, step, logged_at FROM run_steps WHERE step IS NOT NULL AND logged_at IS NOT NULL))) GROUP BY run_id),
f AS (SELECT m.run_id, m.seed, m.mix, m.last_step, r.val_loss FROM m JOIN r ON r.run_id = m.run_id AND r.step = m.last_step),
lg AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY seed ORDER BY last_step DESC, f.run_id) AS w FROM f JOIN q ON q.run_id = f.run_id WHERE seed IS NOT NULL AND mix IS NULL AND parts = 1) WHERE w = 1)"""


def rendered_logs(s, d):
    """Each run's log, line by line: seed, mixture, whether it was resumed, readings."""
    c = R.curve(steps(s, d))
    meta = c.groupBy("run_id").agg(F.min("init_seed").alias("seed"), F.max("mix_spec").alias("mix"))
    parts = R.sessions(steps(s, d)).groupBy("run_id").agg(F.max("part").alias("parts"))
    line = lambda df, v: df.select("run_id", v.alias("value"))
    return (
        line(meta.where("seed is not null"), F.format_string("init_seed=%d", "seed"))
        .union(line(meta.where("mix is not null"), F.format_string("[mix] spec=%s slices=[]", "mix")))
        .union(line(parts.where("parts > 1"), F.lit("Resumed from a checkpoint")))
        .union(R.log_lines(c))
    )


@query(_SCAN + " SELECT CAST(1000 AS BIGINT) AS train_steps, seed, run_id, last_step, round(val_loss, 4) AS final_loss FROM lg")
def seed_scan(s, d):
    """Replicates found in the logs alone: of no mixture and not resumed."""
    return R.scan_logs(rendered_logs(s, d)).withColumn("final_loss", F.round("final_loss", 4))


@query(_SCAN + """, rg AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY seed ORDER BY last_step DESC, run_id) AS w FROM f WHERE seed IS NOT NULL) WHERE w = 1)
SELECT seed, run_id, 'log' AS origin FROM lg UNION ALL SELECT seed, run_id, 'registry' FROM rg WHERE seed NOT IN (SELECT seed FROM lg)""")
def seed_merge(s, d):
    """The logs' replicates, and the registry's for seeds that no log tells of."""
    c = R.final_loss(R.curve(steps(s, d))).where("init_seed is not null")
    w = Window.partitionBy("init_seed").orderBy(F.desc("step"), "run_id")
    reg = c.withColumn("k", F.row_number().over(w)).where("k = 1").select(F.lit(1000).cast("bigint").alias("train_steps"), F.col("init_seed").alias("seed"), "run_id", F.col("step").alias("last_step"), F.col("val_loss").alias("final_loss"))
    return R.logs_over_registry(R.scan_logs(rendered_logs(s, d)), reg).select("seed", "run_id", "origin")


# Extensions on the event table: windows in event time.
@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(s, d):
    return table(s, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), k AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM o)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM k GROUP BY user_id, sid""")
def events_sessions(s, d):
    g = table(s, d, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros(F.col("session_window.start").cast("timestamp")).alias("start_us"), "n")
