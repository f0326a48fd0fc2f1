"""Mixture, batching and training-schedule queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import mixing as X
from textloom.operators.prefix import running_sum
from textloom.plans.registry import query
from textloom.scratch import written
from textloom.tables import table

STEPS, BATCH, SEQ, SHARD, EOT = 40, 13, 64, 20_000, 50256


def sched(s, d):
    return table(s, d, "mix_schedule")


def steps(s, n=STEPS):
    return s.range(n).select(F.col("id").alias("step"), (F.col("id") / n).alias("progress"))


VIOL_SQL = """
WITH f AS (SELECT schedule_name, progress, sum(weight) AS t, count(DISTINCT slice) AS k, count(*) AS r FROM mix_schedule GROUP BY 1, 2), a AS (SELECT schedule_name, count(DISTINCT slice) AS w FROM mix_schedule GROUP BY 1),
x AS (SELECT schedule_name, 'negative_weight' AS rule, count(*) FILTER (WHERE weight < 0) AS n FROM mix_schedule GROUP BY 1 UNION ALL SELECT schedule_name, 'progress_range', count(*) FILTER (WHERE progress < 0 OR progress > 1) FROM mix_schedule GROUP BY 1
UNION ALL SELECT schedule_name, 'zero_total', count(*) FILTER (WHERE t <= 0) FROM f GROUP BY 1 UNION ALL SELECT f.schedule_name, 'missing_slice', count(*) FILTER (WHERE k < w) FROM f JOIN a ON a.schedule_name = f.schedule_name GROUP BY 1
UNION ALL SELECT schedule_name, 'repeated_slice', count(*) FILTER (WHERE r > k) FROM f GROUP BY 1) SELECT * FROM x
"""


@query(VIOL_SQL)
def schedule_violations(s, d):
    return X.violations(sched(s, d))


@query("SELECT DISTINCT schedule_name, slice FROM mix_schedule")
def mix_slices(s, d):
    return sched(s, d).select("schedule_name", "slice").distinct()


WEIGHTS_SQL = f"""
iv AS (SELECT schedule_name, slice, progress AS p0, weight AS w0, lead(progress) OVER w AS p1, lead(weight) OVER w AS w1, row_number() OVER w AS k FROM mix_schedule WINDOW w AS (PARTITION BY schedule_name, slice ORDER BY progress)),
st AS (SELECT i AS step, i / {STEPS} AS progress FROM (SELECT unnest(range({STEPS})) AS i)),
rw AS (SELECT schedule_name, step, slice, CASE WHEN p1 IS NULL THEN w0 ELSE w0 + (w1 - w0) * greatest(0.0, (progress - p0) / (p1 - p0)) END AS raw FROM st JOIN iv ON (progress >= p0 OR k = 1) AND (p1 IS NULL OR progress < p1)),
wt AS (SELECT schedule_name, step, slice, raw / sum(raw) OVER (PARTITION BY schedule_name, step) AS weight FROM rw)
"""


@query(f"WITH {WEIGHTS_SQL} SELECT schedule_name, step, slice, round(weight, 6) AS weight FROM wt")
def mix_weights(s, d):
    return X.weights_at(sched(s, d), steps(s)).withColumn("weight", F.round("weight", 6))


def counts(s, d):
    return X.allocation(X.weights_at(sched(s, d), steps(s)), BATCH)


# The fold over the steps: floors, then one each to the largest remainders (ties by name), and the rest carried on.
ALLOC_SQL = f"""WITH RECURSIVE {WEIGHTS_SQL}, wl AS (SELECT schedule_name, step, list(weight ORDER BY slice) AS ws, list(slice ORDER BY slice) AS names FROM wt GROUP BY 1, 2),
al(schedule_name, step, names, counts, carry) AS (SELECT DISTINCT schedule_name, CAST(-1 AS BIGINT), names, CAST([] AS BIGINT[]), list_transform(ws, lambda x: 0.0::DOUBLE) FROM wl WHERE step = 0
UNION ALL SELECT schedule_name, step, names, counts, list_transform(range(1, len(ws) + 1), lambda i: want[i] - counts[i]) FROM (
 SELECT *, list_transform(range(1, len(ws) + 1), lambda i: low[i] + CASE WHEN len(list_filter(range(1, len(ws) + 1), lambda j: want[j] - low[j] > want[i] - low[i] OR (want[j] - low[j] = want[i] - low[i] AND j < i))) < {BATCH} - list_sum(low) THEN 1 ELSE 0 END)::BIGINT[] AS counts FROM (
  SELECT *, list_transform(want, lambda x: greatest(0, floor(x)))::BIGINT[] AS low FROM (SELECT wl.schedule_name, CAST(wl.step AS BIGINT) AS step, wl.names, ws, list_transform(range(1, len(ws) + 1), lambda i: ws[i] * {BATCH} + carry[i]) AS want FROM al JOIN wl ON wl.schedule_name = al.schedule_name AND wl.step = al.step + 1)))),
ct AS (SELECT schedule_name, step, unnest(names) AS slice, CAST(unnest(counts) AS INT) AS count, unnest(carry) AS carry FROM al WHERE step >= 0)
"""


@query(ALLOC_SQL + "SELECT schedule_name, step, slice, count, round(carry, 6) AS carry FROM ct")
def mix_allocation(s, d):
    return counts(s, d).withColumn("carry", F.round("carry", 6))


@query(f"SELECT n AS schedule_name, {STEPS} AS steps, CAST({STEPS * BATCH} AS BIGINT) AS sequences, 0 AS wrong_steps FROM (SELECT DISTINCT schedule_name AS n FROM mix_schedule)")
def mix_batch_exact(s, d):
    """Every step's counts sum to the batch."""
    per = counts(s, d).groupBy("schedule_name", "step").agg(F.sum("count").alias("c"))
    return per.groupBy("schedule_name").agg(F.count("*").cast("int").alias("steps"), F.sum("c").alias("sequences"), F.count(F.when(F.col("c") != BATCH, 1)).cast("int").alias("wrong_steps"))


@query(ALLOC_SQL + "SELECT schedule_name, step, slice, count, CAST(coalesce(sum(count) OVER (PARTITION BY schedule_name, slice ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cursor_before FROM ct")
def mix_cursor(s, d):
    return X.cursors(counts(s, d)).select("schedule_name", "step", "slice", "count", "cursor_before")


INTER_SQL = """
WITH c AS (SELECT * FROM (VALUES ('flat', 0, 'backbone', 9), ('flat', 0, 'register', 4), ('flat', 1, 'backbone', 7), ('flat', 1, 'general', 3), ('flat', 1, 'register', 3)) t(schedule_name, step, slice, n)),
t AS (SELECT *, sum(n) OVER (PARTITION BY schedule_name, step) AS total FROM c), x AS (SELECT *, unnest(range(n)) AS ordinal FROM t)
SELECT schedule_name, step, row_number() OVER (PARTITION BY schedule_name, step ORDER BY n - ordinal * (total - n) DESC, slice, ordinal) - 1 AS slot, slice, ordinal FROM x
"""


@query(INTER_SQL)
def mix_interleave(s, d):
    rows = [("flat", 0, "backbone", 9), ("flat", 0, "register", 4), ("flat", 1, "backbone", 7), ("flat", 1, "general", 3), ("flat", 1, "register", 3)]
    return X.interleave(s.createDataFrame(rows, "schedule_name string, step int, slice string, count int"))


@query(ALLOC_SQL + """, t AS (SELECT *, sum(count) OVER (PARTITION BY schedule_name, step) AS total FROM ct WHERE count > 0), x AS (SELECT *, unnest(range(count)) AS ordinal FROM t)
SELECT schedule_name, step, row_number() OVER (PARTITION BY schedule_name, step ORDER BY count - ordinal * (total - count) DESC, slice, ordinal) - 1 AS slot, slice, ordinal FROM x""")
def mix_layout(s, d):
    return X.interleave(counts(s, d))


MISSING_SQL = """
WITH iv AS (SELECT schedule_name, slice, progress AS p0, weight AS w0, lead(progress) OVER w AS p1, lead(weight) OVER w AS w1, row_number() OVER w AS k FROM mix_schedule WINDOW w AS (PARTITION BY schedule_name, slice ORDER BY progress)),
st AS (SELECT unnest(range(101)) / 100 AS progress), u AS (SELECT DISTINCT schedule_name, slice FROM st JOIN iv ON (progress >= p0 OR k = 1) AND (p1 IS NULL OR progress < p1)
WHERE CASE WHEN p1 IS NULL THEN w0 ELSE w0 + (w1 - w0) * greatest(0.0, (progress - p0) / (p1 - p0)) END > 0)
SELECT schedule_name, slice, NOT EXISTS (SELECT 1 FROM documents WHERE documents.slice = u.slice) AS missing FROM u
"""


@query(MISSING_SQL)
def missing_slices(s, d):
    points = s.range(101).select(F.col("id").alias("step"), (F.col("id") / 100).alias("progress"))
    used = X.weights_at(sched(s, d), points).where("weight > 0").select("schedule_name", "slice").distinct()
    have = table(s, d, "documents").select("slice").where("slice is not null").distinct().withColumn("here", F.lit(True))
    return used.join(have, "slice", "left").select("schedule_name", "slice", F.col("here").isNull().alias("missing"))


@query(f"""WITH {WEIGHTS_SQL}, n AS (SELECT schedule_name, slice, sum(weight) * {BATCH} AS seqs FROM wt GROUP BY 1, 2), p AS (SELECT slice, CAST(sum(n_chars) AS BIGINT) AS pool FROM documents WHERE slice IS NOT NULL GROUP BY 1)
SELECT n.schedule_name, n.slice, pool, round(seqs * {SEQ} / pool, 5) AS epochs FROM n LEFT JOIN p ON p.slice = n.slice""")
def epochs_per_slice(s, d):
    """Expected epochs of each slice's pool (sized in characters); infinite for an empty pool."""
    n = X.weights_at(sched(s, d), steps(s)).groupBy("schedule_name", "slice").agg((F.sum("weight") * BATCH).alias("seqs"))
    p = table(s, d, "documents").where("slice is not null").groupBy("slice").agg(F.sum("n_chars").alias("pool"))
    e = F.when(F.coalesce("pool", F.lit(0)) > 0, F.round(F.col("seqs") * SEQ / F.col("pool"), 5)).otherwise(F.lit(float("inf")))
    return n.join(p, "slice", "left").select("schedule_name", "slice", "pool", e.alias("epochs"))


def offsets(s, d):
    """Documents in one stream of characters taken as tokens, each with one separator before it."""
    t = table(s, d, "documents").select("doc_id", (F.col("n_chars") + 1).alias("len"))
    return running_sum(t, [], ["doc_id"], "len", "start", name="offsets")


OFF_SQL = "o AS (SELECT doc_id, n_chars + 1 AS len, CAST(coalesce(sum(n_chars + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents)"


@query(f"WITH {OFF_SQL} SELECT doc_id, start, len, start // {SHARD} AS shard, start % {SHARD} AS pos FROM o")
def token_offsets(s, d):
    return offsets(s, d).select("doc_id", "start", "len", F.floor(F.col("start") / SHARD).alias("shard"), F.pmod("start", F.lit(SHARD)).alias("pos"))


@query(f"""WITH {OFF_SQL}, t AS (SELECT CAST(sum(len) AS BIGINT) AS total FROM o), k AS (SELECT unnest(range(CAST(ceil(total / {SHARD}) AS BIGINT))) AS shard, total FROM t)
SELECT shard, CASE WHEN shard = 0 THEN 'val' ELSE 'train' END AS split, printf('%s_%03d.bin', CASE WHEN shard = 0 THEN 'val' ELSE 'train' END, shard) AS name, least({SHARD}, total - shard * {SHARD}) AS n_tokens FROM k""")
def shard_rollover(s, d):
    total = offsets(s, d).agg(F.sum("len").alias("total"))
    k = total.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("total") / SHARD) - 1)).alias("shard"), "total")
    split = F.when(F.col("shard") == 0, "val").otherwise("train")
    return k.select("shard", split.alias("split"), F.format_string("%s_%03d.bin", split, "shard").alias("name"), F.least(F.lit(SHARD), F.col("total") - F.col("shard") * SHARD).alias("n_tokens"))


@query(f"WITH {OFF_SQL} SELECT start // {SHARD} AS shard, count(*) AS documents, min(start % {SHARD}) AS first_bos FROM o GROUP BY 1")
def bos_index(s, d):
    o = offsets(s, d)
    return o.groupBy(F.floor(F.col("start") / SHARD).alias("shard")).agg(F.count("*").alias("documents"), F.min(F.pmod("start", F.lit(SHARD))).alias("first_bos"))


@query(f"""WITH RECURSIVE {OFF_SQL}, a AS (SELECT start // {SHARD} AS shard, start, least(start + len, (start // {SHARD} + 1) * {SHARD}) AS stop, row_number() OVER (PARTITION BY start // {SHARD} ORDER BY start) AS k FROM o),
r(shard, k, rank, seq, start, stop, room) AS (SELECT shard, k, CAST(0 AS BIGINT), CAST(0 AS BIGINT), start, start + least(stop - start, 512, 2049), 2049 - least(stop - start, 512, 2049) FROM a WHERE k = 1
UNION ALL SELECT a.shard, a.k, r.rank + CASE WHEN r.room = 0 THEN 1 ELSE 0 END, CASE WHEN r.room = 0 THEN 0 ELSE r.seq + 1 END, a.start, a.start + least(a.stop - a.start, 512, CASE WHEN r.room = 0 THEN 2049 ELSE r.room END),
 CASE WHEN r.room = 0 THEN 2049 ELSE r.room END - least(a.stop - a.start, 512, CASE WHEN r.room = 0 THEN 2049 ELSE r.room END) FROM r JOIN a ON a.shard = r.shard AND a.k = r.k + 1)
SELECT CAST(shard AS BIGINT) AS shard, CAST(rank AS INT) AS rank, CAST(seq AS INT) AS seq_no, start, CAST(stop AS BIGINT) AS stop FROM r WHERE EXISTS (SELECT 1 FROM r AS f WHERE f.shard = r.shard AND f.rank = r.rank AND f.room = 0)""")
def pack_documents(s, d):
    o = offsets(s, d).select(F.floor(F.col("start") / SHARD).alias("shard"), "start", F.least(F.col("start") + F.col("len"), (F.floor(F.col("start") / SHARD) + 1) * SHARD).alias("stop"))
    return X.pack_documents(o, 2048, 512)


@query(f"WITH {OFF_SQL} SELECT start // 4096 AS win, count(*) AS starts, list_sum(list(start % 4096)) AS sum_pos FROM o GROUP BY 1")
def fixed_windows(s, d):
    return offsets(s, d).groupBy(F.floor(F.col("start") / 4096).alias("win")).agg(F.count("*").alias("starts"), F.sum(F.pmod("start", F.lit(4096))).alias("sum_pos"))


@query(f"""WITH {OFF_SQL}, w AS (SELECT start // 4096 AS win, list(start % 4096 ORDER BY start) AS ends FROM o GROUP BY 1)
SELECT win, array_to_string(list_concat(list_concat([0], ends[1:14]), list_transform(range(greatest(14 - len(ends), 0)), lambda x: 4096)), ',') AS cum_lengths FROM w""")
def cum_lengths(s, d):
    """[0, document starts ..., fill], 15 wide."""
    o = offsets(s, d).select(F.floor(F.col("start") / 4096).alias("win"), F.pmod("start", F.lit(4096)).alias("pos"))
    e = o.groupBy("win").agg(F.array_sort(F.collect_list("pos")).alias("ends"))
    fill = F.array_repeat(F.lit(4096).cast("bigint"), F.greatest(F.lit(14) - F.size("ends"), F.lit(0)))
    return e.select("win", F.array_join(F.concat(F.array(F.lit(0).cast("bigint")), F.slice("ends", 1, 14), fill), ",").alias("cum_lengths"))


_VOCAB = 50304 * 15 // 2
BIGRAM_SQL = f"""
WITH t AS (SELECT doc_id, i AS pos, unicode(substring(text, i, 1)) AS cur, CASE WHEN i > 1 THEN unicode(substring(text, i - 1, 1)) END AS prev FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
h AS (SELECT doc_id, CASE WHEN prev IS NULL THEN {_VOCAB - 1} ELSE xor(36313 * cur, 27191 * prev) % {_VOCAB - 1} END AS h, CASE WHEN prev IS NULL THEN 0 ELSE xor(prev, cur) % 8192 END AS g FROM t WHERE cur < 50304 AND coalesce(prev, 0) < 50304)
SELECT doc_id, CAST(sum(h) AS BIGINT) AS hash_sum, CAST(sum(g) AS BIGINT) AS sign_sum, count(*) AS n FROM h GROUP BY doc_id
"""


@query(BIGRAM_SQL)
def bigram_hash(s, d):
    """Hashes and sign indexes of neighbouring ids; characters stand for ids, those beyond the vocabulary of 50,304 are passed over."""
    t = table(s, d, "documents").where("text is not null and text <> ''")
    ids = F.transform(F.filter(F.split("text", ""), lambda x: x != ""), lambda x: F.ascii(x))
    known = lambda x: x.between(0, 50303)
    h = lambda c, p: F.when(p == -1, F.lit(_VOCAB - 1)).otherwise(F.pmod((c * 36313).bitwiseXOR(p * 27191), F.lit(_VOCAB - 1)))
    g = lambda c, p: F.when(p == -1, F.lit(0)).otherwise(F.pmod(p.bitwiseXOR(c), F.lit(8192)))
    # -1 stands before the first; a pair with an id beyond the vocabulary is null.
    before = t.select("doc_id", ids.alias("c")).select("doc_id", "c", F.concat(F.array(F.lit(-1)), F.slice("c", F.lit(1), F.size("c") - 1)).alias("p"))
    pairs = F.filter(F.arrays_zip("c", "p"), lambda x: known(x["c"]) & ((x["p"] == -1) | known(x["p"])))
    add = lambda f: F.aggregate("x", F.lit(0).cast("bigint"), lambda a, x: a + f(x["c"], x["p"]))
    return before.select("doc_id", pairs.alias("x")).where(F.size("x") > 0).select("doc_id", add(h).alias("hash_sum"), add(g).alias("sign_sum"), F.size("x").cast("bigint").alias("n"))


@query("""SELECT doc_id, n, len(w) AS windows, coalesce(list_last(w), -1) AS last_start FROM (SELECT doc_id, n_chars + 1 AS n,
list_filter(range(0, greatest(n_chars, 0), 32), lambda a: n_chars + 1 >= 2 AND (a = 0 OR a - 32 + 65 < n_chars + 1)) AS w FROM documents)""")
def eval_windows(s, d):
    """Windows of 64 + 1 tokens at stride 32; the first that reaches the end is the last."""
    n = F.col("n_chars") + 1
    starts = F.when(n >= 2, F.sequence(F.lit(0).cast("bigint"), n - 2, F.lit(32).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    w = F.filter(starts, lambda a: (a == 0) | (a - 32 + 65 < F.col("n_chars") + 1))
    return table(s, d, "documents").select("doc_id", n.alias("n"), F.size(w).alias("windows"), F.coalesce(F.get(w, F.size(w) - 1), F.lit(-1)).alias("last_start"))


PLAN_SQL = f"""
WITH {OFF_SQL}, t AS (SELECT CAST(sum(len) AS BIGINT) AS total FROM o), k AS (SELECT unnest(range(CAST(ceil(total / {SHARD}) AS BIGINT))) AS shard, total FROM t),
b AS (SELECT shard, greatest(1, (least({SHARD}, total - shard * {SHARD}) - 2) // 832) AS n FROM k), c AS (SELECT shard, n, coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS per FROM b),
st AS (SELECT unnest(range(200)) AS step) SELECT step, CAST(step // per AS BIGINT) AS epoch, shard, CAST((step % per - before) * 832 AS BIGINT) AS pos FROM st JOIN c ON step % per >= before AND step % per < before + n
"""


@query(PLAN_SQL)
def batch_plan(s, d):
    """Step -> (epoch, shard, position) of a loader that reads 832 tokens a step and wraps around."""
    k = shard_rollover(s, d).select("shard", F.greatest(F.lit(1), F.floor((F.col("n_tokens") - 2) / 832)).alias("n"))
    c = running_sum(k, [], ["shard"], "n", "before", name="plan").join(F.broadcast(k.agg(F.sum("n").alias("per"))), F.lit(True))
    st = s.range(200).select(F.col("id").alias("step"))
    at = F.pmod("step", F.col("per"))
    return st.join(c, (at >= F.col("before")) & (at < F.col("before") + F.col("n"))).select("step", F.floor(F.col("step") / F.col("per")).alias("epoch"), "shard", ((at - F.col("before")) * 832).alias("pos"))


def slice_shards(s, d):
    """Shards per slice, sized in characters."""
    t = table(s, d, "documents").where("slice is not null").select("slice", "doc_id", "n_chars")
    o = running_sum(t, ["slice"], ["doc_id"], "n_chars", "start", name="slice-offsets")
    return o.groupBy("slice", F.floor(F.col("start") / SHARD).alias("shard")).agg(F.sum("n_chars").alias("n_tokens"))


@query()
def slice_pool_plan(s, d):
    return X.pool_plan(counts(s, d), slice_shards(s, d), SEQ, strict=True)


@query()
def mixed_batches(s, d):
    """Each row of each batch: its slot, slice, shard and token position."""
    c = written(counts(s, d), "counts")
    plan = X.pool_plan(c, slice_shards(s, d), SEQ, strict=True)
    return X.interleave(c).join(plan, ["schedule_name", "step", "slice"]).select("schedule_name", "step", "slot", "slice", "epoch", "shard", (F.col("pos") + F.col("ordinal") * SEQ).alias("pos"))


@query()
def pack_eval_tasks(s, d):
    t = table(s, d, "cases").select("id", (F.length(F.coalesce("prompt", F.lit(""))) + F.length(F.coalesce("target", F.lit("")))).alias("length")).dropDuplicates(["id"])
    return X.pack_tasks(t.select(F.col("id").alias("item"), "length", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int").alias("rank")), 65536)


# Fixed values of these queries: ranks, tokens of a row and of a packed sequence.
RANKS, ROW, PACKED = 4, 4 * 256, 16_384


def shard_sizes(s, d):
    return shard_rollover(s, d).select("shard", "n_tokens")


_SIZES = f"{OFF_SQL}, tt AS (SELECT CAST(sum(len) AS BIGINT) AS total FROM o), z AS (SELECT shard, least({SHARD}, total - shard * {SHARD}) AS n_tokens FROM (SELECT unnest(range(CAST(ceil(total / {SHARD}) AS BIGINT))) AS shard, total FROM tt))"


@query(f"""WITH {_SIZES}, b AS (SELECT shard, n_tokens, (n_tokens - 1) // {RANKS * ROW} AS batches FROM z WHERE n_tokens >= {RANKS * ROW} + 1)
SELECT shard, CAST(k AS BIGINT) AS batch, CAST(rank AS INT) AS rank, CAST((k * {RANKS} + rank) * {ROW} AS BIGINT) AS pos FROM (SELECT shard, unnest(range(batches)) AS k FROM b), (SELECT unnest(range({RANKS})) AS rank)""")
def strided_batches(s, d):
    """Where each rank of the strided loader reads: ranks side by side, on to the next shard when a step for all would overrun."""
    return X.strided_batches(shard_sizes(s, d), RANKS, ROW)


@query(f"""WITH p AS (SELECT slice, CAST(sum(n_chars) AS BIGINT) AS total FROM documents WHERE slice IS NOT NULL GROUP BY 1), q AS (SELECT slice, total, unnest([0, 1, 19999, 20000, 20001, 123456, 5000000]::BIGINT[]) AS skipped FROM p WHERE total > 0),
a AS (SELECT *, CASE WHEN skipped = 0 THEN 0 ELSE (skipped - 1) // total END AS epoch, CASE WHEN skipped = 0 THEN 0 ELSE (skipped - 1) % total + 1 END AS spot FROM q),
o AS (SELECT slice, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY slice ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM documents WHERE slice IS NOT NULL),
h AS (SELECT slice, start // {SHARD} AS shard, sum(n_chars) AS n FROM o GROUP BY 1, 2), c AS (SELECT slice, shard, n, coalesce(sum(n) OVER (PARTITION BY slice ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h WHERE n > 0)
SELECT a.slice, skipped, CAST(epoch AS BIGINT) AS epoch, CAST(c.shard AS BIGINT) AS shard, CAST(spot - before AS BIGINT) AS pos FROM a JOIN c ON c.slice = a.slice AND spot <= before + n AND (spot > before OR (spot = 0 AND before = 0))""")
def pool_skip(s, d):
    """Where a slice's pool stands after so many tokens: a resume without reading."""
    skips = s.createDataFrame([(0,), (1,), (19_999,), (20_000,), (20_001,), (123_456,), (5_000_000,)], "skipped bigint")
    return X.pool_skip(slice_shards(s, d).where("n_tokens > 0"), skips)


_CHOICES = f"""t AS (SELECT id, prompt, target, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT id, min(coalesce(prompt, '')) AS prompt, min(coalesce(target, '')) AS target FROM cases WHERE id IS NOT NULL GROUP BY id)), n AS (SELECT count(*) AS n FROM t),
e AS (SELECT a.id, a.k, length(a.prompt) AS ctx, list(1 + length(b.target) ORDER BY j) AS ends FROM t a, n, (SELECT unnest(range(4)) AS j) x JOIN t b ON b.k = (a.k + j) % n.n GROUP BY a.id, a.k, a.prompt),
w AS (SELECT id, ctx, ends, k % {RANKS} AS rank, k // {RANKS} AS spot, 4 * ctx + list_sum(ends) AS total FROM e)"""


@query(f"""WITH RECURSIVE {_CHOICES}, r(rank, spot, id, sequence, start, used) AS (SELECT rank, spot, id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(total + 3 - 4 AS BIGINT) FROM w WHERE spot = 0
UNION ALL SELECT w.rank, w.spot, w.id, r.sequence + CASE WHEN r.used + w.total >= {PACKED} THEN 1 ELSE 0 END, CASE WHEN r.used + w.total >= {PACKED} THEN 0 ELSE r.used END, CAST(CASE WHEN r.used + w.total >= {PACKED} THEN w.total - 1 ELSE r.used + w.total END AS BIGINT) FROM r JOIN w ON w.rank = r.rank AND w.spot = r.spot + 1)
SELECT CAST(r.rank AS INT) AS rank, CAST(sequence AS INT) AS sequence, r.id AS item, start AS offset, CAST(used - start AS BIGINT) AS tokens, CAST(start + CASE WHEN start > 0 THEN 1 ELSE 0 END + ctx - 1 AS BIGINT) AS first_span_start, CAST(start + CASE WHEN start > 0 THEN 1 ELSE 0 END + ctx - 1 + ends[1] AS BIGINT) AS first_span_end FROM r JOIN w ON w.id = r.id""")
def pack_choice_tasks(s, d):
    """Tasks of one context and four endings, taken by the ranks in turn and packed with separators; characters stand for tokens."""
    one = table(s, d, "cases").where("id is not null").groupBy("id").agg(F.min(F.coalesce("prompt", F.lit(""))).alias("prompt"), F.min(F.coalesce("target", F.lit(""))).alias("target"))
    t = running_sum(one.withColumn("one", F.lit(1)), [], ["id"], "one", "k", name="choices").select("id", "k", F.length("prompt").alias("ctx"), (F.length("target") + 1).alias("end"))
    t = written(t, "choices")
    n = t.agg(F.count("*").alias("n"))
    ends = t.join(F.broadcast(n), F.lit(True)).select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"), "k", "n", "end").select(F.pmod(F.col("k") - F.col("j"), "n").alias("k"), "j", "end")
    four = ends.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "end"))), lambda x: x["end"]).alias("ends"))
    return X.pack_choices(t.join(four, "k").select(F.col("id").alias("item"), F.col("k").alias("at"), "ctx", "ends"), RANKS, PACKED)


@query("SELECT n AS preset, p AS progress, s AS slice, w AS weight FROM (VALUES " + ", ".join(f"('{n}', {p}::DOUBLE, '{sl}', {w}::DOUBLE)" for n, rows in X.PRESETS.items() for p, sl, w in rows) + ") t(n, p, s, w)")
def schedule_presets(s, d):
    """Every named schedule, parsed."""
    out = None
    for name in X.PRESETS:
        p = X.parse_schedule(s, name).select(F.lit(name).alias("preset"), "progress", "slice", "weight")
        out = p if out is None else out.union(p)
    return out


@query(f"SELECT n, CAST(ceil(n / 128) * 128 AS BIGINT) AS padded, n * 8 * 4 AS granule, least(n * 1000, ((n * 700 - 1) // (n * 8)) * (n * 8)) AS val_tokens FROM (SELECT unnest([1, 127, 128, 50257, 65536]) AS n)")
def size_rules(s, d):
    """Vocabulary padding, batch granules and the cap of validation tokens."""
    n = F.col("n").cast("bigint")
    t = s.createDataFrame([(1,), (127,), (128,), (50257,), (65536,)], "n int")
    return t.select("n", (F.ceil(n / 128) * 128).alias("padded"), (n * 32).alias("granule"), F.least(n * 1000, F.floor((n * 700 - 1) / (n * 8)) * (n * 8)).alias("val_tokens"))


# The stages of the short run, the buckets of the medium one.
STAGES = [(0, 500, 1.0, 896, 1, 3), (500, 1000, 1.52, 2048, 3, 7), (1000, 1500, 1.73, 2048, 5, 11), (1500, 1540, 1.0, 2048, 6, 13)]
_STAGES = ", ".join(str(x) for x in STAGES)


@query(f"""WITH g AS (SELECT * FROM (VALUES {_STAGES}) t(a, b, mul, seq, ws, wl)), st AS (SELECT unnest(range(1541)) AS step), j AS (SELECT step, least(step, 1539) AS k FROM st),
l AS (SELECT step, a, b, mul, seq, wl, CASE WHEN step >= 1540 THEN 1.0 ELSE (step - a) / (b - a) END AS t, least(1.0, greatest(0, step - 600) / 900.0) AS c FROM j JOIN g ON k >= a AND k < b)
SELECT step, seq, wl, round(t, 6) AS t, round(CASE WHEN step >= 600 THEN mul * (1 - c) + 0.15 * c ELSE mul END, 6) AS lr,
round(CASE WHEN step < 300 THEN 0.85 + step / 300 * 0.1 WHEN step > 1490 THEN 0.95 - (step - 1490) / 50 * 0.1 ELSE 0.95 END, 6) AS momentum,
round(CASE WHEN a = 0 THEN 0.25 - 0.25 * t WHEN a = 500 THEN 0.5 - 0.5 * t ELSE 0 END, 6) AS mtp_last FROM l""")
def stage_lookup(s, d):
    """Stage, progress, learning rate, momentum and last prediction weight by step."""
    g = s.createDataFrame(STAGES, "a int, b int, mul double, seq int, ws int, wl int")
    st = s.range(1541).select(F.col("id").alias("step"), F.least("id", F.lit(1539)).alias("k"))
    j = st.join(F.broadcast(g), (F.col("k") >= F.col("a")) & (F.col("k") < F.col("b")))
    t = F.when(F.col("step") >= 1540, 1.0).otherwise((F.col("step") - F.col("a")) / (F.col("b") - F.col("a")))
    c = F.least(F.lit(1.0), F.greatest(F.lit(0), F.col("step") - 600) / 900.0)
    lr = F.when(F.col("step") >= 600, F.col("mul") * (1 - c) + 0.15 * c).otherwise(F.col("mul"))
    mom = F.when(F.col("step") < 300, 0.85 + F.col("step") / 300 * 0.1).when(F.col("step") > 1490, 0.95 - (F.col("step") - 1490) / 50 * 0.1).otherwise(0.95)
    mtp = F.when(F.col("a") == 0, 0.25 - 0.25 * t).when(F.col("a") == 500, 0.5 - 0.5 * t).otherwise(0.0)
    return j.select("step", "seq", "wl", F.round(t, 6).alias("t"), F.round(lr, 6).alias("lr"), F.round(mom, 6).alias("momentum"), F.round(mtp, 6).alias("mtp_last"))


@query("""WITH st AS (SELECT i AS step, i / 1200 AS x FROM (SELECT unnest(range(1261)) AS i)), m AS (SELECT step, x, CASE WHEN x > 3/12 THEN 2.0 WHEN x > 2/12 THEN 1.73 WHEN x > 1/12 THEN 1.52 ELSE 1.0 END AS top FROM st)
SELECT step, round(CASE WHEN step > 1200 THEN 0.1 WHEN x >= 0.4 THEN top * ((1 - x) / 0.6) + (1 - (1 - x) / 0.6) * 0.1 ELSE top END, 6) AS lr, CASE WHEN step >= 1200 THEN 13 ELSE ([3, 7, 11])[CAST(floor(3 * x) AS INT) + 1] END AS window_size,
round(CASE WHEN x < 0.3 THEN 1.0 ELSE greatest(0, 1 - x) / 0.7 END, 6) AS linear_eta, step = 1200 OR step % (CASE WHEN x < 0.9 THEN 125 ELSE 25 END) = 0 AS validates FROM m""")
def lr_medium(s, d):
    """Step-bucket schedules, the stable-then-linear rule and the validation cadence."""
    st = s.range(1261).select(F.col("id").alias("step"), (F.col("id") / 1200).alias("x"))
    x, step = F.col("x"), F.col("step")
    top = F.when(x > 3 / 12, 2.0).when(x > 2 / 12, 1.73).when(x > 1 / 12, 1.52).otherwise(1.0)
    w = (1 - x) / 0.6
    lr = F.when(step > 1200, 0.1).when(x >= 0.4, top * w + (1 - w) * 0.1).otherwise(top)
    size = F.when(step >= 1200, 13).otherwise(F.get(F.array(F.lit(3), F.lit(7), F.lit(11)), F.floor(3 * x).cast("int")))
    eta = F.when(x < 0.3, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - x) / 0.7)
    val = (step == 1200) | (F.pmod(step, F.when(x < 0.9, 125).otherwise(25)) == 0)
    return st.select("step", F.round(lr, 6).alias("lr"), size.alias("window_size"), F.round(eta, 6).alias("linear_eta"), val.alias("validates"))
