"""Case, overlap, evaluation and vector queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import cases as C
from textloom.plans.registry import query
from textloom.plans.text_queries import _SP
from textloom.tables import spread, table

_TASK = "lower(trim(task))"
_EDGE = r"""[.,;:!?''"()\[\]—–]"""
OVER_SQL = f"""
WITH c AS (SELECT DISTINCT id, {_TASK} AS task, list_filter(regexp_split_to_array(coalesce(prompt, ''), '{_SP}+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(coalesce(target, ''), '{_SP}+'), lambda x: x <> '') AS b FROM cases WHERE id IS NOT NULL),
g AS (SELECT id, task, list_distinct(list_transform(range(1, greatest(len(a) - 1, 1)), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) AS ga, list_distinct(list_transform(range(1, greatest(len(b) - 1, 1)), lambda i: b[i] || ' ' || b[i + 1] || ' ' || b[i + 2])) AS gb,
 list_distinct(list_transform(a, lambda x: lower(regexp_replace(x, '^{_EDGE}+|{_EDGE}+$', '', 'g')))) AS wa, list_distinct(list_transform(b, lambda x: lower(regexp_replace(x, '^{_EDGE}+|{_EDGE}+$', '', 'g')))) AS wb FROM c),
s AS (SELECT id, task, CASE WHEN len(ga) > 0 THEN len(list_intersect(ga, gb)) / len(ga) ELSE 0.0 END AS p, CASE WHEN len(gb) > 0 THEN len(list_intersect(ga, gb)) / len(gb) ELSE 0.0 END AS r,
 CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 ELSE len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) END AS w FROM g),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM s),
o AS (SELECT *, 0.5 * (CASE task WHEN 'continuation' THEN p WHEN 'restoration' THEN r WHEN 'infilling' THEN f1 ELSE 0.0 END) + 0.5 * w AS reward FROM f)
"""


def scored(s, d):
    """The prompt stands for the reply."""
    c = table(s, d, "cases").where("id is not null").select("id", F.lower(F.trim("task")).alias("task"), "prompt", "target").distinct()
    return C.overlap_scores(c, "prompt", "target", "task").drop("prompt", "target")


@query(OVER_SQL + "SELECT id, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM o")
def ngram_overlap(s, d):
    return scored(s, d).select("id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(OVER_SQL + "SELECT id, round(w, 6) AS word_overlap FROM o")
def word_jaccard(s, d):
    return scored(s, d).select("id", F.round("word_overlap", 6).alias("word_overlap"))


@query(OVER_SQL + "SELECT id, task, round(reward, 6) AS reward FROM o")
def case_reward(s, d):
    return scored(s, d).select("id", "task", F.round("reward", 6).alias("reward"))


@query(OVER_SQL + "SELECT coalesce(task, '') AS task, count(*) AS n, round(avg(reward), 6) AS mean_reward, round(avg(w), 6) AS mean_overlap FROM o GROUP BY 1")
def reward_summary(s, d):
    return scored(s, d).groupBy(F.coalesce("task", F.lit("")).alias("task")).agg(F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("mean_reward"), F.round(F.avg("word_overlap"), 6).alias("mean_overlap"))


def passages_of(s, d):
    t = spread(table(s, d, "documents").select("doc_id", "source_id", "text")).select("doc_id", F.coalesce("source_id", F.lit(-1)).alias("book"), F.posexplode(C.extract_passages(F.col("text"))).alias("part", "passage"))
    return t


# Paragraphs of ten words or more, merged greedily to 80 to 200 words: one paragraph a step.
PASS_SQL = f"""WITH RECURSIVE pw AS (SELECT doc_id, source_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n[\\s\\x0B]*\\n'), lambda p: len(list_filter(regexp_split_to_array(p, '{_SP}+'), lambda x: x <> ''))), lambda n: n >= 10) AS ws FROM documents),
f(doc_id, source_id, ws, k, buf, done) AS (SELECT doc_id, source_id, ws, 0, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM pw
UNION ALL SELECT doc_id, source_id, ws, k + 1, CASE WHEN buf + ws[k + 1] <= 200 THEN buf + ws[k + 1] ELSE ws[k + 1] END, CASE WHEN buf + ws[k + 1] > 200 AND buf >= 80 THEN list_append(done, buf) ELSE done END FROM f WHERE k < len(ws)),
ps AS (SELECT doc_id, source_id, unnest(range(len(d))) AS part, unnest(d) AS words FROM (SELECT doc_id, source_id, CASE WHEN buf >= 80 THEN list_append(done, buf) ELSE done END AS d FROM f WHERE k = len(ws)))
"""


@query(PASS_SQL + "SELECT doc_id, CAST(part AS INT) AS part, CAST(words AS INT) AS words FROM ps")
def extract_passages(s, d):
    return passages_of(s, d).select("doc_id", "part", F.size(F.split("passage", " ")).alias("words"))


_DW = f"w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SP}+'), lambda x: x <> '') AS w FROM documents)"


def doc_words(s, d):
    return table(s, d, "documents").select("doc_id", T.space_words(F.coalesce("text", F.lit(""))).alias("w"))


@query(f"WITH {_DW}, c AS (SELECT doc_id, w, greatest(CAST(floor(len(w) * 0.6) AS BIGINT), 20) AS c FROM w) SELECT doc_id, md5(array_to_string(w[1:c], ' ')) AS prompt, md5(array_to_string(w[c + 1:], ' ')) AS target FROM c")
def continuation_case(s, d):
    p, t = C.continuation(F.col("w"))
    return doc_words(s, d).select("doc_id", F.md5(p).alias("prompt"), F.md5(t).alias("target"))


@query(f"""WITH {_DW}, c AS (SELECT doc_id, w, len(w) // 3 AS k FROM w)
SELECT doc_id, md5(array_to_string(w[1:k], ' ') || ' [FILL] ' || array_to_string(w[2 * k + 1:], ' ')) AS prompt, md5(array_to_string(w[k + 1:2 * k], ' ')) AS target FROM c""")
def infilling_case(s, d):
    p, t = C.infilling(F.col("w"))
    return doc_words(s, d).select("doc_id", F.md5(p).alias("prompt"), F.md5(t).alias("target"))


_PLAIN = "q"
for _old, _new in C.PLAIN.items():
    _PLAIN = f"regexp_replace({_PLAIN}, '(?i)\\b{_old}\\b', '{_new}', 'g')"


@query(f"""WITH a AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '[;:]', '. ', 'g'), '{_SP}+[–—]{_SP}+', '. ', 'g') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, text, regexp_replace(regexp_replace(t, '\\([^\\n]*?\\)', '', 'g'), '(?i),{_SP}+(?:{C.CLAUSES})\\b[^.]*', '', 'g') AS t FROM a),
c AS (SELECT doc_id, text, array_to_string(list_transform(string_split(regexp_replace(t, '([.!?]{_SP}+)([A-Z])', '\\1' || chr(63743) || '\\2', 'g'), chr(63743)), lambda x, i: CASE WHEN i > 1 THEN lower(x[1]) || x[2:] ELSE x END), '') AS q FROM b),
e AS (SELECT doc_id, text, regexp_replace({_PLAIN}, '{_SP}{{2,}}', ' ', 'g') AS t FROM c)
SELECT doc_id, md5(regexp_replace(t, '^{_SP}+|{_SP}+$', '', 'g')) AS prompt, md5(text) AS target FROM e""")
def restoration_case(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(C.degraded(F.col("text"))).alias("prompt"), F.md5("text").alias("target"))


@query(PASS_SQL + """, h AS (SELECT doc_id, coalesce(source_id, -1) AS book, part, md5('1930:' || coalesce(source_id, -1) || ':' || doc_id || ':' || part) AS h FROM ps), r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY h, doc_id, part) AS r FROM h)
SELECT doc_id, book, CAST(part AS INT) AS part FROM r ORDER BY r > 2, h, book, doc_id, part LIMIT 100""")
def sample_cases(s, d):
    return C.sample_cases(passages_of(s, d), 100).select("doc_id", "book", "part")


@query("SELECT id, task, md5(coalesce(prompt, '')) AS prompt, source_id, epoch_us(made_at) AS made_us FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY made_at) AS r FROM cases WHERE id IS NOT NULL) WHERE r = 1")
def cases_roundtrip(s, d):
    """Cases through JSON and back, first delivery of each id."""
    c = table(s, d, "cases").where("id is not null")
    j = c.select(F.to_json(F.struct(*c.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("j"))
    back = j.select(F.from_json("j", c.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("c")).select("c.*")
    r = back.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("made_at"))).where("r = 1")
    return r.select("id", "task", F.md5(F.coalesce("prompt", F.lit(""))).alias("prompt"), "source_id", F.unix_micros("made_at").alias("made_us"))


@query("""WITH c AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM passages WHERE id IS NOT NULL)), b AS (SELECT unnest(range(5)) AS batch)
SELECT batch, g AS member, id FROM b, (SELECT unnest(range(3)) AS g), c WHERE (k - batch * 16 % n + n) % n < 16""")
def circular_batches(s, d):
    """Batches of 16 items around the circle, each item in a group of three."""
    from textloom.operators.prefix import running_sum

    c = table(s, d, "passages").select("id").where("id is not null").distinct().withColumn("one", F.lit(1))
    k = running_sum(c, [], ["id"], "one", "k", name="circle").join(F.broadcast(c.agg(F.count("*").alias("n"))), F.lit(True))
    at = F.pmod(F.col("k") - F.pmod(F.col("batch") * 16, F.col("n")) + F.col("n"), F.col("n"))
    b = k.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(4)))).where(at < 16)
    return b.select("batch", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("member"), "id")


# Vectors and scored passages.
@query("SELECT label, i - 1 AS dim, round(avg(x), 5) AS mean, count(*) AS n FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
def vector_mean(s, d):
    e = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT a.i - 1 AS i, b.i - 1 AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2""")
def vector_covariance(s, d):
    """Upper triangle of the sample covariance, from the Gram matrices of the tasks."""
    return C.covariance(table(s, d, "embeddings"), "embedding").select("i", "j", F.round("cov", 6).alias("cov"))


@query("""WITH e AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2)
SELECT b.label, round(sqrt(sum((b.m - a.m) * (b.m - a.m))), 5) AS norm FROM m a JOIN m b ON a.i = b.i AND a.label = 0 GROUP BY 1""")
def mean_difference(s, d):
    """Norm of each label's mean minus label 0's."""
    e = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    a = m.where("label = 0").select("i", F.col("m").alias("m0"))
    return m.join(F.broadcast(a), "i").groupBy("label").agg(F.round(F.sqrt(F.sum((F.col("m") - F.col("m0")) ** 2)), 5).alias("norm"))


@query("""SELECT vec_id, mode, round(list_sum(list_transform(embedding, lambda x: CASE mode WHEN 'add' THEN x::DOUBLE WHEN 'subtract' THEN -x::DOUBLE ELSE 0 END)), 4) AS total FROM embeddings, (SELECT unnest(['add', 'subtract', 'none']) AS mode)""")
def direction_delta(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding", F.explode(F.array(F.lit("add"), F.lit("subtract"), F.lit("none"))).alias("mode"))
    v = F.transform("embedding", lambda x: F.when(F.col("mode") == "add", x.cast("double")).when(F.col("mode") == "subtract", -x.cast("double")).otherwise(F.lit(0.0)))
    return e.select("vec_id", "mode", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""WITH l AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), z AS (SELECT *, ln(list_sum(list_transform(v, lambda x: exp(x)))) AS z, ln(list_sum(list_transform(v, lambda x: exp(x / 2)))) AS y FROM l)
SELECT label, round(avg(list_sum(list_transform(v, lambda x: exp(x - z) * ((x - z) - (x / 2 - y))))), 6) AS mean_kl FROM z GROUP BY label""")
def mean_kl(s, d):
    """KL of the softmax of a vector against that of its half."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    add = lambda f: F.log(F.aggregate(F.transform("v", f), F.lit(0.0), lambda a, x: a + x))
    z = table(s, d, "embeddings").select("label", v.alias("v")).withColumn("z", add(F.exp)).withColumn("y", add(lambda x: F.exp(x / 2)))
    kl = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("z")) * ((x - F.col("z")) - (x / 2 - F.col("y"))))
    return z.groupBy("label").agg(F.round(F.avg(kl), 6).alias("mean_kl"))


@query("""WITH p AS (SELECT id, min(text) AS text FROM passages WHERE id IS NOT NULL GROUP BY id), k AS (SELECT id, text, CASE WHEN id LIKE '%.contrast' THEN left(id, length(id) - 9) ELSE id END AS base, id LIKE '%.contrast' AS c FROM p),
b AS (SELECT base, bool_or(c) AND bool_or(NOT c) AS pair FROM k GROUP BY base), r AS (SELECT k.base, id, CASE WHEN NOT pair THEN 'craft' WHEN c THEN 'wrong' ELSE 'target' END AS role FROM k JOIN b ON b.base = k.base)
SELECT id, role, row_number() OVER (ORDER BY role = 'craft', base, role) - 1 AS place FROM r""")
def context_roles(s, d):
    """The contexts of the vectors in order: of each pair the target, then the wrong one, then what has no partner."""
    from textloom.operators.prefix import running_sum

    p = table(s, d, "passages").where("id is not null").select("id").distinct()
    k = p.select("id", F.regexp_replace("id", r"\.contrast$", "").alias("base"), F.col("id").endswith(".contrast").alias("c"))
    pair = k.groupBy("base").agg((F.bool_or("c") & F.bool_or(~F.col("c"))).alias("pair"))
    r = k.join(pair, "base").select("id", "base", F.when(~F.col("pair"), "craft").when(F.col("c"), "wrong").otherwise("target").alias("role"), F.lit(1).alias("one"))
    return running_sum(r.withColumn("late", F.col("role") == "craft"), [], ["late", "base", "role"], "one", "place", name="roles").select("id", "role", "place")


@query("""WITH g AS (SELECT label, mode, count(*) AS rows, max(abs(list_sum(list_transform(embedding, lambda x: CASE mode WHEN 'none' THEN 0.0::DOUBLE ELSE x::DOUBLE END)))) AS residual FROM embeddings, (SELECT unnest(['add', 'none']) AS mode) GROUP BY 1, 2)
SELECT label, mode, rows, CASE WHEN mode = 'none' THEN residual <= 1e-4 ELSE TRUE END AS ok FROM g""")
def steer_checks(s, d):
    """Rows of each label and mode, and whether the unsteered ones leave no residual."""
    e = table(s, d, "embeddings").select("label", "embedding", F.explode(F.array(F.lit("add"), F.lit("none"))).alias("mode"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.when(F.col("mode") == "none", 0.0).otherwise(x.cast("double")))
    return e.groupBy("label", "mode").agg(F.count("*").alias("rows"), F.max(F.abs(total)).alias("r")).select("label", "mode", "rows", F.when(F.col("mode") == "none", F.col("r") <= 1e-4).otherwise(F.lit(True)).alias("ok"))


@query("""SELECT task, temperature, count(*) AS prompts FROM (SELECT DISTINCT coalesce(lower(trim(task)), '') AS task, prompt FROM cases WHERE prompt <> ''), (SELECT unnest([0.0, 0.7, 1.0]::DOUBLE[]) AS temperature) GROUP BY 1, 2""")
def generation_grid(s, d):
    """Prompts of each family times the temperatures."""
    from textloom.sources.texts import prompt_grid

    f = table(s, d, "cases").where("prompt <> ''").select(F.coalesce(F.lower(F.trim("task")), F.lit("")).alias("family"), F.array("prompt").alias("prompts")).distinct()
    return prompt_grid(f, [0.0, 0.7, 1.0]).groupBy(F.col("family").alias("task"), "temperature").agg(F.count("*").alias("prompts"))


_NLL = "(SELECT id, greatest(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')), 1) AS tokens, length(coalesce(text, '')) / 3.0 AS nll FROM (SELECT id, min(text) AS text FROM passages WHERE id IS NOT NULL GROUP BY id))"


def nll(s, d):
    """Scores are an input: characters / 3 stand for the summed loss of a passage."""
    p = table(s, d, "passages").where("id is not null").groupBy("id").agg(F.min("text").alias("text"))
    t = F.coalesce("text", F.lit(""))
    n = F.greatest(F.size(F.filter(F.split(t, r"\s+"), lambda x: x != "")), F.lit(1))
    return p.select("id", n.alias("tokens"), (F.length(t) / 3.0).alias("nll"))


@query(f"SELECT id, tokens, round(nll / tokens, 6) AS nats_per_token, round(ln(exp(nll / tokens)), 5) AS log_ppl FROM {_NLL}")
def passage_ppl(s, d):
    x = F.col("nll") / F.col("tokens")
    return nll(s, d).select("id", "tokens", F.round(x, 6).alias("nats_per_token"), F.round(F.log(F.exp(x)), 5).alias("log_ppl"))


@query(f"""WITH n AS {_NLL}, k AS (SELECT id, tokens, nll, id LIKE '%.contrast' AS c, CASE WHEN id LIKE '%.contrast' THEN left(id, length(id) - 9) ELSE id END AS base FROM n),
p AS (SELECT t.base, w.nll / w.tokens - t.nll / t.tokens AS gap FROM k t JOIN k w ON w.base = t.base AND w.c AND NOT t.c)
SELECT count(*) AS targets, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(nll) / sum(tokens), 6) AS mean_nll, (SELECT count(*) FROM p) AS pairs, round((SELECT avg(gap) FROM p), 6) AS loss_gap FROM k WHERE NOT c""")
def register_eval(s, d):
    c = F.col("id").endswith(".contrast")
    k = nll(s, d).select("tokens", "nll", c.alias("c"), F.regexp_replace("id", r"\.contrast$", "").alias("base"))
    t, w = k.where("not c"), k.where("c").select("base", (F.col("nll") / F.col("tokens")).alias("wrong"))
    gap = t.join(w, "base").agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("wrong") - F.col("nll") / F.col("tokens")), 6).alias("loss_gap"))
    return t.agg(F.count("*").alias("targets"), F.sum("tokens").alias("tokens"), F.round(F.sum("nll") / F.sum("tokens"), 6).alias("mean_nll")).join(F.broadcast(gap), F.lit(True))


@query("""WITH e AS (SELECT vec_id, label, [list_avg(embedding[1:16]), list_avg(embedding[17:32]), list_avg(embedding[33:48]), list_avg(embedding[49:64])] AS l FROM embeddings)
SELECT count(*) AS tasks, CAST(sum(CASE WHEN list_position(l, list_min(l)) - 1 = label % 4 THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM e""")
def choice_accuracy(s, d):
    """Mean loss over each of four spans, the least is the choice; the vector stands for the losses."""
    parts = [F.aggregate(F.slice("embedding", k * 16 + 1, 16), F.lit(0.0), lambda a, x: a + x.cast("double")) / 16 for k in range(4)]
    l = F.array(*parts)  # noqa: E741
    hit = F.array_position(l, F.array_min(l)) - 1 == F.pmod("label", F.lit(4))
    return table(s, d, "embeddings").agg(F.count("*").alias("tasks"), F.sum(hit.cast("bigint")).alias("correct"))
