"""Cleaning, quality and word queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import quality as Q
from textloom.plans.registry import query
from textloom.tables import spread, table

SMALL = {"min_chars": 200}

_SP = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"
_START = r"(?is)\*\*\*\s*(?:START OF (?:THE |THIS )?PROJECT GUTENBERG EBOOK|BEGIN [A-Z_]+ ETEXT).*?\*\*\*"
_END = r"(?is)\*\*\*\s*(?:END OF (?:THE |THIS )?PROJECT GUTENBERG EBOOK.*?|END OF ETEXT )\*\*\*"
TRIM = lambda x: f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"
CLEAN_SQL = f"""
m AS (SELECT doc_id, source, lang, slice, text, regexp_extract(text, '{_START}', 0) AS sm, regexp_extract(text, '{_END}', 0) AS em FROM documents),
o AS (SELECT *, CASE WHEN sm <> '' THEN strpos(text, sm) - 1 + length(sm) ELSE 0 END AS a, CASE WHEN em <> '' THEN strpos(text, em) - 1 ELSE length(text) END AS b FROM m),
st AS (SELECT *, {TRIM("CASE WHEN b <= a THEN text ELSE substring(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)) END")} AS body FROM o),
cl AS (SELECT *, CASE WHEN length(body) < 100 THEN text ELSE body END AS cleaned FROM st)
"""


@query(f"WITH {CLEAN_SQL} SELECT doc_id, length(body) AS n_body, md5(body) AS body_md5, length(cleaned) AS n_cleaned FROM cl")
def strip_boilerplate(s, d):
    t = table(s, d, "documents")
    b = t.select("doc_id", "text", T.strip_boilerplate(F.col("text")).alias("body"))
    c = F.when(F.length("body") < 100, F.col("text")).otherwise(F.col("body"))
    return b.select("doc_id", F.length("body").alias("n_body"), F.md5("body").alias("body_md5"), F.length(c).alias("n_cleaned"))


@query(f"WITH {CLEAN_SQL} SELECT source, count(*) AS changed, CAST(sum(length(text) - length(cleaned)) AS BIGINT) AS saved_chars FROM cl WHERE cleaned <> text GROUP BY source")
def reclean_report(s, d):
    t = table(s, d, "documents").withColumn("cleaned", T.clean(F.col("text"))).where("cleaned <> text")
    return t.groupBy("source").agg(F.count("*").alias("changed"), F.sum(F.length("text") - F.length("cleaned")).alias("saved_chars"))


_W = f"list_filter(regexp_split_to_array(t, '{_SP}+'), lambda x: x <> '')"
METRICS_SQL = f"""
b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, t, length(t) AS n_chars, length(regexp_replace(t, '{_SP}', '', 'g')) AS ns, length(regexp_replace(t, '\\P{{L}}', '', 'g')) AS al,
  length(regexp_replace(t, '\\P{{Nd}}', '', 'g')) AS dg, length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) AS up,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: {TRIM("x")}), lambda x: x <> '') AS ls, {_W} AS ws,
  len(regexp_extract_all(t, '[.!?]+["''”’)\\]]*(\\s|$)')) AS n_sentences FROM b),
m AS (SELECT doc_id, n_chars, al / greatest(ns, 1) AS alpha_ratio, dg / greatest(ns, 1) AS digit_ratio, up / greatest(al, 1) AS upper_ratio,
  len(list_filter(ls, lambda x: length(x) < 40)) / greatest(len(ls), 1) AS short_line_frac,
  CASE WHEN len(ls) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - len(list_distinct(ls)) / len(ls) END AS dup_line_frac, len(ws) AS n_words, n_sentences,
  CASE WHEN n_sentences > 0 THEN len(ws) / n_sentences ELSE 'Infinity'::DOUBLE END AS sentence_words,
  CASE WHEN len(ws) > 0 THEN length(array_to_string(ws, '')) / len(ws) ELSE 0.0 END AS mean_word_len,
  regexp_matches(t, '{T.RESIDUAL}') AS residual_boilerplate, regexp_matches(substring(t, 1, 4000), '{T.AUDIOBOOK}') AS audiobook_metadata FROM c)
"""
RATIOS = ("alpha_ratio", "digit_ratio", "upper_ratio", "short_line_frac", "dup_line_frac", "mean_word_len")
_R = ", ".join(f"round({c}, 6) AS {c}" for c in RATIOS)


def metrics(s, d, carry=()):
    return Q.quality_metrics(spread(table(s, d, "documents").select("doc_id", "text")), carry=carry)


@query(f"WITH {METRICS_SQL} SELECT doc_id, n_chars, n_words, n_sentences, {_R}, CASE WHEN isinf(sentence_words) THEN NULL ELSE round(sentence_words, 6) END AS sentence_words, residual_boilerplate, audiobook_metadata FROM m")
def quality_metrics(s, d):
    m = metrics(s, d)
    sw = F.when(F.col("sentence_words") != float("inf"), F.round("sentence_words", 6))
    return m.select("doc_id", "n_chars", "n_words", "n_sentences", *[F.round(c, 6).alias(c) for c in RATIOS], sw.alias("sentence_words"), "residual_boilerplate", "audiobook_metadata")


VERDICT_SQL = f"""
WITH {METRICS_SQL}, v AS (SELECT *, list_filter([
  CASE WHEN residual_boilerplate THEN 'residual_gutenberg_license' END, CASE WHEN audiobook_metadata THEN 'audiobook_metadata' END, CASE WHEN n_chars < 200 THEN 'too_short' END,
  CASE WHEN n_chars > 0 AND digit_ratio > 0.05 THEN 'digit_ratio' END, CASE WHEN n_chars > 0 AND alpha_ratio < 0.8 THEN 'alpha_ratio' END,
  CASE WHEN n_chars > 0 AND dup_line_frac > 0.32 THEN 'dup_lines' END, CASE WHEN n_chars > 0 AND upper_ratio > 0.14 THEN 'upper_ratio' END,
  CASE WHEN n_chars = 0 OR sentence_words < 5 THEN 'short_sentences' END, CASE WHEN n_chars > 0 AND sentence_words > 90 THEN 'no_sentences' END], lambda x: x IS NOT NULL) AS kinds FROM m)
"""


def verdicts(s, d, carry=()):
    v = Q.quality_verdict(metrics(s, d, carry), SMALL)
    return v.withColumn("kinds", F.transform("reasons", lambda x: F.regexp_replace(x, r"\(.*", "")))


@query(VERDICT_SQL + "SELECT doc_id, array_to_string(kinds, '|') AS kinds, len(kinds) AS n_reasons, len(kinds) = 0 AS keep FROM v")
def quality_verdict(s, d):
    return verdicts(s, d).select("doc_id", F.array_join("kinds", "|").alias("kinds"), F.size("kinds").alias("n_reasons"), "keep")


@query(VERDICT_SQL + "SELECT keep, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT len(kinds) = 0 AS keep, n_chars FROM v) GROUP BY keep")
def quality_filter(s, d):
    from pyspark.sql import Window

    g = verdicts(s, d).groupBy("keep").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
    return g.withColumn("share", F.round(F.col("documents") / F.sum("documents").over(Window.partitionBy(F.lit(1))), 6))


_P = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(f"""WITH {METRICS_SQL}, f AS (SELECT 'digit_ratio' AS metric, digit_ratio AS x FROM m UNION ALL SELECT 'sentence_words', sentence_words FROM m UNION ALL SELECT 'upper_ratio', upper_ratio FROM m),
g AS (SELECT metric, list(x ORDER BY x) AS v FROM f WHERE NOT isinf(x) GROUP BY metric)
SELECT metric, p, round(v[CAST(floor(p * (len(v) - 1)) AS BIGINT) + 1], 6) AS value FROM g, (SELECT unnest({_P}::DOUBLE[]) AS p)""")
def quality_percentiles(s, d):
    m, out = metrics(s, d), None
    for c in ("digit_ratio", "sentence_words", "upper_ratio"):
        q = Q.lower_percentiles(m, c, _P).select(F.lit(c).alias("metric"), "p", F.round("value", 6).alias("value"))
        out = q if out is None else out.union(q)
    return out


@query(VERDICT_SQL + "SELECT doc_id, len(kinds) AS n_reasons, array_to_string(kinds, '|') AS kinds FROM v WHERE len(kinds) > 0 ORDER BY len(kinds) DESC, doc_id LIMIT 25")
def worst_documents(s, d):
    v = verdicts(s, d).where("not keep")
    return v.select("doc_id", F.size("kinds").alias("n_reasons"), F.array_join("kinds", "|").alias("kinds")).orderBy(F.desc("n_reasons"), "doc_id").limit(25)


@query(VERDICT_SQL + """SELECT doc_id, round(margin, 6) AS margin FROM (SELECT doc_id, least((0.05 - digit_ratio) / 0.05, (alpha_ratio - 0.8) / 0.8, (0.32 - dup_line_frac) / 0.32, (0.14 - upper_ratio) / 0.14) AS margin
FROM v WHERE len(kinds) = 0) ORDER BY round(margin, 6), doc_id LIMIT 10""")
def borderline_documents(s, d):
    v = verdicts(s, d).where("keep").select("doc_id", F.round(Q.margins(), 6).alias("margin"))
    return v.orderBy("margin", "doc_id").limit(10)


_AW = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')"


@query(f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {_AW} AS w FROM documents)")
def word_tokens(s, d):
    w = table(s, d, "documents").select("doc_id", T.ascii_words(F.coalesce("text", F.lit(""))).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query(f"""WITH w AS (SELECT doc_id, {_AW} AS w FROM documents), g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 20))
SELECT doc_id, count(*) AS shingles FROM g GROUP BY doc_id""")
def shingle_count(s, d):
    w = table(s, d, "documents").select("doc_id", T.ascii_words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") >= 20)
    return w.select("doc_id", F.size(F.array_distinct(T.ngrams(F.col("w"), 5))).cast("bigint").alias("shingles"))


@query("""SELECT tok AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS tok FROM documents) GROUP BY tok""")
def word_freq(s, d):
    w = table(s, d, "documents").select(F.explode(T.ascii_words(F.col("text"))).alias("token"))
    return w.groupBy("token").agg(F.count("*").alias("n"))


@query()
def pretokenize(s, d):
    t = table(s, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(T.PRETOKEN), F.lit(0)).alias("pieces"), "n_chars")
    return t.select("doc_id", F.size("pieces").alias("n_pieces"), (F.length(F.array_join("pieces", "")) == F.col("n_chars")).alias("lossless"))


@query(f"""WITH w AS (SELECT doc_id, {_AW} AS w FROM documents), n AS (SELECT unnest(range(3, 13)) AS n),
g AS (SELECT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, n WHERE len(w) >= n)),
c AS (SELECT doc_id, n, g, count(*) AS k FROM g GROUP BY doc_id, n, g HAVING count(*) >= 2), m AS (SELECT doc_id, max(n) AS n FROM c GROUP BY doc_id)
SELECT c.doc_id, CAST(c.n AS INT) AS n, max(c.k) AS occurrences FROM c JOIN m ON m.doc_id = c.doc_id AND m.n = c.n GROUP BY c.doc_id, c.n""")
def longest_repeat(s, d):
    """The longest run of 3 to 12 words that a text repeats, and how often the commonest of that length stands in it."""
    w = spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", T.ascii_words(F.coalesce("text", F.lit(""))).alias("w"))
    best = w.where(T.repeats(F.col("w"), 3)).select("doc_id", T.longest_repeat(F.col("w"), 3, 12).alias("b")).where("b is not null")
    return best.select("doc_id", "b.n", F.col("b.k").cast("bigint").alias("occurrences"))
