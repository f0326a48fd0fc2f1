"""The training-data queries p1_ to p8_, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import curriculum, leaks, names, natural, neardup, packing, splits, truncation
from textloom.scratch import written
from textloom.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def texts(s: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """A table of texts, over all cores also where it is one small file."""
    t = table(s, d, name)
    return spread(t.select(*columns, "text") if columns else t)


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return names.author_pairs(table(s, d, "cases"))


def p1_authors(s: SparkSession, d: str) -> DataFrame:
    return names.author_clusters(table(s, d, "cases"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return splits.related_books(table(s, d, "cases"))


def p2_splits(s: SparkSession, d: str) -> DataFrame:
    return splits.split_cases(table(s, d, "cases"), table(s, d, "split_targets"))


def p2_shares(s: SparkSession, d: str) -> DataFrame:
    return splits.split_report(written(p2_splits(s, d), "p2"), table(s, d, "split_targets"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates_found(texts(s, d, "passages"), table(s, d, "cases"))


def p3_groups(s: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(texts(s, d, "passages"), "id", "text")


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return natural.unnatural_passages(texts(s, d, "passages"), table(s, d, "common_words"))


def p4_statistics(s: SparkSession, d: str) -> DataFrame:
    stats = natural.text_statistics(table(s, d, "passages"), table(s, d, "common_words"))
    round_ = [F.floor(F.col(c) * 1000 + 1e-6).cast("bigint").alias(f"{c}_milli") for c in ("mean_word_len", "symbol_ratio", "line_end_share", "common_share", "distinct_ratio")]
    return stats.select("id", "text_key", *natural.COUNTS, *round_)


def p4_verdicts(s: SparkSession, d: str) -> DataFrame:
    return natural.judged_passages(texts(s, d, "passages"), table(s, d, "common_words"))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(texts(s, d, "documents", "doc_id"), leaks.evaluation_items(texts(s, d, "passages"), table(s, d, "cases")))


def p5_tolerant(s: SparkSession, d: str) -> DataFrame:
    """Documents and items that share 12 words in a row but for one replaced."""
    return leaks.leaked_items(texts(s, d, "documents", "doc_id"), leaks.evaluation_items(texts(s, d, "passages"), table(s, d, "cases")), leaks.TOLERANT)


def p6_containers(s: SparkSession, d: str) -> DataFrame:
    return packing.packed(texts(s, d, "documents", "doc_id"), table(s, d, "pack_sizes"))


def p6_fill(s: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(written(p6_containers(s, d), "p6"), table(s, d, "pack_sizes"))


def p7_draws(s: SparkSession, d: str) -> DataFrame:
    return curriculum.draws(texts(s, d, "documents"), table(s, d, "mix_targets"), table(s, d, "mix_schedule"))


def p7_shares(s: SparkSession, d: str) -> DataFrame:
    return curriculum.reached_shares(p7_draws(s, d), table(s, d, "mix_targets"))


def p8_found(s: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_documents(texts(s, d, "documents", "doc_id", "source"))


def p8_rates(s: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(texts(s, d, "documents", "doc_id", "source"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        p1_found, p1_authors, p2_found, p2_splits, p2_shares, p3_found, p3_groups, p4_found, p4_statistics, p4_verdicts,
        p5_found, p5_tolerant, p6_containers, p6_fill, p7_draws, p7_shares, p8_found, p8_rates,
    )}


_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"

P3_SQL = f"""
WITH p AS (SELECT DISTINCT id, {_WORDS.format("text")} AS w FROM passages WHERE text IS NOT NULL AND id IS NOT NULL),
ps AS (SELECT DISTINCT id, w, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM p WHERE len(w) >= 3)),
pn AS (SELECT id, w, count(*) AS n FROM ps GROUP BY id, w),
pp AS (SELECT a.id AS x, b.id AS y, a.w AS wa, b.w AS wb, count(*) AS c FROM ps a JOIN ps b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id, a.w, b.w),
t AS (SELECT DISTINCT CAST(source_id AS VARCHAR) AS id, regexp_replace(lower(source_title), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS w FROM cases WHERE source_title IS NOT NULL AND source_id IS NOT NULL),
ts AS (SELECT DISTINCT id, w, substring(w, i, 3) AS g FROM (SELECT id, w, unnest(range(1, length(w) - 1)) AS i FROM t WHERE length(w) >= 3)),
tn AS (SELECT id, w, count(*) AS n FROM ts GROUP BY id, w),
tp AS (SELECT a.id AS x, b.id AS y, a.w AS wa, b.w AS wb, count(*) AS c FROM ts a JOIN ts b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id, a.w, b.w)
SELECT DISTINCT 'passage' AS record_kind, x AS id_a, y AS id_b FROM pp JOIN pn a ON a.id = x AND a.w = wa JOIN pn b ON b.id = y AND b.w = wb WHERE c >= 0.7 * (a.n + b.n - c)
UNION ALL
SELECT DISTINCT 'title', x, y FROM tp JOIN tn a ON a.id = x AND a.w = wa JOIN tn b ON b.id = y AND b.w = wb WHERE c >= 0.6 * (a.n + b.n - c)
"""

P4_SQL = f"""
WITH p AS (SELECT DISTINCT id, coalesce(sha256(text), '') AS text_key, text FROM passages WHERE id IS NOT NULL),
f AS (SELECT id, text_key, text, {_WORDS.format("text")} AS w, regexp_replace(text, '[\\s]', '', 'g') AS solid,
      list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: x <> '') AS lines
      FROM p WHERE text IS NOT NULL AND trim(text) <> ''),
u AS (SELECT id, text_key, unnest(w) AS x FROM f),
c AS (SELECT id, text_key, lang, count(*) AS n FROM u JOIN common_words ON word = x GROUP BY id, text_key, lang),
b AS (SELECT id, text_key, max(n) AS n FROM c GROUP BY id, text_key),
g AS (SELECT id, text_key, count(DISTINCT x) AS kinds, sum(length(x)) AS letters FROM u GROUP BY id, text_key),
r AS (SELECT f.id, f.text_key, length(text) AS n_chars, len(w) AS n_words, len(lines) AS n_lines,
      CASE WHEN len(w) > 0 THEN letters / len(w) ELSE 0.0 END AS mean_word_len,
      length(regexp_replace(solid, '[\\p{{L}}\\p{{N}}]', '', 'g')) / length(solid) AS symbol_ratio,
      len(list_filter(lines, lambda x: contains('.!?,;:…—"”’'')]', right(x, 1)))) / len(lines) AS line_end_share,
      CASE WHEN len(w) > 0 THEN coalesce(b.n, 0) / len(w) ELSE 0.0 END AS common_share,
      CASE WHEN len(w) > 0 THEN kinds / len(w) ELSE 0.0 END AS distinct_ratio
      FROM f LEFT JOIN b ON b.id = f.id AND b.text_key = f.text_key LEFT JOIN g ON g.id = f.id AND g.text_key = f.text_key)
SELECT p.id, p.text_key, n_chars, n_words, n_lines, CAST(floor(round(mean_word_len, 6) * 1000 + 1e-6) AS BIGINT) AS mean_word_len_milli, CAST(floor(round(symbol_ratio, 6) * 1000 + 1e-6) AS BIGINT) AS symbol_ratio_milli,
       CAST(floor(round(line_end_share, 6) * 1000 + 1e-6) AS BIGINT) AS line_end_share_milli, CAST(floor(round(common_share, 6) * 1000 + 1e-6) AS BIGINT) AS common_share_milli, CAST(floor(round(distinct_ratio, 6) * 1000 + 1e-6) AS BIGINT) AS distinct_ratio_milli
FROM p LEFT JOIN r ON r.id = p.id AND r.text_key = p.text_key
"""

P5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT 'text' AS f, id, text AS t FROM passages UNION ALL SELECT 'prompt', id, prompt FROM cases UNION ALL SELECT 'target', id, target FROM cases),
iw AS (SELECT DISTINCT f, id, {_WORDS.format("t")} AS w FROM i WHERE t IS NOT NULL AND id IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT f, id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT f, id, w, unnest(range(1, len(w) - 10)) AS k FROM iw WHERE len(w) >= 12))
SELECT DISTINCT doc_id, f AS item_field, id AS item_id FROM dg JOIN ig ON dg.g = ig.g
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL, "p4_statistics": P4_SQL, "p5_found": P5_SQL}
