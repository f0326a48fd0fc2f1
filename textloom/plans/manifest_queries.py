"""Manifest, slice and holdout queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import manifest as M
from textloom.plans.registry import query
from textloom.tables import table

LAST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gutenberg_id ORDER BY line_no DESC, written_at DESC) AS r FROM manifest WHERE gutenberg_id IS NOT NULL) WHERE r = 1)"
USABLE = "coalesce(status, '') <> 'failed' AND NOT coalesce(copyright, FALSE)"
NAMES = ("Quillfeather", "Soombebets", "Kerlior", "Glolbith", "Thungorn")  # authors of the fixtures taken as register
_PAT = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in (*M.REGISTER_AUTHORS, *NAMES)) + "]"
CLASS = f"CASE WHEN len(list_filter(coalesce(authors, []), lambda a: len(list_filter({_PAT}, lambda p: contains(a, p))) > 0)) > 0 THEN 'register' ELSE 'backbone' END"


def man(s, d):
    return table(s, d, "manifest")


@query(f"WITH {LAST} SELECT gutenberg_id, title, char_count, line_no FROM l WHERE {USABLE}")
def manifest_last_wins(s, d):
    return M.last_wins(man(s, d)).select("gutenberg_id", "title", "char_count", "line_no")


@query(f"WITH {LAST}, f AS (SELECT gutenberg_id, min(line_no) AS position FROM manifest GROUP BY gutenberg_id) SELECT l.gutenberg_id, f.position, l.line_no, l.status FROM l JOIN f ON f.gutenberg_id = l.gutenberg_id")
def manifest_dedupe_stable(s, d):
    return M.stable_dedupe(man(s, d)).select("gutenberg_id", "position", "line_no", "status")


@query("""SELECT gutenberg_id, line_no, status, copyright FROM (SELECT *, row_number() OVER (PARTITION BY gutenberg_id ORDER BY line_no, written_at) AS r
FROM manifest WHERE gutenberg_id IS NOT NULL AND coalesce(status, '') <> 'failed') WHERE r = 1""")
def manifest_first_wins(s, d):
    return M.first_wins(man(s, d)).select("gutenberg_id", "line_no", "status", "copyright")


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, ''))) AS n_bytes, coalesce(slice, 'backbone') AS slice, 'en' AS default_lang, coalesce(lang, 'en') AS lang FROM documents""")
def backfill_hashes(s, d):
    t = F.coalesce("text", F.lit(""))
    return table(s, d, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.octet_length(t).alias("n_bytes"), F.coalesce("slice", F.lit("backbone")).alias("slice"), F.lit("en").alias("default_lang"), F.coalesce("lang", F.lit("en")).alias("lang"))


@query(f"""WITH {LAST} SELECT d.doc_id, l.title, array_to_string(l.subjects[1:12], '|') AS subjects, array_to_string(l.bookshelves[1:8], '|') AS shelves, list_max(l.author_death_year) AS last_death,
CASE WHEN l.copyright THEN 'restricted' WHEN l.gutenberg_id IS NULL THEN 'unknown' WHEN len(l.author_death_year) > 0 THEN 'author_death' ELSE 'library' END AS basis
FROM documents d LEFT JOIN l ON l.gutenberg_id = d.source_id""")
def backfill_metadata(s, d):
    last = M._ranked(man(s, d).where("gutenberg_id is not null"), F.desc("line_no"), F.desc("written_at")).where("__r = 1")
    j = table(s, d, "documents").select("doc_id", "source_id").join(last, F.col("gutenberg_id") == F.col("source_id"), "left")
    basis = F.when(F.col("copyright"), "restricted").when(F.col("gutenberg_id").isNull(), "unknown").when(F.size("author_death_year") > 0, "author_death").otherwise("library")
    return j.select("doc_id", "title", F.array_join(F.slice("subjects", 1, 12), "|").alias("subjects"), F.array_join(F.slice("bookshelves", 1, 8), "|").alias("shelves"), F.array_max("author_death_year").alias("last_death"), basis.alias("basis"))


@query("SELECT DISTINCT gutenberg_id FROM manifest m WHERE gutenberg_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.source_id = m.gutenberg_id)")
def pending_fetch(s, d):
    have = table(s, d, "documents").select(F.col("source_id").alias("gutenberg_id")).distinct()
    return man(s, d).select("gutenberg_id").where("gutenberg_id is not null").distinct().join(have, "gutenberg_id", "left_anti")


@query(r"""SELECT line_no, source_url, CASE WHEN source_url LIKE '%/plain' THEN source_url WHEN source_url IS NOT NULL THEN source_url || '/plain' END AS text_url, regexp_extract(source_url, 'https?://([^/]+)', 1) AS host,
list_last(string_split(replace(local_path, chr(92), '/'), '/')) AS file_name FROM manifest""")
def plain_text_url(s, d):
    u = F.col("source_url")
    return man(s, d).select("line_no", u, F.when(u.endswith("/plain"), u).when(u.isNotNull(), F.concat(u, F.lit("/plain"))).alias("text_url"), F.regexp_extract(u, "https?://([^/]+)", 1).alias("host"), M.base_name(F.col("local_path")).alias("file_name"))


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE list_contains(lang_codes, 'en') AND source_url IS NOT NULL AND title IS NOT NULL AND title <> '') AS wanted FROM manifest")
def source_predicate(s, d):
    ok = F.array_contains("lang_codes", "en") & F.col("source_url").isNotNull() & (F.col("title") != "")
    return man(s, d).agg(F.count("*").alias("lines"), F.count(F.when(ok, 1)).alias("wanted"))


FETCH_SQL = """
WITH q AS (SELECT unnest(subjects) AS subject, gutenberg_id, line_no, copyright, status FROM manifest WHERE gutenberg_id IS NOT NULL),
k AS (SELECT regexp_extract(subject, '^[^-]*[^- ]', 0) AS topic, gutenberg_id, min(line_no) AS line_no, bool_or(coalesce(copyright, FALSE)) AS c, bool_or(status = 'failed') AS f FROM q GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY line_no, gutenberg_id) AS seen FROM k),
u AS (SELECT *, row_number() OVER (PARTITION BY gutenberg_id ORDER BY topic) AS dup FROM r WHERE seen <= 20),
h AS (SELECT DISTINCT source_id FROM documents)
SELECT topic, CASE WHEN dup > 1 THEN 'duplicate' WHEN c THEN 'copyright' WHEN h.source_id IS NOT NULL THEN 'on_disk' WHEN f THEN 'retry' ELSE 'fetch' END AS outcome, count(*) AS n
FROM u LEFT JOIN h ON h.source_id = u.gutenberg_id GROUP BY 1, 2
"""


@query(FETCH_SQL)
def targeted_fetch_plan(s, d):
    q = man(s, d).where("gutenberg_id is not null").select(F.explode("subjects").alias("subject"), "gutenberg_id", "line_no", F.coalesce("copyright", F.lit(False)).alias("c"), (F.col("status") == "failed").alias("f"))
    k = q.groupBy(F.regexp_extract("subject", "^[^-]*[^- ]", 0).alias("topic"), "gutenberg_id").agg(F.min("line_no").alias("line_no"), F.bool_or("c").alias("c"), F.bool_or("f").alias("f"))
    u = k.withColumn("seen", F.row_number().over(Window.partitionBy("topic").orderBy("line_no", "gutenberg_id"))).where("seen <= 20")
    u = u.withColumn("dup", F.row_number().over(Window.partitionBy("gutenberg_id").orderBy("topic")))
    h = table(s, d, "documents").select(F.col("source_id").alias("gutenberg_id")).where("gutenberg_id is not null").distinct().withColumn("here", F.lit(True))
    out = F.when(F.col("dup") > 1, "duplicate").when(F.col("c"), "copyright").when(F.col("here"), "on_disk").when(F.col("f"), "retry").otherwise("fetch")
    return u.join(h, "gutenberg_id", "left").groupBy("topic", out.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""WITH {LAST}, c AS (SELECT source_id AS gutenberg_id, count(*) AS chunks, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE source_id IS NOT NULL GROUP BY 1)
SELECT l.gutenberg_id, c.chunks, c.chars, CASE WHEN c.chunks IS NULL THEN NULL ELSE l.split END AS split, CASE WHEN c.chunks IS NULL THEN NULL ELSE l.token_count END AS token_count FROM l LEFT JOIN c ON c.gutenberg_id = l.gutenberg_id""")
def manifest_update(s, d):
    last = M._ranked(man(s, d).where("gutenberg_id is not null"), F.desc("line_no"), F.desc("written_at")).where("__r = 1")
    c = table(s, d, "documents").where("source_id is not null").groupBy(F.col("source_id").alias("gutenberg_id")).agg(F.count("*").alias("chunks"), F.sum("n_chars").alias("chars"))
    has = F.col("chunks").isNotNull()
    return last.join(c, "gutenberg_id", "left").select("gutenberg_id", "chunks", "chars", F.when(has, F.col("split")).alias("split"), F.when(has, F.col("token_count")).alias("token_count"))


@query(f"""WITH {LAST}, b AS (SELECT gutenberg_id, CAST(coalesce(char_count, 0) AS BIGINT) AS weight, md5('1930:' || CAST(gutenberg_id AS VARCHAR)) AS h FROM l WHERE {USABLE}),
a AS (SELECT *, row_number() OVER (ORDER BY h, gutenberg_id) - 1 AS rank, coalesce(sum(weight) OVER (ORDER BY h, gutenberg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS acc_before FROM b)
SELECT gutenberg_id, weight, CAST(rank AS BIGINT) AS rank, CAST(acc_before AS BIGINT) AS acc_before FROM a WHERE acc_before < 0.01 * (SELECT sum(weight) FROM b) OR rank < 8""")
def val_holdout(s, d):
    return M.holdout(M.last_wins(man(s, d)), "gutenberg_id", "char_count")


@query(f"""WITH {LAST}, b AS (SELECT gutenberg_id, title, CAST(coalesce(char_count, 0) AS BIGINT) AS weight, md5('1930:' || CAST(gutenberg_id AS VARCHAR)) AS h FROM l WHERE {USABLE}),
a AS (SELECT *, row_number() OVER (ORDER BY h, gutenberg_id) - 1 AS rank, coalesce(sum(weight) OVER (ORDER BY h, gutenberg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS acc_before FROM b), v AS (SELECT * FROM a WHERE acc_before < 0.01 * (SELECT sum(weight) FROM b) OR rank < 8)
SELECT string_agg(CAST(gutenberg_id AS VARCHAR), ',' ORDER BY gutenberg_id) AS val_book_ids, count(*) AS books, CAST(1930 AS BIGINT) AS seed, 0.01 AS val_frac_target, round(sum(weight) / (SELECT sum(weight) FROM b), 6) AS val_frac_actual_chars FROM v""")
def val_pin(s, d):
    """The held-out books pinned as one JSON record and read back."""
    from textloom.plans.source_queries import _folder
    from textloom.sources.jsonl import append_jsonl

    books, at = M.last_wins(man(s, d)), _folder(s, "val-pin")
    total = books.agg(F.sum(F.coalesce("char_count", F.lit(0))).alias("total"))
    held = M.holdout(books, "gutenberg_id", "char_count")  # about a hundredth of the books
    pin = held.agg(F.array_sort(F.collect_list("gutenberg_id")).alias("val_book_ids"), F.sum("weight").alias("w")).join(F.broadcast(total), F.lit(True))
    append_jsonl(pin.select("val_book_ids", F.lit(1930).cast("bigint").alias("seed"), F.lit(0.01).alias("val_frac_target"), (F.col("w") / F.col("total")).alias("val_frac_actual_chars")), at)
    r = s.read.schema("val_book_ids array<bigint>, seed bigint, val_frac_target double, val_frac_actual_chars double").json(at)
    return r.select(F.array_join(F.col("val_book_ids").cast("array<string>"), ",").alias("val_book_ids"), F.size("val_book_ids").cast("bigint").alias("books"), "seed", "val_frac_target", F.round("val_frac_actual_chars", 6).alias("val_frac_actual_chars"))


@query("""WITH cand AS (SELECT DISTINCT source_id, source_author, source_title FROM cases WHERE source_id IS NOT NULL),
man AS (SELECT gutenberg_id, bool_or(split = 'val') AS v, count(*) AS n FROM manifest GROUP BY 1), held AS (SELECT DISTINCT split_part(source_author, ',', 1) AS surname FROM cases WHERE lower(trim(task)) = 'restoration' AND source_author LIKE '%,%')
SELECT cand.source_id, cand.source_author, cand.source_title, CASE WHEN man.v THEN 'val-book' WHEN held.surname IS NOT NULL THEN 'eval-holdout' WHEN man.n IS NOT NULL THEN 'already-in-corpus' ELSE 'clean' END AS conflict
FROM cand LEFT JOIN man ON man.gutenberg_id = cand.source_id LEFT JOIN held ON held.surname = split_part(cand.source_author, ',', 1)""")
def candidate_conflicts(s, d):
    c = table(s, d, "cases")
    cand = c.where("source_id is not null").select("source_id", "source_author", "source_title").distinct()
    m = man(s, d).groupBy(F.col("gutenberg_id").alias("source_id")).agg(F.bool_or(F.col("split") == "val").alias("v"), F.count("*").alias("n"))
    surname = F.split_part("source_author", F.lit(","), F.lit(1)).alias("surname")
    held = c.where((F.lower(F.trim("task")) == "restoration") & F.col("source_author").contains(",")).select(surname).distinct().withColumn("held", F.lit(True))
    j = cand.join(m, "source_id", "left").withColumn("surname", surname).join(held, "surname", "left")
    tell = F.when(F.col("v"), "val-book").when(F.col("held"), "eval-holdout").when(F.col("n").isNotNull(), "already-in-corpus").otherwise("clean")
    return j.select("source_id", "source_author", "source_title", tell.alias("conflict"))


@query(f"WITH {LAST}, o AS (SELECT gutenberg_id AS id, min(slice) AS slice FROM manifest WHERE status = 'failed' OR is_near_duplicate GROUP BY gutenberg_id) SELECT gutenberg_id, coalesce(o.slice, {CLASS}) AS slice FROM l LEFT JOIN o ON o.id = l.gutenberg_id")
def slice_classify(s, d):
    m = M._ranked(man(s, d).where("gutenberg_id is not null"), F.desc("line_no"), F.desc("written_at")).where("__r = 1")
    over = man(s, d).where("status = 'failed' or is_near_duplicate").groupBy("gutenberg_id").agg(F.min("slice").alias("override"))
    return m.join(over, "gutenberg_id", "left").select("gutenberg_id", M.classify(F.col("authors"), F.col("override"), (*M.REGISTER_AUTHORS, *NAMES)).alias("slice"))


@query(f"""WITH {LAST}, c AS (SELECT coalesce(slice, {CLASS}) AS slice, coalesce(token_count, 0) AS t FROM l WHERE split IS NOT NULL), g AS (SELECT slice, count(*) AS books, CAST(sum(t) AS BIGINT) AS tokens FROM c GROUP BY slice)
SELECT k.slice, coalesce(books, 0) AS books, coalesce(tokens, 0) AS tokens, round(coalesce(tokens, 0) / greatest((SELECT sum(t) FROM c), 1), 6) AS share FROM (SELECT unnest(['backbone', 'register']) AS slice) k LEFT JOIN g ON g.slice = k.slice""")
def slice_summary(s, d):
    m = M._ranked(man(s, d).where("gutenberg_id is not null"), F.desc("line_no"), F.desc("written_at")).where("__r = 1").where("split is not null")
    c = m.select(F.coalesce("slice", M.classify(F.col("authors"), None, (*M.REGISTER_AUTHORS, *NAMES))).alias("slice"), F.coalesce("token_count", F.lit(0)).alias("t"))
    g = c.groupBy("slice").agg(F.count("*").alias("books"), F.sum("t").alias("tokens"))
    dim = s.createDataFrame([("backbone",), ("register",)], "slice string")
    j = dim.join(g, "slice", "left").select("slice", F.coalesce("books", F.lit(0)).alias("books"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    return j.withColumn("share", F.round(F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(1)), 6))


@query("SELECT coalesce(slice, 'backbone') AS slice, count(*) AS documents, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''))) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def slice_tokens(s, d):
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))
    return table(s, d, "documents").groupBy(F.coalesce("slice", F.lit("backbone")).alias("slice")).agg(F.count("*").alias("documents"), F.sum(n).alias("tokens"))
