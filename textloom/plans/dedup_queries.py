"""Near-duplicate and contamination queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import dedup as D
from textloom.plans.registry import query
from textloom.plans.text_queries import VERDICT_SQL, verdicts
from textloom.scratch import written
from textloom.tables import spread, table

SETS_SQL = """
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 20)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT i, j, c / (x.n + y.n - c) AS jaccard FROM p JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE c >= 0.8 * (x.n + y.n - c))
"""


def sets(s, d):
    return D.shingle_sets(spread(table(s, d, "documents").select("doc_id", "text")))


@query(f"""WITH {SETS_SQL}, k AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS k FROM g GROUP BY doc_id), c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep FROM k),
r AS (SELECT DISTINCT rep FROM c), l AS (SELECT i, j FROM e WHERE jaccard < 1 AND i IN (SELECT rep FROM r) AND j IN (SELECT rep FROM r)),
d AS (SELECT x AS rep, count(*) AS links FROM (SELECT i AS x FROM l UNION ALL SELECT j FROM l) GROUP BY 1)
SELECT c.doc_id, c.rep AS class_id, coalesce(d.links, 0) AS links FROM c LEFT JOIN d ON d.rep = c.rep""")
def exact_jaccard_links(s, d):
    members, reps = D.set_classes(sets(s, d))
    links = written(D.exact_pairs(written(reps, "reps")), "links")
    deg = links.select(F.col("i").alias("rep")).union(links.select("j")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(deg, "rep", "left").select(F.col("id").alias("doc_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


@query()
def sampled_shingles(s, d):
    return sets(s, d).select(F.col("id").alias("doc_id"), F.size("sh").alias("shingles"), F.size(D.sampled(F.col("sh"))).alias("sampled"))


@query()
def minhash_signature(s, d):
    return D.signatures(sets(s, d)).select(F.col("id").alias("doc_id"), "n", "n_sample", "sig")


def class_signatures(s, d):
    """Of passages, which hold close copies."""
    _, reps = D.set_classes(D.shingle_sets(spread(table(s, d, "passages").select("id", "text").dropDuplicates(["id"])), "id"))
    reps = written(reps, "reps")
    return reps, written(D.signatures(reps), "signatures")


@query()
def lsh_candidates(s, d):
    return D.lsh_candidates(class_signatures(s, d)[1])


@query()
def signature_prefilter(s, d):
    return D.signature_prefilter(class_signatures(s, d)[1])


@query()
def dedup_candidates(s, d):
    """Candidates of both indexes and of the sparse sizes over class representatives, verified on the full sets."""
    reps, sig = class_signatures(s, d)
    return D.candidates(sig, reps)


@query()
def sparse_signature_pairs(s, d):
    """Classes within a size ratio of which one at least is sparse: partners are counted, not listed."""
    return D.sparse_partners(class_signatures(s, d)[1])


SPARSE_SQL = """
WITH t AS (SELECT gutenberg_id AS id, CAST(max(char_count) AS BIGINT) AS n FROM manifest WHERE char_count > 0 GROUP BY 1)
SELECT a.id, count(b.id) AS partners, coalesce(min(b.id), -1) AS first_partner FROM t a LEFT JOIN t b ON a.id <> b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY a.id
"""


@query(SPARSE_SQL)
def sparse_size_pairs(s, d):
    """Books within a size ratio: all are taken as sparse, partners are counted, not listed."""
    t = table(s, d, "manifest").where("char_count > 0").groupBy(F.col("gutenberg_id").alias("id")).agg(F.max("char_count").alias("n"))
    p = D.sparse_pairs(t.withColumn("n_sample", F.lit(0)))
    both = p.select(F.col("i").alias("id"), F.col("j").alias("o")).union(p.select("j", "i"))
    g = both.groupBy("id").agg(F.count("*").alias("partners"), F.min("o").alias("first_partner"))
    return t.join(g, "id", "left").select("id", F.coalesce("partners", F.lit(0)).alias("partners"), F.coalesce("first_partner", F.lit(-1)).alias("first_partner"))


# Greedy choice by (eligible, bytes, id): the nodes with links one by one, each a representative unless it touches one.
MIS_SQL = VERDICT_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""", {SETS_SQL}, k AS (SELECT v.doc_id AS id, len(kinds) = 0 AS ok, strlen(coalesce(text, '')) AS bytes FROM v JOIN documents t ON t.doc_id = v.doc_id),
s AS (SELECT i AS x, j AS y FROM e UNION ALL SELECT j, i FROM e), a AS (SELECT k.id, k.ok, row_number() OVER (ORDER BY ok DESC, bytes DESC, k.id) AS r, list(y) AS nb FROM k JOIN s ON s.x = k.id GROUP BY k.id, k.ok, k.bytes),
gm(r, reps) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT a.r, CASE WHEN a.ok AND NOT list_has_any(gm.reps, a.nb) THEN list_append(gm.reps, a.id) ELSE gm.reps END FROM gm JOIN a ON a.r = gm.r + 1),
reps AS (SELECT unnest(reps) AS id FROM gm WHERE r = (SELECT max(r) FROM gm)), lost AS (SELECT s.x AS id, arg_min(s.y, b.r) AS representative FROM s JOIN reps ON reps.id = s.y JOIN a b ON b.id = s.y WHERE s.x NOT IN (SELECT id FROM reps) GROUP BY s.x),
roles AS (SELECT n.doc_id, CASE WHEN lost.id IS NOT NULL THEN 'loser' WHEN n.doc_id IN (SELECT representative FROM lost) THEN 'representative' ELSE 'kept' END AS role, representative FROM n LEFT JOIN lost ON lost.id = n.doc_id)
"""


@query(MIS_SQL + "SELECT representative AS rep_id, count(*) AS losers, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS loser_ids FROM roles WHERE role = 'loser' GROUP BY representative")
def dedup_clusters(s, d):
    r = D.near_dedup(verdicts(s, d, ("text",)).select("doc_id", "text", "keep"), F.col("keep"))
    return r.where("role = 'loser'").groupBy(F.col("representative").alias("rep_id")).agg(F.count("*").alias("losers"), F.array_join(F.array_sort(F.collect_set("id")).cast("array<string>"), ",").alias("loser_ids"))


@query(MIS_SQL + "SELECT doc_id, role, representative FROM roles")
def near_dedup(s, d):
    return D.near_dedup(verdicts(s, d, ("text",)).select("doc_id", "text", "keep"), F.col("keep")).select(F.col("id").alias("doc_id"), "role", "representative")


@query(MIS_SQL + """, l AS (SELECT gutenberg_id, prose_filter_pass FROM (SELECT *, row_number() OVER (PARTITION BY gutenberg_id ORDER BY line_no DESC, written_at DESC) AS q FROM manifest WHERE gutenberg_id IS NOT NULL) WHERE q = 1)
SELECT t.doc_id, coalesce(role = 'loser', FALSE) AS is_near_duplicate, representative AS duplicate_of, coalesce(l.prose_filter_pass, k.ok) AS eligible FROM documents t JOIN k ON k.id = t.doc_id LEFT JOIN roles ON roles.doc_id = t.doc_id LEFT JOIN l ON l.gutenberg_id = t.source_id""")
def duplicate_flags(s, d):
    """The losers written back to the documents: what each repeats, and whether it may stand for others (the manifest's own verdict first)."""
    v = verdicts(s, d, ("text",)).select("doc_id", "text", "keep")
    r = D.near_dedup(v, F.col("keep")).select(F.col("id").alias("doc_id"), "role", "representative")
    m = table(s, d, "manifest").where("gutenberg_id is not null").withColumn("q", F.row_number().over(Window.partitionBy("gutenberg_id").orderBy(F.desc("line_no"), F.desc("written_at")))).where("q = 1")
    own = table(s, d, "documents").select("doc_id", F.col("source_id").alias("gutenberg_id")).join(m.select("gutenberg_id", "prose_filter_pass"), "gutenberg_id", "left")
    j = own.join(v.select("doc_id", "keep"), "doc_id").join(r, "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.col("role") == "loser", F.lit(False)).alias("is_near_duplicate"), F.col("representative").alias("duplicate_of"), F.coalesce("prose_filter_pass", "keep").alias("eligible"))


CONTRAST_SQL = """
WITH p AS (SELECT DISTINCT id, text FROM passages WHERE id IS NOT NULL), b AS (SELECT id, min(text) AS text FROM p GROUP BY id),
k AS (SELECT id, text, CASE WHEN id LIKE '%.contrast' THEN left(id, length(id) - 9) ELSE id END AS base, id LIKE '%.contrast' AS c FROM b)
SELECT base, max(CASE WHEN NOT c THEN length(coalesce(text, '')) END) AS target_chars, max(CASE WHEN c THEN length(coalesce(text, '')) END) AS contrast_chars,
CASE WHEN bool_or(c) AND bool_or(NOT c) THEN 'pair' WHEN bool_or(c) THEN 'orphan' ELSE 'single' END AS kind FROM k GROUP BY base
"""


@query(CONTRAST_SQL)
def contrast_pairs(s, d):
    b = table(s, d, "passages").where("id is not null").groupBy("id").agg(F.min("text").alias("text"))
    c = F.col("id").endswith(".contrast")
    n = F.length(F.coalesce("text", F.lit("")))
    k = b.select(F.regexp_replace("id", r"\.contrast$", "").alias("base"), c.alias("c"), n.alias("n"))
    kind = F.when(F.bool_or("c") & F.bool_or(~F.col("c")), "pair").when(F.bool_or("c"), "orphan").otherwise("single")
    return k.groupBy("base").agg(F.max(F.when(~F.col("c"), F.col("n"))).alias("target_chars"), F.max(F.when(F.col("c"), F.col("n"))).alias("contrast_chars"), kind.alias("kind"))


@query("""WITH f AS (SELECT section_file, sha256(string_agg(h, '' ORDER BY id, h)) AS digest, count(*) AS passages FROM (SELECT DISTINCT section_file, id, sha256(id || '|' || coalesce(text, '')) AS h FROM passages) GROUP BY section_file)
SELECT section_file, left(digest, 16) AS digest, passages FROM f""")
def eval_digest(s, d):
    p = table(s, d, "passages").select("section_file", "id", F.sha2(F.concat("id", F.lit("|"), F.coalesce("text", F.lit(""))), 256).alias("h")).distinct()
    g = p.groupBy("section_file").agg(F.array_sort(F.collect_list(F.struct("id", "h"))).alias("l"), F.count("*").alias("passages"))
    return g.select("section_file", F.substring(F.sha2(F.array_join(F.transform("l", lambda x: x["h"]), ""), 256), 1, 16).alias("digest"), "passages")


MATCH_SQL = """
WITH q AS (SELECT DISTINCT id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM passages WHERE text IS NOT NULL), c AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents WHERE text IS NOT NULL),
qg AS (SELECT id, i - 1 AS q_start, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM q WHERE len(w) >= 12)),
cg AS (SELECT doc_id, i - 1 AS c_start, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM c WHERE len(w) >= 12)),
h AS (SELECT id, doc_id, q_start, c_start FROM qg JOIN cg ON qg.g = cg.g)
"""


def matches(s, d, n=12):
    """``(id, doc_id, q_start, c_start)``: equal runs of n words of passages and documents."""
    p = table(s, d, "passages").where("text is not null").select("id", "text").distinct()
    return D.equal_runs(p, spread(table(s, d, "documents").select("doc_id", "text").where("text is not null")), n)


@query(MATCH_SQL + "SELECT id, doc_id, count(*) AS hits, min(q_start) AS first_q, min(c_start) AS first_c FROM h GROUP BY 1, 2")
def ngram_matches(s, d):
    return matches(s, d).groupBy("id", "doc_id").agg(F.count("*").alias("hits"), F.min("q_start").alias("first_q"), F.min("c_start").alias("first_c"))


@query(MATCH_SQL + "SELECT doc_id, count(DISTINCT id) AS items, count(*) AS hits, min(id) AS first_item FROM h GROUP BY doc_id")
def contamination_hits(s, d):
    return matches(s, d).groupBy("doc_id").agg(F.countDistinct("id").alias("items"), F.count("*").alias("hits"), F.min("id").alias("first_item"))


@query(MATCH_SQL + "SELECT count(*) = 0 AS clean, count(*) AS hits, min(id) AS first_item, CAST(min(doc_id) AS BIGINT) AS first_doc FROM h")
def contamination_verdict(s, d):
    """What the guard of :func:`assert_clean` would say."""
    return matches(s, d).agg((F.count("*") == 0).alias("clean"), F.count("*").alias("hits"), F.min("id").alias("first_item"), F.min("doc_id").alias("first_doc"))


@query(VERDICT_SQL + "SELECT doc_id FROM v WHERE len(kinds) = 0")
def quality_kept(s, d):
    return verdicts(s, d).where("keep").select("doc_id")
