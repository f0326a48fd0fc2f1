"""Near-duplicate books: sampled shingles, MinHash candidates, exact verification, clusters.

Texts with one shingle set are compared once: signatures, candidates and
shingle joins run over the classes, and the ids join at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.graph import priority_independent_set
from textloom.scratch import written

# The geometry of the signatures and the thresholds.
PERMUTATIONS, BANDS, ROWS, SHINGLE, MODULUS = 120, 12, 10, 5, 64
JACCARD, FLOOR, SPARSE, PRIME = 0.80, 0.50, 8, (1 << 61) - 1


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, sh)``: sorted distinct hashes of five words, for texts of at least 20 words."""
    w = docs.select(F.col(id_col).alias("id"), T.ascii_words(F.coalesce(text_col, F.lit(""))).alias("w")).where(F.size("w") >= SHINGLE * 4)
    grams = T.run_hashes(F.col("w"), SHINGLE)
    return w.select("id", F.array_sort(F.array_distinct(grams)).alias("sh"))


def sampled(sh: Column) -> Column:
    """The content-defined sample: hashes divisible by the modulus."""
    return F.filter(sh, lambda h: h.bitwiseAND(F.lit(MODULUS - 1)) == 0)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1930)
    return rng.integers(1, PRIME, PERMUTATIONS, dtype=np.uint64), rng.integers(0, PRIME, PERMUTATIONS, dtype=np.uint64)


def _mul_mod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b mod 2^61 - 1 without overflow, for operands below 2^61."""
    lo, hi = b & np.uint64((1 << 31) - 1), b >> np.uint64(31)
    alo, ahi = a & np.uint64((1 << 31) - 1), a >> np.uint64(31)
    mid = ahi * lo + alo * hi
    total = ((ahi * hi) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << np.uint64(31)) + alo * lo
    total = (total & np.uint64(PRIME)) + (total >> np.uint64(61))
    return np.where(total >= np.uint64(PRIME), total - np.uint64(PRIME), total)


def minhash_values(sets: pd.Series) -> pd.Series:
    """min over the set of (a h + b) mod (2^61 - 1) for each permutation; the prime where the set is empty."""
    a, b = _coefficients()
    out = []
    for s in sets:
        if s is None or not len(s):
            out.append(np.full(PERMUTATIONS, PRIME, np.int64))
            continue
        h = np.asarray(s, np.int64).view(np.uint64) % np.uint64(PRIME)
        v = _mul_mod(a[:, None], h[None, :]) + b[:, None]
        out.append(np.where(v >= np.uint64(PRIME), v - np.uint64(PRIME), v).min(1).astype(np.int64))
    return pd.Series(out)


def signatures(sets: DataFrame) -> DataFrame:
    """``(id, n, n_sample, sig)``."""
    kind = dict(sets.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "n": b["n"], "n_sample": b["s"].map(len).astype("int32"), "sig": minhash_values(b["s"])})

    return sets.select("id", F.size("sh").alias("n"), sampled(F.col("sh")).alias("s")).mapInPandas(run, f"id {kind}, n int, n_sample int, sig array<bigint>")


def _pairs(a: DataFrame, on: list[str]) -> DataFrame:
    b = a.select(*on, F.col("id").alias("j"))
    return a.select(*on, F.col("id").alias("i")).join(b, on).where("i < j").select("i", "j").distinct()


def lsh_candidates(sig: DataFrame) -> DataFrame:
    """``(i, j)`` with an equal band of ten rows."""
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(F.slice("sig", k * ROWS + 1, ROWS)).alias("key")) for k in range(BANDS)])
    return _pairs(sig.where("n_sample > 0").select("id", F.explode(bands).alias("b")).select("id", "b.band", "b.key"), ["band", "key"])


def signature_prefilter(sig: DataFrame, floor: float = FLOOR) -> DataFrame:
    """``(i, j, equal)`` with at least ``floor`` of the signature slots equal: an inverted index on (slot, value)."""
    slots = sig.where("n_sample > 0").select("id", F.posexplode("sig").alias("slot", "value"))
    b = slots.select("slot", "value", F.col("id").alias("j"))
    met = slots.select("slot", "value", F.col("id").alias("i")).join(b, ["slot", "value"]).where("i < j")
    return met.groupBy("i", "j").agg(F.count("*").alias("equal")).where(F.col("equal") >= int(np.ceil(floor * PERMUTATIONS)))


def exact_pairs(sets: DataFrame, jaccard: float = JACCARD, hot: int = 64, send: int = 200_000) -> DataFrame:
    """``(i, j, jaccard)`` of all pairs of sets at or above the threshold: exact prefix-filtered join.

    Of each set, in one order of all shingles, only the first n - ceil(t n) + 1
    are joined: two sets at t share one of them. The order is that of the
    hashes, in which the sets are sorted already, but for shingles that more
    than ``hot`` prefixes hold: they come last, and only the sets with such a
    one in their prefix are put in order anew. Pairs that meet are verified on
    the full sets.
    """
    keep = (F.col("n") - F.ceil(F.lit(jaccard) * F.col("n")) + 1).cast("int")
    sized = sets.select("id", "sh", F.size("sh").alias("n"))
    first = written(sized.select("id", "n", F.explode(F.slice("sh", F.lit(1), keep)).alias("g")), "dedup-prefixes")
    common = written(first.groupBy("g").agg(F.count("*").alias("f")).where(F.col("f") > hot).select("g"), "dedup-common")
    few = common.count() <= send
    common = F.broadcast(common) if few else common
    late = written(first.join(common, "g", "left_semi").select("id").distinct(), "dedup-late")
    anew = sized.join(F.broadcast(late) if late.count() <= send else late, "id", "left_semi").select("id", "n", F.explode("sh").alias("g"))
    last = common.withColumn("last", F.lit(True))
    ordered = anew.join(last, "g", "left").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("last", F.lit(False)).alias("last"), "g"))).alias("o"))
    put = ordered.select("id", "n", F.explode(F.transform(F.slice("o", F.lit(1), keep), lambda x: x["g"])).alias("g"))
    kept = first.join(F.broadcast(late) if late.count() <= send else late, "id", "left_anti").select("id", "n", "g")
    prefix = written(kept.union(put), "dedup-joined")
    shared = prefix.groupBy("g").agg(F.count("*").alias("f")).where("f > 1").select("g")
    prefix = prefix.join(shared, "g", "left_semi")
    b = prefix.select("g", F.col("id").alias("j"), F.col("n").alias("m"))
    near = F.least("n", "m") >= F.lit(jaccard) * F.greatest("n", "m")
    met = prefix.select("g", F.col("id").alias("i"), "n").join(b, "g").where((F.col("i") < F.col("j")) & near).select("i", "j").distinct()
    return verify(met, sets, jaccard)


def equal_runs(items: DataFrame, corpus: DataFrame, n: int, send: int = 2_000_000) -> DataFrame:
    """``(id, doc_id, q_start, c_start)``: runs of n words that stand in an item (id, text) and in a document (doc_id, text).

    Runs are joined on 128 bits of hashes. Of the corpus only the runs that
    some item holds leave their task: their hashes are sent to all tasks, if
    they are no more than ``send``, and joined by shuffle otherwise.
    """

    def runs(t: DataFrame, key: str, at: str) -> DataFrame:
        w = t.select(key, T.ascii_words(F.col("text")).alias("w")).where(F.size("w") >= n)
        both = F.arrays_zip(T.run_hashes(F.col("w"), n).alias("g"), T.run_hashes(F.col("w"), n, 1).alias("k"))
        return w.select(key, F.posexplode(both).alias(at, "x")).select(key, at, "x.g", "x.k")

    q = written(runs(items, "id", "q_start"), "run-items")
    wanted = written(q.select("g").distinct(), "run-hashes")
    wanted = F.broadcast(wanted) if wanted.count() <= send else wanted
    hits = runs(corpus, "doc_id", "c_start").join(wanted, "g", "left_semi")
    return hits.join(q, ["g", "k"]).select("id", "doc_id", "q_start", "c_start")


def assert_clean(items: DataFrame, corpus: DataFrame, n: int = 12) -> None:
    """RuntimeError with the number of matches and the first of them, if any item shares a run of n words with the corpus."""
    hits = written(equal_runs(items, corpus, n), "run-hits")
    if not hits.isEmpty():
        first = hits.orderBy("id", "doc_id", "q_start", "c_start").first()
        raise RuntimeError(f"{hits.count()} runs of {n} words stand in the corpus; the first: item {first['id']!r} at {first['q_start']} in document {first['doc_id']!r} at {first['c_start']}")


def verify(pairs: DataFrame, sets: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """``(i, j, jaccard)`` of the pairs whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("id").alias("i"), F.col("sh").alias("a")), "i").join(sets.select(F.col("id").alias("j"), F.col("sh").alias("b")), "j")
    c = F.size(F.array_intersect("a", "b"))
    j = c / (F.size("a") + F.size("b") - c)
    return both.select("i", "j", j.alias("jaccard")).where(F.col("jaccard") >= jaccard)


def sparse_pairs(sig: DataFrame, ratio: float = JACCARD) -> DataFrame:
    """``(i, j)`` where either side has few sampled shingles and the sizes are within the ratio.

    A theta join on sizes, as buckets of a geometric scale: neighbours differ by
    at most one bucket.
    """
    step = float(np.log(1 / ratio))
    k = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / step).cast("int")
    a = sig.select("id", "n", (F.col("n_sample") < SPARSE).alias("sparse"), k.alias("k"))
    left = a.select(F.col("id").alias("i"), F.col("n").alias("n1"), F.col("sparse").alias("s1"), F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))
    right = a.select(F.col("id").alias("j"), F.col("n").alias("n2"), F.col("sparse").alias("s2"), "k")
    return left.join(right, "k").where((F.col("i") < F.col("j")) & (F.col("s1") | F.col("s2")) & (F.least("n1", "n2") >= F.lit(ratio) * F.greatest("n1", "n2"))).select("i", "j").distinct()


def sparse_partners(sig: DataFrame, ratio: float = JACCARD) -> DataFrame:
    """``(id, partners, first_partner)``: the pairs of :func:`sparse_pairs` counted by id, all ids kept.

    A pair is decided by sizes and sparseness alone, so groups of equal
    (n, sparse) are joined in place of the ids: their number is bounded by the
    sizes that occur, and the pairs, a square of the ids, are never listed.
    """
    a = sig.select("id", F.col("n").cast("bigint").alias("n"), (F.col("n_sample") < SPARSE).alias("sparse"))
    g = a.groupBy("n", "sparse").agg(F.count("*").alias("c"), F.min("id").alias("low"))
    # The least id but one stands in where the least is the id itself.
    second = a.join(g, ["n", "sparse"]).where(F.col("id") > F.col("low")).groupBy("n", "sparse").agg(F.min("id").alias("second"))
    g = written(g.join(second, ["n", "sparse"], "left"), "sparse-groups")
    x, y = g.select("n", F.col("sparse").alias("sparse"), "low"), g.select(F.col("n").alias("m"), F.col("sparse").alias("other"), F.col("c"), F.col("low").alias("l"), "second")
    met = x.join(y, (F.least("n", "m") >= F.lit(ratio) * F.greatest("n", "m")) & (F.col("sparse") | F.col("other")))
    own = (F.col("n") == F.col("m")) & (F.col("sparse") == F.col("other"))
    found = met.groupBy("n", "sparse").agg(
        (F.sum("c") - F.sum(own.cast("int"))).alias("partners"),
        F.min(F.when(~own, F.col("l"))).alias("apart"),
        F.min(F.when(own, F.col("l"))).alias("first"),
        F.min(F.when(own, F.col("second"))).alias("second"),
    )
    same = F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return a.join(found, ["n", "sparse"], "left").select("id", F.coalesce("partners", F.lit(0)).alias("partners"), F.least("apart", same).alias("first_partner"))


def candidates(sig: DataFrame, sets: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """``(i, j, jaccard)`` of the union of the three candidate sources, verified on the full sets.

    The sparse source alone is a square of the sets. What verification leaves
    of it are the similar pairs with a sparse side, since a similar pair is
    within the size ratio too; the exact prefix join gives just these.
    """
    met = verify(lsh_candidates(sig).union(signature_prefilter(sig).select("i", "j")).distinct(), sets, jaccard)
    side = lambda k: sig.select(F.col("id").alias(k), (F.col("n_sample") < SPARSE).alias(f"sparse_{k}"))
    sparse = exact_pairs(sets, jaccard).join(side("i"), "i").join(side("j"), "j").where("sparse_i or sparse_j").select("i", "j", "jaccard")
    return met.union(sparse).dropDuplicates(["i", "j"])


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, reps)``: ids with equal shingle sets form a class, named by its smallest id."""
    keyed = written(sets.withColumn("key", F.sha2(F.array_join("sh", ","), 256)), "dedup-sets")
    rep = keyed.groupBy("key").agg(F.min("id").alias("rep"))
    members = keyed.select("id", "key").join(rep, "key").select("id", "rep")
    return members, keyed.join(rep.select(F.col("rep").alias("id"), "key"), ["id", "key"], "left_semi").select("id", "sh")


def edges_by_class(sets: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """``(i, j)``: links between class representatives, and of each copy to its representative."""
    members, reps = set_classes(sets)
    links = exact_pairs(written(reps, "dedup-reps"), jaccard).select("i", "j")
    return links.union(members.where("id <> rep").select(F.col("rep").alias("i"), F.col("id").alias("j")))


def near_dedup(docs: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, role, representative)``: which documents go, and whose near-duplicates they are.

    Representatives are picked by (eligible, bytes descending, id): the
    lexicographically first maximal independent set over direct links. A copy
    shares its class's links, so a class acts through its best member, and the
    other members are losers of that member.
    """
    sets = written(shingle_sets(docs, id_col, text_col), "dedup-shingles")
    members, reps = set_classes(sets)
    members = written(members, "dedup-members")
    links = exact_pairs(written(reps, "dedup-reps")).select("i", "j")
    rank = docs.select(F.col(id_col).alias("id"), eligible.alias("eligible"), F.octet_length(F.coalesce(text_col, F.lit(""))).alias("bytes"))
    order = F.struct((~F.col("eligible")).alias("x"), (-F.col("bytes")).alias("b"), F.col("id"))
    ranked = rank.join(members, "id").withColumn("order", order)
    heads = ranked.groupBy("rep").agg(F.min("order").alias("o"))
    nodes = heads.select(F.col("rep").alias("node"), F.col("o").alias("rank"), (~F.col("o.x")).alias("eligible"), F.col("o.id").alias("best"))
    nodes = written(nodes, "dedup-nodes")
    mis = priority_independent_set(nodes, links.select(F.col("i").alias("src"), F.col("j").alias("dst")))
    named = mis.join(nodes.select("node", "best", F.col("eligible").alias("ok")), "node").join(nodes.select(F.col("node").alias("representative"), F.col("best").alias("head")), "representative", "left")
    out = members.join(named.select(F.col("node").alias("rep"), "role", "best", "head", "ok"), "rep")
    head = F.coalesce("head", F.when(F.col("ok") & (F.col("id") != F.col("best")), F.col("best")))
    twins = members.groupBy("rep").agg((F.count("*") > 1).alias("twins"))
    role = F.when(head.isNotNull(), "loser").when((F.col("role") == "representative") | (F.col("ok") & F.col("twins")), "representative").otherwise("kept")
    return out.join(twins, "rep").select("id", role.alias("role"), head.alias("representative"))

