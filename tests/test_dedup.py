import random

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import dedup as D


def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(120)] for _ in range(6)]
    out = []
    for i, b in enumerate(base):
        out.append((i * 10, " ".join(b)))
        edited = list(b)
        for k in range(i):
            edited[k * 20] = "changed"
        out.append((i * 10 + 1, " ".join(edited)))
    return [*out, (100, out[0][1]), (101, "too short"), (102, None), (103, "")]


def brute(rows, t=0.8):
    import re

    sets = {}
    for i, x in rows:
        w = re.findall("[a-z0-9']+", (x or "").lower())
        if len(w) >= 20:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def test_exact_pairs_equal_brute_force(spark):
    rows = texts()
    s = D.shingle_sets(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r["i"], r["j"]) for r in D.exact_pairs(s).collect()} == brute(rows)


def test_signature_candidates_hold_the_equal_sets(spark):
    s = D.shingle_sets(spark.createDataFrame(texts(), "doc_id bigint, text string"))
    sig = D.signatures(s)
    both = {(r["i"], r["j"]) for r in D.lsh_candidates(sig).collect()}, {(r["i"], r["j"]) for r in D.signature_prefilter(sig).collect()}
    sampled = {r["id"] for r in sig.where("n_sample > 0").collect()}
    for c in both:
        assert not {0, 100} <= sampled or (0, 100) in c


def test_modular_product_is_exact():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, D.PRIME, 200, dtype=np.uint64) for _ in range(2))
    assert [int(x) for x in D._mul_mod(a, b)] == [int(x) * int(y) % D.PRIME for x, y in zip(a, b)]


def test_sparse_boundary(spark):
    sig = spark.createDataFrame([(0, 100, 7), (1, 105, 8), (2, 500, 20)], "id bigint, n int, n_sample int")
    assert {(r["i"], r["j"]) for r in D.sparse_pairs(sig).collect()} == {(0, 1)}


def test_candidates_hold_the_sparse_pairs(spark):
    # Texts of 30 words have 26 shingles, of which the sample often takes none.
    rng = random.Random(5)
    rows = texts()
    for i in range(200, 260, 2):
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
        rows += [(i, " ".join(w)), (i + 1, " ".join([*w[:-1], "changed"]))]
    _, reps = D.set_classes(D.shingle_sets(spark.createDataFrame(rows, "doc_id bigint, text string")))
    sig = D.signatures(reps)
    sampled = {r["id"]: r["n_sample"] for r in sig.collect()}
    got = {(r["i"], r["j"]): r["jaccard"] for r in D.candidates(sig, reps).collect()}
    want = {(a, b) for a, b in brute(rows) if a in sampled and b in sampled}
    assert any(max(sampled[a], sampled[b]) == 0 for a, b in want) and all(min(sampled[a], sampled[b]) < D.SPARSE for a, b in want)
    assert set(got) == want and all(x >= D.JACCARD for x in got.values())


def test_sparse_partners_count_the_sparse_pairs(spark):
    rng = random.Random(6)
    sig = spark.createDataFrame([(i, rng.randrange(20, 90), rng.choice([0, 7, 8, 9, 20])) for i in range(200)] + [(900, 5000, 0), (901, 6000, 80)], "id bigint, n int, n_sample int")
    want = {r["id"]: [] for r in sig.collect()}
    for r in D.sparse_pairs(sig).collect():
        want[r["i"]].append(r["j"])
        want[r["j"]].append(r["i"])
    got = {r["id"]: (r["partners"], r["first_partner"]) for r in D.sparse_partners(sig).collect()}
    assert got == {i: (len(p), min(p, default=None)) for i, p in want.items()}


def test_clean_beats_longer_and_dirty_stay(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base + " extra words at the end", False), (2, base, True), (3, " ".join(f"v{i}" for i in range(50)), False), (4, " ".join(f"v{i}" for i in range(50)), False)]
    got = {r["id"]: (r["role"], r["representative"]) for r in D.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, ok boolean"), F.col("ok")).collect()}
    assert got[2] == ("representative", None) and got[1] == ("loser", 2)
    assert got[3] == ("kept", None) == got[4]


def test_exact_pairs_with_hot_shingles_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    frame = [word() for _ in range(40)]
    rows = []
    for i in range(30):
        own = [word() for _ in range(rng.choice([4, 8, 40]))]
        rows.append((i, " ".join(frame + own)))
        if i % 3 == 0:
            rows.append((100 + i, " ".join(frame + own[:-1] + ["changed"])))
    s = D.shingle_sets(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute(rows)
    for hot, send in ((64, 200_000), (3, 200_000), (3, 0)):
        assert {(r["i"], r["j"]) for r in D.exact_pairs(s, hot=hot, send=send).collect()} == want and want


def test_equal_runs(spark):
    q = spark.createDataFrame([("q", "one two three four"), ("short", "one"), ("none", "five six seven"), ("null", None)], "id string, text string")
    c = spark.createDataFrame([(1, "zero one TWO three, four two three four"), (2, None), (3, "")], "doc_id int, text string")
    for send in (100, 0):
        got = {tuple(r) for r in D.equal_runs(q, c, 3, send).select("id", "doc_id", "q_start", "c_start").collect()}
        assert got == {("q", 1, 0, 1), ("q", 1, 1, 2), ("q", 1, 1, 5)}
