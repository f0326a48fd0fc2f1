import random
import re

import numpy as np

from textloom.llm import leaks as L
from textloom.llm import neardup as D

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(6)) for _ in range(400)]


def prose(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def edited(w, k):
    w = list(w)
    for _ in range(k):
        w[RNG.randrange(len(w))] = "edit"
    return w


def jaccard(a, b, n):
    x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_sampling_agrees_with_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 300, dtype=np.int64)
    w = rng.uniform(0.5, 5, 300)
    a, b = np.arange(0, 200), np.arange(60, 300)
    sh, lw = np.r_[h[a], h[b]], np.log(np.r_[w[a], w[b]]).astype(np.float32)
    keys = D.band_keys(sh, lw, np.array([0, 200]), 1500, 1)
    want = w[60:200].sum() / w.sum()
    assert abs((keys[0] == keys[1]).mean() - want) < 0.05


def test_pairs_equal_brute_force(spark):
    rows, texts = [], {}
    for i in range(25):
        base = prose(100)
        for j in range(4):
            texts[f"{i}.{j}"] = edited(base, j * 3)
    texts["copy"] = texts["0.0"]
    rows = [(k, " ".join(w).upper() + "!", "x", 1) for k, w in texts.items()]
    rows += [rows[0], ("null", None, "x", 1), ("blank", "  ", "x", 1), ("short", "a b", "x", 1), (None, "a b c d e", "x", 1), ("long", " ".join(prose(30000)), "x", 1)]
    df = spark.createDataFrame(rows, "id string, text string, key string, n int")
    ids = sorted(texts)
    want = {(a, b) for a in ids for b in ids if a < b and jaccard(texts[a], texts[b], 3) >= 0.7}
    got = {(r["id_a"], r["id_b"]) for r in D.near_duplicate_pairs(df, "id", "text", D.PASSAGES).collect()}
    assert got == want
    g = {r["id"]: r for r in D.near_duplicate_groups(df, "id", "text").collect()}
    assert g["copy"]["class_id"] == "0.0" and "null" not in g and g["long"]["links"] == 0
    assert D.near_duplicate_pairs(df.limit(0), "id", "text", D.PASSAGES).count() == 0
    assert D.near_duplicate_groups(df.limit(0), "id", "text").count() == 0


def test_large_family_of_close_copies_is_whole(spark):
    # All texts are copies of one: what they share weighs ln 2, each edit ln(1 + N), and a pair at 0.7 is at about 0.27 by weight.
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(157)]
    texts = {}
    for i in range(80):
        w = list(base)
        for k in range(4 + i % 2):
            w[rng.randrange(157)] = f"own{i}x{k}"
        texts[f"{i:02}"] = w
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "id string, text string")
    ids = sorted(texts)
    want = {(a, b) for a in ids for b in ids if a < b and jaccard(texts[a], texts[b], 3) >= 0.7}
    got = {(r["id_a"], r["id_b"]) for r in D.near_duplicate_pairs(df, "id", "text", D.PASSAGES).collect()}
    assert len(want) > 100 and got == want


def test_titles(spark):
    t = spark.createDataFrame([(1, "The Lantern of Ombersley"), (2, "THE LANTERN, OF OMBERSLEY"), (3, "Lantern of Ombersley, The"), (4, "A Net for Sheaves"), (5, None), (6, "?")], "source_id bigint, source_title string")
    got = {(r["id_a"], r["id_b"]) for r in D.near_duplicate_pairs(t, "source_id", "source_title", D.TITLES).collect()}
    assert got == {("1", "2"), ("1", "3"), ("2", "3")}


def words(x):
    return re.findall(r"[^\W_]+", (x or "").lower())


def brute(docs, items, subs=0):
    out = set()
    for d, t in docs:
        a = words(t)
        for f, i, u in items:
            b = words(u)
            hit = any(sum(x != y for x, y in zip(a[p : p + 12], b[q : q + 12])) <= subs for p in range(len(a) - 11) for q in range(len(b) - 11))
            if hit and d is not None:
                out.add((d, f, i))
    return out


def test_leaks_equal_brute_force_also_with_hot_seeds(spark):
    items, docs = [], []
    for k in range(12):
        w = prose(20)
        items.append(("target" if k % 2 else "text", f"i{k}", " ".join(w)))
        for n in (11, 12, 15):
            a = RNG.randrange(0, 20 - n + 1)
            run = w[a : a + n]
            docs.append((len(docs), " ".join(prose(8)) + ", " + "_".join(run).upper() + " " + " ".join(prose(5))))
        sub = list(w)
        sub[10] = "replaced"
        docs.append((len(docs), " ".join(sub[4:18])))
    phrase = " ".join(prose(9))
    docs += [(1000 + k, f"{' '.join(prose(6))} {phrase} {' '.join(prose(6))}") for k in range(10)]
    items += [("prompt", f"h{k}", f"{' '.join(prose(6))} {phrase} {' '.join(prose(6))}") for k in range(10)]
    docs += [(2000, None), (2001, ""), (2002, docs[1][1])]
    items += [("text", "none", None), items[0], ("prompt", "same", items[0][2])]
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_field string, item_id string, text string")
    for s in (L.Settings(), L.Settings(hot_pairs=3, send_keys=2), L.TOLERANT, L.Settings(max_subs=1, masks=L.TOLERANT.masks, hot_pairs=1), L.Settings(max_subs=1, masks=L.TOLERANT.masks, hot_pairs=1, send_keys=0)):
        got = {(r["doc_id"], r["item_field"], r["item_id"]) for r in L.leaked_items(dd, ii, s).collect()}
        assert got == brute(docs, items, s.max_subs), s
    assert L.leaked_items(dd.limit(0), ii).count() == 0 == L.leaked_items(dd, ii.limit(0)).count()


def test_an_id_with_a_copy_keeps_its_other_text(spark):
    a, b = " ".join(prose(20)), " ".join(prose(20))
    dd = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id bigint, text string")
    ii = spark.createDataFrame([("text", "x", b), ("text", "y", a)], "item_field string, item_id string, text string")
    got = {tuple(r) for r in L.leaked_items(dd, ii).collect()}
    assert got == {(1, "text", "y"), (2, "text", "y"), (2, "text", "x")}


def _spread(spark, n=60):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        base = [rng.choice(WORDS) for _ in range(60)]
        rows += [(f"{i:02}a", base), (f"{i:02}b", edited(base, 2)), (f"{i:02}c", base + [rng.choice(WORDS) for _ in range(10)])]
    return rows, spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "id string, text string")


def test_groups_are_those_of_exact_weights(spark):
    rows, df = _spread(spark)
    sets = {k: {} for k, _ in rows}
    for k, w in rows:
        for i in range(len(w) - 4):
            g = tuple(w[i : i + 5])
            sets[k][g] = sets[k].get(g, 0) + 1
    df_of = {}
    for v in sets.values():
        for g in v:
            df_of[g] = df_of.get(g, 0) + 1
    for rarest in (1024, 30):
        weigh = {k: {g: (1 + np.log(c)) * np.log(1 + min(len(rows) / df_of[g], rarest)) for g, c in v.items()} for k, v in sets.items()}
        want = dict.fromkeys(sets, 0)
        ids = sorted(sets)
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                x, y = weigh[a], weigh[b]
                low = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
                if low and (low / (sum(x.values()) + sum(y.values()) - low) >= 0.8 or len(x.keys() & y.keys()) >= 0.8 * len(x.keys() | y.keys())):
                    want[a] += 1
                    want[b] += 1
        for hot in (500, 1):
            got = {r["id"]: r["links"] for r in D.near_duplicate_groups(df, "id", "text", D.Settings(weighted=0.8, rarest=rarest, hot=hot)).collect()}
            assert got == want and sum(want.values()) > 50


def test_hot_bands_lose_no_pair(spark):
    rows, df = _spread(spark)
    ids, texts = sorted(k for k, _ in rows), dict(rows)
    want = {(a, b) for a in ids for b in ids if a < b and jaccard(texts[a], texts[b], 3) >= 0.7}
    for hot in (500, 1):
        s = D.Settings(unit="word", size=3, jaccard=0.7, bands=24, rows=1, plain_bands=24, hot=hot)
        assert {(r["id_a"], r["id_b"]) for r in D.near_duplicate_pairs(df, "id", "text", s).collect()} == want
