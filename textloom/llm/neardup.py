"""Near-duplicate records: consistent weighted sampling over TF-IDF shingles.

1. Shingles of a text are runs of ``size`` words (or characters); texts with
   one and the same shingle set form a class, and only the class is compared.
2. A shingle weighs (1 + ln tf) * ln(1 + min(N / df, ``rarest``)). Document
   frequencies are exact, over all classes, by a hash-partitioned aggregate;
   only the shingles of more than one in ``rarest`` texts are sent to the tasks,
   at most ``rarest`` times as many as a text holds on average, however large
   the collection is. A rarer shingle tells no more than one of that frequency,
   so weights don't drift as the collection grows.
3. Improved consistent weighted sampling draws ``bands * rows`` samples from
   the weighted set; two sets agree in a sample with a probability equal to
   their weighted Jaccard similarity. Bands of ``rows`` samples are join keys.
4. Classes that meet in a band are verified: by weighted Jaccard similarity,
   where ``weighted`` is set, or by the share of common distinct shingles. A
   band of more than ``hot`` classes is split by size on a geometric scale,
   which loses no similar pair: their sizes (or total weights) are as near as
   the threshold says.

The uniform draws of a (sample, shingle) come from a table of 2^16 triples that
each sample addresses through its own hash of the shingle: fixed, the same on
every machine, and some ten times cheaper than drawing anew.

Defined results: null, blank and too short texts have no shingles and belong
to no class; repeated rows are one record; ids whose texts are alike share a
class; an empty table gives empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.tokens import mix, windows, word_hashes
from textloom.operators.graph import connected_components
from textloom.scratch import written

_NOT_ALNUM = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Settings:
    """What counts as similar, and how candidates are drawn."""

    unit: str = "word"  # or "char": characters of the text stripped to letters and digits
    size: int = 5
    jaccard: float = 0.8  # least share of common distinct shingles
    weighted: float | None = None  # least weighted Jaccard similarity, which makes a pair similar as well
    bands: int = 20
    rows: int = 3
    #: Bands drawn without weights: a pair at ``jaccard`` is missed with at most (1 - jaccard^rows)^plain_bands, here 0.512: < 0.0001 %.
    plain_bands: int = 20
    rarest: int = 1024
    hot: int = 500


#: Passages, as p3_found defines them, by the sets alone: a pair at 0.7 is missed with at most (1 - 0.7^3)^24 < 0.005 % whatever its
#: weighted similarity; the weighted bands alone would miss one of weighted similarity w with (1 - w^3)^24, half of them at w = 0.3.
PASSAGES = Settings(unit="word", size=3, jaccard=0.7, bands=24, rows=3, plain_bands=24)
#: Titles: a pair at 0.6 is missed with at most (1 - 0.6^4)^120 < 0.00001 %, by the weighted bands alone with (1 - w^4)^120.
TITLES = Settings(unit="char", size=3, jaccard=0.6, bands=120, rows=4, plain_bands=120)
#: Groups of passages: five words, similar by weight or by the sets; a pair at 0.8 by weight is missed with at most (1 - 0.8^3)^20 < 0.0001 %.
GROUPS = Settings(weighted=0.8)

FEATURES = "id string, key binary, n int, sh array<bigint>, tf array<int>"


def shingles(texts: list[str | None], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, tf, end)`` of the distinct shingles of each text, sorted within a text."""
    if s.unit == "word":
        h, ends = word_hashes(texts)
    else:
        bare = [_NOT_ALNUM.sub("", t.lower()) if t else "" for t in texts]
        ends = np.cumsum([len(t) for t in bare]) if bare else np.empty(0, np.int64)
        h = mix(np.frombuffer("".join(bare).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    g, doc, _ = windows(h, np.asarray(ends, np.int64), range(s.size), s.size)
    if not len(g):
        return g, np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    first = np.r_[True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(first)
    tf = np.diff(np.r_[at, len(g)]).astype(np.int32)
    return g[at], tf, np.searchsorted(doc[at], np.arange(len(texts)), side="right")


def _features(s: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g, tf, ends = shingles(b["text"].tolist(), s)
            starts = np.r_[0, ends[:-1]] if len(ends) else ends
            sh = g.view(np.int64)
            keep = np.flatnonzero(ends > starts)
            if not len(keep):
                continue
            # The class key: two sums of scrambled hashes, alike for equal sets whatever the order.
            a, c = mix(g + np.uint64(7)), mix(g ^ np.uint64(0x5DEECE66D))
            ka, kc = np.r_[np.uint64(0), np.cumsum(a)], np.r_[np.uint64(0), np.cumsum(c)]
            ka, kc = ka[ends] - ka[starts], kc[ends] - kc[starts]
            yield pd.DataFrame(
                {
                    "id": b["id"].values[keep],
                    "key": [x.tobytes() for x in np.stack([ka, kc, (ends - starts).astype(np.uint64)], 1)[keep]],
                    "n": (ends - starts)[keep].astype(np.int32),
                    "sh": [sh[starts[i] : ends[i]] for i in keep],
                    "tf": [tf[starts[i] : ends[i]] for i in keep],
                }
            )

    return run


def common_shingles(reps: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray, int]:
    """``(hashes, frequencies, N)``: the shingles of more than one in ``rarest`` classes, by hash."""
    total = reps.count()
    counts = reps.select(F.explode("sh").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    # At most rarest * (shingles of an average class) rows: a bound that the collection's size doesn't move.
    found = counts.where(F.col("df") * s.rarest > total).toPandas().sort_values("h")
    return found["h"].to_numpy(np.int64), found["df"].to_numpy(np.float64), total


@lru_cache(maxsize=2)
def _draws(seed: int = 1930) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """2^16 triples: r ~ Gamma(2, 1), ln c with c ~ Gamma(2, 1), beta ~ Uniform(0, 1)."""
    rng = np.random.default_rng(seed)
    n = 1 << 16
    return tuple(x.astype(np.float32) for x in (rng.gamma(2.0, 1.0, n), np.log(rng.gamma(2.0, 1.0, n)), rng.random(n)))


def band_keys(sh: np.ndarray, log_weight: np.ndarray, starts: np.ndarray, bands: int, rows: int, first: int = 0) -> np.ndarray:
    """Band keys, one row a text, of texts whose shingles lie in a row from ``starts`` on.

    A sample of a text is the shingle k with the least
    ln a_k = ln c_k - r_k * (t_k - beta_k + 1), t_k = floor(ln w_k / r_k + beta_k),
    together with t_k. ``first`` numbers the first band; other numbers draw other samples.
    """
    gamma_r, log_c, beta = _draws()
    u = sh.view(np.uint64)
    lengths = np.diff(np.r_[starts, len(sh)])
    out = np.empty((len(starts), bands), np.int64)
    for band in range(first, first + bands):
        key = np.full(len(starts), band + 1, np.uint64)
        for row in range(rows):
            k = band * rows + row
            salt = mix(np.array([k * 2 + 1], np.uint64))[0] | np.uint64(1)
            at = ((u * salt) >> np.uint64(48)).astype(np.intp)
            r = gamma_r[at]
            t = np.floor(log_weight / r + beta[at])
            a = log_c[at] - r * (t - beta[at] + np.float32(1))
            low = np.minimum.reduceat(a, starts)
            hit = np.flatnonzero(a == np.repeat(low, lengths))
            # Among equal minima, which only hash collisions bring, the smallest hash counts.
            doc = np.searchsorted(starts, hit, side="right") - 1
            hit = hit[np.r_[True, doc[1:] != doc[:-1]]]
            key = mix(key * np.uint64(0x100000001B3) + mix(u[hit] + t[hit].astype(np.int64).view(np.uint64)))
        out[:, band - first] = key.view(np.int64)
    return out


def _weights(sh: np.ndarray, tf: np.ndarray, common: tuple[np.ndarray, np.ndarray, int], rarest: int) -> np.ndarray:
    h, df, total = common
    ratio = np.full(len(sh), float(rarest))
    if len(h):
        at = np.minimum(np.searchsorted(h, sh), len(h) - 1)
        hit = h[at] == sh
        ratio[hit] = np.minimum(total / df[at[hit]], rarest)
    return (1 + np.log(np.maximum(tf, 1))) * np.log(1 + ratio)


def classes(df: DataFrame, id_col: str, text_col: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """``(members, reps)``: ``(id, rep)`` of every text with shingles, and the classes' features."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    feats = written(rows.mapInPandas(_features(s), FEATURES), "dup-features")
    members = feats.select("id", "key").distinct()
    rep = members.groupBy("key").agg(F.min("id").alias("rep"))
    first = feats.join(rep.select(F.col("key"), F.col("rep").alias("id")), ["key", "id"], "left_semi").dropDuplicates(["key"])
    reps = written(first.select(F.col("id").alias("rep"), "key", "n", "sh", "tf"), "dup-classes")
    return members.join(rep, "key").select("id", "key", "rep"), reps


def similar_classes(reps: DataFrame, s: Settings) -> DataFrame:
    """``(key_a, key_b, jaccard, weighted)`` of the class pairs that are similar enough."""
    sent = reps.sparkSession.sparkContext.broadcast(common_shingles(reps, s))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in np.array_split(np.arange(len(b)), max(1, -(-len(b) // 512))):
                if not len(part):
                    continue
                sub = b.iloc[part]
                sh = np.concatenate(sub["sh"].values)
                w = _weights(sh, np.concatenate(sub["tf"].values), sent.value, s.rarest)
                starts = np.r_[0, np.cumsum(sub["n"].values)[:-1]].astype(np.intp)
                keys = band_keys(sh, np.log(w).astype(np.float32), starts, s.bands, s.rows)
                plain = band_keys(sh, np.zeros(len(sh), np.float32), starts, s.plain_bands, s.rows, s.bands)
                yield pd.DataFrame({"key": sub["key"].values, "n": sub["n"].astype(float).values, "w": np.add.reduceat(w, starts), "bands": list(keys), "plain": list(plain)})

    signed = written(reps.select("key", "n", "sh", "tf").mapInPandas(sign, "key binary, n double, w double, bands array<bigint>, plain array<bigint>"), "dup-bands")

    def side(size: str, least: float, bands: str) -> DataFrame:
        step = F.floor(F.log(size) / math.log(1 / least)).cast("int") if least < 1 else F.lit(0)
        return signed.select("key", F.col(size).alias("size"), F.lit(least).alias("least"), step.alias("step"), F.explode(bands).alias("band"))

    keyed = side("n", s.jaccard, "bands" if s.weighted is None else "plain")
    keyed = keyed.union(side("n", s.jaccard, "plain") if s.weighted is None else side("w", s.weighted, "bands"))
    # Bands that one class alone has are dropped before the join; hot ones are split by size.
    shared = keyed.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band", (F.col("c") > s.hot).alias("hot"))
    keyed = written(keyed.join(shared, "band"), "dup-shared")
    step = F.when(F.col("hot"), F.col("step")).otherwise(0)
    a = keyed.select("band", "key", "size", "least", F.explode(F.when(F.col("hot"), F.array(F.col("step"), F.col("step") + 1)).otherwise(F.array(F.lit(0)))).alias("step")).alias("a")
    b = keyed.select("band", "key", "size", step.alias("step")).alias("b")
    # The first is the smaller, and not too small; neighbouring steps hold all such pairs.
    near = (F.struct("a.size", "a.key") < F.struct("b.size", "b.key")) & (F.col("a.size") >= F.col("a.least") * F.col("b.size") * (1 - 1e-9))
    pairs = a.join(b, ["band", "step"]).where(near).select(F.least("a.key", "b.key").alias("key_a"), F.greatest("a.key", "b.key").alias("key_b")).distinct()
    sets = reps.select("key", "sh", "tf")
    both = pairs.join(sets.select(F.col("key").alias("key_a"), F.col("sh").alias("sa"), F.col("tf").alias("ta")), "key_a").join(
        sets.select(F.col("key").alias("key_b"), F.col("sh").alias("sb"), F.col("tf").alias("tb")), "key_b"
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ka, kb, sa, sb, ta, tb in zip(b["key_a"], b["key_b"], b["sa"], b["sb"], b["ta"], b["tb"]):
                common, ia, ib = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
                jac = len(common) / (len(sa) + len(sb) - len(common))
                if jac < s.jaccard and s.weighted is None:
                    continue
                wa, wb = (_weights(x, t, sent.value, s.rarest) for x, t in ((sa, ta), (sb, tb)))
                low = np.minimum(wa[ia], wb[ib]).sum()
                wj = low / (wa.sum() + wb.sum() - low)
                if jac >= s.jaccard or wj >= s.weighted:
                    out.append((ka, kb, jac, wj))
            yield pd.DataFrame(out, columns=["key_a", "key_b", "jaccard", "weighted"])

    return both.mapInPandas(verify, "key_a binary, key_b binary, jaccard double, weighted double")


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: all pairs of different ids with similar texts."""
    members, reps = classes(df, id_col, text_col, s)
    members = written(members, "dup-members")
    links = similar_classes(reps, s).select("key_a", "key_b")
    links = links.union(members.select(F.col("key").alias("key_a"), F.col("key").alias("key_b")).distinct())
    a = members.select(F.col("key").alias("key_a"), F.col("id").alias("x"))
    b = members.select(F.col("key").alias("key_b"), F.col("id").alias("y"))
    met = links.join(a, "key_a").join(b, "key_b").where("x <> y")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, s: Settings = GROUPS) -> DataFrame:
    """``(id, class_id, group_id, links)``, a row per id with shingles.

    ``class_id``: the smallest id with the same shingles (the smallest of
    several, if an id has several texts); ``group_id``: the smallest id that a
    chain of similar texts reaches; ``links``: similar classes, its own left out.
    """
    members, reps = classes(df, id_col, text_col, s)
    members = written(members, "dup-members")
    links = written(similar_classes(reps, s), "dup-links")
    name = members.select("key", "rep").distinct()
    edges = links.join(name.select(F.col("key").alias("key_a"), F.col("rep").alias("src")), "key_a").join(
        name.select(F.col("key").alias("key_b"), F.col("rep").alias("dst")), "key_b"
    )
    # An id with several texts ties their classes.
    own = members.select(F.col("rep").alias("src"), F.col("id").alias("dst")).distinct()
    comp = connected_components(edges.select("src", "dst").union(own))
    degree = links.select(F.col("key_a").alias("key")).union(links.select("key_b")).groupBy("key").agg(F.count("*").alias("d"))
    return (
        members.join(degree, "key", "left")
        .groupBy("id")
        .agg(F.min("rep").alias("class_id"), F.coalesce(F.sum("d"), F.lit(0)).alias("links"))
        .join(comp.select(F.col("node").alias("id"), F.col("component").alias("group_id")), "id")
        .select("id", "class_id", "group_id", "links")
    )


def near_duplicates_found(passages: DataFrame, cases: DataFrame) -> DataFrame:
    """``(record_kind, id_a, id_b)`` for passages and for book titles."""
    text = near_duplicate_pairs(passages, "id", "text", PASSAGES).select(F.lit("passage").alias("record_kind"), "id_a", "id_b")
    books = cases.select("source_id", "source_title").where("source_id is not null").distinct()
    title = near_duplicate_pairs(books, "source_id", "source_title", TITLES).select(F.lit("title").alias("record_kind"), "id_a", "id_b")
    return text.union(title)
