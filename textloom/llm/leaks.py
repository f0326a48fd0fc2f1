"""Evaluation texts inside a training corpus: spaced-seed hashing.

A seed is a run of words hashed through a fixed mask that ignores some of its
positions. Test and training seeds are joined on the hash, and each pair of
texts that meets is verified on its words, with up to ``max_subs`` words
replaced in a run of ``min_run``.

Exact runs (``max_subs = 0``) need no more than one seed of each run: of the
seeds inside a window of ``min_run`` words the least hash is taken, on both
sides alike (winnowing), which keeps about a quarter of the seeds and loses no
run. With substitutions every seed of every mask is kept, and any window in
which the replaced words leave one placed mask untouched is found.

A seed that many texts of both sides hold would join to a product of texts
that need not share a run. Seeds beyond ``hot_pairs`` pairs are therefore
joined by the whole runs around them, which only texts that share a run hold:
by the hash of the run, or, with a word replaced, by its hashes with each one
word left out. Nothing is dropped.

Defined results: null, blank and too short texts match nothing; repeated rows
and copies are compared once and reported for each id; empty tables give an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.tokens import mix, windows, word_hashes
from textloom.scratch import written


@dataclass(frozen=True)
class Settings:
    min_run: int = 12
    max_subs: int = 0
    masks: tuple[str, ...] = ("110111",)
    hot_pairs: int = 100_000
    #: A list of at most so many 8-byte keys is sent to all tasks; a longer one is joined by shuffle.
    send_keys: int = 1_000_000


#: Of any 12 words with one replaced, 6 or more in a row are untouched, and hold a whole seed of a mask of no more than 6.
TOLERANT = Settings(max_subs=1, masks=("110111",))


def _masked(h: np.ndarray, ends: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g, doc, pos = windows(h, ends, [i for i, c in enumerate(mask) if c == "1"], len(mask))
    return mix(g + np.uint64(int(mask, 2) + 1)), doc, pos


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row."""
    have, m = 1, g
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:]) if len(m) > step else m[:0]
        have += step
    return m


def seeds(texts: list[str | None], s: Settings, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """``(hash, text number, run hash)``: the seeds by which texts meet; run hashes only if ``wide``."""
    h, ends = word_hashes(texts)
    ends = np.asarray(ends, np.int64)
    if s.max_subs:
        parts = [_masked(h, ends, m)[:2] for m in s.masks]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), None
    mask = s.masks[0]
    g, doc, _ = _masked(h, ends, mask)
    width = s.min_run - len(mask) + 1
    low = _least(g, width)
    whole = doc[: len(low)] == doc[width - 1 :] if len(low) else np.empty(0, bool)
    low, d = low[whole], doc[: len(whole)][whole]
    if wide:
        runs, run_doc, _ = windows(h, ends, range(s.min_run), s.min_run)
        assert len(runs) == len(low)
        return low, d, runs
    first = np.r_[True, (low[1:] != low[:-1]) | (d[1:] != d[:-1])] if len(low) else np.empty(0, bool)
    return low[first], d[first], None


def _left_out(h: np.ndarray, ends: np.ndarray, s: Settings, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, run hash)`` of the windows of ``min_run`` words, hashed with each of them left out in turn.

    Where ``hot`` is given, only windows that hold one of its seeds.
    """
    if s.max_subs > 1:
        raise ValueError("hot seeds are told apart by runs with at most one word replaced")
    seen = np.zeros(len(h), bool)
    for mask in s.masks:
        g, doc, pos = _masked(h, ends, mask)
        starts = np.r_[0, ends[:-1]][doc] + pos if len(g) else np.empty(0, np.int64)
        if hot is not None:
            starts = starts[np.isin(g.view(np.int64), hot)]
        # Windows whose words hold the seed: they begin up to min_run - span earlier.
        for back in range(s.min_run - len(mask) + 1):
            at = starts - back
            seen[at[at >= 0]] = True
    out = []
    for k in range(s.min_run):
        g, doc, pos = windows(h, ends, [i for i in range(s.min_run) if i != k], s.min_run)
        if not len(g):
            continue
        keep = seen[np.r_[0, ends[:-1]][doc] + pos]
        out.append((mix(g[keep] + np.uint64(k + 1)), doc[keep]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate([d for _, d in out]), np.concatenate([g for g, _ in out])


def _emit_hot(s: Settings, sent):
    """Runs with a word left out around the hot seeds (sent to all tasks, as they are few; None: around all)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, ends = word_hashes(b["text"].tolist())
            d, r = _left_out(h, np.asarray(ends, np.int64), s, None if sent is None else sent.value)
            yield pd.DataFrame({"owner": b["owner"].values[d], "side": b["side"].values[d], "run": r.view(np.int64)}).drop_duplicates()

    return run


def _emit(s: Settings, wide: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, d, r = seeds(b["text"].tolist(), s, wide)
            out = {"h": h.view(np.int64), "owner": b["owner"].values[d], "side": b["side"].values[d]}
            yield pd.DataFrame(out | ({"run": r.view(np.int64)} if wide else {})).drop_duplicates()

    return run


def shares_run(a: str, b: str, s: Settings) -> bool:
    """True if ``min_run`` consecutive words of a stand in b with at most ``max_subs`` of them replaced."""
    (ha, ea), (hb, eb) = word_hashes([a]), word_hashes([b])
    if min(len(ha), len(hb)) < s.min_run:
        return False
    if not s.max_subs:
        x, y = (windows(h, np.asarray(e, np.int64), range(s.min_run), s.min_run)[0] for h, e in ((ha, ea), (hb, eb)))
        return bool(np.isin(x, y).any())
    diagonals: set[int] = set()
    for mask in s.masks:
        (x, _, px), (y, _, py) = (_masked(h, np.asarray(e, np.int64), mask) for h, e in ((ha, ea), (hb, eb)))
        order = np.argsort(y, kind="stable")
        lo, hi = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
        for i in np.flatnonzero(hi > lo):
            diagonals.update((py[order[lo[i] : hi[i]]] - px[i]).tolist())
    for d in diagonals:
        i, j = max(0, -d), max(0, d)
        n = min(len(ha) - i, len(hb) - j)
        if n >= s.min_run:
            same = np.cumsum(np.r_[0, (ha[i : i + n] == hb[j : j + n]).astype(np.int64)])
            if (same[s.min_run :] - same[: -s.min_run]).max() >= s.min_run - s.max_subs:
                return True
    return False


def _among(df: DataFrame, keys: DataFrame, col: str, n: int, s: Settings) -> DataFrame:
    """Rows of ``df`` whose ``col`` is among ``keys``; sent to all tasks only if they are few."""
    return df.join(F.broadcast(keys) if n <= s.send_keys else keys, col, "left_semi")


def leak_pairs(corpus: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(doc, item)`` class keys of texts that share a run, with ``corpus`` and ``items`` of
    columns ``owner`` (see :func:`owned`) and ``text``."""
    both = corpus.select("owner", "text", F.lit(0).alias("side")).union(items.select("owner", "text", F.lit(1).alias("side")))
    found = written(both.mapInPandas(_emit(s, False), "h bigint, owner bigint, side int"), "leak-seeds")
    counts = found.groupBy("h").agg(F.sum(1 - F.col("side")).alias("nd"), F.sum("side").alias("ni")).where("nd > 0 and ni > 0")
    counts = written(counts, "leak-shared")
    limit = F.lit(s.hot_pairs)
    cool = counts.where(F.col("nd") * F.col("ni") <= limit).select("h")
    few = _among(found, cool, "h", cool.count(), s)
    d, i = few.where("side = 0").select("h", F.col("owner").alias("doc")), few.where("side = 1").select("h", F.col("owner").alias("item"))
    met = d.join(i, "h").select("doc", "item")
    hot = counts.where(F.col("nd") * F.col("ni") > limit).select("h")
    n_hot = hot.count()
    if n_hot:
        if s.max_subs:
            # An array of at most send_keys keys, counted; beyond that every window is taken.
            sent = both.sparkSession.sparkContext.broadcast(hot.toPandas()["h"].to_numpy(np.int64)) if n_hot <= s.send_keys else None
            wide = written(both.mapInPandas(_emit_hot(s, sent), "owner bigint, side int, run bigint"), "leak-runs")
            runs = wide.groupBy("run").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo < hi").select("run")
            wide = wide.join(runs, "run", "left_semi")
        else:
            wide = written(_among(both.mapInPandas(_emit(s, True), "h bigint, owner bigint, side int, run bigint"), hot, "h", n_hot, s).distinct(), "leak-runs")
        d, i = (wide.where(F.col("side") == k).select("run", F.col("owner").alias(n)) for k, n in ((0, "doc"), (1, "item")))
        met = met.union(d.join(i, "run").select("doc", "item"))
    met = written(met.distinct(), "leak-candidates")
    docs, tests = met.select("doc").distinct(), met.select("item").distinct()
    dt = _among(corpus.withColumnRenamed("owner", "doc"), docs, "doc", docs.count(), s).select("doc", F.col("text").alias("dt")).dropDuplicates()
    it = _among(items.withColumnRenamed("owner", "item"), tests, "item", tests.count(), s).select("item", F.col("text").alias("it")).dropDuplicates()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [shares_run(x, y, s) for x, y in zip(b["dt"], b["it"])]
            yield b.loc[ok, ["doc", "item", "dsha", "isha"]]

    sha = lambda c: F.sha2(c, 256)
    paired = met.join(dt, "doc").join(it, "item").select("doc", "item", "dt", "it", sha("dt").alias("dsha"), sha("it").alias("isha"))
    return paired.mapInPandas(verify, "doc bigint, item bigint, dsha string, isha string").distinct()


def owned(rows: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with a column ``owner``, the class of equal texts (a hash; the exact text decides in the end)."""
    return rows.where(F.col("text").isNotNull() & F.col(id_col).isNotNull()).withColumn("owner", F.xxhash64("text"))


def one_of_each(rows: DataFrame, ids: list[str], s: Settings) -> DataFrame:
    """``(owner, text)`` with copies left out, without moving the texts.

    Only ids and text hashes are grouped; the copies are then taken away by id
    and text, since an id may have other texts, by a sent list if they are few.
    """
    key = F.concat_ws("\u0001", *ids)
    sha = F.sha2("text", 256)
    named = rows.select(key.alias("k"), "owner", sha.alias("sha"))
    twice = named.groupBy("owner", "sha").agg(F.min("k").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = written(named.join(twice, ["owner", "sha"]).where("k <> rep").select("k", "owner", "sha").distinct(), "leak-copies")
    out = rows.withColumn("k", key).withColumn("sha", sha)
    return out.join(F.broadcast(copies) if copies.count() <= s.send_keys // 8 else copies, ["k", "owner", "sha"], "left_anti").select("owner", "text")


def leaked_items(documents: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(doc_id, item_field, item_id)``: the items that leaked into each document.

    ``documents``: doc_id, text; ``items``: item_field, item_id, text.
    """
    docs = owned(documents.select("doc_id", "text"), "doc_id")
    tests = owned(items.select("item_field", "item_id", "text"), "item_id")
    pairs = written(leak_pairs(one_of_each(docs, ["doc_id"], s), one_of_each(tests, ["item_field", "item_id"], s), s), "leak-pairs")
    docs_of, tests_of = pairs.select("doc", "dsha").distinct(), pairs.select("item", "isha").distinct()
    send = lambda d: F.broadcast(d) if d.count() <= s.send_keys // 4 else d
    dm = docs.select("doc_id", F.col("owner").alias("doc"), F.sha2("text", 256).alias("dsha")).join(send(docs_of), ["doc", "dsha"], "left_semi")
    im = tests.select("item_field", "item_id", F.col("owner").alias("item"), F.sha2("text", 256).alias("isha")).join(send(tests_of), ["item", "isha"], "left_semi")
    return pairs.join(dm, ["doc", "dsha"]).join(im, ["item", "isha"]).select("doc_id", "item_field", "item_id").distinct()


def evaluation_items(passages: DataFrame, cases: DataFrame) -> DataFrame:
    """``(item_field, item_id, text)`` of passages and of the prompts and targets of cases."""
    return (
        passages.select(F.lit("text").alias("item_field"), F.col("id").alias("item_id"), "text")
        .union(cases.select(F.lit("prompt"), "id", "prompt"))
        .union(cases.select(F.lit("target"), "id", "target"))
    )
