"""Text quality statistics and outlier scores from exact per-language ranks.

Statistics of a text are compared with those of its language only, and among
different texts with enough function words, so that neither copies nor junk of
any share lower the scores of junk. The values of each (language, statistic) are counted, range-partitioned and sorted, the
partitions' totals are summed into offsets, and the exact number of smaller
and of equal values gives the two empirical tail probabilities of each value.
A text's outlier score is the sum of -ln(tail) over the statistics, each tail
taken on the side that is suspect for it.

Equal values are counted before the sort, so a value that a third of all texts
share is one row. Nothing but partition totals, of a size that the number of
partitions bounds, is gathered.

The score alone decides: a text is not natural if it scores at least
``least_score + least_tails * ln(n + 1)`` in a language of n ranked texts. A
statistic beyond all ranked texts adds ln(n + 1), and so many of them together
come only where nearly all of a text lacks what natural text has. The threshold
lies midway between the highest natural and the lowest unnatural scores of
samples of 60 to 60,000 texts, which both grow with ln(n).

Defined results: null and blank texts have null statistics and no verdict;
repeated rows are one; a text without words of any language is ranked with
the commonest language; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.tokens import WORD
from textloom.scratch import written

#: Statistic -> suspect side: low, high, or both.
SIDES = {
    "varied_common_share": "low",
    "common_share": "low",
    "bare_run": "high",
    "bare_share": "high",
    "digit_ratio": "high",
    "symbol_ratio": "high",
    "mean_word_len": "both",
    "words_per_stop": "high",
}
STATS = (*SIDES, "distinct_ratio", "line_end_share")
COUNTS = ("n_chars", "n_words", "n_lines")

_SPACE = re.compile(r"\s+")
_STOPS = re.compile(r"[.!?…][\"”’»)\]]*(?:\s|$)")
_NOT_WORD = re.compile(r"[^\W_]")
_DIGIT = re.compile(r"\d")
LINE_END = ".!?,;:…—\"”’')]"


def statistics(text: str, common: dict[str, frozenset[str]]) -> tuple[str | None, dict[str, float]]:
    """The language of a text (None if no common word occurs) and its statistics."""
    words = WORD.findall(text.lower())
    solid = _SPACE.sub("", text)
    lines = [x for x in (line.strip() for line in text.splitlines()) if x]
    n, m = len(words), len(solid)
    seen = Counter(words)
    hits = {lang: sum(seen[w] for w in ws if w in seen) for lang, ws in common.items()}
    lang = max(sorted(hits), key=lambda x: hits[x]) if hits and max(hits.values()) else None
    counted = sorted(((seen[w], w) for w in common.get(lang, ()) if w in seen), reverse=True) if lang else []
    kinds, varied = [k for k, _ in counted], frozenset(w for _, w in counted[1:])
    # The longest run of words without a common word, the text's commonest left out: an index repeats one.
    at = [i for i, w in enumerate(words) if w in varied] if varied else []
    bare = max(map(int.__sub__, [*at, n], [-1, *at])) - 1
    letters = len(_NOT_WORD.findall(solid))
    return lang, {
        "n_chars": len(text),
        "n_words": n,
        "n_lines": len(lines),
        "mean_word_len": sum(map(len, words)) / n if n else 0.0,
        "symbol_ratio": (m - letters) / m if m else 0.0,
        "digit_ratio": len(_DIGIT.findall(solid)) / m if m else 0.0,
        "line_end_share": sum(x[-1] in LINE_END for x in lines) / len(lines) if lines else 0.0,
        "common_share": sum(kinds) / n if n else 0.0,
        "varied_common_share": sum(kinds[1:]) / n if n else 0.0,
        "bare_run": float(bare),
        "bare_share": bare / n if n else 0.0,
        "words_per_stop": n / max(1, len(_STOPS.findall(text))),
        "distinct_ratio": len(seen) / n if n else 0.0,
    }


def text_statistics(passages: DataFrame, common_words: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, text_key, lang, n_chars, n_words, n_lines, statistics ...)``, a row per distinct (id, text)."""
    common: dict[str, set[str]] = {}
    for r in common_words.select("lang", "word").where("lang is not null and word is not null").collect():  # a fixed table of word lists
        common.setdefault(r["lang"], set()).add(r["word"])
    lists = {k: frozenset(v) for k, v in common.items()}
    rows = passages.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    rows = rows.withColumn("text_key", F.coalesce(F.sha2("text", 256), F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, key, t in zip(b["id"], b["text_key"], b["text"]):
                if t is None or not t.strip():
                    out.append((i, key, None, *[None] * (len(COUNTS) + len(STATS))))
                    continue
                lang, s = statistics(t, lists)
                out.append((i, key, lang, *[int(s[c]) for c in COUNTS], *[round(s[c], 6) for c in STATS]))
            frame = pd.DataFrame(out, columns=["id", "text_key", "lang", *COUNTS, *STATS])
            yield frame.astype({c: "Int64" for c in COUNTS})

    kinds = ", ".join([*[f"{c} bigint" for c in COUNTS], *[f"{c} double" for c in STATS]])
    return rows.mapInPandas(run, f"id string, text_key string, lang string, {kinds}").dropDuplicates(["id", "text_key"])


def tail_probabilities(values: DataFrame, per_task: int = 200_000) -> DataFrame:
    """``(lang, stat, value, lower, upper)``: exact shares of values <= and >= each value.

    ``values``: lang, stat, value; a row per observation.
    """
    n = F.col("total")
    return rank_counts(values.withColumn("w", F.lit(1)), per_task).select("lang", "stat", "value", (F.col("le") / n).alias("lower"), (F.col("ge") / n).alias("upper"))


def rank_counts(values: DataFrame, per_task: int = 200_000) -> DataFrame:
    """``(lang, stat, value, le, ge, total)``: exact weights of values <= and >= each value, and of all.

    ``values``: lang, stat, value, w; a row per observation, 0 weights are ranked and not counted.
    """
    counted = written(values.groupBy("lang", "stat", "value").agg(F.sum("w").alias("n")), "rank-counts")
    parts = max(1, -(-counted.count() // per_task))
    ranged = written(counted.repartitionByRange(parts, "lang", "stat", "value").withColumn("pid", F.spark_partition_id()), "rank-ranges")
    totals = ranged.groupBy("pid", "lang", "stat").agg(F.sum("n").alias("t"))
    group = Window.partitionBy("lang", "stat")
    offsets = totals.select(
        "pid",
        "lang",
        "stat",
        F.coalesce(F.sum("t").over(group.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("t").over(group).alias("total"),
    )
    inner = Window.partitionBy("pid", "lang", "stat").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranged.withColumn("run", F.sum("n").over(inner)).join(offsets, ["pid", "lang", "stat"])
    upto = F.col("before") + F.col("run")
    return ranked.select("lang", "stat", "value", upto.alias("le"), (F.col("total") - upto + F.col("n")).alias("ge"), "total")


def outlier_scores(stats: DataFrame, least_varied: float = 0.04) -> DataFrame:
    """``(text_key, rank_lang, score, ranked)`` of each different text of the output of :func:`text_statistics`.

    ``ranked``: the texts of the language with ``least_varied`` or more, among which, with itself, a text is ranked.
    """
    have = written(stats.where("n_words is not null").select("text_key", "lang", *SIDES).dropDuplicates(["text_key"]), "rank-texts")
    top = have.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").select(F.col("lang").alias("top")).limit(1)
    placed = have.join(F.broadcast(top), F.lit(True), "left").withColumn(
        "rank_lang", F.when(F.col("lang").isNotNull() & (F.col("common_share") >= 0.05), F.col("lang")).otherwise(F.coalesce("top", F.lit("")))
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in SIDES])).alias("p")
    w = (F.col("varied_common_share") >= least_varied).cast("int").alias("w")
    long = written(placed.select("text_key", F.col("rank_lang").alias("lang"), w, pairs).select("text_key", "lang", "w", "p.stat", "p.value"), "rank-values")
    ranks = rank_counts(long.select("lang", "stat", "value", "w"))
    own = 1 - F.col("w")
    lower, upper = ((F.col(c) + own) / (F.col("total") + own) for c in ("le", "ge"))
    side = F.create_map(*[F.lit(x) for kv in SIDES.items() for x in kv])[F.col("stat")]
    both = F.least(F.lit(1.0), 2 * F.least(lower, upper))
    tail = F.when(side == "low", lower).when(side == "high", upper).otherwise(both)
    return (
        long.join(ranks, ["lang", "stat", "value"])
        .groupBy("text_key", F.col("lang").alias("rank_lang"))
        .agg(F.sum(-F.log(tail)).alias("score"), F.max("total").alias("ranked"))
    )


def judged_passages(passages: DataFrame, common_words: DataFrame, least_score: float = 7.5, least_tails: float = 3.8, least_varied: float = 0.04) -> DataFrame:
    """The statistics with ``score`` (rounded) and ``is_natural`` (null for null and blank texts)."""
    stats = written(text_statistics(passages, common_words), "text-stats")
    scored = stats.join(outlier_scores(stats, least_varied), "text_key", "left")
    junk = F.col("score") >= least_score + least_tails * F.log(F.col("ranked") + F.lit(1.0))
    return scored.select(*[scored[c] for c in stats.columns], F.round("score", 6).alias("score"), F.when(F.col("score").isNotNull(), ~junk).alias("is_natural"))


def unnatural_passages(passages: DataFrame, common_words: DataFrame) -> DataFrame:
    """``(id)`` of passages whose text isn't natural."""
    return judged_passages(passages, common_words).where("is_natural = false").select("id").distinct()
