"""Structural quality metrics, verdicts with reasons, percentiles and margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.prefix import running_sum

# Rejection thresholds.
THRESHOLDS = {
    "min_chars": 5000,
    "max_digit_ratio": 0.050,
    "min_alpha_ratio": 0.800,
    "max_dup_line_frac": 0.320,
    "max_upper_ratio": 0.140,
    "min_sentence_words": 5.0,
    "max_sentence_words": 90.0,
}


def quality_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The metrics of each text, one projection over the scan, with the columns ``carry`` beside them.

    Null texts count as empty; an empty text has 0 everywhere, alpha_ratio 0
    and no sentence. ``sentence_words`` is infinite where no sentence ends.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda drop: F.length(F.regexp_replace(t, drop, ""))
    lines = F.filter(F.transform(F.split(t, "\n"), T.trimmed), lambda x: x != "")
    d = docs.select(
        F.col(id_col),
        F.length(t).alias("n_chars"),
        count(r"(?U)\s").alias("ns"),
        count(r"\P{L}").alias("al"),
        count(r"\P{Nd}").alias("dg"),
        count(r"\P{Lu}").alias("up"),
        lines.alias("ls"),
        T.space_words(t).alias("ws"),
        F.regexp_count(t, F.lit(T.SENTENCE_END)).alias("n_sentences"),
        t.rlike(T.RESIDUAL).alias("residual_boilerplate"),
        F.substring(t, 1, 4000).rlike(T.AUDIOBOOK).alias("audiobook_metadata"),
        *carry,
    )
    one = lambda c: F.greatest(c, F.lit(1))
    n_lines = one(F.size("ls"))
    letters = F.aggregate("ws", F.lit(0), lambda a, w: a + F.length(w))
    return d.select(
        id_col,
        "residual_boilerplate",
        "audiobook_metadata",
        "n_chars",
        (F.col("al") / one(F.col("ns"))).alias("alpha_ratio"),
        (F.col("dg") / one(F.col("ns"))).alias("digit_ratio"),
        (F.col("up") / one(F.col("al"))).alias("upper_ratio"),
        (F.size(F.filter("ls", lambda x: F.length(x) < 40)) / n_lines).alias("short_line_frac"),
        F.when(F.size("ls") == 0, 1.0).otherwise(1.0 - F.size(F.array_distinct("ls")) / n_lines).alias("dup_line_frac"),
        F.size("ws").alias("n_words"),
        "n_sentences",
        F.when(F.col("n_sentences") > 0, F.size("ws") / F.col("n_sentences")).otherwise(F.lit(float("inf"))).alias("sentence_words"),
        T.ratio(letters, F.size("ws")).alias("mean_word_len"),
        *carry,
    )


def reasons(m: dict[str, float] | None = None) -> Column:
    """The ordered rejection reasons of a row of metrics; an empty array keeps the document."""
    t = THRESHOLDS | (m or {})
    empty = F.col("n_chars") == 0
    tell = lambda bad, form, col: F.when(bad & ~empty, F.format_string(form, F.col(col)))
    sw = F.when(empty, F.lit(0.0)).otherwise(F.col("sentence_words"))
    width = F.when(F.col("sentence_words") == float("inf"), F.lit("inf")).otherwise(F.format_string("%.1f", sw))
    return F.array_compact(
        F.array(
            F.when(F.col("residual_boilerplate"), F.lit("residual_gutenberg_license")),
            F.when(F.col("audiobook_metadata"), F.lit("audiobook_metadata")),
            F.when(F.col("n_chars") < t["min_chars"], F.format_string("too_short(%d)", F.col("n_chars"))),
            tell(F.col("digit_ratio") > t["max_digit_ratio"], "digit_ratio(%.3f)", "digit_ratio"),
            tell(F.col("alpha_ratio") < t["min_alpha_ratio"], "alpha_ratio(%.3f)", "alpha_ratio"),
            tell(F.col("dup_line_frac") > t["max_dup_line_frac"], "dup_lines(%.3f)", "dup_line_frac"),
            tell(F.col("upper_ratio") > t["max_upper_ratio"], "upper_ratio(%.3f)", "upper_ratio"),
            F.when(sw < t["min_sentence_words"], F.format_string("short_sentences(%sw)", F.when(empty, F.lit("0.0")).otherwise(width))),
            F.when(sw > t["max_sentence_words"], F.format_string("no_sentences(%sw)", width)),
        )
    )


def quality_verdict(metrics: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """The metrics with ``reasons`` and ``keep``."""
    return metrics.withColumn("reasons", reasons(thresholds)).withColumn("keep", F.size("reasons") == 0)


def lower_percentiles(values: DataFrame, col: str, shares: list[float]) -> DataFrame:
    """``(p, value)``: lower nearest rank, the finite value at index int(p * (n - 1)), without interpolation.

    Equal values are counted first, so the running count is over distinct values.
    """
    finite = values.where(F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(col) != float("inf")))
    counted = finite.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    upto = running_sum(counted, [], ["value"], "n", "before").withColumn("upto", F.col("before") + F.col("n")).join(F.broadcast(total), F.lit(True))
    p = F.explode(F.array(*[F.lit(x) for x in shares]))
    return upto.withColumn("p", p).where(F.col("upto") > F.floor(F.col("p") * (F.col("total") - 1))).groupBy("p").agg(F.min("value").alias("value"))


def margins(t: dict[str, float] | None = None) -> Column:
    """How far a kept document is from the nearest rejection, as a share of the threshold."""
    t = THRESHOLDS | (t or {})
    return F.least(
        (t["max_digit_ratio"] - F.col("digit_ratio")) / t["max_digit_ratio"],
        (F.col("alpha_ratio") - t["min_alpha_ratio"]) / t["min_alpha_ratio"],
        (t["max_dup_line_frac"] - F.col("dup_line_frac")) / t["max_dup_line_frac"],
        (t["max_upper_ratio"] - F.col("upper_ratio")) / t["max_upper_ratio"],
    )
