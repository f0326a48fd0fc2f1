from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import quality as Q


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_boilerplate_markers_are_optional_and_ordered(spark):
    body = "x" * 10
    both = f"head\n*** START OF THE PROJECT GUTENBERG EBOOK A ***\n{body}\n*** END OF THE PROJECT GUTENBERG EBOOK A ***\ntail"
    assert one(spark, both, T.strip_boilerplate) == body
    assert one(spark, f"***START OF THIS PROJECT GUTENBERG EBOOK***{body}", T.strip_boilerplate) == body
    wrong = "a *** END OF THE PROJECT GUTENBERG EBOOK *** b *** START OF THE PROJECT GUTENBERG EBOOK *** c"
    assert one(spark, wrong, T.strip_boilerplate) == wrong
    assert one(spark, both, T.clean) == both  # less than 100 characters would be left
    assert one(spark, None, T.strip_boilerplate) is None


def test_ascii_words_and_ngrams(spark):
    assert one(spark, "Café isn't 3rd", T.ascii_words) == ["caf", "isn't", "3rd"]
    assert one(spark, "a b c d", lambda c: T.ngrams(T.space_words(c), 3)) == ["a b c", "b c d"]
    assert one(spark, "a b", lambda c: T.ngrams(T.space_words(c), 3)) == []
    assert one(spark, "a\u00a0b  c ", T.space_words) == ["a", "b", "c"]


def test_metrics_and_reasons(spark):
    d = spark.createDataFrame([(1, ""), (2, None), (3, "no stop here"), (4, "One two. Three four.\nOne two. Three four.")], "doc_id int, text string")
    v = {r["doc_id"]: r for r in Q.quality_verdict(Q.quality_metrics(d), {"min_chars": 5}).collect()}
    assert v[1]["reasons"] == ["too_short(0)", "short_sentences(0.0w)"] == v[2]["reasons"]
    assert v[3]["sentence_words"] == float("inf") and v[3]["reasons"] == ["no_sentences(infw)"]
    assert v[4]["dup_line_frac"] == 0.5 and v[4]["n_sentences"] == 4 and "dup_lines(0.500)" in v[4]["reasons"]


def test_lower_percentiles_do_not_interpolate(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 10)] + [(None,), (float("inf"),)], "x double")
    got = {r["p"]: r["value"] for r in Q.lower_percentiles(v, "x", [0.0, 0.5, 0.99, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.5: 2.0, 0.99: 2.0, 1.0: 10.0}


def test_longest_repeat(spark):
    rows = [("a b c a b c a b", (5, 2)), ("x x x x", (3, 2)), ("a b c d e f", None), ("", None), ("w1 w2 w3 q w1 w2 w3 r w1 w2 w3", (3, 3)), (" ".join(map(str, range(20))) + " " + " ".join(map(str, range(20))), (12, 2))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r["i"]: r["b"] and tuple(r["b"]) for r in df.select("i", T.longest_repeat(T.ascii_words(F.col("t")), 3, 12).alias("b")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}


def test_run_hashes_are_those_of_the_runs(spark):
    words = "a b c a b c d e f g h i j k l a b".split()
    df = spark.createDataFrame([(words[:k],) for k in range(len(words) + 1)], "w array<string>")
    for n in (1, 2, 3, 5, 7, 12):
        seen = {}
        for r in df.select("w", T.run_hashes(F.col("w"), n).alias("h")).collect():
            runs = [tuple(r["w"][i : i + n]) for i in range(len(r["w"]) - n + 1)]
            assert len(r["h"]) == max(0, len(runs))
            for x, h in zip(runs, r["h"]):
                assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)
