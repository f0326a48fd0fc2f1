import random

from pyspark.sql import functions as F

from textloom.llm import names as N
from textloom.llm import splits as S

SCHEMA = "id string, task string, source_author string, source_id bigint, extra string"

VARIANTS = [
    "Marrowby, Josephine Maud", "Marrowby, J. M.", "Josephine Maud Marrowby", "Mrs. J. M. Marrowby", "Marrowby, Josie", "MARROWBY, Josephine M.", "Marowby, Josephine Maud",
    "Marrowby, J. M. (Josephine Maud)", "Marrowby, Josephine Maud, 1848-1911", " Josephine  Marrowby ", "Marrowby Josephine Maud", "josephine maud marrowby",
]
OTHERS = ["Marrowby, Lucian", "Tallis, Ann, the elder", "Tallis, Ann, the younger", "?", "Anonymous", "Various", "Unknown", None, "", "X"]
BODY = ["Dunmore Society of Owls and Inks", "The Dunmore Soc. of Owls & Inks", "Society of Owls and Inks, Dunmore", "Dunmore Society of Owls and Ikns"]


def cases(spark, empty=False):
    rows = []
    for k, v in enumerate([*VARIANTS, *OTHERS, *BODY]):
        book = 1 if v in VARIANTS else 2 if v in BODY else 10 + k
        rows += [(f"{k}-{i}", "infilling", v, book, "x") for i in range(9 if v in ("Marrowby, Josephine Maud", BODY[0]) else 2)]
    rows.append(("n", None, "Marrowby, Lucian", None, None))
    return spark.createDataFrame([] if empty else rows, SCHEMA)


def test_one_edit():
    assert N.one_edit("abcd", "abdc") and N.one_edit("abcd", "abd") and N.one_edit("abcd", "abxd") and N.one_edit("abd", "abcd")
    assert not N.one_edit("abcd", "abcd") and not N.one_edit("abcd", "badc") and not N.one_edit("abcd", "ab")


def test_pairs_hold_every_variant_and_nobody_else(spark):
    got = {(r["name_a"], r["name_b"]) for r in N.author_pairs(cases(spark)).collect()}
    want = {(a, b) for g in (VARIANTS, BODY) for a in g for b in g if a < b}
    assert got == want
    assert N.author_pairs(cases(spark, empty=True)).count() == 0


def test_books_are_tied_by_chains_of_authors(spark):
    rows = [("a", "x", "One, Ann", 5, ""), ("b", "x", "Ann One", 3, ""), ("c", "x", "Two, Bob", 3, ""), ("d", "x", "Two, Bob", 9, ""), ("e", "x", None, 7, ""), ("f", "x", "?", 8, ""), ("g", "x", "?", 7, "")]
    got = {(r["root_source_id"], r["source_id"]) for r in S.related_books(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(3, 5), (3, 9)}


def test_splits_keep_components_whole_and_meet_shares(spark):
    rng = random.Random(2)
    rows = [(f"{i}", rng.choice([" Infilling", "continuation", None]), f"Name{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}x, Q", i % 100, "") for i in range(3000)]
    rows += [(f"h{i}", "restoration", "Hot, Hugo", 500, "") for i in range(1000)] + [("n1", "x", None, None, ""), ("n1", "x", None, None, "")]
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1), ("none", None)], "split_name string, target_share double")
    a = S.split_cases(spark.createDataFrame(rows, SCHEMA), targets, block=40)
    assert a.count() == len(rows)
    assert a.groupBy("component").agg(F.countDistinct("split_name").alias("n")).where("n <> 1").count() == 0
    shares = {r["split_name"]: r["share"] for r in S.split_report(a, targets).collect()}
    assert abs(shares["train"] - 0.8) < 0.02 and abs(shares["val"] - 0.1) < 0.02 and shares["none"] == 0.0
    assert S.split_cases(cases(spark, empty=True), targets).count() == 0
