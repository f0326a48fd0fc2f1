from textloom.llm import natural as T

COMMON = {"en": frozenset("the of and to in a was".split())}


def test_longest_run_without_a_varied_common_word():
    lang, s = T.statistics("The cat of the house was grey and old cats ran home", COMMON)
    # "the" is the commonest and counts as bare: cat | of | the house | was | grey | and | old cats ran home
    assert lang == "en" and s["bare_run"] == 4 and s["bare_share"] == 4 / 12
    assert T.statistics("thing of wood\nthing of iron\nthing of tin", COMMON)[1]["bare_run"] == 9
    assert T.statistics("?!", COMMON)[1]["bare_run"] == 0 and T.statistics("one two", {})[1]["bare_share"] == 1.0


def test_the_score_alone_decides(spark):
    cw = spark.createDataFrame([("en", w) for w in COMMON["en"]], "lang string, word string")
    good = [(f"g{i}", f"The cat of number {i} was in the house and a dog ran to the tree of {i % 7} oaks. It was late. " * (1 + i % 3)) for i in range(40)]
    bad = [("list", "\n".join(f"- red lamp {i}" for i in range(30)))]
    df = spark.createDataFrame([*good, *bad], "id string, text string")
    v = {r["id"]: r for r in T.judged_passages(df, cw).collect()}
    assert {i for i, r in v.items() if r["is_natural"] is False} == {"list"}
    strict = {r["id"]: r["is_natural"] for r in T.judged_passages(df, cw, least_score=0.0, least_tails=0.0).collect()}
    assert not any(strict.values())
    loose = {r["id"]: r["is_natural"] for r in T.judged_passages(df, cw, least_score=500.0).collect()}
    assert all(loose.values())
