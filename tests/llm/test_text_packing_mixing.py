import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import curriculum as C
from textloom.llm import natural as T
from textloom.llm import packing as P
from textloom.llm import truncation as U


@pytest.mark.parametrize(
    "text,state",
    [
        (None, "whole"), ("", "whole"), ("  ", "whole"), ("He went home.", "whole"), ("“I know,” she said. “Do you—”", "whole"), ("He went ho", "cut"), ("He went to the", "cut"), ("He went to the.", "cut"),
        ("He saw the moon (pale and", "cut"), ("a broken char �", "cut"), ("left <td cla", "cut"), ("left &nbs", "cut"), ("It ended so...", "open"), ("A letter.\n\nYour old servant,\nJohn Smith", "whole"),
        ("He went home.\n\nTHE END", "whole"), ("He went ho\n\n*** END OF ETEXT ***", "cut"), ("He stood.\n\nLondon, 1817", "whole"), ("“He stood still.", "cut"), ("She paused,”", "cut"),
        ("One, Ann. A thing, 3s. 4d.\nTwo, Bob. A thing, 5s. 6d.\nThree, Cy. A thing, 7s. 1d.\nFo", "cut"), ("One, Ann. A thing, 3s. 4d.\nTwo, Bob. A thing, 5s. 6d.", "whole"),
        ("The moon upon the silver water lay,\nAnd every boat was drifting to the bay\nWhile all the lamps were lit along the quay;", "open"),
        ("The moon upon the silver water lay,\nAnd every boat was drifting to the bay\nWhile a", "cut"), ("He saw it â€” gone", "cut"), ("line one\r\nwent home.\r\n", "whole"),
    ],
)
def test_endings(text, state):
    assert U.ending(text) == state


def test_field_limits_and_copies(spark):
    verse = "The moon upon the silver water lay,\nAnd every boat was drifting to the bay %s\nWhile all the lamps were lit along the %s;"
    rows = [(i, verse % ("ab"[i % 2] * 3, chr(97 + i) * 4), "lim", "x") for i in range(6)] + [(50, "A whole text.", "lim", None), (51, verse % ("zzzz", "nobody"), "free", None)]
    rows += [(60, rows[0][1], "free", None), (61, rows[1][1], None, None), (70, None, "free", None), (71, "cut here in the", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars string")
    got = {r["doc_id"] for r in U.truncated_documents(df).collect()}
    assert got == {0, 1, 2, 3, 4, 5, 60, 61, 71}
    assert U.truncated_documents(df.limit(0)).count() == 0
    rate = {r["source"]: r["share_cut"] for r in U.truncation_rates(df).collect()}
    assert rate["lim"] == round(6 / 7, 6)


def test_a_quote_far_from_the_end_is_open():
    far = "He went home and sat down again. " * 700
    assert U.ending("“" + far + "He stood.") == "open" and U.ending(far + "He stood.") == "whole"


def test_limits_do_not_depend_on_the_size_of_the_source(spark):
    ends = [(i, "big", 1000 + i % 4000, 1000 + i % 4000, i, "whole") for i in range(2000)]
    ends += [(10_000 + i, "big", 500, 700 + i, 10_000 + i, "open") for i in range(12)]  # a limit in characters, 0.6 % of the rows
    ends += [(20_000 + i, "copies", 300, 390, 20_000 + i % 4, "cut") for i in range(4)] + [(30_000 + i, "copies", 90, 90, 5, "whole") for i in range(3000)]
    ends += [(40_000 + i, "bytes", 200 - i, 256 - i % 4, 40_000 + i, "cut") for i in range(4)]  # one text at each of four byte sizes
    ends += [(50_000 + i, "verse", 100 + i // 4, 150 + i // 4, 50_000 + i, "open") for i in range(2000)]  # four at every size: no limit
    ends += [(60_000 + i, "same", 77, 77, 60_000, "open") for i in range(9)]  # copies of one text
    df = spark.createDataFrame(ends, U.ENDS)
    got = {(r["source"], r["unit"], r["size"]): r["texts"] for r in U.source_limits(df).collect()}
    assert got == {("big", "chars", 500): 12, ("copies", "chars", 300): 4, ("copies", "bytes", 390): 4, ("bytes", "bytes", 256): 4}


def test_exact_tail_ranks(spark):
    rng = random.Random(1)
    v = [("en", "s", float(rng.randrange(20))) for _ in range(300)] + [("fr", "s", 3.0)] * 5
    got = {(r["lang"], r["value"]): (r["lower"], r["upper"]) for r in T.tail_probabilities(spark.createDataFrame(v, "lang string, stat string, value double"), per_task=6).collect()}
    for (lang, x), (lo, up) in got.items():
        own = [y for k, _, y in v if k == lang]
        assert math.isclose(lo, sum(y <= x for y in own) / len(own)) and math.isclose(up, sum(y >= x for y in own) / len(own))


def test_verdicts(spark):
    cw = spark.createDataFrame([("en", w) for w in "the of and to in a was his with her".split()] + [(None, "x")], "lang string, word string")
    good = [(f"g{i}", f"The cat of number {i} was in the house and her dog ran to a tree with his bone. It was late.") for i in range(30)]
    bad = [("list", "\n".join(f"- red lamp{i}" for i in range(20))), ("index", "\n".join(f"Name{i}, thing of, {i}, 7-9" for i in range(20)))]
    rows = [*good, *bad, good[0], ("null", None), ("blank", " "), (None, "text"), ("long", good[1][1] * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, text string, score int")
    assert {r["id"] for r in T.unnatural_passages(df, cw).collect()} == {"list", "index"}
    v = {r["id"]: r["is_natural"] for r in T.judged_passages(df, cw).collect()}
    assert v["null"] is None and v["blank"] is None and v["long"] is True
    assert T.unnatural_passages(df.limit(0), cw).count() == 0 == T.unnatural_passages(df, cw.limit(0)).where("id = 'zzz'").count()


def test_junk_does_not_lower_its_own_score(spark):
    cw = spark.createDataFrame([("en", w) for w in "the of and to in a was his with her".split()], "lang string, word string")
    good = [(f"g{i}", f"The cat of number {i} was in the house and her dog ran to a tree with his bone. It was late.") for i in range(30)]
    index = "\n".join(f"Name{i}, thing of, {i}, 7-9" for i in range(20))
    plain = ("plain", "No cat here, number 5, but a small house; her dog ran to some tree. Cats sit down.")
    copies = [(f"c{i}", index) for i in range(300)]
    other = [(f"o{i}", index + f"\nOther{i}, more of, {i}, 1-2") for i in range(300)]
    score = {}
    for name, rows in (("one", [*good, plain, copies[0]]), ("copies", [*good, plain, *copies]), ("kinds", [*good, plain, copies[0], *other])):
        v = {r["id"]: r for r in T.judged_passages(spark.createDataFrame(rows, "id string, text string"), cw).collect()}
        assert {i for i, r in v.items() if not r["is_natural"]} == {i for i, _ in rows if i[0] in "co"}
        score[name] = v["c0"]["score"]
    assert score["one"] == score["copies"] == score["kinds"]
    # The score decides: few function words alone don't make junk.
    few = [("few", "Cats ran home. Dogs sat down in number 5 trees, it says here, late on that cold day. It went well, we all said.")]
    v = {r["id"]: r for r in T.judged_passages(spark.createDataFrame([*good, *few], "id string, text string"), cw, least_score=1000.0, least_tails=1000.0).collect()}
    assert v["few"]["varied_common_share"] < 0.04 and v["few"]["is_natural"]


def test_pack_is_sound_and_tight():
    rng = random.Random(4)
    sizes = sorted((int(rng.lognormvariate(4, 1)) % 512 + 1 for _ in range(4000)), reverse=True)
    where = P.pack(sizes, 512)
    load = np.bincount(where, sizes)
    assert load.max() <= 512 and sum(sizes) / (len(load) * 512) > 0.97 and len(where) == len(sizes)
    assert P.pack([], 10) == [] and P.pack([0, 0], 10) == [0, 0] and P.pack([10, 10, 1], 10) == [0, 1, 2]


def test_few_sequences_are_left_underfilled():
    rng = random.Random(8)
    sizes = sorted((rng.randrange(1, 200) if rng.random() < 0.6 else rng.randrange(200, 512) for _ in range(6000)), reverse=True)
    where = P.pack(sizes, 512)
    load = np.bincount(where, sizes)
    assert load.max() <= 512 and sum(sizes) / (len(load) * 512) > 0.99 and (load < 0.9 * 512).sum() <= 5 and (load > 0).all()
    first = P.pack(sizes, 512, spare=-1.0, underfilled=0.0)
    assert max(where) < max(first)
    assert P._closed([300, 200, 100], [0, 1, 2], [212, 312, 412], 512, 0.9) == [0, 0, 1]


def test_every_document_is_packed_once(spark):
    rows = [(i, "word " * (i % 40), "x") for i in range(120)] + [(500, "word " * 700, "x"), (501, None, None), (502, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, container_name string")
    kinds = spark.createDataFrame([("s", 64), ("l", 512), ("bad", 0), (None, 5)], "container_name string, capacity_tokens bigint")
    p = P.packed(df, kinds, block=50)
    tokens = {r["doc_id"]: r["n_tokens"] for r in P.token_counts(df).collect()}
    for name, cap in (("s", 64), ("l", 512)):
        own = p.where(F.col("container_name") == name)
        assert {r["doc_id"]: r["t"] for r in own.groupBy("doc_id").agg(F.sum("n_tokens").alias("t")).collect()} == tokens
        assert own.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.max("t")).first()[0] <= cap
        assert {r["doc_id"] for r in own.where("piece_no > 0").collect()} == {i for i, n in tokens.items() if n > cap}
    assert P.packed(df.limit(0), kinds).count() == 0 == P.packed(df, kinds.limit(0)).count()


def test_inverse_of_integrated_weights():
    frames = [(0.0, 0.9, 0.1), (0.5, 0.9, 0.1), (1.0, 0.5, 0.5)]
    u = np.linspace(0, 1, 101)
    for r in (0.0, 0.3, 1.0):
        t = C.invert(u, np.full(101, r), frames)
        assert (np.diff(t) >= 0).all() and t[0] == 0 and abs(t[-1] - 1) < 1e-9
        x = np.linspace(0, 1, 100_001)
        b, g = np.interp(x, [0, 0.5, 1], [0.9, 0.9, 0.5]), np.interp(x, [0, 0.5, 1], [0.1, 0.1, 0.5])
        w = np.cumsum((1 - r) * b / b.mean() + r * g / g.mean()) / len(x)
        assert np.abs(np.interp(t, x, w) - u).max() < 1e-3


def test_draws_reach_targets_within_repeats(spark):
    rows = [(i, "word " * 20, s, sl, 1) for i, (s, sl) in enumerate([("big", "backbone")] * 300 + [("mid", "register")] * 60 + [("tiny", None)] * 20 + [(None, "backbone")] * 5 + [("no", "x")] * 5)]
    rows += [(1000, None, "big", None, 1), (1001, "", "mid", None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, slice string, draw_no int")
    tg = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 2), ("tiny", 0.2, 4), ("gone", 0.0, 1), ("void", None, 1)], "source string, target_share double, max_repeats int")
    sch = spark.createDataFrame([("ramp", 0.0, "backbone", 0.9), ("ramp", 0.0, "register", 0.1), ("ramp", 1.0, "backbone", 0.5), ("ramp", 1.0, "register", 0.5)], "schedule_name string, progress double, slice string, weight double")
    d = C.draws(df, tg, sch, per_task=50).collect()
    share = {r["source"]: r for r in C.reached_shares(spark.createDataFrame(d), tg).collect()}
    for s, x, k in (("big", 0.5, 2), ("mid", 0.3, 2), ("tiny", 0.2, 4)):
        assert abs(share[s]["share"] - x) < 0.02 and share[s]["most_repeats"] <= k
    assert share["gone"]["draws"] == 0
    d.sort(key=lambda r: r["token_offset"])
    at = 0
    for a, b in zip(d, d[1:]):
        assert a["progress"] <= b["progress"] and a["token_offset"] == at
        at += a["n_tokens"]
    assert C.draws(df.limit(0), tg, sch).count() == 0
