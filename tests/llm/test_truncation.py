import pytest

from textloom.llm import truncation as U


@pytest.mark.parametrize(
    "text,stack",
    [
        ("He (the “old [man]” of", "("), ("“One.\n\n“Two.” (three)", ""), ("<p>One <b>two</b> <br> three", "<p"), ("<i>one</i> said he", ""), ('He said "go" and "stay', "“"), ("« Oui », dit-il", ""), ("", ""),
    ],
)
def test_what_is_left_on_the_stack(text, stack):
    assert U.left_open(text) == stack


@pytest.mark.parametrize(
    "text,state",
    [
        ("He went home. [...]", "open"), ("“He went home. [...]", "cut"), ("He went ho [more]", "cut"), ("left at R&D;", "cut"), ("half an escape \\u20", "cut"), ("far &#82", "cut"), ("He went to the (old", "cut"),
        ("It came to 5%.", "whole"), ("He wrote <i>so</i>.", "whole"), ("He went home—", "whole"), ("and then they,.", "cut"), ("He left it with…", "cut"), ("Paid, 3s. 4d", "whole"),
    ],
)
def test_more_endings(text, state):
    assert U.ending(text) == state


def test_the_whole_text_is_read():
    far = "He went home and sat down again. " * 3000
    assert U.ending("<p>“" + far + "He stood.") == "open" and U.Reader("(" + far).stack == ["("]
    assert U.Reader("He went to the. " + far).broken == 1 and U.Reader(far).stops == 3000


def test_stopped_cuts_count_only_beyond_the_broken_stops_inside(spark):
    rows = [(i, "edits", 100, 100, i, "cut" if i < 4 else "whole", i < 4, 10, int(i % 10 == 0)) for i in range(400)]  # as often inside as at the end
    rows += [(1000 + i, "cuts", 100, 100, 1000 + i, "cut" if i < 40 else "whole", i < 40, 10, 0) for i in range(400)]
    rows += [(2000 + i, None, 100, 100, 2000 + i, "cut" if i < 60 else "whole", i < 60, 10, 0) for i in range(400)]
    rows += [(3000 + i, "copies", 100, 100, 3000, "cut", True, 10, 0) for i in range(400)] + [(4000 + i, "copies", 100, 100, 4000 + i, "whole", False, 10, 0) for i in range(400)]
    got = {r["source"] for r in U.stopped_sources(spark.createDataFrame(rows, U.READ)).collect()}
    assert got == {"cuts", None}
    assert U.stopped_sources(spark.createDataFrame([], U.READ)).count() == 0


def test_stopped_cuts_away_from_limits(spark):
    whole = "He went home number %d. She stayed there. They sat down. It rained."
    rows = [(i, whole % i, "a") for i in range(60)] + [(100, "He went home. He went to the.", "a"), (101, "He went home. He went to the", "a")]
    rows += [(200 + i, f"He went home {i} times. She, number {i}, came to the.", "b") for i in range(30)] + [(300, "And of the.", None), (301, None, None), (302, " ", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r["doc_id"] for r in U.truncated_documents(df).collect()} == {101, *range(200, 230)}
