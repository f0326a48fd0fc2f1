"""Text expressions on columns; all run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers of the public e-book library, and of its bare form in the fixtures.
START_MARK = r"(?is)\*\*\*\s*(?:START OF (?:THE |THIS )?PROJECT GUTENBERG EBOOK|BEGIN [A-Z_]+ ETEXT).*?\*\*\*"
END_MARK = r"(?is)\*\*\*\s*(?:END OF (?:THE |THIS )?PROJECT GUTENBERG EBOOK.*?|END OF ETEXT )\*\*\*"
# License remains, audiobook listings, sentence ends.
RESIDUAL = r"(?i)gutenberg\.org/license|Section 1\.\s+General Terms of Use|This eBook is for the use of anyone anywhere"
AUDIOBOOK = r"(?i)This audio reading of"
SENTENCE_END = "[.!?]+[\"'”’)\\]]*(\\s|$)"
# The pre-tokenizer's pattern and the punctuation stripped from words.
PRETOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_EDGE = ".,;:!?'\"()\\[\\]—–"


def ascii_words(text: Column) -> Column:
    """``[a-z0-9']+`` runs of the lower-cased text: accents split words."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def space_words(text: Column) -> Column:
    """Unicode white-space separated words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def trimmed(text: Column) -> Column:
    """Unicode white space stripped from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once per row, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def ngrams(words: Column, n: int) -> Column:
    """The array of n consecutive words joined by blanks; empty if there are fewer."""
    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    return bound(words, lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(grams(w)))


def run_hashes(words: Column, n: int, seed: int = 0) -> Column:
    """64-bit hashes of the runs of n consecutive words, in order; empty if there are fewer.

    Words are hashed once, and runs of a and of b words are put together into
    runs of a + b, by doubling, so that a run costs about log n steps and no string.
    """

    def together(x: Column, y: Column, a: int, b: int) -> Column:
        s = F.size(x) - b
        return F.zip_with(F.slice(x, F.lit(1), s), F.slice(y, F.lit(a + 1), s), lambda p, q: F.xxhash64(p, q))

    def grown(have: Column, a: int, total: Column | None, t: int) -> Column:
        """``have``: runs of a; ``total``: runs of t, of the low bits of n so far."""
        if n & a:
            if total is None:
                return bound(have, lambda h: grown_on(h, a, h, a))
            return bound(together(have, total, a, t), lambda x: grown_on(have, a, x, a + t))
        return grown_on(have, a, total, t)

    def grown_on(have: Column, a: int, total: Column | None, t: int) -> Column:
        if t == n:
            return total
        return bound(together(have, have, a, a), lambda h: grown(h, 2 * a, total, t))

    one = F.transform(words, lambda w: F.xxhash64(F.lit(seed), w))
    return F.when(F.size(words) < n, F.array().cast("array<bigint>")).otherwise(bound(one, lambda h: grown(h, 1, None, 0)))


def longest_repeat(words: Column, least: int, most: int) -> Column:
    """``(n, k)``: the greatest n from ``least`` to ``most`` of which a run of n words comes twice, and how often
    the commonest does; null if none. Longer runs are tried first, within the row.
    """

    def times(h: Column) -> Column:
        none = F.struct(F.lit(0).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(a: Column, x: Column) -> Column:
            run = F.when((x == a["last"]) & (a["run"] > 0), a["run"] + 1).otherwise(1)
            return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

        return F.aggregate(F.array_sort(h), none, step, lambda a: a["best"])

    def tried(n: int) -> Column:
        return bound(run_hashes(words, n), lambda h: F.when(F.size(h) > F.size(F.array_distinct(h)), F.struct(F.lit(n).alias("n"), times(h).alias("k"))))

    return F.coalesce(*[tried(n) for n in range(most, least - 1, -1)])


def repeats(words: Column, n: int) -> Column:
    """True if some run of n words comes twice; only then can a longer one."""
    return bound(run_hashes(words, n), lambda h: F.size(h) > F.size(F.array_distinct(h)))


def strip_boilerplate(text: Column) -> Column:
    """The text between the first start marker and the first end marker, each optional, stripped.

    Markers out of order leave the text whole. Null stays null.
    """
    begin = F.regexp_instr(text, F.lit(START_MARK))
    start = F.when(begin > 0, begin - 1 + F.length(F.regexp_extract(text, START_MARK, 0))).otherwise(0)
    stop = F.regexp_instr(text, F.lit(END_MARK))
    end = F.when(stop > 0, stop - 1).otherwise(F.length(text))
    inner = F.when(end <= start, text).otherwise(F.substring(text, start + 1, end - start))
    return trimmed(inner)


def clean(text: Column, least: int = 100) -> Column:
    """:func:`strip_boilerplate`, unless less than ``least`` characters are left."""
    c = strip_boilerplate(text)
    return F.when(F.length(c) < least, text).otherwise(c)


def word_set(text: Column) -> Column:
    """The distinct words, lower-cased and without the punctuation around them."""
    edge = f"^[{WORD_EDGE}]+|[{WORD_EDGE}]+$"
    return F.array_distinct(F.transform(space_words(text), lambda w: F.lower(F.regexp_replace(w, edge, ""))))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")
