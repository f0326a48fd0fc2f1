"""Texts cut off by field limits: a structural completeness check.

A stack automaton reads each whole text once and holds what is open: the
sentence, quotes, brackets, markup, and a tag, escape or character that is not
finished. Words open a sentence; a terminator or, where the text's own layout
ends sentences by lines (verse, lists, plays, letters), the end of a line
closes it; a closing mark takes back its opener; a paragraph opens its own
quotes and brackets. What is left on the stack tells three ways to end:

- ``whole``: nothing is open, or the text stops as a writer ends it (a closing
  line, a signature, the end of an entry, a dash);
- ``cut``: a sentence, an entry, a tag, an escape or a character is open, or a
  terminator or closing mark follows a sentence that isn't complete;
- ``open``: the last sentence has a terminator, but an open quote or bracket or
  a mark of omission casts doubt on it; or a verse line has none.

The sources' baselines decide what the automaton can't: a length, in characters
or bytes, at which several different texts of a source end unterminated, and
far more of them than at the neighbouring lengths, is a field limit of the
source, and an open text of that length is cut. A terminator behind an
incomplete sentence is evidence of a cut only at a limit, or where the source
has more of them at the ends of its texts than their share of the stops inside
its texts explains: editing leaves them anywhere. Copies of a cut text are cut.

Defined results: null and blank texts are whole; a text without a source is
held against the limits of all sources; repeated rows get one verdict; empty
tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.scratch import written

# Articles, prepositions and conjunctions that no sentence ends with (English, French, German).
NEVER_LAST = frozenset(
    """a an the this these those my his our their its every some any no what which such another each of to from with at by into upon among toward between beneath
    and or nor but that than if unless because while whereas since until although though when where who whose as before after within without over
    un une le la les ce cette ces son sa ses du des de et ou mais que qui dans sur sous avec pour vers
    ein eine einen einem der die das den dem des und oder aber mit auf von zu vom zum zur im am diese dieser dieses jene jener ihre seine""".split()
)

_WRONG = {"â€”": "—", "â€“": "–", "â€¦": "…", "â€œ": "“", "â€\x9d": "”", "â€™": "’", "â€˜": "‘", "â€": "”"}
_HEADER = re.compile(r"^\s*\*{2,}\s*(?:BEGIN|START)[^\n]*\*{2,}\s*\n", re.I)
_FOOTER = re.compile(r"\n\s*\*{2,}\s*END OF[^\n]*\*{2,}\s*$", re.I)
_CLOSING = re.compile(r"(?:^|\n)[ \t>]*(?:THE END|FINIS|Finis|The End|END OF [A-Z .]{1,40}|(?:VOLUME|BOOK|PART|CHAPTER|ACT|SCENE) [IVXLC\d]+|\[[^\[\]\n]{1,120}\]|\*(?: ?\*)+|[-_=~]{3,})\.?\s*$")
_ENTRY = re.compile(r"(?:\d+[sd]\.?|(?:\s{2,}|\t|\.{2,} ?)\d+|\b\d+\s*(?:vols?\.?|pp?\.?))$", re.I)
_ENTRY_TAIL = re.compile(r"[.…—]+$")
_PLACE = re.compile(r"^[A-ZÀ-Ý][\w’' -]{1,40}, (?:\d{1,2}(?:st|nd|rd|th)? (?:of )?\w+,? )?\d{4}\.?$")
_MARKS = re.compile(r"\s*(?:\[(?:\.{3}|…|more|continued|truncated|cut|text truncated|snip)\]|\((?:\.{3}|…|more|continued|truncated)\)|<(?:more|truncated)>|(?:read|see) more)\s*$", re.I)
_STOP = re.compile(r"[.!?][\"”’»)\]_*']*$")
_QUOTED = re.compile(r"^[ \t]*(?:>[ \t]?)+", re.M)

#: No mark or end of an entry is longer, so that these need not be looked for in the whole text.
_TAIL = 64
_PAIRS = {"“": "”", "„": "“", "(": ")", "[": "]", "«": "»"}
_CLOSERS = frozenset(_PAIRS.values())
_VOID = frozenset("br hr img input meta link col area base wbr source embed".split())
#: What moves the automaton: breaks, whole tags, terminators with the closing marks behind them, dashes, marks.
_EVENTS = re.compile(r"(?P<n>\n)|(?P<t></?[A-Za-z][^<>\n]*>)|(?P<s>[.!?…]+)|(?P<d>—|–|--+)|(?P<m>[“”„«»()\[\]\"])")
#: A tag, entity, escape or character that the text stops in.
_WITHIN = re.compile(r"(?:\ufffd|<[A-Za-z/!][^<>\n]*|&(?:#\w*|[A-Za-z]\w*)?|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|(?<=%[0-9A-F][0-9A-F])%[0-9A-F]?)[\s]*$")


class Reader:
    """The automaton after a whole text: its stack, and how the text's last words ended.

    ``stack``: open symbols, outermost first (tags as ``<name``); ``last``: the
    kind of the last event after which no word came (``s`` terminator, ``d``
    dash, ``m`` closing mark, '' none: a sentence is open); ``trail``: the last
    terminator leaves words out (an ellipsis); ``lost``: the last sentence is
    closed though a comma or a word that needs another comes before its stop,
    or its own quote is open; ``stops``, ``broken``: terminators, and those of
    them that come after such a comma or word, all over the text.
    """

    __slots__ = ("stack", "last", "trail", "lost", "stops", "broken")

    def __init__(self, text: str) -> None:
        self.stack: list[str] = []
        self.last, self.trail, self.lost = "", False, False
        self.stops = self.broken = 0
        at, newline, opened = 0, -2, False
        for m in _EVENTS.finditer(text):
            i, kind = m.start(), m.lastgroup
            piece = text[at:i].rstrip("*_'’‘ \t") if i > at else ""
            if piece and not piece.isspace():
                self.last, self.trail, self.lost = "", False, False
            at = m.end()
            if kind == "n":
                if newline >= 0 and (i == newline + 1 or text[newline + 1 : i].isspace()):
                    self.stack = [x for x in self.stack if x[0] == "<"]
                newline = i
            elif kind == "t":
                self._tag(m[0])
            elif kind == "m":
                if not self.last and m[0] in _CLOSERS and piece:
                    self.lost = piece[-1] in ",;:" or piece[-1].isalnum() and m[0] in "”»"
                if m[0] in "“„«":
                    opened = True
                self._mark(m[0])
            else:
                if kind == "s" and not self.last:
                    self.stops += 1
                    self.lost = piece[-1:] in (",", ";", ":") or piece[piece.rfind(" ") + 1 :].lower() in NEVER_LAST
                    self.broken += self.lost
                    self.lost |= opened and "“" in self.stack
                    opened = False
                self.last, self.trail = kind, kind == "s" and (m[0] == "…" or m[0].endswith("...") or m[0].endswith("…"))
        if text[at:].strip("*_'’‘ \t\n"):
            self.last, self.trail, self.lost = "", False, False

    def _mark(self, c: str) -> None:
        top = self.stack[-1] if self.stack else ""
        if c == '"':
            c = "”" if top == "“" else "“"
        if c in _CLOSERS and top and _PAIRS.get(top) == c:
            self.stack.pop()
        elif c in _PAIRS:
            self.stack.append(c)
        if c in _PAIRS and c not in _CLOSERS:
            self.last, self.trail = "", False
        elif not self.last:
            self.last = "m"

    def _tag(self, tag: str) -> None:
        name = re.match(r"</?([A-Za-z][\w-]*)", tag)[1].lower()
        if name in _VOID or tag.endswith("/>"):
            return
        if tag[1] != "/":
            self.stack.append("<" + name)
        elif "<" + name in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index("<" + name) :]


def left_open(text: str) -> str:
    """The quotes, brackets and tags still open at the end of a text, innermost last."""
    return "".join(Reader(text).stack)


def _verse(lines: list[str]) -> bool:
    """Lines that break where the writer wants: most begin with a capital and several end without a stop."""
    own = [x for x in lines if x]
    if len(own) < 2 or max(map(len, own)) >= 160:
        return False
    starts = sum(x.lstrip("“\"'‘(")[:1].isupper() for x in own)
    return starts >= 0.9 * len(own) and sum(not _STOP.search(x, max(0, len(x) - _TAIL)) for x in own[:-1]) >= max(1, 0.3 * (len(own) - 1))


def _signed(before: str, last: str, block: list[str], lines: list[str]) -> bool:
    """A name under a courtesy that ends with a comma, the two of them in a block of their own."""
    if not before.endswith(",") or len(last.split()) > 5 or not last[:1].isupper():
        return False
    return len(before) < 60 and (len(block) == 2 and len(before) < 40 or not _verse([x for x in lines if x]))


def _entry(line: str) -> bool:
    return bool(_ENTRY.search(_ENTRY_TAIL.sub("", line[-_TAIL:])))


def _listed(lines: list[str]) -> bool:
    """Most of the lines are entries that end with a price, a page or a count."""
    return len(lines) >= 2 and sum(_entry(x) for x in lines) >= 0.8 * len(lines)


def ending(text: str | None) -> str:
    """``whole``, ``cut`` or ``open``."""
    return judged(text)[0]


def judged(text: str | None) -> tuple[str, Reader | None]:
    """The way a text ends, and the automaton after it (None where the layout alone decides)."""
    if not text or not text.strip():
        return "whole", None
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    if "â€" in t:
        for wrong, right in _WRONG.items():
            t = t.replace(wrong, right)
    if "**" in t:
        t = _HEADER.sub("", _FOOTER.sub("", t))
    t = t.rstrip()
    if not t:
        return "whole", None
    if _WITHIN.search(t[max(t.rfind("\n"), t.rfind("<"), 0) :]):
        return "cut", None
    mark = _MARKS.search(t, max(0, len(t) - _TAIL))
    if not mark and _CLOSING.search(t[max(0, t.rfind("\n")) :]):
        return "whole", None
    if mark:
        t = t[: mark.start()].rstrip()
        if not t:
            return "whole", None
    lines = [x.strip() for x in (_QUOTED.sub("", t) if ">" in t else t).split("\n")]
    last = lines[-1]
    block = lines[max((i for i, x in enumerate(lines) if not x), default=-1) + 1 :]
    before = next((x for x in reversed(lines[:-1]) if x), "")
    if _PLACE.match(last) or _signed(before, last, block, lines):
        return "whole", None
    end = Reader(t)
    return _state(t, lines, block, end, bool(mark)), end


def _state(t: str, lines: list[str], block: list[str], end: Reader, mark: bool) -> str:
    last, own = lines[-1], [x for x in lines if x]
    # An entry ends by its own form; a list's last line that doesn't is unfinished.
    if _entry(last) or _ENTRY.search(last[-_TAIL:]):
        return "open" if mark or end.trail else "whole"
    if _listed([x for x in block[:-1] if x]) or _listed(own[:-1]):
        return "whole" if end.last == "s" and not end.trail and len(last) > 60 else "cut"
    if end.lost and end.last != "d":
        return "cut"
    if end.last == "s":
        return "cut" if mark and end.stack else "open" if mark or end.stack or end.trail else "whole"
    if end.last == "d":
        return "open" if mark else "whole"
    # A sentence is open. Lines may end where sentences don't, if the text's own lines do, but not within a bracket or far from the margin.
    verse = _verse(own) or _verse(block)
    if "(" not in end.stack and end.last != "m":
        if t[-1] in ",;:" and last[:1].isupper() and len(last) < 120 and (verse or len(own) < 4):
            return "open"
        if verse and (t[-1].isalnum() or t[-1] in ",;:"):
            sizes = sorted(len(x) for x in own[:-1])
            if len(own) < 3 or len(last) >= 0.6 * sizes[len(sizes) // 2]:
                return "open"
    return "cut"


ENDS = "doc_id bigint, source string, n_chars int, n_bytes int, text_key bigint, state string"
#: ``stopped``: cut though a terminator or closing mark ends the text; ``stops``, ``broken``: see :class:`Reader`.
READ = ENDS + ", stopped boolean, stops bigint, broken bigint"


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = b["text"].tolist()
        read = [judged(t) for t in texts]
        yield pd.DataFrame(
            {
                "doc_id": b["doc_id"],
                "source": b["source"],
                "n_chars": [len(t) if t else 0 for t in texts],
                "n_bytes": [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts],
                "text_key": b["text_key"],
                "state": [state for state, _ in read],
                "stopped": [state == "cut" and r is not None and r.last in ("s", "m") for state, r in read],
                "stops": [r.stops if r else 0 for _, r in read],
                "broken": [r.broken if r else 0 for _, r in read],
            }
        )


def source_limits(ends: DataFrame, least_texts: int = 3, chance: float = 0.01, near: int = 50) -> DataFrame:
    """``(source, unit, size, texts)``: lengths at which different texts of a source stop unterminated.

    The different unterminated texts at a size are held against those expected
    there, at most (an upper bound of the mean of the sizes up to ``near`` below
    and above, since few texts lie there in small sources): by Chernoff's
    bound for a Poisson count, so many must have a probability below ``chance``
    over all sizes of the source. A byte limit leaves up to three bytes of a
    broken character out, so four byte sizes are pooled; of pools that overlap
    the fullest is the limit, the smallest among equals.
    """
    texts = ends.where("source is not null and state <> 'whole'").select("source", "n_chars", "n_bytes", "text_key").distinct()
    by = lambda unit, col: texts.groupBy("source", F.lit(unit).alias("unit"), F.col(col).cast("bigint").alias("size")).agg(F.count("*").alias("own"))
    w = Window.partitionBy("source", "unit").orderBy("size")
    over = lambda low, high: F.coalesce(F.sum("own").over(w.rangeBetween(low, high)), F.lit(0))
    spare = F.when(F.col("unit") == "bytes", 3).otherwise(0)
    pooled = by("chars", "n_chars").union(by("bytes", "n_bytes")).select(
        "*",
        F.count("*").over(Window.partitionBy("source", "unit")).alias("sizes"),
        F.when(spare > 0, over(-3, 0)).otherwise(F.col("own")).alias("texts"),
        F.when(spare > 0, over(-3 - near, -4) + over(1, near)).otherwise(over(-near, -1) + over(1, near)).alias("around"),
    )
    # Sizes from 1 on: near the least there are fewer below.
    width = F.least(F.lit(near), F.greatest(F.col("size") - spare - 1, F.lit(0))) + near
    expected = (F.col("around") + 3 + 2 * F.sqrt("around")) * (1 + spare) / width
    surprise = F.col("texts") * F.log(F.col("texts") / expected) - F.col("texts") + expected
    found = pooled.where((F.col("texts") >= least_texts) & (F.col("texts") > expected) & (surprise >= F.log(F.col("sizes") / chance)))
    best = F.max(F.struct("texts", (-F.col("size")).alias("less"))).over(w.rangeBetween(-3, 3))
    return found.withColumn("best", best).where((F.col("unit") == "chars") | (F.col("best.less") == -F.col("size"))).select("source", "unit", "size", "texts")


def stopped_sources(ends: DataFrame, chance: float = 0.01) -> DataFrame:
    """``(source)``: sources (null: one of its own) with more stopped cuts than the broken stops inside their texts explain.

    Different texts are counted. As in :func:`source_limits`, by Chernoff's
    bound so many must have a probability below ``chance`` over all sources.
    """
    texts = ends.groupBy("source", "text_key").agg(F.max("stops").alias("stops"), F.max("broken").alias("broken"), F.max(F.col("stopped").cast("int")).alias("stopped"))
    per = texts.groupBy("source").agg(F.count("*").alias("n"), F.sum("stopped").alias("k"), F.sum("stops").alias("stops"), F.sum("broken").alias("broken"))
    per = per.withColumn("all", F.count("*").over(Window.partitionBy(F.lit(1))))  # a row per source
    # The mean from above, since few broken stops lie in small sources.
    expected = F.col("n") * (F.col("broken") + 3 + 2 * F.sqrt("broken")) / F.greatest("stops", F.lit(1))
    surprise = F.col("k") * F.log(F.col("k") / expected) - F.col("k") + expected
    return per.where((F.col("k") > expected) & (surprise >= F.log(F.col("all") / chance))).select("source")


def truncations(documents: DataFrame, least_texts: int = 3) -> DataFrame:
    """``(doc_id, source, n_chars, state, at_limit, is_cut)``, a row per document row."""
    rows = documents.select("doc_id", "source", "text", F.xxhash64("text").alias("text_key"))
    ends = written(rows.mapInPandas(_ends, READ), "cut-ends")
    limits = written(source_limits(ends, least_texts), "cut-limits")
    chars = limits.where("unit = 'chars'").select("source", F.col("size").alias("limit_chars")).distinct()
    # A byte limit leaves up to three bytes of a broken character out.
    spare = F.explode(F.sequence(F.col("size") - 3, F.col("size"))).alias("limit_bytes")
    size = limits.where("unit = 'bytes'").select("source", "size")
    bytes_ = size.select("source", spare).distinct()
    at_c = chars.select("source", F.col("limit_chars").alias("n_chars"), F.lit(True).alias("at_chars"))
    at_b = bytes_.select("source", F.col("limit_bytes").alias("n_bytes"), F.lit(True).alias("at_bytes"))
    any_c = chars.select(F.col("limit_chars").alias("n_chars"), F.lit(True).alias("any_chars")).distinct()
    any_b = bytes_.select(F.col("limit_bytes").alias("n_bytes"), F.lit(True).alias("any_bytes")).distinct()
    known = ends.join(at_c, ["source", "n_chars"], "left").join(at_b, ["source", "n_bytes"], "left").join(any_c, "n_chars", "left").join(any_b, "n_bytes", "left")
    no = F.lit(False)
    at_limit = F.when(F.col("source").isNull(), F.coalesce("any_chars", no) | F.coalesce("any_bytes", no)).otherwise(F.coalesce("at_chars", no) | F.coalesce("at_bytes", no))
    telling = F.broadcast(stopped_sources(ends).select(F.col("source").alias("s"), F.lit(True).alias("telling")))  # a row per source at most
    known = known.join(telling, F.col("source").eqNullSafe(F.col("s")), "left")
    sure = (F.col("state") == "cut") & (~F.col("stopped") | F.coalesce("telling", no))
    seen = known.withColumn("at_limit", at_limit).withColumn("own", sure | ((F.col("state") != "whole") & F.col("at_limit")))
    bad = seen.where("own").select("text_key", F.lit(True).alias("copied")).distinct()
    return seen.join(bad, "text_key", "left").select("doc_id", "source", "n_chars", "state", "at_limit", F.coalesce("copied", no).alias("is_cut"))


def truncated_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id)`` of the documents whose text was cut off."""
    return truncations(documents).where("is_cut").select("doc_id").distinct()


def truncation_rates(documents: DataFrame) -> DataFrame:
    """``(source, documents, cut, at_limit, share_cut)``, null sources together."""
    return (
        truncations(documents)
        .groupBy("source")
        .agg(F.count("*").alias("documents"), F.sum(F.col("is_cut").cast("int")).alias("cut"), F.sum((F.col("is_cut") & F.col("at_limit")).cast("int")).alias("at_limit"))
        .withColumn("share_cut", F.round(F.col("cut") / F.col("documents"), 6))
    )
