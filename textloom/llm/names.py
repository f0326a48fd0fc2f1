"""Variant spellings of personal and corporate names: noisy-channel attribution.

A writer has one full name in mind (the canonical form) and types it through a
channel that makes typing errors, abbreviates, reorders, drops middle names and
uses nicknames. Frequent spellings are the candidate canonical forms. Every
spelling goes to the candidate with the largest posterior

    log P(canonical) + log P(spelling | canonical) + evidence of shared books

and the attachments, which form a forest, are closed into authors.

Nothing is compared all against all: spellings of one normal form collapse
first, and only forms that agree in a surname (up to one deletion on either
side, which covers one insertion, deletion, substitution or transposition) and
an initial, or in a surname and a given name up to one deletion, are scored.

Defined results: null, blank and the placeholder names (:data:`NOBODY`) name
nobody and are left out; equal spellings are one; an empty table gives an
empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.graph import connected_components
from textloom.scratch import written

# Names that stand for no author.
NOBODY = ("?", "anonymous", "various", "unknown", "")

# Forms of address before a name.
TITLES = frozenset("mr mrs miss ms dr rev sir lady prof capt col major lord dame the hon".split())

# Abbreviations in the names of bodies, and the words they stand for.
BODY_WORDS = {
    "soc": "society", "assn": "association", "assoc": "association", "inst": "institute", "bros": "brotherhood", "comm": "committee",
    "co": "company", "dept": "department", "univ": "university", "acad": "academy", "lib": "library", "coll": "college", "fed": "federation",
    "govt": "government", "corp": "corporation", "min": "ministry", "natl": "national", "dir": "directorate",
}
BODIES = frozenset(BODY_WORDS.values()) | frozenset("guild club union league council commission order fellowship museum bureau office press board".split())

# English nicknames and the names they stand for.
NICKNAMES = {
    "abby": "abigail", "alec": "alexander", "alex": "alexander", "sandy": "alexander", "archie": "archibald", "gus": "augustus", "barney": "barnaby",
    "bart": "bartholomew", "bea": "beatrice", "trixie": "beatrice", "ben": "benjamin benedict", "benny": "benjamin", "biddy": "bridget", "cissy": "cecilia",
    "celia": "cecilia", "charlie": "charlotte charles", "lottie": "charlotte", "clem": "clement", "connie": "constance", "con": "conrad", "bert": "cuthbert hubert gilbert albert herbert robert",
    "cuddy": "cuthbert", "debby": "deborah", "deb": "deborah", "dolly": "dorothea", "dora": "dorothea theodora", "dot": "dorothea", "edie": "edith",
    "ed": "edmund edward", "ned": "edmund edward", "ted": "edmund edward theodore", "nell": "eleanor", "nelly": "eleanor", "nora": "eleanor",
    "bess": "elizabeth", "bessie": "elizabeth", "betty": "elizabeth", "betsy": "elizabeth", "eliza": "elizabeth", "lizzie": "elizabeth", "liza": "elizabeth",
    "ras": "erasmus", "evie": "everard", "fee": "felicity", "ferdy": "ferdinand", "flo": "florence", "flossie": "florence", "florrie": "florence",
    "fred": "frederick ferdinand", "freddy": "frederick", "freddie": "frederick", "georgie": "georgiana", "gertie": "gertrude", "trudy": "gertrude",
    "gil": "gilbert", "hattie": "harriet", "harry": "harriet henry harold", "etta": "henrietta harriet", "hetty": "henrietta", "horry": "horatio", "hugh": "hubert hugo",
    "iggy": "ignatius", "immy": "imogen", "bella": "isabella", "belle": "isabella", "jem": "jemima", "mima": "jemima", "jon": "jonathan", "jo": "josephine",
    "josie": "josephine", "jules": "julian", "kate": "katherine", "kitty": "katherine", "kathy": "katherine", "ken": "kenelm kenneth", "kizzy": "keziah",
    "vinnie": "lavinia", "larry": "lawrence", "laurie": "lawrence", "leo": "leopold", "letty": "letitia", "tish": "letitia", "luke": "lucian lucas", "lucy": "lucian lucinda",
    "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "daisy": "margaret", "madge": "margaret", "greta": "margaret", "matt": "matthew", "molly": "marianne mary",
    "milly": "millicent", "monty": "montague", "nat": "nathaniel", "nate": "nathaniel", "nick": "nicholas", "nicky": "nicholas", "ozzy": "oswald",
    "tilly": "ottilie matilda", "penny": "penelope", "percy": "percival", "pip": "philippa", "pippa": "philippa", "prissy": "priscilla", "cilla": "priscilla",
    "quin": "quentin", "ray": "raymond", "reg": "reginald", "reggie": "reginald", "rod": "roderick", "roddy": "roderick", "rose": "rosamund", "rosie": "rosamund",
    "rob": "robert", "bob": "robert", "bobby": "robert", "sam": "samuel", "sammy": "samuel", "sal": "sarah", "sally": "sarah", "sim": "simon", "sukey": "susannah",
    "sue": "susannah", "susie": "susannah", "tad": "thaddeus", "thad": "thaddeus", "theo": "theodore", "teddy": "theodore edward", "tom": "thomas thomasina",
    "tommy": "thomas thomasina", "tim": "timothy", "toby": "tobias", "val": "valentine", "vin": "vincent", "vince": "vincent", "wat": "walter", "wally": "walter",
    "mina": "wilhelmina", "minnie": "wilhelmina", "willa": "wilhelmina", "will": "william", "bill": "william", "billy": "william", "willy": "william",
    "winnie": "winifred", "freda": "winifred", "zach": "zachary", "zack": "zachary", "jack": "john", "johnny": "john", "jim": "james", "jimmy": "james",
    "dick": "richard", "polly": "mary", "nan": "ann", "nancy": "ann", "hal": "henry", "frank": "francis", "fanny": "frances", "chas": "charles", "wm": "william",
    "al": "albert alfred", "alf": "alfred", "andy": "andrew", "art": "arthur", "chris": "christopher christina", "dan": "daniel", "danny": "daniel", "dave": "david",
    "don": "donald", "gene": "eugene", "geo": "george", "geoff": "geoffrey", "greg": "gregory", "jeff": "jeffrey", "jenny": "jennifer jane", "jerry": "jeremiah gerald", "joe": "joseph",
    "mike": "michael", "mick": "michael", "pat": "patrick patricia", "paddy": "patrick", "pete": "peter", "phil": "philip", "ron": "ronald", "steve": "stephen", "sid": "sidney", "stan": "stanley",
}

#: Log-probabilities of the channel.
TYPO, INITIAL, NICK, DROPPED, NO_TAG = -6.0, -2.0, -3.0, -2.0, -4.0
#: Log-odds that two spellings seen in one book mean one person.
SAME_BOOK = 6.0
#: The least log-posterior, over the log-frequency of the spelling itself, of an attachment across two spellings of a surname or body.
LEAST_GAIN = -5.0

_DATES = re.compile(r"[,\s]*\(?\b(?:b\.|d\.|c\.|fl\.)?\s*\d{3,4}\??\s*(?:-\s*(?:\d{3,4}\??)?)?\)?\s*$")
_TAG = re.compile(r"[,\s]*\(?the\s+(elder|younger)\)?\s*$")
_PAREN = re.compile(r"\(([^()]*)\)")
_PARTICLES = frozenset("de du la le van von der den di da del st".split())

PARSED = "spelling string, n bigint, form string, kind string, tag string, surname string, given array<string>, keys array<string>"


def plain(text: str) -> str:
    """Lower case without accents, white space as single blanks."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(bare.casefold().split())


def one_edit(a: str, b: str) -> bool:
    """True if one insertion, deletion, substitution or neighbour swap makes a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def deletions(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def parses(spelling: str) -> tuple[str, str, list[tuple[str, list[str]]]]:
    """``(kind, tag, readings)`` of a spelling; kind ``p`` person, ``b`` body, ``-`` nobody.

    A reading is (surname, given names); a name without a comma that is not
    clearly one order has two. A body's reading is ('', its sorted words).
    """
    text = plain(spelling)
    if text in NOBODY:
        return "-", "", []
    tag = ""
    if m := _TAG.search(text):
        tag, text = m[1], text[: m.start()]
    text = _DATES.sub("", text).strip(" ,;")
    words = re.findall(r"[^\W_]+", text.replace("&", " and "))
    full = [BODY_WORDS.get(w, w) for w in words]
    if any(w in BODIES for w in full) and any(w in ("and", "of", "for") for w in words):
        return "b", tag, [("", sorted(w for w in full if w not in ("the", "and", "of", "for")))]
    inner = ""
    if m := _PAREN.search(text):
        inner, text = m[1], _PAREN.sub(" ", text)
    split = lambda s: [w for w in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", s)]
    if "," in text:
        head, _, rest = text.partition(",")
        surname = [w for w in split(head) if w not in TITLES] or split(head)
        given = [w for w in split(inner or rest) if w not in TITLES]
        return ("p", tag, [(" ".join(surname), given)]) if surname else ("-", tag, [])
    names = split(text)
    titled = [w for w in names if w not in TITLES]
    addressed, names = len(titled) < len(names), titled or names
    if not names:
        return "-", tag, []
    if len(names) == 1:
        return "p", tag, [(names[0], split(inner))]
    at = len(names) - 1
    while at > 1 and names[at - 1] in _PARTICLES:
        at -= 1
    readings = [(" ".join(names[at:]), split(inner) or names[:at])]
    if not addressed and len(names[0]) > 1 and all(len(w) > 1 for w in names):
        readings.append((names[0], names[1:]))
    return "p", tag, readings


def _keys(kind: str, readings: list[tuple[str, list[str]]]) -> list[str]:
    out: set[str] = set()
    for surname, given in readings:
        if kind == "b":
            out |= {"b|" + " ".join(c) for k in (len(given), len(given) - 1) for c in combinations(given, k) if k > 1}
            continue
        if not given:
            continue
        first = {given[0][0]} | {x[0] for x in NICKNAMES.get(given[0], "").split()}
        for d in deletions(surname) if len(surname) > 3 else {surname}:
            out |= {f"s|{d}|{f}" for f in first}
        if len(given[0]) > 3:
            out |= {f"g|{surname}|{d}" for d in deletions(given[0])}
    return sorted(out)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for spelling, n in zip(batch["spelling"], batch["n"]):
            kind, tag, readings = parses(spelling)
            if kind == "-":
                continue
            keys = _keys(kind, readings)
            for i, (surname, given) in enumerate(readings):
                rows.append((spelling, n, f"{kind}|{tag}|{surname}|{' '.join(given)}", kind, tag, surname, given, keys if i == 0 else []))
        yield pd.DataFrame(rows, columns=["spelling", "n", "form", "kind", "tag", "surname", "given", "keys"])


def _given_cost(a: str, b: str) -> float | None:
    """Log-probability of typing the given name b as a; None if it can't be."""
    if a == b:
        return 0.0
    if len(a) == 1:
        return INITIAL if b[0] == a else None
    if b in NICKNAMES.get(a, "").split():
        return NICK
    if len(a) >= 4 and len(b) >= 4 and one_edit(a, b):
        return TYPO
    if len(a) >= 3 and a[-1] in "ye" and len(b) > len(a) and b.startswith(a[: max(3, len(a) - 2)]):
        return NICK - 1
    return None


def channel(v: tuple[str, str, str, list[str]], c: tuple[str, str, str, list[str]]) -> float | None:
    """log P(v | c) of forms (kind, tag, surname, given), or None if v can't come from c."""
    if v[0] != c[0]:
        return None
    cost = 0.0
    if v[1] != c[1]:
        if v[1]:
            return None
        cost += NO_TAG
    if v[0] == "b":
        if len(v[3]) != len(c[3]):
            return None
        rest_v, rest_c = list(v[3]), list(c[3])
        for w in v[3]:
            if w in rest_c:
                rest_c.remove(w)
                rest_v.remove(w)
        if not rest_v:
            return cost
        return cost + TYPO if len(rest_v) == 1 and one_edit(rest_v[0], rest_c[0]) else None
    if v[2] != c[2]:
        if len(v[2]) < 4 or len(c[2]) < 4 or not one_edit(v[2], c[2]):
            return None
        cost += TYPO
    if not v[3] or not c[3] or len(v[3]) > len(c[3]):
        return None
    for a, b in zip(v[3], c[3]):
        if (x := _given_cost(a, b)) is None:
            return None
        cost += x
    return cost + DROPPED * (len(c[3]) - len(v[3]))


def fullness(given: list[str]) -> int:
    """How much a name tells: full given names count more than initials and nicknames."""
    return sum(4 if len(g) > 1 and g not in NICKNAMES else 3 if len(g) > 1 else 1 for g in given)


SCORED = "v string, c string, score double, typo boolean"


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for v, c, nv, nc, vf, cf in zip(b["v"], b["c"], b["nv"], b["nc"], b["vf"], b["cf"]):
            best = None
            for x in vf:
                for y in cf:
                    fx, fy = fullness(list(x["given"])), fullness(list(y["given"]))
                    if (fy, nc, c) <= (fx, nv, v) and x["kind"] == "p" or x["kind"] == "b" and (nc, c) <= (nv, v):
                        continue
                    s = channel((x["kind"], x["tag"], x["surname"], list(x["given"])), (y["kind"], y["tag"], y["surname"], list(y["given"])))
                    if s is not None and (best is None or s > best[0]):
                        best = (s, x["surname"] != y["surname"] or (x["kind"] == "b" and s <= TYPO))
            if best is not None:
                rows.append((v, c, best[0] + math.log(nc), best[1]))
        yield pd.DataFrame(rows, columns=["v", "c", "score", "typo"])


def author_clusters(cases: DataFrame, author: str = "source_author", book: str = "source_id") -> DataFrame:
    """``(spelling, author_key)`` for every spelling that names somebody.

    ``author_key`` is the smallest node name of the cluster, equal for all
    spellings of an author. Rows with a null book count for the frequency but
    give no evidence of shared books.
    """
    seen = cases.select(F.col(author).alias("spelling"), F.col(book).alias("book")).where("spelling is not null")
    counts = seen.groupBy("spelling").agg(F.count("*").alias("n"))
    tasks = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    readings = written(counts.repartition(tasks, "spelling").mapInPandas(_parse, PARSED), "name-readings")
    # A node is the set of spellings with the same readings.
    per = readings.groupBy("spelling").agg(
        F.first("n").alias("n"),
        F.array_join(F.array_sort(F.collect_set("form")), "\u0001").alias("node"),
        F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"),
        F.collect_list(F.struct("kind", "tag", "surname", "given")).alias("forms"),
    )
    member = written(per.select("spelling", "n", "node"), "name-members")
    nodes = written(per.groupBy("node").agg(F.sum("n").alias("n"), F.first("keys").alias("keys"), F.first("forms").alias("forms")), "name-nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    pairs = keyed.alias("a").join(keyed.alias("b"), "key").where("a.node <> b.node").select(F.col("a.node").alias("v"), F.col("b.node").alias("c")).distinct()
    full = nodes.select("node", "n", "forms")
    pairs = pairs.join(full.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("forms").alias("vf")), "v")
    pairs = pairs.join(full.select(F.col("node").alias("c"), F.col("n").alias("nc"), F.col("forms").alias("cf")), "c")
    scored = written(pairs.mapInPandas(_score, SCORED), "name-scores")
    books = written(seen.where("book is not null").distinct().join(member, "spelling").select("node", "book").distinct(), "name-books")
    shared = (
        scored.select("v", "c")
        .join(books.select(F.col("node").alias("v"), "book"), "v")
        .join(books.select(F.col("node").alias("c"), "book"), ["c", "book"])
        .select("v", "c")
        .distinct()
        .withColumn("same_book", F.lit(True))
    )
    own = nodes.select(F.col("node").alias("v"), F.col("n").alias("nv"))
    ranked = (
        scored.join(shared, ["v", "c"], "left")
        .join(own, "v")
        .withColumn("post", F.col("score") + F.when(F.col("same_book"), SAME_BOOK).otherwise(0.0))
        .where((~F.col("typo")) | (F.col("post") - F.log("nv") >= LEAST_GAIN))
        .withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("post"), "c")))
    )
    links = ranked.where("r = 1").select(F.col("v").alias("src"), F.col("c").alias("dst"))
    loops = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    comp = connected_components(links.union(loops))
    return member.join(comp.withColumnRenamed("component", "author_key"), "node").select("spelling", "author_key")


def author_pairs(cases: DataFrame, author: str = "source_author", book: str = "source_id") -> DataFrame:
    """``(name_a, name_b)``: different spellings, as stored, of one author, name_a < name_b."""
    c = written(author_clusters(cases, author, book), "name-clusters")
    a, b = c.select(F.col("spelling").alias("name_a"), "author_key"), c.select(F.col("spelling").alias("name_b"), "author_key")
    return a.join(b, "author_key").where("name_a < name_b").select("name_a", "name_b")
