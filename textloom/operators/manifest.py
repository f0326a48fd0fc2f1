"""Relational operators over the document manifest, one line per write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Author patterns of the register slice, matched case-sensitively as substrings.
REGISTER_AUTHORS = (
    "Poe, Edgar Allan", "Bierce, Ambrose", "Machen, Arthur", "Blackwood, Algernon", "Dunsany", "James, M. R.", "Hodgson, William Hope", "Chambers, Robert W",
    "Le Fanu", "Lovecraft", "Shiel, M. P", "Marsh, Richard", "Benson, E. F", "Onions, Oliver", "Hearn, Lafcadio", "Hoffmann, E. T. A", "Gautier, Th",
    "Radcliffe, Ann", "Maturin, Charles Robert", "Beckford, William", "Shelley, Mary Wollstonecraft", "Stoker, Bram", "Walpole, Horace", "Riddell, Mrs. J. H",
    "Crawford, F. Marion", "Wells, H. G",
)


def _ranked(m: DataFrame, *order: Column) -> DataFrame:
    return m.withColumn("__r", F.row_number().over(Window.partitionBy("gutenberg_id").orderBy(*order)))


def usable() -> Column:
    """Neither failed nor known to be under copyright; unknown copyright is kept."""
    return (F.coalesce("status", F.lit("")) != "failed") & ~F.coalesce("copyright", F.lit(False))


def last_wins(m: DataFrame) -> DataFrame:
    """The last line of each id, and only if it is usable: a late failure removes the book.

    Lines are ordered by ``line_no``, repeated ones by ``written_at``. Null ids are dropped.
    """
    last = _ranked(m.where("gutenberg_id is not null"), F.desc("line_no"), F.desc("written_at")).where("__r = 1").drop("__r")
    return last.where(usable())


def stable_dedupe(m: DataFrame) -> DataFrame:
    """The last line of each id, with ``position``: where its first line stood."""
    k = m.where("gutenberg_id is not null")
    first = k.groupBy("gutenberg_id").agg(F.min("line_no").alias("position"))
    return _ranked(k, F.desc("line_no"), F.desc("written_at")).where("__r = 1").drop("__r").join(first, "gutenberg_id")


def first_wins(m: DataFrame) -> DataFrame:
    """The first line of each id that hasn't failed; failed lines are passed over."""
    ok = m.where("gutenberg_id is not null").where(F.coalesce("status", F.lit("")) != "failed")
    return _ranked(ok, F.asc("line_no"), F.asc("written_at")).where("__r = 1").drop("__r")


def base_name(path: Column) -> Column:
    """The last part of a path with slashes or backslashes."""
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def classify(authors: Column, override: Column | None = None, patterns: tuple[str, ...] = REGISTER_AUTHORS) -> Column:
    """``register`` or ``backbone``: an override wins, else any author that contains a pattern."""
    hit = F.exists(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.coalesce(a.contains(p), F.lit(False))))
    own = F.when(hit, F.lit("register")).otherwise(F.lit("backbone"))
    return own if override is None else F.coalesce(F.when(override.isin("register", "backbone"), override), own)


def holdout(books: DataFrame, id_col: str, weight: str, seed: int = 1930, share: float = 0.01, least: int = 8) -> DataFrame:
    """``(id, weight, rank, acc_before)`` of the held-out books.

    Books in the order of a seeded hash; one is taken while the weight before
    it is under ``share`` of all, or fewer than ``least`` are taken, so the book
    that crosses the target is in. Only as many leading books as can be in are
    ever sorted: the first hash ranges whose weight reaches the target.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    b = books.select(id_col, F.coalesce(weight, F.lit(0)).cast("bigint").alias("weight"), order.alias("h"))
    total = b.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total"))
    from textloom.operators.prefix import running_sum

    acc = running_sum(b, [], ["h", id_col], "weight", "acc_before", name="holdout")
    ranked = running_sum(acc.withColumn("one", F.lit(1)), [], ["h", id_col], "one", "rank", name="holdout-rank").drop("one")
    return ranked.join(F.broadcast(total), F.lit(True)).where((F.col("acc_before") < F.col("total") * share) | (F.col("rank") < least)).select(id_col, "weight", "rank", "acc_before")
