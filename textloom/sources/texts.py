"""Sources of text form: sectioned passages, result tables, slice manifests, book pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_sections(files: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """``(name, id, text)`` of sectioned files.

    ``## id`` opens a section, a line ``---`` ends it, other lines that begin
    with # are dropped, what stands before the first section is ignored, and a
    later section of the same id replaces an earlier one.
    """
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(text, "\r\n?", "\n")), r"\n## ")
    s = files.select(F.col(name).alias("name"), F.posexplode(parts).alias("at", "part")).where("at > 0")
    body = F.regexp_replace(F.regexp_replace("part", r"^[^\n]*\n?", ""), r"(?s)(^|\n)---[ \t]*(\n.*)?$", "")
    keep = F.filter(F.split(body, "\n"), lambda x: ~x.startswith("#"))
    s = s.select("name", "at", F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)).alias("id"), F.regexp_replace(F.array_join(keep, "\n"), r"^\s+|\s+$", "").alias("text"))
    last = F.row_number().over(Window.partitionBy("name", "id").orderBy(F.desc("at")))
    return s.withColumn("k", last).where("k = 1").select("name", "id", "text")


def result_rows(lines: DataFrame) -> DataFrame:
    """``(number, steps, description, evidence, date, log)`` of a Markdown results table, a line each in ``value``.

    Rows need seven cells between the bars and a number in the first; ruler and head are passed over.
    """
    cells = F.transform(F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    t = lines.select(cells.alias("c")).where((F.size("c") == 7) & F.get("c", F.lit(0)).rlike(r"^\d+$"))
    number = lambda i: F.regexp_extract(F.get("c", F.lit(i)), r"(\d+)", 1).cast("int")
    names = ["description", "evidence", "date", "log", "by"]
    return t.select(number(0).alias("number"), number(1).alias("steps"), *[F.get("c", F.lit(i + 2)).alias(n) for i, n in enumerate(names)])


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSONL manifest with a fixed schema; blank lines are skipped, broken ones abort."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of whole files, broken bytes replaced."""
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", F.decode("content", "UTF-8").alias("text"))


def prompt_grid(families: DataFrame, temperatures: list[float]) -> DataFrame:
    """``(family, prompt, temperature)``: families (family, prompts array) times temperatures."""
    return families.select("family", F.explode("prompts").alias("prompt")).withColumn("temperature", F.explode(F.array(*[F.lit(t) for t in temperatures])))
