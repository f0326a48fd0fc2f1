"""Tokenizer, shard, bundle and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import bpe as B
from textloom.plans.registry import query
from textloom.scratch import shared_folder, written
from textloom.sources import jsonl, shards, texts
from textloom.streaming.trajectories import StepStream, last_per_step
from textloom.tables import spread, table

VOCAB = "byte_bpe_50k.tiktoken"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCAB)


def words(s, d):
    w = table(s, d, "documents").select(F.explode(T.ascii_words(F.coalesce("text", F.lit("")))).alias("w"))
    return w.groupBy("w").agg(F.count("*").alias("n")).select(F.filter(F.split("w", ""), lambda x: x != "").alias("pieces"), "n")


@query("""WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')) AS w FROM documents), f AS (SELECT w, count(*) AS n FROM w GROUP BY w), p AS (SELECT w, n, unnest(range(1, length(w))) AS i FROM f WHERE length(w) > 1)
SELECT substring(w, i, 1) AS "left", substring(w, i + 1, 1) AS "right", CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1, 2""")
def bpe_pair_counts(s, d):
    return B.pair_counts(words(s, d))


@query()
def bpe_merges(s, d):
    found = B.learn_merges(written(words(s, d), "words"), 8)
    return s.createDataFrame([(k, *m) for k, m in enumerate(found)], "rank int, left string, right string, n bigint")


@query()
def tokenize_docs(s, d):
    t = B.tokenize(spread(table(s, d, "documents").select("doc_id", "text")), vocabulary())
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), F.get("tokens", F.lit(0)).alias("first"))


@query()
def token_shards(s, d):
    """Tokens cut into shards, written in the shard format and read back."""
    shards.register(s)
    folder = f"{shared_folder(s)}/textloom/shards-{uuid.uuid4().hex}"
    made = B.shard_pieces(written(B.tokenize(spread(table(s, d, "documents").select("doc_id", "text")), vocabulary()), "tokens"), 50_000)
    made.select("shard", "tokens").write.format("token_shard").mode("append").save(folder)
    r = s.read.format("token_shard").load(folder)
    eot = F.size(F.filter("tokens", lambda t: t == B.EOT))
    return r.groupBy("name").agg(F.max("n_tokens").alias("n_tokens"), F.sum(F.size("tokens")).alias("read_tokens"), F.sum(eot).alias("documents"))


@query("""WITH f AS (SELECT source_id AS id, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size FROM documents WHERE source_id IS NOT NULL GROUP BY 1), m AS (SELECT gutenberg_id AS id, max(char_count) AS size, max(sha256) AS sha FROM manifest WHERE gutenberg_id IS NOT NULL GROUP BY 1)
SELECT coalesce(m.id, f.id) AS id, m.id IS NOT NULL AS listed, f.id IS NOT NULL AS present, coalesce(f.size <= m.size, FALSE) AS size_ok, coalesce(length(m.sha) = 64, FALSE) AS sha_ok FROM m FULL JOIN f ON m.id = f.id""")
def verify_shards(s, d):
    """Manifest against files, both ways."""
    f = table(s, d, "documents").where("source_id is not null").groupBy(F.col("source_id").alias("id")).agg(F.sum("n_chars").alias("fs"), F.lit(True).alias("present"))
    m = table(s, d, "manifest").where("gutenberg_id is not null").groupBy(F.col("gutenberg_id").alias("id")).agg(F.max("char_count").alias("ms"), F.max("sha256").alias("sha"), F.lit(True).alias("listed"))
    no = F.lit(False)
    return m.join(f, "id", "full").select("id", F.coalesce("listed", no).alias("listed"), F.coalesce("present", no).alias("present"), F.coalesce(F.col("fs") <= F.col("ms"), no).alias("size_ok"), F.coalesce(F.length("sha") == 64, no).alias("sha_ok"))


@query("WITH l AS (SELECT line_no, gutenberg_id, coalesce(token_count, 0) AS t FROM manifest WHERE gutenberg_id IS NOT NULL ORDER BY line_no LIMIT 20) SELECT count(*) AS lines, count(DISTINCT gutenberg_id) AS books, CAST(sum(t) AS BIGINT) AS tokens FROM l")
def reduced_manifest(s, d):
    """The first 20 lines as a bundle with its own totals; the limit is the feature."""
    m = table(s, d, "manifest").where("gutenberg_id is not null").orderBy("line_no").limit(20)
    return m.agg(F.count("*").alias("lines"), F.countDistinct("gutenberg_id").alias("books"), F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"))


@query("""SELECT section_file, id, md5(text) AS body FROM (SELECT section_file, id, min(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text FROM passages WHERE id IS NOT NULL AND text IS NOT NULL AND section_file IS NOT NULL AND NOT regexp_matches(text, '(?m)^(#|---)') AND NOT contains(text, chr(13)) GROUP BY 1, 2)""".replace("\\\\", "\\"))
def section_files(s, d):
    """Passages written as sectioned files and parsed again."""
    p = table(s, d, "passages").where(r"id is not null and text is not null and section_file is not null").where(~F.col("text").rlike(r"(?m)^(#|---)") & ~F.col("text").contains("\r"))
    one = p.groupBy("section_file", "id").agg(F.min(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("text"))
    part = F.concat(F.lit("## "), "id", F.lit("\n"), "text", F.lit("\n---\n"))
    files = one.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(16))).groupBy("section_file", "b").agg(F.array_join(F.collect_list(part), "").alias("text"))
    return texts.parse_sections(files.select(F.concat_ws("/", "section_file", "b").alias("name"), "text")).select(F.regexp_extract("name", "^(.*)/", 1).alias("section_file"), "id", F.md5("text").alias("body"))


def _folder(s, name):
    return f"{shared_folder(s)}/textloom/{name}-{uuid.uuid4().hex}"


@query("SELECT line_no, gutenberg_id, md5(coalesce(title, '')) AS title, coalesce(array_to_string(authors, '|'), '') AS authors, status, copyright, char_count FROM manifest")
def manifest_jsonl(s, d):
    """The manifest written as JSONL and read again."""
    m, at = table(s, d, "manifest"), _folder(s, "manifest-jsonl")
    jsonl.append_jsonl(m, at)
    r = texts.read_manifest(s, at, ", ".join(f"`{n}` {t}" for n, t in m.dtypes))
    return r.select("line_no", "gutenberg_id", F.md5(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce(F.array_join("authors", "|"), F.lit("")).alias("authors"), "status", "copyright", "char_count")


@query("""SELECT run_id, step, CASE WHEN isnan(val_loss) OR isinf(val_loss) THEN NULL ELSE round(val_loss, 6) END AS val_loss, coalesce(isnan(val_loss) OR isinf(val_loss), FALSE) AS val_loss_nonfinite, count(*) AS n FROM run_steps GROUP BY 1, 2, 3, 4""")
def trajectory_jsonl(s, d):
    """Step rows appended twice over as JSONL, NaN as null with a flag, and read again."""
    t, at = table(s, d, "run_steps").select("run_id", "step", "val_loss"), _folder(s, "trajectory")
    for half in (0, 1):
        jsonl.append_jsonl(t.where(F.coalesce(F.pmod("step", F.lit(2)), F.lit(0)) == half), at)
    r = s.read.schema("run_id string, step bigint, val_loss double, val_loss_nonfinite boolean").option("mode", "FAILFAST").json(at)
    return r.groupBy("run_id", "step", F.round("val_loss", 6).alias("val_loss"), F.coalesce("val_loss_nonfinite", F.lit(False)).alias("val_loss_nonfinite")).agg(F.count("*").alias("n"))


@query("SELECT run_id, min(init_seed) AS seed, max(mix_spec) AS mix, max(step) AS last_step, TRUE AS indexed FROM run_steps WHERE run_id IS NOT NULL GROUP BY run_id")
def run_index(s, d):
    """A record of each run, then the common index, read back from the records."""
    at = _folder(s, "runs")
    runs = table(s, d, "run_steps").where("run_id is not null").groupBy("run_id").agg(F.min("init_seed").alias("seed"), F.max("mix_spec").alias("mix"), F.max("step").alias("last_step"))
    jsonl.write_run_records(runs, at)
    schema = "run_id string, seed bigint, mix string, last_step bigint"
    index = s.read.schema(schema).json(f"{at}/index").select("run_id", F.lit(True).alias("indexed"))
    return jsonl.read_run_records(s, at, schema).join(index, "run_id", "left").select("run_id", "seed", "mix", "last_step", F.coalesce("indexed", F.lit(False)).alias("indexed"))


@query("""WITH o AS (SELECT slice, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY slice ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM documents WHERE slice IS NOT NULL), h AS (SELECT slice, CAST(start // 20000 AS BIGINT) AS k, sum(n_chars) AS n FROM o GROUP BY 1, 2)
SELECT slice, printf('%s_%06d.bin', slice, k) AS shard_name, CAST(n AS BIGINT) AS num_tokens, CAST(sum(n) OVER (PARTITION BY slice) AS BIGINT) AS pool_tokens FROM h""")
def slice_manifest(s, d):
    """Shards by slice and by split written as one manifest, its facts checked, and the section of slices read."""
    from textloom.plans.mix_queries import shard_rollover, slice_shards

    at = _folder(s, "shard-manifest")
    own = slice_shards(s, d).select(F.lit("train").alias("split"), "slice", F.format_string("%s_%06d.bin", "slice", "shard").alias("name"), "n_tokens")
    jsonl.write_shard_manifest(own.union(shard_rollover(s, d).select("split", F.lit(None).cast("string"), "name", "n_tokens")), at, tokenizer=VOCAB, vocab_size=50304, eot_token=B.EOT)
    jsonl.check_manifest(s, at, tokenizer=VOCAB, vocab_size=50304, eot_token=B.EOT)
    return jsonl.load_slice_manifest(s, at)


@query("""WITH t AS (SELECT 3 * count(*) AS n FROM documents), k AS (SELECT unnest(range(CAST(ceil(n / 500) AS BIGINT))) AS k, n FROM t)
SELECT printf('train_%06d.bin', k) AS name, CAST(least(500, n - 500 * k) AS BIGINT) AS n_tokens, CAST(1024 + 2 * least(500, n - 500 * k) AS BIGINT) AS file_size, CAST(ceil(least(500 * (k + 1), n) / 3) - ceil(500 * k / 3) AS BIGINT) AS document_starts, TRUE AS ok, FALSE AS differs FROM k""")
def shards_inspected(s, d):
    """Shards of three tokens a document, written, inspected and held against their own manifest."""
    shards.register(s)
    at = _folder(s, "inspected")
    t = table(s, d, "documents").select("doc_id", F.array(F.lit(B.EOT), F.pmod("doc_id", F.lit(50_000)).cast("int"), F.pmod("n_chars", F.lit(50_000)).cast("int")).alias("tokens"))
    B.shard_pieces(t, 500).select("shard", "tokens").write.format("token_shard").mode("append").save(at)
    found = written(shards.inspect_shards(s, at), "inspected")
    against = shards.compared(found, found.select("name", "n_tokens", "file_size", "sha256"))
    return found.join(against, "name").select("name", "n_tokens", "file_size", "document_starts", F.col("problem").isNull().alias("ok"), "differs")


@query("SELECT i AS step, i / 1000 AS progress FROM (SELECT unnest(range(1000)) AS i)")
def replayed_steps(s, d):
    """The step stream read to its end in two runs from one checkpoint: every step once."""
    s.dataSource.register(StepStream)
    at = _folder(s, "steps")
    for _ in range(2):
        r = s.readStream.format("step_stream").option("steps", 1000).option("per_batch", 500).load()
        r.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return s.read.schema("step bigint, progress double").parquet(f"{at}/rows")


@query("""WITH c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']')) AS token FROM documents) SELECT token, row_number() OVER (ORDER BY token) + 255 AS id FROM c""")
def bpe_alphabet(s, d):
    """The first entries of a trained vocabulary: its characters in order, from 256 on."""
    return B.vocabulary(words(s, d), []).select("token", "id")


def _stream(s, d, name):
    """The table as a file stream, whether it is one file or a folder of files."""
    t = table(s, d, name)
    one_file = t.inputFiles()[0].endswith(f"/{name}.parquet")
    r = s.readStream.schema(t.schema)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(d) if one_file else r.parquet(f"{d}/{name}.parquet")


def _sunk(s, stream, schema):
    """Run an append-mode stream over what is there into a written table, and return it."""
    at = f"{shared_folder(s)}/textloom/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return s.read.schema(schema).parquet(f"{at}/rows")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(s, d):
    """Daily windows of the event stream; open windows are closed by a run's end, so the state is read by update batches."""
    ev = _stream(s, d, "events")
    at = f"{shared_folder(s)}/textloom/stream-{uuid.uuid4().hex}"
    # State is kept for the windows of 60 days; what comes later than that is dropped.
    agg = ev.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "60 days").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))

    def keep(batch, k):
        batch.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", F.lit(k).alias("batch")).write.mode("append").parquet(f"{at}/rows")

    agg.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = s.read.parquet(f"{at}/rows")
    return rows.groupBy("start_us", "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("SELECT run_id, count(*) AS steps FROM (SELECT DISTINCT run_id, step FROM run_steps) GROUP BY run_id")
def stream_last_wins(s, d):
    """Repeated and restarted steps of the run stream count once."""
    seen = _stream(s, d, "run_steps").select("run_id", "step").dropDuplicates(["run_id", "step"])
    return _sunk(s, seen, "run_id string, step bigint").groupBy("run_id").agg(F.count("*").alias("steps"))


@query("""SELECT run_id, step, round(val_loss, 6) AS val_loss, epoch_us(logged_at) AS logged_us FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY logged_at DESC NULLS LAST, received_at DESC NULLS LAST, val_loss DESC NULLS LAST) AS k FROM run_steps WHERE run_id IS NOT NULL AND step IS NOT NULL) WHERE k = 1""")
def stream_last_readings(s, d):
    """The last reading of each step of the run stream; the state is a row per step of the runs in it."""
    at = f"{shared_folder(s)}/textloom/stream-{uuid.uuid4().hex}"
    last = last_per_step(_stream(s, d, "run_steps").where("run_id is not null and step is not null"))

    def keep(batch, k):
        batch.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{at}/rows")

    last.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = s.read.schema("run_id string, step bigint, val_loss double, logged_at timestamp, batch bigint").parquet(f"{at}/rows")
    newest = rows.groupBy("run_id", "step").agg(F.max_by(F.struct("val_loss", "logged_at"), "batch").alias("x"))
    # As the SQL rounds: the double is scaled first, so 8.1131745 (8113174.499999999) goes down, which round(v, 6) takes up by its digits.
    v = F.col("x.val_loss")
    rounded = F.when(F.abs(v) < 1e302, F.round(v * 1e6) / 1e6).otherwise(v)
    return newest.select("run_id", "step", rounded.alias("val_loss"), F.unix_micros("x.logged_at").alias("logged_us"))


@query()
def corpus_build(s, d):
    """The whole corpus build, summarised by slice."""
    from textloom.plans.corpus import corpus_summary

    return corpus_summary(s, d)
