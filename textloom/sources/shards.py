"""Token shards: a header of 256 little-endian int32, then uint16 tokens.

``spark.read.format("token_shard").load(folder)`` and
``df.write.format("token_shard").save(folder)``. Reading yields rows of at most
``chunk`` tokens, so a task never holds a whole shard; writing takes rows
(shard, tokens), one file per shard, in which the shard's rows follow one another
as they come. A shard's rows must come together and in one task; a shard that
comes twice is an error. Files get their names when the whole job commits, so
that failed and repeated attempts leave none.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# The format.
MAGIC, VERSION, HEADER = 20240520, 1, 1024


def header(n: int) -> bytes:
    return struct.pack("<256i", MAGIC, VERSION, n, *[0] * 253)


def check_header(raw: bytes, size: int, strict: bool = True) -> int:
    """The number of tokens; ValueError if magic, version or the file size don't fit."""
    if len(raw) < HEADER:
        raise ValueError("shorter than a header")
    magic, version, n = struct.unpack("<3i", raw[:12])
    if magic != MAGIC or (strict and version != VERSION):
        raise ValueError(f"magic {magic}, version {version}")
    if size != HEADER + 2 * n:
        raise ValueError(f"{n} tokens don't fit {size} bytes")
    return n


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class ShardFile(InputPartition):
    path: str
    size: int


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunk", 1 << 16))
        self.strict = options.get("strict", "true").lower() == "true"

    def partitions(self) -> list[ShardFile]:
        from pyarrow import fs

        system, root = _fs(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [ShardFile(f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".bin")]

    def read(self, partition: ShardFile) -> Iterator[tuple]:
        system, _ = _fs(self.path)
        with system.open_input_stream(partition.path) as f:
            n = check_header(f.read(HEADER), partition.size, self.strict)
            name, at = partition.path.rsplit("/", 1)[-1], 0
            while at < n:
                t = np.frombuffer(f.read(2 * min(self.chunk, n - at)), "<u2")
                yield name, n, at, t.astype(np.int32).tolist()
                at += len(t)


@dataclass
class Written(WriterCommitMessage):
    files: list


class ShardWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.prefix = options["path"], options.get("prefix", "train")

    def write(self, rows: Iterator) -> Written:
        system, root = _fs(self.path)
        system.create_dir(root, recursive=True)
        files, seen = [], set()
        for shard, own in groupby(rows, key=lambda r: r["shard"]):
            name = f"{self.prefix}_{shard:06d}.bin"
            if shard in seen:
                raise ValueError(f"the rows of shard {shard} don't come together")
            seen.add(shard)
            # The header wants the length first: a shard's payload, whose size is fixed, is held as bytes.
            parts = [_payload(r["tokens"]) for r in own]
            n = sum(map(len, parts)) // 2
            temporary = f"{root}/.{name}.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(temporary) as f:
                f.write(header(n))
                for part in parts:
                    f.write(part)
            files.append((name, temporary, n))
        return Written(files)

    def commit(self, messages: list) -> None:
        system, root = _fs(self.path)
        files = [f for m in messages if m for f in m.files]
        if len({name for name, _, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("a shard was written by two tasks")
        for name, temporary, _ in files:
            system.move(temporary, f"{root}/{name}")

    def abort(self, messages: list) -> None:
        system, _ = _fs(self.path)
        for m in messages:
            for _, temporary, _ in m.files if m else ():
                system.delete_file(temporary)


def _payload(tokens: list[int] | None) -> bytes:
    t = np.asarray(tokens if tokens is not None else [], np.int64)
    if len(t) and (t.min() < 0 or t.max() >= 1 << 16):
        raise ValueError("a token id needs more than 16 bits")
    return t.astype("<u2").tobytes()


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shard"

    def schema(self) -> str:
        return "name string, n_tokens int, pos int, tokens array<int>"

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options)

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(TokenShards)


INSPECTED = "name string, magic int, version int, n_tokens bigint, file_size bigint, sha256 string, document_starts bigint, problem string"


def inspect_shards(spark: SparkSession, folder: str, eot: int = 50256) -> DataFrame:
    """A row per shard file: header, size, digest, separators in it, and what is wrong with it (null if nothing).

    Files are read in pieces, one task a file; only their names are listed first.
    """
    from pyarrow import fs

    system, root = _fs(folder)
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".bin"))
    files = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, len(names)), "path") if names else spark.createDataFrame([], "path string")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path in b["path"]:
                digest, starts, size, odd = hashlib.sha256(), 0, 0, b""
                with _fs(folder)[0].open_input_stream(path) as f:
                    raw = f.read(HEADER)
                    digest.update(raw)
                    size += len(raw)
                    while chunk := f.read(1 << 24):
                        digest.update(chunk)
                        size += len(chunk)
                        chunk = odd + chunk
                        whole = len(chunk) // 2 * 2
                        starts += int((np.frombuffer(chunk[:whole], "<u2") == eot).sum())
                        odd = chunk[whole:]
                magic, version, n = struct.unpack("<3i", raw[:12]) if len(raw) >= 12 else (None, None, None)
                try:
                    problem = check_header(raw, size) and None
                except ValueError as e:
                    problem = str(e)
                rows.append((path.rsplit("/", 1)[-1], magic, version, n, size, digest.hexdigest(), starts, problem))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INSPECTED.split(", ")]).astype({"magic": "Int32", "version": "Int32", "n_tokens": "Int64"})

    return files.mapInPandas(look, INSPECTED)


def compared(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(name, listed, present, differs)``: shards against a manifest (name, and any of n_tokens, file_size, sha256), both ways."""
    known = [c for c in ("n_tokens", "file_size", "sha256", "magic", "version") if c in manifest.columns]
    m = manifest.select("name", F.lit(True).alias("listed"), *[F.col(c).alias(f"m_{c}") for c in known])
    j = found.select("name", F.lit(True).alias("present"), *known).join(m, "name", "full")
    other = F.lit(False)
    for c in known:
        other = other | F.coalesce(F.col(f"m_{c}").isNotNull() & (F.col(c) != F.col(f"m_{c}")), F.lit(False))
    no = F.lit(False)
    return j.select("name", F.coalesce("listed", no).alias("listed"), F.coalesce("present", no).alias("present"), other.alias("differs"))
