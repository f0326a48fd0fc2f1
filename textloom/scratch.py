"""Intermediate tables in the folder that all executors share.

Iterative and two-pass operators cut their lineage by writing a table and
reading it back, so that a lost executor costs a re-read and not a re-run. The
folder is the one the session names in ``spark.checkpoint.dir``. Only where
that setting is absent and the master is local is a temporary folder made.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Raises RuntimeError on a cluster without ``spark.checkpoint.dir``: a
    machine-local folder would be invisible to the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="textloom-")
    return _LOCAL[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return it read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        if "/textloom/" in f:
            path.getFileSystem(conf).delete(path, True)


def drop_local_folders() -> None:
    """Remove the temporary folders made for local sessions."""
    for folder in _LOCAL.values():
        shutil.rmtree(folder, ignore_errors=True)
    _LOCAL.clear()
