"""Structured Streaming: append-only trajectories, replayable step streams, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def read_steps(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def last_per_step(stream: DataFrame) -> DataFrame:
    """The last reading of each (run, step), of several at the same times the highest; update or complete mode. State is a row per step."""
    return stream.groupBy("run_id", "step").agg(F.max_by("val_loss", F.struct("logged_at", "received_at", "val_loss")).alias("val_loss"), F.max("logged_at").alias("logged_at"))


def event_windows(stream: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type in tumbling or sliding windows; rows later than ``late`` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Session windows by user."""
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


class StepPartition(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class StepReader(DataSourceStreamReader):
    """The offset is the step: a restarted query replays exactly the steps after its checkpoint."""

    def __init__(self, options: dict):
        self.steps, self.per_batch = int(options.get("steps", 1000)), int(options.get("per_batch", 100))
        self.at = 0

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.steps, self.at + self.per_batch)
        return {"step": self.at}

    def partitions(self, start: dict, end: dict) -> list[StepPartition]:
        self.at = max(self.at, end["step"])
        return [StepPartition(start["step"], end["step"])]

    def read(self, partition: StepPartition) -> Iterator[tuple]:
        for k in range(partition.start, partition.stop):
            yield (k, k / self.steps)

    def commit(self, end: dict) -> None:
        pass


class StepStream(DataSource):
    """``spark.readStream.format("step_stream")``: training steps (step, progress) in order, replayable."""

    @classmethod
    def name(cls) -> str:
        return "step_stream"

    def schema(self) -> str:
        return "step bigint, progress double"

    def streamReader(self, schema) -> StepReader:
        return StepReader(self.options)
