"""Ingest as a stream: every log once, redacted, sampled per micro-batch.

Two ways to keep an id single. ``once_within`` holds the ids of a watermark window in state and is
enough when repeats arrive soon. ``start_ingest`` checks each micro-batch against everything stored and
is exact over any time; a replayed micro-batch replaces its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from goldsieve.operators import ingest
from goldsieve.plans.curation import ingest_batch
from goldsieve.schemas import schema_of
from goldsieve.sources.tables import Tables


def log_stream(spark: SparkSession, folder: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Raw logs arriving as files."""
    reader = spark.readStream.format(fmt).schema(schema_of("raw_logs"))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def once_within(logs: DataFrame, delay: str) -> DataFrame:
    """Drop repeats of an id that arrive within ``delay`` of each other; state is bounded by the watermark."""
    return logs.withWatermark("log_ts", delay).dropDuplicatesWithinWatermark(["id"])


def redacted(logs: DataFrame) -> DataFrame:
    """The stateless part of ingest: redaction and priority, the same expressions as in batch."""
    return ingest.with_priority(ingest.redact(logs))


def start_ingest(
    logs: DataFrame, tables: Tables, checkpoint: str, name: str = "stream", every: str | None = None,
    fraction: float = 0.5, seed: int = 42, ids_keep_time: bool = False,
) -> StreamingQuery:
    """Write normalized logs batch by batch. Without ``every``, take what is there and stop.

    See ``ingest_batch`` for ``ids_keep_time``: a long history is then not read for every micro-batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        ingest_batch(tables, batch, f"{name}-{number:012d}", fraction, seed, ids_keep_time)

    writer = logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
