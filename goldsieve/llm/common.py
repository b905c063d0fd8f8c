"""What several operators share: stored tables, word patterns, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldsieve.session import ensure_checkpoint_dir

#: A word, as Java's and DuckDB's regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, read again after lost executors."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path, compression="zstd")
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


#: Rows of whole texts in an Arrow batch; Spark's own default would put hundreds of MB of long texts into one.
BATCH_ROWS = 1000


def with_small_batches(frame: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches hold at most ``BATCH_ROWS`` rows from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(frame.sparkSession.conf.get(name)) <= BATCH_ROWS:
        frame.sparkSession.conf.set(name, BATCH_ROWS)
    return frame


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def held_out(doc_id: Column, remainder: int = 2, folds: int = 4) -> Column:
    """Whether a document belongs to the fold that is never learned from; a null id does not."""
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(fold == remainder, F.lit(False))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` text bytes; one longer text makes a batch alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


def give_back() -> None:
    """Returns freed memory to the system, so that a worker that Spark keeps for later tasks holds nothing of this one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def spans(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat positions of consecutive pieces, each given by its offset and length."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(offsets - (ends - lengths), lengths)
