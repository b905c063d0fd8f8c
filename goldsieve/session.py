"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# For speed, but for the last of a repeated JSON key being the one that counts, as in most parsers.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


PARTITION_BYTES = 256 << 20
MOST_PARTITIONS = 100_000


def shuffle_partitions(input_bytes: int) -> int:
    """Enough shuffle partitions that one holds about 256 MB; adaptive execution merges small ones."""
    return max(200, min(MOST_PARTITIONS, -(-input_bytes // PARTITION_BYTES)))


def build_session(
    app: str = "goldsieve", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the engine's defaults, sized for ``input_bytes``; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if input_bytes is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions(input_bytes)))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only for a local session that has none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="goldsieve-checkpoint-")
    context.setCheckpointDir(named)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Bits of an estimated size from which a stored frame no longer hands it on.
SIZE_BITS = 62
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Materialise an iterative state in the reliable checkpoint folder.

    A checkpoint keeps the size that the planner had estimated, and a join estimates the product of its sides. In a loop that joins a
    state with itself the digits of the estimate double each round, until they alone fill the driver; beyond ``SIZE_BITS`` it is unknown.
    Shuffle files that led to the checkpoint are removed as soon as it is stored.
    """
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    kept = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        stored = frame.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting
    finally:
        spark.conf.set(_CLEANUP, kept)
    plan = stored._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes().bit_length() <= SIZE_BITS:
        return stored
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), stored._jdf.schema(), False), spark)


def release(stored: DataFrame) -> None:
    """Delete a state that :func:`cut_lineage` returned, once a later one is stored and nothing reads it any more."""
    spark = stored.sparkSession
    file = stored._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
