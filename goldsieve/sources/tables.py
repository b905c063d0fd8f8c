"""Stage tables as Parquet folders: declared schemas, appends, replacement, and current views.

Nothing is updated in place. Changes of state are appended and the current row of a key is its newest,
so a write never reads the table it replaces and a lost executor or a restarted job leaves no half
updated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from goldsieve.operators.upkeep import latest_per_key
from goldsieve.schemas import schema_of

# Tables split into folders by these columns.
LAYOUT = {"normalized_logs": "ingest_batch", "eval_results": "run_id"}
# Audit time columns filled at write time when the caller leaves them out.
AUDIT = {"created_at", "updated_at", "noted_at"}

# The table that lists the columns other tables gained.
ADDED, ADDED_SCHEMA = "added_columns", "`table` string, `column` string, kind string"


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._added: dict[str, dict[str, str]] | None = None

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _schema(self, name: str):
        schema = schema_of(name)
        for column, kind in self.added_columns(name).items():
            schema = schema.add(column, kind)
        folder = LAYOUT.get(name)
        return schema.add(folder, "string") if folder and folder not in schema.names else schema

    def added_columns(self, name: str) -> dict[str, str]:
        """Columns that a table has gained since it was declared, and their types."""
        if self._added is None:
            self._added = {}
            if self.exists(ADDED):  # a row a column
                for r in sorted(self.spark.read.schema(ADDED_SCHEMA).parquet(self.path(ADDED)).collect()):
                    self._added.setdefault(r.table, {}).setdefault(r.column, r.kind)
        return self._added.get(name, {})

    def add_column(self, name: str, column: str, kind: str) -> None:
        """Gives a stored table a nullable column; a table that has it stays as it is. No file is written anew: rows
        stored before are read as NULL, rows appended from now on may have it."""
        self._added = None  # another writer may have added some
        if column in self._schema(name).names:
            return
        row = self.spark.createDataFrame([(name, column, kind)], ADDED_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(self.path(ADDED))
        self._added = None

    def read(self, name: str) -> DataFrame:
        """The table as declared; empty before the first write, NULL for columns older files lack."""
        schema = self._schema(name)
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def _shape(self, name: str, rows: DataFrame) -> DataFrame:
        columns = []
        for field in self._schema(name).fields:
            if field.name in rows.columns:
                column = F.col(field.name)
            elif field.name in AUDIT:
                column = F.current_timestamp()
            else:
                column = F.lit(None)
            columns.append(column.cast(field.dataType).alias(field.name))
        return rows.select(*columns)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows with the declared columns and audit times."""
        writer = self._shape(name, rows).write.mode("append")
        if name in LAYOUT:
            writer = writer.partitionBy(LAYOUT[name])
        writer.parquet(self.path(name))

    def put_part(self, name: str, rows: DataFrame, part: str) -> None:
        """Write one folder of a split table; doing it again replaces that folder only, also by nothing."""
        written = Observation()
        shaped = self._shape(name, rows.withColumn(LAYOUT[name], F.lit(part))).observe(written, F.count(F.lit(1)).alias("n"))
        shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(LAYOUT[name]).parquet(
            self.path(name)
        )
        if not written.get["n"] and self.exists(name):  # no row, no folder: the old one would stay
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/{LAYOUT[name]}={part}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Replace all rows, also by none. ``rows`` must not read the same table."""
        self._shape(name, rows).write.mode("overwrite").parquet(self.path(name))

    def ensure(self, name: str) -> None:
        """Create the table with its schema if it is absent."""
        if not self.exists(name):
            self.replace(name, self.spark.createDataFrame([], self._schema(name)))

    # --- current views -----------------------------------------------------------------------------
    def scores(self) -> DataFrame:
        return latest_per_key(self.read("confidence_scores"), "eval_id", "created_at")

    def queue(self) -> DataFrame:
        return latest_per_key(self.read("human_review_queue"), "eval_id", "created_at")

    def runs(self) -> DataFrame:
        stamped = self.read("eval_runs").withColumn("_at", F.coalesce("completed_at", "started_at"))
        return latest_per_key(stamped, "run_id", "_at").drop("_at")

    def logs(self) -> DataFrame:
        """Normalized logs with their cluster, NULL when not clustered."""
        clusters = self.read("cluster_assignments").select("id", "cluster_id", "batch_id")
        return self.read("normalized_logs").join(clusters, "id", "left")

    def with_texts(self, ids: DataFrame, *columns: str) -> DataFrame:
        """``ids`` (``id, ingest_batch``, stored) with columns of their logs; only the batches that occur are read."""
        batches = [r[0] for r in ids.select("ingest_batch").distinct().collect()]  # one short name a batch
        logs = self.read("normalized_logs").filter(F.col("ingest_batch").isin(batches))
        return logs.select("id", *columns).join(ids.select("id"), "id", "left_semi")

    def evals(self) -> DataFrame:
        """Evals with the newest reviewer note."""
        notes = latest_per_key(self.read("reviewer_notes"), "eval_id", "noted_at").select("eval_id", "manual_notes")
        return self.read("eval_dataset").join(notes, "eval_id", "left")
