"""The curation stages in order. Stages talk only through tables; each does what is still pending.

Answers of judges and encoders are materialised before they are used, so a model is asked once per row
even when a stage writes more than one table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.functions.vectors import encode, with_dense_vector, with_token_vector
from goldsieve.operators import cluster, confidence, coverage, dedup, ingest, judge, pending
from goldsieve.operators.upkeep import assign_eval_ids, stable_id
from goldsieve.fixed import VOTE_RUNS
from goldsieve.session import cut_lineage
from goldsieve.sources.tables import Tables

Maker = Callable[[], judge.Answerer]


@dataclass
class Models:
    """Injected models. Without an encoder, prompts are compared by their token counts."""

    labeler: Maker
    golden: Maker
    multi: Maker
    voter: Maker
    label_source: str = "judge"
    encoder: Callable | None = None
    encoder_name: str = "tokens"  # vectors are kept under this name; another encoder needs another
    partitions: int | None = None  # tasks that ask models; by default at least one a core, more with more rows

    def spread(self, frame: DataFrame) -> int:
        return self.partitions or judge.tasks_for(frame)


def _vectors(frame: DataFrame, models: Models) -> DataFrame:
    if models.encoder is None:
        return with_token_vector(frame, "user_prompt").drop("user_prompt")
    dense = encode(frame.repartition(models.spread(frame)), "user_prompt", "embedding", models.encoder)
    return with_dense_vector(dense, "embedding").drop("embedding", "user_prompt")


def _ask(todo: DataFrame, message, maker: Maker, models: Models) -> DataFrame:
    keys = [c for c in todo.columns if c not in ("user_prompt", "model_response")]
    asked = todo.select(*keys, message(F.col("user_prompt"), F.col("model_response")).alias("message"))
    return cut_lineage(judge.infer(asked, "message", "raw", maker, models.spread(asked)).drop("message"))


def ingest_batch(
    tables: Tables, raw: DataFrame, batch: str, fraction: float = 0.5, seed: int = 42, ids_keep_time: bool = False,
) -> None:
    """Normalize the logs no other batch holds. Running a batch again replaces its own rows.

    ``ids_keep_time`` promises that a repeated id comes with the same time. Known ids are then looked up in
    the time range of ``raw`` only, which skips the files of other times by their statistics.
    """
    known = tables.read("normalized_logs").filter(F.col("ingest_batch") != batch)
    if ids_keep_time:
        span = raw.agg(F.min("log_ts").alias("low"), F.max("log_ts").alias("high")).first()
        known = known.filter(F.col("log_ts").between(F.lit(span.low), F.lit(span.high)))
    # Known ids go first, on narrow rows; only what is new is told apart and moved with its texts.
    unseen = raw.join(ingest.new_logs(raw.select("id"), known).distinct(), "id", "left_semi")
    fresh = ingest.normalize(ingest.redact(ingest.mark_sampled(ingest.with_priority(ingest.distinct_logs(unseen)), fraction, seed)))
    tables.put_part("normalized_logs", fresh, batch)


def cluster_batch(tables: Tables, models: Models, batch: str, radius: float | None = None) -> None:
    """Cluster the sampled logs that have no cluster; ids are unique over batches by their batch."""
    sampled = tables.read("normalized_logs").filter("is_sampled = 1").select("id", "ingest_batch")
    ids = cut_lineage(sampled.join(tables.read("cluster_assignments").select("id"), "id", "left_anti"))
    todo = tables.with_texts(ids, "user_prompt").withColumn("item_id", stable_id(F.col("id")))
    vectors = cut_lineage(_vectors(todo, models))
    labels = cluster.density_clusters(vectors.drop("id"), radius)
    named = vectors.select("id", "item_id").join(labels, "item_id")
    tables.append("cluster_assignments", named.withColumn("batch_id", F.lit(batch)))


def label_batch(tables: Tables, models: Models, also: DataFrame | None = None) -> None:
    """Judge novel and badly received logs, and the logs of ``also`` (``id``); failures are kept as fallback labels."""
    signals = tables.read("normalized_logs").select("id", "ingest_batch", "user_feedback")
    clustered = signals.join(tables.read("cluster_assignments").select("id", "cluster_id"), "id", "left")
    ids = cut_lineage(pending.to_label(clustered, tables.read("eval_dataset"), "ingest_batch").dropDuplicates(["id"]))
    todo = tables.with_texts(ids, "user_prompt", "model_response")
    if also is not None:
        labeled = tables.read("eval_dataset").select(F.col("interaction_id").alias("id"))
        more = tables.read("normalized_logs").select("id", "user_prompt", "model_response").join(also.select("id"), "id", "left_semi")
        todo = todo.unionByName(more.join(labeled, "id", "left_anti")).dropDuplicates(["id"])
    todo = todo.withColumnRenamed("id", "interaction_id")
    raw = _ask(todo, judge.label_message, models.labeler, models)
    tables.append("eval_dataset", assign_eval_ids(judge.label_with_fallback(raw, source=F.lit(models.label_source))))


def golden_batch(tables: Tables, models: Models) -> None:
    todo = pending.lacking(tables.read("eval_dataset"), tables.read("golden_answers"), tables.read("normalized_logs"))
    tables.append("golden_answers", judge.golden_rows(_ask(todo, judge.golden_message, models.golden, models)))


def multilabel_batch(tables: Tables, models: Models) -> None:
    todo = pending.lacking(tables.read("eval_dataset"), tables.read("multi_labels"), tables.read("normalized_logs"))
    tables.append("multi_labels", judge.normalize_multilabel(_ask(todo, judge.label_message, models.multi, models)))


def route_batch(tables: Tables, models: Models, runs: int = VOTE_RUNS) -> None:
    """Several votes per eval, then approval or the review queue."""
    todo = pending.lacking(tables.read("eval_dataset"), tables.read("confidence_scores"), tables.read("normalized_logs"))
    raw = _ask(confidence.fan_out_votes(todo, runs), judge.label_message, models.voter, models)
    scores = cut_lineage(confidence.with_status(confidence.majority(judge.normalize_vote(raw))))
    tables.append("human_review_queue", confidence.review_queue(scores))
    tables.append("confidence_scores", scores)


def store_vectors(tables: Tables, models: Models) -> DataFrame:
    """Vectors of all approved evals; each is encoded once and kept for later batches, by eval and encoder."""
    approved = tables.scores().filter("status = 'approved'").select("eval_id")
    kept = tables.read("eval_vectors").filter(F.col("encoder") == models.encoder_name)
    lacking = approved.join(kept.select("eval_id"), "eval_id", "left_anti")
    texts = pending.with_interaction(
        tables.read("eval_dataset").select("eval_id", "interaction_id").join(lacking, "eval_id"), tables.read("normalized_logs"), ["user_prompt"]
    )
    fresh = _vectors(texts.select("eval_id", "user_prompt"), models).withColumn("encoder", F.lit(models.encoder_name))
    tables.append("eval_vectors", fresh)
    stored = tables.read("eval_vectors").filter(F.col("encoder") == models.encoder_name)
    return stored.join(approved, "eval_id", "left_semi").drop("encoder", "created_at").dropDuplicates(["eval_id"])


def dedup_batch(tables: Tables, models: Models, floor: float | None = None) -> None:
    """Decide on approved evals not checked yet, against all approved ones; then refresh coverage."""
    seen = tables.read("dedup_log").select(F.col("candidate_eval_id").alias("eval_id"), F.lit(True).alias("_seen")).distinct()
    vectors = store_vectors(tables, models).join(seen, "eval_id", "left").withColumn("ask", F.col("_seen").isNull()).drop("_seen")
    matches = dedup.best_match(vectors, floor)
    tables.append("dedup_log", dedup.decide(matches, whole_counts=models.encoder is None))
    refresh_coverage(tables)


def refresh_coverage(tables: Tables) -> None:
    """Always rewritten, also when nothing qualifies."""
    report = coverage.coverage_report(tables.read("eval_dataset"), tables.scores(), tables.read("dedup_log"))
    tables.replace("coverage_report", report)


def review(tables: Tables, decisions: DataFrame, *order: str) -> None:
    """Append the outcome of reviewers' decisions (``eval_id, decision``); of several on an eval the last by ``order`` counts."""
    decided = decisions.select("eval_id", "decision", *order)
    hit = decided.select("eval_id").distinct()
    scores, queue = confidence.apply_decisions(
        tables.scores().join(hit, "eval_id", "left_semi"), tables.queue().join(hit, "eval_id", "left_semi"), decided, *order
    )
    tables.append("confidence_scores", scores.drop("created_at"))
    tables.append("human_review_queue", queue.drop("created_at"))


def add_notes(tables: Tables, notes: DataFrame) -> None:
    """Append reviewers' notes (``eval_id, manual_notes``)."""
    tables.append("reviewer_notes", notes.select("eval_id", "manual_notes"))


def fill_gaps(tables: Tables, pool: DataFrame) -> DataFrame:
    """Logs to look at for thin cells: up to the quota per category from ``pool`` (``id, category``)."""
    gaps = coverage.coverage_gaps(tables.read("coverage_report").drop("updated_at"))
    return coverage.top_up(coverage.gap_quota(gaps), pool)


def run_curation(
    tables: Tables, raw: DataFrame, models: Models, batch: str, radius: float | None = None, pool: DataFrame | None = None,
    floor: float | None = None,
) -> None:
    """All stages once, for one batch of raw logs.

    ``radius`` limits how far apart clustered prompts may be, ``floor`` how similar a match must be to be
    looked for. How much work they save depends on the data: texts that resemble nothing meet nearly every block.

    ``pool`` (``id, category``) names stored logs that may fill thin cells of the last coverage report.
    """
    also = None if pool is None else cut_lineage(fill_gaps(tables, pool))
    ingest_batch(tables, raw, batch)
    cluster_batch(tables, models, batch, radius)
    label_batch(tables, models, also)
    golden_batch(tables, models)
    multilabel_batch(tables, models)
    route_batch(tables, models)
    dedup_batch(tables, models, floor)
