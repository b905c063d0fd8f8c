"""Registered queries: ingest, pending work, judges, routing, coverage, evaluation, comparison, review.

Each entry runs an operator over the whole tables; the SQL next to it says the same in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from goldsieve.functions.text import redact_pii
from goldsieve.operators import confidence, coverage, curate, evaluate, ingest, judge, numbering, pending, regress, upkeep
from goldsieve.plans.registry import query

# --- SQL pieces shared by several checks -----------------------------------------------------------
_REDACT = r"""regexp_replace(regexp_replace({c}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}', '[REDACTED_EMAIL]', 'g'),
    '\b\d{{3}}[-.]?\d{{3}}[-.]?\d{{4}}\b', '[REDACTED_PHONE]', 'g')"""
_PRIORITY = """(CASE WHEN user_feedback IN ('thumbs_down', 'retry') THEN 5 ELSE 1 END
    + CASE WHEN latency_ms > 1500 THEN 2 ELSE 0 END)"""
_SAMPLED = f"""new AS (SELECT *, {_PRIORITY} AS w FROM raw_logs WHERE id NOT IN (SELECT id FROM ingested_ids)),
tot AS (SELECT CAST(round_even(0.5 * count(*), 0) AS DOUBLE) AS n, CAST(sum(w) AS DOUBLE) AS tw FROM new),
picked AS (SELECT new.*, CAST(CASE WHEN ('0x' || substr(md5('42:' || id), 1, 13))::BIGINT / pow(2, 52)
                                        < 1 - pow(1 - w / tw, n) THEN 1 ELSE 0 END AS INT) AS is_sampled FROM new, tot)"""
_JSON = "(CASE WHEN json_valid(raw) THEN CASE WHEN json_type(raw::JSON) = 'OBJECT' THEN raw::JSON END END)"


_IS_APPROVED = "eval_id IN (SELECT eval_id FROM confidence_scores WHERE status = 'approved')"
_NOT_REJECTED = "eval_id NOT IN (SELECT candidate_eval_id FROM dedup_log WHERE action <> 'accepted')"


def _truthy(value: str) -> str:
    return f"""(CASE json_type({value}) WHEN 'NULL' THEN false WHEN 'VARCHAR' THEN ({value} ->> '$') <> ''
        WHEN 'BOOLEAN' THEN ({value} ->> '$') = 'true' WHEN 'ARRAY' THEN json_array_length({value}) > 0
        WHEN 'OBJECT' THEN len(json_keys({value})) > 0 ELSE TRY_CAST(({value} ->> '$') AS DOUBLE) <> 0 END)"""


def _first(doc: str, keys: list[str]) -> str:
    tries = [f"""CASE WHEN {_truthy(f"({doc} -> '$.\"{k}\"')")} THEN ({doc} ->> '$."{k}"') END""" for k in keys]
    return "coalesce(" + ", ".join(tries + ["NULL"]) + ")"


# --- ingest -------------------------------------------------------------------------------------------
@query("ingest_new_logs", "SELECT id, user_prompt, latency_ms, user_feedback FROM raw_logs WHERE id NOT IN (SELECT id FROM ingested_ids)")
def ingest_new_logs(t):
    return ingest.new_logs(t.raw_logs, t.ingested_ids).select("id", "user_prompt", "latency_ms", "user_feedback")


@query(
    "redact_pii",
    f"SELECT id, {_REDACT.format(c='user_prompt')} AS user_prompt, {_REDACT.format(c='model_response')} AS model_response FROM raw_logs",
)
def redact_query(t):
    return ingest.redact(t.raw_logs).select("id", "user_prompt", "model_response")


@query("redact_documents", f"SELECT doc_id, {_REDACT.format(c='text')} AS text FROM documents")
def redact_documents(t):
    return t.documents.select("doc_id", redact_pii(F.col("text")).alias("text"))


@query("priority_score", f"SELECT id, CAST({_PRIORITY} AS INT) AS priority_score FROM raw_logs")
def priority_query(t):
    return ingest.with_priority(t.raw_logs).select("id", "priority_score")


@query("signal_sample", f"WITH {_SAMPLED} SELECT id, CAST(w AS INT) AS priority_score FROM picked WHERE is_sampled = 1")
def signal_sample(t):
    fresh = ingest.new_logs(t.raw_logs, t.ingested_ids)
    marked = ingest.mark_sampled(ingest.with_priority(fresh))
    return marked.filter(F.col("is_sampled") == 1).select("id", "priority_score")


@query(
    "signal_draws",
    f"""WITH {_SAMPLED}, line AS (SELECT id, w, CAST(sum(w) OVER (ORDER BY id) AS BIGINT) - w AS before FROM new),
    points AS (SELECT CAST(floor(('0x' || substr(md5('42:draw' || j), 1, 13))::BIGINT / pow(2, 52) * tw) AS BIGINT) AS point
        FROM (SELECT unnest(range(CAST(n AS BIGINT))) AS j, tw FROM tot))
    SELECT id, count(*) AS draws FROM points JOIN line ON point >= before AND point < before + w GROUP BY id""",
)
def signal_draws(t):
    fresh = ingest.with_priority(ingest.new_logs(t.raw_logs, t.ingested_ids).select("id", "user_feedback", "latency_ms"))
    return numbering.weighted_draws(fresh, "id", "priority_score")


@query(
    "normalize_logs",
    f"""WITH {_SAMPLED} SELECT id, log_ts, {_REDACT.format(c='user_prompt')} AS user_prompt,
    {_REDACT.format(c='model_response')} AS model_response, latency_ms, user_feedback, is_sampled FROM picked""",
)
def normalize_logs(t):
    return ingest.ingest(t.raw_logs, t.ingested_ids)


@query(
    "distinct_ids",
    "SELECT DISTINCT id, user_feedback FROM (SELECT id, user_feedback FROM raw_logs UNION ALL SELECT id, user_feedback FROM normalized_logs)",
)
def distinct_ids(t):
    twice = t.raw_logs.select("id", "user_feedback").unionAll(t.normalized_logs.select("id", "user_feedback"))
    return ingest.distinct_logs(twice)


@query(
    "token_estimate",
    """SELECT id, CAST(floor(length(user_prompt) / 4) AS INT) AS prompt_tokens,
              CAST(floor(length(model_response) / 4) AS INT) AS completion_tokens FROM raw_logs""",
)
def token_estimate_query(t):
    return ingest.with_token_estimates(t.raw_logs).select("id", "prompt_tokens", "completion_tokens")


# --- pending work -------------------------------------------------------------------------------------
@query("pending_cluster", "SELECT id, user_prompt, model_response FROM normalized_logs WHERE is_sampled = 1 AND cluster_id IS NULL")
def pending_cluster(t):
    return pending.to_cluster(t.normalized_logs).select("id", "user_prompt", "model_response")


@query(
    "label_candidates",
    """SELECT id, user_prompt, model_response FROM normalized_logs
       WHERE id NOT IN (SELECT interaction_id FROM eval_dataset)
         AND (coalesce(cluster_id, 0) = -1 OR coalesce(user_feedback, '') IN ('thumbs_down', 'retry'))""",
)
def label_candidates(t):
    return pending.to_label(t.normalized_logs, t.eval_dataset)


def _lacking(table: str, extra: str = "") -> str:
    return f"""SELECT eval_id, user_prompt, model_response{extra} FROM eval_dataset JOIN interactions ON id = interaction_id
       WHERE eval_id NOT IN (SELECT eval_id FROM {table})"""


@query("pending_golden", _lacking("golden_answers", ", category"))
def pending_golden(t):
    return pending.lacking(t.eval_dataset, t.golden_answers, t.interactions, "category")


@query("pending_multilabel", _lacking("multi_labels"))
def pending_multilabel(t):
    return pending.lacking(t.eval_dataset, t.multi_labels, t.interactions)


@query("pending_confidence", _lacking("confidence_scores"))
def pending_confidence(t):
    return pending.lacking(t.eval_dataset, t.confidence_scores, t.interactions)


@query(
    "approved_evals",
    f"SELECT eval_id, user_prompt FROM eval_dataset JOIN interactions ON id = interaction_id WHERE {_IS_APPROVED}",
)
def approved_evals(t):
    return pending.approved(t.eval_dataset, t.confidence_scores, t.interactions)


@query(
    "dedup_candidates",
    f"""SELECT eval_id, user_prompt FROM eval_dataset JOIN interactions ON id = interaction_id
        WHERE {_IS_APPROVED} AND eval_id NOT IN (SELECT candidate_eval_id FROM dedup_log)""",
)
def dedup_candidates(t):
    return pending.approved_unchecked(t.eval_dataset, t.confidence_scores, t.interactions, t.dedup_log)


# --- judges -------------------------------------------------------------------------------------------
@query(
    "batch_judge",
    """SELECT eval_id, '{"category":"Normal","quality_score":' || CAST(length(message) % 5 + 1 AS VARCHAR) || '}' AS raw
       FROM (SELECT e.eval_id, 'User: ' || coalesce(i.user_prompt, 'None') || chr(10) || 'AI: ' || coalesce(i.model_response, 'None') AS message
             FROM eval_dataset e JOIN interactions i ON i.id = e.interaction_id)""",
)
def batch_judge(t):
    texts = pending.with_interaction(t.eval_dataset, t.interactions, ["user_prompt", "model_response"])
    asked = texts.select("eval_id", judge.label_message(F.col("user_prompt"), F.col("model_response")).alias("message"))
    return judge.infer(asked, "message", "raw", judge.length_judge).select("eval_id", "raw")


@query("judge_votes_long", "SELECT eval_id, category, CAST(r AS INT) AS run_idx FROM eval_dataset, generate_series(1, 3) AS g(r)")
def judge_votes_long(t):
    return confidence.fan_out_votes(t.eval_dataset.select("eval_id", "category"), 3)


@query(
    "judge_messages",
    """SELECT e.eval_id,
       'User: ' || coalesce(i.user_prompt, 'None') || chr(10) || 'AI: ' || coalesce(i.model_response, 'None') AS label_message,
       'User prompt: ' || coalesce(i.user_prompt, 'None') || chr(10) || 'AI response: ' || coalesce(i.model_response, 'None') AS golden_message,
       'User Prompt: ' || coalesce(i.user_prompt, 'None') || chr(10) || chr(10) || 'Golden Reference / Rubric (score 5): '
         || coalesce(nullif(g.golden_answer, ''), nullif(g.rubric_score_5, ''), 'No reference provided.')
         || chr(10) || chr(10) || 'Model Response to Score: ' || coalesce(i.model_response, 'None')
         || chr(10) || chr(10) || 'Must Contain: ' || replace(coalesce(m.must_contain, '[]'), '","', '", "')
         || chr(10) || 'Must NOT Contain: ' || replace(coalesce(m.must_not_contain, '[]'), '","', '", "')
         || chr(10) || 'Expected Behavior: ' || coalesce(m.expected_behavior, 'None') || chr(10) AS score_message
       FROM eval_dataset e JOIN interactions i ON i.id = e.interaction_id
       LEFT JOIN golden_answers g ON g.eval_id = e.eval_id LEFT JOIN multi_labels m ON m.eval_id = e.eval_id""",
)
def judge_messages(t):
    view = curate.explorer(t.eval_dataset, t.interactions, t.confidence_scores, t.golden_answers, t.multi_labels)
    prompt, response = F.col("user_prompt"), F.col("model_response")
    reference = judge.reference_text(F.col("golden_answer"), F.col("rubric_score_5"))
    return view.select(
        "eval_id",
        judge.label_message(prompt, response).alias("label_message"),
        judge.golden_message(prompt, response).alias("golden_message"),
        judge.score_message(
            prompt, reference, response, F.col("must_contain"), F.col("must_not_contain"), F.col("expected_behavior")
        ).alias("score_message"),
    )


_CATEGORY = f"coalesce({_first('j', ['category', 'Category', 'interaction_type'])}, 'Unknown')"
_QUALITY = f"CAST(coalesce({_first('j', ['quality_score', 'quality', 'score'])}, '3') AS INT)"
_DIFFICULTY = f"coalesce({_first('j', ['difficulty', 'Difficulty', 'complexity'])}, 'simple')"
_REASONING = f"coalesce({_first('j', ['reasoning', 'Reasoning', 'explanation'])}, 'No reasoning provided')"


@query(
    "normalize_label",
    f"""SELECT eval_id, {_CATEGORY} AS category, {_QUALITY} AS quality_score, {_DIFFICULTY} AS difficulty,
       {_REASONING} AS reasoning FROM (SELECT eval_id, {_JSON} AS j FROM judge_raw) WHERE j IS NOT NULL""",
)
def normalize_label(t):
    return judge.normalize_label(t.judge_raw)


@query(
    "label_with_fallback",
    f"""SELECT eval_id, CASE WHEN j IS NULL THEN 'Labeling Failed' ELSE {_CATEGORY} END AS category,
       CASE WHEN j IS NULL THEN 3 ELSE {_QUALITY} END AS quality_score,
       CASE WHEN j IS NULL THEN 'unknown' ELSE {_DIFFICULTY} END AS difficulty,
       CASE WHEN raw IS NULL THEN 'OpenRouter failed (openrouter_exhausted)' WHEN j IS NULL THEN 'OpenRouter failed (parse_error)'
            ELSE {_REASONING} END AS reasoning,
       CASE WHEN j IS NULL THEN 'fallback' ELSE 'openrouter:judge-1' END AS labeled_by,
       CAST(CASE WHEN j IS NOT NULL AND {_QUALITY} >= 4 THEN 1 ELSE 0 END AS INT) AS is_positive_case
       FROM (SELECT eval_id, raw, {_JSON} AS j FROM judge_raw)""",
)
def label_with_fallback(t):
    return judge.label_with_fallback(t.judge_raw, source=judge.model_source(F.lit("vendor/judge-1:free")))


@query(
    "normalize_golden",
    f"""SELECT eval_id, coalesce({_first('j', ['question_type', 'type', 'question_type_label'])}, 'unknown') AS question_type,
       coalesce({_first('j', ['chain_of_thought', 'reasoning'])}, '') AS chain_of_thought,
       {_first('j', ['golden_answer', 'reference_answer', 'answer'])} AS golden_answer
       FROM (SELECT eval_id, {_JSON} AS j FROM golden_raw) WHERE j IS NOT NULL AND len(json_keys(j)) > 0""",
)
def normalize_golden(t):
    return judge.normalize_golden(t.golden_raw)


@query(
    "normalize_rubric",
    f"""WITH found AS (SELECT eval_id, CASE WHEN {_truthy("(j -> '$.rubric')")} THEN j -> '$.rubric'
            WHEN {_truthy("(j -> '$.scoring_rubric')")} THEN j -> '$.scoring_rubric' END AS r
            FROM (SELECT eval_id, {_JSON} AS j FROM golden_raw) WHERE j IS NOT NULL AND len(json_keys(j)) > 0),
       shaped AS (SELECT eval_id, CASE WHEN json_type(r) = 'OBJECT' THEN r
              WHEN json_type(r) = 'VARCHAR' THEN CASE WHEN json_valid(r ->> '$') THEN (r ->> '$')::JSON END END AS o,
            CASE WHEN json_type(r) = 'VARCHAR' THEN CASE WHEN NOT json_valid(r ->> '$') THEN r ->> '$' END END AS plain FROM found)
       SELECT eval_id, coalesce({_first('o', ['score_5', '5', 'excellent'])}, plain, '') AS rubric_score_5,
       coalesce({_first('o', ['score_3', '3', 'acceptable'])}, '') AS rubric_score_3,
       coalesce({_first('o', ['score_1', '1', 'poor'])}, '') AS rubric_score_1 FROM shaped""",
)
def normalize_rubric(t):
    return judge.normalize_rubric(t.golden_raw)


@query(
    "normalize_multilabel",
    f"""SELECT eval_id, CAST(coalesce({_first('j', ['expected_quality'])}, '3') AS INT) AS expected_quality,
       coalesce({_first('j', ['expected_behavior'])}, 'should_answer') AS expected_behavior,
       coalesce({_first('j', ['must_contain'])}, '[]') AS must_contain,
       coalesce({_first('j', ['must_not_contain'])}, '[]') AS must_not_contain
       FROM (SELECT eval_id, {_JSON} AS j FROM judge_raw) WHERE j IS NOT NULL""",
)
def normalize_multilabel(t):
    return judge.normalize_multilabel(t.judge_raw)


@query(
    "normalize_vote",
    f"""SELECT eval_id, CASE WHEN j IS NOT NULL THEN coalesce({_first('j', ['category', 'Category'])}, 'Unknown') END AS category,
       CASE WHEN j IS NOT NULL THEN coalesce({_first('j', ['expected_behavior', 'behavior'])}, 'should_answer') END AS behavior
       FROM (SELECT eval_id, {_JSON} AS j FROM judge_raw)""",
)
def normalize_vote(t):
    return judge.normalize_vote(t.judge_raw)


def _flag(key: str, default: str) -> str:
    return f"""CASE WHEN j IS NULL THEN false WHEN (j -> '$.{key}') IS NULL THEN {default}
               ELSE coalesce(CAST((j ->> '$.{key}') AS BOOLEAN), false) END"""


@query(
    "normalize_score",
    f"""SELECT eval_case_id, CASE WHEN j IS NULL THEN 3 ELSE CAST(coalesce({_first('j', ['score'])}, '3') AS INT) END AS score,
       {_flag('passed', 'false')} AS judge_passed, {_flag('must_contain_pass', 'false')} AS must_contain_pass,
       {_flag('must_not_contain_pass', 'true')} AS must_not_contain_pass,
       CASE WHEN j IS NULL THEN 'No score returned' ELSE coalesce({_first('j', ['reasoning'])}, '') END AS reasoning
       FROM (SELECT eval_case_id, {_JSON} AS j FROM score_raw)""",
)
def normalize_score(t):
    return judge.normalize_score(t.score_raw)


# --- routing and review -----------------------------------------------------------------------------
_MAJORITY = """per AS (SELECT eval_id, category AS v, count(*) AS n, min(run_idx) AS f FROM judge_votes WHERE category IS NOT NULL GROUP BY 1, 2),
beh AS (SELECT eval_id, behavior AS v, count(*) AS n, min(run_idx) AS f FROM judge_votes WHERE behavior IS NOT NULL GROUP BY 1, 2),
maj AS (SELECT t.eval_id, CAST(t.runs AS INT) AS num_runs,
  coalesce(CAST(c.n AS DOUBLE) / t.runs, 0.0) AS agreement_ratio, coalesce(c.v, 'Unknown') AS majority_category,
  CASE WHEN c.v IS NULL THEN 'should_answer' ELSE coalesce(b.v, 'should_answer') END AS majority_behavior
  FROM (SELECT eval_id, count(*) AS runs FROM judge_votes GROUP BY 1) t
  LEFT JOIN (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY eval_id ORDER BY n DESC, f) = 1) c ON c.eval_id = t.eval_id
  LEFT JOIN (SELECT * FROM beh QUALIFY row_number() OVER (PARTITION BY eval_id ORDER BY n DESC, f) = 1) b ON b.eval_id = t.eval_id)"""


@query("majority_vote", f"WITH {_MAJORITY} SELECT * FROM maj")
def majority_vote(t):
    return confidence.majority(t.judge_votes)


@query(
    "confidence_status",
    f"WITH {_MAJORITY} SELECT eval_id, agreement_ratio, CASE WHEN agreement_ratio >= 0.65 THEN 'approved' ELSE 'needs_review' END AS status FROM maj",
)
def confidence_status(t):
    scored = confidence.with_status(confidence.majority(t.judge_votes))
    return scored.select("eval_id", "agreement_ratio", "status")


@query(
    "review_queue",
    f"""WITH {_MAJORITY} SELECT eval_id, 'Low confidence (' || CAST(CAST(round_even(agreement_ratio * 100, 0) AS INT) AS VARCHAR)
        || '% agreement across ' || CAST(num_runs AS VARCHAR) || ' runs)' AS reason, 0 AS reviewed FROM maj WHERE agreement_ratio < 0.65""",
)
def review_queue(t):
    return confidence.review_queue(confidence.with_status(confidence.majority(t.judge_votes)))


@query(
    "upsert_latest",
    f"""WITH {_MAJORITY} SELECT eval_id, CASE WHEN agreement_ratio >= 0.65 THEN num_runs * 2 ELSE num_runs END AS num_runs, agreement_ratio,
        majority_category, majority_behavior, CASE WHEN agreement_ratio >= 0.65 THEN 'approved' ELSE 'needs_review' END AS status FROM maj
        WHERE eval_id IN (SELECT candidate_eval_id FROM dedup_log)
        UNION ALL SELECT eval_id, num_runs, agreement_ratio, majority_category, majority_behavior, status FROM confidence_scores
        WHERE eval_id NOT IN (SELECT candidate_eval_id FROM dedup_log)""",
)
def upsert_latest(t):
    rerun = t.dedup_log.select(F.col("candidate_eval_id").alias("eval_id"))
    fresh = confidence.with_status(confidence.majority(t.judge_votes.join(rerun, "eval_id", "left_semi"))).withColumn("attempt", F.lit(1))
    again = fresh.filter("status = 'approved'").withColumn("num_runs", F.col("num_runs") * 2).withColumn("attempt", F.lit(2))
    return upkeep.upsert(t.confidence_scores, again.unionByName(fresh), "eval_id", "attempt").drop("attempt")


@query(
    "insert_if_absent",
    """SELECT run_id, model_name FROM (SELECT run_id, model_name FROM eval_runs WHERE completed_at IS NOT NULL)
       UNION ALL SELECT run_id, 'model_b' FROM eval_runs WHERE completed_at IS NULL""",
)
def insert_if_absent(t):
    runs = t.eval_runs
    stored = runs.filter(F.col("completed_at").isNotNull()).select("run_id", "model_name")
    twice = runs.select("run_id", F.explode(F.array(F.lit("model_c"), F.lit("model_b"))).alias("model_name"))
    twice = twice.withColumn("attempt", F.when(F.col("model_name") == "model_b", 1).otherwise(2))
    return upkeep.insert_if_absent(stored, twice, "run_id", "attempt").drop("attempt")


@query(
    "keyed_update",
    """SELECT e.eval_id, e.interaction_id, e.category, e.difficulty, e.quality_score,
       CASE n.manual_notes WHEN 'looks fine' THEN 'read again' ELSE n.manual_notes END AS manual_notes
       FROM eval_dataset e LEFT JOIN review_notes n ON n.eval_id = e.eval_id""",
)
def keyed_update(t):
    with_notes = upkeep.add_missing_column(t.eval_dataset, "manual_notes", "string")
    first = t.review_notes.withColumn("at", F.lit(1))
    second = first.filter("manual_notes = 'looks fine'").withColumns({"manual_notes": F.lit("read again"), "at": F.lit(2)})
    return upkeep.keyed_update(with_notes, second.unionByName(first), "eval_id", "at")


@query(
    "add_missing_column",
    "SELECT eval_id, category, difficulty, CAST(NULL AS VARCHAR) AS manual_notes FROM eval_dataset",
)
def add_missing_column(t):
    frame = t.eval_dataset.select("eval_id", "category", "difficulty")
    once = upkeep.add_missing_column(frame, "manual_notes", "string")
    return upkeep.add_missing_column(once, "manual_notes", "string")


@query(
    "assign_eval_ids",
    """SELECT i.id AS interaction_id,
       CAST(('0x' || substr(md5(i.id), 1, 16))::UBIGINT % 9223372036854775807 AS BIGINT) AS eval_id
       FROM normalized_logs i WHERE i.id NOT IN (SELECT interaction_id FROM eval_dataset)
         AND (coalesce(cluster_id, 0) = -1 OR coalesce(user_feedback, '') IN ('thumbs_down', 'retry'))""",
)
def assign_eval_ids(t):
    todo = pending.to_label(t.normalized_logs, t.eval_dataset).select(F.col("id").alias("interaction_id"))
    return upkeep.assign_eval_ids(todo)


@query(
    "dense_eval_ids",
    """WITH todo AS (SELECT i.id AS interaction_id, labeled_late, row_number() OVER (ORDER BY labeled_late, i.id) AS dense_id
       FROM (SELECT *, coalesce(user_feedback, '') = 'retry' AS labeled_late FROM normalized_logs) i
       WHERE i.id NOT IN (SELECT interaction_id FROM eval_dataset)
         AND (coalesce(cluster_id, 0) = -1 OR coalesce(user_feedback, '') IN ('thumbs_down', 'retry')))
       SELECT interaction_id, dense_id FROM todo""",
)
def dense_eval_ids(t):
    """Two batches: retried requests come second and go on from the last number of the others."""
    todo = pending.to_label(t.normalized_logs, t.eval_dataset).select(F.col("id").alias("interaction_id"))
    late = t.normalized_logs.filter("user_feedback = 'retry'").select(F.col("id").alias("interaction_id"))
    first = numbering.dense_ids(todo.join(late, "interaction_id", "left_anti"), "interaction_id", "dense_id")
    second = numbering.dense_ids(todo.join(late, "interaction_id", "left_semi"), "interaction_id", "dense_id", first)
    return first.unionByName(second)


@query(
    "apply_review_decisions",
    """SELECT c.eval_id, coalesce(CASE d.decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' END, c.status) AS status,
       CAST(CASE WHEN d.eval_id IS NOT NULL THEN 1 ELSE q.reviewed END AS INT) AS reviewed
       FROM confidence_scores c LEFT JOIN review_decisions d ON d.eval_id = c.eval_id LEFT JOIN human_review_queue q ON q.eval_id = c.eval_id""",
)
def apply_review_decisions(t):
    final = t.review_decisions.withColumn("at", F.lit(2))
    taken_back = final.withColumns({"decision": F.when(F.col("decision") == "approve", "reject").otherwise("approve"), "at": F.lit(1)})
    scores, queue = confidence.apply_decisions(t.confidence_scores, t.human_review_queue, final.unionByName(taken_back), "at")
    return scores.select("eval_id", "status").join(queue.select("eval_id", "reviewed"), "eval_id", "left")


# --- coverage -----------------------------------------------------------------------------------------
_REPORT = f"""rep AS (SELECT category, difficulty, count(*) AS count, avg(agreement_ratio) AS avg_confidence
  FROM eval_dataset JOIN confidence_scores USING (eval_id) WHERE status = 'approved' AND {_NOT_REJECTED} GROUP BY ALL)"""
_GAPS = f"""{_REPORT}, gaps AS (SELECT category, difficulty, count, 5 - count AS needed FROM rep WHERE count < 5
  UNION ALL SELECT c, 'simple', 0, 5 FROM (VALUES ('Normal'), ('Jailbreak'), ('Angry User'), ('Refusal'), ('Policy Question'), ('Hallucination')) AS v(c)
  WHERE c NOT IN (SELECT category FROM rep))"""


def _report(t):
    return coverage.coverage_report(t.eval_dataset, t.confidence_scores, t.dedup_log)


@query("coverage_report", f"WITH {_REPORT} SELECT category, difficulty, count, round(avg_confidence, 9) AS avg_confidence FROM rep")
def coverage_report(t):
    return _report(t).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query(
    "coverage_delta",
    f"""WITH reviewed AS (SELECT c.eval_id, c.agreement_ratio,
        coalesce(CASE d.decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' END, c.status) AS status
        FROM confidence_scores c LEFT JOIN review_decisions d ON d.eval_id = c.eval_id)
    SELECT category, difficulty, count(*) AS count, round(avg(agreement_ratio), 9) AS avg_confidence
    FROM eval_dataset JOIN reviewed USING (eval_id) WHERE status = 'approved' AND {_NOT_REJECTED} GROUP BY ALL""",
)
def coverage_delta(t):
    """The report before the review decisions, carried on by the evals that these touch."""
    state = coverage.coverage_state(coverage.counted_evals(t.eval_dataset, t.confidence_scores, t.dedup_log))
    touched = t.review_decisions.select("eval_id").distinct()
    old = t.confidence_scores.join(touched, "eval_id", "left_semi")
    decisions = t.review_decisions.withColumn("at", F.lit(1))
    new, _ = confidence.apply_decisions(old, t.human_review_queue, decisions, "at")
    evals, log = t.eval_dataset.join(touched, "eval_id", "left_semi"), t.dedup_log
    delta = coverage.coverage_delta(coverage.counted_evals(evals, old, log), coverage.counted_evals(evals, new, log))
    return coverage.report_of(coverage.apply_delta(state, delta)).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query("coverage_flagged", f"WITH {_REPORT} SELECT category, difficulty, count, count < 3 AS needs_more FROM rep")
def coverage_flagged(t):
    return coverage.flag_thin(_report(t)).drop("avg_confidence")


@query("coverage_gaps", f"WITH {_GAPS} SELECT * FROM gaps")
def coverage_gaps(t):
    return coverage.coverage_gaps(_report(t))


@query("gap_quota", f"WITH {_GAPS} SELECT *, needed * 2 AS quota FROM gaps")
def gap_quota(t):
    return coverage.gap_quota(coverage.coverage_gaps(_report(t)))


@query(
    "coverage_top_up",
    f"""WITH {_GAPS}, quota AS (SELECT category, sum(needed * 2) AS quota FROM gaps GROUP BY 1)
       SELECT id, category FROM (SELECT p.id, p.category, q.quota, row_number() OVER (PARTITION BY p.category
            ORDER BY ('0x' || substr(md5('42:' || p.id), 1, 13))::BIGINT / pow(2, 52), p.id) AS r
          FROM (SELECT l.id, CASE WHEN l.user_feedback IS NULL THEN 'Hallucination' ELSE 'Jailbreak' END AS category
                FROM normalized_logs l WHERE l.is_sampled = 0
                UNION ALL SELECT l.id, e.category FROM normalized_logs l JOIN eval_dataset e ON e.interaction_id = l.id
                WHERE l.is_sampled = 1) p JOIN quota q ON q.category = p.category)
       WHERE r <= quota""",
)
def coverage_top_up(t):
    logs = t.normalized_logs.select("id", "user_feedback", "is_sampled")
    guessed = logs.filter(F.col("is_sampled") == 0).select(
        "id", F.when(F.col("user_feedback").isNull(), "Hallucination").otherwise("Jailbreak").alias("category")
    )
    labels = t.eval_dataset.select(F.col("interaction_id").alias("id"), "category")
    known = logs.filter(F.col("is_sampled") == 1).join(labels, "id").select("id", "category")
    quotas = coverage.gap_quota(coverage.coverage_gaps(_report(t)))
    return coverage.top_up(quotas, guessed.unionByName(known))


# --- evaluation ---------------------------------------------------------------------------------------
_CASES = f"""cases AS (SELECT eval_id, category, difficulty, user_prompt, golden_answer, rubric_score_5, must_contain,
  must_not_contain, expected_behavior FROM eval_dataset JOIN interactions ON id = interaction_id
  LEFT JOIN golden_answers USING (eval_id) LEFT JOIN multi_labels USING (eval_id) WHERE {_IS_APPROVED} AND {_NOT_REJECTED})"""
_CHECKS = """checks AS (SELECT e.eval_id,
  len(list_filter(coalesce(from_json(m.must_contain, '["VARCHAR"]'), []), lambda x: NOT contains(lower(coalesce(i.model_response, '')), lower(x)))) = 0 AS must_contain_pass,
  len(list_filter(coalesce(from_json(m.must_not_contain, '["VARCHAR"]'), []), lambda x: contains(lower(coalesce(i.model_response, '')), lower(x)))) = 0 AS must_not_contain_pass
  FROM eval_dataset e JOIN interactions i ON i.id = e.interaction_id LEFT JOIN multi_labels m ON m.eval_id = e.eval_id)"""


def _cases(t):
    return evaluate.eval_cases(
        t.eval_dataset, t.interactions, t.confidence_scores, t.golden_answers, t.multi_labels, t.dedup_log
    )


def _checked(t):
    view = pending.with_interaction(t.eval_dataset, t.interactions, ["model_response"])
    return evaluate.check_assertions(view.join(t.multi_labels, "eval_id", "left"))


@query("eval_cases", f"WITH {_CASES} SELECT * FROM cases")
def eval_cases(t):
    return _cases(t)


@query("eval_cases_limited", f"WITH {_CASES} SELECT * FROM cases ORDER BY eval_id LIMIT 25")
def eval_cases_limited(t):
    return evaluate.first_cases(_cases(t), 25)


@query(
    "eval_reference",
    f"""WITH {_CASES} SELECT eval_id, coalesce(nullif(golden_answer, ''), nullif(rubric_score_5, ''), 'No reference provided.') AS reference FROM cases""",
)
def eval_reference(t):
    return evaluate.with_reference(_cases(t)).select("eval_id", "reference")


@query("assertion_checks", f"WITH {_CHECKS} SELECT * FROM checks")
def assertion_checks(t):
    return _checked(t).select("eval_id", "must_contain_pass", "must_not_contain_pass")


@query(
    "pass_fail",
    f"""WITH {_CHECKS}, scored AS (SELECT eval_case_id, CASE WHEN j IS NULL THEN 3 ELSE CAST(coalesce({_first('j', ['score'])}, '3') AS INT) END AS score
         FROM (SELECT eval_case_id, {_JSON} AS j FROM score_raw))
       SELECT c.eval_id, s.score, c.must_contain_pass, c.must_not_contain_pass,
              s.score >= 4 AND c.must_contain_pass AND c.must_not_contain_pass AS passed
       FROM checks c JOIN scored s ON s.eval_case_id = c.eval_id""",
)
def pass_fail(t):
    scores = judge.normalize_score(t.score_raw).select(F.col("eval_case_id").alias("eval_id"), "score")
    checked = _checked(t).select("eval_id", "must_contain_pass", "must_not_contain_pass")
    return evaluate.apply_pass_rule(checked.join(scores, "eval_id"))


@query(
    "run_summary",
    """SELECT run_id, count(*) AS total_cases, CAST(sum(passed) AS BIGINT) AS passed, CAST(count(*) - sum(passed) AS BIGINT) AS failed,
       CAST(sum(passed) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS pass_rate FROM eval_results GROUP BY run_id""",
)
def run_summary(t):
    return evaluate.run_summary(t.eval_results)


@query(
    "eval_breakdown",
    """SELECT run_id, category, difficulty, CAST(sum(passed) AS BIGINT) AS passed, count(*) AS count,
       CAST(sum(passed) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS pass_rate FROM eval_results
       WHERE category IS NOT NULL AND difficulty IS NOT NULL GROUP BY ALL""",
)
def eval_breakdown(t):
    return evaluate.breakdown(t.eval_results)


# --- comparing runs -------------------------------------------------------------------------------------
_TRANSITIONS = """tr AS (SELECT n.eval_case_id, n.category, n.difficulty, o.score AS old_score, n.score AS new_score,
  n.score - o.score AS delta, CASE WHEN o.passed = 1 AND n.passed <> 1 THEN 'regression' WHEN o.passed <> 1 AND n.passed = 1 THEN 'improvement'
    WHEN abs(n.score - o.score) > 1 THEN 'score_shift' ELSE 'unchanged' END AS transition, n.reasoning
  FROM eval_results n JOIN eval_results o ON o.eval_case_id = n.eval_case_id AND o.run_id = 'run_5' WHERE n.run_id = 'run_6')"""
_RATES = """rates AS (SELECT category, avg(CASE WHEN run_id = 'run_5' THEN CAST(passed AS DOUBLE) END) AS old_rate,
  avg(CASE WHEN run_id = 'run_6' THEN CAST(passed AS DOUBLE) END) AS new_rate FROM eval_results WHERE run_id IN ('run_5', 'run_6') GROUP BY 1)"""


def _compared(t):
    return regress.compare(t.eval_results, "run_6", "run_5")


@query(
    "latest_two_runs",
    "SELECT run_id, model_name, completed_at FROM eval_runs WHERE completed_at IS NOT NULL ORDER BY completed_at DESC, run_id DESC LIMIT 2",
)
def latest_two_runs(t):
    return regress.latest_two(t.eval_runs)


@query("run_results", "SELECT eval_case_id, category, difficulty, score, passed, reasoning FROM eval_results WHERE run_id = 'run_6'")
def run_results(t):
    return regress.results_of(t.eval_results, "run_6").drop("run_id")


@query(
    "run_coverage",
    """SELECT count(*) FILTER (WHERE n AND o) AS shared, count(*) FILTER (WHERE n AND NOT o) AS added, count(*) FILTER (WHERE o AND NOT n) AS removed
       FROM (SELECT eval_case_id, bool_or(run_id = 'run_6') AS n, bool_or(run_id = 'run_5') AS o FROM eval_results GROUP BY 1)""",
)
def run_coverage(t):
    return regress.run_coverage(_compared(t))


@query("case_transitions", f"WITH {_TRANSITIONS} SELECT * FROM tr")
def case_transitions(t):
    return regress.transitions(_compared(t))


@query(
    "regressions",
    f"WITH {_TRANSITIONS} SELECT eval_case_id, category, difficulty, old_score, new_score, substr(reasoning, 1, 80) AS reason FROM tr WHERE transition = 'regression'",
)
def regressions(t):
    return regress.regressions(regress.transitions(_compared(t)))


@query(
    "improvements",
    f"WITH {_TRANSITIONS} SELECT eval_case_id, category, difficulty, old_score, new_score FROM tr WHERE transition = 'improvement'",
)
def improvements(t):
    return regress.improvements(regress.transitions(_compared(t)))


@query(
    "score_shifts",
    f"""WITH {_TRANSITIONS} SELECT eval_case_id, category, difficulty, old_score, new_score, delta,
        CASE WHEN delta > 0 THEN 'up' ELSE 'DOWN' END AS direction FROM tr WHERE transition = 'score_shift'""",
)
def score_shifts(t):
    return regress.score_shifts(regress.transitions(_compared(t)))


@query(
    "category_shift",
    f"""WITH {_RATES} SELECT category, old_rate, new_rate, new_rate - old_rate AS delta,
        CASE WHEN new_rate - old_rate < CAST(-0.1 AS DOUBLE) THEN 'WARNING' WHEN new_rate - old_rate > CAST(0.1 AS DOUBLE) THEN 'IMPROVED' ELSE '' END AS flag
        FROM rates WHERE category IS NOT NULL AND old_rate IS NOT NULL AND new_rate IS NOT NULL""",
)
def category_shift(t):
    return regress.category_shift(regress.category_rates(t.eval_results, "run_6", "run_5"))


@query("all_categories", "SELECT category FROM eval_results WHERE run_id = 'run_6' UNION SELECT category FROM eval_results WHERE run_id = 'run_5'")
def all_categories(t):
    results = t.eval_results
    return regress.all_categories(regress.results_of(results, "run_6"), regress.results_of(results, "run_5"))


@query(
    "regression_summary",
    f"""WITH {_TRANSITIONS} SELECT 'run_6' AS run_id_new, 'run_5' AS run_id_old, count(*) FILTER (WHERE transition = 'regression') AS new_failures,
        count(*) FILTER (WHERE transition = 'improvement') AS new_passes, count(*) FILTER (WHERE transition = 'score_shift') AS score_shifts FROM tr""",
)
def regression_summary(t):
    return regress.regression_summary(regress.transitions(_compared(t)), "run_6", "run_5")


# --- review views ---------------------------------------------------------------------------------------
_EXPLORER = """explorer AS (SELECT eval_id, category, difficulty, quality_score, status, agreement_ratio, golden_answer, rubric_score_5,
  expected_behavior, must_contain, must_not_contain, user_prompt, model_response
  FROM eval_dataset JOIN interactions ON id = interaction_id LEFT JOIN confidence_scores USING (eval_id)
  LEFT JOIN golden_answers USING (eval_id) LEFT JOIN multi_labels USING (eval_id))"""


def _explorer(t):
    return curate.explorer(t.eval_dataset, t.interactions, t.confidence_scores, t.golden_answers, t.multi_labels)


@query("explorer_view", f"WITH {_EXPLORER} SELECT * FROM explorer")
def explorer_view(t):
    return _explorer(t)


@query(
    "explorer_filtered",
    f"""WITH {_EXPLORER} SELECT * FROM explorer WHERE status = 'approved' AND category IN ('Normal', 'Angry User')
        AND difficulty IN ('moderate', 'hard') AND quality_score >= 3""",
)
def explorer_filtered(t):
    return curate.filter_explorer(
        _explorer(t), categories=["Normal", "Angry User"], difficulties=["moderate", "hard"], min_quality=3
    )


@query(
    "filter_options",
    """WITH ok AS (SELECT e.* FROM eval_dataset e JOIN confidence_scores cs ON cs.eval_id = e.eval_id WHERE cs.status = 'approved')
       SELECT 'category' AS field, category AS value FROM ok UNION SELECT 'difficulty', difficulty FROM ok""",
)
def filter_options(t):
    return curate.filter_options(t.eval_dataset, t.confidence_scores)


@query(
    "review_queue_view",
    """SELECT eval_id, reason, reviewed, user_prompt, model_response, majority_category, majority_behavior, agreement_ratio
       FROM human_review_queue JOIN confidence_scores USING (eval_id) JOIN eval_dataset USING (eval_id)
       JOIN interactions ON id = interaction_id WHERE reviewed = 0""",
)
def review_queue_view(t):
    return curate.review_queue_view(t.human_review_queue, t.eval_dataset, t.interactions, t.confidence_scores)


@query(
    "curation_kpis",
    """SELECT count(*) AS total, count(*) FILTER (WHERE cs.status = 'approved') AS approved, count(*) FILTER (WHERE cs.status = 'rejected') AS rejected
       FROM eval_dataset e LEFT JOIN confidence_scores cs ON cs.eval_id = e.eval_id""",
)
def curation_kpis(t):
    return curate.curation_kpis(t.eval_dataset, t.confidence_scores)


@query(
    "coverage_matrix",
    """SELECT category, count(*) FILTER (WHERE difficulty = 'simple') AS simple, count(*) FILTER (WHERE difficulty = 'moderate') AS moderate,
       count(*) FILTER (WHERE difficulty = 'hard') AS hard, count(*) FILTER (WHERE difficulty = 'adversarial') AS adversarial
       FROM eval_dataset GROUP BY category""",
)
def coverage_matrix(t):
    return curate.coverage_matrix(t.eval_dataset)


@query(
    "label_crosstab",
    f"""WITH labels AS (SELECT CASE WHEN j IS NULL THEN 'Labeling Failed' ELSE {_CATEGORY} END AS category,
        CASE WHEN j IS NULL THEN 'unknown' ELSE {_DIFFICULTY} END AS difficulty FROM (SELECT raw, {_JSON} AS j FROM judge_raw)),
    rows AS (SELECT DISTINCT category FROM labels), cols AS (SELECT DISTINCT difficulty FROM labels)
    SELECT r.category, c.difficulty, (SELECT count(*) FROM labels l WHERE l.category = r.category AND l.difficulty = c.difficulty) AS count
    FROM rows r, cols c""",
)
def label_crosstab(t):
    return curate.label_crosstab(judge.label_with_fallback(t.judge_raw, source=judge.model_source(F.lit("vendor/judge-1:free"))))


@query(
    "assertion_text",
    f"""WITH {_EXPLORER} SELECT eval_id,
       CASE WHEN len(from_json(must_contain, '["VARCHAR"]')) > 0 THEN array_to_string(from_json(must_contain, '["VARCHAR"]'), ', ') ELSE 'None' END AS must_contain_text,
       CASE WHEN len(from_json(must_not_contain, '["VARCHAR"]')) > 0 THEN array_to_string(from_json(must_not_contain, '["VARCHAR"]'), ', ') ELSE 'None' END AS must_not_contain_text,
       coalesce(nullif(golden_answer, ''), 'N/A') AS golden_text, coalesce(nullif(rubric_score_5, ''), 'N/A') AS rubric_text FROM explorer""",
)
def assertion_text(t):
    return curate.assertion_text(_explorer(t)).select(
        "eval_id", "must_contain_text", "must_not_contain_text", "golden_text", "rubric_text"
    )
