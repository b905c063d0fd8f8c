"""Log-, label- and run-shaped views over the driver's tables.

The SQL text is shared by Spark and the checking engine, so both start from equal inputs. Every view
keeps all rows and whole texts of the tables it reads; stages that are "already done" are told apart
by real columns (date, language, source, label), not by picking ids.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

SPREAD = "spark.goldsieve.spreadInputs"

VIEWS: dict[str, str] = {
    "raw_logs": """
SELECT CAST(e.event_id AS STRING) AS id, e.ts AS log_ts,
       CASE WHEN e.event_id % 7 = 0 THEN concat(d.text, ' call 555-', lpad(CAST(e.event_id % 1000 AS STRING), 3, '0'),
                                                '-', lpad(CAST(e.event_id % 10000 AS STRING), 4, '0'))
            WHEN e.event_id % 11 = 0 THEN concat(d.text, ' mail u.', CAST(e.event_id AS STRING), '@example.com now')
            ELSE d.text END AS user_prompt,
       'You are a helpful assistant.' AS system_prompt,
       CASE WHEN d.lang = 'en' THEN 'model_a' ELSE 'model_b' END AS model_used,
       CASE WHEN e.event_id % 17 = 0 THEN NULL ELSE r.text END AS model_response,
       CASE WHEN e.event_id % 97 = 0 THEN NULL ELSE CAST(floor(e.value * 20) AS INT) END AS latency_ms,
       CASE e.event_type WHEN 'error' THEN 'thumbs_down' WHEN 'signup' THEN 'retry'
                         WHEN 'purchase' THEN 'thumbs_up' END AS user_feedback,
       CASE e.user_id % 3 WHEN 0 THEN 'chatbot_widget' WHEN 1 THEN 'in_app_help' ELSE 'email_auto_reply' END AS feature_name
FROM (SELECT *, event_id % (SELECT count(*) FROM documents) AS asked,
             (event_id * 31 + 7) % (SELECT count(*) FROM documents) AS answered FROM events) e
JOIN documents d ON d.doc_id = e.asked JOIN documents r ON r.doc_id = e.answered""",
    "ingested_ids": """
SELECT CAST(event_id AS STRING) AS id FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-11'""",
    "normalized_logs": """
SELECT id, log_ts, user_prompt, model_response, latency_ms, user_feedback,
       CASE WHEN latency_ms IS NULL OR user_feedback = 'thumbs_up' THEN NULL WHEN latency_ms > 2000 THEN -1
            ELSE latency_ms % 50 END AS cluster_id,
       CASE WHEN user_feedback IS NULL THEN 0 ELSE 1 END AS is_sampled
FROM raw_logs""",
    "interactions": """
SELECT CAST(d.doc_id AS STRING) AS id, d.text AS user_prompt, r.text AS model_response
FROM (SELECT doc_id, text, (doc_id * 31 + 7) % (SELECT count(*) FROM documents) AS answered FROM documents) d
JOIN documents r ON r.doc_id = d.answered""",
    "eval_dataset": """
SELECT d.doc_id AS eval_id, CAST(d.doc_id AS STRING) AS interaction_id,
       CASE WHEN d.doc_id % 20 < 11 THEN 'Normal' WHEN d.doc_id % 20 < 14 THEN 'Policy Question'
            WHEN d.doc_id % 20 < 16 THEN 'Angry User' WHEN d.doc_id % 20 = 16 THEN 'Refusal'
            WHEN d.doc_id % 20 = 17 THEN 'Jailbreak' WHEN d.doc_id % 20 = 18 THEN 'Prompt Injection'
            ELSE 'Unknown' END AS category,
       CASE WHEN l.toxic = 1 THEN 'adversarial' WHEN d.n_chars < 500 THEN 'simple'
            WHEN d.n_chars < 2000 THEN 'moderate' ELSE 'hard' END AS difficulty,
       CAST(CASE WHEN l.quality = 1 THEN 4 + d.doc_id % 2 WHEN l.quality = 0 THEN 1 + d.doc_id % 2 ELSE 3 END AS INT)
           AS quality_score
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "judge_votes": """
SELECT e.eval_id, r.run_idx,
       CASE WHEN (e.eval_id * 31 + r.run_idx * 17) % 10 = 0 THEN NULL
            WHEN (e.eval_id * 7 + r.run_idx * r.run_idx) % 4 = 0 THEN 'Normal'
            WHEN (e.eval_id + r.run_idx) % 9 = 0 THEN 'Refusal' ELSE e.category END AS category,
       CASE WHEN (e.eval_id * 31 + r.run_idx * 17) % 10 = 0 THEN NULL
            WHEN (e.eval_id + r.run_idx * 3) % 5 = 0 THEN 'should_refuse'
            WHEN (e.eval_id + r.run_idx) % 4 = 0 THEN 'should_clarify' ELSE 'should_answer' END AS behavior
FROM eval_dataset e CROSS JOIN (VALUES (1), (2), (3)) AS r(run_idx)""",
    "multi_labels": """
SELECT doc_id AS eval_id,
       CAST(1 + n_chars % 5 AS INT) AS expected_quality,
       CASE doc_id % 4 WHEN 0 THEN '["the","ing"]' WHEN 1 THEN '["en"]' WHEN 2 THEN '[]' END AS must_contain,
       CASE doc_id % 3 WHEN 0 THEN '["example.com"]' WHEN 1 THEN '["###","@"]' END AS must_not_contain,
       CASE doc_id % 5 WHEN 0 THEN 'should_refuse' WHEN 1 THEN 'should_clarify' ELSE 'should_answer' END
           AS expected_behavior
FROM documents WHERE lang <> 'de'""",
    "golden_answers": """
SELECT doc_id AS eval_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS golden_answer,
       CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('covers the issue from ', source) END AS rubric_score_5
FROM documents WHERE source NOT IN ('src3', 'src11')""",
    "confidence_scores": """
SELECT e.eval_id, 3 AS num_runs,
       CAST(CASE e.eval_id % 4 WHEN 0 THEN CAST(1 AS DOUBLE) / 3 WHEN 1 THEN CAST(2 AS DOUBLE) / 3 ELSE 1 END AS DOUBLE)
           AS agreement_ratio,
       e.category AS majority_category,
       CASE e.eval_id % 5 WHEN 0 THEN 'should_refuse' ELSE 'should_answer' END AS majority_behavior,
       CASE WHEN e.eval_id % 4 = 0 AND e.eval_id % 12 = 0 THEN 'rejected' WHEN e.eval_id % 4 = 0 THEN 'needs_review'
            ELSE 'approved' END AS status
FROM eval_dataset e JOIN documents d ON d.doc_id = e.eval_id WHERE d.source <> 'src4'""",
    "human_review_queue": """
SELECT eval_id, 'Low confidence (33% agreement across 3 runs)' AS reason,
       CAST(CASE WHEN status = 'rejected' THEN 1 ELSE 0 END AS INT) AS reviewed
FROM confidence_scores WHERE status <> 'approved'""",
    "review_decisions": """
SELECT q.eval_id, CASE WHEN l.quality = 1 THEN 'approve' ELSE 'reject' END AS decision
FROM human_review_queue q JOIN labels l ON l.doc_id = q.eval_id WHERE q.reviewed = 0""",
    "review_notes": """
SELECT doc_id AS eval_id, CASE WHEN toxic = 1 THEN 'toxic, keep as a trap' ELSE 'looks fine' END AS manual_notes
FROM labels""",
    "dedup_log": """
SELECT c.eval_id AS candidate_eval_id, CASE WHEN c.eval_id % 9 = 2 THEN c.eval_id - 1 END AS duplicate_of_eval_id,
       CAST(CASE WHEN c.eval_id % 9 = 2 THEN 0.97 ELSE 0.5 END AS DOUBLE) AS similarity_score,
       CASE WHEN c.eval_id % 9 = 2 THEN 'rejected_duplicate' ELSE 'accepted' END AS action
FROM confidence_scores c JOIN documents d ON d.doc_id = c.eval_id
WHERE c.status = 'approved' AND d.source NOT IN ('src5', 'src10', 'src19')""",
    "judge_raw": """
SELECT doc_id AS eval_id, CASE doc_id % 10
       WHEN 0 THEN concat('{"category":"Normal","quality_score":5,"difficulty":"simple","reasoning":"ok ', source, '","expected_behavior":"should_answer"}')
       WHEN 1 THEN '{"Category":"Refusal","quality":2,"Difficulty":"hard","Reasoning":"r","behavior":"should_refuse"}'
       WHEN 2 THEN concat('{"interaction_type":"Jailbreak","score":1,"complexity":"adversarial","explanation":"', lang, '"}')
       WHEN 3 THEN '{"category":"","quality_score":0,"difficulty":null,"reasoning":""}'
       WHEN 4 THEN '{}'
       WHEN 5 THEN 'not json'
       WHEN 6 THEN NULL
       WHEN 7 THEN '{"category":"","Category":"Angry User","quality_score":null,"quality":4}'
       WHEN 8 THEN '{"expected_quality":0,"expected_behavior":"","must_contain":[],"must_not_contain":null}'
       ELSE concat('{"expected_quality":4,"expected_behavior":"should_clarify","must_contain":["a","', lang, '"],"must_not_contain":["c"]}') END AS raw
FROM documents""",
    "golden_raw": """
SELECT doc_id AS eval_id, CASE doc_id % 8
       WHEN 0 THEN concat('{"question_type":"factual","chain_of_thought":"c","golden_answer":"', source, '","rubric":{"score_5":"a","score_3":"b","score_1":"c"}}')
       WHEN 1 THEN '{"type":"subjective","reasoning":"r","golden_answer":null,"rubric":{"5":"a5","3":"a3","1":"a1"}}'
       WHEN 2 THEN '{"question_type_label":"adversarial","reference_answer":"no","scoring_rubric":{"excellent":"x","acceptable":"y","poor":"z"}}'
       WHEN 3 THEN concat('{"answer":"w","rubric":"plain text ', lang, '"}')
       WHEN 4 THEN concat('{"question_type":"factual","rubric":"{', chr(92), '"score_5', chr(92), '":', chr(92), '"inner', chr(92), '"}"}')
       WHEN 5 THEN '{"question_type":"","golden_answer":"","rubric":["l"]}'
       WHEN 6 THEN 'broken{'
       ELSE NULL END AS raw
FROM documents""",
    "score_raw": """
SELECT doc_id AS eval_case_id, CASE doc_id % 6
       WHEN 0 THEN concat('{"score":5,"passed":true,"must_contain_pass":true,"must_not_contain_pass":true,"reasoning":"ok ', source, '"}')
       WHEN 1 THEN '{"score":4,"passed":true,"must_contain_pass":true}'
       WHEN 2 THEN '{"score":0,"passed":false,"must_contain_pass":false,"must_not_contain_pass":false,"reasoning":null}'
       WHEN 3 THEN '{"score":5,"passed":true,"must_contain_pass":false,"must_not_contain_pass":true}'
       WHEN 4 THEN '{}'
       ELSE NULL END AS raw
FROM documents""",
    "eval_results": """
SELECT concat('run_', CAST(l.l_linenumber AS STRING)) AS run_id, l.l_orderkey AS eval_case_id,
       max(o.o_orderpriority) AS category, max(o.o_orderstatus) AS difficulty,
       CAST(max(CAST(l.l_quantity AS BIGINT) % 5) + 1 AS INT) AS score,
       CAST(CASE WHEN max(CAST(l.l_quantity AS BIGINT) % 5) >= 3 AND max(l.l_partkey) % 3 <> 0 AND max(l.l_suppkey) % 5 <> 0
                 THEN 1 ELSE 0 END AS INT) AS passed,
       concat('The response was read against the reference answer for an order of priority ', max(o.o_orderpriority),
              ' and status ', max(o.o_orderstatus)) AS reasoning
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY l.l_linenumber, l.l_orderkey""",
    "eval_runs": """
SELECT run_id, 'model_a' AS model_name,
       CASE WHEN run_id = 'run_7' THEN NULL ELSE concat('2024-01-0', substr(run_id, 5, 1), 'T00:00:00') END AS completed_at
FROM eval_results GROUP BY run_id""",
}

#: The same rows as Spark builds them, with less text moved: responses meet the narrow keys, then texts by the id that others join
#: on. A key that occurs twice is asked for once and gives as many rows as before.
SPARK_FORMS: dict[str, str] = {
    "interactions": """
SELECT d.id, d.user_prompt, a.model_response FROM (SELECT CAST(doc_id AS STRING) AS id, text AS user_prompt FROM documents) d
JOIN (SELECT k.id, r.text AS model_response FROM
      (SELECT DISTINCT CAST(doc_id AS STRING) AS id, (doc_id * 31 + 7) % (SELECT count(*) FROM documents) AS answered FROM documents) k
      JOIN documents r ON r.doc_id = k.answered) a ON a.id = d.id""",
}

_WORD = re.compile(r"[a-z_]+")


def _needed(sql: str, known: list[str]) -> list[str]:
    """The views ``sql`` reads, directly or through others, in definition order."""
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        found = {w for w in _WORD.findall(todo.pop()) if w in known} - wanted
        wanted |= found
        todo += [VIEWS[w] for w in found if w in VIEWS]
    return [k for k in known if k in wanted]


def with_views(sql: str) -> str:
    """``sql`` with the views it reads put in front as common table expressions."""
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in _needed(sql, list(VIEWS))]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[len("WITH RECURSIVE"):].strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[len("WITH"):].strip()
    return "WITH " + ",\n".join(parts) + "\n" + body


class Inputs:
    """Views and tables of one data folder, as DataFrames: ``inputs.raw_logs``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """One table as it is stored, or dealt out to as many tasks as the session's ``SPREAD`` setting says.

        The setting is for single files with one row group, which Spark cannot split; it is off by default.
        """
        frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        tasks = self.spark.conf.get(SPREAD, None)
        return frame.repartition(int(tasks)) if tasks and name not in ("region", "nation", "labels", "benchmark") else frame

    def sql(self, text: str) -> DataFrame:
        parts, tables = [], {}
        for name in _needed(text, BASE_TABLES + list(VIEWS)):
            if name in VIEWS:
                body = SPARK_FORMS.get(name, VIEWS[name]).strip().replace("{", "{{").replace("}", "}}")
            else:
                tables[name] = self.table(name)
                body = f"SELECT * FROM {{{name}}}"
            parts.append(f"{name} AS ({body})")
        return self.spark.sql("WITH " + ",\n".join(parts) + "\n" + text, **tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        if name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)
