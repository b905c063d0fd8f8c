"""The registered queries of this subpackage: each applies an operator to a whole table.

``ORACLES`` holds SQL for DuckDB where SQL can express the result; the other queries are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldsieve.llm.common import WORD, scratch
from goldsieve.llm.bpe import bpe_encode_decode
from goldsieve.llm.conversation_repair import conversation_digests, repair_conversations
from goldsieve.llm.exact_dedup import exact_duplicates
from goldsieve.llm.language import identify_languages, train_language_model
from goldsieve.llm.line_dedup import ORACLE as LINE_ORACLE
from goldsieve.llm.line_dedup import dedup_lines
from goldsieve.llm.mixing import mix_sources
from goldsieve.llm.periodic_runs import periodic_runs
from goldsieve.llm.prefix_counts import count_prefixes
from goldsieve.llm.quality_model import score_quality
from goldsieve.llm.quality_rules import ORACLE as QUALITY_ORACLE
from goldsieve.llm.quality_rules import quality_rules
from goldsieve.llm.sharding import shard_by_bytes
from goldsieve.llm.simhash import near_duplicates
from goldsieve.llm.token_output import read_tokens, write_tokens

def crc32_sql(text: str) -> str:
    """SQL for DuckDB, which has no such function: the unsigned crc32 of a short ASCII text, bit by bit."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(substr({text}, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))"
    turn = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}::BIGINT[]), lambda c, x: {turn}), 4294967295::BIGINT)"


#: All places that hold the word found one period on, as stretches without a gap; the least period of a stretch counts.
RUNS_ORACLE = f"""
WITH hashed AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
         {crc32_sql("doc_id::VARCHAR")} AS h FROM documents
), planned AS (
  SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM hashed
), numbered AS (
  SELECT k, doc_id, n, unnest(range(n)) AS i, ws, a, 1 + (n - a) // (3 + g % 8) AS p FROM planned
), words AS (
  SELECT k, n, i, ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS w FROM numbered
), same AS (
  SELECT x.k, x.n, y.i - x.i AS q, x.i AS i FROM words x JOIN words y ON x.k = y.k AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT k, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM same)
  GROUP BY k, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT k, s, len, min(q) AS q FROM stretches GROUP BY k, s, len
), listed AS (
  SELECT k, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listing FROM runs GROUP BY k
), best AS (
  SELECT k, s, len, q FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY len * 1.0 / q DESC, s, q) AS place FROM runs) WHERE place = 1
), kept AS (
  SELECT k, string_agg(w, ' ' ORDER BY i) AS body FROM words
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.k = words.k AND words.i >= r.s + r.q AND words.i < r.s + r.len) GROUP BY k
)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, b.len * 1000 // b.q AS exponent_milli,
       sha256(coalesce(l.listing, '')) AS runs_sha256, sha256(coalesce(t.body, '')) AS collapsed_sha256
FROM planned d LEFT JOIN listed l USING (k) LEFT JOIN best b USING (k) LEFT JOIN kept t USING (k)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op2_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), keep="largest")


@query("op3_source_mix")
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_shards")
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir)).select(
        "doc_id", F.col("shard_bytes").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_quality_rules", QUALITY_ORACLE)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_encode_decode(documents(spark, sf_dir), path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op1_token_output")
def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    write_tokens(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, folder).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"),
    )


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify_languages(docs, train_language_model(docs)).select("doc_id", "held_out", "lang_pred", "score")


@query("op6_quality_model")
def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op9_line_dedup", LINE_ORACLE)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


def with_planted_period(docs: DataFrame) -> DataFrame:
    """The documents, of which a tenth by the hash of the id end in words that repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    chosen = (F.col("h") % 10 == 0) & F.col("text").rlike(WORD)
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words")).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), F.col("n") - F.col("a"))
    return rows.select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(
        F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")).alias("text"))


@query("op11_periodic_runs", RUNS_ORACLE)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_period(documents(spark, sf_dir)))

    def better(best, r):  # of runs in ascending order of start and period the first of the greatest exact exponent
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    kind = "struct<start:bigint,length:bigint,period:bigint>"
    best = F.aggregate("runs", F.lit(None).cast(kind), better)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    rows = found.select("row.doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_prefixes(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by the hash of conversation and turn; a dropped row only names its conversation."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fault == 0).alias("absent"), F.explode(F.array_repeat(F.lit(1), F.when(fault == 3, 2).otherwise(1).cast("int"))).alias("copy"),
    ).drop("copy")


def _repair_oracle() -> str:
    """Four states (0 start, 1 after system, 2 after user, 3 after a pair), each with ten digits of price before its letters of edits."""
    def more(state: str, price: str, edit: str) -> str:
        return f"printf('%010d', substr({state}, 1, 10)::BIGINT + {price}) || substr({state}, 11) || '{edit}'"

    may_read_user = "least(s.s0, s.s1, s.s3)"
    return f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS h FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE h <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt
), seen AS (
  SELECT *, substr(role, 1, 1) AS r, NOT regexp_matches(text, '{WORD}') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut FROM ordered
), flagged AS (
  SELECT *, blank OR again AS must, CASE WHEN cut AND NOT blank AND NOT again THEN 5 ELSE 0 END AS extra,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS bad FROM seen
), steps(conv_id, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '0000000000', NULL::VARCHAR, '0000000005I', '0000000010II' FROM conversations
  UNION ALL
  SELECT conv_id, i, n0, n1, c2, least(n3, {more("c2", "5", "I")}) FROM (
    SELECT *, least(n2, {more("least(n0, n1, n3)", "5", "I")}) AS c2 FROM (
      SELECT s.conv_id, f.i, {more("s.s0", "2", "D")} AS n0,
        least({more("s.s1", "2", "D")}, CASE WHEN NOT must AND r = 's' THEN {more("s.s0", "extra", "K")} END) AS n1,
        least({more("s.s2", "2", "D")}, CASE WHEN NOT must THEN {more(may_read_user, "1 + extra", "R")} END,
              CASE WHEN NOT must AND r = 'u' THEN {more(may_read_user, "extra", "K")} END) AS n2,
        least({more("s.s3", "2", "D")}, CASE WHEN NOT must THEN {more("s.s2", "1 + extra", "R")} END,
              CASE WHEN NOT must AND r = 'a' THEN {more("s.s2", "extra", "K")} END) AS n3
      FROM steps s JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1))
), solved AS (
  SELECT conv_id, substr(v, 1, 10)::BIGINT AS cost, substr(v, 11) AS audit FROM (SELECT conv_id, arg_max(least(s0, s3), i) AS v FROM steps GROUP BY conv_id)
), letters AS (
  SELECT conv_id, j, substr(audit, j, 1) AS e FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM solved)
), placed AS (
  SELECT *, sum((e <> 'I')::INT) OVER w AS i, sum((e <> 'D')::INT) OVER w AS m FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), kept AS (
  SELECT p.conv_id, p.j, p.e, p.m, f.role, f.text, max((p.m = 1 AND p.e = 'K' AND f.r = 's')::INT) OVER (PARTITION BY p.conv_id) AS has_system
  FROM placed p LEFT JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND p.e <> 'I' WHERE p.e <> 'D'
), written AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (m - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body FROM kept GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(again AND NOT blank) AS duplicate, count_if(extra > 0) AS truncated, count_if(bad) AS illegal FROM flagged GROUP BY conv_id
)
SELECT s.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM solved s LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM s.conv_id
"""


@query("op13_conversation_repair", _repair_oracle())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_faults(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_digests(repair_conversations(rows, absent="absent"))
