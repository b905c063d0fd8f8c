"""Judges: message texts, batch inference on executors, and normalization of what they answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldsieve.fixed import (
    BAD_ANSWER, CATEGORY_KEYS, DEFAULT_BEHAVIOR, DEFAULT_CATEGORY, DEFAULT_DIFFICULTY, DEFAULT_QUALITY,
    DEFAULT_QUESTION_TYPE, DIFFICULTY_KEYS, FAILED_CATEGORY, FAILED_DIFFICULTY, FAILED_REASONING, FAILED_SOURCE,
    GOLDEN_KEYS, GOLDEN_MESSAGE, LABEL_MESSAGE, NO_ANSWER, NO_REASONING, NO_REFERENCE, PASS_SCORE, QUALITY_KEYS,
    QUESTION_TYPE_KEYS, REASONING_KEYS, RUBRIC_KEYS, RUBRIC_LEVELS, SCORE_MESSAGE, SOURCE_PREFIX, THOUGHT_KEYS,
    VOTE_BEHAVIOR_KEYS, VOTE_CATEGORY_KEYS,
)
from goldsieve.functions.loose_json import (
    first_counting, first_json, member_columns, parse_object, pick_bool, pick_int, pick_text, string_items, with_members,
)

# Takes the texts of one Arrow batch, returns one answer (or None) for each.
Answerer = Callable[[list[str]], list[str | None]]


TASK_ROWS = 256


def tasks_for(frame: DataFrame) -> int:
    """Tasks for rows that are slow to answer: as many as there are cores, more when a task would hold many rows."""
    return max(frame.sparkSession.sparkContext.defaultParallelism, -(-frame.count() // TASK_ROWS))


def infer(
    frame: DataFrame, text: str, answer: str, make: Callable[[], Answerer], partitions: int | None = None,
    error_prefix: str | None = None, error: str | None = None,
) -> DataFrame:
    """Add column ``answer`` by running an injected model over column ``text``, batch by batch.

    ``make`` is called once per task, so a model loads once and serves every batch of the task.
    ``partitions`` bounds how many tasks call out at a time. When a batch raises, its texts are asked one
    by one, and only those that raise again get NULL, or ``[<error_prefix>: ...]`` when a prefix is given. ``error`` names
    a further column for the text of what was raised.
    """
    names = [answer] + ([error] if error else [])
    schema = T.StructType(frame.schema.fields + [T.StructField(n, T.StringType()) for n in names])

    def one_by_one(ask: Answerer, texts: list[str]) -> tuple[list[str | None], list[str | None]]:
        answers, errors = [], []
        for item in texts:
            try:
                answers += ask([item])
                errors.append(None)
            except Exception as raised:  # the model is foreign code; its failure is data here
                answers.append(f"[{error_prefix}: {raised}]" if error_prefix else None)
                errors.append(str(raised) or type(raised).__name__)
        return answers, errors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for batch in batches:
            texts = batch[text].tolist()
            try:
                given = ask(texts), [None] * len(texts)
            except Exception:
                given = one_by_one(ask, texts)
            yield batch.assign(**{n: pd.Series(v, index=batch.index, dtype="object") for n, v in zip(names, given)})

    spread = frame if partitions is None else frame.repartition(partitions)
    return spread.mapInPandas(run, schema)


def length_judge() -> Answerer:
    """A deterministic stand-in judge: the quality follows from the length of the text."""

    def ask(texts: list[str]) -> list[str | None]:
        return [f'{{"category":"Normal","quality_score":{len(t) % 5 + 1}}}' for t in texts]

    return ask


def _word(text: Column) -> Column:
    return F.coalesce(text, F.lit("None"))


def label_message(prompt: Column, response: Column) -> Column:
    return F.format_string(LABEL_MESSAGE, _word(prompt), _word(response))


def golden_message(prompt: Column, response: Column) -> Column:
    return F.format_string(GOLDEN_MESSAGE, _word(prompt), _word(response))


def _listing(items: Column) -> Column:
    """A JSON list with ', ' between the items."""
    quoted = F.transform(items, lambda item: F.regexp_extract(F.to_json(F.array(item)), r"(?s)^\[(.*)\]$", 1))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def reference_text(golden: Column, rubric: Column) -> Column:
    """The golden answer, else the top rubric level, else a fixed wording; '' counts as missing."""
    return F.coalesce(
        F.nullif(golden, F.lit("")), F.nullif(rubric, F.lit("")), F.lit(NO_REFERENCE)
    )


def score_message(
    prompt: Column, reference: Column, response: Column, must: Column, must_not: Column, behavior: Column
) -> Column:
    """What a scoring judge reads about one response."""
    lists = _listing(string_items(must)), _listing(string_items(must_not))
    return F.format_string(SCORE_MESSAGE, _word(prompt), _word(reference), _word(response), *lists, _word(behavior))


def model_source(model: Column) -> Column:
    """The name in 'vendor/name:tag', marked with how it was reached."""
    return F.concat(F.lit(SOURCE_PREFIX), F.split(F.split(model, "/")[1], ":")[0])


def _opened(frame: DataFrame, raw: str, *keys: list[str]) -> DataFrame:
    """The answer parsed into ``_doc`` and its members under ``keys`` taken out."""
    parsed = frame.withColumn("_doc", parse_object(F.col(raw)))
    return with_members(parsed, "_doc", [k for group in keys for k in group])


def _kept(frame: DataFrame, *without: str) -> list[str]:
    return [c for c in frame.columns if c not in without]


def _label_fields() -> dict[str, Column]:
    return {
        "category": pick_text(CATEGORY_KEYS, DEFAULT_CATEGORY),
        "quality_score": pick_int(QUALITY_KEYS, DEFAULT_QUALITY),
        "difficulty": pick_text(DIFFICULTY_KEYS, DEFAULT_DIFFICULTY),
        "reasoning": pick_text(REASONING_KEYS, NO_REASONING),
    }


def normalize_label(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """Category, quality, difficulty and reasoning with their key fallbacks; failed rows are left out."""
    opened = _opened(frame, raw, CATEGORY_KEYS, QUALITY_KEYS, DIFFICULTY_KEYS, REASONING_KEYS)
    fields = [value.alias(name) for name, value in _label_fields().items()]
    return opened.filter(F.col("_doc").isNotNull()).select(*_kept(frame, raw), *fields)


def label_with_fallback(frame: DataFrame, raw: str = "raw", source: Column | None = None) -> DataFrame:
    """Like ``normalize_label`` but a failed row stays, marked as failed, and the positive flag is set."""
    why = F.when(F.col(raw).isNull(), NO_ANSWER).otherwise(BAD_ANSWER)
    on_failure = {
        "category": F.lit(FAILED_CATEGORY), "quality_score": F.lit(DEFAULT_QUALITY),
        "difficulty": F.lit(FAILED_DIFFICULTY), "reasoning": F.format_string(FAILED_REASONING, why),
        "labeled_by": F.lit(FAILED_SOURCE),
    }
    fields = {**_label_fields(), "labeled_by": F.lit("judge") if source is None else source}
    opened = _opened(frame, raw, CATEGORY_KEYS, QUALITY_KEYS, DIFFICULTY_KEYS, REASONING_KEYS)
    failed = F.col("_doc").isNull()
    labeled = opened.select(
        *_kept(frame, raw),
        *[F.when(failed, on_failure[name]).otherwise(value).alias(name) for name, value in fields.items()],
    )
    return labeled.withColumn("is_positive_case", F.when(F.col("quality_score") >= PASS_SCORE, 1).otherwise(0))


def _answered() -> Column:
    """An answer that is an object with at least one member."""
    return F.col("_doc").isNotNull() & (F.to_json("_doc") != "{}")


def _golden_fields() -> list[Column]:
    return [
        pick_text(QUESTION_TYPE_KEYS, DEFAULT_QUESTION_TYPE).alias("question_type"),
        pick_text(THOUGHT_KEYS, "").alias("chain_of_thought"),
        pick_text(GOLDEN_KEYS).alias("golden_answer"),
    ]


def _rubric_levels(opened: DataFrame, kept: list[str]) -> DataFrame:
    """The columns ``kept`` and the rubric's levels, from an object, JSON inside text, or plain text."""
    found, json = first_counting(RUBRIC_KEYS), first_json(RUBRIC_KEYS)
    text = F.when(json.startswith('"'), found.cast("string"))
    staged = opened.select(*kept, F.when(json.startswith("{"), found).alias("_object"), text.alias("_text"))
    staged = staged.withColumn("_inner", F.try_parse_json("_text"))
    rubric = F.coalesce("_object", F.when(F.col("_text").rlike(r"^\s*\{"), F.col("_inner")))
    plain = F.when(F.col("_inner").isNull(), F.col("_text"))
    staged = staged.select(*kept, rubric.alias("_rubric"), plain.alias("_plain"))
    members = with_members(staged, "_rubric", [k for keys in RUBRIC_LEVELS.values() for k in keys])
    top, *_ = RUBRIC_LEVELS
    levels = [
        F.coalesce(pick_text(keys), F.col("_plain") if level == top else F.lit(None), F.lit("")).alias(level)
        for level, keys in RUBRIC_LEVELS.items()
    ]
    return members.select(*kept, *levels)


def normalize_rubric(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """The three rubric levels; plain text counts for the top level only."""
    return _rubric_levels(_opened(frame, raw, RUBRIC_KEYS).filter(_answered()), _kept(frame, raw))


def normalize_golden(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """Question type, reasoning and golden answer; failed and empty answers are left out and stay pending."""
    opened = _opened(frame, raw, QUESTION_TYPE_KEYS, THOUGHT_KEYS, GOLDEN_KEYS).filter(_answered())
    return opened.select(*_kept(frame, raw), *_golden_fields())


def golden_rows(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """Golden fields and rubric levels of each answered eval, parsed once."""
    opened = _opened(frame, raw, QUESTION_TYPE_KEYS, THOUGHT_KEYS, GOLDEN_KEYS, RUBRIC_KEYS).filter(_answered())
    members = [c for key in RUBRIC_KEYS for c in member_columns(key)]
    fields = opened.select(*_kept(frame, raw), *members, *_golden_fields())
    return _rubric_levels(fields, _kept(fields, *members))


def normalize_multilabel(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """Expected quality and behavior with defaults, both lists as JSON text; failed rows are left out."""
    opened = _opened(frame, raw, ["expected_quality", "expected_behavior", "must_contain", "must_not_contain"])
    return opened.filter(F.col("_doc").isNotNull()).select(
        *_kept(frame, raw),
        pick_int(["expected_quality"], DEFAULT_QUALITY).alias("expected_quality"),
        pick_text(["expected_behavior"], DEFAULT_BEHAVIOR).alias("expected_behavior"),
        F.coalesce(first_json(["must_contain"]), F.lit("[]")).alias("must_contain"),
        F.coalesce(first_json(["must_not_contain"]), F.lit("[]")).alias("must_not_contain"),
    )


def normalize_vote(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """One vote per row; a failed answer stays as a vote of NULLs, because it counts as a run."""
    given = F.col("_doc").isNotNull()
    return _opened(frame, raw, VOTE_CATEGORY_KEYS, VOTE_BEHAVIOR_KEYS).select(
        *_kept(frame, raw),
        F.when(given, pick_text(VOTE_CATEGORY_KEYS, DEFAULT_CATEGORY)).alias("category"),
        F.when(given, pick_text(VOTE_BEHAVIOR_KEYS, DEFAULT_BEHAVIOR)).alias("behavior"),
    )


def normalize_score(frame: DataFrame, raw: str = "raw", failure: str = "No score returned", error: str | None = None) -> DataFrame:
    """Score and the three booleans with their defaults; a failed answer becomes a failing row of score 3.

    Its reason is the text in column ``error`` where there is one, else ``failure``.
    """
    failed = F.col("_doc").isNull()
    reason = F.coalesce(F.col(error), F.lit(failure)) if error else F.lit(failure)

    def flag(key: str, default: bool) -> Column:
        return F.when(failed, F.lit(False)).otherwise(pick_bool(key, default))

    opened = _opened(frame, raw, ["score", "passed", "must_contain_pass", "must_not_contain_pass", "reasoning"])
    return opened.select(
        *_kept(frame, raw),
        F.when(failed, DEFAULT_QUALITY).otherwise(pick_int(["score"], DEFAULT_QUALITY)).alias("score"),
        flag("passed", False).alias("judge_passed"),
        flag("must_contain_pass", False).alias("must_contain_pass"),
        flag("must_not_contain_pass", True).alias("must_not_contain_pass"),
        F.when(failed, reason).otherwise(pick_text(["reasoning"], "")).alias("reasoning"),
    )
