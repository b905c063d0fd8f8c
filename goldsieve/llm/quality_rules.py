"""Quality rules whose thresholds follow the data.

Every document is measured once. For each language and source a mergeable quantile sketch of every measure is built: a
histogram with buckets of 6 significant bits, so that sketches merge by adding counts and the same data
give the same sketch however they are split. The fences are medians plus a multiple of the spread below them,
plus a slack; they join back to the measures of their own group.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldsieve.llm.common import small_batches, stored, with_small_batches

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Least words, and most percent of words inside repeated windows: the rule that holds for every document.
LEAST_WORDS, MOST_REPEATED = 10, 20

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """A measure in whole numbers and how far from the median of its group it may lie."""

    name: str
    top: str
    bottom: str
    unit: int
    slack: int
    both: bool = False


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 10_000, 300),
    Rule("dup_lines", "n_dup_lines", "n_lines", 10_000, 4_000),
    Rule("word_length", "word_chars", "n_words", 100, 200, both=True),
)
SPREAD = 6
BITS = 6


def repeated_words(ids: np.ndarray, doc: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of ``size`` words that its document holds twice or more.

    Windows meet by a 64-bit hash and neighbours are compared word by word; should two different windows
    share a hash, other multipliers are tried.
    """
    covered = np.zeros(len(ids), bool)
    starts = np.flatnonzero(doc[size - 1:] == doc[:len(doc) - size + 1]) if len(ids) >= size else np.zeros(0, np.int64)
    if len(starts) == 0:
        return covered
    for seed in count():
        factors = np.random.default_rng(seed).integers(1, 1 << 63, size + 1, dtype=np.uint64) | np.uint64(1)
        hashes = doc[starts].astype(np.uint64) * factors[size]
        for k in range(size):
            hashes += ids[starts + k].astype(np.uint64) * factors[k]
        order = np.argsort(hashes, kind="stable")
        same = hashes[order[1:]] == hashes[order[:-1]]
        left, right = starts[order[:-1][same]], starts[order[1:][same]]
        if (doc[left] == doc[right]).all() and all((ids[left + k] == ids[right + k]).all() for k in range(size)):
            break
    marks = np.zeros(len(ids) + size, np.int64)
    marks[left], marks[right] = 1, 1
    reach = np.concatenate([np.zeros(size, np.int64), np.cumsum(marks)])
    return reach[size:size + len(ids)] - reach[:len(ids)] > 0


def measure_texts(texts: list[str | None]) -> dict[str, list[int]]:
    """The six counts of each text."""
    numbers, words, ends, out = defaultdict(count().__next__), [], [], {m: [] for m in MEASURES}
    for text in texts:
        text = text or ""
        words += text.encode("utf-8", "surrogatepass").split()
        ends.append(len(words))
        lines = [line for line in text.split("\n") if line.strip(SPACES)]
        out["word_chars"].append(len(text) - sum(map(text.count, SPACES)))
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_lines"].append(len(lines))
    n_words = np.diff([0, *ends])
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    doc = np.repeat(np.arange(len(texts)), n_words)
    out["n_words"] = n_words.tolist()
    out["n_repeat_words"] = np.bincount(doc, repeated_words(ids, doc), len(texts)).astype(np.int64).tolist()
    return out


def measured(docs: DataFrame, text: str, carried: list[Column]) -> DataFrame:
    rows = docs.select(*carried, F.col(text).alias("_text"))
    names = [n for n in rows.columns if n != "_text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"), *(f"{m} bigint" for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            counts = measure_texts(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *(pa.array(counts[m], pa.int64()) for m in MEASURES)], [*names, *MEASURES]
            )

    return with_small_batches(rows).mapInArrow(run, schema)


def _value(rule: Rule) -> Column:
    return F.expr(f"{rule.unit} * {rule.top} div greatest({rule.bottom}, 1)")


def bucket(value: Column, bits: int = BITS) -> Column:
    """The value with all but its leading ``bits`` bits zero."""
    shift = F.greatest(F.length(F.bin(value)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rows: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, rule, bucket, n``: one mergeable histogram for each group and rule."""
    values = F.array(*(F.struct(F.lit(r.name).alias("rule"), bucket(_value(r)).alias("bucket")) for r in RULES))
    return rows.select(*groups, F.explode(values).alias("v")).groupBy(*groups, "v.rule", "v.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """One row per group: ``<rule>_low`` and ``<rule>_high``."""
    ordered = Window.partitionBy(*groups, "rule").orderBy("bucket")
    placed = sketch.select(
        "*", F.sum("n").over(ordered).alias("below"), F.sum("n").over(Window.partitionBy(*groups, "rule")).alias("all")
    )
    found = []
    for r in RULES:
        of = lambda percent: F.min(F.when((F.col("rule") == r.name) & (F.col("below") * 100 >= F.col("all") * percent), F.col("bucket")))  # noqa: E731, B023
        reach = F.lit(SPREAD) * (of(50) - of(25)) + r.slack
        found += [(of(50) + reach).alias(f"{r.name}_high"), ((of(50) - reach) if r.both else F.lit(0).cast("bigint")).alias(f"{r.name}_low")]
    return placed.groupBy(*groups).agg(*found)


def quality_rules(docs: DataFrame, text: str = "text", key: str = "doc_id", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per document: ``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    A document goes when it has fewer than 10 words or more than 20% of them in repeated windows, or when a measure
    lies outside the fence of its language and source. Documents that fail the first rule do not shape the fences.
    Null values of a group column form a group; a null text has no words and fails. Null and repeated keys are kept as
    they are, and only the named columns are read. An empty table gives no rows.
    """
    names = [f"_g{i}" for i in range(len(groups))]
    rows = stored(measured(docs, text, [F.col(key).alias("_id"), *(F.col(g).alias(n) for g, n in zip(groups, names))]), "measures")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = rows.withColumn("base_failed", failed)
    limits = fences(sketches(judged.filter("not base_failed"), names), names)
    limits = limits.select(*(F.col(n).alias(f"{n}_") for n in names), *(c for c in limits.columns if c not in names))
    same = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]
    inside = [_value(r).between(F.col(f"{r.name}_low"), F.col(f"{r.name}_high")) for r in RULES]
    verdict = F.coalesce(reduce(and_, inside), F.lit(False))
    return judged.join(limits, same, "left").select(
        F.col("_id").alias(key), *MEASURES[:5], "base_failed", (~F.col("base_failed") & verdict).alias("kept"),
    )


def _oracle() -> str:
    """The same rules in DuckDB's SQL."""
    values = ", ".join(f"('{r.name}', {r.unit} * {r.top} // greatest({r.bottom}, 1), {r.slack}, {str(r.both).lower()})" for r in RULES)
    shift = f"greatest(length(bin(v)) - {BITS}, 0)"
    return rf"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split WHERE len(w) >= {WINDOW})),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id),
measures AS (
  SELECT s.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM split s LEFT JOIN repeated r USING (doc_id)),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM measures),
valued AS (SELECT doc_id, lang, source, base_failed, u.rule, u.v, u.slack, u.both_sides
  FROM judged, LATERAL (VALUES {values}) AS u(rule, v, slack, both_sides)),
sketch AS (
  SELECT lang, source, rule, ((v >> {shift}) << {shift}) AS bucket, count(*) AS n FROM valued WHERE NOT base_failed GROUP BY ALL),
placed AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY lang, source, rule) AS total
  FROM sketch),
fence AS (
  SELECT lang, source, rule, min(bucket) FILTER (below * 100 >= total * 50) AS q50, min(bucket) FILTER (below * 100 >= total * 25) AS q25
  FROM placed GROUP BY ALL),
verdict AS (
  SELECT v.doc_id, bool_and(v.v <= q50 + {SPREAD} * (q50 - q25) + slack
    AND (NOT both_sides OR v.v >= q50 - {SPREAD} * (q50 - q25) - slack)) AS fits
  FROM valued v LEFT JOIN fence f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source AND v.rule = f.rule
  GROUP BY v.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fits, false) AS kept
FROM judged JOIN verdict USING (doc_id)
"""


ORACLE = _oracle()
