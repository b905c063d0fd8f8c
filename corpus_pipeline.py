"""A training corpus from raw documents, in stages; each reads all rows that the one before it kept.

Training, graph components and Newton steps have no SQL form, so ``ORACLE_SQL`` is None and tests hold the stages
against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldsieve.llm.bpe import bpe_encode_decode
from goldsieve.llm.common import stored
from goldsieve.llm.language import UNKNOWN, identify_languages, train_language_model
from goldsieve.llm.line_dedup import dedup_lines
from goldsieve.llm.mixing import mix_sources
from goldsieve.llm.simhash import keep_one_of_each

#: Of the way from pure chance (one of the languages learned) to certainty, what a document's best language has to reach.
LEAST_SCORE = 0.1
#: Words of a shingle and differing bits of linked fingerprints in the near-duplicate stage.
SHINGLE, BITS = 4, 4

ORACLE_SQL = None


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Whole rows as one column, so that names of theirs cannot clash, beside the columns that a stage reads."""
    return docs.select(F.struct("*").alias("row"), *columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, null and empty ones included, and those that resemble no language; fills in a language that
    is missing. Repeated rows and null keys are documents like any other. An empty table, or one without labels, gives no rows."""
    network = train_language_model(docs)
    found = identify_languages(_rows(docs, "doc_id", "text"), network, carry=("row",))
    chance = 1 / max(1, len(network.languages))
    known = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= chance + LEAST_SCORE * (1 - chance)))
    return known.select(F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred")).alias("row")).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out repeated lines; documents that consist of nothing else go. Null and empty texts have no lines to lose and stay.
    Repeated rows lose the same lines; of equal lines the earliest stays. An empty table gives no rows."""
    found = dedup_lines(_rows(docs, "doc_id", "text"))
    left = found.filter((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_dropped") == 0, F.col("row.n_chars")).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return left.select(row.alias("row")).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by SimHash stays, the one with the smallest key. Texts without words, null ones
    included, are one group; repeated rows are one document. An empty table gives no rows."""
    return keep_one_of_each(docs, size=SHINGLE, bits=BITS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes sources to their target weights: a document appears as often as the mix takes it, up to three times. A null source is
    one more source; a text without words is taken once, or three times from a source taken in full. Repeated rows count each. An
    empty table gives no rows."""
    mixed = mix_sources(_rows(docs, "doc_id", "text", "source"), carry=("row",))
    taken = mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return taken.select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and digests of the ids and of the text they decode to. Null texts have no ids; repeated rows stay;
    an empty table gives no rows."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_encode_decode(docs, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language-id", languages), ("line-dedup", lines), ("simhash-near-dedup", near_copies), ("source-mix", mixture),
    ("bpe-encode-decode", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
