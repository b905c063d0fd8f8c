"""Keyed table upkeep without row updates in place: upsert, insert-if-absent, keyed update, new column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(rows: DataFrame, key: str, *order: str, last: bool = True) -> DataFrame:
    """The last (or first) row of every key by ``order``; rows it does not tell apart go by all their values.

    Combines on the map side, and gives the same row however the input is split.
    """
    others = [c for c in rows.columns if c != key]
    if not others:
        return rows.distinct()
    place = F.struct(*order, *others)
    chosen = (F.max_by if last else F.min_by)(F.struct(*others), place)
    picked = rows.groupBy(key).agg(chosen.alias("_row"))
    return picked.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def upsert(existing: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of ``new`` replace rows of ``existing`` with the same key; of repeated new keys the last by ``order`` counts."""
    newest = one_per_key(new, key, *order)
    return existing.join(newest.select(key), key, "left_anti").unionByName(newest, allowMissingColumns=True)


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet are added, of a repeated key the first by ``order``; others are ignored."""
    fresh = one_per_key(new.join(existing.select(key), key, "left_anti"), key, *order, last=False)
    return existing.unionByName(fresh.select(*new.columns), allowMissingColumns=True)


def keyed_update(table: DataFrame, changes: DataFrame, key: str, *order: str) -> DataFrame:
    """Set the columns of ``changes`` (but those of ``order``) on the rows with the same key; a change may set NULL.

    Of several changes to a key the last by ``order`` counts.
    """
    columns = [c for c in changes.columns if c != key and c not in order]
    packed = one_per_key(changes, key, *order).select(key, F.struct(*columns).alias("_new"))
    joined = table.join(packed, key, "left")
    values = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(values).drop("_new").select(*table.columns)


def add_missing_column(table: DataFrame, name: str, dtype: str) -> DataFrame:
    """The table with a NULL column ``name``; unchanged if it has one."""
    return table if name in table.columns else table.withColumn(name, F.lit(None).cast(dtype))


def latest_per_key(history: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of every key of an append-only table, of equally new ones by their values; combines on the map side."""
    columns = [c for c in history.columns if c != key]
    newest = history.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order, *columns)).alias("_row"))
    return newest.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def stable_id(natural_key: Column) -> Column:
    """A 63-bit id that depends only on the natural key, so reruns and lost executors keep it."""
    digits = F.conv(F.substring(F.md5(natural_key.cast("string")), 1, 16), 16, 10).cast("decimal(20,0)")
    return (digits % F.lit(2**63 - 1).cast("decimal(20,0)")).cast("bigint")


def assign_eval_ids(labeled: DataFrame) -> DataFrame:
    """Give labeled interactions their eval id; equal interactions always get equal ids."""
    return labeled.withColumn("eval_id", stable_id(F.col("interaction_id")))
