"""Reading loosely shaped JSON from judges: key fallbacks and truthiness, on VARIANT values.

A member counts only if it is present and not null, '', 0, false, [] or {}. That is read off its JSON
text, where the text "0" keeps its quotes and so differs from the number 0.

Members are first taken out as columns of their own (``with_members``), so that each is looked up and
written as JSON once per row however many rules ask about it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EMPTY = ["null", '""', "false", "[]", "{}", "0", "-0", "0.0", "-0.0"]


def parse_object(raw: Column) -> Column:
    """The JSON object as VARIANT; NULL for NULL, broken JSON or any other JSON type."""
    return F.when(raw.rlike(r"^\s*\{"), F.try_parse_json(raw))


def member_columns(key: str) -> tuple[str, str]:
    """The columns of a member: its value and its JSON text. Column names ignore case, keys do not."""
    name = "".join(f"^{c.lower()}" if c.isupper() else c for c in key)
    return f"_value_{name}", f"_json_{name}"


def _value(key: str) -> Column:
    return F.col(member_columns(key)[0])


def _json(key: str) -> Column:
    return F.col(member_columns(key)[1])


def counts(json: Column) -> Column:
    """Does a member with this JSON text count; NULL when there is no member."""
    return ~json.isin(_EMPTY)


def with_members(frame: DataFrame, doc: str, keys: Iterable[str]) -> DataFrame:
    """Take members of the object in column ``doc`` out as values and as JSON text."""
    keys = list(dict.fromkeys(keys))
    values = {member_columns(k)[0]: F.try_variant_get(F.col(doc), f'$["{k}"]', "variant") for k in keys}
    return frame.withColumns(values).withColumns({member_columns(k)[1]: F.to_json(_value(k)) for k in keys})


def first_counting(keys: list[str]) -> Column:
    """The first member that counts, as VARIANT, else NULL."""
    return F.coalesce(*[F.when(counts(_json(k)), _value(k)) for k in keys])


def first_json(keys: list[str]) -> Column:
    """The JSON text of the first member that counts, else NULL."""
    return F.coalesce(*[F.when(counts(_json(k)), _json(k)) for k in keys])


def pick_text(keys: list[str], default: str | None = None) -> Column:
    """The first member that counts, as text, else ``default``."""
    text = first_counting(keys).cast("string")
    return text if default is None else F.coalesce(text, F.lit(default))


def pick_int(keys: list[str], default: int) -> Column:
    """The first member that counts, as a whole number; unreadable text gives NULL."""
    number = first_counting(keys).cast("string").try_cast("double").try_cast("int")
    return F.when(first_json(keys).isNull(), F.lit(default)).otherwise(number)


def pick_bool(key: str, default: bool) -> Column:
    """A boolean member. Absent gives ``default``, null gives false, 'false' as text is false."""
    typed = F.coalesce(_value(key).cast("string").try_cast("boolean"), counts(_json(key)))
    return F.when(_json(key).isNull(), F.lit(default)).when(_json(key) == "null", F.lit(False)).otherwise(typed)


def string_items(text: Column) -> Column:
    """A JSON array of strings as an array; NULL, '' and broken text give an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
