"""Text expressions: redaction, token estimate, tokens, percent wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldsieve.fixed import EMAIL_MARK, EMAIL_PATTERN, PHONE_MARK, PHONE_PATTERN

TOKEN = r"([a-z0-9\xC0-\xFF]+)"


def redact_pii(text: Column) -> Column:
    """Mask e-mail addresses, then phone numbers; NULL and '' stay as they are.

    Texts without '@' skip the address pattern. Word boundaries and digits are read as Unicode. A look ahead for a digit
    changes no match, but spares the dearer test for a word boundary nearly everywhere.
    """
    without_mail = F.when(
        text.contains("@"), F.regexp_replace(text, EMAIL_PATTERN, EMAIL_MARK)
    ).otherwise(text)
    return F.regexp_replace(without_mail, "(?U)(?=\\d)" + PHONE_PATTERN, PHONE_MARK)


def token_estimate(text: Column) -> Column:
    """Four characters count as one token."""
    return F.floor(F.length(text) / 4).cast("int")


def sorted_tokens(text: Column) -> Column:
    """Lower-cased alphanumeric tokens in order, repeats kept.

    Matching the tokens is several times faster than splitting at what lies between them.
    """
    return F.sort_array(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1)))


def percent_text(ratio: Column) -> Column:
    """'33%': rounded half to even, the way the report wording needs it."""
    return F.concat(F.bround(ratio * 100, 0).cast("int").cast("string"), F.lit("%"))


def or_word(text: Column, word: str) -> Column:
    """The text, or ``word`` when it is NULL or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(word))


def unit_hash(key: Column, seed: int) -> Column:
    """A repeatable uniform number in [0, 1) from 52 bits of md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
