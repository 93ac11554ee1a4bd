"""Text helpers as column expressions; compatibility folding runs on Arrow batches, as Spark has none."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def ascii_key(text: Column) -> Column:
    """Lower-case letters and digits of ASCII text, every other run one space, trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKD", t.lower()) if t else "")


def folded_key(text: Column) -> Column:
    """ascii_key after compatibility decomposition: an accent becomes a gap where it stood between letters."""
    return F.trim(F.regexp_replace(_compatible(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def squeezed_key(text: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def shortened(text: Column, most: int = 90) -> Column:
    """At most ``most`` characters, an ellipsis after the cut."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first (pattern, value) rule that matches, without regard to case; null text gives null."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    result = F.lit(default)
    for pattern, value in reversed(rules):
        result = F.when(clean.rlike(f"(?i){pattern}"), F.lit(value)).otherwise(result)
    return F.when(clean != "", result)


def shared_words(a: Column, b: Column) -> Column:
    """How many words of three letters and more of one key begin a word of the other, or the other way round."""
    words = lambda t: F.filter(F.split(t, " "), lambda w: F.length(w) >= 3)
    return F.size(F.filter(words(a), lambda x: F.exists(words(b), lambda y: x.startswith(y) | y.startswith(x))))
