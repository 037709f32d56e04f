"""Words of whole texts as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run without the ASCII characters other than digits and small letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z, nothing else changed; texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column, pattern: str = WORD) -> Column:
    """The words of a text in order; null has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def count_words(text: Column) -> Column:
    """Number of words; lower-casing changes no word's ends, so the pattern takes both cases."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("bigint")


def runs(count: Column, at, none: str) -> Column:
    """``at(i)`` for i = 0 .. count - 1, an empty array of type ``none`` if count is not positive."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast(f"array<{none}>"))


def spread(rows: DataFrame, keep: list[str], array: Column, name: str = "at") -> DataFrame:
    """``keep`` and one row per element of ``array``. The outer form: for the inner one Spark infers a filter on the
    array's size and computes the whole array a second time below it."""
    return rows.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
