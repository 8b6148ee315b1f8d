"""Tokenizers shared by the retrieval operators and their SQL twins.

FIXED VALUES: the whitespace class equals Python's ``str.split()``
whitespace; the word pattern equals runs of two or more word characters
(letters, digits, underscore), i.e. the default TF-IDF token pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python str.split() whitespace, written with \x{..} escapes understood by both
# Java regex (Spark) and RE2 (DuckDB).
WHITESPACE = (r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
              r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
WORD = r"[\p{L}\p{N}_]{2,}"


def whitespace_tokens(text: Column) -> Column:
    """Distinct lower-cased whitespace tokens (no empty strings)."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), WHITESPACE, -1)
    return F.array_distinct(F.array_remove(parts, ""))


def word_tokens(text: Column) -> Column:
    """All lower-cased word tokens of length >= 2, in text order (with repeats)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def sql_whitespace_tokens(text: str) -> str:
    return (f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '{WHITESPACE}'), "
            f"lambda t: t <> ''))")


def sql_word_tokens(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{WORD}')"

