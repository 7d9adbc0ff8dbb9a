"""Text normalization in two flavours that must never be mixed, and pieces of normalized text.

normalize_sql keeps letters, numbers and marks (native). normalize_unicode is NFKC with case folding, keeps word
characters and so splits at combining vowel signs and keeps underscores (an Arrow UDF, as Spark has neither NFKC nor
folding). Nulls become ''.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_WORD = r"[^\p{L}\p{N}\p{M}]+"


def normalize_sql(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    plain = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(plain, NOT_WORD, " "))


def _fold(value: str | None) -> str:
    text = unicodedata.normalize("NFKC", value or "").casefold().replace("&", " and ")
    return " ".join(re.sub(r"[^\w]+", " ", text).split())


@F.pandas_udf(T.StringType())
def normalize_unicode(text: pd.Series) -> pd.Series:
    return text.map(_fold, na_action=None)


def _accents(value: str | None) -> str:
    text = _fold(value)
    bare = _fold("".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)))
    return text if bare == text else f"{text} {bare}"


@F.pandas_udf(T.StringType())
def with_bare_accents(text: pd.Series) -> pd.Series:
    """The text that name retrieval sees: normalize_unicode, and behind it the same without accents where that differs."""
    return text.map(_accents, na_action=None)


def compact(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def tokens(text: Column) -> Column:
    """Words of a normalized text, in order, with repeats and without empty ones."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def digit_runs(text: Column) -> Column:
    """Runs of ASCII digits, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))


def unicode_digit_set(normalized: Column) -> Column:
    """Distinct runs of digits of any script."""
    return F.array_distinct(F.regexp_extract_all(normalized, F.lit(r"(\p{Nd}+)"), F.lit(1)))


def field_text(name: Column, address: Column) -> Column:
    """The text that retrieval sees: fields with their tags."""
    return F.concat_ws(" ", F.lit("name"), name, F.lit("address"), address)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, not again for each element of a lambda in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(text: Column, low: int, high: int) -> Column:
    """All character n-grams of low to high characters, spaces included, case kept."""
    return _once(text, lambda t: F.flatten(F.array(*[_of(t, n) for n in range(low, high + 1)])))


def _of(text: Column, n: int) -> Column:
    spots = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.substring(text, i, F.lit(n)))


def word_grams(text: Column, low: int, high: int) -> Column:
    """Character n-grams inside words, each word between two spaces; a short word gives itself once."""
    def of(word: Column) -> Column:
        one = lambda padded, n: F.when(F.length(padded) <= n, F.when(F.lit(n == low) | (F.length(padded) >= n), F.array(padded)).otherwise(F.array().cast("array<string>"))).otherwise(_of(padded, n))
        return _once(F.concat(F.lit(" "), word, F.lit(" ")), lambda padded: F.flatten(F.array(*[one(padded, n) for n in range(low, high + 1)])))

    return F.flatten(F.transform(tokens(text), of))


def word_pairs(text: Column) -> Column:
    """Words and pairs of neighbouring words."""
    def of(words: Column) -> Column:
        n = F.size(words)
        pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))
        return F.concat(words, pairs)

    return _once(tokens(text), of)


def md5_number(text: Column) -> Column:
    """The low 64 bits of md5, its bytes from the least: the order of this hexadecimal text is that of the number."""
    low = F.right(F.md5(text.cast("binary")), F.lit(16))
    return F.concat(*[F.substring(low, 15 - 2 * k, 2) for k in range(8)])


def md5_bucket(text: Column, n: int) -> Column:
    return (F.conv(md5_number(text), 16, 10).cast("decimal(20,0)") % n).cast("int")


def sha_rank(seed: int, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), text).cast("binary"), 256)
