"""Text analysis: text of values, words, normal form, stop words, stems, offsets, and clean-up of strings."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.functions.stemming import english_stem

#: Runs of letters, marks and digits. It means the same to Spark and to other SQL engines.
SIMPLE_WORDS = r"[\p{L}\p{M}\p{N}]+"

#: Words by Unicode's default boundaries: letters and digits, joined by the marks that may stand inside. Each
#: ideograph and each hiragana sign is a word of its own, with the marks that follow it.
_LONE = r"\p{IsHan}\p{IsHiragana}"
UNICODE_WORDS = (
    rf"[{_LONE}]\p{{M}}*|(?:[\p{{L}}\p{{M}}\p{{N}}_&&[^{_LONE}]]"
    rf"|(?<=[\p{{L}}\p{{M}}&&[^{_LONE}]])[.:·'’](?=[\p{{L}}&&[^{_LONE}]])|(?<=\p{{Nd}})[.,;'’](?=\p{{Nd}}))+"
)


def words(text: Column, pattern: str = UNICODE_WORDS) -> Column:
    """Array of the words of a text that hold a letter or digit; null text gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return found if pattern == SIMPLE_WORDS else F.filter(found, lambda w: w.rlike(r"[\p{L}\p{N}]"))


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """NFC. Only texts with combining marks reach Python, as a null stands there for any other: a branch alone does not
    keep rows from a Python function. All others stay as they are."""
    marked = F.when(text.rlike(r"\p{M}"), text)
    return F.coalesce(_composed(marked), text)


def normal(text: Column, nfc: bool = False) -> Column:
    """Lower case, after NFC if asked for."""
    return F.lower(composed(text) if nfc else text)


def as_text(value: Column, separator: str = " ", kind: T.DataType | None = None) -> Column:
    """Text of a value of any kind: null is empty; elements of arrays, fields of structs by name and values of
    maps by key are joined by the separator, at any depth. Without ``kind`` the value is taken for a plain one."""
    if isinstance(kind, T.ArrayType):
        parts = F.transform(value, lambda x: as_text(x, separator, kind.elementType))
    elif isinstance(kind, T.MapType):
        parts = F.transform(F.array_sort(F.map_entries(value)), lambda x: as_text(x["value"], separator, kind.valueType))
    elif isinstance(kind, T.StructType):
        parts = F.array(*(as_text(value[f.name], separator, f.dataType) for f in sorted(kind.fields, key=lambda f: f.name)))
        parts = F.when(value.isNotNull(), parts)
    else:
        return F.coalesce(value.cast("string"), F.lit(""))
    return F.coalesce(F.array_join(parts, separator, ""), F.lit(""))


def array_text(value: Column, separator: str = " ") -> Column:
    """Text of an array of strings; a null element counts as an empty text between separators."""
    return F.coalesce(F.array_join(value, separator, ""), F.lit(""))


def _texts(docs: DataFrame, fields: Sequence[str], separator: str) -> Column:
    of = lambda f: as_text(F.col(f), separator, docs.schema[f].dataType)
    return F.explode(F.array(*(F.struct(F.lit(f).alias("field"), of(f).alias("text")) for f in fields)))


def tokens(
    docs: DataFrame, fields: Sequence[str], key: str = "doc_id", pattern: str = SIMPLE_WORDS, stop_words: Sequence[str] = (), separator: str = " "
) -> DataFrame:
    """(key, field, pos, term) of all words; ``pos`` counts every word, stop words included."""
    each = docs.select(key, _texts(docs, fields, separator).alias("f")).select(key, "f.field", F.posexplode(words(normal(F.col("f.text")), pattern)).alias("pos", "term"))
    return each.where(~F.col("term").isin(list(stop_words))) if stop_words else each


def analysed(
    docs: DataFrame, fields: Sequence[str], key: str = "doc_id", pattern: str = SIMPLE_WORDS, stop_words: Sequence[str] = (), stem: bool = False, separator: str = " "
) -> DataFrame:
    """(key, field, pos, term, original, start, end): every word with what stood in the text and where, in characters.

    The pieces between words are what splitting by the same pattern leaves, so a word starts where the lengths of
    all words and pieces before it end: a running sum over the words of a text.
    """
    texts = docs.select(key, _texts(docs, fields, separator).alias("f")).select(key, "f.field", F.col("f.text").alias("text"), F.monotonically_increasing_id().alias("row"))
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(found.alias("word"), F.split("text", pattern, -1).alias("gap"))
    each = texts.select(key, "field", "row", F.posexplode(pieces).alias("pos", "x")).select(key, "field", "row", "pos", F.col("x.word").alias("original"), F.col("x.gap").alias("gap"))
    each = each.where(F.col("original").isNotNull())
    size = F.length("original")
    ends = F.sum(F.length("gap") + size).over(W.partitionBy("row").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    each = each.withColumn("end", ends).withColumn("start", F.col("end") - size).withColumn("term", F.lower("original")).where(F.col("original").rlike(r"[\p{L}\p{N}]"))
    each = each.where(~F.col("term").isin(list(stop_words))) if stop_words else each
    each = stemmed(each).withColumn("term", F.col("stem")) if stem else each
    return each.select(key, "field", "pos", "term", "original", "start", "end")


@F.pandas_udf(T.StringType())
def _english(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: None if t is None else english_stem(t))


def stemmed(terms: DataFrame, column: str = "term", out: str = "stem") -> DataFrame:
    """``terms`` with the English stem of a column. Each distinct term is stemmed once and joined back."""
    distinct = terms.select(column).distinct().withColumn(out, _english(F.col(column)))
    return terms.join(distinct, column)


def without_controls(text: Column) -> Column:
    """Drops control characters but for line feeds, tabs and returns; runs of spaces become one."""
    return F.regexp_replace(F.regexp_replace(text, r"[\p{Cc}&&[^\n\t\r]]", ""), " +", " ")


def trimmed(text: Column) -> Column:
    """Drops control characters that are no white space, and white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[\p{Cc}&&[^\s]]", ""), r"^\s+|\s+$", "")


def highlighted(text: Column, terms: Sequence[str], before: str = "<em>", after: str = "</em>") -> Column:
    """The text with every whole word that equals a term, in any case, between the marks."""
    if not terms:
        return text
    either = "|".join(rf"\Q{t}\E" for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_])({either})(?![\p{{L}}\p{{N}}_])", f"{before}$1{after}")


def cropped(text: Column, n: int = 200) -> Column:
    """The first n characters, and an ellipsis if there were more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def readable_bytes(n: Column) -> Column:
    """A number of bytes in the largest unit of 1,024 that is not above it, with two decimals."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        out = F.when(n >= 1024**power, F.concat(F.replace(F.call_function("format_number", n / float(1024**power), F.lit("0.00")), F.lit(",")), F.lit(f" {unit}"))).otherwise(out)
    return out


#: Units of a duration, in seconds.
DURATIONS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}


def duration_seconds(value: Column) -> Column:
    """Column: seconds of a duration such as ``250ms`` or ``1.5h``; null for anything else. A number alone is seconds."""
    pattern = r"^\s*(\d+\.?\d*|\.\d+)(" + "|".join(DURATIONS) + r")?\s*$"
    unit = F.regexp_extract(value, pattern, 2)
    factor = F.lit(1.0)
    for name, seconds in DURATIONS.items():
        factor = F.when(unit == name, F.lit(seconds)).otherwise(factor)
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, 1).cast("double") * factor)
