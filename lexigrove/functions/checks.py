"""Checks of names, keys and request texts, as Columns that say whether a value is valid; null is not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What names may hold, how long texts may be in bytes, and names that collections may not have.
COLLECTION_NAME, FIELD_NAME = r"^[a-zA-Z0-9_-]{1,512}$", r"^[a-zA-Z0-9_.]{1,512}$"
MOST_KEY_BYTES, MOST_QUERY_BYTES, MOST_FILTER_BYTES = 512, 4096, 2048
RESERVED_NAMES = ("*", "all", "system", "internal", ".", "..", "metrics", "health", "version", "stats")


def collection_name(value: Column) -> Column:
    return F.coalesce(value.rlike(COLLECTION_NAME) & ~value.isin(*RESERVED_NAMES), F.lit(False))


def field_name(value: Column) -> Column:
    return F.coalesce(value.rlike(FIELD_NAME), F.lit(False))


def key_text(value: Column) -> Column:
    """A key as text: not empty, and of a bounded length."""
    return F.coalesce(F.octet_length(value).between(1, MOST_KEY_BYTES), F.lit(False))


def query_text(value: Column, most: int = MOST_QUERY_BYTES) -> Column:
    return F.coalesce(F.octet_length(value) <= most, F.lit(False))


def filter_text(value: Column) -> Column:
    return query_text(value, MOST_FILTER_BYTES)


def as_key(column: str, kind: T.DataType) -> Column:
    """Column: a key as text. Keys are strings or numbers; any other kind is refused."""
    if not isinstance(kind, T.StringType | T.NumericType):
        raise TypeError(f"{column} is {kind.simpleString()}; a key must be a string or a number")
    return F.col(column).cast("string")
