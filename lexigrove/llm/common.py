"""What the operators of this subpackage share.

* tables in the shared folder (``stored``), which cut lineage and survive lost executors;
* ``split_words``: the words ``[^\\x20\\x09-\\x0D]+`` of many texts at once, with 64-bit hashes,
  in numpy over the Arrow buffers of a batch;
* small numeric helpers for hashing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.sources.shared import new_path, shared_folder, stored

__all__ = ["new_path", "shared_folder", "stored"]

#: The white space that separates words everywhere in this subpackage.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Text bytes that one numpy step works on, out of a batch of what Spark's own limit on bytes lets in; longer
#: texts are a step of their own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Column: the number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def fold_of(doc_id, folds: int = 5):
    """Column: crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


# ---------------------------------------------------------------- hashing in numpy

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random 64-bit value for each byte, and the same with A-Z sharing those of a-z.
EXACT_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_P))
_BYTE = EXACT_BYTE.copy()
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_P, n), _powers(_P_INVERSE, n)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data, offsets


def steps(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about STEP_BYTES of text each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + STEP_BYTES, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def short_batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold about STEP_BYTES of column ``text``, or one row."""
    for batch in batches:
        for first, last in steps(text_buffer(batch.column(text))[1]):
            yield batch.slice(first, last - first)


def is_blank(part: np.ndarray) -> np.ndarray:
    """Which bytes are white space."""
    return _SPACE[part]


def span_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial in the bytes' ``values``, taken from prefix sums
    modulo 2**64 and then mixed, so that no Python runs for a span."""
    up, down = _POWERS.upto(len(part))
    sums = np.zeros(len(part) + 1, _U)
    np.cumsum(values[part] * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each row), A-Z lower-cased, in text order.

    ``offsets`` may begin anywhere in ``data``.
    """
    n_rows = len(offsets) - 1
    base, end = int(offsets[0]), int(offsets[-1])
    part = data[base:end]
    if not len(part):
        return np.empty(0, _U), np.zeros(n_rows, np.int64)
    inner = offsets - base
    word = ~_SPACE[part]
    edge = np.zeros(len(part) + 1, dtype=bool)
    edge[inner] = True  # a row's end parts words like white space does
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate((word[1:], [False])))) + 1
    counts = np.diff(np.searchsorted(starts, inner))
    return span_hashes(part, starts, ends), counts


class HashTable:
    """Numbers of 64-bit keys, in numpy arrays: open addressing, whole arrays of keys at a time."""

    def __init__(self, bits: int = 12) -> None:
        self.n = 0
        self._room(bits)

    def _room(self, bits: int) -> None:
        self.mask = _U((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, _U)  # 0 is no key
        self.numbers = np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that are not there."""
        keys = np.where(keys == 0, _U(1), keys)
        out = np.full(len(keys), -1, np.int64)
        at = (keys & self.mask).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.numbers[at[hit]]
            more = ~hit & (there != 0)
            open_, at = open_[more], (at[more] + 1) & int(self.mask)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Gives new, distinct keys the next numbers, in their order."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            full = self.keys != 0
            old_keys, old_numbers = self.keys[full], self.numbers[full]
            self._room(max(12, int(4 * (self.n + len(keys))).bit_length()))
            self._put(old_keys, old_numbers)
        self._put(np.where(keys == 0, _U(1), keys), np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at = (keys & self.mask).astype(np.int64)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]], self.numbers[at[free]] = keys[free], numbers[free]  # of two at one place the last stays
            rest = self.keys[at] != keys
            keys, numbers, at = keys[rest], numbers[rest], (at[rest] + 1) & int(self.mask)
