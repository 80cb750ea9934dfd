"""Typo tolerance: how many edits a word may have, and words within that distance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ONE_FROM, TWO_FROM = 5, 9
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def allowed(length: Column, level: str = "default", one_from: int = ONE_FROM, two_from: int = TWO_FROM) -> Column:
    """Edits allowed for words of a length; level is disabled, min or default."""
    if level == "disabled":
        return F.lit(0)
    one = F.when(length >= one_from, 1).otherwise(0)
    return one if level == "min" else F.when(length >= two_from, 2).otherwise(one)


def penalty(distance: Column) -> Column:
    return F.when(distance == 0, 0.0).otherwise(0.5 / distance)


def is_prefix(query: Column, candidate: Column) -> Column:
    """Whether the candidate begins the query, in any case."""
    return F.lower(query).startswith(F.lower(candidate))


def substitutions(term: Column) -> Column:
    """All words that differ from the term in one letter, by place and then by letter."""
    places = F.sequence(F.lit(1), F.length(term))
    letters = F.array(*map(F.lit, LETTERS))

    def at(i: Column) -> Column:
        other = F.filter(letters, lambda c: c != F.substring(term, i, F.lit(1)))
        return F.transform(other, lambda c: F.concat(F.substring(term, F.lit(1), i - 1), c, F.substring(term, i + 1, F.length(term))))

    return F.flatten(F.transform(places, at))


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, no part edited twice."""
    last, before, row = [], [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = before[j - 1] if x == y else 1 + min(before[j - 1], before[j], row[-1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and last[j - 2] + 1 < best:
                best = last[j - 2] + 1
            row.append(best)
    return row[-1]


@F.pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def swapped(a: Column, b: Column) -> Column:
    """Whether one swap of neighbours makes ``a``, of two characters or more, to ``b``."""

    def at(i: Column) -> Column:
        return F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b

    return F.exists(F.sequence(F.lit(1), F.length(a) - 1), at)


def without_one(word: Column) -> Column:
    """Array of the words that are left when one character is dropped."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def shortened(word: Column, most: int) -> Column:
    """Array of the distinct words that are left when up to ``most`` (0 to 2) characters are dropped."""
    out = F.array(word)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(F.filter(out, lambda w: w != ""), without_one))))
    return out


def _without(word: Column, at: Column) -> Column:
    """The word less its character at a place, from 1; at 0 the whole word."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word)))


def _dropped(words: DataFrame, word: str, wide: bool) -> DataFrame:
    """A row for each way to drop up to ``room`` characters of a word: at ``at`` and, before it, at ``and_at`` (0: none).
    ``key`` is a hash of what is left. ``wide``: whether there is room for two."""
    out = words.withColumn("at", F.explode(F.sequence(F.lit(0), F.when(F.col("room") > 0, F.length(word)).otherwise(0))))
    left = _without(F.col(word), F.col("at"))
    if not wide:
        return out.withColumn("key", F.xxhash64(left))
    before = F.when((F.col("room") == 2) & (F.col("at") > 1), F.sequence(F.lit(0), F.col("at") - 1)).otherwise(F.array(F.lit(0)))
    return out.withColumn("and_at", F.explode(before)).withColumn("key", F.xxhash64(F.col("room") == 2, _without(left, F.col("and_at"))))


def _one_edit(i: Column, j: Column) -> Column:
    """Distance of a query and a term that are the same without their characters at i and j (0: none is left out), if
    it is one at most. Of all such places of two words only one pair tells it; null for all others."""
    last = lambda word, at: F.substring(word, at, F.lit(1)) != F.substring(word, at + 1, F.lit(1))  # noqa: E731  # of a run of one character
    other = F.col("query") != F.col("term")
    found = (
        F.when((i == 0) & (j == 0), 0)
        .when(j == 0, F.when(last("query", i), 1))
        .when(i == 0, F.when(last("term", j), 1))
        .when(i == j, F.when(other, 1))
        .when(i + 1 == j, F.when(other & (F.substring("query", i, F.lit(1)) == F.substring("term", j, F.lit(1))), 1))
    )
    return F.when(_without(F.col("query"), i) == _without(F.col("term"), j), found)  # hashes can be equal by chance


def _swaps_may_join(plain: Column) -> Column:
    """False if a query and a term that are three or four plain edits apart can't be joined by two swaps or by a swap and an
    edit: swaps keep the characters, an edit changes, adds or drops one."""
    a, b = (F.array_join(F.sort_array(F.split(word, "")), "") for word in ("query", "term"))
    return F.levenshtein(a, b) <= F.when(plain == 4, 0).otherwise(2 - F.abs(F.length("query") - F.length("term")))


#: Evaluated where it stands: the planner would move the plain function below the step that makes pairs single.
_exact_distance = F.pandas_udf(edit_distance.func, T.IntegerType()).asNondeterministic()


def fuzzy(queries: DataFrame, terms: DataFrame, level: str = "default", most: int | None = 8) -> DataFrame:
    """(query, term, distance): for each query (column query) its best terms within the allowed edits; ``terms`` has
    term, each once, and total_tf. Ties go to commoner terms, then by term. Without ``most``, all of them.

    Words within so many edits of each other share a word that is left when each drops as many characters, so both
    sides meet by hashes of such words, an equality with many small keys, and never by length. What is left when characters
    are dropped is many times larger than the words' file, so neither side is ever sent to all tasks.

    Where one edit is allowed the places of the dropped characters tell a pair, and tell it once: nothing is measured, and
    no pairs have to be made single. Where two are, plain Levenshtein distance in the JVM decides: up to two it is
    the distance, but for swaps of neighbours. Of pairs three or four apart only those with nearly the same characters, which two
    swaps or a swap and an edit may join, reach the exact distance.
    """
    wide = level not in ("disabled", "min")
    q = queries.select("query").where(F.col("query").isNotNull()).distinct().withColumn("room", allowed(F.length("query"), level))
    size = F.length("query")
    of = lambda length, room: F.struct(length.alias("length"), F.lit(room).alias("room"))
    reach = F.when(F.col("room") == 0, F.array(of(size, 0))).when(F.col("room") == 1, F.array(of(size - 1, 0), of(size, 1), of(size + 1, 1)))
    reach = reach.otherwise(F.array(*(of(size + n, 2) for n in range(-2, 3))))
    lengths = q.select(F.explode(reach).alias("of")).groupBy("of.length", (F.col("of.room") == 2).alias("two")).agg(F.max("of.room").alias("room"))
    rooms = terms.select("term", "total_tf", F.length("term").alias("length")).join(F.broadcast(lengths), "length")  # two rows for some lengths
    asked = _dropped(q, "query", wide).select("query", "room", F.col("at").alias("i"), "key")
    known = _dropped(rooms, "term", wide).select("term", "total_tf", F.col("room").alias("of"), F.col("at").alias("j"), "key")
    pairs = asked.hint("merge").join(known.hint("merge"), "key")
    near_by = F.when((F.col("room") > 0) | (F.col("j") == 0), _one_edit(F.col("i"), F.col("j")))
    if not wide:
        near = pairs.withColumn("distance", near_by).where(F.col("distance").isNotNull())
    else:
        found = F.when(F.col("room") == 2, -1).otherwise(F.when(F.col("of") < 2, near_by))  # -1: to be measured
        found = pairs.withColumn("found", found).where(F.col("found").isNotNull())
        single = found.groupBy("query", "term", "total_tf").agg(F.min("found").alias("found"))  # what is made of ``found`` stays above
        measured = F.when(F.col("found") < 0, F.levenshtein("query", "term", 4)).otherwise(F.col("found"))
        swap = (F.col("found") < 0) & (F.col("plain") == 2) & (F.length("query") == F.length("term")) & swapped(F.col("query"), F.col("term"))
        plain = single.withColumn("plain", measured).where((F.col("plain") >= 0) & ((F.col("plain") <= 2) | _swaps_may_join(F.col("plain"))))
        plain = plain.withColumn("plain", F.when(swap, 1).otherwise(F.col("plain")))
        far = lambda c: F.when(F.col("plain") > 2, F.col(c))
        exact = plain.withColumn("exact", _exact_distance(far("query"), far("term")))
        near = exact.select("query", "term", "total_tf", F.coalesce("exact", "plain").alias("distance")).where(F.col("distance") <= 2)
    if most is not None:
        place = F.row_number().over(W.partitionBy("query").orderBy(F.col("distance").asc(), F.desc("total_tf"), F.col("term").asc()))
        near = near.withColumn("place", place).where(F.col("place") <= most)
    return near.select("query", "term", "distance")
