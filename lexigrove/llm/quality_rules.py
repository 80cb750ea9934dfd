"""Quality rules under weak supervision (operator 5).

Rules look at counts of a text and vote good (1), bad (-1) or abstain (0). No rule decides alone:
expectation-maximisation over all documents estimates how often each rule votes each way on good
and on bad documents, and a document's posterior quality follows from its votes.

Edge cases: a null or empty text has no words and all counts 0; it fails the base test. Repeated
rows are each judged. Without rows the result is empty. Only ``doc_id`` and ``text`` are read, so
further columns, whatever their names, do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import common
from lexigrove.llm.weak_labels import LabelModel, fit_label_model

#: Counts of a text that rules can use, all long.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_bare", "n_distinct", "n_odd",
)

_SYMBOLS = "#*$%&|<>"
_BLANKS = "\x20\t\n\v\f\r"
#: Digits, and marks that are rare inside prose.
_ODD = re.compile(rb"[#*$%&|<>@_=+~^\\/{}\[\]0-9]")


def repeated_words(words: Sequence, width: int = 5) -> int:
    """Words that stand in a window of ``width`` words found twice or more, the first one included."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    ids: dict = {}
    window_ids = np.fromiter((ids.setdefault(w, len(ids)) for w in windows), np.int64, len(windows))
    again = np.bincount(window_ids)[window_ids] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def text_counts(text: str) -> tuple[int, ...]:
    """The COUNTS of one text. Words are byte strings parted by ASCII white space only."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes, this parts at space and \t\n\v\f\r exactly
    if not words:
        return (0,) * len(COUNTS)
    n_chars = len(text) - sum(map(text.count, _BLANKS))
    n_symbols = sum(map(text.count, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    distinct = set(words)
    bare = {w for w in distinct if not w.isalnum() and not any(map(str.isalnum, w.decode("utf-8", "replace")))}
    n_bare = sum(map(words.count, bare)) if len(bare) < 8 else sum(w in bare for w in words)
    n_upper = sum(map(bytes.isupper, words))
    odd = {w for w in distinct if _ODD.search(w)} if _ODD.search(raw) else ()
    return (
        len(words), n_chars, n_symbols, len(lines) - len(set(lines)), repeated_words(words),
        len(lines), n_upper, n_bare, len(distinct), sum(w in odd for w in words) if odd else 0,
    )


def row_key() -> Column:
    """Column: a hash of a document's id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, the COUNTS of every whole text, and ``row_key``, a hash of id and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.short_batches(batches, 1):
            rows = [text_counts(t or "") for t in batch.column(1).to_pylist()]
            values = np.array(rows, np.int64).reshape(len(rows), len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(values[:, i]) for i in range(len(COUNTS))), batch.column(2)], ["doc_id", *COUNTS, "row_key"]
            )

    schema = "doc_id long, " + ", ".join(f"{name} long" for name in COUNTS) + ", row_key long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key()).mapInArrow(count, schema)


def with_counts(docs: DataFrame, out: str) -> DataFrame:
    """``docs`` with the COUNTS of the text as a struct column; all other columns stay in the JVM."""

    @F.arrow_udf("struct<" + ", ".join(f"{name}: long" for name in COUNTS) + ">")
    def count(texts: pa.Array) -> pa.Array:
        values = np.array([text_counts(t.as_py() or "") for t in texts], np.int64).reshape(len(texts), len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(values[:, i]) for i in range(len(COUNTS))], list(COUNTS))

    return docs.withColumn(out, count.asNondeterministic()(F.col("text").cast("string")))


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: Column
    good: Column

    def vote(self) -> Column:
        return F.when(self.bad, -1).when(self.good, 1).otherwise(0)


def standard_rules(column: Callable[[str], Column] = F.col) -> list[Rule]:
    """The rules of the query; ``column`` gives the Column of one of the COUNTS.

    They differ in how much they can be trusted, which is for the model to find out: most bad ways are seen
    by two rules or more, while a short text, say, has often nothing else against it.
    """
    n, c = column("n_words"), column
    return [
        Rule("length", n < 20, n >= 40),
        Rule("symbols", c("n_symbols") * 10 > n, c("n_symbols") * 50 <= n),
        Rule("odd_words", c("n_odd") * 5 > n, c("n_odd") * 20 <= n),
        Rule("shouting", c("n_upper") * 10 > n * 3, c("n_upper") * 20 <= n),
        Rule("repeats", c("n_repeat_words") * 100 > n * 20, c("n_repeat_words") * 20 <= n),
        Rule("lines", c("n_dup_lines") * 2 > c("n_lines"), c("n_dup_lines") == 0),
        Rule("bare_tokens", c("n_bare") * 10 > n, c("n_bare") * 50 <= n),
        Rule("variety", c("n_distinct") * 5 < n * 2, c("n_distinct") * 2 > n),
        Rule("word_length", (c("word_chars") < n * 3) | (c("word_chars") > n * 11), c("word_chars").between(n * 4, n * 8)),
    ]


def base_failed(column: Callable[[str], Column] = F.col) -> Column:
    return (column("n_words") < 10) | (column("n_repeat_words") * 100 > column("n_words") * 20)


def votes_of(counts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``counts`` with the array ``votes``, one vote for each rule."""
    return counts.withColumn("votes", F.array(*(r.vote().cast("int") for r in rules)))


def judged(
    docs: DataFrame, rules: Sequence[Rule] | None = None, keep_at: float = 0.5
) -> tuple[DataFrame, LabelModel]:
    """Every document with its COUNTS, votes, posterior ``quality``, base_failed and kept; the model.

    The text is read once: the counts go to a table in the shared folder. The model is fitted to the
    number of documents of each vote pattern, of which there are at most 3 to the number of rules.
    """
    rules = list(rules or standard_rules())
    voted = common.stored(votes_of(counted(docs), rules), "quality-counts")
    model = fit_label_model(voted, "votes", [r.name for r in rules])
    out = (
        voted.withColumn("quality", model.posterior(F.col("votes")))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))
    )
    return out, model


def passed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    A first pass fits the model and gives each vote pattern its posterior; a second judges each row
    where it is read, by its pattern, so no text is shuffled. There are at most 3 to the number of rules
    patterns, so that their table can be broadcast.
    """
    judgement, _ = judged(docs)
    patterns = judgement.groupBy(F.col("votes").alias("__votes")).agg(F.max("quality").alias("__quality"))
    column = "__counts"
    while column in docs.columns:
        column += "_"
    told = with_counts(docs, column)
    at = lambda name: F.col(f"{column}.{name}")
    votes = F.array(*(r.vote().cast("int") for r in standard_rules(at)))
    good = patterns.where("__quality >= 0.5").select("__votes")
    return told.where(~base_failed(at)).join(F.broadcast(good), votes == F.col("__votes"), "left_semi").select(docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = judged(common.table(spark, sf_dir, "documents"))
    names = ["doc_id", *COUNTS[:5], "base_failed", "kept", "quality"]
    return out.select(*names)
