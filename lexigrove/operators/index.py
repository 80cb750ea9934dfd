"""The inverted index as four tables, and how documents enter and leave it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.functions import text
from lexigrove.functions.stemming import english_stem
from lexigrove.sources import shared


@dataclass(frozen=True)
class Index:
    """postings (term, doc_id, field, tf), lengths (doc_id, field, length): a row for each document and
    field, also with no words. A stored index also keeps what follows from them: ``dictionary`` (what
    ``terms`` gives), ``by_doc`` (what ``doc_lengths`` gives) and the ``numbers`` of ``stats``."""

    postings: DataFrame
    lengths: DataFrame
    dictionary: DataFrame | None = None
    by_doc: DataFrame | None = None
    numbers: tuple[int, float] | None = None
    dealt: bool = False  # whether postings already lie by term and share of the documents
    one_field: bool = False  # whether a term has one posting for each document
    words: DataFrame | None = None  # (term) of each word, as it comes from the texts
    texts: Texts | None = None  # what the index is made of, if documents come straight from their texts

    def totals(self) -> DataFrame:
        """(term, total_tf): the dictionary without numbers of documents. Before an index is stored, words are counted
        where they are read, and only counts meet."""
        if self.dictionary is not None:
            return self.dictionary.select("term", "total_tf")
        if self.words is not None:
            return self.words.groupBy("term").agg(F.count("*").alias("total_tf"))
        return self.postings.groupBy("term").agg(F.sum("tf").alias("total_tf"))

    def terms(self) -> DataFrame:
        """(term, doc_freq, total_tf). A term's postings are summed by document before they meet."""
        if self.dictionary is not None:
            return self.dictionary
        if self.one_field:
            return self.postings.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("total_tf"))
        by_doc = self.postings.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
        return by_doc.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("total_tf"))

    def field_terms(self) -> DataFrame:
        """(term, field, total_tf)."""
        return self.postings.groupBy("term", "field").agg(F.sum("tf").alias("total_tf"))

    def doc_lengths(self) -> DataFrame:
        """(doc_id, length over all fields)."""
        if self.by_doc is not None:
            return self.by_doc
        return self.lengths.groupBy("doc_id").agg(F.sum("length").alias("length"))

    def stats(self) -> DataFrame:
        """One row: doc_count, total_length, avg_length (0 without documents)."""
        sums = self.doc_lengths().agg(F.count("*").alias("doc_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length"))
        return sums.withColumn("avg_length", F.when(F.col("doc_count") > 0, F.col("total_length") / F.col("doc_count")).otherwise(0.0))

    def size(self) -> tuple[int, float]:
        """Number of documents and their mean length."""
        if self.numbers is not None:
            return self.numbers
        row = self.stats().first()
        return row["doc_count"], row["avg_length"]

    def narrowed(self, terms: Sequence[str]) -> Index:
        """The index with the postings of these terms alone, and the lengths of all documents. An index that is not stored
        would read and split all texts for each use of either; here one pass keeps both, in a table of the shared folder."""
        if self.texts is None or self.texts.stem or self.numbers is not None:
            return self
        wanted = sorted(set(terms))
        found = F.filter("f.words", lambda w: w.isin(wanted)).alias("found")
        kept = shared.stored(self.texts.split().select("doc_id", "f.field", F.size("f.words").cast("long").alias("length"), found), "narrowed")
        postings = kept.select("doc_id", "field", F.explode("found").alias("term")).groupBy("term", "doc_id", "field").agg(F.count("*").alias("tf"))
        return Index(postings, kept.select("doc_id", "field", "length"), one_field=self.one_field)

    def without(self, ids: DataFrame) -> Index:
        """The index less the documents of ``ids`` (column doc_id)."""
        return Index(self.postings.join(ids, "doc_id", "left_anti"), self.lengths.join(ids, "doc_id", "left_anti"))

    def plus(self, other: Index) -> Index:
        return Index(self.postings.unionByName(other.postings), self.lengths.unionByName(other.lengths))

    def write(self, path: str) -> Index:
        """Writes the tables to a folder and reads them back; ``load`` reads them in any other session.

        Each file holds the postings of a share of the documents, sorted by term, so that no task gets a common term
        whole and reads of a term skip most of each file. Documents that come from their texts are counted where their
        texts lie: words never meet in a shuffle, and lengths follow from postings. Others, and those that repeat a key,
        whose counts must meet, are dealt out by term and share. Statistics are taken from the tables once, so that a query
        reads its postings and the lengths of its documents and nothing else.
        """
        spark = self.postings.sparkSession
        size = None if self.texts is None else self.texts.size()
        alone = size is not None
        if alone:
            dealt = self.texts.postings(size)
        else:
            dealt = self.postings if self.dealt else self.postings.repartition(F.col("term"), _share())
        dealt.sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings")
        written = spark.read.parquet(f"{path}/postings")
        (self.texts.lengths(written) if alone else self.lengths).write.parquet(f"{path}/lengths")
        kept = Index(written, spark.read.parquet(f"{path}/lengths"), one_field=self.one_field)
        terms = written.groupBy("term").agg(F.count_if("first").alias("doc_freq"), F.sum("tf").alias("total_tf")) if alone else kept.terms()
        terms.sortWithinPartitions("term").write.parquet(f"{path}/terms")
        kept.doc_lengths().write.parquet(f"{path}/doc-lengths")
        replace(kept, by_doc=spark.read.parquet(f"{path}/doc-lengths")).stats().write.parquet(f"{path}/numbers")
        return load(spark, path)

    def stored(self) -> Index:
        """``write`` to a new folder of the shared one."""
        return self.write(shared.new_path(self.postings.sparkSession, "index"))


TASK_BYTES = 16 << 20  # bytes of text of which one task makes postings; they take some ten times as many


@dataclass(frozen=True)
class Texts:
    """The texts that an index is made of: ``docs`` (doc_id and fields), text and words of each field, before stems."""

    docs: DataFrame
    fields: Sequence[str]
    texts: Sequence[Column]
    words: Sequence[Column]
    stem: bool = False

    def size(self) -> int | None:
        """Bytes of all texts; None if documents repeat a key, so that counts of several rows belong together."""
        each = self.docs.select("doc_id", sum((F.octet_length(t).cast("long") for t in self.texts), F.lit(0)).alias("size"))
        of_key = each.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        row = of_key.agg(F.max("n").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
        return None if (row["n"] or 0) > 1 else row["size"]

    def split(self) -> DataFrame:
        """(doc_id, f: field and words) of each text, where it lies."""
        each = (F.struct(F.lit(f).alias("field"), w.alias("words")) for f, w in zip(self.fields, self.words, strict=True))
        return spread(self.docs).select("doc_id", F.explode(F.array(*each)).alias("f"))

    def postings(self, size: int) -> DataFrame:
        """(term, doc_id, field, tf, first), counted document by document; ``first``: whether it is the document's first
        posting of the term. Only texts are dealt out, ``size`` bytes in all, to tasks that sort their postings in memory:
        as they lie, a file of one row group would be one task."""
        kind = T.StructType([
            T.StructField("term", T.StringType()), T.StructField("doc_id", self.docs.schema["doc_id"].dataType), T.StructField("field", T.StringType()),
            T.StructField("tf", T.LongType()), T.StructField("first", T.BooleanType()),
        ])
        cores = self.docs.sparkSession.sparkContext.defaultParallelism
        each = self.docs.repartition(max(cores, -(-size // TASK_BYTES)), F.col("doc_id")).select("doc_id", *(w.alias(f"__words_{i}") for i, w in enumerate(self.words)))
        return each.mapInArrow(_counting(list(self.fields), self.stem), kind)

    def lengths(self, postings: DataFrame) -> DataFrame:
        """(doc_id, field, length) from the postings; documents without words come from the keys."""
        none = self.docs.select("doc_id", F.explode(F.array(*map(F.lit, self.fields))).alias("field"), F.lit(0).cast("long").alias("tf"))
        return postings.select("doc_id", "field", "tf").unionByName(none).groupBy("doc_id", "field").agg(F.sum("tf").alias("length"))


def _counting(fields: list[str], stem: bool):
    """For ``mapInArrow``: postings of documents (doc_id, and an array of words for each field)."""

    def counted(batches):
        names = pa.array(fields)
        for batch in batches:
            each = [batch.column(i + 1) for i in range(len(fields))]
            words = pa.concat_arrays([e.flatten() for e in each]).dictionary_encode()
            terms, codes = words.dictionary, words.indices.to_numpy()
            if stem:
                stems = pa.array(map(english_stem, terms.to_pylist()), pa.string()).dictionary_encode()
                terms, codes = stems.dictionary, stems.indices.to_numpy()[codes]
            # A posting is one number: its term, then its document's place in the batch, then its field.
            keys = np.concatenate([pc.list_parent_indices(e).to_numpy().astype(np.int64) * len(fields) + i for i, e in enumerate(each)])
            keys += codes.astype(np.int64) * (batch.num_rows * len(fields))
            found, tf = np.unique(keys, return_counts=True)
            of_doc, field = np.divmod(found, len(fields))
            term, doc = np.divmod(of_doc, batch.num_rows)
            columns = [terms.take(pa.array(term)), batch.column(0).take(pa.array(doc)), names.take(pa.array(field)), pa.array(tf.astype(np.int64)), pa.array(np.diff(of_doc, prepend=-1) != 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "field", "tf", "first"])

    return counted


SHARES = 16  # shares of the documents by which a term's postings are dealt out


def _share():
    return F.pmod(F.hash("doc_id"), F.lit(SHARES))


def load(spark: SparkSession, path: str) -> Index:
    """The index that ``Index.write`` has written to a folder."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    one = read("numbers").first()
    return Index(read("postings").select("term", "doc_id", "field", "tf"), read("lengths"), read("terms"), read("doc-lengths"), (one["doc_count"], one["avg_length"]))


def build(
    docs: DataFrame, fields: Sequence[str], key: str = "doc_id", pattern: str = text.SIMPLE_WORDS, stop_words: Sequence[str] = (), stem: bool = False, separator: str = " "
) -> Index:
    """Index of the given fields. ``docs`` is read once for words and once for its keys.

    Words meet in one shuffle, by term and a share of the documents, in which they are counted and then stay.
    """
    plain = docs.select(F.col(key).alias("doc_id"), *fields)
    docs = spread(plain)
    words = text.tokens(docs, fields, "doc_id", pattern, stop_words, separator)
    if stem:
        words = text.stemmed(words).select("doc_id", "field", F.col("stem").alias("term"))
    dealt = words.withColumn("share", _share()).repartition("term", "share")
    postings = dealt.groupBy("term", "share", "doc_id", "field").agg(F.count("*").alias("tf")).drop("share")
    texts = [text.as_text(F.col(f), separator, docs.schema[f].dataType) for f in fields]
    each = [_words(t, pattern, stop_words) for t in texts]
    counted = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.size(w).cast("long").alias("length")) for f, w in zip(fields, each, strict=True)))).alias("f"))
    return Index(
        postings, counted.select("doc_id", "f.field", "f.length"), dealt=True, one_field=len(fields) == 1, words=words.select("term"),
        texts=Texts(plain, fields, texts, each, stem),
    )


def _words(value: Column, pattern: str, stop_words: Sequence[str]) -> Column:
    found = text.words(text.normal(value), pattern)
    return F.filter(found, lambda w: ~w.isin(list(stop_words))) if stop_words else found


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores: a small file of one row group is one task, however many cores there are. A table
    of at least as many partitions as cores stays as it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key, whole."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fields that ``new`` has a value for replace those of ``old``; all others stay."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    names = [*old.columns, *(c for c in new.columns if c not in old.columns)]

    def pick(c: str):
        sides = [F.col(f"{t}.{c}") for t, df in (("n", new), ("o", old)) if c in df.columns]
        return F.coalesce(*sides).alias(c)

    return both.select(*map(pick, names))


def repeated_keys(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys that a batch holds more than once, and null or empty ones; a valid batch has none."""
    bad = docs.groupBy(F.col(key).cast("string").alias(key)).count()
    return bad.where((F.col("count") > 1) | F.col(key).isNull() | (F.col(key) == ""))
