"""A search request as one plan: rank, filter, rules, sort, page, facets and highlights.

The filter is applied to the documents before they meet the ranking, sorting is over all hits and not
over a page, facets count all hits, and highlighting runs on the page alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.functions import text, typos
from lexigrove.operators import facets, ranking, synonyms
from lexigrove.operators.boolean import Condition
from lexigrove.operators.index import Index

DEFAULT_LIMIT, MOST = 20, 1000
FAR = 8  # the distance of query words that counts, at most
#: Names of ranking rules; each is one key of the order of hits.
RANKING_RULES = ("words", "typo", "proximity", "attribute", "sort", "exactness", "score")


def order_of(name: str | Column) -> Column:
    """A sort key: a Column, or ``field``, ``field:asc`` or ``field:desc``."""
    if isinstance(name, Column):
        return name
    column, _, way = name.rpartition(":") if name.endswith((":asc", ":desc")) else (name, "", "asc")
    return F.desc(column) if way == "desc" else F.asc(column)


def condition_of(condition: str | Column) -> Column:
    return F.expr(condition) if isinstance(condition, str) else condition


@dataclass(frozen=True)
class Rule:
    """Applies to queries that contain ``query``, in any case: hides documents, pins some to places, and adds a
    filter and sort keys. Filters and keys are Columns, or SQL and ``field:desc``, which can be stored."""

    query: str
    hide: tuple = ()
    pin: tuple[tuple[object, int], ...] = ()  # (doc_id, place from 1)
    filter: Column | str | None = None
    sort: tuple[Column | str, ...] = ()
    enabled: bool = True
    name: str = ""

    def applies(self, q: str) -> bool:
        return self.enabled and self.query.lower() in q.lower()


@dataclass(frozen=True)
class RuleSummary:
    """What the rules of a request did: names (or queries) of those that applied, and what they brought in."""

    rules: tuple[str, ...] = ()
    pinned: tuple = ()
    hidden: tuple = ()
    filters: int = 0
    sorts: int = 0


@dataclass(frozen=True)
class Request:
    """``terms`` are analysed query terms; without them, and without a condition, all documents match.

    ``Collection.request`` makes one from a query text: ``query`` is that text, ``words`` its words, and ``meant``
    tells which word a term stands for, with how many typos, and whether it is the word itself. ``ranking`` names
    RANKING_RULES in the order in which they decide; without it, hits go by rules' keys, ``sort`` and score.
    """

    terms: Sequence[str] = ()
    condition: Condition | None = None
    filter: Column | str | None = None
    sort: Sequence[Column | str] = ()
    offset: int = 0
    limit: int = DEFAULT_LIMIT
    columns: Sequence[str] = ()
    distinct: str | None = None
    highlight: Sequence[str] = ()
    crop: int = 200
    facets: Sequence[str] = ()
    weights: Mapping[str, float] = field(default_factory=dict)
    rules: Sequence[Rule] = ()
    query: str = ""
    words: Sequence[str] = ()
    meant: Sequence[tuple[str, str, int, bool]] = ()  # (term, word, typos, exact)
    ranking: Sequence[str] = ()

    def __post_init__(self) -> None:
        if self.offset < 0 or self.limit < 1:
            raise ValueError(f"offset {self.offset} and limit {self.limit}: at least 0 and 1")
        if unknown := [r for r in self.ranking if r not in RANKING_RULES]:
            raise ValueError(f"unknown ranking rules {unknown}")

    def applied(self) -> list[Rule]:
        q = self.query or " ".join(self.terms)
        return [r for r in self.rules if r.applies(q)]

    def summary(self) -> RuleSummary:
        rules = self.applied()
        return RuleSummary(
            tuple(r.name or r.query for r in rules), tuple(p for r in rules for p in r.pin), tuple(d for r in rules for d in r.hide),
            sum(r.filter is not None for r in rules), sum(len(r.sort) for r in rules),
        )


@dataclass(frozen=True)
class Collection:
    """Documents with their key and an index of their text fields, and how texts are analysed. An index is needed
    for requests with terms only."""

    docs: DataFrame
    index: Index | None = None
    key: str = "doc_id"
    text_field: str = "text"
    fields: Sequence[str] = ()
    pattern: str = text.SIMPLE_WORDS
    stop_words: Sequence[str] = ()
    stem: bool = False
    weights: Mapping[str, float] = field(default_factory=dict)
    rules: Sequence[Rule] = ()

    def terms(self, query: str) -> list[str]:
        """The words of a query text, analysed like the documents', in their order."""
        spark = self.docs.sparkSession
        asked = spark.createDataFrame([(0, query)], "doc_id int, text string")
        found = text.tokens(asked, ["text"], pattern=self.pattern, stop_words=self.stop_words)
        found = text.stemmed(found).withColumn("term", F.col("stem")) if self.stem else found
        return [r["term"] for r in found.orderBy("pos").collect()]  # the words of one query

    def request(self, query: str, typo: str = "disabled", links: DataFrame | None = None, **options) -> Request:
        """The request of a query text: its words, dictionary words within the typos that the level (disabled, min or
        default) allows, eight at most for each, and what they lead to by ``links`` of synonyms."""
        spark = self.docs.sparkSession
        words = self.terms(query)
        meant = {(w, w): (0, True) for w in words}
        if words and typo != "disabled":
            asked = spark.createDataFrame([(w,) for w in sorted(set(words))], "query string")
            for r in typos.fuzzy(asked, self.index.totals(), typo).collect():  # eight rows for each word
                meant.setdefault((r["term"], r["query"]), (r["distance"], r["distance"] == 0))
        if words and links is not None:
            asked = spark.createDataFrame([(w, w) for w in sorted(set(words))], "query_id string, term string")
            for r in synonyms.expanded(asked, links).collect():  # the synonyms of a query's words
                meant.setdefault((r["term"], r["query_id"]), (0, False))
        rows = sorted((term, word, n, same) for (term, word), (n, same) in meant.items())
        options.setdefault("weights", self.weights)
        options.setdefault("rules", self.rules)
        return Request(terms=sorted({r[0] for r in rows}), query=query, words=words, meant=rows, **options)

    def _documents(self) -> DataFrame:
        return self.docs.withColumnRenamed(self.key, "doc_id") if self.key != "doc_id" else self.docs

    def _words(self) -> Column:
        """Array of the words of all text fields; a null stands between fields, so that no phrase spans two."""
        parts = []
        for f in self.fields or [self.text_field]:
            found = text.words(text.normal(text.as_text(F.col(f), kind=self.docs.schema[f].dataType)), self.pattern)
            parts += [found, F.array(F.lit(None).cast("string"))]
        return F.concat(*parts[:-1])

    def hits(self, request: Request) -> DataFrame:
        """All documents that match, with score; no order and no page yet."""
        docs = self._documents()
        applied = request.applied()
        for condition in [request.filter, *(r.filter for r in applied)]:
            docs = docs if condition is None else docs.where(condition_of(condition))
        if hidden := sorted({d for r in applied for d in r.hide}, key=str):
            docs = docs.where(~F.col("doc_id").isin(hidden))
        terms = list(request.terms)
        if request.condition is not None:
            docs = docs.where(F.coalesce(request.condition.holds(self._words()), F.lit(False)))
            terms = terms or request.condition.terms()
        if not terms:
            return docs.withColumn("score", F.lit(0.0))
        how = "inner" if request.condition is None else "left"
        scored = docs.join(ranking.bm25(self.index, terms, weights=request.weights or None), "doc_id", how)
        hits = scored.withColumn("score", F.coalesce("score", F.lit(0.0)))
        if request.distinct:
            best = W.partitionBy(request.distinct).orderBy(F.desc("score"), "doc_id")
            hits = hits.withColumn("__place", F.row_number().over(best)).where("__place = 1").drop("__place")
        return hits

    def _ruled(self, hits: DataFrame, request: Request) -> DataFrame:
        """``hits`` with a column for each ranking rule of the request that needs one."""
        if not set(request.ranking) & {"words", "typo", "attribute", "exactness", "proximity"} or not request.terms:
            return hits
        spark, fields = self.docs.sparkSession, list(self.fields or [self.text_field])
        rows = [tuple(r) for r in request.meant] or [(t, t, 0, True) for t in request.terms]
        meant = F.broadcast(spark.createDataFrame(rows, "term string, word string, typos int, exact boolean"))  # a request's terms
        places = F.create_map(*(x for i, f in enumerate(fields) for x in (F.lit(f), F.lit(i))))
        found = self.index.postings.where(F.col("term").isin(sorted({r[0] for r in rows}))).join(meant, "term")
        by_word = found.groupBy("doc_id", "word").agg(F.min("typos").alias("typos"), F.max("exact").alias("exact"), F.min(places[F.col("field")]).alias("place"))
        by_doc = by_word.groupBy("doc_id").agg(F.count("*").alias("__words"), F.sum("typos").alias("__typos"), F.sum(F.col("exact").cast("int")).alias("__exact"), F.min("place").alias("__attribute"))
        out = hits.join(by_doc, "doc_id", "left").fillna({"__words": 0, "__typos": 0, "__exact": 0})
        if "proximity" in request.ranking:
            out = out.withColumn("__all_words", self._words())
            total = F.lit(0)
            for a, b in zip(request.words or request.terms, (request.words or request.terms)[1:], strict=False):
                x, y = (F.array_position("__all_words", F.lit(w)) for w in (a, b))
                total = total + F.when((x > 0) & (y > 0), F.least(F.abs(x - y), F.lit(FAR))).otherwise(FAR)
            out = out.withColumn("__proximity", total).drop("__all_words")
        return out

    def _order(self, request: Request) -> list[Column]:
        ruled = [order_of(c) for r in request.applied() for c in r.sort]
        keys = {
            "words": [F.desc("__words")], "typo": [F.asc("__typos")], "proximity": [F.asc("__proximity")], "attribute": [F.asc_nulls_last("__attribute")],
            "exactness": [F.desc("__exact")], "sort": [order_of(c) for c in request.sort], "score": [F.desc("score")],
        }
        named = [k for name in request.ranking if request.terms or name in ("sort", "score") for k in keys[name]]
        rest = [] if "sort" in request.ranking else keys["sort"]
        return [*ruled, *named, *rest, F.desc("score"), F.col("doc_id").asc()]

    def page(self, request: Request) -> DataFrame:
        """The page of hits, in order, with ``place`` from 1 on. Pinned documents stand at their places."""
        order = self._order(request)
        hits = self._ruled(self.hits(request), request)
        limit = min(request.limit, MOST)
        pins = [p for r in request.applied() for p in r.pin]
        if pins:
            hits = hits.where(~F.col("doc_id").isin([d for d, _ in pins]))
        page = hits.orderBy(*order).offset(request.offset).limit(limit)  # MOST rows at most from here on
        page = page.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)).cast("double"))
        page = page.drop("__words", "__typos", "__exact", "__attribute", "__proximity")
        if pins:
            at = F.create_map(*(x for d, place in pins for x in (F.lit(d), F.lit(place - 0.5))))
            pinned = self._documents().where(F.col("doc_id").isin([d for d, _ in pins])).withColumn("score", F.lit(0.0)).withColumn("place", at[F.col("doc_id")])
            # A pin moves what stands at its place and after by one.
            for _, place in sorted(pins, key=lambda p: p[1]):
                page = page.withColumn("place", F.when(F.col("place") >= place, F.col("place") + 1).otherwise(F.col("place")))
            page = page.unionByName(pinned.withColumn("place", F.col("place") + 0.5))
        page = page.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("place", "doc_id")))
        for name in request.highlight:
            page = page.withColumn(f"{name}_highlight", text.cropped(text.highlighted(text.as_text(F.col(name), kind=self.docs.schema[name].dataType), list(request.terms)), request.crop))
        names = [*request.columns, *(f"{n}_highlight" for n in request.highlight)] if request.columns else [c for c in page.columns if c not in ("doc_id", "score", "place")]
        return page.select("place", "doc_id", "score", *[n for n in names if n not in ("place", "doc_id", "score")])

    def retrieved(self, request: Request) -> DataFrame:
        """(doc_id, score and the request's columns) of all hits, in no order: a request without its page."""
        return self.hits(request).select("doc_id", "score", *(c for c in request.columns if c not in ("doc_id", "score")))

    def hydrated(self, ranked: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
        """``ranked`` (doc_id and more) with the documents' columns; ids without a document are left out."""
        docs = self._documents()
        return ranked.join(docs.select("doc_id", *columns) if columns else docs, "doc_id")

    def total(self, request: Request) -> DataFrame:
        return self.hits(request).agg(F.count("*").alias("total_hits"))

    def facet_counts(self, request: Request, most: int = 100) -> DataFrame:
        return facets.top_counts(self.hits(request), request.facets, most)

    def autocomplete(self, prefix: str, limit: int = 10) -> DataFrame:
        """(term, total_tf) of the first terms with a prefix; the filter reaches the scan of postings."""
        starts = F.col("term").startswith(prefix)
        if self.index.dictionary is not None:
            found = self.index.dictionary.where(starts).select("term", "total_tf")
        else:
            found = self.index.postings.where(starts).groupBy("term").agg(F.sum("tf").alias("total_tf"))
        return found.orderBy("term").limit(min(limit, 100))


def multi_search(spark: SparkSession, requests: Sequence[tuple[Collection | None, Request]]) -> DataFrame:
    """(query, place, doc_id, score) of the pages of several requests, one after the other; rules play no part.

    A collection that is not there, and a request that its collection cannot answer, give no rows and do no harm.
    """
    out = spark.createDataFrame([], "query int, place int, doc_id string, score double")
    for i, (c, r) in enumerate(requests):
        try:
            page = None if c is None else c.page(replace(r, rules=()))
        except (AnalysisException, ValueError):
            page = None
        if page is not None:
            out = out.unionByName(page.select(F.lit(i).alias("query"), "place", F.col("doc_id").cast("string").alias("doc_id"), "score"))
    return out
