"""Ranked search over the documents: BM25, Boolean conditions, rules, pages and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrove.functions import text
from lexigrove.operators import boolean, fusion, index, neighbours, ranking, synonyms
from lexigrove.operators.boolean import Not, Phrase, Term
from lexigrove.operators.search import Collection, Request, Rule, multi_search
from lexigrove.plans.common import TOKENS, WORDS, bm25_sql, documents, table, text_index
from lexigrove.sources import shared
from lexigrove.sources.catalog import Catalog, Settings


def collection(spark, d) -> Collection:
    return Collection(documents(spark, d), text_index(spark, d))


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


def bm25_single(spark, d):
    return _rounded(ranking.bm25(text_index(spark, d), ["with"]))


def bm25_multi(spark, d):
    return _rounded(ranking.top(ranking.bm25(text_index(spark, d), ["the", "with", "nation"]), 20))


def bm25_filtered(spark, d):
    request = Request(terms=["with", "this"], filter=F.col("lang") == "en", columns=["lang", "source"], limit=50)
    return _rounded(collection(spark, d).page(request))


def bm25_field_weighted(spark, d):
    idx = index.build(documents(spark, d), ["text", "source"])
    return _rounded(ranking.bm25(idx, ["with", "src3"], weights={"source": 3.0}))


def _holding(spark, d, condition):
    docs = index.spread(documents(spark, d))
    return docs.where(condition.holds(text.words(F.lower("text"), text.SIMPLE_WORDS))).select("doc_id")


def bool_and(spark, d):
    return _holding(spark, d, Term("with") & Term("this") & Term("from"))


def bool_or(spark, d):
    return _holding(spark, d, Term("with") | Term("und"))


def bool_not(spark, d):
    return _holding(spark, d, Term("with") & ~(Term("this") | Term("from")))


def bool_from_index(spark, d):
    return boolean.matching(text_index(spark, d), (Term("with") | Term("und")) & Not(Term("from")))


def phrase(spark, d):
    return _holding(spark, d, Phrase("of", "the"))


def search_condition(spark, d):
    request = Request(condition=Term("with") & ~Term("from"), limit=40)
    return _rounded(collection(spark, d).page(request).select("place", "doc_id", "score"))


def match_all_page(spark, d):
    return collection(spark, d).page(Request(filter=F.col("lang") == "fr", offset=10, limit=15)).select("place", "doc_id", "score")


def total_hits(spark, d):
    return collection(spark, d).total(Request(terms=["with", "und"], filter=F.col("source") != "src3"))


def search_facets(spark, d):
    return collection(spark, d).facet_counts(Request(terms=["with"], facets=["lang", "source"]), most=5)


def distinct_best(spark, d):
    return _rounded(collection(spark, d).hits(Request(terms=["with", "this"], distinct="source")).select("source", "doc_id", "score"))


def autocomplete(spark, d):
    return collection(spark, d).autocomplete("th", 10)


def synonym_search(spark, d):
    """A query text, expanded by synonyms that the documents give: words that begin with the same three letters."""
    c = collection(spark, d)
    terms = c.index.totals().select("term").where(F.length("term") >= 4)
    groups = terms.select(F.substring("term", 1, 3).alias("group"), F.col("term").alias("word"))
    none = spark.createDataFrame([], "source string, word string")
    request = c.request("With the NATION", links=synonyms.links(groups, none))
    return _rounded(ranking.bm25(c.index, request.terms))


def search_text(spark, d):
    """A query text with stop words, in mixed case and with marks."""
    c = Collection(documents(spark, d), text_index(spark, d, stop_words=("the", "of")), stop_words=("the", "of"))
    return _rounded(c.page(c.request("The, WITH... of THIS!", limit=30)).select("place", "doc_id", "score"))


def search_typo(spark, d):
    """A query text with a typo in each word, each of which the dictionary corrects in all ways within one edit."""
    c = collection(spark, d)
    request = c.request("natiom nationen", typo="min")
    return _rounded(c.retrieved(request))


def ranking_rules(spark, d):
    """Hits by the number of query words that they hold, then by the rules after it, then by score."""
    docs = documents(spark, d)
    c = Collection(docs, index.build(docs, ["source", "text"]), fields=["source", "text"])
    request = c.request("with this src3 from", ranking=["words", "attribute", "sort", "score"], sort=["lang:desc"], limit=60)
    return _rounded(c.page(request).select("place", "doc_id", "score"))


def ranking_proximity(spark, d):
    """Hits by how near the first places of the query's words are."""
    c = collection(spark, d)
    request = c.request("with this", ranking=["words", "proximity", "exactness", "typo"], limit=60)
    return _rounded(c.page(request).select("place", "doc_id", "score"))


def index_load(spark, d):
    """An index that is written, and loaded from its folder."""
    path = shared.new_path(spark, "index")
    text_index(spark, d).write(path)
    return _rounded(ranking.bm25(index.load(spark, path), ["with", "und"]))


def collection_weights(spark, d):
    """Field weights and stop words of a collection's settings."""
    kept = Catalog(spark, shared.new_path(spark, "catalog"))
    kept.create("docs", Settings(key="doc_id", searchable=("text", "source"), weights={"source": 3.0}))
    kept.add("docs", documents(spark, d))
    c = kept.collection("docs")
    return _rounded(c.retrieved(c.request("With SRC3")))


def stored_rules(spark, d):
    """Rules that are kept with a collection: a filter, sort keys and hidden documents."""
    kept = Catalog(spark, shared.new_path(spark, "catalog"))
    kept.create("docs", Settings(key="doc_id", searchable=("text",)))
    kept.add("docs", documents(spark, d))
    kept.put_rules("docs", [Rule("with", hide=(4, 8), filter="lang <> 'de'", sort=("source:desc", "lang"), name="first"), Rule("other", filter="false"), Rule("this", hide=(5,), enabled=False)])
    c = kept.collection("docs")
    request = c.request("with THIS", limit=40, columns=["source"])
    assert request.summary().rules == ("first",)
    return _rounded(c.page(request))


def rules_pin_hide(spark, d):
    rules = [Rule("with", hide=(1, 2, 3), pin=((7, 2), (9, 4)))]
    return _rounded(collection(spark, d).page(Request(terms=["with"], rules=rules, limit=10)).select("place", "doc_id", "score"))


def search_highlight(spark, d):
    page = collection(spark, d).page(Request(terms=["with"], highlight=["text"], columns=["lang"], limit=30, crop=60))
    return page.select("place", "doc_id", "text_highlight", "lang")


def multi(spark, d):
    """Pages of three requests; the collection of the second is not there, and the fourth asks for a field that is not."""
    talk = table(spark, d, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    talks = Collection(talk, index.build(talk, ["text"], key="id"), key="id")
    docs = collection(spark, d)
    requests = [(docs, Request(terms=["with"], limit=5)), (None, Request()), (talks, Request(terms=["the"], limit=5)), (docs, Request(filter=F.col("nothing") == 1))]
    return _rounded(multi_search(spark, requests))


def _vector_ranks(spark, d):
    rows = table(spark, d, "embeddings")
    query = [1.0] * 8 + [0.0] * 56
    near = neighbours.nearest(rows, query, 50).select(F.col("vec_id").alias("doc_id"), "score")
    return fusion.ranked(near.withColumn("score", F.round("score", 6)), most=50)


def _keyword_ranks(spark, d):
    return fusion.ranked(_rounded(ranking.bm25(text_index(spark, d), ["with", "this"])), most=50)


def rank_all(spark, d):
    """The place of every hit, without a sort of all of them in one task."""
    return fusion.ranked(_rounded(ranking.bm25(text_index(spark, d), ["with", "this"])))


def rrf_fuse(spark, d):
    return fusion.fused(_keyword_ranks(spark, d), _vector_ranks(spark, d), 0.3).withColumn("score", F.round("score", 8))


def rrf_weighted(spark, d):
    return fusion.reciprocal_ranks(_keyword_ranks(spark, d), _vector_ranks(spark, d), (2.0, 1.0), k=10).withColumn("score", F.round("score", 8))


def hybrid_topk(spark, d):
    fused = fusion.fused(_keyword_ranks(spark, d), _vector_ranks(spark, d)).withColumn("score", F.round("score", 8))
    return fused.orderBy(F.desc("score"), "doc_id").limit(10)


def minmax_normalize(spark, d):
    return _rounded(fusion.normalised(ranking.bm25(text_index(spark, d), ["with"])))


def _holds(sql: str) -> str:
    return rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') AS words FROM documents)
SELECT doc_id FROM w WHERE {sql}"""


def _has(term: str) -> str:
    return f"list_contains(words, '{term}')"


_VECTOR = "[" + ", ".join(["1.0"] * 8 + ["0.0"] * 56) + "]::DOUBLE[]"
_LISTS = rf"""{bm25_sql(["with", "this"])},
keyword AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 50),
vector AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}), 6) DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 50)"""


def _rrf(first: float, second: float, k: float) -> str:
    return f"""WITH {_LISTS} SELECT doc_id, round(sum(s), 8) AS score FROM (
  SELECT doc_id, {first!r}::DOUBLE / ({k!r} + rank) AS s FROM keyword UNION ALL SELECT doc_id, {second!r}::DOUBLE / ({k!r} + rank) FROM vector) GROUP BY doc_id"""


_WEIGHTED = r"""WITH every AS (
  SELECT doc_id, 'text' AS field, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS term FROM documents UNION ALL
  SELECT doc_id, 'source', unnest(regexp_extract_all(lower(source), '[\p{L}\p{M}\p{N}]+')) FROM documents),
lengths AS (SELECT doc_id, count(*) AS length FROM every GROUP BY doc_id), stats AS (SELECT count(*) AS n, avg(length) AS average FROM lengths),
hits AS (SELECT term, doc_id, sum(CASE field WHEN 'source' THEN 3.0 ELSE 1.0 END)::DOUBLE AS tf FROM every WHERE term IN ('with', 'src3') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) AS score
FROM hits JOIN df USING (term) JOIN lengths USING (doc_id) CROSS JOIN stats GROUP BY doc_id"""

QUERIES = {
    "bm25_single": (bm25_single, f"WITH {bm25_sql(['with'])} SELECT doc_id, round(score, 6) AS score FROM scored"),
    "bm25_multi": (bm25_multi, f"WITH {bm25_sql(['the', 'with', 'nation'])} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 20"),
    "bm25_filtered": (
        bm25_filtered,
        f"""WITH {bm25_sql(["with", "this"])} SELECT row_number() OVER (ORDER BY s.score DESC, doc_id)::INTEGER AS place, doc_id, round(s.score, 6) AS score, lang, source
FROM scored s JOIN documents USING (doc_id) WHERE lang = 'en' QUALIFY place <= 50""",
    ),
    "bm25_field_weighted": (bm25_field_weighted, _WEIGHTED),
    "bool_and": (bool_and, _holds(f"{_has('with')} AND {_has('this')} AND {_has('from')}")),
    "bool_or": (bool_or, _holds(f"{_has('with')} OR {_has('und')}")),
    "bool_not": (bool_not, _holds(f"{_has('with')} AND NOT ({_has('this')} OR {_has('from')})")),
    "bool_from_index": (bool_from_index, _holds(f"({_has('with')} OR {_has('und')}) AND NOT {_has('from')}")),
    "phrase": (phrase, _holds("len(list_filter(range(1, len(words)), lambda i: words[i] = 'of' AND words[i + 1] = 'the')) > 0")),
    "search_condition": (
        search_condition,
        rf"""WITH {bm25_sql(["with"])}, w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') AS words FROM documents)
SELECT row_number() OVER (ORDER BY s.score DESC, doc_id)::INTEGER AS place, doc_id, round(s.score, 6) AS score
FROM scored s JOIN w USING (doc_id) WHERE {_has("with")} AND NOT {_has("from")} QUALIFY place <= 40""",
    ),
    "match_all_page": (
        match_all_page,
        "SELECT row_number() OVER (ORDER BY doc_id)::INTEGER AS place, doc_id, 0.0::DOUBLE AS score FROM (SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 15 OFFSET 10)",
    ),
    "total_hits": (total_hits, f"WITH {TOKENS} SELECT count(DISTINCT doc_id) AS total_hits FROM tokens JOIN documents USING (doc_id) WHERE term IN ('with', 'und') AND source <> 'src3'"),
    "search_facets": (
        search_facets,
        f"""WITH {TOKENS}, hits AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM tokens WHERE term = 'with')),
every AS (SELECT 'lang' AS field, lang AS value FROM hits UNION ALL SELECT 'source', source FROM hits)
SELECT field, value, count(*) AS n FROM every GROUP BY field, value QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 5""",
    ),
    "distinct_best": (
        distinct_best,
        f"""WITH {bm25_sql(["with", "this"])} SELECT source, doc_id, round(s.score, 6) AS score FROM scored s JOIN documents USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY s.score DESC, doc_id) = 1""",
    ),
    "autocomplete": (autocomplete, f"WITH {TOKENS} SELECT term, count(*) AS total_tf FROM tokens WHERE starts_with(term, 'th') GROUP BY term ORDER BY term LIMIT 10"),
    "synonym_search": (
        synonym_search,
        f"""WITH {bm25_sql("SELECT term FROM tokens WHERE term IN ('with', 'the', 'nation') OR (length(term) >= 4 AND substr(term, 1, 3) IN (SELECT substr(term, 1, 3) FROM tokens WHERE term IN ('with', 'nation')))")}
SELECT doc_id, round(score, 6) AS score FROM scored""",
    ),
    "search_text": (
        search_text,
        rf"""WITH tokens AS (SELECT * FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) WHERE term NOT IN ('the', 'of')),
lengths AS (SELECT d.doc_id, count(term) AS length FROM documents d LEFT JOIN tokens USING (doc_id) GROUP BY d.doc_id), stats AS (SELECT count(*) AS n, avg(length) AS average FROM lengths),
hits AS (SELECT term, doc_id, count(*) AS tf FROM tokens WHERE term IN ('with', 'this') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / greatest(average, 1)))) AS score
  FROM hits JOIN df USING (term) JOIN lengths USING (doc_id) CROSS JOIN stats GROUP BY doc_id)
SELECT row_number() OVER (ORDER BY s.score DESC, doc_id)::INTEGER AS place, doc_id, round(s.score, 6) AS score FROM scored s QUALIFY place <= 30""",
    ),
    "search_typo": (
        search_typo,
        f"""WITH {bm25_sql("SELECT term FROM (SELECT q, term, row_number() OVER (PARTITION BY q ORDER BY damerau_levenshtein(q, term), n DESC, term) AS i FROM (SELECT term, count(*) AS n FROM tokens GROUP BY term), (VALUES ('natiom'), ('nationen')) v(q) WHERE abs(length(term) - length(q)) <= 1 AND damerau_levenshtein(q, term) <= 1) WHERE i <= 8")}
SELECT doc_id, round(score, 6) AS score FROM scored""",
    ),
    "ranking_rules": (
        ranking_rules,
        r"""WITH every AS (
  SELECT doc_id, 1 AS place, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS term FROM documents UNION ALL
  SELECT doc_id, 0, unnest(regexp_extract_all(lower(source), '[\p{L}\p{M}\p{N}]+')) FROM documents),
lengths AS (SELECT doc_id, count(*) AS length FROM every GROUP BY doc_id), stats AS (SELECT count(*) AS n, avg(length) AS average FROM lengths),
hits AS (SELECT term, doc_id, count(*) AS tf, min(place) AS place FROM every WHERE term IN ('with', 'this', 'src3', 'from') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / greatest(average, 1)))) AS score, count(*) AS words, min(place) AS attribute
  FROM hits JOIN df USING (term) JOIN lengths USING (doc_id) CROSS JOIN stats GROUP BY doc_id)
SELECT row_number() OVER (ORDER BY words DESC, attribute, lang DESC, s.score DESC, doc_id)::INTEGER AS place, doc_id, round(s.score, 6) AS score FROM scored s JOIN documents USING (doc_id) QUALIFY place <= 60""",
    ),
    "ranking_proximity": (
        ranking_proximity,
        rf"""WITH {bm25_sql(["with", "this"])}, w AS (SELECT doc_id, {WORDS} AS words FROM documents),
p AS (SELECT doc_id, score, (SELECT count(*) FROM hits h WHERE h.doc_id = s.doc_id) AS n_words,
      CASE WHEN list_contains(words, 'with') AND list_contains(words, 'this') THEN least(8, abs(list_position(words, 'with') - list_position(words, 'this'))) ELSE 8 END AS far
      FROM scored s JOIN w USING (doc_id))
SELECT row_number() OVER (ORDER BY n_words DESC, far, score DESC, doc_id)::INTEGER AS place, doc_id, round(p.score, 6) AS score FROM p QUALIFY place <= 60""",
    ),
    "index_load": (index_load, f"WITH {bm25_sql(['with', 'und'])} SELECT doc_id, round(score, 6) AS score FROM scored"),
    "collection_weights": (collection_weights, _WEIGHTED),
    "stored_rules": (
        stored_rules,
        f"""WITH {bm25_sql(["with", "this"])} SELECT row_number() OVER (ORDER BY source DESC, lang, s.score DESC, doc_id)::INTEGER AS place, doc_id, round(s.score, 6) AS score, source
FROM scored s JOIN documents USING (doc_id) WHERE doc_id NOT IN (4, 8) AND lang <> 'de' QUALIFY place <= 40""",
    ),
    "rules_pin_hide": (
        rules_pin_hide,
        f"""WITH {bm25_sql(["with"])}, page AS (
  SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS i FROM scored WHERE doc_id NOT IN (1, 2, 3, 7, 9) QUALIFY i <= 10),
placed AS (
  SELECT CASE WHEN i >= 3 THEN i + 2 WHEN i >= 2 THEN i + 1 ELSE i END AS place, doc_id, score FROM page
  UNION ALL SELECT 2, doc_id, 0.0 FROM documents WHERE doc_id = 7 UNION ALL SELECT 4, doc_id, 0.0 FROM documents WHERE doc_id = 9)
SELECT row_number() OVER (ORDER BY place)::INTEGER AS place, doc_id, round(score, 6) AS score FROM placed""",
    ),
    "search_highlight": (
        search_highlight,
        rf"""WITH {bm25_sql(["with"])}, page AS (SELECT row_number() OVER (ORDER BY s.score DESC, doc_id)::INTEGER AS place, doc_id, lang, text FROM scored s JOIN documents USING (doc_id) QUALIFY place <= 30),
marked AS (SELECT *, regexp_replace(regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_])(with)($|[^\p{{L}}\p{{N}}_])', '\1<em>\2</em>\3', 'gi'),
  '(^|[^\p{{L}}\p{{N}}_>])(with)($|[^\p{{L}}\p{{N}}_<])', '\1<em>\2</em>\3', 'gi') AS m FROM page)
SELECT place, doc_id, lang, CASE WHEN length(m) > 60 THEN substr(m, 1, 60) || '…' ELSE m END AS text_highlight FROM marked""",
    ),
    "multi_search": (
        multi,
        rf"""WITH {bm25_sql(["with"])}, t2 AS (SELECT conv_id || '-' || turn AS doc_id, unnest({WORDS}) AS term FROM conversations),
l2 AS (SELECT conv_id || '-' || turn AS doc_id, len({WORDS}) AS length FROM conversations), s2 AS (SELECT count(*) AS n, avg(length) AS average FROM l2),
h2 AS (SELECT doc_id, count(*) AS tf FROM t2 WHERE term = 'the' GROUP BY doc_id), d2 AS (SELECT count(*) AS df FROM h2),
r2 AS (SELECT doc_id, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / greatest(average, 1))) AS score FROM h2 JOIN l2 USING (doc_id) CROSS JOIN s2 CROSS JOIN d2)
SELECT 0 AS query, place, doc_id, round(score, 6) AS score FROM (SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS place, doc_id::VARCHAR AS doc_id, score FROM scored) WHERE place <= 5
UNION ALL SELECT 2, place, doc_id, round(score, 6) FROM (SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS place, doc_id, score FROM r2) WHERE place <= 5""",
    ),
    "rank_all": (rank_all, f"WITH {bm25_sql(['with', 'this'])} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id)::INTEGER AS rank FROM scored"),
    "rrf_fuse": (rrf_fuse, _rrf(0.7, 0.3, 60.0)),
    "rrf_weighted": (rrf_weighted, _rrf(2 / 3, 1 / 3, 10.0)),
    "hybrid_topk": (hybrid_topk, _rrf(0.5, 0.5, 60.0) + " ORDER BY score DESC, doc_id LIMIT 10"),
    "minmax_normalize": (
        minmax_normalize,
        f"WITH {bm25_sql(['with'])} SELECT doc_id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS score FROM scored",
    ),
}
