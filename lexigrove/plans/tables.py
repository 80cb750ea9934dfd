"""Sorting, pages, projection, facets, and the upkeep of collections and tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.functions import checks, predicates, text
from lexigrove.operators import facets, ranking
from lexigrove.operators.search import Collection, Request
from lexigrove.plans.common import bm25_sql, documents, table, text_index
from lexigrove.sources import documents as source
from lexigrove.sources import shared
from lexigrove.sources.catalog import Catalog, Settings
from lexigrove.sources.versions import Table


def _orders(spark, d) -> Collection:
    return Collection(table(spark, d, "orders"), key="o_orderkey")


def sort_multi(spark, d):
    request = Request(sort=["o_orderpriority", "o_totalprice:desc"], columns=["o_orderpriority", "o_totalprice"], limit=100)
    return _orders(spark, d).page(request).withColumnRenamed("doc_id", "o_orderkey").drop("score")


def page_offset(spark, d):
    return _orders(spark, d).page(Request(sort=[F.desc("o_totalprice")], offset=40, limit=20)).select("place", F.col("doc_id").alias("o_orderkey"))


def project(spark, d):
    parts = Collection(table(spark, d, "part"), key="p_partkey")
    return parts.retrieved(Request(filter="p_size > 5", columns=["p_brand"])).select(F.col("doc_id").alias("p_partkey"), "p_brand")


def hydrate(spark, d):
    docs = documents(spark, d)
    some = Collection(docs.where("lang <> 'fr'"))
    ranked = ranking.bm25(text_index(spark, d), ["with", "und"])
    return some.hydrated(ranked, ["lang", "source"]).withColumn("score", F.round("score", 6))


def facet_counts(spark, d):
    return facets.counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


def facet_topn(spark, d):
    return facets.top_counts(table(spark, d, "part"), ["p_brand", "p_type", "p_size"], 4)


def facet_stats(spark, d):
    out = facets.stats(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.select("field", *(F.round(c, 2).alias(c) for c in ("min", "max", "avg", "sum")), "n")


def facet_array(spark, d):
    rows = documents(spark, d).select("doc_id", F.array("lang", "source", F.expr("nullif(lang, 'fr')")).alias("tags"), F.expr("nullif(lang, 'en')").alias("other"))
    return facets.counts(rows, ["tags", "other"])


def facet_nested(spark, d):
    """Arrays in arrays are flattened, objects give no value, and a null counts as "null"."""
    nested = F.array(F.array("lang", "source"), F.array(F.expr("nullif(lang, 'en')")), F.expr("CASE WHEN doc_id % 7 = 0 THEN NULL ELSE array('x') END"))
    rows = documents(spark, d).select("doc_id", nested.alias("tags"), F.struct("lang").alias("object"), (F.col("doc_id") % 3 == 0).alias("flag"))
    return facets.counts(rows, ["tags", "object", "flag"])


def _catalog(spark, d) -> Catalog:
    kept = Catalog(spark, shared.new_path(spark, "catalog"))
    kept.create("docs", Settings(key="doc_id", searchable=("text",)))
    kept.add("docs", documents(spark, d))
    kept.create("talks", Settings(key="id", searchable=("text",)))
    kept.add("talks", table(spark, d, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn")))
    return kept


def collection_counts(spark, d):
    return _catalog(spark, d).field_counts()


def collection_totals(spark, d):
    return _catalog(spark, d).totals()


def index_swap(spark, d):
    kept = _catalog(spark, d)
    kept.swap("docs", "talks")
    return kept.stats()


def documents_by_key(spark, d):
    wanted = documents(spark, d).where("doc_id % 10 = 7").select("doc_id")
    return _catalog(spark, d).get("docs", wanted).select("doc_id", "lang", F.length("text").alias("length"))


def delete_many(spark, d):
    kept = _catalog(spark, d)
    kept.delete("docs", documents(spark, d).where("doc_id % 5 < 2").select("doc_id"))
    return kept.documents("docs").select("doc_id", "source")


def snapshot_list(spark, d):
    kept = Table(spark, shared.new_path(spark, "table"))
    for i, name in enumerate(("one", "two", "three")):
        kept.write(documents(spark, d).where(F.col("doc_id") % 3 >= i).select("doc_id", "lang"))
        kept.snapshot(name)
    kept.delete_snapshot("two")
    newest = kept.snapshots()
    return newest.select("name", F.col("rows").alias("n_rows"), F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("made_at"))).alias("place"))


def json_round_trip(spark, d):
    path = shared.new_path(spark, "json")
    source.export(documents(spark, d).select("doc_id", "lang", "text", "source"), path)
    return source.read_json(spark, path, "doc_id long, lang string, text string, source string").select("doc_id", "lang", "source", F.md5(F.col("text").cast("binary")).alias("text"))


def export_json_page(spark, d):
    page = source.listed(documents(spark, d).select("doc_id", "lang", "source"), offset=20, limit=30)
    return source.page_as_json(page, "doc_id")


def valid_values(spark, d):
    rows = table(spark, d, "conversations")
    first = F.regexp_extract("text", r"^(\S*)", 1)
    return rows.select(
        "conv_id", "turn", checks.collection_name(first).alias("ok_collection"), checks.field_name(first).alias("ok_field"),
        checks.key_text(F.col("text")).alias("ok_key"), checks.query_text(F.col("text"), 200).alias("ok_query"), checks.filter_text(F.col("text")).alias("ok_filter"),
    )


def durations_and_sizes(spark, d):
    rows = table(spark, d, "lineitem")
    unit = F.element_at(F.array(*map(F.lit, ("ms", "s", "m", "h", "d", "x", ""))), F.col("l_linenumber"))
    text_ = F.concat(F.col("l_quantity").cast("int").cast("string"), unit)
    size = F.pow(F.lit(10.0), F.col("l_linenumber") + 2).cast("long") * F.col("l_quantity").cast("int")
    return rows.select("l_orderkey", "l_linenumber", F.round(text.duration_seconds(text_), 6).alias("seconds"), text.readable_bytes(size).alias("size"))


def nested_text(spark, d):
    """Text of objects and arrays: fields by name, elements in order, nulls as empty texts between separators."""
    nested = F.struct(F.col("c_name").alias("b"), F.array(F.col("c_mktsegment"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END")).alias("a"), (F.col("c_custkey") % 2 == 0).alias("c"))
    rows = table(spark, d, "customer").withColumn("nested", nested)
    return rows.select("c_custkey", text.as_text(F.col("nested"), "|", rows.schema["nested"].dataType).alias("text"))


def filter_constants(spark, d):
    """All of nothing is true, any of nothing is false."""
    part = table(spark, d, "part")
    every = part.where(predicates.all_of()).agg(F.count("*").alias("all_rows"))
    return every.join(part.where(predicates.any_of()).agg(F.count("*").alias("no_rows")))


QUERIES = {
    "sort_multi": (
        sort_multi,
        """SELECT row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey)::INTEGER AS place, o_orderkey, o_orderpriority, o_totalprice
FROM orders QUALIFY place <= 100""",
    ),
    "page_offset": (page_offset, "SELECT (i - 40)::INTEGER AS place, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i BETWEEN 41 AND 60"),
    "project": (project, "SELECT p_partkey, p_brand FROM part WHERE p_size > 5"),
    "hydrate": (
        hydrate,
        f"WITH {bm25_sql(['with', 'und'])} SELECT doc_id, round(s.score, 6) AS score, lang, source FROM scored s JOIN documents USING (doc_id) WHERE lang <> 'fr'",
    ),
    "facet_counts": (
        facet_counts,
        """WITH every AS (SELECT 'l_returnflag' AS field, l_returnflag AS value FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem
UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR FROM lineitem) SELECT field, value, count(*) AS n FROM every GROUP BY ALL""",
    ),
    "facet_topn": (
        facet_topn,
        """WITH every AS (SELECT 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part)
SELECT field, value, count(*) AS n FROM every GROUP BY field, value QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 4""",
    ),
    "facet_stats": (
        facet_stats,
        """WITH every AS (SELECT 'l_quantity' AS field, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem)
SELECT field, round(min(v), 2) AS min, round(max(v), 2) AS max, round(avg(v), 2) AS avg, round(sum(v), 2) AS sum, count(v) AS n FROM every GROUP BY field""",
    ),
    "facet_array": (
        facet_array,
        """WITH every AS (SELECT 'tags' AS field, unnest([lang, source, coalesce(nullif(lang, 'fr'), 'null')]) AS value FROM documents
UNION ALL SELECT 'other', coalesce(nullif(lang, 'en'), 'null') FROM documents) SELECT field, value, count(*) AS n FROM every GROUP BY ALL""",
    ),
    "facet_nested": (
        facet_nested,
        """WITH every AS (SELECT 'tags' AS field, unnest([lang, source, nullif(lang, 'en')]) AS value FROM documents
UNION ALL SELECT 'tags', CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'x' END FROM documents UNION ALL SELECT 'flag', CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END FROM documents)
SELECT field, coalesce(value, 'null') AS value, count(*) AS n FROM every GROUP BY ALL""",
    ),
    "collection_counts": (
        collection_counts,
        "SELECT 'docs' AS name, f.field, CASE f.field WHEN 'doc_id' THEN count(doc_id) WHEN 'text' THEN count(text) WHEN 'lang' THEN count(lang) WHEN 'source' THEN count(source) "
        "WHEN 'n_chars' THEN count(n_chars) ELSE count(*) END AS n FROM documents, (VALUES ('doc_id'), ('text'), ('lang'), ('source'), ('n_chars'), (NULL)) f(field) GROUP BY f.field "
        "UNION ALL SELECT 'talks', f.field, CASE f.field WHEN 'conv_id' THEN count(conv_id) WHEN 'turn' THEN count(turn) WHEN 'role' THEN count(role) WHEN 'text' THEN count(text) ELSE count(*) END "
        "FROM conversations, (VALUES ('conv_id'), ('turn'), ('role'), ('text'), ('id'), (NULL)) f(field) GROUP BY f.field",
    ),
    "collection_totals": (collection_totals, "SELECT 2::BIGINT AS collections, (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations) AS documents"),
    "index_swap": (index_swap, "SELECT 'docs' AS name, count(*) AS documents FROM conversations UNION ALL SELECT 'talks', count(*) FROM documents"),
    "documents_by_key": (documents_by_key, "SELECT doc_id, lang, length(text)::INTEGER AS length FROM documents WHERE doc_id % 10 = 7"),
    "delete_many": (delete_many, "SELECT doc_id, source FROM documents WHERE doc_id % 5 >= 2"),
    "snapshot_list": (snapshot_list, "SELECT 'one' AS name, count(*) AS n_rows, 2 AS place FROM documents UNION ALL SELECT 'three', count(*), 1 FROM documents WHERE doc_id % 3 = 2"),
    "json_round_trip": (json_round_trip, "SELECT doc_id, lang, source, md5(text) AS text FROM documents"),
    "export_json_page": (
        export_json_page,
        """SELECT '[' || string_agg('{"doc_id":' || doc_id || ',"lang":' || to_json(lang) || ',"source":' || to_json(source) || '}', ',' ORDER BY doc_id) || ']' AS json
FROM (SELECT * FROM documents ORDER BY doc_id::VARCHAR LIMIT 30 OFFSET 20)""",
    ),
    "valid_values": (
        valid_values,
        r"""WITH f AS (SELECT *, regexp_extract(text, '^(\S*)', 1) AS one FROM conversations)
SELECT conv_id, turn, regexp_matches(one, '^[a-zA-Z0-9_-]{1,512}$') AND one NOT IN ('all', 'system', 'internal', 'metrics', 'health', 'version', 'stats') AS ok_collection,
       regexp_matches(one, '^[a-zA-Z0-9_.]{1,512}$') AS ok_field, strlen(text) BETWEEN 1 AND 512 AS ok_key, strlen(text) <= 200 AS ok_query, strlen(text) <= 2048 AS ok_filter FROM f""",
    ),
    "durations_and_sizes": (
        durations_and_sizes,
        """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity::INTEGER AS q, (pow(10.0, l_linenumber + 2))::BIGINT * l_quantity::INTEGER AS size FROM lineitem)
SELECT l_orderkey, l_linenumber, round(q * CASE l_linenumber WHEN 1 THEN 0.001 WHEN 2 THEN 1.0 WHEN 3 THEN 60.0 WHEN 4 THEN 3600.0 WHEN 5 THEN 86400.0 WHEN 7 THEN 1.0 END::DOUBLE, 6) AS seconds,
       CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.2f KB', size / 1024.0::DOUBLE) WHEN size < 1073741824 THEN printf('%.2f MB', size / 1048576.0::DOUBLE)
            WHEN size < 1099511627776 THEN printf('%.2f GB', size / 1073741824.0::DOUBLE) ELSE printf('%.2f TB', size / 1099511627776.0::DOUBLE) END AS size FROM t""",
    ),
    "nested_text": (
        nested_text,
        """SELECT c_custkey, c_mktsegment || '|' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END || '|' || c_name || '|' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS text FROM customer""",
    ),
    "filter_constants": (filter_constants, "SELECT count(*) AS all_rows, 0::BIGINT AS no_rows FROM part"),
}
