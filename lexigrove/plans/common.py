"""What the catalogue's modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrove.operators import index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_index(spark: SparkSession, sf_dir: str, **options) -> index.Index:
    return index.build(documents(spark, sf_dir), ["text"], **options)


#: SQL: the words of a column ``text``, by simple boundaries and by Unicode's. For the latter, marks that join two
#: letters or two digits are first turned into a letter, twice, as neighbouring joints share a character.
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')"
_JOINED = "text"
for _ in range(2):
    _JOINED = rf"regexp_replace(regexp_replace({_JOINED}, '([\p{{L}}\p{{M}}])[.:·''’](\p{{L}})', '\1ˑ\2', 'g'), '(\p{{Nd}})[.,;''’](\p{{Nd}})', '\1ˑ\2', 'g')"
UNICODE_WORDS = rf"list_filter(regexp_extract_all({_JOINED}, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))"

def letters_sql(word: str) -> str:
    """SQL: a word with each letter beyond ASCII as one byte, as the engine's edit distances count bytes."""
    return f"translate({word}, 'äöüßáàâéèêëíìîïóòôúùûñçõãøåæœ', '!#$%&()*+,-./:;<=>?@[]^_`{{|}}~')"


#: SQL: words of all documents, one row each.
TOKENS = r"""tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS term FROM documents)"""

#: SQL: postings, lengths and statistics of the index of ``documents.text``.
INDEX = TOKENS + r""",
postings AS (SELECT term, doc_id, count(*) AS tf FROM tokens GROUP BY ALL),
lengths AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS length FROM documents),
stats AS (SELECT count(*) AS n, avg(length) AS average FROM lengths)"""


def bm25_sql(terms: list[str] | str, k1: float = 1.2, b: float = 0.75) -> str:
    """SQL: CTEs up to ``scored`` (doc_id, score), for listed terms or those of a query."""
    listed = terms if isinstance(terms, str) else ", ".join(f"'{t}'" for t in terms)
    return rf"""{INDEX},
hits AS (SELECT * FROM postings WHERE term IN ({listed})),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (
  SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1)
         / (tf + {k1} * (1 - {b} + {b} * length / greatest(average, 1)))) AS score
  FROM hits JOIN df USING (term) JOIN lengths USING (doc_id) CROSS JOIN stats GROUP BY doc_id)"""
