"""Synonyms of query terms as tables.

Equivalent words are stars around one word that stands for their group, one-way replacements are links;
expanding terms is a join with the links, repeated until nothing new comes or the depth is reached. Tables of
synonyms can be of any size: a group of n words is n links and never n times n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.sources import shared

DEPTH = 4
MOST_ROUNDS = 60


def groups(equivalent: DataFrame) -> DataFrame:
    """(word, name): for each word of ``equivalent`` (group, word) the least word of its group, where groups that
    share a word are one. A group without words is refused."""
    members = shared.stored(equivalent.select("group", "word").distinct(), "synonyms")  # once, as it may follow from all texts
    if not members.where(F.col("word").isNull() | (F.trim("word") == "")).isEmpty():
        raise ValueError("a group of synonyms holds no word, or an empty one")
    names = members.groupBy("word").agg(F.min("word").alias("name"))
    for _ in range(MOST_ROUNDS):  # the least name goes around in each group until none gets smaller
        of_group = members.join(names, "word").groupBy("group").agg(F.min("name").alias("low"))
        least = members.join(of_group, "group").groupBy("word").agg(F.min("low").alias("name"))
        least = shared.stored(least, "synonym-names")
        moved = least.join(names.withColumnRenamed("name", "old"), "word").where("name <> old")
        if moved.isEmpty():
            return least
        names = least
    raise RuntimeError(f"groups of synonyms did not settle in {MOST_ROUNDS} rounds")


def links(equivalent: DataFrame, one_way: DataFrame) -> DataFrame:
    """(term, other, kind). ``equivalent``: group, word. ``one_way``: source, word.

    Kind "name" leads from a word to the name of its group, "word" from the name to the group's words, "way" along
    one-way replacements: a source leads to its words; a word leads back to its source unless it is itself a source.
    """
    named = groups(equivalent)
    up = named.select(F.col("word").alias("term"), F.col("name").alias("other"), F.lit("name").alias("kind"))
    down = named.select(F.col("name").alias("term"), F.col("word").alias("other"), F.lit("word").alias("kind"))
    forth = one_way.select(F.col("source").alias("term"), F.col("word").alias("other"), F.lit("way").alias("kind"))
    sources = one_way.select(F.col("source").alias("term")).distinct()
    back = one_way.select(F.col("word").alias("term"), F.col("source").alias("other"), F.lit("way").alias("kind")).join(sources, "term", "left_anti")
    return up.unionByName(down).unionByName(forth).unionByName(back).distinct()


def reached(terms: DataFrame, synonyms: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query_id, kind, term): what the terms of each query lead to within ``depth`` steps, with whole groups by name.

    Kind "group" stands for all words of the group of that name (the links of kind "word" have them), kind "word" for
    one word outside the query's groups. So n queries that reach a group of m words are n rows and never n times m.
    """
    synonyms = shared.stored(synonyms.select("term", "other", "kind"), "synonym-links")
    name, way = (synonyms.where(F.col("kind") == kind).select("term", F.col("other").alias(to)) for kind, to in (("name", "name"), ("way", "other")))
    # Where the words of a group lead to outside of it.
    of_other = name.select(F.col("term").alias("other"), F.col("name").alias("other_name"))
    out_of = way.join(name, "term").join(of_other, "other", "left").where("other_name is null or other_name <> name")
    out_of = shared.stored(out_of.select(F.col("name").alias("term"), "other").distinct(), "synonym-ways")
    found = terms.select("query_id", F.lit("word").alias("kind"), "term").distinct()
    for _ in range(depth):
        found = shared.stored(found, "synonyms-reached")
        words, groups = (found.where(F.col("kind") == kind) for kind in ("word", "group"))
        groups_ = groups.unionByName(words.join(name, "term").select("query_id", F.lit("group").alias("kind"), F.col("name").alias("term"))).distinct()
        further = words.join(way, "term").unionByName(groups.join(out_of, "term")).select("query_id", "kind", F.col("other").alias("term"))
        words_ = words.unionByName(further.withColumn("kind", F.lit("word"))).distinct()
        # Words of a group that the query has reached add nothing to it.
        inside = groups_.select("query_id", F.col("term").alias("name"))
        words_ = words_.join(name, "term", "left").join(inside, ["query_id", "name"], "left_anti")
        found = groups_.unionByName(words_.select("query_id", "kind", "term"))
    return shared.stored(found, "synonyms-reached")


def expanded(terms: DataFrame, synonyms: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query_id, term): the terms of each query and all that they lead to within ``depth`` steps; a step goes to
    all words of a term's group, and along the one-way links. It is as long as all groups for all that reach them."""
    found = reached(terms, synonyms, depth)
    down = synonyms.where(F.col("kind") == "word").select("term", "other")
    words = found.where(F.col("kind") == "group").join(down, "term").select("query_id", F.col("other").alias("term"))
    return found.where(F.col("kind") == "word").select("query_id", "term").unionByName(words).distinct()
