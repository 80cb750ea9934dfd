import random

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import typos
from lexigrove.operators import boolean, facets, fusion, index, ranking, synonyms
from lexigrove.plans import catalogue
from lexigrove.operators.boolean import Phrase, Term
from lexigrove.operators.search import Collection, Request, Rule, RuleSummary, multi_search


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "the quick brown fox", "x"), (2, "the lazy dog", "y"), (3, "the fox", "x"), (4, None, "y")], "doc_id long, text string, tag string")


@pytest.fixture(scope="module")
def idx(docs):
    return index.build(docs, ["text"]).stored()


def ids(df):
    return [r["doc_id"] for r in df.collect()]


def test_index(idx):
    terms = {r["term"]: (r["doc_freq"], r["total_tf"]) for r in idx.terms().collect()}
    assert terms["fox"] == (2, 2) and terms["the"] == (3, 3)
    stats = idx.stats().first()
    assert (stats["doc_count"], stats["total_length"]) == (4, 9)
    left = idx.without(idx.lengths.where("doc_id = 2").select("doc_id"))
    assert "dog" not in {r["term"] for r in left.terms().collect()}


def test_empty_index(spark):
    none = index.build(spark.createDataFrame([], "doc_id long, text string"), ["text"])
    assert none.stats().first()["avg_length"] == 0
    assert ranking.bm25(none, ["x"]).count() == 0


def test_stemmed_index(docs):
    assert {"quick", "lazi"} <= {r["term"] for r in index.build(docs, ["text"], stem=True).terms().collect()}


def test_bm25_prefers_the_shorter(idx):
    assert ids(ranking.top(ranking.bm25(idx, ["fox"]))) == [3, 1]
    assert ids(ranking.top(ranking.bm25(idx, ["fox", "fox"]))) == [3, 1]


def test_top_is_no_full_sort(idx):
    plan = ranking.top(ranking.bm25(idx, ["fox"]))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan or "GlobalLimit" in plan


def test_conditions(docs, idx):
    words = F.split(F.coalesce("text", F.lit("")), " ")
    at = lambda c: ids(docs.where(c.holds(words)).orderBy("doc_id"))
    assert at(Term("the") & ~Term("fox")) == [2]
    assert at(Term("dog") | Term("quick")) == [1, 2]
    assert at(Phrase("the", "fox")) == [3]
    assert at(~Term("the")) == [4]
    assert sorted(ids(boolean.matching(idx, ~Term("the")))) == [4]
    assert (Term("b") & ~Term("c") | Term("a")).terms() == ["a", "b"]


def test_pages_rules_and_facets(docs, idx):
    c = Collection(docs, idx)
    assert ids(c.page(Request(terms=["fox"]))) == [3, 1]
    assert ids(c.page(Request(limit=2, offset=1))) == [2, 3]
    pinned = c.page(Request(terms=["fox"], rules=[Rule("FOX", hide=(1,), pin=((2, 1),))]))
    assert ids(pinned.orderBy("place")) == [2, 3]
    assert ids(c.page(Request(terms=["fox"], rules=[Rule("dog", hide=(1,))])).orderBy("place")) == [3, 1]
    assert ids(c.page(Request(terms=["the"], sort=[F.desc("tag")], filter=F.col("doc_id") < 3))) == [2, 1]
    counts = {r["value"]: r["n"] for r in c.facet_counts(Request(terms=["the"], facets=["tag"])).collect()}
    assert counts == {"x": 2, "y": 1}
    assert c.page(Request(terms=["fox"], highlight=["text"])).orderBy("place").first()["text_highlight"] == "the <em>fox</em>"
    assert sorted(r["tag"] for r in c.hits(Request(terms=["the"], distinct="tag")).collect()) == ["x", "y"]
    spark = docs.sparkSession
    several = [(c, Request(terms=["fox"])), (None, Request()), (c, Request(filter="nothing = 1")), (c, Request(terms=["dog"]))]
    assert sorted((r["query"], r["doc_id"]) for r in multi_search(spark, several).collect()) == [(0, "1"), (0, "3"), (3, "2")]
    assert multi_search(spark, []).count() == 0
    assert [r["term"] for r in c.autocomplete("l").collect()] == ["lazy"]


def test_upsert_merge_and_keys(spark):
    old = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "doc_id int, x string, y string")
    new = spark.createDataFrame([(2, None, "e"), (3, "f", None)], "doc_id int, x string, y string")
    assert sorted(map(tuple, index.upsert(old, new).collect()), key=str) == [(1, "a", "b"), (2, None, "e"), (3, "f", None)]
    assert sorted(map(tuple, index.merge(old, new).collect()), key=str) == [(1, "a", "b"), (2, "c", "e"), (3, "f", None)]
    twice = spark.createDataFrame([("a",), ("a",), ("",), (None,), ("b",)], "doc_id string")
    assert index.repeated_keys(twice).count() == 3


def test_facets(spark):
    df = spark.createDataFrame([("books", 10.0, ["a", "b"]), ("books", 20.0, ["a", None]), ("movies", None, None)], "c string, p double, t array<string>")
    assert {(r["value"], r["n"]) for r in facets.counts(df, ["t"]).collect()} == {("a", 2), ("b", 1), ("null", 2)}
    assert facets.top_counts(df, ["c"], 0).collect()[0]["value"] == "books"
    assert tuple(facets.stats(df, ["p"]).first()) == ("p", 10.0, 20.0, 15.0, 30.0, 2)


def test_fusion(spark):
    lists = lambda *xs: spark.createDataFrame([(x, i + 1) for i, x in enumerate(xs)], "doc_id string, rank int")
    first = lambda df: df.orderBy(F.desc("score"), "doc_id").first()["doc_id"]
    assert first(fusion.fused(lists("a", "b"), lists("c", "d"), 0)) == "a"
    assert first(fusion.fused(lists("a"), lists("c", "d"), 1)) == "c"
    assert first(fusion.fused(lists("a", "b"), lists("b", "c"), 0.5)) == "b"
    assert fusion.reciprocal_ranks(lists("a"), lists("b"), (0, 0)).count() == 0
    scored = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", 30.0)], "doc_id string, score double")
    assert sorted(r["score"] for r in fusion.normalised(scored).collect()) == [0, 0.5, 1]
    same = spark.createDataFrame([("a", 5.0), ("b", 5.0)], "doc_id string, score double")
    assert [r["score"] for r in fusion.normalised(same).collect()] == [5, 5]


def test_typos(spark):
    assert [typos.edits(a, b) for a, b in (("", ""), ("abc", "abc"), ("abc", "abd"), ("kitten", "sitting"), ("abcd", "acbd"), ("ca", "abc"))] == [0, 0, 1, 3, 1, 3]
    df = spark.createDataFrame([(3,), (5,), (8,), (10,)], "n int")
    assert [r[0] for r in df.select(typos.allowed(F.col("n"))).collect()] == [0, 1, 1, 2]
    terms = spark.createDataFrame([("quick", 5), ("quikc", 1), ("thick", 9), ("quack", 7)], "term string, total_tf long")
    found = typos.fuzzy(spark.createDataFrame([("quikc",)], "query string"), terms)
    assert [(r["term"], r["distance"]) for r in found.collect()] == [("quikc", 0), ("quick", 1)]


def test_fuzzy_is_all_pairs(spark):
    """Words that meet by what is left when characters are dropped are all words within the edits."""
    dice = random.Random(4)
    words = sorted({"".join(dice.choice("abé") for _ in range(dice.randint(1, 11))) for _ in range(250)} | {"abababababab", "bababababab"})
    terms = spark.createDataFrame([(w, len(w)) for w in words], "term string, total_tf long")
    asked = spark.createDataFrame([(w,) for w in words[::4] + words[:3]], "query string")
    for level in ("default", "min", "disabled"):
        room = lambda w, level=level: 0 if level == "disabled" else int(len(w) >= 5) + int(level == "default" and len(w) >= 9)
        want = {(q, w, typos.edits(q, w)) for q in {*words[::4], *words[:3]} for w in words if typos.edits(q, w) <= room(q)}
        assert {tuple(r) for r in typos.fuzzy(asked, terms, level, None).collect()} == want
    cut = typos.fuzzy(asked, terms, "default", 3).groupBy("query").count().agg(F.max("count")).first()[0]
    assert cut == 3


def test_typo_candidates_of_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "One two three fourthword caf\u00e9"), (2, "one"), (3, None), (4, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["term"]: (r["n"], r["low"], r["high"], r["allowed"]) for r in catalogue.queries()["typo_candidates"](spark, str(tmp_path)).collect()}
    want = {}
    for w in ("one", "two", "three", "fourthword", "caf\u00e9"):
        made = [w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in typos.LETTERS if c != w[i]]
        want[w] = (len(made), min(made), max(made), 2 if len(w) >= 9 else int(len(w) >= 5))
    assert got == want


def test_synonyms(spark):
    groups = spark.createDataFrame([(1, "fast"), (1, "quick"), (2, "quick"), (2, "rapid")], "group int, word string")
    one_way = spark.createDataFrame([("phone", "mobile"), ("mobile", "cell")], "source string, word string")
    asked = spark.createDataFrame([(1, "fast"), (2, "phone"), (3, "cell")], "query_id int, term string")
    found = {}
    for r in synonyms.expanded(asked, synonyms.links(groups, one_way)).collect():
        found.setdefault(r["query_id"], set()).add(r["term"])
    assert found == {1: {"fast", "quick", "rapid"}, 2: {"phone", "mobile", "cell"}, 3: {"cell", "mobile"}}
    with pytest.raises(ValueError):
        synonyms.groups(groups.union(spark.createDataFrame([(3, "")], groups.schema)))
    chain = spark.createDataFrame([(i, f"w{j:02}") for i in range(20) for j in (i, i + 1)], "group int, word string")
    assert {r["name"] for r in synonyms.groups(chain).collect()} == {"w00"}  # groups that share words are one, however many steps apart


def test_request_from_a_text(spark, docs, idx):
    c = Collection(docs, idx)
    assert c.terms("The, QUICK fox's") == ["the", "quick", "fox", "s"]
    request = c.request("quikc foxes", typo="min")
    assert request.terms == ["foxes", "quick", "quikc"] and ("quick", "quikc", 1, False) in request.meant
    assert ids(c.page(request)) == [1]
    links = synonyms.links(spark.createDataFrame([(1, "cat"), (1, "dog")], "g int, word string").withColumnRenamed("g", "group"), spark.createDataFrame([], "source string, word string"))
    assert ids(c.page(c.request("cat", links=links))) == [2]
    stemmed = Collection(docs, index.build(docs, ["text"], stop_words=["the"], stem=True), stop_words=["the"], stem=True)
    assert stemmed.terms("the foxes lazily") == ["fox", "lazili"]
    assert sorted(ids(stemmed.page(stemmed.request("the foxes")))) == [1, 3]


def test_named_ranking_rules(spark):
    rows = [(1, "red", "blue blue blue"), (2, "x", "red and some words blue"), (3, "x", "red blue"), (4, "x", "reds blue")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string")
    c = Collection(docs, index.build(docs, ["title", "text"]), text_field="title", fields=["title", "text"])
    place = lambda *names, **more: ids(c.page(c.request("red blue", ranking=names, **more)))
    assert place("words", "proximity")[-1] == 4 and place("words", "proximity")[:2] != [2, 4]
    assert place("attribute")[0] == 1
    assert place("words", "sort", sort=["doc_id:desc"]) == [3, 2, 1, 4]
    assert place("words", "proximity")[0] in (1, 3)
    exact = c.request("reds blue", typo="min", ranking=["exactness"])
    assert ids(c.page(exact))[0] == 4
    with pytest.raises(ValueError):
        Request(ranking=["luck"])
    for bad in ({"limit": 0}, {"offset": -1}):
        with pytest.raises(ValueError):
            Request(**bad)


def test_conditions_see_all_fields(spark):
    docs = spark.createDataFrame([(1, "a b", "c d"), (2, "b c", None)], "doc_id long, x string, y string")
    c = Collection(docs, index.build(docs, ["x", "y"]), text_field="x", fields=["x", "y"])
    assert ids(c.page(Request(condition=Term("c")))) == [2, 1]
    assert ids(c.page(Request(condition=Phrase("b", "c")))) == [2]  # no phrase spans two fields
    assert ids(c.page(Request(condition=~Term("c")))) == []


def test_rule_summary():
    rules = [Rule("fox", hide=(1,), pin=((2, 1),), filter="true", sort=("a:desc", "b"), name="r"), Rule("dog"), Rule("f", enabled=False)]
    assert Request(terms=["fox"], rules=rules).summary() == RuleSummary(("r",), ((2, 1),), (1,), 1, 2)


def test_index_is_loaded_from_its_folder(spark, docs, tmp_path):
    written = index.build(docs, ["text"]).write(f"file://{tmp_path}/i")
    again = index.load(spark, f"file://{tmp_path}/i")
    assert again.numbers == written.numbers == (4, 9 / 4)
    assert sorted(map(tuple, ranking.bm25(again, ["fox"]).collect())) == sorted(map(tuple, ranking.bm25(written, ["fox"]).collect()))
    plan = index.build(docs, ["text"]).postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(term") == 1 and plan.count("hashpartitioning") == 1  # words meet in one shuffle


def test_ranks_over_ranges(spark):
    rows = [(i, float(i * 7 % 50)) for i in range(200)]
    out = fusion.ranked(spark.createDataFrame(rows, "doc_id long, score double").repartition(5)).collect()
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["rank"])] == [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [r["rank"] for r in sorted(out, key=lambda r: r["rank"])] == list(range(1, 201))


def test_reached_groups_are_what_terms_lead_to(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    equivalent = [(f"g{rng.randrange(18)}", w) for w in words[:40]] + [("g3", "w7"), ("g4", "w7")]
    one_way = [(rng.choice(words), rng.choice(words)) for _ in range(25)]
    links = synonyms.links(spark.createDataFrame(equivalent, "group string, word string"), spark.createDataFrame(one_way, "source string, word string"))
    rows = [tuple(r) for r in links.select("term", "other", "kind").collect()]
    name = {a: b for a, b, kind in rows if kind == "name"}
    asked = [(i % 9, rng.choice([*words, "none"])) for i in range(14)]
    for depth in (1, 2, 4):
        plain = set(asked)
        for _ in range(depth):
            plain |= {(q, w) for q, t in plain if t in name for w in name if name[w] == name[t]} | {(q, b) for q, t in plain for a, b, kind in rows if kind == "way" and a == t}
        terms = spark.createDataFrame(asked, "query_id int, term string")
        found = [tuple(r) for r in synonyms.reached(terms, links, depth).select("query_id", "kind", "term").collect()]
        assert len(found) == len(set(found))
        whole = {(q, w) for q, kind, t in found if kind == "group" for w in name if name[w] == t} | {(q, t) for q, kind, t in found if kind == "word"}
        assert whole == plain
        assert {tuple(r) for r in synonyms.expanded(terms, links, depth).collect()} == plain


def test_reached_names_a_group_once_for_each_query(spark):
    equivalent = [("g", f"w{i}") for i in range(100)]
    links = synonyms.links(spark.createDataFrame(equivalent, "group string, word string"), spark.createDataFrame([], "source string, word string"))
    terms = spark.createDataFrame([(w, w) for _, w in equivalent], "query_id string, term string")
    assert synonyms.reached(terms, links, 2).count() == 100  # and not 10,000


def test_fuzzy_sends_no_side_of_variants_to_all_tasks(spark, tmp_path):
    """A file far below the size that Spark broadcasts holds words that are many times larger with characters dropped."""
    spark.createDataFrame([(f"internation{i}", i) for i in range(50)], "term string, total_tf long").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    found = typos.fuzzy(words.select(F.col("term").alias("query")), words)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1  # that of the few lengths


def test_swapped(spark):
    pairs = [("abcd", "bacd"), ("abcd", "abdc"), ("abcd", "badc"), ("abcd", "abcd"), ("ab", "ba"), ("aab", "aba"), ("abcde", "edcba")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in rows.select(typos.swapped(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, True, True, False]


def test_documents_with_the_same_words_have_the_same_score(spark):
    rng = random.Random(3)
    terms = {f"t{i}": i * i + 1 for i in range(9)}
    rows = [(t, i, "text", n) for i in range(80) for t, n in terms.items()]
    rng.shuffle(rows)
    postings = spark.createDataFrame(rows, "term string, doc_id long, field string, tf long")
    lengths = spark.createDataFrame([(i, "text", 300) for i in range(80)], "doc_id long, field string, length long")
    found = ranking.bm25(index.Index(postings, lengths), list(terms)).collect()
    assert len(found) == 80 and len({r["score"] for r in found}) == 1


def test_stored_index_counts_where_texts_lie(spark):
    """Words of documents that come from their texts never meet in a shuffle, and terms of two fields count a document once."""
    rows = [(i, f"fox {i % 7} the the", "fox tail" if i % 2 else None) for i in range(40)] + [(40, None, ""), (41, "The É2 été", "the")]
    made = index.build(spark.createDataFrame(rows, "doc_id long, a string, b string").repartition(3), ["a", "b"], stop_words=["tail"])
    plan = made.texts.postings(100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(doc_id" in plan
    kept = made.stored()
    for ours, plain in ((kept.postings, made.postings), (kept.lengths, made.lengths), (kept.terms(), made.terms()), (kept.doc_lengths(), made.doc_lengths())):
        assert sorted(map(tuple, ours.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert {r["term"]: (r["doc_freq"], r["total_tf"]) for r in kept.terms().collect()}["fox"] == (40, 60)
    assert kept.numbers == made.size()


def test_stored_index_with_stems_and_repeated_keys(spark, docs):
    plain = index.build(docs, ["text"], stem=True)
    assert sorted(map(tuple, plain.stored().terms().collect())) == sorted(map(tuple, plain.terms().collect()))
    twice = index.build(docs.unionByName(docs.where("doc_id < 3")), ["text"])
    assert twice.texts.size() is None
    assert {r["term"]: (r["doc_freq"], r["total_tf"]) for r in twice.stored().terms().collect()}["the"] == (3, 5)


def test_ranking_reads_texts_once(spark, tmp_path):
    rows = [(i, f"fox {i % 7} the the", "fox tail" if i % 2 else None) for i in range(40)] + [(40, None, ""), (3, "the fox again", "the")]
    spark.createDataFrame(rows, "doc_id long, a string, b string").write.parquet(f"{tmp_path}/docs")
    made = index.build(spark.read.parquet(f"{tmp_path}/docs"), ["a", "b"])
    found = ranking.bm25(made, ["fox", "the", "none"], weights={"b": 2.0})
    assert not any(f"{tmp_path}/docs" in f for f in found.inputFiles())
    plain = ranking.bm25(index.Index(made.postings, made.lengths), ["fox", "the", "none"], weights={"b": 2.0})
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_fuzzy_tells_one_edit_by_places(spark):
    """With one edit at most pairs are neither measured in Python nor made single after the join, and come once."""
    words = ["aaaaa", "aaaaaa", "aaaa", "aaaab", "aaaba", "abaaa", "baaaa", "aabba", "ababa", "babaa", "ab", "ba", "", "caféé", "cafée", "café", "cfaéé", "\U0001d52baaaa", "abcde", "abdce", "bacde", "abecd", "abcd"]
    terms = spark.createDataFrame([(w, 1) for w in words], "term string, total_tf long")
    asked = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "query string")
    found = typos.fuzzy(asked, terms, "min", None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "levenshtein" not in plan and "Aggregate" not in plan.split("SortMergeJoin")[0]
    want = sorted((q, w, typos.edits(q, w)) for q in words for w in words if typos.edits(q, w) <= int(len(q) >= 5))
    assert sorted(map(tuple, found.collect())) == want


def test_fuzzy_reads_queries_once(spark, tmp_path):
    """Lengths of the queries come from the same reading as the queries."""
    spark.createDataFrame([(f"internation{i}",) for i in range(50)], "query string").write.parquet(f"{tmp_path}/words")
    asked = spark.read.parquet(f"{tmp_path}/words")
    found = typos.fuzzy(asked, asked.select(F.col("query").alias("term"), F.lit(1).alias("total_tf")), "min", None)
    assert found.count() > 0
    found = typos.fuzzy(asked, spark.createDataFrame([("internation1", 1)], "term string, total_tf long"), "min", None)
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_only_pairs_that_swaps_may_join_are_measured_in_python(spark):
    dice = random.Random(7)
    words = sorted({"".join(dice.choice("abcé") for _ in range(dice.randint(8, 11))) for _ in range(150)})
    for w in words[:60]:  # near words by two edits of any kind
        for _ in range(2):
            i = dice.randrange(len(w) - 1)
            w = dice.choice([w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "d" + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + "b" + w[i:]])
        words.append(w)
    rows = spark.createDataFrame([(q, w) for q in words[::3] for w in words], "query string, term string")
    plain = rows.withColumn("plain", F.levenshtein("query", "term")).where("plain BETWEEN 3 AND 4").withColumn("may", typos._swaps_may_join(F.col("plain"))).collect()
    assert all(r["may"] for r in plain if typos.edits(r["query"], r["term"]) <= 2)
    assert sum(r["may"] for r in plain) < len(plain) / 2
    asked = rows.select("query").distinct()
    terms = spark.createDataFrame([(w, 1) for w in sorted(set(words))], "term string, total_tf long")
    room = lambda q: 2 if len(q) >= 9 else 1
    want = sorted((q, w, typos.edits(q, w)) for q in {*words[::3]} for w in {*words} if typos.edits(q, w) <= room(q) and len(q) >= 5)
    assert sorted(tuple(r) for r in typos.fuzzy(asked, terms, "default", None).collect() if len(r["query"]) >= 5) == want
