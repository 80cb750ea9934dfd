"""run() against a plain Python version of its five stages, and the SQL of queries that have it."""

import hashlib
import os
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrove.llm import entries, length_buckets, quality_rules
from tests.llm.conftest import SCHEMA
from tests.llm.test_dedup_and_lm import shingles
from tests.llm.test_filters_and_mix import plain_counts, plain_languages, plain_posteriors, targets

DATA = "/root/testdata/sf0.001"


def plain_quality(rows, votes):
    """Rows that pass the base test and have a posterior of one half or more."""
    posterior = plain_posteriors([votes[i] for i in range(len(rows))])
    out = []
    for r, p in zip(rows, posterior, strict=True):
        n, *_, again = plain_counts(r["text"])
        if n >= 10 and 100 * again <= 20 * n and p >= 0.5:
            out.append(r)
    return out


def plain_language(rows):
    train = [(r["lang"], r["text"]) for r in rows if r["lang"] is not None]
    told = plain_languages(train, [(i, r["text"]) for i, r in enumerate(rows)])
    return [r for i, r in enumerate(rows) if told[i][0] != "und" and told[i][1] >= 0.5]


def plain_near_dedup(rows):
    """One row for each id, then the least id of each component of links at five words and 0.8."""
    texts = defaultdict(set)
    for r in rows:
        texts[r["doc_id"]].add(r["text"])
    assert all(len(t) == 1 for t in texts.values())
    sets = {i: shingles(next(iter(t)), 5) for i, t in texts.items() if i is not None}
    low = {i: i for i in sets}
    for _ in sets:
        for a, b in combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low[a] = low[b] = min(low[a], low[b])
    seen, out = set(), []
    for r in rows:
        if r["doc_id"] is None or (low[r["doc_id"]] == r["doc_id"] and r["doc_id"] not in seen):
            seen.add(r["doc_id"])
            out.append(r)
    return out


def plain_mix(rows):
    """Rows with their copies by Pareto order sampling, source by source."""
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    want = targets({s: sum(map(size, rs)) for s, rs in by_source.items()})
    out = []
    for s, rs in by_source.items():
        total = sum(map(size, rs))
        whole = int(want[s] // total)
        rest = want[s] - whole * total
        tilt = {id(r): int(65536.0 / (1.0 + size(r)) ** 0.25) for r in rs}
        tilted = sum(size(r) * tilt[id(r)] for r in rs)

        def rank(r, tilt=tilt, tilted=tilted, rest=rest):
            name = "mix" + ("" if r["doc_id"] is None else str(r["doc_id"])) + hashlib.md5((r["text"] or "").encode()).hexdigest()
            u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            odds = max(1e-9, min(1 - 1e-9, rest * tilt[id(r)] / tilted))
            return u / (1 - u) * (1 - odds) / odds

        upto = 0
        for r in sorted(rs, key=rank):
            upto += size(r)
            out += [r] * (whole + (rest > 0 and upto - size(r) / 2 <= rest))
    return out


def test_run_matches_plain_python(spark, texts, tmp_path):
    rows = [dict(zip(("doc_id", "text", "lang", "source"), t, strict=True)) for t in texts if t[0] != 97]
    rows += [rows[5], rows[-1]]
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], None, True, 0.5, 3, 7, "r") for r in rows], SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    voted = quality_rules.votes_of(quality_rules.counted(df), quality_rules.standard_rules())
    by_row = {(r["doc_id"], r["row_key"]): tuple(r["votes"]) for r in voted.collect()}
    keys = [(r["doc_id"], r["k"]) for r in df.select("doc_id", quality_rules.row_key().alias("k")).collect()]
    kept = plain_quality(rows, [by_row[k] for k in keys])
    kept = plain_mix(plain_near_dedup(plain_language(kept)))
    assert 40 < len({r["doc_id"] for r in kept}) < len(rows) - 20  # stages have rejected, linked and dropped rows

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths = Counter(len((r["text"] or "").encode().split()) + 1 for r in kept)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode().split()) + 1) for r in kept)
    n, counts = (np.array(x) for x in zip(*sorted(lengths.items()), strict=True))
    edges = length_buckets.optimal_boundaries(n, counts, length_buckets.BUCKETS)  # tested against all choices elsewhere
    members = defaultdict(list)
    for r in got:
        assert r["bucket_tokens"] == min(e for e in edges if e >= r["n_tokens"]) and r["bucket_tokens"] == edges[r["bucket"]]
        members[r["bucket"]].append((r["batch"], r["slot"]))
    for bucket, places in members.items():
        per_batch = max(1, length_buckets.BUDGET // edges[bucket])
        assert sorted(places) == [(i // per_batch, i % per_batch) for i in range(len(places))]


def test_rows_of_one_id(spark):
    """Of rows with one id and different texts the same one stays however they lie; rows without an id get their own copies."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a, "s"), (1, b, "s"), (2, "c " * 30, "s"), (None, a, "t"), (None, b + " z", "t"), (None, b + " z", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = corpus_pipeline.near_dedup(spark, df, "").collect()
    again = corpus_pipeline.near_dedup(spark, df.repartition(3, "text").orderBy(F.desc("text")), "").collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert sorted(str(r["doc_id"]) for r in first) == ["1", "2", "None", "None", "None"]
    copies = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mix(spark, df, "").collect())
    want = Counter()
    for r in plain_mix([dict(zip(("doc_id", "text", "source"), r, strict=True)) for r in rows]):
        want[r["doc_id"], r["text"]] += 1
    assert copies == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for table in os.listdir(DATA):
        c.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{table}'")
    df = entries.queries()[name](spark, DATA)
    names = sorted(df.columns)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    theirs = c.sql(f"SELECT {', '.join(names)} FROM ({entries.oracle_sql()[name]})").fetchall()
    assert sorted(map(plain, df.select(names).collect()), key=str) == sorted(map(plain, theirs), key=str)
