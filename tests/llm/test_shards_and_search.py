"""Training-order shards as an exact round trip, and vector search against brute force."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import common, training_order, vector_search

needs_vocabulary = pytest.mark.skipif(not os.path.exists(training_order.VOCABULARY), reason="no vocabulary here")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = training_order.feistel(np.arange(n), n, 99)
    assert sorted(slots.tolist()) == list(range(n))
    assert training_order.feistel(slots, n, 99, inverse=True).tolist() == list(range(n))
    if n > 100:
        assert slots.tolist() != training_order.feistel(np.arange(n), n, 100).tolist()


@needs_vocabulary
def test_encoder_is_the_vocabularys(texts, monkeypatch):
    with open(training_order.VOCABULARY, "rb") as f:
        vocabulary = f.read()
    dice = random.Random(3)
    extra = ["a  b", " a", "a ", "a\n b\t c \n", "it's we'll", "x \u00a0 y", "1 22,3 é", "\n", " ", "a\nb\n\nc"]
    extra += ["".join(dice.choice(["a", "b", " ", "\n", "é", "'s", "1", "-", "\t", "\x1c", "\u2003", "漢"]) for _ in range(dice.randint(0, 12))) for _ in range(2000)]
    every = [t or "" for t in [*(t for _, t, *_ in texts), *extra]]
    for most in (1_000_000, 40):  # a memory for all pieces, and one that is soon full
        monkeypatch.setattr(training_order, "_MEMO", most)
        encode = training_order.Encoder(vocabulary)
        data, offsets = common.text_buffer(pa.array(every))
        want = [[*encode.encoding.encode_ordinary(t), encode.end] for t in every]
        for first, last in common.steps(offsets):
            ids, sizes = encode(data, offsets[first : last + 1])
            assert sizes.tolist() == encode.lengths(data, offsets[first : last + 1]).tolist() == [len(w) for w in want[first:last]]
            assert ids.tolist() == [i for w in want[first:last] for i in w]


@needs_vocabulary
@pytest.mark.parametrize(("per_shard", "at_once"), [(50, 4096), (50, 16), (None, 64)])
def test_round_trip(spark, docs, texts, tmp_path, monkeypatch, per_shard, at_once):
    monkeypatch.setattr(training_order, "READ_RECORDS", at_once)
    path = f"file://{tmp_path}/shards"
    total = training_order.write_shards(docs.repartition(3, "text"), path, length=32, shard_records=per_shard)
    per_shard = training_order.layout(path)["shard_records"]
    rows = training_order.read_shards(spark, path).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(total))
    names = sorted(os.listdir(tmp_path / "shards"))
    sizes = [os.path.getsize(tmp_path / "shards" / n) for n in names if n.endswith(".bin")]
    assert set(sizes[:-1]) <= {per_shard * training_order.shard_bytes(32)} and len(sizes) == -(-total // per_shard)
    with open(training_order.VOCABULARY, "rb") as f:
        encode = training_order.Encoder(f.read())
    pieces = {}
    for r in rows:
        assert r["position"] == r["slot"] % per_shard * training_order.shard_bytes(32) and r["shard"] == r["slot"] // per_shard
        pieces.setdefault(r["doc_id"], {}).setdefault(r["piece"], set()).add(bytes(r["tokens"]))
    for i, t, *_ in texts:
        got = b"".join(next(iter(v)) for _, v in sorted(pieces[-1 if i is None else i].items()))
        ids = np.frombuffer(got, np.uint16).tolist()
        assert ids[-1] == encode.end and encode.encoding.decode(ids[:-1]) == (t or "")
    later = training_order.read_shards(spark, path, first_slot=123).orderBy("slot").collect()
    assert [r["slot"] for r in later] == list(range(123, total)) and later[0]["tokens"] == rows[123]["tokens"]


def test_shards_grow_with_the_corpus():
    assert training_order.records_of_shard(1) == training_order.SHARD_RECORDS
    for total in (10**6, 10**9, 3 * 10**9):
        per_shard = training_order.records_of_shard(total)
        assert per_shard & (per_shard - 1) == 0 and -(-total // per_shard) <= training_order.MOST_SHARDS
    assert training_order.records_of_shard(10**13) == training_order.MOST_RECORDS


# ---------------------------------------------------------------- vectors


def brute(rows, k, every):
    ids = sorted(rows)
    m = np.array([rows[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in (i for i in ids if i % every == 0):
        s = m @ m[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out[q] = [(ids[i], s[i]) for i in order]
    return out


def test_search(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 32))
    rows = {i: (centres[i % 20] + rng.normal(size=32) * 0.4).astype(np.float32).tolist() for i in range(1500)}
    odd = [(5001, None), (5050, []), (5100, [0.0] * 32), (5150, [1.0] * 31 + [None]), (5200, [float("nan")] * 32), (5250, [float("inf")] * 32), (5300, [1.0, 2.0]), (5301, [2.0, 1.0]), (5302, [3.0, 1.0]), (None, [1.0] * 32)]
    data = [(i, v, "x", 1) for i, v in [*rows.items(), *odd, (0, rows[0])]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score string, rank int")
    got = {}
    for r in vector_search.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert [i for i, _ in got.pop(5300)] == [5301, 5302]  # vectors of another length are searched among themselves
    want = brute(rows, 5, 50)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        for i, s in found:
            a, b = np.array(rows[q], np.float64), np.array(rows[i], np.float64)
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_near_copies_are_ranked_exactly(spark):
    """Groups of thousands of near copies that quantise alike: the nearest are not those of the smallest ids."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 16))
    rows = {i: (centres[i % 3] + rng.normal(size=16) * 1e-4).tolist() for i in range(9000)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.nearest(df, F.col("id") % 1000 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in found] for q, found in brute(rows, 5, 1000).items()}


def test_cells_lose_no_neighbour(spark, monkeypatch):
    """Many cells over clusters, even directions and a hot group of copies give what brute force gives."""
    monkeypatch.setattr(vector_search, "CELL_ROWS", 100)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 8))
    rows = {i: (centres[i % 12] + rng.normal(size=8) * 0.1).tolist() for i in range(1500)}
    rows |= {i: rng.normal(size=8).tolist() for i in range(1500, 2200)}
    rows |= {i: rows[3] for i in range(2200, 3000)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    want = {q: [(i, round(s, 9)) for i, s in found] for q, found in brute(rows, 5, 50).items()}
    assert {q: [s for _, s in v] for q, v in got.items()} == {q: [s for _, s in v] for q, v in want.items()}
    assert {q: v for q, v in got.items() if q < 2200} == {q: v for q, v in want.items() if q < 2200}


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.1, 1.0])]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "vec_id long, embedding array<double>")
        assert [r["vec_id"] for r in vector_search.nearest(df, F.col("id") == 2).orderBy("rank").collect()] == [3, 1]


def test_copies_and_few_candidates(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 0.0]) for i in range(400)] + [(500, [0.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = vector_search.nearest(df, F.col("id") == 50).orderBy("rank").collect()
    assert [r["vec_id"] for r in rows] == [0, 1, 2, 3, 4]
    few = vector_search.nearest(df.where("vec_id in (0, 1, 500)"), F.col("id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in few] == [1, 500]
    assert vector_search.nearest(df.where("false"), F.col("id") == 0).count() == 0
    assert vector_search.nearest(df.where("vec_id = 0"), F.col("id") == 0).count() == 0
