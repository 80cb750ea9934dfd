"""Near-duplicates and the language model against plain Python on the same texts."""

import math
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lexigrove.llm import brown_lm, common, near_duplicates
from lexigrove.llm.components import components


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_match_all_pairs(spark, docs, texts, width, percent):
    sets = {i: shingles(t, width) for i, t, *_ in texts if i is not None}
    low = {i: i for i in sets}

    def root(i):
        return i if low[i] == i else root(low[i])

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            low[max(x, y)] = min(x, y)
    out = near_duplicates.near_duplicates(docs, width, percent).collect()
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["n_shingles"] == len(sets[r["doc_id"]])
            assert r["component_id"] == root(r["doc_id"]) and r["kept"] == (r["doc_id"] == root(r["doc_id"]))


def test_cells_lose_no_pair(spark, monkeypatch):
    """A bucket that is dealt out in many cells gives the pairs that all members give."""
    monkeypatch.setattr(near_duplicates, "CELL", 4)
    base = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sig = near_duplicates.signatures(df, 3, 8).withColumn("node", common.F.col("doc_id")).withColumn("component", common.F.col("doc_id")).withColumn("key", common.F.element_at("bands", 1)).withColumn("size", common.F.lit(30))
    sizes = sig.groupBy("key").count().collect()
    expected = sum(r["count"] * (r["count"] - 1) // 2 for r in sizes)
    got = near_duplicates.similar_across(sig, 85)
    assert got.count() == got.distinct().count() == expected > 0


def test_large_components_do_not_meet_themselves(spark, monkeypatch):
    """A bucket with a large component, a middling one and single members: every pair across them, none inside, each once."""
    monkeypatch.setattr(near_duplicates, "CELL", 4)
    base = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(40)]
    part = {i: 100 if i < 20 else 200 if i < 28 else i for i in range(40)}
    df = spark.createDataFrame([(i, t, part[i]) for i, t in texts], "doc_id long, text string, component long")
    sig = near_duplicates.signatures(df, 3, 1).withColumnRenamed("doc_id", "node").join(df.select(common.F.col("doc_id").alias("node"), "component"), "node")
    rows = sig.withColumn("key", common.F.lit(7).cast("long")).withColumn("bands", common.F.array("key")).withColumn("size", common.F.lit(40))
    got = sorted((r["a"], r["b"]) for r in near_duplicates.similar_across(rows, 85).collect())
    assert got == [(a, b) for a, b in combinations(range(40), 2) if part[a] != part[b]]


def test_shared_ids_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (7, a), (9, c), (9, ""), (8, c), (4, None), (3, "")]
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(5, 3, False), (3, 3, True), (7, 3, False), (9, 8, False), (8, 8, True), (4, 4, True)}
    assert len(out) == len(rows)


def test_repeated_rows_are_linear(spark):
    """Two near copies, each row 2,000 times: the pair is confirmed once."""
    base = [f"w{i}" for i in range(200)]
    one, two = " ".join(base), " ".join(["x", *base[1:]])
    df = spark.createDataFrame([(1, one), (2, two)] * 2000, "doc_id long, text string")
    out = near_duplicates.near_duplicates(df).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, out)) == [(1, 1, 2000), (2, 1, 2000)]


def test_sketch_test_keeps_links():
    rng = np.random.default_rng(0)
    for n in (5, 40, 400, 4000):
        for _ in range(40):
            shared = rng.integers(0, 2**63, n, dtype=np.uint64)
            own = int(n * 0.15 / 0.85 / 2)
            sets = [np.unique(np.concatenate([shared, rng.integers(0, 2**63, own, dtype=np.uint64)]) * np.uint64(2)) for _ in range(2)]
            bits, samples = zip(*(near_duplicates.odd_sketches(s, np.zeros(len(s), int), 1) for s in sets), strict=True)
            differing = np.bitwise_count(bits[0] ^ bits[1]).sum(1)
            assert near_duplicates.may_link(differing, np.array([len(sets[0])]), np.array([len(sets[1])]), samples[0], samples[1], 85)[0]


def test_band_count():
    bands = near_duplicates.band_count(85)
    assert (1 - 0.85**4) ** bands <= 1e-7 < (1 - 0.85**4) ** (bands - 1)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(1, 5), (5, 1), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {1: 1, 5: 1}


def test_split_words_is_bytes_split(texts):
    import pyarrow as pa

    column = pa.array([t for _, t, *_ in texts]).slice(3)
    data, offsets = common.text_buffer(column)
    hashes, counts = common.split_words(data, offsets)
    expected = [w for t in column.to_pylist() for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in column.to_pylist()]
    assert len({(h, w) for h, w in zip(hashes.tolist(), expected, strict=True)}) == len(set(expected)) == len(set(hashes.tolist()))


# ---------------------------------------------------------------- language model


@pytest.fixture(scope="module")
def small(spark, docs):
    train = docs.where(~brown_lm.held_out(docs.doc_id))
    model = brown_lm.fit(train, core_size=100, head_size=150, n_classes=6, sweeps=2)
    return model, brown_lm.scored(docs, model).collect()


def test_base_counts(small, texts):
    model, rows = small
    every = [*texts, texts[-1], texts[5]]
    train = [t for i, t, *_ in every if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in [*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    assert (model.train_tokens, model.types) == (n, v)
    expected = sorted(
        (len(words(t)) + 1, sum(w in counts for w in [*words(t), b""]), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), b""]), 4)) for _, t, *_ in every
    )
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in rows) == expected


def test_probabilities_sum_to_one(small):
    model, _ = small
    known = {w: (n, c) for w, n, c in zip(model.head, model.head_counts, model.head_classes, strict=True)} | {bytes(r["word"]): (r["n"], r["cls"]) for r in model.rest.collect()}
    assert len(known) + 1 == model.types
    for h in range(len(model.follow)):
        p = sum(model.follow[h, c] * (n + 0.5) / model.mass[c] for n, c in known.values())
        p += model.follow[h, 0] * (model.end_count + 0.5) / model.mass[0] + (model.follow[h] * model.unknown / np.maximum(model.mass, 1e-300)).sum()
        assert p == pytest.approx(1)


def test_scores_match_the_model(small, texts):
    model, rows = small
    known = {w: (n, c) for w, n, c in zip(model.head, model.head_counts, model.head_classes, strict=True)} | {bytes(r["word"]): (r["n"], r["cls"]) for r in model.rest.collect()}
    head = dict(zip(model.head, model.head_classes, strict=True))
    assert len(head) > 50 and model.rest.count() > 50
    unknown = (model.follow * model.unknown / np.maximum(model.mass, 1e-300)).sum(1)
    by_id = {r["doc_id"]: r for r in rows}
    for i, t, *_ in texts:
        h, total = 0, 0.0
        for w in [*words(t), None]:
            n, c = (model.end_count, 0) if w is None else known.get(w, (0, None))
            p = unknown[h] if c is None else model.follow[h, c] * (n + 0.5) / model.mass[c]
            total += math.log10(brown_lm.MIX * p + (1 - brown_lm.MIX) * (n + 0.5) / model.base_total)
            h = head.get(w, len(model.follow) - 1)
        assert by_id[i]["score"] == pytest.approx(total, rel=1e-6)


def test_exchange_finds_two_kinds_of_words():
    rng = np.random.default_rng(1)
    kind = np.arange(40) % 2
    features = np.array([rng.multinomial(200, [0.45, 0.45, 0.05, 0.05] if k else [0.05, 0.05, 0.45, 0.45]) for k in kind])
    classes = brown_lm.exchange(features, np.arange(40) // 2 % 2 + 1, 2, inner=4)
    assert len({(k, c) for k, c in zip(kind.tolist(), classes.tolist(), strict=True)}) == 2


def test_other_words_move_to_their_best_classes(small, spark, docs):
    """Classes and transitions of all words outside the core, recounted text by text in plain Python."""
    model, _ = small
    n_classes, symbols = 6, 8
    train = [words(r["text"]) for r in docs.where(~brown_lm.held_out(docs.doc_id)).collect()]
    head = dict(zip(model.head, model.head_classes.tolist(), strict=True))
    core = set(model.head[:100])
    outside = n_classes + 1

    def around(known):
        for ws in train:
            hs = [0, *(known.get(w, outside) for w in ws), 0]
            for i, w in enumerate(ws):
                yield w, hs[i], hs[i + 2]

    def likelihoods(known):
        table = np.zeros((n_classes + 1, 2 * symbols))
        for w, left, right in around(known):
            if w in core:
                table[head[w], left] += 1
                table[head[w], symbols + right] += 1
        return np.log((table[1:] + 0.5) / (table[1:].sum(1, keepdims=True) / 2 + 0.5 * symbols))

    def best(known, wanted):
        table, gain = likelihoods(known), {}
        for w, left, right in around(known):
            if wanted(w):
                gain[w] = gain.get(w, 0) + table[:, left] + table[:, symbols + right]
        return gain

    rest = {bytes(r["word"]): r["cls"] for r in model.rest.collect()}
    first = best({w: c for w, c in head.items() if w in core}, lambda w: w in head and w not in core)
    second = best(head, lambda w: w not in head)
    assert set(second) == set(rest) and set(first) == set(head) - core
    for w, gain in [*first.items(), *second.items()]:
        assert gain[(head | rest)[w] - 1] == pytest.approx(gain.max(), rel=1e-9)
    follow = np.zeros((symbols, n_classes + 1))
    for ws in train:
        for v, w in zip([None, *ws], [*ws, None], strict=True):
            follow[0 if v is None else head.get(v, outside), 0 if w is None else (head | rest)[w]] += 1
    level = model.mass / model.mass.sum()
    assert np.allclose(model.follow, (follow + brown_lm.PRIOR * level) / (follow.sum(1, keepdims=True) + brown_lm.PRIOR))
