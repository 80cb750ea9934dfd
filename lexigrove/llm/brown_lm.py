"""Language-model scoring with Brown classes (operator 4).

A word's probability after its predecessor is that of its class after the predecessor's class times
that of the word within its class, mixed with the smoothed unigram:

    p(w | v) = MIX * p(c(w) | h(v)) * p(w | c(w)) + (1 - MIX) * p(w)

Classes come from exchange clustering (Kneser & Ney, 1993; distributed as in Uszkoreit & Brants, 2008).
Spark counts, over all training texts, which classes stand left and right of each of the CORE commonest
words; a sweep then moves each word to the class that gains most likelihood, with the counts of the
neighbours' classes as they were when the sweep began, and the next sweep counts anew. When the core
has settled, the HEAD commonest words move to their best classes by their own neighbours, and then every
other word of the vocabulary, however rare, does so by its neighbours of the head, each in one
distributed step. h(v) is the class of a word of the head; as predecessors, all other words are of one
kind, so that a text can be scored without looking up the class of a rare word's successor first.

What is bounded: the core, the classes, and the HEAD words that each task holds in memory. All else,
counts and classes of all other words, stays in tables and meets the texts in a shuffle; rare words are
spread evenly, and common ones never get there. What is gathered of a word is at most a count for each
symbol left and right of it.

Probabilities of all known words, the end and one unknown word sum to 1 after any predecessor, as those
of the base do. Edge cases: a null or empty text is its end alone. Repeated rows are scored each. With
nothing to learn from, N and V are 0 and every token is unknown. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import common

CORE, HEAD, CLASSES = 8192, 131_072, 64
SWEEPS, INNER = 3, 2
MIX, PRIOR = 0.95, 50.0
_FLUSH = 200_000
_CHUNK = 64  # core words of one row of counts
_GROUP = 64  # tasks whose counts meet first
_WORDS = 5_000  # words that are settled at once
_HELD = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as bytes, A-Z lower-cased; bytes part at space and \\t\\n\\v\\f\\r exactly."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


# ---------------------------------------------------------------- counts of words


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all whole texts; each task sums before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return made

        for batch in common.short_batches(batches, 0):
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                if len(seen) > _FLUSH:
                    yield out()
        yield out()

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray, int]:
    """The commonest words, commonest first, at most ``most`` of them, with their counts, and the least count.

    Words with equal counts are in or out together; the count comes from a histogram of counts.
    """
    top = F.least(F.col("n"), F.lit(1_000_000))
    histogram = counts.groupBy(top.alias("n")).count().orderBy(F.desc("n")).collect()
    cut, total = 1_000_001, 0
    for r in histogram:
        total += r["count"]
        if total > most:
            break
        cut = r["n"]
    rows = counts.where(F.col("n") >= cut).select("word", "n").collect()  # ``most`` rows at most
    rows.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    return [bytes(r["word"]) for r in rows], np.array([r["n"] for r in rows], np.int64), cut


# ---------------------------------------------------------------- exchange clustering


def head_ids(train: DataFrame, head: list[bytes]) -> DataFrame:
    """For each batch of texts, the ids of their words as 32-bit numbers.

    A word of the head is its rank, any other word len(head), and an end, before the first text and after
    each, is len(head) + 1.
    """
    shared = train.sparkSession.sparkContext.broadcast(head)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {w: i for i, w in enumerate(shared.value)}
        other, end = len(ids), len(ids) + 1
        get = ids.get
        for batch in common.short_batches(batches, 0):
            flat = [end]
            for text in batch.column(0).to_pylist():
                flat.extend([get(w, other) for w in words_of(text)])
                flat.append(end)
            yield pa.RecordBatch.from_arrays([pa.array([np.array(flat, np.int32).tobytes()], pa.binary())], ["ids"])

    return train.select("text").mapInArrow(number, "ids binary")


def symbols_of(classes: np.ndarray, n_head: int, n_classes: int) -> np.ndarray:
    """The symbol of each id: 0 the end, 1 to n_classes the classes of the first words of the head, n_classes + 1
    all words that have no class yet."""
    symbol = np.full(n_head + 2, n_classes + 1, np.int64)
    symbol[: len(classes)] = classes
    symbol[n_head + 1] = 0
    return symbol


def neighbour_counts(ids: DataFrame, symbol: np.ndarray, n_core: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts (core, 2 * symbols) of the symbols left and right of each core word,
    counts (symbols, symbols) of neighbouring symbols), over all texts.

    Tasks add up what they read; the sums of up to _GROUP tasks meet first, then those of all.
    """
    symbols = n_classes + 2
    shared = ids.sparkSession.sparkContext.broadcast(symbol)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = np.zeros(n_core * 2 * symbols, np.int64)
        by_class = np.zeros(symbols * symbols, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                word = np.frombuffer(blob, np.int32).astype(np.int64)
                cls = shared.value[word]
                by_class += np.bincount(cls[:-1] * symbols + cls[1:], minlength=len(by_class))
                left = np.flatnonzero(word[1:] < n_core) + 1
                right = np.flatnonzero(word[:-1] < n_core)
                by_word += np.bincount(
                    np.concatenate([word[left] * 2 * symbols + cls[left - 1], (word[right] * 2 + 1) * symbols + cls[right + 1]]),
                    minlength=len(by_word),
                )
        table = by_word.reshape(n_core, 2 * symbols)
        chunks = [(i // _CHUNK, table[i : i + _CHUNK].tobytes()) for i in range(0, n_core, _CHUNK)]
        chunks.append((-1, by_class.tobytes()))
        group = pa.array(np.full(len(chunks), TaskContext.get().partitionId() // _GROUP, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in chunks], pa.int32()), group, pa.array([b for _, b in chunks], pa.binary())], ["chunk", "part", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                part = np.frombuffer(blob, np.int64)
                total = part if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])

    parts = ids.mapInArrow(count, "chunk int, part int, counts binary")
    parts = parts.groupBy("chunk", "part").applyInArrow(add, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    found = {r["chunk"]: np.frombuffer(bytes(r["counts"]), np.int64) for r in parts.collect()}  # CORE x 2 x symbols numbers
    by_word = np.concatenate([found[c].reshape(-1, 2 * symbols) for c in sorted(found) if c >= 0] or [np.zeros((0, 2 * symbols), np.int64)])
    return by_word, found.get(-1, np.zeros(symbols * symbols, np.int64)).reshape(symbols, symbols)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(features: np.ndarray, classes: np.ndarray, n_classes: int, inner: int = INNER) -> np.ndarray:
    """Moves each word in turn to the class that gains most likelihood; returns the new classes.

    features (words, f): counts of the neighbours' classes. The likelihood of words given neighbours
    is, up to a constant, the sum of x log x over class-by-feature counts less that over class totals.
    """
    classes = classes.copy()
    table = np.zeros((n_classes + 1, features.shape[1]))
    np.add.at(table, classes, features)
    for _ in range(inner):
        moved = 0
        for w in range(len(features)):
            on = np.flatnonzero(features[w])
            v = features[w, on].astype(float)
            n, old = v.sum(), classes[w]
            table[old, on] -= v
            mine, totals = table[1:, on], table[1:].sum(1)
            gain = (_xlogx(mine + v) - _xlogx(mine)).sum(1) - (_xlogx(totals + n) - _xlogx(totals))
            new = int(gain.argmax()) + 1
            table[new, on] += v
            classes[w] = new
            moved += new != old
        if not moved:
            break
    return classes


# ---------------------------------------------------------------- the other words


def class_likelihoods(by_word: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """(2 * symbols, classes): log likelihood of the symbol left or right of a word, given the word's class."""
    table = np.zeros((n_classes + 1, by_word.shape[1]))
    np.add.at(table, classes, by_word)
    share = np.log((table[1:] + 0.5) / (table[1:].sum(1, keepdims=True) / 2 + 0.25 * by_word.shape[1]))
    return share.T.copy()


def best_classes(gathered: DataFrame, likely: np.ndarray) -> DataFrame:
    """word, cls, n for each word of ``gathered`` (word, code, n), the symbols next to it with their numbers; word
    null: n words of class cls after symbol h. Codes below the number of symbols are left of the word.

    All rows of a word are a count for each code at most, so its list is short however common it is.
    """
    shared = gathered.sparkSession.sparkContext.broadcast(likely)
    symbols, n_classes = len(likely) // 2, likely.shape[1]
    kind = gathered.schema["word"].dataType.simpleString()
    none = pa.binary() if kind == "binary" else pa.int32()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = np.zeros((symbols, n_classes), np.int64)
        for batch in batches:
            for first in range(0, len(batch), _WORDS):
                part = batch.slice(first, _WORDS)
                found = part.column("found")
                sizes = np.diff(found.offsets.to_numpy())
                flat = found.flatten()
                code, n = flat.field("code").to_numpy(), flat.field("n").to_numpy()
                starts = np.cumsum(sizes) - sizes
                best = np.add.reduceat(shared.value[code] * n[:, None], starts, axis=0).argmax(1)
                left = code < symbols
                np.add.at(after, (code[left], np.repeat(best, sizes)[left]), n[left])
                total = np.add.reduceat(np.where(left, n, 0), starts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("word"), pa.array((best + 1).astype(np.int32)), pa.array(total), pa.nulls(len(best), pa.int32())], ["word", "cls", "n", "h"]
                )
        h, c = np.nonzero(after)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(h), none), pa.array((c + 1).astype(np.int32)), pa.array(after[h, c]), pa.array(h.astype(np.int32))], ["word", "cls", "n", "h"]
        )

    each = gathered.repartition("word").groupBy("word", "code").agg(F.sum("n").alias("n"))
    lists = each.groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("found"))
    return lists.mapInArrow(settle, f"word {kind}, cls int, n long, h int")


def head_neighbours(ids: DataFrame, symbol: np.ndarray, first: int, last: int, n_classes: int) -> DataFrame:
    """word (its id), code, n for the words of the head from ``first`` to ``last`` - 1; tasks sum before the shuffle."""
    codes = 2 * (n_classes + 2)
    shared = ids.sparkSession.sparkContext.broadcast(symbol)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held) if held else np.empty(0, np.int64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((keys // codes).astype(np.int32)), pa.array((keys % codes).astype(np.int32)), pa.array(n)], ["word", "code", "n"])

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                word = np.frombuffer(blob, np.int32).astype(np.int64)
                cls = shared.value[word]
                at = np.flatnonzero((word >= first) & (word < last))  # an end stands before and after every word
                held.append(word[at] * codes + cls[at - 1])
                held.append(word[at] * codes + codes // 2 + cls[at + 1])
            if sum(map(len, held)) > _HELD:
                yield out()
        yield out()

    return ids.mapInArrow(gather, "word int, code int, n long")


def rare_neighbours(train: DataFrame, head: list[bytes], symbol: np.ndarray, n_classes: int) -> DataFrame:
    """word, code, n for the words outside the head; tasks sum before the shuffle."""
    symbols, n_head = n_classes + 2, len(head)
    shared = train.sparkSession.sparkContext.broadcast((head, symbol))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = shared.value
        get = dict(zip(words, known[:n_head].tolist(), strict=True)).get
        seen: defaultdict = defaultdict(int)

        def out() -> pa.RecordBatch:
            keys = list(seen)
            made = pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in keys], pa.binary()), pa.array([c for _, c in keys], pa.int32()), pa.array(seen.values(), pa.int64())], ["word", "code", "n"]
            )
            seen.clear()
            return made

        for batch in common.short_batches(batches, 0):
            for text in batch.column(0).to_pylist():
                ws = words_of(text)
                hs = [get(w, -1) for w in ws]
                for i, h in enumerate(hs):
                    if h < 0:
                        left = hs[i - 1] if i else 0
                        right = hs[i + 1] if i + 1 < len(hs) else 0
                        seen[ws[i], left if left >= 0 else symbols - 1] += 1
                        seen[ws[i], symbols + (right if right >= 0 else symbols - 1)] += 1
                if len(seen) > _FLUSH:
                    yield out()
        yield out()

    return train.select("text").mapInArrow(gather, "word binary, code int, n long")


# ---------------------------------------------------------------- the model


@dataclass
class BrownModel:
    """train_tokens is N and types V of the base. ``follow[h, c]``: p(class c after symbol h), class 0
    the end and the last the unknown word; ``mass[c]``: counts of a class's words, each plus 1/2."""

    train_tokens: int
    types: int
    end_count: int
    head: list[bytes]
    head_counts: np.ndarray
    head_classes: np.ndarray
    rest: DataFrame
    follow: np.ndarray
    mass: np.ndarray
    unknown: np.ndarray

    @property
    def base_total(self) -> float:
        return self.train_tokens + 0.5 * (self.types + 1)


def fit(train: DataFrame, core_size: int = CORE, head_size: int = HEAD, n_classes: int = CLASSES, sweeps: int = SWEEPS) -> BrownModel:
    """Counts words, clusters them and counts class transitions over all rows of ``train``."""
    train = train.select(F.col("text").cast("string").alias("text"))
    counts = common.stored(word_counts(train), "word-counts")
    n_docs = train.count()
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head, head_counts, cut = commonest(counts, head_size)
    n_core, n_head, symbols = min(core_size, len(head)), len(head), n_classes + 2

    ids = common.stored(head_ids(train, head), "head-ids")
    classes = (np.arange(n_core) % n_classes + 1).astype(np.int64)
    for _ in range(sweeps):
        by_word, _ = neighbour_counts(ids, symbols_of(classes, n_head, n_classes), n_core, n_classes)
        classes = exchange(by_word, classes, n_classes)
    by_word, _ = neighbour_counts(ids, symbols_of(classes, n_head, n_classes), n_core, n_classes)

    likely = class_likelihoods(by_word, classes, n_classes)
    near = head_neighbours(ids, symbols_of(classes, n_head, n_classes), n_core, n_head, n_classes)
    found = best_classes(near, likely).where(F.col("word").isNotNull()).select("word", "cls").collect()  # ``head_size`` rows at most
    head_classes = np.concatenate([classes, np.zeros(n_head - n_core, np.int64)])
    head_classes[np.array([r["word"] for r in found], np.int64)] = [r["cls"] for r in found]

    # With classes for the whole head: transitions, and the classes of all other words.
    symbol = symbols_of(head_classes, n_head, n_classes)
    by_word, after = neighbour_counts(ids, symbol, n_core, n_classes)
    likely = class_likelihoods(by_word, classes, n_classes)
    settled = common.stored(best_classes(rare_neighbours(train, head, symbol, n_classes), likely), "word-classes")
    rest = settled.where(F.col("word").isNotNull()).select("word", "n", "cls")
    follow = np.zeros((symbols, n_classes + 1))
    follow += after[:, : n_classes + 1]
    for r in settled.where(F.col("word").isNull()).groupBy("h", "cls").agg(F.sum("n").alias("n")).collect():  # symbols x classes
        follow[r["h"], r["cls"]] += r["n"]
    types = np.bincount(head_classes, minlength=n_classes + 1).astype(float)
    n_by_class = np.bincount(head_classes, head_counts, n_classes + 1)
    for r in rest.groupBy("cls").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect():  # one row a class
        types[r["cls"]] += r["v"]
        n_by_class[r["cls"]] += r["n"]
    types[0], n_by_class[0] = (1, n_docs) if n_docs else (0, 0)
    # The unknown word is one more type, dealt out to the word classes by their number of types.
    unknown = 0.5 * types * (np.arange(n_classes + 1) > 0) / max(1.0, types[1:].sum())
    mass = n_by_class + 0.5 * types + unknown
    level = mass / max(mass.sum(), 1e-300)
    follow = (follow + PRIOR * level) / (follow.sum(1, keepdims=True) + PRIOR)
    return BrownModel(
        train_tokens=int(totals["n"]) + n_docs, types=int(totals["v"]) + (n_docs > 0), end_count=n_docs, head=head,
        head_counts=head_counts, head_classes=head_classes, rest=rest, follow=follow, mass=mass, unknown=unknown,
    )


def scored(docs: DataFrame, model: BrownModel) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every document.

    Head words and ends are scored where the text is read. Each other word goes, with the symbol
    before it, to the table of rare words; sums by document come back together at the end.
    """
    spark = docs.sparkSession
    total, n_symbols = model.base_total, len(model.follow)
    has_end = model.end_count > 0
    shared = spark.sparkContext.broadcast((model.head, model.head_counts, model.head_classes, model.follow, model.mass))
    end_count = model.end_count

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, counts, classes, follow, mass = shared.value
        k = len(head)
        ids = {w: i for i, w in enumerate(head)}
        get = ids.get
        n = np.concatenate([counts, [0, end_count]]) + 0.5  # by id; k any other word, k + 1 the end
        cls = np.concatenate([classes, [0, 0]]).astype(np.int64)
        symbol = np.full(k + 2, n_symbols - 1, np.int64)
        symbol[:k] = classes
        symbol[k + 1] = 0
        base = n / total
        within = n / np.maximum(mass[cls], 1e-300)
        for batch in common.short_batches(batches, 2):
            words, flat, sizes = [], [], []
            for text in batch.column(2).to_pylist():
                ws = words_of(text)
                words += ws
                words.append(b"")
                flat += [get(w, k) for w in ws]
                flat.append(k + 1)
                sizes.append(len(ws) + 1)
            if not sizes:
                continue
            at, sizes = np.array(flat, np.int64), np.array(sizes, np.int64)
            starts = np.cumsum(sizes) - sizes
            before = np.empty_like(at)
            before[1:] = symbol[at[:-1]]
            before[starts] = 0
            here = at != k
            here &= (at != k + 1) | has_end
            p = MIX * follow[before, cls[at]] * within[at] + (1 - MIX) * base[at]
            add = lambda x: np.add.reduceat(np.where(here, x, 0), starts)  # noqa: E731, B023
            away = np.flatnonzero(~here)
            row = np.repeat(np.arange(len(sizes)), sizes)[away]
            rid = batch.column(0).to_numpy()
            n_rows, n_away = len(sizes), len(away)
            keys = [b" %d" % r for r in rid.tolist()] + [words[i] for i in away.tolist()]  # no word begins with a space
            nothing = np.zeros(n_away)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.binary()), pa.array(np.concatenate([rid, rid[row]])),
                    pa.concat_arrays([batch.column(1), pa.nulls(n_away, pa.int64())]),
                    pa.array(np.concatenate([np.full(n_rows, -1), before[away]]).astype(np.int32)),
                    pa.array(np.concatenate([sizes, nothing]).astype(np.int64)), pa.array(np.concatenate([add(1), nothing]).astype(np.int64)),
                    pa.array(np.concatenate([add(np.log10(base[at])), nothing])), pa.array(np.concatenate([add(np.log10(p)), nothing])),
                ],
                ["word", "rid", "doc_id", "h", "n_tokens", "n_known", "base_score", "score"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.mapInArrow(read, "word binary, rid long, doc_id long, h int, n_tokens long, n_known long, base_score double, score double")
    joined = rows.join(model.rest, "word", "left")

    # p(class | symbol) / mass(class) for each pair, and what the unknown word gets after each symbol: a small, fixed number of rows.
    mass, n_classes = np.maximum(model.mass, 1e-300), len(model.mass) - 1
    pairs = [(h, c, float(model.follow[h, c] / mass[c])) for h in range(n_symbols) for c in range(1, n_classes + 1)]
    pairs += [(h, 0, float((model.follow[h] / mass * model.unknown).sum() / 0.5)) for h in range(n_symbols)]
    factors = F.broadcast(spark.createDataFrame(pairs, "h int, cls int, factor double"))
    joined = joined.withColumn("cls", F.coalesce("cls", F.lit(0))).join(factors, ["h", "cls"], "left")
    half = F.coalesce("n", F.lit(0)) + 0.5
    away = F.col("h") >= 0
    base = F.when(away, F.log10(half / total)).otherwise(F.col("base_score"))
    score = F.when(away, F.log10(MIX * F.col("factor") * half + (1 - MIX) * half / total)).otherwise(F.col("score"))
    known = F.when(away, F.col("n").isNotNull().cast("long")).otherwise(F.col("n_known"))
    return joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"),
        F.sum(base).alias("base_score"), F.sum(score).alias("score"),
    ).drop("rid")


def held_out(doc_id: Column) -> Column:
    return common.fold_of(doc_id) == 1


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
