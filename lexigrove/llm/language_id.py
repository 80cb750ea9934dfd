"""Language identification by word-first backoff (operator 7).

Known words are scored by their log frequency in each language. A word that no language knows falls
back to its longest character n-grams, with marks for the word's ends, of which any is known, then to
shorter ones. A document's scores are the sums over all words of its whole text.

The classifier is fitted on at most about ``fit_docs`` documents of each language, taken by a hash of id
and text; that is its only bound. Every value of ``lang`` with words in the sample is learnt, with every
word and every n-gram of the sample. Spark counts them; the model keeps a 64-bit hash and the counts of
those languages that have the word, so its size follows from the sample and not from words times languages.

Scores are worked out for a slice of texts at once in numpy: each distinct word of the slice is looked up
once, and what it adds to its languages is summed by document.

Edge cases: a null text, and one without a letter, is ``und`` with score 0; so is every text if there
is nothing to learn from. Ties go to the language that sorts first. Only ``doc_id``, ``text`` and, for
fitting, ``lang`` are read; other columns do not matter. Very long texts are read in parts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import common

FIT_DOCS = 4_000  # documents of a language that the classifier is fitted on, about
LONGEST = 5
NONE = "und"
_RUN = re.compile(r"[^\W\d_]+")
_FLUSH = 200_000
_PART = 1 << 18  # characters of a very long text that are taken at once
_ENTRIES = 2_000_000  # numbers that are summed at once
_U = np.uint64
_PLACE = common.mix(np.arange(1, LONGEST + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F)) | _U(1)  # odd factors by place in an n-gram


def letter_words(text: str) -> list[str]:
    """Lower-cased runs of letters; a run must hold a letter, not only other numerals."""
    return _RUN.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(any(map(str.isalpha, w)) for w in words)


def parts_of(text: str) -> Iterator[str]:
    """The text, in parts that end at a space if it is very long."""
    first = 0
    while len(text) - first > _PART:
        last = text.find(" ", first + _PART)
        if last < 0:
            break
        yield text[first:last]
        first = last
    yield text[first:]


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, exact in their bytes."""
    data, offsets = common.text_buffer(words)
    part = data[int(offsets[0]) : int(offsets[-1])]
    return common.span_hashes(part, offsets[:-1] - offsets[0], offsets[1:] - offsets[0], common.EXACT_BYTE)


def gram_hashes(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, hash) of all substrings of n characters; "<" and ">" mark a word's ends unless n is 1."""
    marked = [f"<{w}>" for w in words] if n > 1 else words
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(marked)), sizes)
    last = np.repeat(np.cumsum(sizes), sizes)
    at = np.flatnonzero(np.arange(len(points)) + n <= last)
    hashes = np.full(len(at), n, _U)
    for i in range(n):
        hashes += common.mix(points[at + i] + _U(1)) * _PLACE[i]
    return word[at], common.mix(hashes)


@dataclass
class Frequencies:
    """Log frequencies of keys by language: ``level[l] + delta`` for each language ``lang`` that has the key,
    between ``starts`` of the key, and ``level[l]`` for all others."""

    keys: np.ndarray
    starts: np.ndarray
    lang: np.ndarray
    delta: np.ndarray
    level: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, lang: np.ndarray, n: np.ndarray, n_langs: int) -> Frequencies:
        """From the number ``n`` of each pair of key and language, smoothed by one half."""
        order = np.lexsort((lang, keys))
        keys, lang, n = keys[order], lang[order], n[order]
        distinct, starts = np.unique(keys, return_index=True)
        total = np.bincount(lang, n, n_langs)
        level = np.log(0.5 / (total + 0.5 * (len(distinct) + 1)))
        return cls(distinct, np.append(starts, len(keys)), lang.astype(np.int32), np.log(2 * n + 1).astype(np.float32), level)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that are not there."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


@dataclass
class LanguageModel:
    """``kinds[0]`` holds words, ``kinds[n]`` n-grams of n characters."""

    langs: list[str]
    kinds: list[Frequencies] = field(default_factory=list)

    def looked_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(kind that each word is scored by, -1 for none; and of all that words add: word, language, amount)."""
        kind = np.full(len(words), -1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def add(k: int, word: np.ndarray, place: np.ndarray, share: np.ndarray) -> None:
            f = self.kinds[k]
            n = f.starts[place + 1] - f.starts[place]
            at = np.repeat(f.starts[place] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            found.append((np.repeat(word, n), f.lang[at], f.delta[at] * np.repeat(share, n)))
            kind[word] = k

        place = self.kinds[0].find(word_hashes(pa.array(words, pa.string())))
        known = np.flatnonzero(place >= 0)
        add(0, known, place[known], np.ones(len(known)))
        left = np.flatnonzero(place < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            word, hashes = gram_hashes([words[i] for i in left.tolist()], n)
            place = self.kinds[n].find(hashes)
            word, place = word[place >= 0], place[place >= 0]
            hits = np.bincount(word, minlength=len(left))
            add(n, left[word], place, 1 / hits[word])
            left = left[hits == 0]
        return kind, *(np.concatenate(x) for x in zip(*found, strict=True))

    def scores(self, doc: np.ndarray, words: pa.Array, n_docs: int) -> np.ndarray:
        """(n_docs, languages): sums of log frequencies of ``words``, each a word of document ``doc``."""
        n_langs = len(self.langs)
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy()
        distinct = coded.dictionary.to_pylist()
        kind, word, lang, amount = self.looked_up(distinct)
        order = np.argsort(word, kind="stable")
        lang, amount = lang[order], amount[order]
        n = np.bincount(word, minlength=len(distinct))
        starts = np.cumsum(n) - n
        used = np.bincount(doc * (LONGEST + 2) + kind[which] + 1, minlength=n_docs * (LONGEST + 2)).reshape(n_docs, -1)
        out = used[:, 1:] @ np.array([f.level for f in self.kinds])
        ends = np.cumsum(n[which])
        first = 0
        while first < len(which):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _ENTRIES, side="right")))
            w, size = which[first:last], n[which[first:last]]
            at = np.repeat(starts[w] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            cell = np.repeat(doc[first:last] * n_langs, size) + lang[at]
            out += np.bincount(cell, amount[at], n_docs * n_langs).reshape(n_docs, n_langs)
            first = last
        return out


def fit(docs: DataFrame, held_out, fit_docs: int = FIT_DOCS) -> LanguageModel:
    """Learns from the rows with a lang that ``held_out`` (a Column) does not hold back."""
    spark = docs.sparkSession
    train = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & ~held_out)
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([])
    shares = spark.createDataFrame([(lang, i, min(1.0, fit_docs / sizes[lang])) for i, lang in enumerate(langs)], "lang string, lang_no int, share double")
    point = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 52)) / float(1 << 52)
    train = train.join(F.broadcast(shares), "lang").where(point < F.col("share")).select("lang_no", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            flat = [(lang, w, n) for lang, c in seen.items() for w, n in c.items() if any(map(str.isalpha, w))]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))], ["lang_no", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in parts_of(text.as_py() or ""):
                    seen[lang].update(letter_words(part))
                if sum(map(len, seen.values())) > _FLUSH:
                    yield out()
        yield out()

    def kinds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words with their numbers, and n-grams with the number of words that they are in."""
        for batch in batches:
            for first in range(0, len(batch), 20_000):
                part = batch.slice(first, 20_000)
                lang, words = part.column(0).to_numpy(), part.column(1)
                rows = [(np.zeros(len(lang), np.int32), word_hashes(words), lang, part.column(2).to_numpy())]
                for n in range(1, LONGEST + 1):
                    word, hashes = gram_hashes(words.to_pylist(), n)
                    for one in np.unique(lang).tolist():
                        keys, times = np.unique(hashes[lang[word] == one], return_counts=True)
                        rows.append((np.full(len(keys), n, np.int32), keys, np.full(len(keys), one, np.int32), times))
                kind, keys, lang, n = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(keys.view(np.int64)), pa.array(lang), pa.array(n)], ["kind", "key", "lang_no", "n"])

    counts = train.mapInArrow(count, "lang_no int, word string, n long").groupBy("lang_no", "word").agg(F.sum("n").alias("n"))
    made = counts.mapInArrow(kinds_of, "kind int, key long, lang_no int, n long").groupBy("kind", "key", "lang_no").agg(F.sum("n").alias("n"))
    found = made.select("kind", "key", "lang_no", F.col("n").cast("int").alias("n")).toArrow()  # what the bounded sample holds
    kind, keys, lang, n = (found.column(c).to_numpy() for c in ("kind", "key", "lang_no", "n"))
    present = np.unique(lang)  # a language without words takes no part
    lang = np.searchsorted(present, lang)
    model = LanguageModel([langs[i] for i in present.tolist()])
    for k in range(LONGEST + 1 if len(present) else 0):
        here = kind == k
        model.kinds.append(Frequencies.of(keys[here].view(_U), lang[here], n[here], len(present)))
    return model


def predict(docs: DataFrame, model: LanguageModel, out: str = "language") -> DataFrame:
    """``docs`` with the struct column ``out``: lang_pred and score, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size follows from the sample

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def language(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m: LanguageModel = shared.value

        def told(slice_: pa.Array) -> tuple[list[str], list[float]]:
            doc, words, letters = [], [], np.zeros(len(slice_), bool)
            sums = np.zeros((len(slice_), len(m.langs)))
            for i, text in enumerate(slice_.to_pylist() if m.langs else []):
                for part in parts_of(text or ""):
                    found = letter_words(part)
                    letters[i] |= has_letter(found)
                    words += found
                    doc.append(np.full(len(found), i))
                    if len(words) > _PART:
                        sums += m.scores(np.concatenate(doc), pa.array(words, pa.string()), len(slice_))
                        doc, words = [], []
            if words:
                sums += m.scores(np.concatenate(doc), pa.array(words, pa.string()), len(slice_))
            if not m.langs:
                return [NONE] * len(slice_), [0.0] * len(slice_)
            best = sums.argmax(1)
            odds = 1 / np.exp(np.clip(sums - sums.max(1, keepdims=True), -700, 0)).sum(1)
            return [m.langs[b] if has else NONE for b, has in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, odds, 0.0).tolist()

        for batch in texts:
            preds: list[str] = []
            scores: list[float] = []
            for first, last in common.steps(common.text_buffer(batch)[1]):
                p, s = told(batch.slice(first, last - first))
                preds += p
                scores += s
            yield pa.StructArray.from_arrays([pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return docs.withColumn(out, language(F.col("text").cast("string")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = common.fold_of(F.col("doc_id")) == 0
    model = fit(docs, held_out)
    named = predict(docs.select("doc_id", "text"), model)
    return named.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")
