"""Boolean and phrase conditions as sets of documents.

A condition is built from Term, Phrase, And, Or and Not. Each one tells for a row of the documents
whether it holds, over the array of the row's words, which is worked out once a row however many parts the
condition has: one pass over the text and no join. With an index, ``matching`` gives the same documents
from postings, for conditions that hold on few of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.operators.index import Index


class Condition:
    def holds(self, words: Column) -> Column:
        """Column: whether the condition holds for an array of words. The array is bound to a name first, so that
        the expression it comes from is not repeated for each part and each place."""
        return F.element_at(F.transform(F.array(words), self.over), 1)

    def over(self, words: Column) -> Column:
        """Column: the same over an array that is already at hand."""
        raise NotImplementedError

    def __and__(self, other: Condition) -> Condition:
        return And(self, other)

    def __or__(self, other: Condition) -> Condition:
        return Or(self, other)

    def __invert__(self) -> Condition:
        return Not(self)

    def terms(self) -> list[str]:
        """Sorted distinct terms that add to a document's score; those under Not do not."""
        return []


@dataclass(frozen=True)
class Term(Condition):
    term: str

    def over(self, words: Column) -> Column:
        return F.array_contains(words, self.term.lower())

    def terms(self) -> list[str]:
        return [self.term.lower()]


class Phrase(Condition):
    """Words that follow one another."""

    def __init__(self, *words: str) -> None:
        self.words = tuple(w.lower() for w in words)

    def over(self, words: Column) -> Column:
        first, *rest = self.words
        places = F.sequence(F.lit(1), F.size(words) - len(rest))

        def stands(i: Column) -> Column:
            out = F.element_at(words, i) == first
            for n, w in enumerate(rest, 1):
                out = out & (F.element_at(words, i + n) == w)
            return out

        return F.array_contains(words, first) & (F.size(words) >= len(self.words)) & F.exists(F.when(F.size(words) >= len(self.words), places), stands)

    def terms(self) -> list[str]:
        return sorted(set(self.words))


class And(Condition):
    def __init__(self, *parts: Condition) -> None:
        self.parts = parts

    def over(self, words: Column) -> Column:
        out = self.parts[0].over(words)
        for p in self.parts[1:]:
            out = out & p.over(words)
        return out

    def terms(self) -> list[str]:
        return sorted({t for p in self.parts for t in p.terms()})


class Or(And):
    def over(self, words: Column) -> Column:
        out = self.parts[0].over(words)
        for p in self.parts[1:]:
            out = out | p.over(words)
        return out


@dataclass(frozen=True)
class Not(Condition):
    part: Condition

    def over(self, words: Column) -> Column:
        return ~self.part.over(words)


def matching(index: Index, condition: Condition) -> DataFrame:
    """(doc_id) of the documents of an index for which a condition without phrases holds."""
    universe = index.lengths.select("doc_id").distinct()
    if isinstance(condition, Term):
        return index.postings.where(F.col("term") == condition.term.lower()).select("doc_id").distinct()
    if isinstance(condition, Not):
        return universe.join(matching(index, condition.part), "doc_id", "left_anti")
    if isinstance(condition, Or):
        found = matching(index, condition.parts[0])
        for p in condition.parts[1:]:
            found = found.unionByName(matching(index, p))
        return found.distinct()
    if isinstance(condition, And):
        found = matching(index, condition.parts[0])
        for p in condition.parts[1:]:
            found = found.join(matching(index, p), "doc_id", "left_semi")
        return found
    raise TypeError("phrases need the words of the documents: use holds()")
