"""Label model for votes of overlapping heuristics, shared by the quality rules and the classifier.

A row is good or bad, and heuristics vote -1 (bad), 0 (abstain) or 1 (good) with rates that depend on
what the row is (Dawid & Skene, 1979; an abstention is no evidence). Rows are bad in different ways,
each of which few heuristics see; a single bad class would explain the commonest way and call
the others good. So bad is a mixture with one part for each heuristic, and the posterior of good is
one minus that of all parts.

All rates, those of bad votes on good rows included, are estimated from the rows, under weak Beta priors
that count as a few dozen votes. What tells an accurate heuristic from an inaccurate one is agreement:
bad votes that others confirm make a way of being bad, and a heuristic whose bad votes stand alone
far more often than that way explains has them counted as errors on good rows.

Expectation-maximisation runs over the counts of distinct vote patterns: Spark groups all rows by
pattern, and the groups, at most 3 to the number of voters however many rows there are, are what the
driver sees.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_VOTERS = 10  # 59,049 patterns at most reach the driver
#: Beta priors as numbers of bad and good votes: of any voter on good rows, of a voter on rows that are bad in
#: its own way, and of one on rows that are bad in another's way.
ON_GOOD, ON_OWN, ON_OTHER = (2.0, 38.0), (8.0, 2.0), (2.0, 6.0)
#: Where the rounds begin: the probability of good for rows with no bad vote, one, and more.
FIRST_GOOD = (0.99, 0.5, 0.02)


@dataclass(frozen=True)
class LabelModel:
    """``rates[c, j]``: how often voter j, if it votes, votes bad and good on class c, which is 0 for
    good and 1 + i for the part of bad that voter i is named for; ``shares[c]``: how common it is."""

    names: tuple[str, ...]
    shares: np.ndarray
    rates: np.ndarray

    def accuracies(self) -> dict[str, float]:
        """For each voter, the share of its votes that are right, abstentions aside."""
        good = self.shares[0] * self.rates[0]
        bad = np.einsum("c,cjv->jv", self.shares[1:], self.rates[1:])
        right, cast = good[:, 1] + bad[:, 0], good.sum(1) + bad.sum(1)
        return dict(zip(self.names, (right / np.maximum(cast, 1e-300)).tolist(), strict=True))

    def posterior(self, votes: Column) -> Column:
        """Column: probability of good, from built-in functions only."""

        def ratio(c: int) -> Column:  # of class c to good, for this row's votes
            total = F.lit(math.log(self.shares[c]) - math.log(self.shares[0]))
            for j, odds in enumerate(np.log(self.rates[c]) - np.log(self.rates[0])):
                vote = F.element_at(votes, j + 1)
                total = total + F.when(vote == -1, float(odds[0])).when(vote == 1, float(odds[1])).otherwise(0.0)
            return F.exp(total)

        return F.lit(1.0) / (F.lit(1.0) + sum((ratio(c) for c in range(2, len(self.shares))), ratio(1)))


def expectation_maximisation(
    patterns: np.ndarray, counts: np.ndarray, names: Sequence[str], rounds: int = 500
) -> LabelModel:
    """Fits the model to patterns (k, voters) with their numbers of rows.

    It begins from "a row with several bad votes is bad in the ways of these voters, one with a single bad
    vote may be either" and stops when the posteriors settle. Without rows, the priors are the model.
    """
    n_voters = len(names)
    weight = counts.astype(float)
    bad = (patterns == -1).astype(float).reshape(len(patterns), n_voters)
    hot = np.stack([patterns == v for v in (-1, 1)], axis=-1).astype(float).reshape(len(patterns), n_voters, 2)
    n_bad = bad.sum(1, keepdims=True)
    good = np.choose(np.minimum(n_bad, 2).astype(int), FIRST_GOOD)
    ways = np.where(n_bad == 0, 1 / n_voters, bad / np.maximum(n_bad, 1))
    member = np.concatenate([good, (1 - good) * ways], axis=1)
    prior = np.tile(np.array(ON_OTHER), (n_voters + 1, n_voters, 1))
    prior[0] = ON_GOOD
    prior[np.arange(1, n_voters + 1), np.arange(n_voters)] = ON_OWN
    for _ in range(rounds):
        shares = member.T @ weight + 1
        shares /= shares.sum()
        rates = np.einsum("kc,k,kjv->cjv", member, weight, hot) + prior
        rates /= rates.sum(-1, keepdims=True)
        scores = np.einsum("kjv,cjv->kc", hot, np.log(rates)) + np.log(shares)
        now = np.exp(scores - scores.max(1, initial=-np.inf, keepdims=True))
        now /= now.sum(1, keepdims=True)
        moved, member = np.abs(now - member).max(initial=0), now
        if moved < 1e-9:
            break
    return LabelModel(tuple(names), shares, rates)


def fit_label_model(votes: DataFrame, column: str, names: Sequence[str]) -> LabelModel:
    """Groups all rows by vote pattern and fits the model to the groups."""
    if len(names) > MAX_VOTERS:
        raise ValueError(f"at most {MAX_VOTERS} voters, got {len(names)}")
    rows = votes.groupBy(F.col(column).alias("votes")).count().orderBy("votes").collect()
    patterns = np.array([r["votes"] for r in rows], np.int64).reshape(len(rows), len(names))
    return expectation_maximisation(patterns, np.array([r["count"] for r in rows], np.int64), names)
