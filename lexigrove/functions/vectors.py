"""Similarities of dense, sparse and multi-vectors, and quantised codes, as built-in Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; 0 for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths, empty vectors and zero norms."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > 0), dot(a, b) / both).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    """Distance; infinite for vectors of different lengths."""
    squares = _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))
    return F.when(F.size(a) == F.size(b), F.sqrt(squares)).otherwise(float("inf"))


METRICS = {"cosine": cosine, "dot": dot, "euclidean": lambda a, b: -euclidean(a, b)}


def sparse(a: Column) -> Column:
    """Map from place to value, without zeros."""
    pairs = F.transform(_double(a), lambda x, i: F.struct(i.alias("key"), x.alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] != 0))


def sparse_dot(a: Column, b: Column) -> Column:
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return _sum(F.transform(shared, lambda k: F.element_at(a, k) * F.element_at(b, k)))


def sparse_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(F.map_values(a), lambda x: x * x)))


def sparse_cosine(a: Column, b: Column) -> Column:
    both = sparse_norm(a) * sparse_norm(b)
    return F.when(both > 0, sparse_dot(a, b) / both).otherwise(0.0)


def dimension(dense: Column) -> Column:
    return F.size(dense)


def sparse_dimension(a: Column) -> Column:
    """The larger of the number of values and the highest place plus one."""
    return F.greatest(F.size(a), F.coalesce(F.array_max(F.map_keys(a)) + 1, F.lit(0)))


def max_similarity(query: Column, document: Column) -> Column:
    """Late interaction: for each query vector its best product with a document vector, summed."""

    def best(q: Column) -> Column:
        fit = F.filter(document, lambda d: F.size(d) == F.size(q))
        return F.coalesce(F.array_max(F.transform(fit, lambda d: dot(q, d))), F.lit(0.0))

    return _sum(F.transform(query, best))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Similarity of two structs ``dense`` (array), ``sparse`` (map) and ``multi`` (array of arrays), of which one is
    set. Dense pairs go by the metric, sparse ones by cosine or product (0 under any other), multi-vectors always by
    late interaction; of different kinds it is 0."""
    sparse_by = {"cosine": sparse_cosine, "dot": sparse_dot}.get(metric, lambda x, y: F.lit(0.0))
    both = lambda kind: a[kind].isNotNull() & b[kind].isNotNull()
    return (
        F.when(both("dense"), METRICS[metric](a["dense"], b["dense"]))
        .when(both("sparse"), sparse_by(a["sparse"], b["sparse"]))
        .when(both("multi"), max_similarity(a["multi"], b["multi"]))
        .otherwise(0.0)
    )


def embedding_dimension(a: Column) -> Column:
    """Dimensions of a struct like that of ``similarity``; of multi-vectors, those of the first."""
    first = F.size(F.get(a["multi"], F.lit(0)))
    return F.coalesce(F.when(a["dense"].isNotNull(), F.size(a["dense"])), F.when(a["sparse"].isNotNull(), sparse_dimension(a["sparse"])), F.when(a["multi"].isNotNull(), F.greatest(first, F.lit(0))), F.lit(0))


def sign_bits(a: Column) -> Column:
    """Binary code: whether each component is above zero."""
    return F.transform(a, lambda x: (x > 0).cast("int"))


def sign_distance(a: Column, b: Column) -> Column:
    """-1 for equal codes, 1 for opposite ones."""
    differ = _sum(F.zip_with(a, b, lambda x, y: (x != y).cast("double")))
    return 2 * differ / F.size(a) - 1


def scalar_code(a: Column, low: Column, span: Column) -> Column:
    """8-bit code of each component on its own calibrated range."""
    share = F.zip_with(F.zip_with(_double(a), low, lambda x, l: x - l), span, lambda x, s: x / s)
    return F.transform(share, lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 255).cast("int"))


def scalar_value(code: Column, low: Column, span: Column) -> Column:
    """What a scalar code stands for."""
    return F.zip_with(F.zip_with(code, span, lambda c, s: c / 255.0 * s), low, lambda x, l: x + l)
