"""Filter predicates with two-valued logic, as Columns.

A predicate over a missing or mistyped value is false and never null, so its negation is true. Each is
written in the plain form that a scan can push down, and coalesced only where a null could be seen: by
``not_``, ``ne``, ``not_in`` and ``all_of``/``any_of`` of those. A WHERE drops nulls and false alike, so
the plain form gives the same rows.

Fields of schemaless documents come from ``json_field``, which keeps missing, null and kinds apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
EARTH_METRES = 6_371_000.0


def _sure(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def _is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def eq(field: Column, value) -> Column:
    """Equal; numbers of floating type within EPSILON. ``None`` asks for a null."""
    if value is None:
        return field.isNull()
    return F.abs(field - F.lit(value)) < EPSILON if isinstance(value, float) else field == F.lit(value)


def ne(field: Column, value) -> Column:
    return ~_sure(eq(field, value))


def gt(field: Column, value) -> Column:
    return field > F.lit(value)


def ge(field: Column, value) -> Column:
    return field >= F.lit(value)


def lt(field: Column, value) -> Column:
    return field < F.lit(value)


def le(field: Column, value) -> Column:
    return field <= F.lit(value)


def between(field: Column, low, high) -> Column:
    """Both ends included."""
    return field.between(F.lit(low), F.lit(high))


def in_(field: Column, values: Sequence) -> Column:
    if any(isinstance(v, float) for v in values):
        return reduce(lambda a, b: a | b, (eq(field, v) for v in values), F.lit(False))
    return field.isin(list(values)) if values else F.lit(False)


def not_in(field: Column, values: Sequence) -> Column:
    return ~_sure(in_(field, values))


def is_null(field: Column) -> Column:
    return field.isNull()


def is_not_null(field: Column) -> Column:
    return field.isNotNull()


def contains(field: Column, part: str) -> Column:
    return field.contains(part)


def starts_with(field: Column, part: str) -> Column:
    return field.startswith(part)


def ends_with(field: Column, part: str) -> Column:
    return field.endswith(part)


def like(field: Column, pattern: str) -> Column:
    """``%`` and ``_``; a backslash is a plain character."""
    return field.like(pattern.replace("\\", "\\\\"))


def geo_box(point: Column, top: float, right: float, bottom: float, left: float) -> Column:
    """Inside a box of latitudes and longitudes, both ends included; boxes do not wrap."""
    _check_degrees(top, right)
    _check_degrees(bottom, left)
    return point["lat"].between(bottom, top) & point["lng"].between(left, right)


def geo_metres(point: Column, lat: float, lng: float) -> Column:
    """Great-circle distance by the haversine formula."""
    d_lat, d_lng = F.radians(point["lat"] - lat), F.radians(point["lng"] - lng)
    a = F.sin(d_lat / 2) * F.sin(d_lat / 2) + F.cos(F.radians(F.lit(lat))) * F.cos(F.radians(point["lat"])) * F.sin(d_lng / 2) * F.sin(d_lng / 2)
    return 2 * EARTH_METRES * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def geo_radius(point: Column, lat: float, lng: float, metres: float) -> Column:
    _check_degrees(lat, lng)
    return geo_metres(point, lat, lng) <= metres


def _check_degrees(lat: float, lng: float) -> None:
    if not (-90 <= lat <= 90 and -180 <= lng <= 180):
        raise ValueError(f"latitude {lat} or longitude {lng} is out of range")


def not_(p: Column) -> Column:
    return ~_sure(p)


def all_of(*ps: Column) -> Column:
    return reduce(lambda a, b: a & b, ps, F.lit(True))


def any_of(*ps: Column) -> Column:
    return reduce(lambda a, b: a | b, map(_sure, ps), F.lit(False))


class JsonField:
    """A top-level field of a JSON document; dots in its name are part of the name."""

    def __init__(self, document: Column, name: str) -> None:
        self.value = F.variant_get(F.try_parse_json(document), f"$['{name}']", "variant")
        self.kind = F.schema_of_variant(self.value)
        self.text = F.get_json_object(document, f"$['{name}']")

    def exists(self) -> Column:
        """Whether the key is there, even with a null."""
        return self.value.isNotNull()

    def is_null(self) -> Column:
        """Null or missing."""
        return self.value.isNull() | F.is_variant_null(self.value)

    def number(self) -> Column:
        """The value if it is a number, else null: neither booleans nor strings turn into numbers."""
        return F.when(self.kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.expr("1.0") * self.text.cast("double"))

    def string(self) -> Column:
        return F.when(self.kind == "STRING", self.text)

    def boolean(self) -> Column:
        return F.when(self.kind == "BOOLEAN", self.text.cast("boolean"))


def json_field(document: Column, name: str) -> JsonField:
    return JsonField(document, name)
