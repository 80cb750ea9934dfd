"""Collections: named tables of documents with a key, settings and rules, kept in a table of their own."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions import checks
from lexigrove.operators import index
from lexigrove.operators.search import Collection, Request, Rule, multi_search
from lexigrove.sources import shared
from lexigrove.sources.versions import Table

_SCHEMA = "name string, path string, settings string, rules string"


@dataclass(frozen=True)
class Settings:
    """What a collection is indexed and searched by; no searchable fields means all text columns."""

    key: str = "id"
    searchable: tuple[str, ...] = ()
    stop_words: tuple[str, ...] = ()
    stem: bool = False
    weights: dict[str, float] = field(default_factory=dict)
    separator: str = " "


@dataclass(frozen=True)
class _Entry:
    path: str
    settings: Settings
    rules: tuple[Rule, ...] = ()


def _tuples(value):
    """JSON arrays as tuples, at any depth."""
    return tuple(map(_tuples, value)) if isinstance(value, list) else value


class Catalog:
    """Creates, changes and drops collections. Each change is a version of the catalog's table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.table = Table(spark, f"{self.path}/catalog")

    def _entries(self) -> dict[str, _Entry]:
        rows = self.table.read().collect() if self.table.versions() else []  # a row for each collection
        made = lambda kind, d: kind(**{k: _tuples(v) for k, v in d.items()})
        return {r["name"]: _Entry(r["path"], made(Settings, json.loads(r["settings"])), tuple(made(Rule, d) for d in json.loads(r["rules"]))) for r in rows}

    def _save(self, entries: dict[str, _Entry]) -> None:
        rows = [(n, e.path, json.dumps(asdict(e.settings)), json.dumps([asdict(r) for r in e.rules])) for n, e in sorted(entries.items())]
        self.table.write(self.spark.createDataFrame(rows, _SCHEMA).coalesce(1))

    def _entry(self, name: str) -> _Entry:
        entries = self._entries()
        if name not in entries:
            raise KeyError(f"no collection {name}")
        return entries[name]

    def create(self, name: str, settings: Settings = Settings()) -> None:  # noqa: B008
        entries = self._entries()
        if not re.match(checks.COLLECTION_NAME, name) or name in checks.RESERVED_NAMES or name in entries:
            raise ValueError(f"collection {name!r} exists or has no valid name")
        self._save(entries | {name: _Entry(f"{self.path}/data/{name}-{len(self.table.versions())}", settings)})

    def names(self) -> list[str]:
        return sorted(self._entries())

    def drop(self, name: str) -> None:
        """Takes the name out; files stay for readers that still have them open."""
        self._entry(name)
        self._save({n: e for n, e in self._entries().items() if n != name})

    def swap(self, first: str, second: str) -> None:
        """Exchanges the documents, settings and rules of two collections at once."""
        a, b = self._entry(first), self._entry(second)
        self._save(self._entries() | {first: b, second: a})

    def settings(self, name: str) -> Settings:
        return self._entry(name).settings

    def change(self, name: str, **changes) -> None:
        entry = self._entry(name)
        self._save(self._entries() | {name: replace(entry, settings=replace(entry.settings, **changes))})

    def rules(self, name: str) -> tuple[Rule, ...]:
        return self._entry(name).rules

    def put_rules(self, name: str, rules: Sequence[Rule]) -> None:
        """Keeps the rules of a collection, in place of those it had. Filters and sort keys must be texts."""
        for r in rules:
            if not isinstance(r.filter, str | None) or not all(isinstance(k, str) for k in r.sort):
                raise TypeError(f"rule {r.name or r.query}: stored filters are SQL, stored sort keys field:asc or field:desc")
        self._save(self._entries() | {name: replace(self._entry(name), rules=tuple(rules))})

    def documents(self, name: str) -> DataFrame:
        return Table(self.spark, self._entry(name).path).read()

    def get(self, name: str, ids: DataFrame) -> DataFrame:
        """The documents whose key is in ``ids``; a filter on few keys reaches the scan."""
        return self.documents(name).join(ids, self.settings(name).key, "left_semi")

    def add(self, name: str, docs: DataFrame, merge: bool = False) -> None:
        """Upserts documents, whole or (``merge``) field by field. A batch with a null, empty or repeated key is refused
        as a whole, and so is a key that is neither text nor number."""
        entry = self._entry(name)
        key = entry.settings.key
        checks.as_key(key, docs.schema[key].dataType)
        if not index.repeated_keys(docs, key).isEmpty():
            raise ValueError(f"null, empty or repeated {key} in the batch")
        table = Table(self.spark, entry.path)
        change = index.merge if merge else index.upsert
        table.write(change(table.read(), docs, key) if table.versions() else docs)

    def delete(self, name: str, ids: DataFrame | None = None) -> None:
        """Deletes the documents whose key is in ``ids``, or all."""
        entry = self._entry(name)
        table = Table(self.spark, entry.path)
        rows = table.read()
        table.write(rows.limit(0) if ids is None else rows.join(ids, entry.settings.key, "left_anti"))

    def collection(self, name: str) -> Collection:
        """The collection, ready to be searched. Its index is written once for each version of documents and settings."""
        entry = self._entry(name)
        s, docs = entry.settings, self.documents(name)
        fields = list(s.searchable) or [c for c, kind in docs.dtypes if kind == "string" and c != s.key]
        version = Table(self.spark, entry.path).versions()[-1]
        how = hashlib.md5(json.dumps([fields, s.key, s.stop_words, s.stem, s.separator]).encode()).hexdigest()[:12]
        path = f"{entry.path}-index/{version}-{how}"
        if not shared.exists(self.spark, f"{path}/numbers/_SUCCESS"):
            shared.delete(self.spark, path)
            index.build(docs, fields, s.key, stop_words=s.stop_words, stem=s.stem, separator=s.separator).write(path)
        made = index.load(self.spark, path)
        return Collection(docs, made, s.key, fields[0], fields, stop_words=s.stop_words, stem=s.stem, weights=s.weights, rules=entry.rules)

    def search(self, requests: Sequence[tuple[str, Request]]) -> DataFrame:
        """``multi_search`` over collections by name; one that is not there gives no rows."""
        names = set(self.names())
        return multi_search(self.spark, [(self.collection(n) if n in names else None, r) for n, r in requests])

    def stats(self) -> DataFrame:
        """(name, documents) of all collections with documents."""
        return self.field_counts().where("field is null").select("name", F.col("n").alias("documents"))

    def field_counts(self) -> DataFrame:
        """(name, field, n): for each collection and field the documents that have a value; field null: all of them."""
        out = self.spark.createDataFrame([], "name string, field string, n long")
        for name, entry in self._entries().items():
            table = Table(self.spark, entry.path)
            if table.versions():
                rows = table.read()
                sums = rows.agg(F.count("*").alias("__all"), *(F.count(c).alias(c) for c in rows.columns))
                pairs = F.array(*(F.struct(F.lit(None if c == "__all" else c).cast("string").alias("field"), F.col(c).alias("n")) for c in sums.columns))
                out = out.unionByName(sums.select(F.lit(name).alias("name"), F.explode(pairs).alias("x")).select("name", "x.field", "x.n"))
        return out

    def totals(self) -> DataFrame:
        """One row: collections with documents, and documents, over the whole catalog."""
        return self.stats().agg(F.count("*").alias("collections"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))
