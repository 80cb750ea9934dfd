r"""URL filters by a bit-parallel wildcard automaton (operator 10).

A rule is a pair of globs, for the host and for the path. Its pattern, ``host-glob``, a boundary
symbol and ``path-glob``, becomes a run of bits in a row of 64-bit words, one bit for each symbol,
and all rules lie side by side in that row. One Shift-And step moves every rule over one symbol of
the URL; a ``*`` is a bit that, once reached, stays set. The steps run over a batch of URLs at a
time, so the work for each symbol of a URL is a few numpy operations on short rows of words.

A canonical URL is ``.host``, the boundary symbol, then the path. The boundary is no byte, so no
``*`` of the host side can reach into the path: bytes and boundary have different masks.

Edge cases: null, and a URL without ``://``, have an empty host and path; only rules that match
those apply, else the default verdict. Repeated URLs get equal rows. Long URLs are matched whole.
Only ``page_id`` and ``url`` are read, so columns of other names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import common

_BOUNDARY = 256  # the symbol between host and path; bytes are 0 to 255


@dataclass(frozen=True)
class UrlRule:
    """A glob rule. ``*`` stands for any run of bytes and ``?`` for one; both stay on their side."""

    host: str
    path: str
    verdict: str
    name: str | None = None
    rank: int = 0  # of the rules that fit a URL, the highest rank wins, then the first listed


def domain_rule(host: str, path: str, verdict: str) -> UrlRule:
    """A host with all its subdomains, and paths that begin with ``path``; longer rules win."""
    return UrlRule(f"*.{host}", f"{path}*", verdict, f"{host}{path}", len(host) + len(path))


def _symbols(rule: UrlRule) -> list[int]:
    """Byte values, _BOUNDARY, -1 for ``?`` and -2 for ``*``."""
    side = lambda glob: [{"?": -1, "*": -2}.get(chr(b), b) for b in glob.encode()]
    return [*side(rule.host), _BOUNDARY, *side(rule.path)]


class GlobAutomaton:
    """Shift-And masks of all rules, packed into rows of 64-bit words.

    Each rule takes one bit for its start and one for each of its symbols; ``*`` takes none of its
    own but makes the bit before it stick. Bit k of a rule is set when its first k symbols match.
    """

    def __init__(self, rules: Sequence[UrlRule]) -> None:
        self.rules = list(rules)
        starts, finals, sticks, consumes = [], [], [], []
        at = 0
        for rule in self.rules:
            starts.append(at)
            side = "host"
            for symbol in _symbols(rule):
                if symbol == -2:
                    sticks.append((at, side))
                    continue
                at += 1
                consumes.append((at, symbol, side))
                side = "path" if symbol == _BOUNDARY else side
            finals.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.masks = np.zeros((257, self.words), np.uint64)  # bits that a symbol lets one arrive at
        self.stick = np.zeros((257, self.words), np.uint64)  # bits that a symbol lets one stay at
        for bit, symbol, _ in consumes:
            self._set(self.masks, slice(0, 256) if symbol == -1 else symbol, bit)
        for bit, _ in sticks:
            self._set(self.stick, slice(0, 256), bit)
        self.start = np.zeros(self.words, np.uint64)
        for bit in starts:
            self._set(self.start[None], 0, bit)
        self.final = [(bit // 64, np.uint64(bit % 64)) for bit in finals]

    @staticmethod
    def _set(rows: np.ndarray, which, bit: int) -> None:
        rows[which, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def matches(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """Boolean (urls, rules): all rules against all URLs, one symbol of every URL at each step."""
        texts = [f".{h}".encode("utf-8", "surrogatepass") for h in hosts]
        tails = [p.encode("utf-8", "surrogatepass") for p in paths]
        lengths = np.array([len(a) + 1 + len(b) for a, b in zip(texts, tails, strict=True)], np.int64)
        order = np.argsort(-lengths, kind="stable")  # the URLs still running are always the first ones
        ends = np.concatenate(([0], np.cumsum(lengths)))
        flat = np.empty(int(ends[-1]), np.int16)
        for i, (a, b) in enumerate(zip(texts, tails, strict=True)):
            middle = ends[i] + len(a)
            flat[ends[i] : middle] = np.frombuffer(a, np.uint8)
            flat[middle] = _BOUNDARY
            flat[middle + 1 : ends[i + 1]] = np.frombuffer(b, np.uint8)
        begin, left = ends[:-1][order], lengths[order]
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, side="left"))
            symbol, now = flat[begin[:live] + step], state[:live]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[:live] = (shifted & self.masks[symbol]) | (now & self.stick[symbol])
        out = np.empty((len(texts), len(self.rules)), bool)
        for j, (word, bit) in enumerate(self.final):
            out[order, j] = (state[:, word] >> bit) & one != 0
        return out


def host_of(url: Column) -> Column:
    """Column: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """Column: after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(
    pages: DataFrame, rules: Sequence[UrlRule], default: str = "allow", url: str = "url", key: str = "page_id"
) -> DataFrame:
    """key, host, path, rule (the winner's name, null if it has none or none fits) and verdict."""
    order = sorted(range(len(rules)), key=lambda i: (-rules[i].rank, i))
    ranked = [rules[i] for i in order]
    names = [r.name for r in ranked] + [None]
    verdicts = [r.verdict for r in ranked] + [default]
    kind = dict(pages.dtypes)[key]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(ranked)
        for batch in batches:
            hit = automaton.matches(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            first = np.where(hit.any(1), hit.argmax(1), len(ranked)) if hit.shape[1] else np.zeros(len(hit), int)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([names[i] for i in first], pa.string()), pa.array([verdicts[i] for i in first], pa.string())],
                ["k", "host", "path", "rule", "verdict"],
            )

    cut = pages.select(F.col(key).alias("k"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return cut.mapInArrow(judge, f"k {kind}, host string, path string, rule string, verdict string").withColumnRenamed("k", key)


#: The rules of the query (host, path, verdict).
QUERY_DOMAIN_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Host globs that are blocked where no domain rule fits. They carry no rule name.
QUERY_BLOCKED_HOSTS = ("*.spam-*", "*.cheap-*", "*casino*", "*.ads-*", "*.free-bets.*", "*track*.*")


def query_rules() -> list[UrlRule]:
    named = [domain_rule(*r) for r in QUERY_DOMAIN_RULES]
    return named + [UrlRule(host, "*", "block", None, -1) for host in QUERY_BLOCKED_HOSTS]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.table(spark, sf_dir, "pages"), query_rules())


def op10_sql() -> str:
    def fits(host: str, path: str) -> str:
        return f"(('.' || host) LIKE '%.{host}' AND starts_with(path, '{path}'))"

    longest = sorted(QUERY_DOMAIN_RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest)
    blocked = " OR ".join(f"('.' || host) LIKE '{g.replace('*', '%')}'" for g in QUERY_BLOCKED_HOSTS)
    return f"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict
FROM cut"""
