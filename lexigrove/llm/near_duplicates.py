"""Near-duplicate documents by MinHash bands and odd sketches (operator 3).

A document's set holds its distinct shingles of ``width`` words, A-Z lower-cased; with fewer words, the
whole sequence is the one shingle. Documents are linked if 100 * |A and B| >= percent * |A or B|.

1. One pass over the text gives each document a fingerprint of its whole set, the keys of its MinHash
   bands, and an odd sketch (Mitzenmacher, Pagh & Pham, 2014): each of 4,096 bins of the hash range
   gives its least shingle as a sample, and each sample flips one of 2,048 bits. The samples that two
   documents do not share are what is left in the exclusive or of their bitmaps, so its population
   count tells high similarities apart much better than equal bands do.
2. Documents with equal sets become one class, of which one row goes on. However many exact copies or
   repeated rows there are, they cost one aggregation and never become pairs.
3. The number of bands makes the chance that a pair at the threshold shares none at most ``miss``. In
   each bucket every member is paired with one root, the member with the most company in all its
   buckets, and these pairs are confirmed on full sets. That joins most of a group with as many pairs
   as members.
4. What is left are pairs of a bucket that lie in different components. Each such bucket is dealt out
   in cells of bounded size that meet two blocks of members; members of one large component have blocks of
   their own, which never meet each other, so a large group that its root has joined costs one visit for
   each block of what is outside it. A cell compares its members' odd sketches; only pairs that the
   sketches deem similar leave it, to be confirmed on full sets. No bucket is cut or skipped.
5. Connected components of all confirmed links and of the classes that share an id, the least id naming each.

The sketch test refuses a pair only if its estimate is below the threshold by SIGMAS standard
deviations, so it hardly ever refuses a link, and it never makes one.

Edge cases: a null or empty text, or one of white space, has an empty set and is linked with nothing.
A null ``doc_id`` takes no part: its component is null and it is kept. Rows that share a ``doc_id`` are
one document with several texts: what links with one of them is linked with all, and all have one
component, an empty one among them included. Texts of any length are taken whole. Only ``doc_id`` and
``text`` are read.

What grows faster than the input is the number of pairs in one bucket that lie below the threshold in
different components, which the cells must compare.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import common
from lexigrove.llm.common import mix
from lexigrove.llm.components import components

ROWS_A_BAND = 4
MISS = 1e-7
BINS, SKETCH_BITS = 4096, 2048
SIGMAS = 5  # by which a sketch's estimate may fall short: a chance of 3e-7, near that of the bands
CELL = 1024  # members of one side of a cell, about
_U = np.uint64
_PLACE = mix(np.arange(1, 65, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)  # odd factors by place in a shingle
_FACTOR = mix(np.arange(1, 4097, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)  # of the MinHash functions


def band_count(percent: int, rows: int = ROWS_A_BAND, miss: float = MISS) -> int:
    """Bands for which a pair at the threshold shares none with a chance of ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, one after the other; their number for each row)."""
    words, counts = common.split_words(data, offsets)
    n = len(words) - width + 1
    joined = np.zeros(max(n, 0), _U)
    for i in range(width if n > 0 else 0):
        joined += words[i : i + n] * _PLACE[i]
    joined = mix(joined)
    ends = np.cumsum(counts)
    sets = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= width:
            sets.append(np.unique(joined[end - count : end - width + 1]))
        elif count:
            whole = np.sum(words[end - count : end] * _PLACE[:count], keepdims=True)
            sets.append(mix(whole + np.array([count], _U) * _PLACE[63:]))
        else:
            sets.append(np.empty(0, _U))
    return (np.concatenate(sets) if sets else np.empty(0, _U)), np.array([len(s) for s in sets], np.int64)


def fingerprints(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each set that tell it from all others; 0 and 0 for an empty set."""
    full = np.flatnonzero(counts)
    f1, f2 = np.zeros(len(counts), _U), np.zeros(len(counts), _U)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        f1[full] = np.add.reduceat(mix(values ^ _U(0x2545F4914F6CDD1D)), starts)
        f2[full] = np.bitwise_xor.reduceat(mix(values ^ _U(0x9FB21C651E98DF25)), starts)
    return f1.view(np.int64), f2.view(np.int64)


def min_hash_bands(values: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64 (sets, bands): keys of the bands of sets that begin at ``starts``, none of them empty."""
    keys = np.empty((len(starts), bands), _U)
    for band in range(bands):
        key = np.full(len(starts), band + 1, _U)
        for row in range(rows):
            key = mix(key ^ np.minimum.reduceat(values * _FACTOR[band * rows + row], starts))
        keys[:, band] = key
    return keys.view(np.int64)


def odd_sketches(values: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitmaps (rows, SKETCH_BITS / 8), number of samples of each row) of sorted sets."""
    bins = row * BINS + (values >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = bins[1:] != bins[:-1]
    place = (mix(values[first] ^ _U(0x5851F42D4C957F2D)) % _U(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(row[first] * SKETCH_BITS + place, minlength=n_rows * SKETCH_BITS) & 1
    return np.packbits(odd.reshape(n_rows, SKETCH_BITS).astype(np.uint8), axis=1), np.bincount(row[first], minlength=n_rows)


def may_link(differing: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, samples_a: np.ndarray, samples_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches that differ in so many bits may come from documents linked by ``percent``.

    The differing bits give the samples that are not shared, and so the shared ones. A pair at the
    threshold would share t of the bins that its union fills; the estimate may fall short of that by SIGMAS
    standard deviations. Those are of sampling (less the more of the union is sampled) and of samples
    that meet in one bit of the sketch.
    """
    t = percent / 100
    share = np.minimum(2 * differing / SKETCH_BITS, 0.999)
    apart = -SKETCH_BITS / 2 * np.log1p(-share)
    union = (sizes_a + sizes_b) / (1 + t)
    filled = BINS * -np.expm1(-union / BINS)
    variance = filled * t * (1 - t) * (1 - filled / union) + (apart / (1 - share)) ** 2 / (2 * SKETCH_BITS) + 0.25
    return (samples_a + samples_b - apart) / 2 >= t * filled - SIGMAS * np.sqrt(variance)


def signatures(docs: DataFrame, width: int, bands: int, rows: int = ROWS_A_BAND) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (fingerprint of the set), samples, sketch, bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_buffer(batch.column(1))
            for first, last in common.steps(offsets):
                values, counts = shingle_sets(data, offsets[first : last + 1], width)
                full = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[full]
                row = np.repeat(np.arange(len(full)), counts[full])
                f1, f2 = fingerprints(values, counts)
                keys: list = [None] * len(counts)
                sketches: list = [None] * len(counts)
                samples = np.zeros(len(counts), np.int32)
                if len(full):
                    found = min_hash_bands(values, starts, bands, rows)
                    bitmaps, samples[full] = odd_sketches(values, row, len(full))
                    for i, at in enumerate(full.tolist()):
                        keys[at], sketches[at] = found[i], bitmaps[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first), pa.array(counts), pa.array(f1), pa.array(f2),
                        pa.array(samples), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "f1", "f2", "samples", "sketch", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        sign, "doc_id long, n_shingles long, f1 long, f2 long, samples int, sketch binary, bands array<long>"
    )


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 and shingles: the whole set of each row, as sorted 64-bit values."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_buffer(batch.column(1))
            for first, last in common.steps(offsets):
                values, counts = shingle_sets(data, offsets[first : last + 1], width)
                ends = np.cumsum(counts)
                blobs = [values[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                f1, f2 = fingerprints(values, counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(counts), pa.array(f1), pa.array(f2), pa.array(blobs, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "shingles"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(collect, "doc_id long, n_shingles long, f1 long, f2 long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets pass the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(test, "a long, b long")


def similar_across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's members in different components whose odd sketches may link.

    ``rows``: key, size, node, component, n_shingles, samples, sketch, bands. A pair that shares several
    buckets comes from the first of its bands only.
    """
    spread = rows.where(F.col("size") > CELL)
    # Blocks of a bucket: one or more for each component of more than CELL members, and those that the others share. A
    # bucket's list has a name for each CELL members.
    parts = spread.groupBy("key", "component").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    large = F.when(F.col("n") > CELL, F.struct("component", blocks.alias("blocks")))
    mixed = F.ceil(F.sum(F.when(F.col("n") <= CELL, F.col("n"))) / CELL).cast("int")
    layout = parts.groupBy("key").agg(F.map_from_entries(F.collect_list(large)).alias("own"), F.coalesce(mixed, F.lit(0)).alias("shared"))
    numbered = lambda name, n: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)), lambda i: F.concat(name, F.lit("-"), i.cast("string")))
    members = spread.join(layout, "key").withColumn("mine", F.col("own")[F.col("component")])
    share = F.when(F.col("mine").isNotNull(), F.pmod(F.hash("node"), F.col("mine"))).otherwise(F.pmod(F.hash("component"), F.col("shared")))
    name = F.when(F.col("mine").isNotNull(), F.col("component").cast("string")).otherwise(F.lit(""))
    # A component's own blocks do not meet; all others do, and the shared ones also meet themselves.
    foreign = F.filter(F.map_entries("own"), lambda e: F.col("mine").isNull() | (e["key"] != F.col("component")))
    others = F.concat(F.flatten(F.transform(foreign, lambda e: numbered(e["key"].cast("string"), e["value"]))), F.coalesce(numbered(F.lit(""), F.col("shared")), F.array().cast("array<string>")))
    dealt = members.withColumn("block", F.concat(name, F.lit("-"), share.cast("string"))).withColumn("other", F.explode(others))
    columns = ["key", "low", "high", "block", "node", "component", "n_shingles", "samples", "sketch", "bands"]
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).select(columns)
    whole = rows.where(F.col("size") <= CELL)
    for name in ("low", "high", "block"):
        whole = whole.withColumn(name, F.lit("-0"))
    cells = whole.select(columns)
    if not spread.isEmpty():
        cells = cells.unionByName(dealt)
    cells = cells.withColumn("cell", F.xxhash64("key", "low", "high")).withColumn("is_low", F.col("block") == F.col("low")).withColumn("alone", F.col("low") == F.col("high"))
    cells = cells.select("cell", "key", "is_low", "alone", "node", "component", "n_shingles", "samples", "sketch", "bands")
    cells = cells.repartition("cell").sortWithinPartitions("cell", "key", "alone")

    def pairs_of(t: dict[str, np.ndarray], first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(first, last)
        if t["alone"][first]:
            left = right = at
        else:
            left, right = at[t["is_low"][at]], at[~t["is_low"][at]]
        found = []
        for i in left:
            other = right[right > i] if left is right else right
            other = other[t["component"][other] != t["component"][i]]
            if len(other):
                fits = 100 * np.minimum(t["n_shingles"][other], t["n_shingles"][i]) >= percent * np.maximum(t["n_shingles"][other], t["n_shingles"][i])
                other = other[fits]
            if len(other):
                differing = np.bitwise_count(t["sketch"][other] ^ t["sketch"][i]).sum(1)
                other = other[may_link(differing, t["n_shingles"][other], t["n_shingles"][i], t["samples"][other], t["samples"][i], percent)]
            if len(other):
                shared = t["bands"][other] == t["bands"][i]
                found.append((i, other[t["bands"][i][shared.argmax(1)] == t["key"][i]]))
        a = [np.full(len(o), t["node"][i]) for i, o in found]
        b = [t["node"][o] for _, o in found]
        return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        names = ["cell", "key", "is_low", "alone", "node", "component", "n_shingles", "samples"]

        def run(table: pa.Table, whole: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            table = table.combine_chunks()
            t = {n: table.column(n).to_numpy() for n in names}
            t["sketch"] = np.frombuffer(b"".join(table.column("sketch").to_pylist()), _U).reshape(len(table), SKETCH_BITS // 64)
            t["bands"] = table.column("bands").chunk(0).flatten().to_numpy().reshape(len(table), -1)
            change = (np.diff(t["cell"]) != 0) | (np.diff(t["key"]) != 0) | (np.diff(t["alone"].astype(np.int8)) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(table)]
            done = edges if whole else edges[:-1]  # the last cell may go on in the next batch
            a, b = [], []
            for first, last in zip(done, done[1:], strict=False):
                if last - first > 1:
                    x, y = pairs_of(t, first, last)
                    a.append(np.minimum(x, y))
                    b.append(np.maximum(x, y))
            both = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (a, b)]
            return pa.RecordBatch.from_arrays(both, ["a", "b"]), None if whole else table.slice(done[-1])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if len(table):
                out, rest = run(table, whole=False)
                yield out
        if rest is not None and len(rest):
            yield run(rest, whole=True)[0]

    return cells.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links, itself included) and kept."""
    sig = common.stored(signatures(docs, width, band_count(percent, miss=miss)), "minhash")
    real = sig.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    sets_of = ["f1", "f2", "n_shingles"]
    of_id = sig.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("rows"), *(g(c).alias(f"{n}_{c}") for c in sets_of for n, g in (("min", F.min), ("max", F.max))))
    differs = F.expr(" or ".join(f"min_{c} <> max_{c}" for c in sets_of))
    found = of_id.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max(differs), F.lit(False)).alias("several")).first()
    repeated, several = found["rows"] > 1, found["several"]  # whether an id has several rows, and several sets
    classes = real.groupBy(*sets_of).agg(F.min("doc_id").alias("rep"))
    # Where each id has one set, a class can go by its least id; else it gets a number, once, when it is written.
    classes = common.stored(classes.withColumn("node", F.monotonically_increasing_id() if several else F.col("rep")), "set-classes")

    # Buckets of classes, without those that hold one member only. Rows of a class are alike, so one stands for it.
    once = lambda df: df.dropDuplicates(["node"]) if repeated else df
    reps = once(real.join(classes, sets_of).where(F.col("doc_id") == F.col("rep")))
    buckets = reps.select("node", F.explode("bands").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = common.stored(buckets.join(sizes, "key"), "buckets")
    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    mates = common.stored(reps.join(company, "node").select("node", "rep", "company", *sets_of, "samples", "sketch", "bands"), "bucket-mates")

    # One root for each bucket.
    ranked = shared.join(mates.select("node", "company"), "node")
    roots = ranked.groupBy("key").agg(F.max(F.struct("company", (-F.col("node")).alias("minus"))).alias("top"))
    roots = roots.select("key", (-F.col("top.minus")).alias("root"))
    star = shared.join(roots, "key").where(F.col("node") != F.col("root"))
    star = common.stored(star.select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b")).distinct(), "root-pairs")
    wanted = mates.select(F.col("rep").alias("doc_id"))
    sets = full_sets(docs.join(wanted.distinct() if several else wanted, "doc_id", "left_semi"), width)
    if several:
        sets = sets.join(mates.select("node", F.col("rep").alias("doc_id"), *sets_of), ["doc_id", *sets_of])
    else:
        sets = sets.withColumnRenamed("doc_id", "node")
    sets = common.stored(once(sets.select("node", "shingles")), "sets")
    links = common.stored(confirmed(star, sets, percent), "root-links")

    # Pairs of a bucket that the roots have not joined.
    found = components(links)
    labelled = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    rows = labelled.join(open_keys, "key", "left_semi").join(mates.select("node", "n_shingles", "samples", "sketch", "bands"), "node")
    more = confirmed(common.stored(similar_across(common.stored(rows, "open-buckets"), percent), "sketch-pairs"), sets, percent)

    # Components of components. Classes that share an id are linked too, and a component is named by its least id.
    links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    if several:
        ids = of_id.where(differs).select("doc_id")
        twice = real.join(ids, "doc_id", "left_semi").join(classes, sets_of).select("doc_id", "node").distinct()
        twice = twice.join(twice.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")
        links = links.union(twice)
    final = components(links)
    if several:
        linked = classes.join(final, "node")
        final = linked.join(linked.groupBy("component").agg(F.min("rep").alias("least")), "component").select("node", F.col("least").alias("component"))
    named = classes.join(final, "node", "left").select(*sets_of, F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("doc_id", *sets_of).join(named, sets_of, "left")
    if several:  # an empty text has the component of its id's other texts, if there are any
        empty = F.col("n_shingles") == 0
        other = out.where(~empty).join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("other"))
        out = out.join(other, "doc_id", "left").withColumn("component_id", F.when(empty, F.col("other")).otherwise(F.col("component_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=3, percent=85)
