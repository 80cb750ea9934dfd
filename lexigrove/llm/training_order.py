"""Token shards in training order (operator 1).

Documents become token ids of a public byte-level vocabulary, cut into sequences of a fixed number of
tokens (the last one of a document is padded). Sequences are numbered 0 to N - 1 in input order, and a
keyed Feistel permutation with cycle-walking sends each number to a slot: a shuffle of the whole corpus
that needs no sort by random keys and that anyone with the key can invert. Ranges of slots are the
partitions of one shuffle, and each is written as one shard of records with a fixed stride, so that the
record of any slot lies at a computable place and reading resumes from any slot.

A record is, in little-endian order: doc_id (8 bytes), number of the sequence in its document (4),
number of tokens (4), then ``length`` token ids of 2 bytes each, zeros after the last token.

Numbering takes two passes, like numbering rows by partition: the first counts sequences for each input
partition, the second adds a partition's offset to its running count. Both see the same partitions, as
they plan the same files under the same settings.

Edge cases: a null or empty text has no tokens but its end, one sequence. A null ``doc_id`` is written as
-1. Repeated rows are sequences of their own. Without rows there are no shards. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level vocabularies part a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH, KEY = 256, 20_240_607
SHARD_RECORDS, MOST_RECORDS, MOST_SHARDS = 16_384, 1 << 20, 10_000  # shards grow with the corpus, up to half a gigabyte
READ_RECORDS = 4096  # of a range that is read at once
LAYOUT = "layout.json"
_HEADER = 16
_MEMO = 1_000_000
_ROUNDS = 4
_U = np.uint64
_encoders: dict[bytes, object] = {}  # of this worker, by vocabulary


def shard_bytes(length: int) -> int:
    return _HEADER + 2 * length


# ---------------------------------------------------------------- permutation


def feistel(numbers: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Sends each of 0 to n - 1 to a slot of the same range, one to one; ``inverse`` sends it back.

    A balanced Feistel network permutes the least even-bit power of two that holds n; a result outside
    the range is permuted again until it falls inside, which keeps the map one to one.
    """
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = _U((1 << half) - 1)
    keys = common.mix(np.arange(1, _ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) ^ _U(key % (1 << 64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> _U(half), x & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (common.mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (common.mix(right ^ k) & mask)
        return (left << _U(half)) | right

    out = once(numbers.astype(_U))
    while len(outside := np.flatnonzero(out >= _U(n))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


# ---------------------------------------------------------------- tokens


#: White space beyond ASCII, as Unicode has it.
_WIDE_BLANKS = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x20), 0x20]] = True


def blanks(part: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space."""
    out = _BLANK[part]
    for lead, length in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
        at = np.flatnonzero(part[: len(part) - length + 1] == lead) if lead == 0xC2 or (part == lead).any() else np.empty(0, np.int64)
        for blank in (c.encode() for c in _WIDE_BLANKS):
            if blank[0] == lead and len(at):
                here = at[np.logical_and.reduce([part[at + i] == blank[i] for i in range(1, length)])]
                for i in range(length):
                    out[here + i] = True
    return out


class Encoder:
    """Token ids of many texts at once, with a memory of the pieces of text it has met.

    The vocabulary's pattern always parts a text before a space that no white space follows, and on both
    sides of a line feed between other characters. Texts are cut at these places in numpy, pieces are
    looked up by a 64-bit hash of their bytes, and only pieces that are not remembered reach the encoder.
    """

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, vocabulary.splitlines())}
        self.end = len(ranks)  # the id after the vocabulary's last
        self.encoding = tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.table = common.HashTable(16)
        self.begin = np.zeros(1024, np.int64)  # of each remembered piece: where its ids are, and how many
        self.size = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint16)
        self.filled = 0

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all rows, where each piece begins, the number of pieces before each row and after the last)."""
        part, inner = data[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]
        if not len(part):
            return part, np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
        blank = blanks(part)
        edge = np.zeros(len(part) + 1, bool)
        edge[inner] = True
        before, after = np.concatenate(([True], blank[:-1])) | edge[:-1], np.concatenate((blank[1:], [True])) | edge[1:]
        cut = edge[:-1] | ((part == 0x20) & ~after)
        line = np.flatnonzero((part == 0x0A) & ~before & ~after)
        cut[line] = True
        cut[line + 1] = True
        starts = np.flatnonzero(cut)
        return part, starts, np.searchsorted(starts, inner)

    def numbers(self, part: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each piece in ``begin`` and ``size``; new pieces are encoded and get numbers.

        A full memory keeps what it has, as common pieces come early; numbers above it hold until the next call.
        """
        ends = np.append(starts[1:], len(part))
        hashes = common.span_hashes(part, starts, ends, common.EXACT_BYTE)
        found = self.table.find(hashes)
        away = np.flatnonzero(found < 0)
        if not len(away):
            return found
        fresh, first, which = np.unique(hashes[away], return_index=True, return_inverse=True)
        texts = part.tobytes()
        new = [self.encoding.encode_ordinary(texts[starts[i] : ends[i]].decode("utf-8", "replace")) for i in away[first].tolist()]
        n, sizes = self.table.n, np.fromiter(map(len, new), np.int64, len(new))
        total = int(sizes.sum())
        self.begin, self.size = _grown(self.begin, n + len(new)), _grown(self.size, n + len(new))
        self.pool = _grown(self.pool, self.filled + total)
        self.pool[self.filled : self.filled + total] = np.fromiter((i for ids in new for i in ids), np.uint16, total)
        self.begin[n : n + len(new)] = self.filled + np.cumsum(sizes) - sizes
        self.size[n : n + len(new)] = sizes
        found[away] = n + which.reshape(-1)
        if n + len(new) <= _MEMO:
            self.table.add(fresh)
            self.filled += total
        return found

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of ids of each row, its end included."""
        part, starts, at = self.pieces(data, offsets)
        found = self.numbers(part, starts) if len(starts) else starts
        sums = np.concatenate(([0], np.cumsum(self.size[found])))
        return np.diff(sums[at]) + 1

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, each row's followed by the end; their number for each row)."""
        part, starts, at = self.pieces(data, offsets)
        n_rows = len(offsets) - 1
        found = self.numbers(part, starts) if len(starts) else starts
        size, row = self.size[found], np.repeat(np.arange(n_rows), np.diff(at))
        total = int(size.sum())
        ids = np.full(total + n_rows, self.end, np.uint16)
        before = np.cumsum(size) - size
        ids[np.arange(total) + np.repeat(row, size)] = self.pool[np.arange(total) + np.repeat(self.begin[found] - before, size)]
        return ids, np.bincount(row, size, n_rows).astype(np.int64) + 1


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for n elements at least."""
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])


def encoder(vocabulary: bytes) -> Encoder:
    """This worker's encoder; it is kept from task to task."""
    if vocabulary not in _encoders:
        _encoders.clear()
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


# ---------------------------------------------------------------- shards


def records_of_shard(total: int) -> int:
    """Records of a shard: a power of two, so many that there are at most MOST_SHARDS shards, between bounds."""
    return min(MOST_RECORDS, max(SHARD_RECORDS, 1 << (-(-total // MOST_SHARDS) - 1).bit_length() if total else 0))


def records(doc_ids: np.ndarray, ids: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes (n, stride) of the records of all rows, number of records of each row)."""
    n = -(-sizes // length)
    row, piece = np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    head = np.zeros((len(row), shard_bytes(length)), np.uint8)
    head[:, :8] = doc_ids[row].astype("<i8").view(np.uint8).reshape(-1, 8)
    head[:, 8:12] = piece.astype("<i4").view(np.uint8).reshape(-1, 4)
    head[:, 12:16] = np.minimum(length, sizes[row] - piece * length).astype("<i4").view(np.uint8).reshape(-1, 4)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    record = np.repeat(np.cumsum(n) - n, sizes) + place // length
    flat = head.view("<u2").reshape(-1)
    flat[record * (shard_bytes(length) // 2) + _HEADER // 2 + place % length] = ids
    return head, n


def write_shards(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, length: int = LENGTH, shard_records: int | None = None, key: int = KEY
) -> int:
    """Writes ``path``/shard-00000000.bin and so on, and their layout; returns the number of sequences.

    ``path`` is a URI that executors can write to. ``vocabulary`` is a file on the driver; its content,
    less than a megabyte, goes to the tasks. A shard is written under the attempt's own name and then
    renamed, so a task that runs again, or twice, leaves the same file.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    stride = shard_bytes(length)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n = encoder(shared.value), 0
        for batch in batches:
            data, offsets = common.text_buffer(batch.column(1))
            for first, last in common.steps(offsets):
                n += int((-(-encode.lengths(data, offsets[first : last + 1]) // length)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], ["part", "n"])

    counts = sorted((r["part"], r["n"]) for r in source.mapInArrow(count, "part int, n long").collect())  # one row for each input partition
    total = sum(n for _, n in counts)
    if not total:
        return 0
    per_shard = shard_records or records_of_shard(total)
    ends = np.cumsum([n for _, n in counts]).tolist()
    spans = spark.sparkContext.broadcast({p: (e - n, e) for (p, n), e in zip(counts, ends, strict=True)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (at, end) = encoder(shared.value), spans.value[TaskContext.get().partitionId()]
        for batch in batches:
            data, offsets = common.text_buffer(batch.column(1))
            doc_ids = batch.column(0).to_numpy()
            for first, last in common.steps(offsets):
                rows, _ = records(doc_ids[first:last], *encode(data, offsets[first : last + 1]), length)
                slots = feistel(np.arange(at, at + len(rows)), total, key)
                at += len(rows)
                blobs = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * stride).astype(np.int32)), pa.py_buffer(rows)])
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array((slots // per_shard).astype(np.int32)), blobs], ["slot", "shard", "record"])
        if at != end:
            raise RuntimeError(f"{at - end:+} sequences in partition {TaskContext.get().partitionId()}: the input changed between two passes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pa.fs.FileSystem.from_uri(path)
        shard, n, out, names = None, 0, None, ("", "")

        def close() -> pa.RecordBatch:
            out.close()
            files.move(*names)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64())], ["shard", "n"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for first, last in zip(edges, edges[1:], strict=False):
                if first == last:
                    continue
                if shards[first] != shard:
                    if out is not None:
                        yield close()
                    shard, n = int(shards[first]), 0
                    names = (f"{folder}/.{shard:08d}-{TaskContext.get().taskAttemptId()}", f"{folder}/shard-{shard:08d}.bin")
                    out = files.open_output_stream(names[0])
                out.write(b"".join(batch.column("record").slice(first, last - first).to_pylist()))
                n += last - first
        if out is not None:
            yield close()

    files, folder = pa.fs.FileSystem.from_uri(path)
    files.create_dir(folder, recursive=True)
    cuts = source.mapInArrow(cut, "slot long, shard int, record binary")
    dealt = cuts.repartitionById(-(-total // per_shard), F.col("shard")).sortWithinPartitions("slot")
    written = dealt.mapInArrow(write, "shard int, n long").agg(F.sum("n").alias("n")).first()["n"]
    if written != total:
        raise RuntimeError(f"{written} of {total} sequences written")
    with files.open_output_stream(f"{folder}/{LAYOUT}") as out:
        out.write(json.dumps({"sequences": total, "length": length, "shard_records": per_shard, "key": key}).encode())
    return total


def layout(path: str) -> dict[str, int]:
    """sequences, length, shard_records and key of the shards in ``path``."""
    files, folder = pa.fs.FileSystem.from_uri(path)
    with files.open_input_stream(f"{folder}/{LAYOUT}") as f:
        return json.loads(f.read())


def read_shards(spark: SparkSession, path: str, first_slot: int = 0) -> DataFrame:
    """slot, shard, position (byte in the shard), doc_id, piece, n_tokens and tokens of every record from
    ``first_slot`` on. Tasks read ranges of slots, each from the place in its shard that the slot gives."""
    made = layout(path)
    stride, per_shard, total = shard_bytes(made["length"]), made["shard_records"], made["sequences"]
    at_once = READ_RECORDS
    per_range = -(-per_shard // at_once)  # ranges of a shard

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pa.fs.FileSystem.from_uri(path)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                shard, place = number // per_range, number % per_range * at_once
                slot = max(first_slot, shard * per_shard + place)
                end = min(total, (shard + 1) * per_shard, shard * per_shard + place + at_once)
                if slot >= end:
                    continue
                with files.open_input_file(f"{folder}/shard-{shard:08d}.bin") as f:
                    f.seek((slot - shard * per_shard) * stride)
                    for first in range(slot, end, 1000):
                        n = min(1000, end - first)
                        rows = np.frombuffer(f.read(n * stride), np.uint8).reshape(n, stride)
                        sizes = np.ascontiguousarray(rows[:, 8:16]).view("<i4")
                        tokens = [r[_HEADER : _HEADER + 2 * k].tobytes() for r, k in zip(rows, sizes[:, 1].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.arange(first, first + n)), pa.array(np.full(n, shard, np.int32)), pa.array((np.arange(first, first + n) - shard * per_shard) * stride),
                                pa.array(np.ascontiguousarray(rows[:, :8]).view("<i8")[:, 0]), pa.array(sizes[:, 0].copy()), pa.array(sizes[:, 1].copy()),
                                pa.array(tokens, pa.binary()),
                            ],
                            ["slot", "shard", "position", "doc_id", "piece", "n_tokens", "tokens"],
                        )

    schema = "slot long, shard int, position long, doc_id long, piece int, n_tokens int, tokens binary"
    return spark.range(first_slot // per_shard * per_range, -(-total // per_shard) * per_range).mapInArrow(decode, schema)


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards of all documents and returns what is in them, tokens as a checksum."""
    path = common.new_path(spark, "shards")
    docs = common.table(spark, sf_dir, "documents")
    if not write_shards(docs, path):
        return spark.createDataFrame([], "slot long, shard int, position long, doc_id long, piece int, n_tokens int, token_crc long")
    return read_shards(spark, path).withColumn("token_crc", F.crc32("tokens")).drop("tokens")
