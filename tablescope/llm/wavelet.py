"""Token-ID / binary output (operator 6): one wavelet matrix per shard of ids.

Ids are written in ascending document order, an end id after each document. A shard holds a bounded number of ids
(more only for a single longer document) as bit planes, most significant first: each plane is the next bit of all
ids in the order in which the planes before have sorted them, with the count of ones before every block of 512 bits. Planes and
counts answer access, counting and occurrence lookups without unpacking the ids. Shards are rows, each a row group, of
zstd-compressed Parquet files, so writing is atomic per task on any file system Spark writes to, and repeatable, and memory
does not follow the shards of a task. A shard tells the number of ids of its part before it; one row per part tells the rest.

Layout of a payload, little-endian: 8 bytes ``WVMATRX1``; uint32 planes, uint64 ids; per plane uint64
zeros; per plane uint32 counts of ones before each block; per plane the bits, high bit first, padded to blocks.

Defined cases: missing and empty texts are an end id alone; rows with equal ids keep an order by a hash of the
text; a missing document id sorts first. Extra columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.llm.arrays import give_back, pieces
from tablescope.llm.bpe import encoder_of

SHARD_IDS = 1 << 20  # payloads of about two megabytes
SPLITS_A_TASK = 2  # input splits whose words one task encodes once
_PIECE = 2 << 20
#: Readers and writers hold a row group at once, however well it is compressed.
_ONE_SHARD_A_GROUP = {"parquet.block.row.count.limit": 1}
_BLOCK = 512
_MAGIC = b"WVMATRX1"


def pack(ids: np.ndarray, planes: int) -> bytes:
    """The payload of a sequence of ids under 2^planes."""
    n = len(ids)
    blocks = -(-n // _BLOCK)
    now = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    zeros, counts, bits = [], [], []
    for k in range(planes - 1, -1, -1):
        one = ((now >> k) & 1).astype(bool)
        packed = np.zeros(blocks * _BLOCK // 8, np.uint8)
        raw = np.packbits(one)
        packed[: len(raw)] = raw
        ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.uint32)
        counts.append(np.cumsum(ones, dtype=np.uint32) - ones)
        bits.append(packed)
        zeros.append(n - int(ones.sum()))
        now = np.concatenate([now[~one], now[one]])
    head = np.uint32(planes).tobytes() + np.uint64(n).tobytes() + np.array(zeros, np.uint64).tobytes()
    return b"".join([_MAGIC, head, *[c.tobytes() for c in counts], *[b.tobytes() for b in bits]])


class WaveletMatrix:
    """Queries on a payload."""

    def __init__(self, payload: bytes | memoryview):
        payload = memoryview(payload)
        if bytes(payload[:8]) != _MAGIC:
            raise ValueError("not a wavelet matrix")
        self.planes = int(np.frombuffer(payload, np.uint32, 1, 8)[0])
        self.n = int(np.frombuffer(payload, np.uint64, 1, 12)[0])
        blocks, at = -(-self.n // _BLOCK), 20
        self.zeros = np.frombuffer(payload, np.uint64, self.planes, at).astype(np.int64)
        at += 8 * self.planes
        self.counts = [np.frombuffer(payload, np.uint32, blocks, at + 4 * blocks * k) for k in range(self.planes)]
        at += 4 * blocks * self.planes
        size = blocks * _BLOCK // 8
        self.bits = [np.frombuffer(payload, np.uint8, size, at + size * k) for k in range(self.planes)]

    def ids(self) -> np.ndarray:
        """All ids: the planes' sorting undone from the last plane up."""
        now = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for k in range(self.planes - 1, -1, -1):
            one = np.unpackbits(self.bits[k], count=self.n).astype(bool)
            above = np.empty_like(now)
            above[~one] = now[: self.zeros[k]]
            above[one] = now[self.zeros[k] :] | now.dtype.type(1 << (self.planes - 1 - k))
            now = above
        return now

    def _ones(self, plane: int, place: int) -> int:
        """Ones before a place."""
        block = place // _BLOCK
        if block >= len(self.counts[plane]):
            return self.n - int(self.zeros[plane])
        from_ = block * (_BLOCK // 8)
        part = np.unpackbits(self.bits[plane][from_ : from_ + _BLOCK // 8], count=place - block * _BLOCK) if place % _BLOCK else ()
        return int(self.counts[plane][block]) + int(np.sum(part))

    def access(self, place: int) -> int:
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for k in range(self.planes):
            one = (int(self.bits[k][place >> 3]) >> (7 - (place & 7))) & 1
            before = self._ones(k, place)
            place = int(self.zeros[k]) + before if one else place - before
            value = value * 2 + one
        return value

    def _narrow(self, value: int, low: int, high: int) -> tuple[int, int]:
        for k in range(self.planes):
            a, b = self._ones(k, low), self._ones(k, high)
            if (value >> (self.planes - 1 - k)) & 1:
                low, high = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, value: int, low: int = 0, high: int | None = None) -> int:
        """How often an id occurs from place ``low`` to before ``high``."""
        if value >> self.planes:
            return 0
        a, b = self._narrow(value, low, self.n if high is None else high)
        return b - a

    def occurrences(self, value: int) -> np.ndarray:
        """The places of an id, ascending, by select from the last plane up."""
        if value >> self.planes:
            return np.zeros(0, np.int64)
        low, high = self._narrow(value, 0, self.n)
        places = np.arange(low, high)
        for k in range(self.planes - 1, -1, -1):
            one = bool((value >> (self.planes - 1 - k)) & 1)
            places = self._select(k, places - int(self.zeros[k]) if one else places, one)
        return np.sort(places)

    def _select(self, plane: int, ranks: np.ndarray, one: bool) -> np.ndarray:
        """Places of the bits of a kind with the given numbers (from 0)."""
        if not len(ranks):
            return ranks
        before = self.counts[plane].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * _BLOCK - before
        block = np.searchsorted(before, ranks, "right") - 1
        used, where = np.unique(block, return_inverse=True)
        bits = np.unpackbits(self.bits[plane].reshape(-1, _BLOCK // 8)[used], axis=1)
        seen = np.cumsum(bits == one, axis=1)
        return block * _BLOCK + (seen[where] <= (ranks - before[block])[:, None]).sum(axis=1)


def write_ids(docs: DataFrame, path: str, tokenizer_json: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 0) -> None:
    """Write the ids of every document as wavelet shards: (part, shard, before, n_ids, doc_ids, counts, payload)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tokenizer_json)
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    keys = ["doc_id", "_hash", "_copy"]
    parts = max(8, docs.rdd.getNumPartitions() // SPLITS_A_TASK)
    ordered = texts.withColumn("_hash", F.xxhash64("text")).withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder = encoder_of(sent.value)
        planes = max(1, (max(encoder.tokenizer.get_vocab_size() - 1, end_id)).bit_length())
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        ids_of, counts, held, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard, before, ids_of, counts, held, size
            if counts:
                total = np.concatenate(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()),
                        pa.array([shard], pa.int32()),
                        pa.array([before], pa.int64()),
                        pa.array([size], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.concat_arrays(ids_of)),
                        pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total)),
                        pa.array([pack(np.concatenate(held), planes)], pa.binary()),
                    ],
                    names=["part", "shard", "before", "n_ids", "doc_ids", "counts", "payload"],
                )
                shard, before = shard + 1, before + size
            ids_of, counts, held, size = [], [], [], 0

        for batch in batches:
            for first, end, data, offsets in pieces(batch.column(1), _PIECE):
                ids, bounds = encoder.encode(data, offsets)
                ids = np.insert(ids, bounds[1:], end_id).astype(np.uint16 if planes <= 16 else np.uint32)
                ids_of.append(pa.concat_arrays([batch.column(0).slice(first, end - first)]))  # a copy: a slice would keep the batch with its texts
                counts.append(np.diff(bounds) + 1)
                held.append(ids)
                size += len(ids)
                if size >= SHARD_IDS:
                    yield from flush()
        yield from flush()

    schema = "part int, shard int, before long, n_ids long, doc_ids array<long>, counts array<long>, payload binary"
    ordered.select("doc_id", "text").mapInArrow(run, schema).write.options(compression="zstd", **_ONE_SHARD_A_GROUP).parquet(path)


def _started(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``, the ids before each; there is one narrow row per part to sum over."""
    shards = spark.read.parquet(path)
    parts = shards.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("first"))
    return shards.join(F.broadcast(starts), "part").withColumn("start", F.col("first") + F.col("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: (doc_id, start, n_tokens, ids_crc32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for k in range(batch.num_rows):
                ids = WaveletMatrix(batch.column("payload")[k].as_buffer()).ids()
                counts = batch.column("counts")[k].values.to_numpy()
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[k].values, pa.array(batch.column("start")[k].as_py() + ends - counts), pa.array(counts), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    shards = _started(spark, path).select("start", "doc_ids", "counts", "payload")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def find_id(spark: SparkSession, path: str, value: int) -> DataFrame:
    """Every occurrence of an id: (place in the whole sequence), from the bit planes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                places = WaveletMatrix(batch.column("payload")[k].as_buffer()).occurrences(value)
                yield pa.RecordBatch.from_arrays([pa.array(places + batch.column("start")[k].as_py())], names=["place"])

    return _started(spark, path).select("start", "payload").mapInArrow(run, "place long")


def count_id(spark: SparkSession, path: str, value: int) -> DataFrame:
    """How often an id occurs in each shard: (part, shard, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [WaveletMatrix(p.as_buffer()).count(value) for p in batch.column("payload")]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("shard"), pa.array(counts, pa.int64())], names=["part", "shard", "n"])

    return spark.read.parquet(path).select("part", "shard", "payload").mapInArrow(run, "part int, shard int, n long")
