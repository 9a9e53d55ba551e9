"""Token counts (operator 4): document boundaries found by scanning flat token files for the end-of-document id.

The files hold nothing but fixed-width little-endian ids, each document followed by the end id: no index, no lengths. A
file is read as a stream of bytes, cut behind each byte that the end id begins with. So Spark deals it out in splits, and no task
or row holds a whole file; a row is longer only where that byte, and so the end id, is missing for long. The bytes are put
together again in blocks, each a vectorised search for the end id's bytes at every place: a block tells its number of bytes, the places
found and its first and last bytes. A prefix scan over the blocks of a file gives each the bytes before it, hence which
places are those of ids, and the id that is cut by its beginning. Documents may begin in one block, or file, and end in another: the same
scan, and then one over files, gives each block the ids and documents before it and where its open document began, from
which every count follows.

Files are read in the order of the number in their name, then of the name. Defined cases: no files or empty files give no rows;
two end ids in a row enclose an empty document of 0 ids; ids after the last end id are one more document with
``closed`` false. Written texts that are missing or empty are empty documents. A file whose name ends like a compressed
one's is an error, as Spark would expand it.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.llm.arrays import give_back, pieces
from tablescope.llm.bpe import encoder_of
from tablescope.operators.order import materialize

BLOCK_IDS = 1 << 20
_PIECE = 2 << 20
_MARK = b"\xef\xbb\xbf"  # Spark's reader leaves these bytes out at the beginning of a file


def write_flat(docs: DataFrame, path: str, tokenizer_json: str, text_column: str = "text") -> None:
    """Write ids as 16-bit numbers, in the order of the rows: 0 ends a document, every other id is the tokenizer's plus 1.

    Spark's text writer puts the end id, two zero bytes, after each row; ids never hold it, as none of them is 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    texts = docs.select(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder = encoder_of(sent.value)
        if encoder.tokenizer.get_vocab_size() >= 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0), _PIECE):
                ids, bounds = encoder.encode(data, offsets)
                raw = pa.py_buffer((ids + 1).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((2 * bounds).astype(np.int32).tobytes()), raw])], names=["ids"])

    texts.mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value")).write.option("lineSep", "\0\0").text(path)


def _end_bytes(end_id: int, width: int) -> bytes:
    return (end_id % (1 << 8 * width)).to_bytes(width, "little")


def _found(raw: np.ndarray, end: bytes) -> tuple[np.ndarray, bytes, bytes]:
    """Every place where the bytes of the end id begin, and the first and last bytes, in which one may be cut."""
    places = max(len(raw) - len(end) + 1, 0)
    hit = np.ones(places, bool)
    for k, byte in enumerate(end):
        hit &= raw[k : k + places] == byte
    edge = len(end) - 1
    return np.flatnonzero(hit).astype(np.int32), raw[:edge].tobytes(), raw[max(len(raw) - edge, 0) :].tobytes()


def blocks(spark: SparkSession, path: str, end_id: int = 0, width: int = 2) -> DataFrame:
    """One row per block of a split of a file: (file, size, split, block, n_bytes, ends, head, tail), in the order of (split, block).

    ``ends`` has every byte of the block at which the end id's bytes begin. The byte that ends a line is also counted for
    the last line of a file, where it may be missing.
    """
    end = _end_bytes(end_id, width)
    lines = spark.read.options(lineSep=chr(end[0]), encoding="ISO-8859-1").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        limit = BLOCK_IDS * width
        now, block, held, size = None, 0, [], 0

        def put(raw: np.ndarray) -> pa.RecordBatch:
            nonlocal block
            ends, head, tail = _found(raw, end)
            row = [now[0], now[1], now[2], block, len(raw), ends, head, tail]
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        for batch in batches:
            lines, files, sizes, splits = batch.columns
            splits = splits.to_numpy()
            new = (splits[1:] != splits[:-1]) | pc.not_equal(files.slice(1), files.slice(0, max(len(files) - 1, 0))).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(files)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                own = unquote(files[a].as_py()), sizes[a].as_py(), int(splits[a])
                if own != now:
                    if size:
                        yield put(np.concatenate(held))
                    if own[1] % width:
                        raise ValueError(f"{own[0]} is no whole number of ids")
                    now, block, held, size = own, 0, [], 0
                for _, _, data, offsets in pieces(lines.slice(a, b - a), _PIECE):
                    held.append(np.insert(data, offsets[1:], end[0]))
                    size += len(held[-1])
                    if size >= limit:
                        whole = np.concatenate(held)
                        for k in range(0, size - limit + 1, limit):
                            yield put(whole[k : k + limit])
                        held = [whole[size - size % limit :].copy()]
                        size = len(held[0])
        if size:
            yield put(np.concatenate(held))

    names = ["file", "size", "split", "block", "n_bytes", "ends", "head", "tail"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return lines.mapInArrow(run, "file string, size long, split long, block int, n_bytes int, ends array<int>, head binary, tail binary")


def _placed(found: DataFrame, end: bytes) -> DataFrame:
    """The blocks with ``ends``, the numbers of the end ids in the file instead of places in the block."""
    width = len(end)
    ends, head, tail = _found(np.frombuffer(_MARK, np.uint8), end)
    short = found.groupBy("file", "size").agg(F.sum("n_bytes").alias("seen")).where("seen < size")
    mark = [F.lit(-1).cast("long").alias("split"), F.lit(0).alias("block"), F.lit(len(_MARK)).alias("n_bytes"), F.array(*map(F.lit, ends.tolist())).cast("array<int>").alias("ends"), F.lit(head).alias("head"), F.lit(tail).alias("tail")]
    order = Window.partitionBy("file").orderBy("split", "block")
    before = F.coalesce(F.sum(F.col("n_bytes").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tails = [F.coalesce(F.lag("tail", k).over(order), F.lit(b"")) for k in range(width - 1, 0, -1)]  # no block is empty
    rows = found.unionByName(short.select("file", "size", *mark)).select("*", before.alias("start"), F.concat(F.lit(b""), *tails).alias("tails"))
    over = (F.col("start") % width).cast("int")  # bytes of the id that the block begins in
    rows = rows.withColumn("over", over)
    cut = F.concat(F.expr("substring(tails, -over, over)"), F.expr(f"substring(head, 1, {width} - over)"))
    none = F.array().cast("array<long>")
    first = F.when((F.col("over") > 0) & (cut == F.lit(end)), F.array((F.col("start") - F.col("over")).cast("long"))).otherwise(none)
    inside = F.transform("ends", lambda p: F.col("start") + p)
    inside = F.filter(inside, lambda p: (p % width == 0) & (p < F.col("size")))
    return rows.select("file", "size", "split", "block", "n_bytes", F.transform(F.concat(first, inside), lambda p: F.floor(p / width)).alias("ends"))


def token_counts(spark: SparkSession, path: str, end_id: int = 0, width: int = 2) -> DataFrame:
    """Per document, in order: (doc_no, start, n_tokens, closed); start counts all ids before it, end ids included."""
    found = _placed(materialize(blocks(spark, path, end_id, width)), _end_bytes(end_id, width))
    if end_id >> 8 * width:  # no id is that
        found = found.withColumn("ends", F.filter("ends", lambda p: F.lit(False)))
    found = found.withColumn("last", F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1))
    number = F.coalesce(F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"(\d+)", 1).try_cast("long"), F.lit(0))
    files = found.groupBy("file", "size").agg(F.sum(F.col("n_bytes").cast("long")).alias("seen"), F.sum(F.size("ends").cast("long")).alias("docs"), F.max("last").alias("last"))
    whole = (F.col("seen") - F.col("size")).isin(0, 1)
    files = files.withColumn("ids", F.when(whole, F.floor(F.col("size") / width)).otherwise(F.raise_error(F.concat("file", F.lit(" was not read as it is stored"))).cast("long")))
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row per file
    files = files.withColumn("ids_before", F.coalesce(F.sum("ids").over(before), F.lit(0))).withColumn("docs_before", F.coalesce(F.sum("docs").over(before), F.lit(0)))
    files = files.withColumn("open_from", F.coalesce(F.max(F.col("ids_before") + F.col("last")).over(before), F.lit(0)))
    inside = Window.partitionBy("file").orderBy("split", "block").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.select(
        "file",
        "ends",
        F.coalesce(F.sum(F.size("ends").cast("long")).over(inside), F.lit(0)).alias("docs_in_file"),
        F.max("last").over(inside).alias("open_in_file"),
    ).join(files.select("file", "ids_before", "docs_before", "open_from"), "file")
    carry = F.coalesce(F.col("ids_before") + F.col("open_in_file"), F.col("open_from"))
    docs = rows.select("*", carry.alias("carry"), F.posexplode("ends").alias("k", "end"))
    base = F.col("ids_before")
    start = F.when(F.col("k") == 0, F.col("carry")).otherwise(base + F.get("ends", F.col("k") - 1) + 1)
    closed = docs.select((F.col("docs_before") + F.col("docs_in_file") + F.col("k")).alias("doc_no"), start.alias("start"), (base + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    total = files.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("doc_no"), F.coalesce(F.max(F.col("ids_before") + F.col("last")), F.lit(0)).alias("start"), F.sum("ids").alias("n"))
    rest = total.where("n > start").select("doc_no", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(rest)
