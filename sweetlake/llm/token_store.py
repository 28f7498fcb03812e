"""Token ids in dictionary-compressed blocks (operator 7).

Every document's ids are compressed on their own, with one zstandard dictionary that is
trained on the serialized id arrays of a bounded sample, so that a short document can be read
without its neighbours.  Documents lie in ascending doc_id order in blocks; a block is
self-describing: magic, SHA-256 of the dictionary, counts of documents and of those without
doc_id (they come first), then doc ids, id counts and frame offsets, then the frames.  Spark writes blocks as rows of a table (its commit protocol covers
lost executors); beside them lie the dictionary and, per range partition, the ids before it.

Defined results: a null text counts as empty and has only the end id; a null doc_id is kept
and comes first; repeated ids keep all rows, by text order; an empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import packed_ids

END = 2
#: Bound of the dictionary's sample, and of a text in it.
SAMPLE_DOCS, SAMPLE_CHARS = 1_000, 20_000
DICT_BYTES = 64 * 1024
BLOCK_DOCS, BLOCK_BYTES = 1_024, 4_000_000
MAGIC = b"SWTK\x02\0\0\0"
#: Rows that are encoded before their frames leave the worker.
SLICE = 256

FRAMES = "doc_id long, n_tokens long, frame binary"
BLOCKS = "part int, first_id long, last_id long, before_in_part long, n_docs long, n_tokens long, block binary"
ROWS = "doc_id long, start long, n_tokens long, ids binary"


def serialize(ids: bytes) -> bytes:
    """uint32 ids -> their low, then their second bytes and so on: planes compress better."""
    return np.frombuffer(ids, np.uint8).reshape(-1, 4).T.tobytes()


def deserialize(data: bytes) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, size: int = DICT_BYTES, sample: int = SAMPLE_DOCS) -> bytes:
    """Dictionary over at most `sample` id arrays (least hash of doc_id, texts up to SAMPLE_CHARS).

    Too few or too uniform arrays for training: the arrays themselves serve as content."""
    import zstandard

    least = docs.where(F.length("text") <= SAMPLE_CHARS).select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("chosen"))
    # At most `sample` ids and then as many bounded texts: the bound of what reaches the driver.
    least = least.orderBy("h", "chosen").limit(sample).select("chosen").distinct()
    texts = docs.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(least), F.col("doc_id") == F.col("chosen"), "left_semi")
    chosen = texts.dropDuplicates(["doc_id"]).orderBy("doc_id")
    arrays = [serialize(x) for x in packed_ids(tokenizer, [r.text for r in chosen.collect()], END)]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[-size:] or b"\0" * 8


def frames(docs: DataFrame, tokenizer: str, dictionary: bytes, level: int = 1) -> DataFrame:
    """A compressed frame for each document's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b, n, out = whole.slice(at, SLICE), [], []
                for ids in packed_ids(tokenizer, b.column("text").to_pylist(), END):
                    n.append(len(ids) // 4)
                    out.append(c.compress(serialize(ids)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "frame"])

    return docs.select("doc_id", "text").mapInArrow(run, FRAMES)


def pack_block(rows: list[tuple], dict_hash: bytes) -> bytes:
    ids, counts, parts = zip(*rows)
    offsets = [0]
    for p in parts:
        offsets.append(offsets[-1] + len(p))
    n = len(rows)
    index = struct.pack(f"<{n}q{n}Q{n + 1}Q", *(i or 0 for i in ids), *counts, *offsets)
    return MAGIC + dict_hash + struct.pack("<QQ", n, sum(i is None for i in ids)) + index + b"".join(parts)


def open_block(block: bytes, dict_hash: bytes) -> tuple[list[int | None], list[int], list[int], int]:
    """(doc ids, id counts, frame offsets, where frames begin); fails on another format or dictionary."""
    if block[:8] != MAGIC or block[8:40] != dict_hash:
        raise ValueError("not a block of this dictionary")
    n, unnamed = struct.unpack_from("<QQ", block, 40)
    v = struct.unpack_from(f"<{n}q{n}Q{n + 1}Q", block, 56)
    return [*[None] * unnamed, *v[unnamed:n]], list(v[n : 2 * n]), list(v[2 * n :]), 56 + 8 * (3 * n + 1)


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write blocks, dictionary and part index under `path`.

    Text is tokenized once, before the range shuffle, which so moves only frames."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest.hex(), dictionary)], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    made = common.written(frames(docs, tokenizer, dictionary), "frames", "none")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, before = [], 0, 0

        def flush(part: int) -> pa.RecordBatch:
            nonlocal held, size, before
            n = sum(r[1] for r in held)
            row = {"part": [part], "first_id": [held[0][0]], "last_id": [held[-1][0]], "before_in_part": [before], "n_docs": [len(held)], "n_tokens": [n], "block": [pack_block(held, digest)]}
            held, size, before = [], 0, before + n
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), *((k, pa.int64()) for k in list(row)[1:-1]), ("block", pa.binary())]))

        part = 0
        for b in batches:
            for i, n, f, part in zip(*(b.column(k).to_pylist() for k in ("doc_id", "n_tokens", "frame", "part"))):
                held.append((i, n, f))
                size += len(f)
                if len(held) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield flush(part)
        if held:
            yield flush(part)

    (
        made.repartitionByRange(common.parts(made), "doc_id")
        .sortWithinPartitions("doc_id", "n_tokens", "frame")
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(blocks, BLOCKS)
        .write.option("compression", "none")
        .parquet(f"{path}/blocks")
    )
    written = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    per_part = written.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a partition
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_part.select("part", base.cast("long").alias("before_part")).coalesce(1).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of one id, whose blocks alone are then read
    and whose frames alone are then decompressed.  start counts the ids of all documents before it."""
    ((dict_hash, dictionary),) = spark.read.parquet(f"{path}/dictionary").collect()
    if hashlib.sha256(dictionary).hexdigest() != dict_hash:
        raise ValueError("the dictionary does not match its hash")
    digest, dictionary = bytes.fromhex(dict_hash), bytes(dictionary)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if doc_id is not None:
        # A block may begin with rows without id; one that ends with such a row holds no other.
        blocks = blocks.where((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id))
    parts = spark.read.schema("part int, before_part long").parquet(f"{path}/parts")  # a row a partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for b in batches:
            for block, start in zip(b.column("block"), b.column("start").to_pylist()):
                block = block.as_py()
                ids, counts, offsets, begin = open_block(block, digest)
                out: list[tuple] = []
                for k, i in enumerate(ids):
                    if doc_id is None or i == doc_id:
                        raw = deserialize(d.decompress(block[begin + offsets[k] : begin + offsets[k + 1]]))
                        out.append((i, start, counts[k], raw))
                    start += counts[k]
                for at in range(0, len(out), 256):
                    cols = list(zip(*out[at : at + 256]))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return (
        blocks.join(F.broadcast(parts), "part")
        .select("block", (F.col("before_in_part") + F.col("before_part")).alias("start"))
        .mapInArrow(run, ROWS)
    )


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: documents written as token files and read back."""
    path = common.scratch(spark, "tokens")
    write(common.texts(common.table(spark, sf_dir, "documents")), path, common.tokenizer_path("byte_bpe_50k.json"))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


