"""Packing documents into fixed-length sequences (operator 6).

Rows are dealt at random into groups of a bounded mean size of text.  In a group, whole
sequences are cut from the front of long documents; the rests are placed by first-fit
decreasing, where a tournament tree over the bins' free room finds the first bin that fits in
logarithmic time.  A bin left with much room is cut into sequences whose lengths are powers of
two, which need no padding.

Ids travel to their group in two bytes where the vocabulary allows it.  A group's task holds
its ids once: pieces are slices of one buffer.

Defined results: a null or empty text is a document of the end id only; a null doc_id is an
id like others; rows of one doc_id are separate documents, dealt apart; an empty table gives no
pieces.  A document's ids are one value, so a document must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import packed_ids, widest

END = 2
LENGTH = 4096
#: Mean bytes of text, and mean number of documents, of a group at most.
GROUP_BYTES, GROUP = 16_000_000, 4096
#: Rows that are encoded before their ids leave the worker.
SLICE = 256
#: Bins with more room than this part of LENGTH are cut into powers of two.
LOOSE = 32

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Complete binary tree whose nodes hold the largest free room below; leaves are bins in order."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.best = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for `size`, which it then takes."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        found = node - self.leaves
        best[node] -= size
        while node > 1:
            node //= 2
            now = max(best[2 * node], best[2 * node + 1])
            if best[node] == now:
                break
            best[node] = now
        return found


def first_fit_decreasing(sizes: list[int], room: int) -> list[int]:
    """The bin of each item; items go by size, largest first, ties by position."""
    tree, bins = Tournament(len(sizes), room), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins[i] = tree.place(sizes[i])
    return bins


def arrange(lengths: list[int], room: int = LENGTH, loose: int = LOOSE) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of documents of these lengths."""
    sequence, rests = 0, []
    for d, n in enumerate(lengths):
        for start in range(0, n - n % room, room):
            yield d, start, room, sequence, 0
            sequence += 1
        if n % room:
            rests.append((d, n - n % room, n % room))
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for piece, b in zip(rests, first_fit_decreasing([r[2] for r in rests], room)):
        bins.setdefault(b, []).append(piece)
    for b in sorted(bins):
        fill = sum(p[2] for p in bins[b])
        sizes = [fill] if room - fill <= room // loose else [1 << k for k in range(fill.bit_length() - 1, -1, -1) if fill >> k & 1]
        offset = 0
        for d, start, n in bins[b]:
            while n:
                take = min(n, sizes[0] - offset)
                yield d, start, take, sequence, offset
                start, n, offset = start + take, n - take, offset + take
                if offset == sizes[0]:
                    del sizes[0]
                    sequence, offset = sequence + 1, 0
        if offset:
            sequence += 1


def pack(docs: DataFrame, tokenizer: str, end: int = END, room: int = LENGTH, group: int = GROUP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit), the sequence each lies in and where.

    sequence_id is the group's number times 2^32 plus the sequence's in the group."""
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    groups = max(1, -(-size.n // group), -(-size.size // group_bytes))
    # The row's place in its partition deals rows of one doc_id, and those without, apart.
    dealt = common.texts(docs).withColumn("grp", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit(17)), F.lit(groups)))
    narrow = "<u2" if max(end, widest(tokenizer)) < 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                ids = [np.frombuffer(x, "<u4").astype(narrow).tobytes() for x in packed_ids(tokenizer, b.column("text").to_pylist(), end)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grp"), pa.array(ids, pa.binary())], ["doc_id", "grp", "ids"])

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        column = rows.column("ids").combine_chunks()
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        ids = np.frombuffer(column.buffers()[2], narrow, (offsets[-1] - offsets[0]) // np.dtype(narrow).itemsize, offsets[0]).astype("<u4")
        lengths = np.diff(offsets) // np.dtype(narrow).itemsize
        doc, start, length, sequence, offset = np.array(sorted(arrange(lengths.tolist(), room)), np.int64).reshape(-1, 5).T
        cuts = pa.py_buffer(np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int64))
        # In document order pieces follow each other, so the ids of all documents are their buffer.
        pieces = pa.Array.from_buffers(pa.large_binary(), len(length), [None, cuts, pa.py_buffer(ids)])
        columns = [rows.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pieces.cast(pa.binary()), pa.array(lengths[doc]), pa.array((rows.column("grp")[0].as_py() << 32) + sequence), pa.array(offset)]
        return pa.table(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    encoded = dealt.select("doc_id", "grp", "text").mapInArrow(encode, "doc_id long, grp long, ids binary")
    return encoded.groupBy("grp").applyInArrow(place, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents in sequences of at most 4096 tokens."""
    return digest(pack(common.table(spark, sf_dir, "documents"), common.tokenizer_path("word_bpe_49k.json")))
