"""Byte-level BPE by tree reduction (operator 9).

A text is the concatenation of the pattern's matches, each of which is encoded alone.  Within
a match, halves are encoded recursively and neighbours are joined: the tokens around the
seam are taken back to bytes and encoded again in a window that grows on either side until
the tokens next to the window's ends are stable.  A token sequence is the encoding of its
bytes exactly if every two neighbours in it are (each merge has a fixed rank), so a window
whose outer pairs each encode to themselves proves the whole join.  Joining is associative,
so any tree gives the same ids; decoding concatenates the bytes of neighbours, from leaves of a
run of tokens, up a tree likewise.

Defined results: a null or empty text has no ids, the hash of the empty string and no bytes;
very long matches are split in halves, never scanned pair by pair as one.
"""

from __future__ import annotations

import array
import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import BYTE_PATTERN, BYTE_PIECES, UNCOMMON, Halves

#: Byte strings up to this length are leaves of the encoding tree; runs of so many tokens are those of the decoding tree.
LEAF, RUN = 6, 1024
ENCODED = "doc_id long, ids array<int>"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Bpe:
    """Encoding and decoding by one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.common_cut = re.compile(BYTE_PIECES).findall if pattern == BYTE_PATTERN else self.cut
        self.pair_ok = Halves(self._pair_ok)
        self.windows = self.grown = 0  # boundary windows that were encoded again, and those that had to grow
        self.known = Halves(lambda piece: array.array("i", self.encode_piece(piece.encode())).tobytes())
        size = max(self.bytes_of, default=-1) + 1
        self.sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)

    def leaf(self, data: bytes) -> list[int]:
        """Ids of a short byte string: the adjacent pair of least rank, leftmost first, is merged until none is known."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        parts = [data[i : i + 1] for i in range(len(data))]
        far = len(ranks)
        scores = [ranks.get(a + b, far) for a, b in zip(parts, parts[1:])]
        while scores:
            least = min(scores)
            if least == far:
                break
            i = scores.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], far)
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], far)
        return [ranks[p] for p in parts]

    def _pair_ok(self, pair: tuple[int, int]) -> bool:
        return self.merged(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == [*pair]

    def merged(self, data: bytes) -> list[int]:
        """Ids of a byte string by merging alone, whatever its length."""
        return self.leaf(data)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of two encoded byte strings."""
        if not left or not right or self.pair_ok[left[-1], right[0]]:
            return left + right
        i, j = 1, 1
        while True:
            self.windows += 1
            window = self.merged(b"".join(self.bytes_of[t] for t in left[len(left) - i :] + right[:j]))
            left_ok = i == len(left) or self.pair_ok[left[-i - 1], window[0]]
            right_ok = j == len(right) or self.pair_ok[window[-1], right[j]]
            if left_ok and right_ok:
                return left[: len(left) - i] + window + right[j:]
            self.grown += 1
            i, j = (i if left_ok else min(len(left), 2 * i)), (j if right_ok else min(len(right), 2 * j))

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one match, by halves; levels of the tree are joined from the leaves up."""
        if len(data) <= LEAF:
            return self.leaf(data) if data else []
        level = [self.leaf(data[i : i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def pack(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers, one after the other."""
        self.known.turn()
        self.pair_ok.turn()
        cut = self.cut if UNCOMMON.search(text) else self.common_cut
        return b"".join(map(self.known.__getitem__, cut(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.pack(text), np.int32).tolist()

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """Bytes of all ids: neighbours are concatenated, level by level, from runs of tokens up."""
        ids = np.asarray(ids, np.int64)
        level = [self.run_bytes(ids[i : i + RUN]) for i in range(0, len(ids), RUN)] or [b""]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]

    def run_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of ids, gathered from the vocabulary's bytes."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[ids] - ends + sizes, sizes)].tobytes()


CODECS: dict[tuple[str, str], Bpe] = {}


def codec(path: str, pattern: str) -> Bpe:
    """The codec of this worker for a vocabulary file."""
    if (path, pattern) not in CODECS:
        CODECS[path, pattern] = Bpe(load_ranks(path), pattern)
    return CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            packed = [bpe.pack(t) for t in b.column("text").to_pylist()]
            offsets = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    return common.texts(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, bytes) of encoded documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            data = [bpe.decode(x.values.to_numpy() if x.is_valid else []) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(data, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"{ENCODED}, bytes binary")


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents encoded, then decoded."""
    import public_tokenizers

    path, pattern = common.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    done = decode(encode(common.table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
