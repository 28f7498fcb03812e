"""Alignment of two tokenizers' tokens by the bytes they cover (operator 12).

Both token sequences of a text tile the same bytes.  All tokens are sorted by start, and a group
ends where a start reaches the running maximum of the ends before it, that is where tokens of
both end; each pair of an A and a B token of a group is a link.  This runs on arrays of many texts
at once, one after the other, since texts part groups too.

The corpus-wide count of a pair of ids is the number of documents that hold it linked.  Texts are
encoded once: tasks write blocks of documents with each document's distinct pairs as numbers of
the block's own pair list.  Counts are summed over the blocks' lists, joined back to the lists
(never to single documents) and cogrouped with the blocks.

Defined results: a text that is null or empty, or that either tokenizer does not give back byte
for byte (B has one code for blank and U+2581), has no tokens, zeros and an empty column; null
and repeated ids stay rows of their own and count as documents; an empty table gives no rows.
A document's pairs are held at once, and those of a group of many tokens on both sides are counted
by distinct ids, so that long runs cost no memory for each link.
"""

from __future__ import annotations

import array
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import Halves, Memo, byte_letters

#: Characters that are encoded and aligned at once, and distinct pairs, summed over documents, in a block.
SLICE, ENTRIES = 500_000, 300_000
#: Links of a group beyond which its pairs are counted by distinct ids.
WIDE = 1_024
SPANS = "doc_id long, start long, end long, a array<int>, b array<int>"
BLOCKS = (
    "block long, pairs array<long>, holders array<int>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, entries array<long>, pair_at binary, times binary"
)
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Vocabulary:
    """Ids of texts, with the bytes of each id. `pack`: texts with their leading space -> packed ids of each."""

    def __init__(self, tokens: list[bytes], pack):
        self.pack, self.count = pack, len(tokens)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def restores(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the ids' bytes, joined, are these."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids) or ends[-1] != len(raw):
            return False
        return self.bytes[np.repeat(self.begins[ids] - ends + sizes, sizes) + np.arange(len(raw))].tobytes() == raw


def byte_vocabulary(path: str) -> Vocabulary:
    """A byte-level file of the tokenizers library; strings of special tokens are ordinary text."""
    memo = Memo(path)
    memo.tokenizer.encode_special_tokens, memo.added = True, []
    byte = {c: b for b, c in byte_letters().items()}
    names = sorted((i, t) for t, i in memo.tokenizer.get_vocab(with_added_tokens=True).items())
    table = [b""] * (names[-1][0] + 1)
    for i, t in names:
        table[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
    return Vocabulary(table, lambda texts: list(map(memo.pack, texts)))


def piece_vocabulary(path: str) -> Vocabulary:
    """A sentencepiece file. Where no piece holds a blank after another character, a text's stretches of blanks and
    of what follows them are encoded alone, and each distinct one once: those of many texts that are new in one call."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    blank = array.array("I", [model.piece_to_id("▁")]).tobytes()
    cut = re.compile(" +[^ ]*").findall
    fresh: dict[str, bytes] = {" ": blank}
    known = Halves(fresh.__getitem__)

    def whole(texts: list[str]) -> list[bytes]:
        """The model puts the leading space there itself, but for an empty text."""
        return [array.array("I", ids).tobytes() if len(t) > 1 else blank for t, ids in zip(texts, model.encode([t[1:] for t in texts], num_threads=1))]

    def pack(texts: list[str]) -> list[bytes]:
        known.turn()
        cuts = list(map(cut, texts))
        new = [c for c in set().union(*cuts) if c not in known and c not in known.older]
        fresh.clear()
        fresh.update(zip(new, whole(new)))
        return [b"".join(map(known.__getitem__, own)) for own in cuts]

    apart = not any(re.search("[^▁]▁", p) for p in pieces)
    return Vocabulary(table, pack if apart else whole)


VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One a worker and file."""
    if path not in VOCABULARIES:
        VOCABULARIES[path] = piece_vocabulary(path) if path.endswith(".model") else byte_vocabulary(path)
    return VOCABULARIES[path]


def decimals(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of each number below count, left in rows that have a place to spare, and how many they are."""
    width = len(str(max(count - 1, 0))) + 1
    text = "".join(str(i).ljust(width) for i in range(count))
    return np.frombuffer(text.encode(), np.uint8).reshape(count, width), np.array([len(str(i)) for i in range(count)], np.int64)


class Aligned:
    """Tokens and groups of many texts, one after the other.

    a, b: ids; group_a, group_b: the group of each; n_a, n_b: tokens of each text; end_a, end_b: ends in bytes of all texts."""

    def __init__(self, texts: list[str], va: Vocabulary, vb: Vocabulary):
        none = np.zeros(0, np.int64)
        full = [" " + t if t and "▁" not in t else "" for t in texts]
        sides = [[np.frombuffer(ids, np.uint32).astype(np.int64) for ids in v.pack(full)] for v in (va, vb)]
        for k, t in enumerate(full):
            raw = t.encode()
            if not all(v.restores(side[k], raw) for v, side in zip((va, vb), sides)):
                sides[0][k] = sides[1][k] = none
        self.va, self.vb = va, vb
        self.n_a, self.n_b = (np.array([len(i) for i in side], np.int64) for side in sides)
        self.a, self.b = (np.concatenate([none, *side]) for side in sides)
        size_a, size_b = va.sizes[self.a], vb.sizes[self.b]
        self.end_a, self.end_b = np.cumsum(size_a), np.cumsum(size_b)
        starts, ends = np.concatenate([self.end_a - size_a, self.end_b - size_b]), np.concatenate([self.end_a, self.end_b])
        order = np.lexsort((np.arange(len(starts)) >= len(self.a), starts))
        reach = np.maximum.accumulate(ends[order])
        group = np.zeros(len(order), np.int64)
        group[order[1:]] = np.cumsum(starts[order[1:]] >= reach[:-1])
        self.group_a, self.group_b = group[: len(self.a)], group[len(self.a) :]
        self.groups = int(group[order[-1]]) + 1 if len(order) else 0
        self.count_a, self.count_b = (np.bincount(g, minlength=self.groups) for g in (self.group_a, self.group_b))
        self.first_a, self.first_b = (np.cumsum(c) - c for c in (self.count_a, self.count_b))
        # The groups of a text are those of its A tokens.
        self.tail_a, self.tail_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        edge = np.append(self.group_a, self.groups)
        self.group_from, self.group_to = edge[self.tail_a - self.n_a], edge[self.tail_a]
        self.n_groups = self.group_to - self.group_from
        links = np.concatenate([[0], np.cumsum(self.count_a * self.count_b)])
        self.n_links = links[self.group_to] - links[self.group_from]

    def columns(self) -> list[str]:
        """Hash of each text's groups, `a,a|b;a|b,b`: ids stand in rows of digits with a sign after, of which a mask is kept."""
        at = np.concatenate([np.arange(len(self.a)) + self.first_b[self.group_a], np.arange(len(self.b)) + (self.first_a + self.count_a)[self.group_b]])
        (digits_a, long_a), (digits_b, long_b) = digits_of(self.va), digits_of(self.vb)
        width = max(digits_a.shape[1], digits_b.shape[1])
        rows, long = np.empty((len(at), width), np.uint8), np.empty(len(at), np.int64)
        rows[at[: len(self.a)], : digits_a.shape[1]] = digits_a[self.a]
        rows[at[len(self.a) :], : digits_b.shape[1]] = digits_b[self.b]
        long[at] = np.concatenate([long_a[self.a], long_b[self.b]])
        signs = np.full(len(at), ord(","), np.uint8)
        first = self.first_a + self.first_b
        signs[first + self.count_a - 1], signs[first + self.count_a + self.count_b - 1] = ord("|"), ord(";")
        rows[np.arange(len(at)), long] = signs
        flat = memoryview(rows[np.arange(width) <= long[:, None]])
        ends = np.concatenate([[0], np.cumsum(long + 1)])[self.tail_a + self.tail_b].tolist()
        return [hashlib.sha256(flat[b : e - 1]).hexdigest() if e > b else "" for b, e in zip([0, *ends], ends)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each text: text, pair (a id times the B vocabulary, plus b id), number of links; by text and pair."""
        few = (self.count_a * self.count_b <= WIDE)[self.group_a]
        a, g = self.a[few], self.group_a[few]
        times = self.count_b[g]
        ends = np.cumsum(times)
        b = self.b[np.repeat(self.first_b[g] - ends + times, times) + np.arange(ends[-1] if len(ends) else 0)]
        text = np.repeat(np.arange(len(self.n_a)), self.n_a)[few]
        space = self.va.count * self.vb.count
        key = np.repeat(text * space + a * self.vb.count, times) + b
        found, links = np.unique(key, return_counts=True)
        wide = np.flatnonzero(self.count_a * self.count_b > WIDE)
        if len(wide):
            own = np.searchsorted(self.group_to, wide, "right")
            more = [self._wide(g) for g in wide.tolist()]
            key = np.concatenate([found, *(p + t * space for (p, _), t in zip(more, own.tolist()))])
            found, at = np.unique(key, return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, at, np.concatenate([links, *(n for _, n in more)]))
            links = total
        return found // space, found % space, links

    def _wide(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs and links of one group, by the distinct ids of both sides."""
        (a, n), (b, m) = (np.unique(ids[f : f + c], return_counts=True) for ids, f, c in ((self.a, self.first_a[g], self.count_a[g]), (self.b, self.first_b[g], self.count_b[g])))
        return np.add.outer(a * self.vb.count, b).ravel(), np.multiply.outer(n, m).ravel()


DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def digits_of(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    if v.count not in DIGITS:
        DIGITS[v.count] = decimals(v.count)
    return DIGITS[v.count]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(doc ids, texts) of about SLICE characters, or of one longer text."""
    for whole in batches:
        ids, texts = whole.column("doc_id").to_pylist(), whole.column("text").to_pylist()
        size = list(accumulate(map(len, texts), initial=0))
        begin = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or size[i + 1] - size[begin] > SLICE:
                yield ids[begin:i], texts[begin:i]
                begin = i


def blocks(docs: DataFrame, a_path: str, b_path: str, most: int = ENTRIES) -> DataFrame:
    """Documents encoded and aligned, in blocks: a row has a list of distinct pairs with the number of its documents that
    hold each, and for each document its counts and its pairs as places in that list with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = vocabulary(a_path), vocabulary(b_path)
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            pairs, places = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
            width = np.uint16 if len(pairs) <= 1 << 16 else np.uint32
            row = [number, pairs.tolist(), np.bincount(places, minlength=len(pairs)).tolist()]
            row += [[x for h in held for x in h[0][k]] for k in range(7)]
            row += [places.astype(width).tobytes(), np.concatenate([h[2] for h in held]).astype(np.uint32).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCK_TYPES)], schema=BLOCK_TYPES)

        for ids, texts in slices(batches):
            x = Aligned(texts, va, vb)
            text, pair, links = x.pairs()
            entries = np.bincount(text, minlength=len(ids))
            held.append(([ids, *(c.tolist() for c in (x.n_a, x.n_b, x.n_groups, x.n_links)), x.columns(), entries.tolist()], pair, links))
            size += len(pair)
            if size >= most:
                yield block()
                number, held, size = number + 1, [], 0
        if held:
            yield block()

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


_longs = pa.list_(pa.int64())
BLOCK_TYPES = pa.schema(
    [("block", pa.int64()), ("pairs", _longs), ("holders", pa.list_(pa.int32()))]
    + [(c, _longs) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.list_(pa.string())), ("entries", _longs), ("pair_at", pa.binary()), ("times", pa.binary())]
)


def pair_counts(blocks: DataFrame, width: int) -> DataFrame:
    """(pair, a, b, n, best) over all blocks: n documents hold the pair linked; best: no pair of its A id has more.

    width: ids of the B vocabulary, which bounds the pairs of an A id."""
    lists = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("p.*")
    counted = lists.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n"))
    a = F.floor(F.col("pair") / width)
    return counted.select("pair", a.alias("a"), (F.col("pair") - a * width).alias("b"), "n", (F.col("n") == F.max("n").over(Window.partitionBy(a))).alias("best"))


def scored(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents with n_best and count_sum over their links; blocks meet the counts of their own pair lists only."""
    needs = blocks.select("block", F.explode("pairs").alias("pair")).join(counts.select("pair", "n", "best"), "pair")
    needs = needs.select(F.col("block").alias("of_block"), "pair", "n", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        n, best = right.column("n").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        out = []
        for row in left.to_batches():
            for k in range(row.num_rows):
                get = lambda c: row.column(c)[k]  # noqa: B023, E731
                kind = np.uint16 if len(get("pairs").values) <= 1 << 16 else np.uint32
                at, times = np.frombuffer(get("pair_at").as_py(), kind), np.frombuffer(get("times").as_py(), np.uint32).astype(np.int64)
                ends = np.cumsum(get("entries").values.to_numpy())
                sums = []
                for value in (best, n):
                    total = np.concatenate([[0], np.cumsum(times * value[at])])
                    sums.append(pa.array(np.diff(total[np.concatenate([[0], ends])]), pa.int64()))
                whole = [get(c).values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                out.append(pa.table([*whole, *sums, get("groups_sha256").values], [c.split()[0] for c in SCORED.split(", ")]))
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(needs.groupBy("of_block")).applyInArrow(run, SCORED)


def spans(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, start, end, a, b): every group's byte range in blank + text, with the ids of both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = vocabulary(a_path), vocabulary(b_path)
        for ids, texts in slices(batches):
            x = Aligned(texts, va, vb)
            ends = x.end_a[x.first_a + x.count_a - 1]
            text = np.repeat(np.arange(len(ids)), x.n_groups)
            begins = np.concatenate([[0], ends])[:-1] if len(ends) else ends
            base = np.concatenate([[0], ends])[x.group_from][text]
            lists = [pa.ListArray.from_arrays(pa.array(np.append(f, len(i)), pa.int32()), pa.array(i, pa.int32())) for f, i in ((x.first_a, x.a), (x.first_b, x.b))]
            yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t in text.tolist()], pa.int64()), pa.array(begins - base), pa.array(ends - base), *lists], ["doc_id", "start", "end", "a", "b"])

    return docs.select("doc_id", "text").mapInArrow(run, SPANS)


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: alignment of every document's byte-level and sentencepiece tokens."""
    a, b = common.tokenizer_path("byte_bpe_50k.json"), common.tokenizer_path("piece_bpe_32k.model")
    made = common.written(blocks(common.texts(common.table(spark, sf_dir, "documents")), a, b), "aligned")
    return scored(made, pair_counts(made, vocabulary(b).count))
