"""Substring dedup by relative Lempel-Ziv parsing (operator 13).

A window is 50 consecutive words; a word goes if a window over it also starts in a document of a
smaller id.  Documents are factored against reference blocks, but only against those that can
hold a factor of theirs:

1. Of every 50 words, the run of 32 with the least hash is an anchor.  Equal windows have equal
   anchors, so documents that share a window share an anchor.  Each anchor that two documents
   share has one reference document, the least that holds it.
2. Around shared anchors of one reference a document's words form a segment.  The segments of
   reference documents are indexed; the others are factored greedily against them: from a window
   that the index knows as far as the words agree.  Factors of 50 words and more are duplicate
   spans; windows across a factor's end are looked up too, so none is missed.
3. Windows that their reference does not hold may still be shared by documents after it.  They
   are matched by a 128-bit hash, counted before they are joined.

Texts travel once, as blocks: distinct words, and each document's words as numbers in that list.
A reference with many takers is copied to several tasks, each of which has a share of them.

Defined results: a null or empty text has no words; a document of fewer than 50 words keeps all;
a null doc_id takes no part and keeps all; rows of one doc_id do not count against each other; a
window that occurs again in its own document alone stays; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 50, 32
#: Starts of anchors within a window.
CHOICES = WINDOW - ANCHOR + 1
#: Words, and distinct words, beyond which a block of documents ends; one longer document is a block of its own.
BLOCK_WORDS, BLOCK_DISTINCT = 600_000, 60_000
#: Anchors of takers for which a copy of their reference is sent, or four times its own anchors if those are more.
SHARE = 512
#: Odd multipliers of the rolling hashes.
BASE, MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
BLOCKS = "block long, words binary, codes binary, doc_id array<long>, n_words array<long>, anchor array<long>, lo array<long>, hi array<long>, n array<long>"
SEGMENTS = "ref long, share long, taker int, doc_id long, block long, doc int, start long, anchors array<int>, alone array<boolean>, words binary"
FOUND = "block long, doc int, start long, stop long, doc_id long, f1 long, f2 long"
KEPT = "doc_id long, n_words long, n_removed long, kept binary"


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word, in two columns."""
    return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in words), np.uint64).reshape(-1, 2)


def rolling(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each run of `size` values, modulo 2^64 by the differences of one running sum."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = (np.full(len(values), b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * down)])
    run = (total[size:] - total[:n]) * up[:n]
    run ^= run >> np.uint64(32)
    run *= MIX
    return run ^ (run >> np.uint64(29))


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hash at each start, place of the anchor of each window) of one stretch of hashed words."""
    runs = rolling(values, ANCHOR, BASE[0])
    if len(runs) < CHOICES:
        return runs, np.zeros(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(runs, CHOICES)
    step = 1 << 16  # bounds argmin's copies
    least = [seen[i : i + step].argmin(1) for i in range(0, len(seen), step)]
    return runs, np.arange(len(seen)) + np.concatenate(least)


class Codes(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def word_blocks(docs: DataFrame, words: int = BLOCK_WORDS, distinct: int = BLOCK_DISTINCT) -> DataFrame:
    """Documents in blocks, with each anchor of a block, the least and largest doc_id that hold it and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known, held = TaskContext.get().partitionId() << 32, Codes(), []

        def block() -> pa.RecordBatch:
            hashes = word_hashes(list(known))[:, 0] if known else np.zeros(0, np.uint64)
            who, what = [], []
            for i, codes in held:
                if i is not None and len(codes) >= WINDOW:
                    runs, at = anchors(hashes[codes])
                    own = np.unique(runs[np.unique(at)])
                    who.append(np.full(len(own), i, np.int64))
                    what.append(own)
            who, what = np.concatenate([np.zeros(0, np.int64), *who]), np.concatenate([np.zeros(0, np.uint64), *what])
            order = np.argsort(what, kind="stable")
            who, what = who[order], what[order]
            first = np.flatnonzero(np.concatenate([[True], what[1:] != what[:-1]])) if len(what) else np.zeros(0, np.int64)
            bounds = [np.minimum.reduceat(who, first), np.maximum.reduceat(who, first)] if len(first) else [first, first]
            width = np.uint16 if len(known) <= 1 << 16 else np.uint32
            row = [number, b" ".join(known), np.concatenate([np.zeros(0, width), *(c.astype(width) for _, c in held)]).tobytes(), [i for i, _ in held], [len(c) for _, c in held]]
            row += [what[first].view(np.int64), *bounds, np.diff(np.append(first, len(what)))]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCK_TYPES)], schema=BLOCK_TYPES)

        size = 0
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                # Without an argument, split parts bytes at exactly the six ASCII blanks.
                codes = np.fromiter(map(known.__getitem__, text.as_py().encode().split()), np.uint32)
                held.append((i, codes))
                size += len(codes)
                if size >= words or len(known) >= distinct:
                    yield block()
                    number, size, known, held = number + 1, 0, Codes(), []
        if held:
            yield block()

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


_longs = pa.list_(pa.int64())
BLOCK_TYPES = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("codes", pa.binary())] + [(c, _longs) for c in ("doc_id", "n_words", "anchor", "lo", "hi", "n")])


def shared_anchors(blocks: DataFrame) -> DataFrame:
    """(anchor, ref, shares, alone): anchors of several doc_ids with their reference, the number of its copies, and whether
    at most one document besides the reference holds the anchor."""
    every = blocks.select(F.explode(F.arrays_zip("anchor", "lo", "hi", "n")).alias("a")).select("a.*")
    held = every.groupBy("anchor").agg(F.min("lo").alias("ref"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where("ref < hi")
    own = Window.partitionBy("ref")  # at most the anchors of one document
    share = F.greatest(F.lit(SHARE), 4 * F.count("*").over(own))
    return held.select("anchor", "ref", F.ceil(F.sum("n").over(own) / share).alias("shares"), (F.col("n") <= 2).alias("alone"))


def opened(block: dict) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct words of a block, and each document's words as numbers."""
    words = block["words"].split(b" ") if block["words"] else []
    codes = np.frombuffer(block["codes"], np.uint16 if len(words) <= 1 << 16 else np.uint32)
    return words, np.split(codes, np.cumsum(block["n_words"])[:-1]) if block["n_words"] else []


def segments(blocks: DataFrame, shared: DataFrame) -> DataFrame:
    """Stretches of documents around shared anchors, by reference; those of the reference itself go to all its shares."""
    needs = blocks.select(F.col("block").alias("of_block"), F.explode("anchor").alias("anchor")).join(shared, "anchor")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        order = np.argsort(right.column("anchor").to_numpy())
        hashes, ref, shares, alone = (right.column(c).to_numpy(zero_copy_only=False)[order] for c in ("anchor", "ref", "shares", "alone"))
        for block in left.to_pylist() if len(hashes) else []:
            words, docs = opened(block)
            values = word_hashes(words)[:, 0] if words else np.zeros(0, np.uint64)
            for k, (i, codes) in enumerate(zip(block["doc_id"], docs)):
                if i is None or len(codes) < WINDOW:
                    continue
                runs, at = anchors(values[codes])
                at = np.unique(at)
                place = np.minimum(np.searchsorted(hashes, runs[at].view(np.int64)), len(hashes) - 1)
                there = hashes[place] == runs[at].view(np.int64)
                at, place = at[there], place[there]
                # A segment goes on while its reference stays and windows over neighbouring anchors touch.
                begin = np.flatnonzero(np.concatenate([[True], (ref[place][1:] != ref[place][:-1]) | (np.diff(at) > WINDOW + CHOICES - 1)])) if len(at) else at
                for b, e in zip(begin.tolist(), [*begin.tolist()[1:], len(at)]):
                    m, n, low = int(ref[place[b]]), int(shares[place[b]]), max(0, int(at[b]) - CHOICES + 1)
                    text = b" ".join(map(words.__getitem__, codes[low : int(at[e - 1]) + WINDOW].tolist()))
                    row = (i, block["block"], k, low, (at[b:e] - low).tolist(), alone[place[b:e]].tolist(), text)
                    taker = int(i != m)
                    for share in [hash((block["block"], k)) % n] if taker else range(n):
                        rows.append((m, share, taker, *row))
        columns = list(zip(*rows)) or [[]] * len(SEGMENT_TYPES)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SEGMENT_TYPES)], schema=SEGMENT_TYPES)

    return blocks.select("block", "words", "codes", "doc_id", "n_words").groupBy("block").cogroup(needs.groupBy("of_block")).applyInArrow(run, SEGMENTS)


SEGMENT_TYPES = pa.schema(
    [(c, pa.int64()) for c in ("ref", "share")] + [("taker", pa.int32()), ("doc_id", pa.int64()), ("block", pa.int64()), ("doc", pa.int32()), ("start", pa.int64())]
    + [("anchors", pa.list_(pa.int32())), ("alone", pa.list_(pa.bool_())), ("words", pa.binary())]
)


class Reference:
    """Indexed segments of one reference document."""

    def __init__(self):
        self.codes, self.parts, self.ready = Codes(), [], False

    def add(self, text: bytes) -> None:
        self.parts.append(np.fromiter(map(self.codes.__getitem__, text.split()), np.int64))
        self.ready = False

    def index(self) -> None:
        """Windows of all segments, which a number of their own parts, by hash."""
        apart = -1 - np.arange(len(self.parts))
        self.text = np.concatenate([np.append(p, a) for p, a in zip(self.parts, apart)]) if self.parts else np.zeros(0, np.int64)
        hashes = rolling(self.text.astype(np.uint64) + np.uint64(1), WINDOW, BASE[0])
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.ready = True

    def factors(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(start, stop) of greedy factors of at least a window, in order; those after a factor may begin within it."""
        if not self.ready:
            self.index()
        hashes = rolling(codes.astype(np.uint64) + np.uint64(1), WINDOW, BASE[0])
        if not len(self.sorted) or not len(hashes):
            return []
        place = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        hits = np.flatnonzero(self.sorted[place] == hashes)
        found, k = [], 0
        while k < len(hits):
            i = int(hits[k])
            source = int(self.order[place[i]])
            n = min(len(codes) - i, len(self.text) - source)
            differ = np.flatnonzero(codes[i : i + n] != self.text[source : source + n])
            stop = i + (int(differ[0]) if len(differ) else n)
            if stop - i < WINDOW:  # equal hashes of unequal windows
                k += 1
                continue
            found.append((i, stop))
            k = int(np.searchsorted(hits, stop - WINDOW + 1))  # the first window that reaches beyond the factor
        return found


def factored(segments: DataFrame) -> DataFrame:
    """Duplicate spans (f1, f2 null) of the segments' factors, and windows that are not in their reference but may be in
    another taker's text, with their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, reference = None, Reference()
        for b in batches:
            out: list[list] = [[] for _ in FOUND_TYPES]

            def put(*columns) -> None:
                for o, c in zip(out, columns):  # noqa: B023
                    o.append(c)

            names = ("ref", "share", "taker", "doc_id", "block", "doc", "start", "anchors", "alone", "words")
            for ref, share, taker, i, block, doc, start, own, alone, text in zip(*(b.column(c).to_pylist() for c in names)):
                if of != (ref, share):
                    of, reference = (ref, share), Reference()
                if not taker:
                    reference.add(text)
                    continue
                words = text.split()
                codes = np.fromiter(map(reference.codes.__getitem__, words), np.int64, len(words))
                found = reference.factors(codes)
                covered = np.zeros(max(0, len(codes) - WINDOW + 1), bool)
                for s, e in found:
                    covered[s : e - WINDOW + 1] = True
                n = len(found)
                if n:
                    none = np.zeros(n, np.int64)
                    put(none + block, none + doc, np.array([s + start for s, _ in found]), np.array([e + start for _, e in found]), none + i, none, none, np.ones(n, bool))
                asked = [a for a, only in zip(own, alone) if not only]
                if asked and not covered.all():
                    distinct = list(dict.fromkeys(words))
                    number = {w: k for k, w in enumerate(distinct)}
                    values = word_hashes(distinct)[[number[w] for w in words]]
                    _, at = anchors(np.ascontiguousarray(values[:, 0]))
                    left = np.flatnonzero(~covered & np.isin(at, asked))
                    if len(left):
                        none = np.zeros(len(left), np.int64)
                        f1, f2 = (rolling(np.ascontiguousarray(values[:, k]), WINDOW, BASE[k])[left].view(np.int64) for k in (0, 1))
                        put(none + block, none + doc, left + start, left + start + WINDOW, none + i, f1, f2, np.zeros(len(left), bool))
            if out[0]:
                *columns, spans = (np.concatenate(c) for c in out)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type, mask=spans if f.name in ("f1", "f2") else None) for c, f in zip(columns, list(FOUND_TYPES)[:-1])], [f.name for f in list(FOUND_TYPES)[:-1]])

    dealt = segments.repartition(common.parts(segments), "ref", "share").sortWithinPartitions("ref", "share", "taker")
    return dealt.mapInArrow(run, FOUND)


FOUND_TYPES = pa.schema([("block", pa.int64()), ("doc", pa.int32()), *((c, pa.int64()) for c in ("start", "stop", "doc_id", "f1", "f2")), ("span", pa.bool_())])


def duplicate_spans(blocks: DataFrame) -> DataFrame:
    """(block, doc, start, stop): spans of words that windows of smaller doc_ids cover; doc counts within its block."""
    shared = common.written(shared_anchors(blocks), "anchors")
    found = common.written(factored(segments(blocks, shared)), "factors")
    loose = found.where("f1 is not null")
    least = loose.groupBy("f1", "f2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("f1", "f2", "lo")
    later = loose.join(common.written(least, "windows"), ["f1", "f2"]).where("doc_id > lo")
    return found.where("f1 is null").select("block", "doc", "start", "stop").unionByName(later.select("block", "doc", "start", "stop"))


def kept(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words of each document outside its spans, joined by a blank."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("of_doc").to_numpy(), kind="stable")
        doc, start, stop = (right.column(c).to_numpy()[order] for c in ("of_doc", "start", "stop"))
        rows = []
        for block in left.to_pylist():
            words, docs = opened(block)
            bounds = np.searchsorted(doc, np.arange(len(docs) + 1))
            for k, (i, codes) in enumerate(zip(block["doc_id"], docs)):
                b, e = bounds[k], bounds[k + 1]
                # Spans that are open at a word: those that have begun less those that have ended.
                steps = np.bincount(start[b:e], minlength=len(codes) + 1) - np.bincount(stop[b:e], minlength=len(codes) + 1)
                keep = codes[np.cumsum(steps)[:-1] == 0] if e > b else codes
                rows.append((i, len(codes), len(codes) - len(keep), b" ".join(map(words.__getitem__, keep.tolist()))))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 4, KEPT_TYPES)], schema=KEPT_TYPES)

    cut = spans.select(F.col("block").alias("of_block"), F.col("doc").alias("of_doc"), "start", "stop")
    return blocks.select("block", "words", "codes", "doc_id", "n_words").groupBy("block").cogroup(cut.groupBy("of_block")).applyInArrow(run, KEPT)


KEPT_TYPES = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_words", "n_removed")), ("kept", pa.binary())])


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: what is left of every document's words."""
    blocks = common.written(word_blocks(common.texts(common.table(spark, sf_dir, "documents"))), "blocks")
    return kept(blocks, duplicate_spans(blocks)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB: every window by its text's hash.
DEDUPED_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM docs),
windows AS (SELECT r, doc_id, p, sha256(array_to_string(words[p : p + 49], ' ')) AS h FROM starts),
least AS (SELECT h, min(doc_id) AS m FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, p + unnest(range(50)) AS i FROM windows JOIN least USING (h) WHERE doc_id > m),
own AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs),
stay AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM own ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(stay.text, '')) AS kept_sha256 FROM docs LEFT JOIN stay USING (r)
"""
