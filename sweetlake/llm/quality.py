"""Quality scores by a factorisation machine (operator 2).

Features of a whole text are its words, hashed into DIM slots with damped, normed counts, its
structure statistics, and its recorded length (n_chars).  Every feature has a weight and a
vector of FACTORS numbers; pairs interact by the product of their vectors, summed in linear
time as half of (sum of v x)^2 - sum of (v x)^2.  The machine is fitted on the driver by
AdaGrad over at most SAMPLE labelled documents (least hash of doc_id, one row each, of at most
SAMPLE_BYTES), whose features Spark computes; scoring runs where the texts are.

Learning uses only labels of rows with crc32(doc_id as text) mod 3 other than 1; labels, lang,
source and doc_id are never features.

Defined results: a null text counts as empty and is scored from its statistics; a null n_chars
counts as 0; a null doc_id is kept and not held out; of several labels of a document the
largest counts, null labels none; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .near_dedup import documents_of, word_hashes

DIM, FACTORS = 1 << 14, 8
#: Labelled documents that the machine is fitted on, at most, and bytes of a text among them: the bound of what
#: reaches the driver.  Longer texts are scored like all others.
SAMPLE, SAMPLE_BYTES = 6_000, 20_000
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.05, 1e-4

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?'\"()",
    "mark": b"!#$%&*|<>{}[]=~^+@/\\_",
    "blank": b" \t\r",
    "line": b"\n",
}
TABLES = np.array([[chr(c).encode("latin-1") in {bytes([x]) for x in s} for c in range(256)] for s in CLASSES.values()], np.float64)
STATS = len(CLASSES) + 7


@dataclass
class Features:
    """Hashed words as (document, slot, value) and a row of statistics per document."""

    n: int
    doc: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    stats: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> Features:
    n = len(offsets) - 1
    with np.errstate(over="ignore"):
        hashes, doc = word_hashes(data, offsets)
        words = np.bincount(doc, minlength=n).astype(np.float64)
        keys, counts = np.unique(doc * DIM + (hashes % np.uint64(DIM)).astype(np.int64), return_counts=True)
        pairs = hashes[:-1] * np.uint64(0xD1342543DE82EF95) + hashes[1:]
        inside = doc[:-1] == doc[1:]
        pair_doc = doc[:-1][inside]
        order = np.lexsort((pairs[inside], pair_doc))
        p, d = pairs[inside][order], pair_doc[order]
        fresh = np.ones(len(p), bool)
        fresh[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
    owner, slot = keys // DIM, keys % DIM
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(owner, value**2, minlength=n))
    value = value / np.maximum(norm[owner], 1e-9)
    size = np.diff(offsets).astype(np.float64)
    share = []
    for table in TABLES:
        run = np.concatenate([[0.0], np.cumsum(table[data])])
        share.append((run[offsets[1:]] - run[offsets[:-1]]) / np.maximum(size, 1))
    distinct = np.bincount(owner, minlength=n)
    n_pairs = np.bincount(pair_doc, minlength=n)
    more = [
        np.log1p(size) / 10,
        np.log1p(words) / 10,
        size / np.maximum(words, 1) / 10,
        distinct / np.maximum(words, 1),
        np.bincount(d, fresh, minlength=n) / np.maximum(n_pairs, 1),
        (words < 5).astype(np.float64),
        np.log1p(np.maximum(n_chars, 0)) / 10,
    ]
    return Features(n, owner, slot, value, np.stack([*share, *more], axis=1))


@dataclass
class Machine:
    """w0 + w x + half of the squared sum less the sum of squares, over FACTORS dimensions."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def parts(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(margins, sums of v x, standardized statistics)."""
        x = np.clip((f.stats - self.mean) / self.scale, -4, 4) * 0.25
        sums, squares = x @ self.v[DIM:], (x**2) @ (self.v[DIM:] ** 2)
        linear = self.w0 + x @ self.w[DIM:] + np.bincount(f.doc, self.w[f.slot] * f.value, minlength=f.n)
        for k in range(self.v.shape[1]):
            vx = self.v[f.slot, k] * f.value
            sums[:, k] += np.bincount(f.doc, vx, minlength=f.n)
            squares[:, k] += np.bincount(f.doc, vx**2, minlength=f.n)
        return linear + 0.5 * (sums**2 - squares).sum(axis=1), sums, x

    def score(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(f)[0], -30, 30)))


def some(f: Features, chosen: np.ndarray) -> Features:
    """Features of some documents, in that order."""
    begin, end = np.searchsorted(f.doc, chosen), np.searchsorted(f.doc, chosen + 1)
    at = np.concatenate([np.arange(a, b) for a, b in zip(begin, end)]) if len(chosen) else np.zeros(0, np.int64)
    return Features(len(chosen), np.repeat(np.arange(len(chosen)), end - begin), f.slot[at], f.value[at], f.stats[chosen])


def fit(f: Features, label: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """AdaGrad on the log loss."""
    rng = np.random.default_rng(seed)
    width = DIM + STATS
    m = Machine(0.0, np.zeros(width), rng.normal(0, 0.02, (width, FACTORS)), f.stats.mean(axis=0), f.stats.std(axis=0) + 1e-6)
    g0, gw, gv = 1e-6, np.full(width, 1e-6), np.full((width, FACTORS), 1e-6)
    stat_ids = np.arange(DIM, width)
    for _ in range(epochs):
        order = rng.permutation(f.n)
        for at in range(0, f.n, BATCH):
            chosen = order[at : at + BATCH]
            b = some(f, chosen)
            margin, sums, x = m.parts(b)
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[chosen]) / b.n
            dw = np.bincount(b.slot, err[b.doc] * b.value, minlength=width)
            dw[DIM:] = err @ x
            used = np.unique(b.slot)
            place = np.searchsorted(used, b.slot)
            ids = np.concatenate([used, stat_ids])
            dv = np.zeros((len(ids), FACTORS))
            for k in range(FACTORS):
                own = m.v[b.slot, k] * b.value
                dv[: len(used), k] = np.bincount(place, err[b.doc] * b.value * (sums[b.doc, k] - own), minlength=len(used))
                dv[len(used) :, k] = err @ (x * sums[:, k : k + 1]) - m.v[DIM:, k] * (err @ x**2)
            step = dw[ids] + DECAY * m.w[ids]
            dv += DECAY * m.v[ids]
            gw[ids] += step**2
            gv[ids] += dv**2
            g0 += err.sum() ** 2
            m.w[ids] -= RATE * step / np.sqrt(gw[ids])
            m.v[ids] -= RATE * dv / np.sqrt(gv[ids])
            m.w0 -= RATE * err.sum() / np.sqrt(g0)
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chars) with nulls filled; n_chars may be missing."""
    common.small_batches(docs.sparkSession)
    n = F.coalesce(F.col("n_chars").cast("long"), F.lit(0)) if "n_chars" in docs.columns else F.length("text").cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(n, F.lit(0)).alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """A machine fitted on at most `sample` labelled documents that are not held out."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("quality").alias("quality"))
    # At most `sample` rows of two numbers: the bound of what is broadcast.
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    rows = taken(docs).where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    # Of rows of one doc_id the one of the least text hash: at most a row a label reaches the driver.
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by(F.struct("text", "n_chars"), F.struct(F.xxhash64("text"), "n_chars")).alias("row")).select("doc_id", "quality", "row.text", "row.n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, ids = b.column("quality").to_pylist(), b.column("doc_id").to_pylist()
            for at, data, offsets in documents_of(b.column("text")):
                f = features(data, offsets, b.column("n_chars").slice(at, len(offsets) - 1).to_numpy())
                cut = np.searchsorted(f.doc, np.arange(f.n + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at : at + f.n], pa.int64()),
                        pa.array([int(x) for x in label[at : at + f.n]], pa.int32()),
                        pa.array([f.slot[a:z].astype(np.int32) for a, z in zip(cut, cut[1:])], pa.list_(pa.int32())),
                        pa.array([f.value[a:z].astype(np.float32) for a, z in zip(cut, cut[1:])], pa.list_(pa.float32())),
                        pa.array(list(f.stats), pa.list_(pa.float64())),
                    ],
                    ["doc_id", "label", "slot", "value", "stats"],
                )

    made = rows.mapInArrow(run, "doc_id long, label int, slot array<int>, value array<float>, stats array<double>").toArrow()
    if not made.num_rows:
        return None
    made = made.sort_by([("doc_id", "ascending")]).slice(0, sample)
    sizes = np.array([len(x) for x in made.column("slot")])
    label = made.column("label").to_numpy().astype(np.float64)
    flat = lambda c: made.column(c).combine_chunks().flatten().to_numpy()
    f = Features(made.num_rows, np.repeat(np.arange(made.num_rows), sizes), flat("slot").astype(np.int64), flat("value").astype(np.float64), flat("stats").reshape(made.num_rows, STATS))
    del made
    return fit(f, label)


def score(docs: DataFrame, machine: Machine | None, name: str = "quality_score") -> DataFrame:
    """docs' rows, all columns kept, with their score as column `name` (which docs must not have); those without machine score 0.5."""
    if machine is None:
        return docs.withColumn(name, F.lit(0.5))
    small = Machine(float(machine.w0), machine.w.astype(np.float32), machine.v.astype(np.float32), machine.mean, machine.scale)
    schema = docs.withColumn(name, F.lit(0.5)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").cast(pa.string()).fill_null("")
            n_chars = b.column("n_chars").cast(pa.int64()).fill_null(0).to_numpy() if "n_chars" in b.schema.names else np.array([len(t.as_py()) for t in text])
            scores = [small.score(features(data, offsets, n_chars[at : at + len(offsets) - 1])) for at, data, offsets in documents_of(text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: quality of all documents."""
    docs = taken(common.table(spark, sf_dir, "documents"))
    machine = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, machine).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier predicts as good, with their own columns."""
    name = common.free(docs, "quality_score")
    return score(docs, train(docs, labels), name).where(F.col(name) >= 0.5).drop(name)
