"""Near-duplicate groups by SuperMinHash (operator 10).

Texts become sets of hashed five-word shingles.  Documents of equal sets are one class.  Each
set's SuperMinHash signature ranks its elements by one random permutation each, of which only
as many steps are drawn as can still lower the signature (early stopping); it is cut into
bands.  In a band's bucket every class is first compared with one hub, the bucket's least
class; in further rounds, in buckets that still hold several components, with hubs drawn from
the bucket's main component.  That joins large groups of near copies in linear work.  Then, in
buckets still mixed, classes of different components are compared.  A pair counts only if its
full sets say so.  Verified pairs go through connected components.

Link: 100 * |A and B| >= 75 * |A or B|.  With 32 bands of 4 rows a pair at exactly 0.75 meets
in no band with probability 5e-6.  Before sets are compared, parity sketches of 1024 bits are:
they differ in no more bits than the sets differ in elements, and a linked pair's sets differ
in at most a seventh of their summed sizes.  (Where the sketches are nearly full, six standard
deviations above the expected difference is the limit, if that is lower.)

Defined results: a null or empty text, or one without words, has no shingle and is linked with
nothing; fewer than five words are one shingle; a null doc_id takes no part and has a null
component, kept; rows with one doc_id are one node; ties go to the smaller doc_id; an empty
table gives no rows.  Only A-Z are lowered and only ASCII blanks part words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components, forest_roots
from . import common

WORDS = 5
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Bits of a parity sketch.
BITS = 1024
#: Rounds of comparing with a hub of the bucket's main component.
ROUNDS = 2
#: Classes of a block of a large band: two blocks meet in a task.
BLOCK = 4_096
#: Bytes of text that are hashed together.
BYTES = 1_000_000

U = np.uint64
SHIFT = U(48)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (two multiply-xorshift rounds)."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
with np.errstate(over="ignore"):
    LETTER = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1]
    LETTER[BLANK] = 0


def powers(n: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    out = np.full(max(1, n), base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word of documents that lie one after the other in `data`."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    full = ~BLANK[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = ~full[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = np.flatnonzero(full & first)
    if not len(begins):
        return np.zeros(0, U), np.zeros(0, np.int64)
    place = np.arange(len(data))
    place[begins[0] :] -= np.repeat(begins, np.diff(np.append(begins, len(data))))
    place[: begins[0]] = 0
    table = powers(int(place.max()) + 1)
    hashes = np.add.reduceat(LETTER[data] * table[place], begins)
    return mix(hashes), np.searchsorted(offsets, begins, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    with np.errstate(over="ignore"):
        hashes, doc = word_hashes(data, offsets)
        n = len(offsets) - 1
        bounds = np.searchsorted(doc, np.arange(n + 1))
        most = max(0, len(hashes) - words + 1)
        rolled = np.zeros(most, U)
        for k in range(words):
            rolled = rolled * U(0xD1342543DE82EF95) + hashes[k : k + most]
        rolled = mix(rolled)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                few = U(b - a)
                for h in hashes[a:b]:
                    few = few * U(0xD1342543DE82EF95) + h
                out.append(mix(np.array([few ^ U(0x5BD1E995)], U)))
            else:
                out.append(np.zeros(0, U))
        return out


def super_min_hash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures of non-empty sets: slot -> least (step, random number) over the elements.

    Every element walks a random permutation of the slots; at step j it offers j and a random
    fraction to the slot that the permutation has there.  A set stops once all its slots hold
    less than step j + 1."""
    with np.errstate(over="ignore"):
        x = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        best = np.full((len(sets), slots), np.iinfo(U).max, U)
        flat = best.ravel()
        order: np.ndarray | None = None
        for j in range(slots):
            draw = mix(x + U(j + 1) * U(0x9E3779B97F4A7C15))
            k = (j + (draw & U(0xFFFF)) % U(slots - j)).astype(np.int64)
            if order is None:
                slot = k
            else:
                at = np.arange(len(x))
                slot = order[at, k].astype(np.int64)
                order[at, k] = order[:, j]
            np.minimum.at(flat, owner * slots + slot, (U(j) << SHIFT) | (draw >> U(16)))
            going = best.max(axis=1) >= (U(j + 1) << SHIFT)
            if j + 1 == slots or not going.any():
                break
            left = going[owner]
            if order is None:
                x, owner, k = x[left], owner[left], k[left]
                order = np.broadcast_to(np.arange(slots, dtype=np.uint16), (len(x), slots)).copy()
                order[np.arange(len(x)), k] = 0
            elif not left.all():
                x, owner, order = x[left], owner[left], order[left]
        return best


def parity_sketch(elements: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit integers; each element turns one bit over."""
    hits = np.bincount((elements >> U(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS)
    return np.packbits((hits & 1).astype(np.uint8)).view(np.int64)


def documents_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of documents with about BYTES of text."""
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES, "right")) - 1)
        end = min(end, n)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


SIGNED = "doc_id long, n_shingles long, key binary, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, key of the set, band hashes, sketch) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("text")
            for at, data, offsets in documents_of(column):
                sets = shingle_sets(data, offsets)
                n = [len(s) for s in sets]
                full = [i for i, s in enumerate(sets) if len(s)]
                bands, sketch = [[] for _ in sets], [[] for _ in sets]
                if full:
                    best = super_min_hash([sets[i] for i in full])
                    with np.errstate(over="ignore"):
                        h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), (len(full), BANDS)).copy()
                        for r in range(ROWS):
                            h = mix(h * U(0xD1342543DE82EF95) + mix(best[:, r::ROWS]))
                    for i, x in zip(full, h.view(np.int64)):
                        bands[i], sketch[i] = x, parity_sketch(sets[i])
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(sets)), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, longs), pa.array(sketch, longs)],
                    ["doc_id", "n_shingles", "key", "bands", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def sets_of(docs: DataFrame) -> DataFrame:
    """(id, shingles) with each document's full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in documents_of(b.column("text")):
                sets = shingle_sets(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(sets)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "shingles"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "id long, shingles array<long>")


def near(a: str, b: str) -> Column:
    """Whether two classes may be linked, by their sizes and sketches; true for every linked pair."""
    n = [F.col(f"{x}.n_shingles") for x in (a, b)]
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(BITS // 64)))
    most = (n[0] + n[1]) / 7
    expected = BITS / 2 * (1 - F.exp(-2 * most / BITS))
    return (100 * F.least(*n) >= 75 * F.greatest(*n)) & (differ <= F.least(most, expected + 3 * BITS**0.5))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (src, dst) that are linked by their full sets (id, shingles)."""
    one = pairs.join(sets.select(F.col("id").alias("src"), F.col("shingles").alias("a")), "src")
    two = one.join(sets.select(F.col("id").alias("dst"), F.col("shingles").alias("b")), "dst")
    both = F.size(F.array_intersect("a", "b"))
    return two.where(100 * both >= 75 * (F.size("a") + F.size("b") - both)).select("src", "dst").distinct()


def paired(pairs: DataFrame, slim: DataFrame) -> DataFrame:
    """Of pairs (src, dst) those that may be linked."""
    return (
        pairs.join(slim.withColumnRenamed("id", "src").alias("a"), "src")
        .join(slim.withColumnRenamed("id", "dst").alias("b"), "dst")
        .where(near("a", "b"))
        .select("src", "dst")
    )


def mixed_bands(shared: DataFrame, known: DataFrame) -> DataFrame:
    """(band, id, comp) of the bands that hold several components."""
    named = shared.join(known, "id", "left").select("band", "id", F.coalesce("component", "id").alias("comp"))
    mixed = named.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    return named.join(mixed, "band")


def hub_pairs(mixed: DataFrame, turn: int) -> DataFrame:
    """A hub, drawn from the largest component of each band, with each class of the others."""
    counts = mixed.groupBy("band", "comp").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", "band", F.lit(turn))).alias("hub"))
    main = counts.groupBy("band").agg(F.max_by(F.struct("comp", "hub"), F.struct("n", "comp")).alias("m"))
    return (
        mixed.join(main, "band")
        .where(F.col("comp") != F.col("m.comp"))
        .select(F.least("m.hub", "id").alias("src"), F.greatest("m.hub", "id").alias("dst"))
        .where("src <> dst")
        .distinct()
    )


def across_pairs(mixed: DataFrame, slim: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of one band and different components that may be linked.

    A band of many classes is cut by hash into blocks of about `block`; every two blocks meet in a place of their
    own, and in such a band only classes meet whose sizes are in the same or neighbouring powers of 4/3, as a
    linked pair's are.  So no task holds a whole hot band, and no pair that may be linked is left out."""
    blocks = mixed.groupBy("band").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    wide = mixed.join(blocks, "band").join(slim, "id")
    wide = wide.withColumn("own", F.pmod(F.xxhash64("id", F.lit(23)), F.col("blocks")).cast("int"))
    wide = wide.withColumn("level", F.when(F.col("blocks") > 1, F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(4 / 3)))).otherwise(F.lit(0)).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    levels = F.when(F.col("blocks") > 1, F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).otherwise(F.array("level"))
    kept = ["id", "comp", "n_shingles", "sketch"]
    left = wide.select("band", F.col("own").alias("x"), F.explode(every).alias("y"), F.struct(*kept).alias("a"), levels.alias("levels"))
    left = left.select("band", "x", "y", F.explode("levels").alias("level"), "a")
    right = wide.select("band", F.explode(every).alias("x"), F.col("own").alias("y"), "level", F.struct(*kept).alias("b"))
    return (
        left.join(right, ["band", "x", "y", "level"])
        .where((F.col("a.comp") < F.col("b.comp")) & near("a", "b"))
        .select(F.least("a.id", "b.id").alias("src"), F.greatest("a.id", "b.id").alias("dst"))
        .where("src <> dst")
        .distinct()
    )


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: those that links join take the least component's name."""
    name = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"{c}_comp"))
    ends = links.join(name("src"), "src", "left").join(name("dst"), "dst", "left")
    joined = connected_components(ends.select(F.coalesce("src_comp", "src").alias("src"), F.coalesce("dst_comp", "dst").alias("dst")))
    old = known.unionByName(joined.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
    new = joined.select(F.col("id").alias("component"), F.col("component").alias("now"))
    return old.join(new, "component", "left").select("id", F.coalesce("now", "component").alias("component"))


def groups(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    docs = common.texts(docs)
    signed = common.written(signatures(docs), "signed")
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = common.written(
        linkable.groupBy("key")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    slim = classes.select("id", "n_shingles", "sketch")
    rows = classes.select(F.explode("bands").alias("band"), "id")
    full = rows.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("most")).where("hub <> most").drop("most")
    shared = common.written(rows.join(full, "band"), "bands")  # only bands with several classes

    # Full sets of the classes that have such a band; texts move once.
    wanted = shared.select(F.col("id").alias("wanted")).distinct()
    sets = common.written(sets_of(docs.join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")), "sets", "lz4")

    stars = paired(shared.where("id <> hub").groupBy(F.col("id").alias("dst")).agg(F.min("hub").alias("src")), slim)
    # Each class has one star's hub above it, of a smaller id: a forest.
    known = common.written(forest_roots(verified(common.written(stars, "stars"), sets)), "components")
    shared = shared.drop("hub")
    for turn in range(rounds + 1):
        mixed = common.written(mixed_bands(shared, known), "mixed")
        pairs = paired(hub_pairs(mixed, turn), slim) if turn < rounds else across_pairs(mixed, slim)
        links = common.written(verified(common.written(pairs, "pairs"), sets), "links")
        if not links.isEmpty():
            known = common.written(merged(known, links), "components")

    copies = linkable.select(F.col("key").alias("k"), F.col("doc_id").alias("copy")).join(classes.select("key", "id"), F.col("k") == F.col("key"))
    copies = copies.join(known, "id", "left").select("copy", F.coalesce("component", "id").alias("component"))
    named = copies.groupBy("copy").agg(F.min("component").alias("component"), F.collect_set("component").alias("all"))
    # Rows of one doc_id with different texts are one node: it joins their components.
    twice = named.where(F.size("all") > 1).select(F.col("component").alias("src"), F.explode("all").alias("dst"))
    final, twice = named.select(F.col("copy").alias("id"), "component"), common.written(twice, "twice")
    if not twice.isEmpty():
        final = merged(final, twice)
    return (
        signed.select("doc_id", "n_shingles")
        .join(final.withColumnRenamed("id", "member"), F.col("doc_id") == F.col("member"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The documents of which one of each group stays, with all their columns.

    Rows of one doc_id are one node: if it stays, so does one row for each of its distinct texts
    (a null text is one of them).  Rows without doc_id all stay."""
    marks = groups(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias("mark_id")).agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    marks = common.written(marks.where("not kept or n > 1"), "marks")
    own = docs["doc_id"] == marks["mark_id"]
    once = docs.join(marks, own, "left_anti")
    again = marks.where("kept")
    if again.isEmpty():
        return once
    return once.unionByName(docs.join(again, own, "left_semi").dropDuplicates(["doc_id", "text"]))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: near-duplicate groups of all documents."""
    return groups(common.table(spark, sf_dir, "documents"))
