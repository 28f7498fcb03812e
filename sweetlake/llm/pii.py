"""Personal data by bootstrapped contextual extraction (operator 1).

Base matches of four kinds (email, ip, card, phone) are seeds; so are secrets, key-like strings
that are assigned to a name of a credential, which are only accepted through a pattern, too.  The words and cue before a match are its lexical
patterns; identifier-like strings that are no base match are candidates with patterns of their
own.  Patterns and values form a graph whose scores Spark computes in rounds until nothing moves:
a pattern scores by the share of its distinct values that are known to be of one kind, a candidate
by the patterns it stands in (noisy or).  Candidates that score high, in patterns with enough
distinct known values, and known values that stand elsewhere in another form or without cue, are
added as spans; base spans always stay.

Defined results: a null or empty text has no spans; positions are code points, ends exclusive;
copies of a text give their values once to the graph; a null doc_id is kept; repeated rows give
repeated results; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds in the order of all results; the first BASE have base matches.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE, SECRET = 4, 4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Candidates: number-like, address-like and key-like strings.
NUMBER = re.compile(r"(?<![\w+])[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![\w])")
ADDRESS = re.compile(r"(?<![^\s<(\[\"'])[A-Za-z0-9._%+-]{2,64}(?:@| ?\(at\) ?| ?\[at\] ?| at )[A-Za-z0-9-]{2,63}(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]{2,63}){0,4}")
DOTTED = re.compile(r"\.|\(dot\)|\[dot\]| dot ")
KEY = re.compile(r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/-]{16,}+={0,2}(?![A-Za-z0-9_+/=-])")
#: Values of more characters are known by their hash.
LONG_VALUE = 64
#: Fixed value: what a name of a credential holds, with the sign that assigns to it.
CREDENTIAL = re.compile(r"(?:token|secret|passw(?:or)?d|credential|auth|(?:api|access|private|secret)[_ -]?key)[\w.-]{0,24}[\"']?\s{0,3}(?::=|=>|=|:)\s{0,3}[\"']?\Z", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+|[:=#]")
CUES = ":=#"
LEFT = 48

#: A pattern needs so many known distinct values, and such a share of all its values, of one kind.
SUPPORT, SURE = 5, 0.8

FOUND = (
    "row string, doc_id long, sha string, base array<struct<kind:int,b:int,e:int>>, "
    "seeds array<struct<kind:int,value:string,pattern:string>>, "
    "candidates array<struct<kind:int,b:int,e:int,value:string,pattern:string>>"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, each found from its @, so in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:  # what precedes an @ is walked once: @ is no local character
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, begin, end) of all base matches, by kind, then position."""
    out = [(0, b, e) for b, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


def patterns(text: str, begin: int) -> list[str]:
    """Lexical patterns before a position: word and cue, or the last two words."""
    left = text[max(0, begin - LEFT) : begin]
    last = WORD.findall(left.casefold())[-3:]
    if last and last[-1] in CUES:
        return [" ".join(last[-k:]) for k in (2, 3) if len(last) >= k]
    return [" ".join(last[-2:])] if len(last) >= 2 else []


def kinds_of(value: str) -> list[int]:
    """Kinds whose values look like this candidate."""
    if not value[:1].isdigit() or "@" in value or "at" in value:
        return [0]
    n = sum(c.isdigit() for c in value)
    return [k for k, fits in ((2, 12 <= n <= 19), (3, 7 <= n <= 15)) if fits]


def normal(value: str) -> str:
    """Values that differ in separators or case only are one instance."""
    value = re.sub(r"[\s().+-]+", "", value.casefold()) if value[:1] in "+0123456789" else value.casefold()
    return value if len(value) <= LONG_VALUE else hashlib.sha256(value.encode()).hexdigest()


def secret(value: str) -> str:
    return value.casefold() if len(value) <= LONG_VALUE else hashlib.sha256(value.casefold().encode()).hexdigest()


def key_like(value: str) -> bool:
    """Letters and digits, and not few of the latter, as in random strings and unlike words."""
    digits = sum(c.isdigit() for c in value)
    return 8 * digits >= len(value) and any(c.isalpha() for c in value)


class Taken:
    """Stretches of a text that base spans cover."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.begins: list[int] = []
        self.ends: list[int] = []
        for b, e in sorted((b, e) for _, b, e in spans):
            if self.ends and b <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.begins.append(b)
                self.ends.append(e)

    def meets(self, b: int, e: int) -> bool:
        at = bisect.bisect_left(self.begins, e)
        return at > 0 and self.ends[at - 1] > b


def contexts(text: str) -> tuple[list, list, list]:
    """(base spans, seeds (kind, value, pattern), candidates (kind, b, e, value, pattern)) of a text.

    A secret that is assigned to a credential's name is a seed, and also a candidate, as it is no base span."""
    base = base_spans(text)
    seeds = [(k, normal(text[b:e]), p) for k, b, e in base for p in patterns(text, b)]
    taken, found = Taken(base), []
    for m in [*NUMBER.finditer(text), *(ADDRESS.finditer(text) if "at" in text or "@" in text else ())]:
        b, e = m.span()
        if not taken.meets(b, e):
            before = patterns(text, b)
            # Words around a bare "at" are prose unless a dot or a sign before them says otherwise.
            if " at " in m.group() and not DOTTED.search(m.group().split(" at ", 1)[1]) and not any(p[-1] in CUES for p in before):
                continue
            found += [(k, b, e, normal(m.group()), p) for k in kinds_of(m.group()) for p in before or [""]]
    for m in KEY.finditer(text):
        b, e = m.span()
        if key_like(m.group()) and not taken.meets(b, e):
            value, before = secret(m.group()), patterns(text, b) or [""]
            found += [(SECRET, b, e, value, p) for p in before]
            if CREDENTIAL.search(text, max(0, b - LEFT), b):
                seeds += [(SECRET, value, p) for p in before]
    return base, seeds, found


def scan(docs: DataFrame) -> DataFrame:
    """Base spans, seed contexts and candidates of every whole text; sha is the hash of a text with candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        kind_t = pa.struct([("kind", pa.int32()), ("b", pa.int32()), ("e", pa.int32())])
        seed_t = pa.struct([("kind", pa.int32()), ("value", pa.string()), ("pattern", pa.string())])
        cand_t = pa.struct([*kind_t, *list(seed_t)[1:]])
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                base, seeds, found = contexts(text)
                rows.append((f"{part}-{n}", hashlib.sha256(text.encode()).hexdigest() if found else None, base, seeds, found))
                n += 1
            cols = list(zip(*rows)) or [(), (), (), (), ()]
            named = lambda xs, t: pa.array([[dict(zip([f.name for f in t], x)) for x in row] for row in xs], pa.list_(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), batch.column("doc_id"), pa.array(cols[1], pa.string()), named(cols[2], kind_t), named(cols[3], seed_t), named(cols[4], cand_t)],
                ["row", "doc_id", "sha", "base", "seeds", "candidates"],
            )

    return common.texts(docs).mapInArrow(run, FOUND)


def score_graph(edges: DataFrame, support: int = SUPPORT, sure: float = SURE) -> DataFrame:
    """(kind, value) that the graph accepts: values of sure patterns, and those that are base spans elsewhere.

    edges: distinct (pattern, kind, value, seed); an empty pattern gives no score.  A pattern's chance is the share of its
    values that are known; a value's score is the chance that not all its patterns fail.  Values that reach `sure` become
    known in the next round, until none does: known values only grow, so this ends.  Seeds of secrets are known from the
    start but accepted only through patterns.  Each round aggregates before it joins."""
    total = edges.groupBy("pattern").agg(F.count_distinct("value").alias("n"))
    named = common.written(edges.where("pattern <> ''").join(total, "pattern"), "edges")
    seeds = common.written(edges.where("seed = 1").select("kind", "value").distinct(), "seeds")
    known, held, accepted = seeds, -1, None
    while (now := known.count()) != held:
        held = now
        counts = named.join(known, ["kind", "value"]).groupBy("pattern", "kind").agg(F.count("*").alias("known"), F.first("n").alias("n"))
        chances = counts.select("pattern", "kind", F.least(F.lit(0.999), F.col("known") / F.col("n")).alias("p")).where((F.col("known") >= support) & (F.col("p") >= sure))
        scores = named.where((F.col("seed") == 0) | (F.col("kind") == SECRET)).join(chances, ["pattern", "kind"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("s"))
        accepted = common.written(scores.where(F.col("s") >= sure).select("kind", "value"), "accepted")
        known = common.written(accepted.unionByName(seeds).distinct(), "known")
    return accepted.unionByName(seeds.where(F.col("kind") != SECRET)).distinct()


def find(docs: DataFrame) -> DataFrame:
    """(row, doc_id, sha, base, more): base spans and those that patterns discovered, as arrays of (kind, b, e)."""
    found = common.written(scan(docs), "pii")
    edge = lambda c, seed: found.select(F.explode(c).alias("x")).select("x.pattern", "x.kind", "x.value", F.lit(seed).alias("seed"))
    edges = edge("seeds", 1).unionByName(edge("candidates", 0)).groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed"))
    accepted = score_graph(common.written(edges, "edges"))
    each = found.select("row", F.explode("candidates").alias("x")).select("row", "x.kind", "x.value", "x.b", "x.e")
    more = each.join(accepted, ["kind", "value"]).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("kind", "b", "e"))).alias("more"))
    return found.select("row", "doc_id", "sha", "base").join(more, "row", "left").select("row", "doc_id", "sha", "base", F.coalesce("more", F.array().cast("array<struct<kind:int,b:int,e:int>>")).alias("more"))


def listed(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["b"].cast("string"), s["e"].cast("string"))), ",")


def number(kind: int) -> Column:
    """How many base spans are of a kind."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: personal data in all documents."""
    found = find(common.table(spark, sf_dir, "documents"))
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE])]
    spans = F.array_union("base", "more")
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each span's text replaced by its kind in angle brackets; n_chars follows.

    All columns stay.  Base spans are replaced where the text is; discovered ones come by doc_id
    (null is one more value) and text hash, as equal texts have equal spans, so only where there
    are any does a join move texts."""
    found = find(docs).where(F.size("more") > 0)
    columns = docs.columns
    name = common.free(docs, "pii_more")
    marked = docs.withColumn(name, F.array().cast("array<struct<kind:int,b:int,e:int>>"))
    more = common.written(found.select(F.col("doc_id").alias("pii_id"), F.col("sha").alias("pii_sha"), F.col("more").alias(name)), "pii-more")
    if not more.isEmpty():
        more = more.groupBy("pii_id", "pii_sha").agg(F.first(name).alias(name))
        same = docs["doc_id"].cast("long").eqNullSafe(more["pii_id"]) & (F.sha2(docs["text"].cast("binary"), 256) == more["pii_sha"])
        marked = docs.join(more, same, "left").select(*(docs[c] for c in columns), more[name])
    schema = marked.drop(name).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = [], []
            for text, more in zip(b.column("text").to_pylist(), b.column(name).to_pylist()):
                spans = base_spans(text or "") + [(s["kind"], s["b"], s["e"]) for s in more or []]
                out, at = [], 0
                for k, x, y in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if x >= at:
                        out += [text[at:x], f"<{KINDS[k].upper()}>"]
                    at = max(at, y)
                texts.append(text if not spans else "".join([*out, text[at:]]))
                sizes.append(None if text is None else len(texts[-1]))
            cols = {c: b.column(c) for c in columns} | {"text": pa.array(texts, b.column("text").type)}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array(sizes, b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return marked.mapInArrow(run, schema)
