"""Each operator's query against a plain version, on awkward rows and on empty tables."""

import base64
import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sweetlake.llm import byte_bpe, chat, common, graph_search, near_dedup, packing, pii, quality, token_store, tokens, voronoi_join, warc
from sweetlake.llm.queries import ORACLES, QUERIES

from .conftest import texts

TEXTS = {i: t or "" for i, t in enumerate(texts())} | {None: "no id"}


def rows(spark, name, folder):
    return QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    assert len(rows(spark, name, empty)) == (1 if name.startswith("op8") else 0)


def test_pii(spark, folder):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def plain(text):
        for kind, pattern in kinds.items():
            for m in re.finditer(pattern, text):
                d = re.sub(r"\D", "", m.group())
                if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "phone" and not 8 <= len(d) <= 15:
                    continue
                if kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)):
                    continue
                yield f"{kind}:{m.start()}:{m.end()}"

    got = {r.doc_id: r for r in rows(spark, "op1_bootstrapped_pii", folder)}
    assert set(got) == set(TEXTS)
    for i, text in TEXTS.items():
        want = list(plain(text))
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i].spans.split(",")) | {""}
        assert Counter(w.split(":")[0] for w in want) == Counter({k: n for k in kinds if (n := got[i][f"n_{k}"])})


def test_pii_discovers_by_pattern(spark):
    known = [(i, f"note {i}. Phone: +1 (0{i + 10}) 555-77{i + 10} end") for i in range(12)]
    docs = spark.createDataFrame([*known, (100, "see Phone: 017 555 8899 now"), (101, "see version 017 555 1234 now")], "doc_id long, text string")
    got = {r.doc_id: r.more for r in pii.find(docs).collect()}
    assert [(s.kind, s.b, s.e) for s in got[100]] == [(3, 11, 23)] and not got[101]
    text = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert text[100] == "see Phone: <PHONE> now" and text[101].endswith("1234 now") and "<PHONE>" in text[0]


def test_pii_redacts_by_row(spark):
    known = [(i, f"note {i}. Phone: +1 (0{i + 10}) 555-77{i + 10} end") for i in range(12)]
    odd = [(None, "see Phone: 017 555 8899 now"), (None, "clean text that says nothing at all"), (7_000, "see Phone: 017 555 8899 now"), (7_000, "a clean text that is left as it was"), (7_000, None)]
    docs = spark.createDataFrame([*known, *odd, odd[2]], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in pii.redacted(docs).where("doc_id is null or doc_id = 7000").collect())
    clean = lambda t: t and t.replace("017 555 8899", "<PHONE>")
    assert got == Counter((i, clean(t)) for i, t in [*odd, odd[2]])


def test_dedup_keeps_one_row_of_a_doc_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = [(1, a, 1), (1, a, 1), (1, b, 2), (2, a, 1), (2, a, 1), (3, c, 3), (4, None, 4), (4, None, 4), (5, "", 5), (None, c, 6), (None, c, 6)]
    got = near_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string, n long")).collect()
    assert Counter(map(tuple, got)) == Counter({(1, a, 1): 1, (1, b, 2): 1, (3, c, 3): 1, (4, None, 4): 1, (5, "", 5): 1, (None, c, 6): 2})


def test_pii_discovers_secrets_by_pattern(spark):
    """Assigned secrets induce patterns; those find one of another shape, and a known one without its cue."""
    key = lambda i: hashlib.sha1(b"%d" % i).hexdigest()
    docs = [(i, f'some words here client token = "{key(i)}" and more') for i in range(12)] + [(20, f"nothing but {key(3)} here"), (21, f"commit {key(99)} fixes it")]
    docs += [(22, "client token ZZ-9x9x9x9x9x9x9x9x9x"), (23, 'their CLIENT TOKEN = "AB12CD34EF56GH78"')]
    got = {r.doc_id: [(pii.KINDS[s.kind], s.b, s.e) for s in r.more] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == [("secret", 32, 72)] and got[20] == [("secret", 12, 52)] and got[21] == [] and got[23] == [("secret", 22, 38)]
    # Copies of one text count once, so that they give no pattern support.
    one = [(i, "see Phone: +1 (010) 555-7710 end") for i in range(30)] + [(40, "see Phone: 017 555 8899 now")]
    assert not [r for r in pii.find(spark.createDataFrame(one, "doc_id long, text string")).collect() if r.more]


def test_pii_of_very_long_numbers_and_secrets(spark):
    """Parts of thousands of zeros are 0, a secret of any length is found, and a chain of patterns is followed to its end."""
    zeros = "0" * 5_000 + "1.1.1.1"
    key = lambda n, size=40: hashlib.sha512(b"%d" % n).hexdigest() * (size // 128 + 1)
    docs = [(1, zeros), (2, "0" * 5_000 + "999.1.1.1")]
    docs += [(10 + i, f'client token = "{key(i)[:40]}"') for i in range(6)] + [(20, f'client token = "{key(20, 3_000)}"')]
    # Each next cue has five of the values of the one before and one of its own.
    for step, cue in enumerate(["alpha beta :", "gamma delta :", "omega sigma :", "kappa lambda :"], 1):
        docs += [(100 * step + i, f"{cue} {key(step + i if i < 5 else step + 5)[:40]}") for i in range(6)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in found[1].base] == [(1, 0, len(zeros))] and found[2].base == []
    assert all(len(found[i].more) == 1 for i in found if i > 2) and found[20].more[0].e - found[20].more[0].b > 3_000


def test_secret_without_a_supported_pattern_stays_unfound(spark):
    docs = [(i, f'rare{i} token = "{hashlib.sha1(b"%d" % i).hexdigest()}"') for i in range(3)]
    assert not [r for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.more]


def test_pii_long_runs_are_linear():
    assert pii.base_spans("a" * 200_000 + "@" * 1_000 + "999." * 50_000 + "+" * 1_000) == []
    began = time.process_time()
    assert pii.base_spans("a" * 500_000 + " " + "b" * 500_000 + "@x.y") == [(0, 500_001, 1_000_005)]
    pii.contexts("ab12" * 100_000 + " a@b.c" * 20_000 + " 017 555 8899" * 20_000)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("stage", [pii.redacted, lambda d: quality.accepted(d, d.selectExpr("doc_id", "1 as quality").limit(0))])
def test_stages_keep_columns_of_any_name(spark, stage):
    names = ["doc_id", "text", "lang", "quality_score", "quality_score_", "pii_more", "pii_id", "pii_sha", "more", "n_chars"]
    docs = spark.createDataFrame([(1, "mail a@b.cd", "en", 0.1, 2, "m", 7, "s", "x", 11), (None, None, None, None, None, None, None, None, None, None)], ", ".join(f"{n} {t}" for n, t in zip(names, "long string string double long string long string string long".split())))
    out = stage(docs)
    assert out.columns == names and out.count() == 2
    assert {r.pii_more for r in out.collect()} == {"m", None}


def test_training_takes_a_row_a_label(spark):
    """Rows of one doc_id give one row, so what reaches the driver is bounded."""
    a, b, c = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    docs = spark.createDataFrame([(a, f"text {i} of many words", 10) for i in range(50)] + [(b, "bad $$$ $$$", 5), (c, "x" * 100_000, 5)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(a, 1), (b, 0), (c, 1)], "doc_id long, quality int")
    machine = quality.train(docs, labels)
    assert machine is not None and len(quality.score(docs, machine).collect()) == 52


def test_quality(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = [(i, " ".join(word() + ("$$$" if i % 3 == 0 and rng.random() < 0.4 else "") for _ in range(60)), 400) for i in range(600)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 > 0 as int) as quality")
    scored = quality.score(docs, quality.train(docs, labels)).withColumn("held", quality.held_out(F.col("doc_id"))).where("held").collect()
    assert len(scored) > 100 and np.mean([(r.quality_score >= 0.5) == (r.doc_id % 3 > 0) for r in scored]) > 0.95


def test_machine_identity():
    rng = np.random.default_rng(1)
    f = quality.Features(1, np.zeros(3, int), np.array([3, 9, 11]), np.array([0.5, 1.0, 2.0]), np.zeros((1, quality.STATS)))
    m = quality.Machine(0.1, rng.normal(size=quality.DIM + quality.STATS), rng.normal(size=(quality.DIM + quality.STATS, 4)), np.zeros(quality.STATS), np.ones(quality.STATS))
    v = m.v[f.slot] * f.value[:, None]
    pairs = sum(v[i] @ v[j] for i in range(3) for j in range(i))
    assert m.parts(f)[0][0] == pytest.approx(0.1 + m.w[f.slot] @ f.value + pairs)


def test_quality_edges(spark, folder):
    got = rows(spark, "op2_factorisation_machine", folder)
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def vectors(spark, folder):
    kept = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.vec_id is not None and r.embedding and None not in r.embedding]
    return {i: v for i, v in kept if np.isfinite(v).all()}


def test_graph_search(spark, folder):
    v = {i: x for i, x in vectors(spark, folder).items() if x.any()}
    got = {}
    for r in rows(spark, "op3_pruned_graph", folder):
        assert r.score == pytest.approx(float(v[r.query_id] @ v[r.vec_id]), abs=1e-12)
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    hit = total = 0
    for q in (i for i in v if i % 20 == 0):
        want = sorted((i for i in v if i != q), key=lambda i: (-float(v[q] @ v[i]), i))[:20]
        least = float(v[q] @ v[want[-1]])
        assert len(got[q]) == 20 and list(got[q]) and sorted(got[q]) == list(range(1, 21))
        hit += sum(float(v[q] @ v[i]) >= least - 1e-9 for i in got[q].values())
        total += 20
    assert hit >= 0.9 * total


def repeated_ids(spark):
    rng = np.random.default_rng(7)
    v = [(i, rng.integers(-9, 10, 4).tolist()) for i in range(100, 160)]
    v += [(5, [9, 9, 9, 8]), (5, [9, 9, 8, 9]), (5, [9, 8, 9, 9]), (5, [8, 9, 9, 9]), (6, [9, 9, 9, 8]), (4, [-9, 9, 0, 0]), (4, [9, -9, 0, 0]), (4, [9, -9, 0, 0]), (8, [9, -9, 0, 0])]
    asked = [(5, [9, 9, 9, 9]), (4, [9, -9, 0, 0]), (100, [9, -9, 1, 0]), (101, [-9, 9, 1, 0])]
    plain = lambda q, k: [
        (r + 1, i, s) for r, (s, i) in enumerate(sorted(((int(np.dot(x, dict(asked)[q])), i) for i, x in v if i != q), key=lambda p: (-p[0], p[1]))[:k])
    ]
    return v, asked, {q: plain for q, _ in asked}


@pytest.mark.parametrize("pivots", [8, 40])
def test_voronoi_join_of_repeated_ids(spark, pivots):
    v, asked, plain = repeated_ids(spark)
    data, queries = spark.createDataFrame(v, "vec_id long, vec array<long>"), spark.createDataFrame(asked, "query_id long, qvec array<long>")
    got = {tuple(r) for r in voronoi_join.top_k(data, queries, 3, pivots).collect()}
    assert got == {(q, *r) for q, f in plain.items() for r in f(q, 3)}


def plain_top(v, asked, k):
    return {(q, r + 1, i, s) for q, x in asked for r, (s, i) in enumerate(sorted(((sum(int(a) * int(b) for a, b in zip(x, y)), i) for i, y in v if i != q), key=lambda p: (-p[0], p[1]))[:k])}


def voronoi(spark, v, asked, k, **how):
    data, queries = spark.createDataFrame(v, "vec_id long, vec array<long>"), spark.createDataFrame(asked, "query_id long, qvec array<long>")
    return {tuple(r) for r in voronoi_join.top_k(data, queries, k, **how).collect()}


def test_voronoi_join_sends_few_rows_of_clustered_data(spark):
    """Several groups, blocks and parts; under a fifth of rows times groups is sent."""
    rng = np.random.default_rng(11)
    centres = 1000 * np.eye(12, dtype=int)
    v = [(i, (centres[i % 12] + rng.integers(-20, 21, 12)).tolist()) for i in range(2_400)]
    asked, told = v[::4], {}
    assert voronoi(spark, v, asked, 5, part_bytes=4_000, block=20, told=told) == plain_top(v, asked, 5)
    assert told["groups"] >= 12 and told["sent"] < 0.2 * told["rows"] * told["groups"]


def test_voronoi_join_where_nothing_prunes(spark):
    """Cells share groups, so rows are sent once a block of queries."""
    rng = np.random.default_rng(12)
    v = [(i, rng.integers(-50, 51, 16).tolist()) for i in range(600)]
    asked, told = v[::3], {}
    assert voronoi(spark, v, asked, 5, part_bytes=20_000, block=50, told=told) == plain_top(v, asked, 5)
    assert told["groups"] <= 8


def test_voronoi_join_is_exact_for_large_components(spark):
    big = 2**30
    v = [(i, [big + i, -big, big // 3 + i % 7]) for i in range(40)] + [(90, [2**62, 2**62, 0]), (91, [-(2**62), 2**62, 2**62])]
    asked = [v[3], v[17]]
    clip = lambda s: max(-voronoi_join.LONG, min(voronoi_join.LONG, s))
    want = {(q, r, i, clip(s)) for q, r, i, s in plain_top(v, asked, 42)}
    assert {(q, i, s) for q, _, i, s in voronoi(spark, v, asked, 42)} == {(q, i, s) for q, _, i, s in want}


def test_voronoi_bounds_hold():
    rng = np.random.default_rng(3)
    q, v = rng.integers(-99, 100, (50, 6)).astype(float), rng.integers(-99, 100, (80, 6)).astype(float)
    own, far = voronoi_join.nearest_pivot(q, v[:5])
    cells = voronoi_join.Cells(v[:5], np.bincount(own, minlength=5), np.array([far[own == c].max(initial=0) for c in range(5)]))
    low, high, scores = cells.ends(v, -1)[:, own].T, cells.ends(v, 1)[:, own].T, q @ v.T
    assert (low < scores).all() and (scores < high).all()


def test_voronoi_bounds_hold_where_products_cancel():
    """Components near 10^12 whose products cancel: each bound holds the exact product of whole numbers."""
    rng = np.random.default_rng(2)
    half = rng.integers(9 * 10**11, 11 * 10**11, (400, 8))
    v = np.concatenate([half, half + rng.integers(-3, 4, half.shape)], axis=1)
    q = np.concatenate([half[::-1], -half[::-1]], axis=1)
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in q[:20]] for x in v]
    pivots = q[:20].astype(float)
    cells = voronoi_join.Cells(pivots, np.ones(20, int), np.zeros(20))
    low, high = (cells.ends(v.astype(float), sign) for sign in (-1, 1))
    assert all(low[i][j] <= exact[i][j] <= high[i][j] for i in range(len(v)) for j in range(20))


def test_vectors_of_other_lengths_take_no_part(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("lengths"))
    v = [(100 * i, [0.1 * i, 0.5]) for i in range(5)] + [(7, []), (8, [0.1]), (9, [0.1, 0.2, 0.3]), (10, None)]
    spark.createDataFrame(v, "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    for name in ("op3_pruned_graph", "op4_voronoi_join"):
        got = rows(spark, name, at)
        assert {r.query_id for r in got} == {r.vec_id for r in got} == {0, 100, 200, 300, 400} and len(got) == 20


def test_graph_search_of_repeated_ids(spark):
    v, asked, plain = repeated_ids(spark)
    data = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in v], "vec_id long, vec array<double>")
    queries = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in asked], "query_id long, qvec array<double>")
    got = {(r.query_id, r["rank"], r.vec_id, int(r.score)) for r in graph_search.nearest(data, queries, 3).collect()}
    assert got == {(q, *r) for q, f in plain.items() for r in f(q, 3)}


def test_graph_search_over_several_shards_and_blocks(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(1_500, 16))
    data = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, vec array<double>")
    queries = data.where("vec_id % 5 = 0").selectExpr("vec_id as query_id", "vec as qvec")
    got = graph_search.nearest(data, queries, 10, shard=300, block=100).collect()
    scores = v @ v.T
    np.fill_diagonal(scores, -np.inf)
    want = np.argsort(-scores, axis=1)[:, :10]
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert len(got) == 3_000 and hits >= 0.97 * len(got)
    assert all(r.score == pytest.approx(scores[r.query_id, r.vec_id], abs=1e-12) for r in got)


def test_search_meets_a_small_share_of_a_shard():
    rng = np.random.default_rng(10)
    points = rng.normal(size=(40, 8))[rng.integers(0, 40, 6_000)] * 10 + rng.normal(size=(6_000, 8))
    links, entry = graph_search.build_graph(points)
    assert links.shape == (6_000, graph_search.DEGREE)
    met: list[int] = []
    found, _ = graph_search.beam_search(points, links, points[:200] + 0.01, entry, graph_search.BEAM, met)
    near = ((points[:200, None] + 0.01 - points[None]) ** 2).sum(axis=2).argsort(axis=1)[:, :20]
    assert np.mean([len(set(f[:20]) & set(n)) / 20 for f, n in zip(found.tolist(), near.tolist())]) >= 0.95
    assert np.mean(met) < 0.2 * len(points)


def test_robust_prune_keeps_diverse_edges():
    points = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 1]])
    assert set(graph_search.robust_prune(points, 0, np.array([1, 2, 3]))) == {1, 3}


def test_voronoi_join(spark, folder):
    v = {i: np.floor(1024 * x).astype(int) for i, x in vectors(spark, folder).items()}
    want = {(q, k + 1, i, int(v[q] @ v[i])) for q in v if q % 100 == 0 for k, i in enumerate(sorted((i for i in v if i != q), key=lambda i: (-int(v[q] @ v[i]), i))[:10])}
    assert {tuple(r) for r in QUERIES["op4_voronoi_join"](spark, folder).select("query_id", "rank", "vec_id", "score").collect()} == want


def test_warc(spark, folder):
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    last = {h: max(i for i in pages if pages[i] == h) for h in pages.values()}
    got = {r.page_id: r for r in rows(spark, "op5_warc_chunks", folder)}
    assert set(got) == set(pages)
    for i, html in pages.items():
        raw = html.encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[html] == i else ("revisit", last[html]))


def test_warc_payloads_and_small_chunks(spark, folder):
    path = common.scratch(spark, "warc-test")
    warc.write(common.table(spark, folder, "pages"), path, least=5, chunk=100_000)
    got = {}
    for r in sorted(warc.read(spark, path).where("type <> 'revisit'").collect(), key=lambda r: r.segment or 0):
        got[r.page_id] = got.get(r.page_id, "") + r.payload
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert all(pages[i] == text for i, text in got.items()) and {2, 3, 6} <= set(got)  # below `least` all are responses
    assert max(len(c) for c in warc.cut("ab" * 1000, 64)) == 64


def library_ids(name, texts_=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(common.tokenizer_path(name))
    t.encode_special_tokens = True
    return {i: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for i, x in (TEXTS if texts_ is None else texts_).items()}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_equal_the_library(name):
    ids = library_ids(name)
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.packed_ids(common.tokenizer_path(name), list(TEXTS.values()), 2)] == [ids[i].tolist() for i in TEXTS]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_of_added_tokens_equal_the_library(name):
    from tokenizers import Tokenizer

    path = common.tokenizer_path(name)
    plain = Tokenizer.from_file(path)
    some = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>Y 's <|endoftext|><|endoftext|>\n", "A <|ENDOFTEXT|> b", "<|endoftext", "é <|endoftext|> 中"]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.packed_ids(path, some, None)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in some]
    assert plain.token_to_id("<|endoftext|>") in got[0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_common_characters_are_cut_as_the_library_cuts(name):
    """Every character that is not sent through the library's whole pipeline, beside letters, digits, signs and itself."""
    from tokenizers import Tokenizer

    path = common.tokenizer_path(name)
    chars = [c for c in map(chr, range(0x10000)) if not "\ud800" <= c < "\ue000" and not tokens.UNCOMMON.match(c)]
    assert {"\u2019", "\u2014", "\u0416", "\u4e2d"} <= set(chars)
    some = [f"a{c}b {c} {c}{c}1{c} {c}x\n{c}" for c in chars] + [a + b for a, b in zip(chars, chars[1:])]
    plain = [e.ids for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.packed_ids(path, some, None)] == plain


def test_packing(spark, folder):
    ids, cover, sequences = library_ids("word_bpe_49k.json"), Counter(), {}
    for r in rows(spark, "op6_pack_first_fit", folder):
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        cover[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert cover == {i: len(x) for i, x in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_first_fit_decreasing_equals_plain():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        room, want = [100] * len(sizes), [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            want[i] = next(b for b, r in enumerate(room) if r >= sizes[i])
            room[want[i]] -= sizes[i]
        assert packing.first_fit_decreasing(sizes, 100) == want


def test_token_files(spark, folder):
    ids = library_ids("byte_bpe_50k.json")
    start, want = 0, {}
    for i in sorted(ids, key=lambda i: (i is not None, i)):
        want[i] = (start, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        start += len(ids[i])
    assert {r.doc_id: tuple(r[1:]) for r in QUERIES["op7_token_files"](spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want
    path = common.scratch(spark, "tokens-test")
    token_store.write(common.texts(common.table(spark, folder, "documents")), path, common.tokenizer_path("byte_bpe_50k.json"))
    (one,) = token_store.read(spark, path, 12).collect()
    assert np.frombuffer(one.ids, "<u4").tolist() == ids[12].tolist() and one.start == want[12][0]


def test_token_files_point_reads(spark):
    """Blocks that begin with rows without id, the least id, and repeated ids."""
    least = -(2**63)
    docs = spark.createDataFrame([(None, "none"), (None, None), (least, "least"), (5, "five"), (5, "again five"), (7, "")], "doc_id long, text string").coalesce(1)
    path = common.scratch(spark, "tokens-test")
    token_store.write(docs.withColumn("text", F.coalesce("text", F.lit(""))), path, common.tokenizer_path("byte_bpe_50k.json"))
    every = token_store.read(spark, path).collect()
    assert Counter(r.doc_id for r in every) == Counter([None, None, least, 5, 5, 7])
    for i in (least, 5, 7, 6):
        assert Counter(map(tuple, token_store.read(spark, path, i).collect())) == Counter(tuple(r) for r in every if r.doc_id == i)


def test_chat(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    want = con.execute(ORACLES["op8_prefix_targets"]).fetchall()
    names = [d[0] for d in con.description]
    got = QUERIES["op8_prefix_targets"](spark, folder).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_chat_examples(spark):
    from sweetlake.llm import chat

    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b<|"), (1, 2, "user", "c"), (1, 3, "assistant", "d")], "conv_id long, turn long, role string, text string")
    got = chat.examples(chat.format_conversations(df)).orderBy("example").collect()
    assert [r.reply for r in got] == ["b<\\|", "d"]
    assert got[1].context == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<\\|<|im_end|>\n<|im_start|>user\nc<|im_end|>\n<|im_start|>assistant\n"


def test_chat_of_very_many_turns(spark):
    """Spans grow linearly: 100,000 turns of one conversation in seconds."""
    rows = spark.range(100_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    began = time.time()
    r = chat.format_conversations(rows).selectExpr("size(replies) as n", "substring(formatted, element_at(replies, -1).begin + 1, element_at(replies, -1).chars) as last").first()
    assert (r.n, r.last) == (50_000, "t99999") and time.time() - began < 10


def test_byte_bpe(spark, folder):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.load_ranks(common.tokenizer_path("byte_bpe_50k.tiktoken"))
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows(spark, "op9_byte_bpe", folder):
        ids = e.encode_ordinary(TEXTS[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(TEXTS[r.doc_id].encode()).hexdigest()
    bpe, rng = byte_bpe.Bpe(ranks, public_tokenizers.PATTERN), random.Random(4)
    for alphabet in ("ab", "aA", "the in", "é中a", "=-", " \n"):
        for n in (1, 30, 90, 400):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert bpe.encode(text) == e.encode_ordinary(text) and bpe.decode(bpe.encode(text)) == text.encode()


def test_byte_bpe_joins_grow_until_stable(monkeypatch):
    """Joins of small leaves against merging the whole string, with merges that reach far over a seam."""
    monkeypatch.setattr(byte_bpe, "LEAF", 2)
    ranks = {t: r for r, t in enumerate([b"a", b"b", b"aa", b"aaaa", b"ab", b"aab", b"aaaaaaaa", b"ba", b"abab"])}
    bpe = byte_bpe.Bpe(ranks, r"\S+")
    for n in range(1, 13):
        for letters in itertools.product(b"ab", repeat=n):
            data = bytes(letters)
            assert bpe.encode_piece(data) == bpe.leaf(data) and bpe.decode(bpe.encode_piece(data)) == data
    assert bpe.windows > bpe.grown > 100
    assert bpe.decode(np.tile([0, 1, 3], 5_000)) == b"abaaaa" * 5_000  # several levels of runs


def plain_groups(docs):
    """doc -> (shingles, component) by comparing all pairs."""
    sets = {}
    for i, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in docs:
        for b in docs:
            if b < a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in docs}


def test_near_dedup(spark, folder):
    want = plain_groups({i: t for i, t in TEXTS.items() if i is not None})
    got = {r.doc_id: r for r in rows(spark, "op10_super_min_hash", folder)}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i is not None} == want
    assert all(r.kept == (i is None or r.component_id == i) for i, r in got.items())


@pytest.mark.parametrize("n", range(6))
def test_near_dedup_of_few_words_in_a_run(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    (alone,) = near_dedup.shingle_sets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    both = np.frombuffer(f"{text}{text} and six more words of text".encode(), np.uint8)
    among = near_dedup.shingle_sets(both, np.array([0, len(text), len(both)]))[0]
    assert len(alone) == min(n, 1) and alone.tolist() == among.tolist()
    (row,) = near_dedup.signatures(spark.createDataFrame([(7, text)], "doc_id long, text string").coalesce(1)).collect()
    assert row.n_shingles == min(n, 1)


def test_near_dedup_of_many_near_copies(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    docs = {}
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        docs[i] = " ".join(copy)
    got = near_dedup.groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_groups(docs)


def test_hot_band_of_many_unlinked_components(spark):
    """Ten thousand components share one band; the few pairs that may be linked are found, in blocks."""
    rng = np.random.default_rng(8)
    sets = {i: rng.integers(0, 2**63, int(rng.integers(8, 60))).astype(np.uint64) for i in range(10_000)}
    for i in range(0, 40, 2):
        sets[i + 1] = np.append(sets[i], rng.integers(0, 2**63, 1).astype(np.uint64))
    slim = spark.createDataFrame([(i, len(x), near_dedup.parity_sketch(x).tolist()) for i, x in sets.items()], "id long, n_shingles long, sketch array<long>")
    mixed = spark.createDataFrame([(7, i, i) for i in sets] + [(8, i, i // 2) for i in range(6)], "band long, id long, comp long")
    got = {tuple(r) for r in near_dedup.across_pairs(mixed, slim).collect()}
    assert {(i, i + 1) for i in range(0, 40, 2)} <= got and len(got) < 200
    plain = mixed.join(slim, "id")
    small = plain.where("id < 400").select("band", "id", "comp")
    rows = {r.id: (r.n_shingles, r.sketch) for r in slim.where("id < 400").collect()}
    ok = lambda a, b: 100 * min(a[0], b[0]) >= 75 * max(a[0], b[0]) and sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a[1], b[1])) <= (a[0] + b[0]) / 7
    want = {(i, j) for i in rows for j in rows if i < j and ok(rows[i], rows[j])}
    assert {tuple(r) for r in near_dedup.across_pairs(small, slim, block=30).collect()} == want


def test_signature_is_super_min_hash():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 40, 700)]
    sets.append(np.concatenate([sets[3][:600], sets[2]]))
    best = near_dedup.super_min_hash(sets)
    assert (best < np.iinfo(np.uint64).max).all()
    assert sorted((best[0] >> np.uint64(48)).tolist()) == list(range(near_dedup.SLOTS))  # one element: a permutation
    true = len(np.intersect1d(sets[3], sets[4])) / len(np.union1d(sets[3], sets[4]))
    assert abs((best[3] == best[4]).mean() - true) < 0.12


def test_pipeline(spark, folder):
    docs = common.table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "pii", "packing"]
    for name in ("quality", "near_dedup", "pii"):
        assert stages[name](spark, docs, folder).columns == docs.columns
    kept = {r.doc_id for r in stages["near_dedup"](spark, docs, folder).collect()}
    want = plain_groups({i: t for i, t in TEXTS.items() if i is not None})
    assert kept == {i for i, (_, c) in want.items() if c == i} | {None}
    clean = {r.doc_id: r.text for r in stages["pii"](spark, docs, folder).collect()}
    assert clean[12].startswith("mail <EMAIL>, ip <IP> and 1.2.3.256, card <CARD>, call <PHONE>.") and clean[0] is None and clean[4] == "a"
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and {r.doc_id for r in out} <= set(TEXTS)


def test_pipeline_equals_plain(spark, folder):
    """Each stage by plain Python on what the one before keeps; the classifier's scores are its own (held against labels elsewhere)."""
    docs = common.table(spark, folder, "documents")
    scores = {(r.doc_id, r.text): r.quality_score for r in quality.score(docs, quality.train(docs, common.table(spark, folder, "labels"))).collect()}
    good = [(i, t) for (i, t), s in scores.items() if s >= 0.5]
    kept = [i for i, (_, c) in plain_groups({i: t or "" for i, t in good if i is not None}).items() if c == i]
    once = [(i, t or "") for i, t in good if i is None or i in kept]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(once, "doc_id long, text string")).collect()}
    texts_ = {}
    for i, text in once:
        spans = sorted([(k, b, e) for k, b, e in pii.base_spans(text)] + [(s.kind, s.b, s.e) for s in found[i].more], key=lambda s: (s[1], -s[2]))
        out, at = "", 0
        for k, b, e in spans:
            if b >= at:
                out += text[at:b] + f"<{pii.KINDS[k].upper()}>"
            at = max(at, e)
        texts_[i] = out + text[at:]
    ids = library_ids("word_bpe_49k.json", texts_)
    cover = Counter()
    got = corpus_pipeline.run(spark, folder).collect()
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        cover.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    assert cover == Counter((i, k) for i, x in ids.items() for k in range(len(x))) and len(ids) > 5


def test_rows_of_repeated_and_missing_ids(spark):
    """Rows of one doc_id, and those without, are documents of their own in op2, 6, 7 and 9."""
    rows_ = [(1, "one text here"), (1, "another text of one"), (1, "another text of one"), (None, None), (None, "none"), (None, "x" * 5_000), (2, "")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    want = Counter((i, len(x)) for (i, _), x in zip(rows_, library_ids("word_bpe_49k.json", {k: t or "" for k, (_, t) in enumerate(rows_)}).values()))
    packed = packing.pack(docs, common.tokenizer_path("word_bpe_49k.json"), group=2).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in packed if r.start == 0) == want
    path = common.scratch(spark, "tokens-test")
    token_store.write(common.texts(docs), path, common.tokenizer_path("byte_bpe_50k.json"))
    assert Counter(r.doc_id for r in token_store.read(spark, path).collect()) == Counter(i for i, _ in rows_)
    import public_tokenizers

    bpe = common.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = byte_bpe.decode(byte_bpe.encode(docs, *bpe), *bpe).collect()
    assert Counter((r.doc_id, bytes(r.bytes).decode()) for r in back) == Counter((i, t or "") for i, t in rows_)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert Counter(r.doc_id for r in quality.score(docs, quality.train(docs, labels)).collect()) == Counter(i for i, _ in rows_)


def test_warc_of_repeated_and_missing_page_ids(spark):
    pages = [(1, "u", "same"), (1, "u", "same"), (None, None, "same"), (None, "v", None), (3, "w", "other")]
    path = common.scratch(spark, "warc-test")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    got = Counter((r.page_id, r.type, r.refers_to) for r in warc.read(spark, path).collect())
    assert got == Counter([(1, "response", None), (1, "revisit", 1), (None, "revisit", 1), (None, "response", None), (3, "response", None)])


def test_pipeline_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
