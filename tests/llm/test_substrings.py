"""Substring dedup against a plain version."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from sweetlake.llm import common, substrings


def plain(docs):
    words = [re.findall("[^\\x20\\x09-\\x0d]+", t or "") for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, words):
        for p in range(len(w) - 49) if i is not None else ():
            key = tuple(w[p : p + 50])
            least[key] = min(least.get(key, i), i)
    for (i, _), w in zip(docs, words):
        gone = set()
        for p in range(len(w) - 49) if i is not None else ():
            if least[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        kept = [x for k, x in enumerate(w) if k not in gone]
        yield (i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def made(seed=7):
    """Copies, near copies, shared passages in new surroundings, chains of overlaps, repeats within one text."""
    draw = random.Random(seed)
    new = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    passage, line, base = new(70), new(40), new(300)
    texts = [base, base, base[:120] + new(1) + base[121:], base[100:260], new(30) + passage + new(30), new(5) + passage[:49] + new(5), passage[1:51], line + new(60), line + new(60)]
    texts += [new(20) + passage + new(20) for _ in range(6)] + [[*passage, *passage], new(49), base[:50], base[:49], ["same"] * 400, ["same"] * 130 + new(3), (new(7) * 40)]
    edited = base
    for k in range(25):  # each a copy of the one before with an edit, so that windows are shared by some only
        at = draw.randrange(len(edited))
        edited = [*edited[:at], f"edit{k}", *edited[at + 1 :]]
        texts.append(edited)
    texts += [[*a[:90], *b[-90:]] for a, b in [(edited, passage), (texts[30], base), (base, texts[35])]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    draw.shuffle(docs)
    return [*docs, (None, " ".join(base)), (None, None), (900, None), (901, ""), (3, " ".join(base[:200])), (3, " ".join(base[:200])), (902, "\t".join(passage) + "\n"), (903, "é\x1c " * 60 + "\xa0".join(base))]


@pytest.mark.parametrize(("words", "share"), [(substrings.BLOCK_WORDS, substrings.SHARE), (700, 3)])
def test_substrings_equal_plain(spark, monkeypatch, words, share):
    monkeypatch.setattr(substrings, "SHARE", share)
    docs = made()
    blocks = common.written(substrings.word_blocks(common.texts(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, start int, words string")), words), "blocks")
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in substrings.kept(blocks, substrings.duplicate_spans(blocks)).collect()]
    want = list(plain(docs))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 2_000


def test_query(spark, tmp_path):
    at = f"{tmp_path}/documents.parquet"
    docs = made(11)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(at)
    got = sorted(map(tuple, substrings.deduped(spark, str(tmp_path)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == sorted(plain(docs), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
    assert sorted(con.execute(substrings.DEDUPED_SQL).fetchall(), key=str) == got


def test_awkward_texts(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, substrings.deduped(spark, folder).collect()), key=str) == sorted(plain(docs), key=str)


def test_factors_are_greedy_and_complete():
    draw = random.Random(3)
    alphabet = [b"a", b"b"]
    for _ in range(200):
        text = [draw.choice(alphabet) if draw.random() < 0.1 else b"a" for _ in range(draw.randrange(1, 300))]
        source = [draw.choice(alphabet) if draw.random() < 0.1 else b"a" for _ in range(draw.randrange(1, 300))]
        r = substrings.Reference()
        r.add(b" ".join(source))
        found = r.factors(np.array([r.codes[w] for w in text]))
        known = {tuple(source[p : p + 50]) for p in range(len(source) - 49)}
        want = {p for p in range(len(text) - 49) if tuple(text[p : p + 50]) in known}
        assert {p for s, e in found for p in range(s, e - 49)} == want
        assert all(b[1] > a[1] for a, b in zip(found, found[1:]))
