"""Alignment of two tokenizers against a plain version."""

import hashlib
from collections import Counter
from functools import lru_cache
from itertools import groupby

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sweetlake.llm import alignment, common
from sweetlake.llm.tokens import byte_letters

from .conftest import texts

A, B = common.tokenizer_path("byte_bpe_50k.json"), common.tokenizer_path("piece_bpe_32k.model")
ODD = [" two  blanks ", "<|endoftext|> <s> <unk> <0x41>", "▁ low", "x" * 3_000 + " =" * 40, "日本語 ñandú 🙂 é", "a\n\n b\t c", "\x00\x01", " ", "  ", "tab\tand nbsp end", "hello hello hello"]


@lru_cache
def libraries():
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    return whole, sentencepiece.SentencePieceProcessor(model_file=B)


@lru_cache
def tokens(text):
    """Ids of both sides with the bytes of each, or nothing."""
    if not text:
        return [], []
    whole, model = libraries()
    byte = {c: b for b, c in byte_letters().items()}
    a = [(i, bytes(byte[c] for c in whole.id_to_token(i))) for i in whole.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(text)]
    raw = (" " + text).encode()
    return (a, b) if all(b"".join(t for _, t in side) == raw for side in (a, b)) else ([], [])


def ends(side):
    return list(np.cumsum([len(t) for _, t in side]))


def plain(docs):
    made = []
    for i, text in docs:
        a, b = tokens(text)
        cuts, groups, links = set(ends(a)) & set(ends(b)), [], Counter()
        own = [[], []]
        for side, mine in zip((a, b), own):  # cut each side on its own at the common ends
            for (t, _), e in zip(side, ends(side)):
                mine.append(t)
                if e in cuts:
                    mine.append(None)
        split = [[list(g) for last, g in groupby(mine, lambda t: t is None) if not last] for mine in own]
        for x, y in zip(*split):
            groups.append((x, y))
            links.update((p, q) for p in x for q in y)
        made.append((i, len(a), len(b), groups, links))
    counts = Counter(p for *_, links in made for p in links)
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    for i, a, b, groups, links in made:
        column = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (i, a, b, len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), hashlib.sha256(column.encode()).hexdigest() if groups else "")


@pytest.mark.parametrize("entries", [alignment.ENTRIES, 40])
def test_alignment_equals_plain(spark, entries):
    """Awkward texts, null and repeated ids, in one block a task and in many."""
    docs = [*enumerate([*texts(), *ODD]), (None, "no id here"), (None, None), (3, "hello again"), (3, "hello again")]
    df = common.texts(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, pair string, n int"))
    made = common.written(alignment.blocks(df, A, B, entries), "aligned")
    got = alignment.scored(made, alignment.pair_counts(made, alignment.vocabulary(B).count)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(docs), key=str)
    assert sum(r.n_links for r in got) > 1_000 and any(r.n_best < r.n_links for r in got)


def test_wide_groups_are_counted_by_distinct_ids(monkeypatch):
    text = [*texts()[5:], *ODD]
    va, vb = alignment.vocabulary(A), alignment.vocabulary(B)
    want = [x.tolist() for x in alignment.Aligned([t or "" for t in text], va, vb).pairs()]
    monkeypatch.setattr(alignment, "WIDE", 2)
    assert [x.tolist() for x in alignment.Aligned([t or "" for t in text], va, vb).pairs()] == want


def test_spans_tile_texts(spark):
    docs = {i: t for i, t in enumerate(ODD)}
    found = alignment.spans(common.texts(spark.createDataFrame(list(docs.items()), "doc_id long, text string")), A, B).orderBy("doc_id", "start").collect()
    for i, text in docs.items():
        a, b = tokens(text)
        own = [r for r in found if r.doc_id == i]
        assert [t for r in own for t in r.a] == [t for t, _ in a] and [t for r in own for t in r.b] == [t for t, _ in b]
        assert [0, *(r.end for r in own)][:-1] == [r.start for r in own] and [r.end for r in own] == sorted(set(ends(a)) & set(ends(b)))


def test_query(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, alignment.aligned(spark, folder).collect()), key=str) == sorted(plain(docs), key=str)
