"""Merkle manifests against a plain version."""

import hashlib
import zlib

import duckdb
import pytest

from sweetlake.llm import merkle

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(*fields):
    return H("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes):
    """Root and, for each node, its siblings left and right level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, j in enumerate(at):
            first = j - j % 3
            paths[k].append(("".join(nodes[first:j]), "".join(nodes[j + 1 : first + 3])))
            at[k] = j // 3
        nodes = [H("".join(nodes[j : j + 3])) for j in range(0, len(nodes), 3)]
    return nodes[0] if nodes else None, paths


def plain(leaves):
    """Counter-like list of (id, leaf, subroot, root, proof, folded_root) of (id, grp, leaf, claimed)."""
    groups = {}
    for r in leaves:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])) for g in order}
    subs = {g: climb([r[2] for r in own[g]]) for g in order}
    root, tops = climb([subs[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for r, path in zip(own[g], subs[g][1]):
            h = r[3]
            for left, right in path + top:
                h = H(left + h + right)
            out.append((r[0], r[2], subs[g][0], root, ",".join("|".join(s) for s in path + top), h))
    return out


KIND = "id long, grp string, leaf string, claimed string"


@pytest.mark.parametrize("span", [1, 2, 6])
def test_manifest_equals_plain(spark, span):
    """Groups of 1 to 100 nodes, more groups than a superblock holds, null groups and ids, repeated ids and rows."""
    rows = [(i, g, H(f"{g}{i}"), H(f"{g}{i}" + "x" * (i % 2))) for g, n in [(None, 4), ("", 1), ("hot", 100), ("é", 9), ("z", 10), *((f"s{k}", 1 + k % 5) for k in range(12))] for i in range(n)]
    rows += [(None, "hot", H("n"), H("n")), (7, "hot", H("again"), H("again")), (7, "z", H("z7"), H("z7")), (7, "z", H("z7"), H("z7"))]
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, KIND), span).collect()]
    want = [(None if w[0] is None else str(w[0]), *w[1:]) for w in plain(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {w[5] == w[3] for w in want} == {True, False}


def test_query(spark, folder, tmp_path):
    """Awkward rows, and rows with line feeds, against the plain version and against SQL."""
    at = f"{tmp_path}/documents.parquet"
    more = spark.createDataFrame([(i, f"line {i}\nline\n", "en", f"src{i % 3}", 7, "k", "x") for i in range(100, 120)], "doc_id long, text string, lang string, source string, n_chars long, key string, grp string")
    spark.read.parquet(f"{folder}/documents.parquet").unionByName(more).write.parquet(at)
    found = merkle.proofs(spark, str(tmp_path))
    got = sorted(map(tuple, found.collect()), key=str)
    docs = spark.read.parquet(at).collect()
    cut = lambda r: r.text and r.text.replace("\n", "") if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 else r.text
    rows = [(r.doc_id, r.source, leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text), leaf(r.doc_id, r.source, r.lang, r.n_chars, cut(r))) for r in docs]
    want = [(i, h, sub, root, H(proof.replace("|", "").replace(",", "")), fold, fold == root) for i, h, sub, root, proof, fold in plain(rows)]
    assert got == sorted(want, key=str)
    assert {r[6] for r in got} == {True, False}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
    con.execute(merkle.PROOFS_SQL)
    order = [[d[0] for d in con.description].index(c) for c in found.columns]
    assert sorted((tuple(r[k] for k in order) for r in con.fetchall()), key=str) == got
