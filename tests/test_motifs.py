"""Motif alignment against all maps, on determined and undetermined structures."""

import itertools
import random

import pytest

from sweetlake.jobs.queries import QUERIES
from sweetlake.operators import motifs as m
from sweetlake.operators import structures as s

NAMES = ("rid", "parent", "symbol", "anomer", "pos", "maybe")


def named(rows):
    return [dict(zip(NAMES, (*r, None)[:6])) for r in rows]


def plain(motif, structure, strict, ends):
    """(root -> (residues, links)) of all maps; a possible link counts where not strict."""
    a, b = ({r["rid"]: r for r in rows} for rows in (motif, structure))
    maybe = {i: set(r["maybe"] or ()) & b.keys() if r["parent"] is None else set() for i, r in b.items()}
    leaf = lambda rows, i: not any(r["parent"] == i for r in rows.values())
    top = next(i for i, r in a.items() if r["parent"] is None)
    out = {}
    for p in itertools.permutations(b, len(a)):
        at = dict(zip(a, p))
        if not all(m.accepted(*(tuple(x[k] for k in NAMES[2:5]) for x in (a[i], b[j])), strict) for i, j in at.items()):
            continue
        if ends and any(leaf(a, i) and not leaf(b, j) for i, j in at.items()):
            continue
        if all(b[at[i]]["parent"] == at[r["parent"]] or (not strict and at[r["parent"]] in maybe[at[i]]) for i, r in a.items() if r["parent"] is not None):
            ids, links = out.setdefault(at[top], (set(), set()))
            ids.update(p)
            links.update(f"{'' if b[j]['parent'] is None else b[j]['parent']}-{j}" for j in p if j != at[top])
    return out


def structure(rng, n, floating, symbols=("Man", "Gal", "Fuc", None)):
    """A tree of which the last residues hang as equal or other parts on some of the first."""
    rows = []
    for i in range(1, n + 1):
        up = None if i == 1 else rng.randint(1, i - 1)
        rows.append((i, up, rng.choice(symbols), rng.choice(["a", None]), rng.choice([3, None]), None))
    first = max(2, n - floating + 1)
    spots = [rng.sample(range(1, first), rng.randint(1, first - 1)) for _ in range(2)]
    for i in range(first, n + 1):
        inner = rng.random() < 0.3 and i > first
        like = rng.choice([("Fuc", "a", None), rows[i - 1][2:5]])
        rows[i - 1] = (i, i - 1, *like, None) if inner else (i, None, *like, [*rng.choice(spots), *([first] if rng.random() < 0.15 and i > first else [])])
    return rows


def test_alignment_equals_all_maps():
    rng, loose, equal = random.Random(4), 0, 0
    for _ in range(1_200):
        n = rng.randint(1, 4)
        motif = named([(i, None if i == 1 else rng.randint(1, i - 1), rng.choice(["Man", "Gal", "Fuc", None]), rng.choice(["a", None]), None) for i in range(1, n + 1)])
        rows = structure(rng, rng.randint(2, 7), rng.randint(0, 5))
        rng.shuffle(rows)
        target = m.Target(named(rows))
        equal += any(c > 1 for c in target.counts)
        for strict, ends in itertools.product((False, True), repeat=2):
            found = m.Alignment(m.Shape(motif), target, strict, not strict, ends)
            want = plain(motif, named(rows), strict, ends)
            # A floating part that stands for equal ones gives their roots too.
            got = {j: found.matched(j) for j in found.roots()}
            assert {q for j in got for q in target.same[j]} == want.keys()
            assert set().union(*(ids for ids, _ in got.values())) == set().union(*(ids for ids, _ in want.values()))
            assert set().union(*(links for _, links in got.values())) == set().union(*(links for _, links in want.values()))
            if target.root in want:
                assert got[target.root] == want[target.root]
            loose += any(x.startswith("-") for _, links in want.values() for x in links)
    assert loose > 150 and equal > 100


SCHEMA = "acc string, residues array<struct<rid:int,parent:int,symbol:string,anomer:string,pos:int,maybe:array<int>>>, n_subst int, mass double, repeated boolean"
CORE = [(1, None, "GlcNAc", "b", None, None), (2, 1, "Man", "b", 4, None)]
ARM = [(1, None, "Man", None, None, None), (2, 1, "Fuc", "a", None, None)]


def test_kinds(spark):
    """Undetermined structures, substituents, masses, repeats, compositions, parents that are in no row, empty tables."""
    loose = [*CORE, (3, None, "Fuc", "a", None, [1, 2]), (4, None, "Fuc", "a", None, [1, 2])]
    rows = [
        ("core", CORE, 0, 10.0, False), ("other", CORE, 1, 10.0, False), ("heavy", CORE, 0, 11.0, False), ("ring", CORE, 0, 10.0, True), ("loose", loose, 0, None, None),
        ("comp", [(1, None, "GlcNAc", None, None, None), (2, None, "Man", None, None, None)], 0, 10.0, False), ("dangling", [*CORE, (7, 99, "Fuc", "a", None, None)], None, None, None), ("none", [], None, None, None),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {(r.structure, r.type, r.strict): (r.ids, r.links) for r in m.align_motifs(table.where("acc = 'core'"), table, 3).collect()}
    assert {k[0] for k in got if k[1] == "whole"} == {"core"} and got["core", "whole", True] == ("1,2", "1-2")
    assert {k[0] for k in got if k[1] == "core"} == {"core", "other", "heavy", "ring", "loose"}
    assert {k[0] for k in got if k[1] == "nonreducing"} == {"core", "other", "heavy", "loose"}
    arm = spark.createDataFrame([("arm", ARM, None, None, None)], SCHEMA)
    got = {(r.structure, r.type, r.strict): (r.ids, r.links) for r in m.align_motifs(arm, table).collect()}
    assert got == {("loose", "substructure", False): ("2,3,4", "-3,-4"), ("loose", "nonreducing", False): ("2,3,4", "-3,-4")}
    assert m.align_motifs(arm, table.limit(0)).count() == 0 == m.align_motifs(arm.limit(0), table).count()


def test_two_equal_parts_for_two_places_but_not_for_three():
    motif = lambda n: m.Shape(named([(1, None, "Man", None, None), *((i, 1, "Fuc", None, None) for i in range(2, n + 2))]))
    target = m.Target(named([(1, None, "Man", None, None), *((i, None, "Fuc", None, None, [1]) for i in (2, 3))]))
    found = [{kind: (ids, links) for kind, strict, ids, links in m.alignments(motif(n), target)} for n in (1, 2, 3)]
    assert found[0]["core"] == found[1]["core"] == found[1]["whole"] == ([1, 2, 3], ["-2", "-3"]) and found[2] == {}


def test_many_equal_parts_and_long_chains():
    """Neither lists maps: thirty equal parts on thirty places, and a chain of 1,500 residues."""
    rows = [(i, i - 1 or None, "Man", None, None, None) for i in range(1, 31)] + [(i, None, "Fuc", None, None, list(range(1, 31))) for i in range(31, 61)]
    motif = [(i, i - 1 or None, "Man", None, None) for i in range(1, 6)] + [(i + 5, i, "Fuc", None, None) for i in range(1, 6)]
    found = {kind: (ids, links) for kind, strict, ids, links in m.alignments(m.Shape(named(motif)), m.Target(named(rows))) if not strict}
    assert found["core"][0] == [*range(1, 6), *range(31, 61)] and found["substructure"][0] == list(range(1, 61))
    chain = [(i, i - 1 or None, "Man", None, None) for i in range(1, 1_501)]
    found = {kind: ids for kind, _, ids, _ in m.alignments(m.Shape(named(chain[:3])), m.Target(named(chain)))}
    assert found["core"] == [1, 2, 3] and found["nonreducing"] == [1498, 1499, 1500] and len(found["substructure"]) == 1_500


def test_parents_in_a_cycle_are_an_error():
    with pytest.raises(ValueError, match="cycle"):
        m.Shape(named([(1, None, "Man", None, None), (2, 3, "Man", None, None), (3, 2, "Man", None, None)]))
    with pytest.raises(ValueError, match="cycle"):
        s.Tree(named([(1, 2, "Man", None, None), (2, 1, "Man", None, None)]))


def test_equal_structures_are_aligned_once(spark):
    """3,000 copies of a structure have its rows, and the plan aligns classes."""
    rows = [(f"s{i}", CORE, 0, 10.0, False) for i in range(3_000)] + [("other", CORE, 1, 10.0, False), (None, CORE, 0, 10.0, False)]
    table = spark.createDataFrame(rows, SCHEMA)
    found = m.align_motifs(table.where("acc = 's0'"), table, 3)
    kinds = {(r.type, r["count"]) for r in found.where("strict").groupBy("type").count().collect()}
    assert kinds == {("core", 3_002), ("substructure", 3_002), ("nonreducing", 3_002), ("whole", 3_001)}
    assert "_class" in found._jdf.queryExecution().optimizedPlan().toString()


def test_query_takes_all_motifs_and_trees(spark):
    got = QUERIES["J19_align_motifs"](spark, "/root/testdata/sf0.001").collect()
    assert len({r.motif for r in got}) > 50 and {r.structure % 10 for r in got} == set(range(10))
    loose = [r for r in got if "-" in {x[:1] for x in r.links.split(",")}]
    assert any(r.type == "whole" for r in loose) and not any(r.strict for r in loose)
