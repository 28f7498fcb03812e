"""Tree operators against plain versions on small inputs."""

import itertools
import random

from pyspark.sql import functions as F

from sweetlake.jobs.queries import QUERIES
from sweetlake.operators import components
from sweetlake.operators import motifs as matching
from sweetlake.operators import structures as s

SCHEMA = "acc string, rid int, parent int, symbol string, anomer string, pos int"


def residues(spark, trees):
    return spark.createDataFrame([(acc, *r) for acc, rs in trees.items() for r in rs], SCHEMA)


TREES = {
    "full": [(1, None, "GlcNAc", "b", 4), (2, 1, "Man", "b", 4), (3, 2, "Man", "a", 3), (4, 2, "Man", "a", 6)],
    "loose": [(1, None, "GlcNAc", None, 4), (2, 1, "Man", "b", None), (3, 2, "Man", None, 6), (4, 2, "Man", "a", 3)],
    "chain": [(1, None, "GlcNAc", "b", 4), (2, 1, "Man", "b", 4), (3, 2, "Man", "a", 3), (4, 3, "Man", "a", 6)],
    "small": [(1, None, "Man", "b", 4), (2, 1, "Man", "a", 3)],
}


def test_subsumption(spark):
    df = s.gathered(residues(spark, TREES)).selectExpr("acc", "double(size(residues)) as mass", "acc = 'full' as alditol", "residues")
    assert {tuple(r) for r in s.subsumption_pairs(df, 3).collect()} == {("loose", "full", "subsumed")}


def test_alignment(spark):
    df = s.gathered(residues(spark, TREES))
    got = {(r.structure, r.type, r.strict): r.ids for r in matching.align_motifs(df.where("acc = 'small'"), df).collect()}
    assert got["full", "substructure", True] == "2,3" and got["full", "substructure", False] == "2,3"
    assert ("full", "core", False) not in got and ("chain", "nonreducing", False) not in got
    # Ends of the motif lie on ends of the structure; a residue above them may have other branches.
    assert got["full", "nonreducing", True] == "2,3"
    assert got["small", "whole", True] == "1,2" and got["small", "nonreducing", True] == "1,2"


def tree(rows):
    return s.Tree([dict(zip(("rid", "parent", "symbol", "anomer", "pos"), r)) for r in rows])


def maps(a, b):
    """All one-to-one maps of a's residues that keep a's links."""
    up = [{k: i for i, ks in t.kids.items() for k in ks} for t in (a, b)]
    for p in itertools.permutations(b.node, len(a.node)):
        m = dict(zip(a.node, p))
        if all(s.accepts(a.node[i], b.node[m[i]], False, CLASSES) for i in m) and all(up[1].get(m[i]) == m[p] for i, p in up[0].items()):
            yield m


CLASSES = {"Man": "Hex", "Gal": "Hex"}


def test_long_chains_and_dangling_parents_are_compared():
    chain = tree([(i, i - 1 or None, "Man", None, None) for i in range(1, 1_501)])
    assert s.subsumes_tree(chain, chain)
    assert s.subsumes_tree(tree([(1, None, "Man", None, None), (2, 9, "Gal", None, None)]), tree([(1, None, "Man", None, None), (2, 1, "Gal", None, None)]))


def test_subsumption_equals_brute_force():
    """Trees, undetermined structures and compositions with unknown symbols and classes."""
    rng = random.Random(6)
    hits = 0
    for _ in range(1500):
        n, links = rng.randint(1, 5), rng.random()
        a, b = (
            tree([(i, None if i == 1 or rng.random() > keep else rng.randint(1, i - 1), rng.choice(names), rng.choice([None, "a"]), None) for i in range(1, n + 1)])
            for keep, names in ((links, ["Hex", "Man", None]), (1 if rng.random() < 0.7 else links, ["Man", "Gal"]))
        )
        want = any(len(a.tops) > 1 or len(b.tops) == 1 and m[a.root] == b.root for m in maps(a, b))
        assert s.subsumes_tree(a, b, CLASSES) == want
        hits += want
    assert hits > 100


def test_subsumption_of_compositions_and_unknown_symbols(spark):
    both = {"tree": [(1, None, "GlcNAc", "b", 4), (2, 1, "Man", "b", 4)], "open": [(1, None, "GlcNAc", None, None), (2, 1, None, None, None)], "comp": [(1, None, "GlcNAc", None, None), (2, None, "Man", None, None)], "base": [(1, None, "HexNAc", None, None), (2, None, "Hex", None, None)]}
    df = s.gathered(residues(spark, both)).selectExpr("acc", "1d as mass", "false as alditol", "residues")
    got = {(r.parent, r.child) for r in s.subsumption_pairs(df, 2, {"Man": "Hex", "GlcNAc": "HexNAc"}).collect()}
    assert got == {("open", "tree"), ("comp", "tree"), ("base", "tree"), ("base", "comp")}


def test_alignment_of_very_many_motifs(spark):
    motifs = {f"m{k}": [(1, None, f"s{k % 50}", None, k)] for k in range(6_000)} | {"any": [(1, None, None, None, None)]}
    df = s.gathered(residues(spark, motifs))
    got = matching.align_motifs(df, s.gathered(residues(spark, {"x": [(1, None, "s7", "a", 57)]}))).where("type = 'core' and not strict").collect()
    assert {r.motif for r in got} == {"m57", "any"}


def test_long_chains(spark):
    n = 200
    chain = {"c": [(i, i - 1 or None, "Man", None, None) for i in range(1, n + 1)]}
    ions = s.fragment_ions(residues(spark, chain), spark.createDataFrame([("Man", 1.0)], "symbol string, mass double")).collect()
    assert {(r.rid, r.n, r.mass, r.rest) for r in ions} == {(i, n + 1 - i, float(n + 1 - i), float(i - 1)) for i in range(2, n + 1)}
    found = s.all_fragments(s.gathered(residues(spark, {"c": chain["c"][:20]})), batch=7).collect()
    assert len({r.ids for r in found}) == len(found) == 20 * 21 // 2 and {r.n_cleavages for r in found} == {0, 1, 2}


def test_ions_of_unknown_mass(spark):
    rows = residues(spark, {"x": [(1, None, "Man", None, None), (2, 1, None, None, None), (3, 1, "Man", None, None)]})
    got = {r.rid: (r.n, r.mass, r.rest) for r in s.fragment_ions(rows, spark.createDataFrame([("Man", 1.0)], "symbol string, mass double")).collect()}
    assert got == {2: (1, None, None), 3: (1, 1.0, None)}


def test_fragments(spark):
    df = s.gathered(residues(spark, {"full": TREES["full"]}))
    got = {r.ids: r.n_cleavages for r in s.all_fragments(df).collect()}
    near = {frozenset(p) for p in ((1, 2), (2, 3), (2, 4))}
    want = {}
    for n in range(1, 5):
        for p in itertools.combinations((1, 2, 3, 4), n):
            inside = [e for e in near if e <= set(p)]
            if len(inside) == n - 1:
                want[",".join(map(str, p))] = sum(len(e & set(p)) == 1 for e in near)
    assert got == want


def test_trimming(spark):
    df = s.gathered(residues(spark, TREES))
    got = {r.acc: list(r.removed) for r in s.trim_leaves(df, ["Man"]).collect()}
    assert got["fullt3"] == [2, 3, 4] and got["chaint3"] == [2, 3, 4] and got["smallt1"] == [2]
    once = {r.acc: list(r.removed) for r in s.trim_leaves(df, ["Man"], once=True).collect()}
    assert once["fullt2"] == [3, 4] and once["chaint1"] == [4]


def test_subsumption_query_takes_all_trees(spark):
    got = QUERIES["J18_subsumption_pairs"](spark, "/root/testdata/sf0.001").collect()
    assert {r.parent % 4 for r in got if r.parent > 0} == {0, 1, 2, 3} and any(r.parent < 0 < r.child for r in got)


def test_subsumption_classes_give_every_pair(spark):
    """Pairs of representatives and members are all pairs, with copies, alditols and masses that differ."""
    rng, kind = random.Random(6), "acc int, mass double, alditol boolean, residues array<struct<rid:int,parent:int,symbol:string,anomer:string,pos:int>>"
    rows = [(i, 10.0 + rng.choice((0, s.ALDITOL)), rng.random() < 0.5, [(1, None, "Man", rng.choice("ab"), 4), (2, 1, rng.choice(["Man", "Gal", None]), None, rng.choice([None, 3]))]) for i in rng.sample(range(99), 60)]
    df = spark.createDataFrame(rows, kind)
    want = {tuple(r) for r in s.subsumption_pairs(df, 2).collect()}
    found = s.subsumption_classes(df, 2).collect()
    rep = {r.child: r.parent for r in found if r.kind == "same"}
    held = {i: [k for k, *_ in rows if rep.get(k, k) == i] for i in {r[0] for r in rows} - rep.keys()}
    pairs = {tuple(r) for r in found if r.kind != "same"}
    got = {(a, b, k) for p, q, k in pairs for a in held[p] for b in held[q] if a < b or (q, p, k) not in pairs} | {(a, b, "subsumed") for m in held.values() for a in m for b in m if a < b}
    assert got == want and len(found) < len(want) and rep and {k for _, _, k in want} == {"subsumed", "+aldi"}


def test_forest_roots_equal_components(spark):
    rng = random.Random(2)
    edges = [(i, rng.randint(max(0, i - 3), i - 1)) for i in range(1, 200) if i % 11]
    df = spark.createDataFrame(edges, "dst long, src long")
    want = {r.id: r.component for r in components.connected_components(df).collect()}
    assert {r.id: r.component for r in components.forest_roots(df).collect()} == {i: want[i] for i, _ in edges}
    assert components.forest_roots(df.limit(0)).count() == 0


def cleaved_plain(rows, enzyme):
    """What an enzyme leaves of (rid, parent, symbol, anomer), taking one leaf after the other from the definition."""
    live = {r[0]: r for r in rows}
    known = lambda x, y: x is None or x == y

    def can_go(r):
        kids = lambda i: [k for k in live.values() if k[1] == i]
        if r[1] is None or kids(r[0]) or not known(r[2], enzyme["symbol"]) or not (enzyme.get("anomer") is None or known(r[3], enzyme["anomer"])):
            return False
        if enzyme.get("parent") and not known(live[r[1]][2], enzyme["parent"]):
            return False
        return not any(known(k[2], p) for k in kids(r[1]) if k is not r for p in enzyme.get("protectors", ()))

    if enzyme.get("once"):
        first = [r for r in live.values() if can_go(r)]
        return [r for r in rows if r not in first]
    while ready := [r for r in live.values() if can_go(r)]:
        del live[ready[0][0]]
    return list(live.values())


def all_trees(n):
    """Parents of all trees of n residues whose parents have smaller numbers."""
    return itertools.product(*([None] if i == 1 else range(1, i) for i in range(1, n + 1)))


def test_enzymes_equal_the_definition_on_all_trees():
    """All shapes of up to 7 residues, symbols at random, with conditions on parent, anomer and what hangs beside."""
    rng, count = random.Random(9), 0
    rules = [{"symbol": "Gal"}, {"symbol": "Gal", "parent": "GlcNAc", "protectors": ["Fuc"], "once": True}, {"symbol": "Gal", "parent": "GlcNAc", "protectors": ["Fuc", "Man"]}, {"symbol": "Fuc", "anomer": "a"}, {"symbol": "Fuc", "protectors": ["Fuc"]}]
    for n in range(1, 8):
        for parents in all_trees(n):
            rows = [(i, p, rng.choice(["Gal", "Gal", "GlcNAc", "Fuc", "Man", None]), rng.choice(["a", "b", None])) for i, p in enumerate(parents, 1)]
            rule = rng.choice(rules)
            t = tree([(*r, None) for r in rows])
            gone = s.cleaved(t, rule)
            assert sorted(t.node) == sorted(r[0] for r in cleaved_plain(rows, rule)) and len(gone) + len(t.node) == n
            count += len(gone)
    assert count > 500


def test_digest_in_turn_and_together(spark):
    """Gal lies under Fuc and Fuc under Gal: in turn one layer goes, together all; parents and suffixes; empty tables."""
    chain = [(1, None, "GlcNAc", None, None), (2, 1, "Gal", None, None), (3, 2, "Fuc", None, None), (4, 3, "Gal", None, None), (5, 4, "Fuc", None, None)]
    df = s.gathered(residues(spark, {"x": chain, "y": chain[:1], "loose": [(1, None, "Gal", None, None), (2, 9, "Fuc", None, None)]}))
    both = [{"symbol": "Gal", "suffix": "G"}, {"symbol": "Fuc", "suffix": "F"}]
    ask = lambda together: {r.acc: ([list(c) for c in r.cut], list(r.counts), [k.rid for k in r.residues]) for r in s.digest(df, both, together).collect()}
    assert ask(False) == {"x-F1": ([[], [5]], [0, 1], [1, 2, 3, 4]), "y": ([[], []], [0, 0], [1]), "loose": ([[], []], [0, 0], [1, 2])}
    assert ask(True)["x-G2-F2"] == ([[2, 4], [3, 5]], [2, 2], [1])
    assert s.digest(df.limit(0), both).count() == 0
    long = tree([(i, i - 1 or None, "Gal", None, None) for i in range(1, 5_001)])
    assert len(s.cleaved(long, {"symbol": "Gal"})) == 4_999


def test_rules_name_core_tests(spark):
    """A rule's test is a core; structures of two tops and empty ones hold none."""
    core = [(1, None, "GlcNAc", None, None), (2, 1, "GlcNAc", "b", 4), (3, 2, "Man", None, None), (4, 3, "Man", "a", 3), (5, 3, "Man", "a", 6)]
    df = s.gathered(residues(spark, {"core": core, "beta": [*core[:4], (5, 3, "Man", "b", 6)], "comp": [(i, None, *r[2:]) for i, r in enumerate(core, 1)]}))
    df = df.unionByName(df.limit(1).selectExpr("'none' as acc", "filter(residues, r -> false) as residues")).withColumns({"n_core": s.rooted(s.N_CORE), "motifs": F.array(F.lit("m"))})
    assert [r.acc for r in s.classify(df, [{"id": "n", "type": "N-linked", "motifs": ["m"], "test": "n_core"}]).collect()] == ["core"]
    assert {r.acc for r in df.where(s.accepted_core(["Man"])).collect()} == set() and {r.acc for r in df.where(s.accepted_core(["GlcNAc"])).collect()} == {"core", "beta"}
    assert {r.acc for r in df.where(s.no_branch()).collect()} == {"comp", "none"}


def test_subsumption_of_substituents_and_repeats_equals_brute_force():
    rng, hits = random.Random(8), 0
    for _ in range(2_500):
        n = rng.randint(1, 4)
        pair = []
        for known in (0.4, 0.8):
            rows = [{"rid": i, "parent": None if i == 1 else rng.randint(1, i - 1), "symbol": "Man", "anomer": None, "pos": None, "subst": [{"name": rng.choice("SP"), "pos": rng.choice([3, 6]) if rng.random() < known else None} for _ in range(rng.choice([0, 0, 1, 2]))], "bridge": None} for i in range(1, n + 1)]
            if rng.random() < 0.3:
                rows[-1]["bridge"] = rng.randint(1, n)
            pair.append(s.Tree(rows))
        a, b = pair

        def held(i, j):
            general, special = a.subst.get(i, []), b.subst.get(j, [])
            return len(general) == len(special) and any(all(g[0] == x[0] and g[1] in (None, x[1]) for g, x in zip(general, p)) for p in itertools.permutations(special))

        want = len(a.bridge) == len(b.bridge) and any(m[1] == 1 and all(held(i, j) for i, j in m.items()) and all(b.bridge.get(m[i]) == m[k] for i, k in a.bridge.items()) for m in maps(a, b))
        assert s.subsumes_tree(a, b) == want
        hits += want
    assert hits > 100


def test_subsumption_of_substituents_in_a_table(spark):
    kind = "acc string, mass double, alditol boolean, residues array<struct<rid:int,parent:int,symbol:string,anomer:string,pos:int,subst:array<struct<name:string,pos:int>>,bridge:int>>"
    rows = [(acc, 1.0, False, [(1, None, "Man", None, None, subst, bridge)]) for acc, subst, bridge in [("open", [("S", None)], None), ("three", [("S", 3)], None), ("none", None, None), ("ring", [("S", 3)], 1), ("vague", [("S", None)], 1)]]
    got = {(r.parent, r.child) for r in s.subsumption_pairs(spark.createDataFrame(rows, kind), 2).collect()}
    assert got == {("open", "three"), ("vague", "ring")}
