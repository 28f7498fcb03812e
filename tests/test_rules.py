"""Rules with answers worked by hand."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweetlake.functions import text
from sweetlake.operators import chromatograms, fdr, hierarchy, joins, library, stats
from sweetlake.operators.components import connected_components
from sweetlake.sources import readers, sinks

SCORED = [("g1", 10.0, 0), ("g1", 9.0, 0), ("g2", 8.0, 0), ("g3", 7.0, 1), ("g4", 6.0, 0), ("g5", 5.0, 1)]


def scored(spark):
    return spark.createDataFrame(SCORED, "grp string, score double, decoy int")


def test_best_curve_and_qvalues(spark):
    best = fdr.best_per_group(scored(spark), ["grp"], "score", ["decoy"])
    assert best.count() == 5
    curve = fdr.fdr_curve(best)
    assert {r.score: round(r.fdr, 6) for r in curve.collect()} == {5.0: 0.666667, 6.0: 0.333333, 8.0: 0.0}
    asked = spark.createDataFrame([(10.0,), (7.0,), (5.0,), (4.0,), (None,)], "score double")
    q = {r.score: round(r.qvalue, 6) for r in fdr.assign_qvalue(asked, curve).collect()}
    assert q == {10.0: 0.0, 7.0: 0.333333, 5.0: 0.666667, 4.0: 1.0, None: 1.0}
    assert fdr.score_at(curve, 0.4).first()[0] == 6.0
    assert fdr.targets_at(best, 7.0).first()[0] == 2
    assert fdr.fdr_curve(best.limit(0)).count() == 0


def test_benjamini_hochberg(spark):
    three = fdr.bh_fdr(spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double"))
    assert sorted(round(r.bh, 6) for r in three.collect()) == [0.03, 0.04, 0.04]
    two = fdr.bh_fdr(spark.createDataFrame([(0.04,), (0.05,)], "p double"))
    assert {r.p: round(r.bh, 6) for r in two.collect()} == {0.04: 0.08, 0.05: 0.05}


def test_compositions(spark):
    df = spark.createDataFrame([("HexNAc2Hex5",), ("HexNAc(2)Hex(5)",), ("comp_HexNAc2Hex5",)], "t string")
    for r in df.select(text.parse_composition(F.col("t")).alias("c"), text.format_composition(text.parse_composition(F.col("t")), "bracketed").alias("b")).collect():
        assert r.c == {"HexNAc": 2, "Hex": 5} and r.b == "HexNAc(2)Hex(5)"
    label = df.limit(1).select(text.fragment_label(F.lit("Y[HN2F]")).alias("x")).first().x
    assert (label.number, label.series) == (4, "y")


@pytest.mark.parametrize("last,kept", [(10.0, True), (9.0, False)])
def test_library_ratio(spark, last, kept):
    m = spark.createDataFrame([("p", i, x) for i, x in enumerate((100.0, 50.0, 20.0, last))], "pep string, tr int, intensity double")
    assert (library.transition_library(m, ["pep"], "tr").count() > 0) == kept


def test_confusable(spark):
    tr = spark.createDataFrame([(1, 500.0, 1.0, 1.0), (2, 500.04, 1.0, 1.0), (3, 500.085, 1.0, 1.0)], "key int, prod double, nrt double, prec double")
    for slices in (1, 3):
        n = {r.key: r.n for r in library.confusable_transitions(tr, "key", {"prod": 0.05, "nrt": 3, "prec": 30}, slices).collect()}
        assert n == {1: 1, 2: 2, 3: 1}


def test_confusable_of_equal_values(spark):
    """4,000 transitions of two values: two points meet, not 8 million pairs; an unknown value confuses with nothing."""
    tr = spark.range(4_000).selectExpr("id as key", "if(id % 2 = 0, 500d, 500.04d) as prod", "1d as nrt").unionByName(spark.createDataFrame([(9_999, None, 1.0)], "key long, prod double, nrt double"))
    found = library.confusable_transitions(tr, "key", {"prod": 0.05, "nrt": 3})
    assert found.groupBy("n").count().orderBy("n").collect() == [(0, 1), (3_999, 4_000)]
    assert "_m" in found._jdf.queryExecution().optimizedPlan().toString()


def test_source_ids_come_once_before_the_join(spark):
    """Repeated facts and ids are not multiplied: the join is the last step and has the result's rows."""
    taxa = spark.range(2_000).selectExpr("1 as taxid", "'s' as source", "id % 2 as sourceid")
    ids = spark.range(2_000).selectExpr("'s' as source", "id % 2 as sourceid", "id % 4 as acc")
    found = joins.source_ids_to_accessions(taxa, ids)
    assert sorted(tuple(r) for r in found.collect()) == [(a, 1, "s", a % 2) for a in range(4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(i for i, x in enumerate(plan) if "Join" in x) < next(i for i, x in enumerate(plan) if "Aggregate" in x)


def test_motif_hits_look_up_each_set_once(spark):
    """2,000 structures of two sets of alignments and 300 motifs: ids are dealt to the sets, not to the structures."""
    align = spark.range(2_000).selectExpr("id as structure", "explode(array(1, 2, 2)) as motif", "'core' as type", "id % 2 = 0 as strict")
    motifs = spark.range(300).selectExpr("concat('m', id) as motif_id", "1 + id % 2 as structure_acc", "'core' as alignment")
    found = joins.motif_hits(align, motifs).collect()
    every = ";".join(sorted(f"m{i}" for i in range(300)))
    assert len(found) == 2_000 and all(r.loose == every and r.strict == (every if r.structure % 2 == 0 else "") for r in found)
    plan = joins.motif_hits(align, motifs)._jdf.queryExecution().optimizedPlan().toString()
    assert "first(held" in plan


def test_motif_hits_shuffle_no_ids_by_set(spark):
    """3,000 structures of different sets and 6,000 motifs: 24 million ids in the lists, of which none is shuffled; unknown values stay."""
    align = spark.range(3_000).selectExpr("id as structure", "explode(sequence(0, 11)) as motif", "if(id = 1, null, (id * 7919) % 4093) as code").where("shiftright(code, motif) % 2 = 1 or code is null")
    align = align.selectExpr("if(structure = 1, null, structure) as structure", "motif", "'core' as type", "if(code is null, null, code % 3 = 0) as strict")
    motifs = spark.range(6_000).selectExpr("if(id = 5, null, id div 2) as motif_id", "id % 12 as structure_acc", "'core' as alignment")
    found = {r.structure: r for r in joins.motif_hits(align, motifs).collect()}
    ids = {m: {i // 2 for i in range(m, 6_000, 12) if i != 5} for m in range(12)}
    for k in range(3_000):
        code = 4_095 if k == 1 else k * 7919 % 4093
        every = ";".join(map(str, sorted(set().union(*(ids[m] for m in range(12) if code >> m & 1)))))
        if code == 0:
            assert k not in found
            continue
        r = found[None if k == 1 else k]
        assert r.loose == every and r.strict == (every if code % 3 == 0 and k != 1 else "")
    plan = joins.motif_hits(align, motifs)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(motif_id" not in plan


def test_ids_of_more_digits_than_the_width_stay_whole(spark):
    """120 keys of ids of two digits: number 100 and those after it are not cut, so no id comes twice."""
    old = spark.createDataFrame([(7, "TG02")], "key long, id string")
    got = {r.key: r.id for r in sinks.assign_ids(spark.range(120).withColumnRenamed("id", "key"), old, "TG", 2).collect()}
    assert got[7] == "TG02" and got[0] == "TG01" and got[119] == "TG120"
    assert len(set(got.values())) == 120


def test_elements_share_one_count_of_symbols(spark):
    """The rows are read once: known symbols, unknown ones and elements come from one count; a glycan of unknown symbols only has none."""
    items = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (2, "A"), (2, "?"), (3, "?"), (4, None)], "acc int, symbol string")
    table = spark.createDataFrame([("A", "C", 2), ("A", "H", 3), ("B", "C", 5)], "symbol string, element string, n int")
    found = stats.elemental_composition(items, table)
    assert {tuple(r) for r in found.collect()} == {(1, "C", 9), (1, "H", 6), (2, "C", None), (2, "H", None)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_closure_reduction_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "parent string, child string")
    closure = hierarchy.transitive_closure(e)
    assert {tuple(r) for r in closure.collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    assert {tuple(r) for r in hierarchy.transitive_reduction(closure).collect()} == {("a", "b"), ("b", "c")}
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "src int, dst int")).collect()}
    assert got == {x: root(x) for p in pairs for x in p}


def test_species(spark):
    closure = hierarchy.transitive_closure(spark.createDataFrame([("comp", "topo"), ("topo", "sac1"), ("topo", "sac2")], "parent string, child string"))
    direct = spark.createDataFrame([("sac1", "human")], "acc string, species string")
    comp = spark.createDataFrame([(x, "comp") for x in ("comp", "topo", "sac1", "sac2")], "acc string, comp string")
    got = {r.acc: r.kind for r in hierarchy.propagate_species(direct, closure, comp).collect()}
    assert got == {"sac1": "Direct", "topo": "Subsumption", "comp": "Subsumption", "sac2": "Composition"}


def test_direct_and_untyped(spark):
    rows = spark.createDataFrame([(9606, "liver", True), (9606, "liver", False), (9606, "lung", False)], "taxid int, tissue string, direct boolean")
    assert sorted(tuple(r) for r in hierarchy.prefer_direct(rows, ["taxid", "tissue"], "direct").collect()) == [(9606, "liver", True), (9606, "lung", False)]
    typed = spark.createDataFrame([("N", "hybrid"), ("N", None), ("O", None)], "type string, subtype string")
    assert sorted(tuple(map(str, r)) for r in hierarchy.drop_untyped(typed, ["type"], "subtype").collect()) == [("N", "hybrid"), ("O", "None")]


def test_peptides_and_replacements(spark):
    p = spark.createDataFrame([("p1", "NGT", 1, ["q"])], "pep_id string, sequence string, site int, proteins array<string>")
    q = spark.createDataFrame([("q", "ANGTNGTK")], "acc string, protein_sequence string")
    got = sorted((r.start, r.left, r.right, r.protein_site) for r in joins.locate_peptides(p, q).collect())
    assert got == [(2, "A", "N", 2), (5, "T", "K", 5)]
    h = spark.createDataFrame([("A", "x", "h1", True), ("B", "h1", "h1", False)], "acc string, own string, validated string, invalid boolean")
    assert {r.acc: (r.valid, r.replacement) for r in stats.valid_and_replacement(h).collect()} == {"A": (False, "B"), "B": (True, None)}


def test_tails(spark):
    df = spark.createDataFrame([([0.5, 0.5], 1)], "p array<double>, k int")
    assert df.select(chromatograms.poisson_binomial_tail("p", "k").alias("t")).first().t == pytest.approx(0.75)
    assert df.select(text.chance_any(F.lit(0.1), F.lit(2)).alias("c")).first().c == pytest.approx(0.19)


def test_lineage(spark):
    nodes = spark.createDataFrame([(9606, "species", 9605), (9605, "genus", 9604), (9604, "family", 1), (1, "no rank", 1)], "tax_id int, rank string, parent_id int")
    ids = spark.createDataFrame([(9606,)], "id int")
    assert {r["rank"]: r.ancestor for r in hierarchy.ranked_ancestors(ids, nodes).collect()} == {"species": 9606, "genus": 9605, "family": 9604}


def test_chromatogram_specificity(spark):
    x = spark.createDataFrame([("s", -2.0, 4.0), ("s", 0.0, 10.0), ("s", 3.0, 6.0)], "series string, rt double, int double")
    c = spark.createDataFrame([("s", 0.0)], "series string, centre double")
    r = chromatograms.chromatogram_specificity(x, c).first()
    assert (r.inside, r.outside, r.percent, r.specific) == (10.0, 6.0, 60.0, False)


def test_robust_fit(spark):
    p = spark.createDataFrame([("a", float(i), 2.0 * i + 1 + (50 if i == 7 else 0)) for i in range(20)], "k string, x double, y double")
    r = chromatograms.robust_fit(p, "k", "x", "y").first()
    assert (round(r.slope, 6), round(r.intercept, 6), r.removed) == (2.0, 1.0, 1)


def test_subsumption_dump(spark, tmp_path):
    """Text before the first cluster, warnings amid a section, lines of other forms, repeated keys, empty sections and lists."""
    text = """junk
# START now - 2 accessions in molecular weight cluster for 910.3
# WARNING:5 - early - with a dash
# NODES - 2/2 + 0 glycans in molecular weight cluster for 910.3
G00001AA 910.327 Saccharide* G00001AA* G00002BB None FULL HASARCH:G00009ZZ Hex:3 Hex:4 S:1
# WARNING:2 - inside
G00002BB\t910.3 Composition None G00002BB None
short line
# ENDNODES
G00003CC 1.0 Topology None None None
# TREE
G00001AA Saccharide 120
  G00002BB Composition* -
  G00004DD* Topology 7
# ENDTREE
# EDGES
G00002BB: G00001AA G00004DD*
G00001AA:
no list
# ENDEDGES
# DONE - Elapsed time 1.0 sec.
# START later
# NODES - 0/0 + 0 glycans in molecular weight cluster for 1000.00
# ENDNODES
"""
    (tmp_path / "dump.txt").write_text(text)
    d = readers.read_subsumption_dump(spark, str(tmp_path / "dump.txt"))
    got = {r.acc: r for r in d.nodes.collect()}
    assert got.keys() == {"G00001AA", "G00002BB"} and {r.bucket for r in got.values()} == {"910.30"}
    one = got["G00001AA"]
    assert (one.mw, one.level, one.topo, one.comp, one.bcomp) == ("910.33", "Saccharide", "G00001AA", "G00002BB", None)
    assert one.counts == {"Hex": 4, "S": 1} and one.extras == {"FULL": "true", "HASARCH": "G00009ZZ", "S": "1"} and got["G00002BB"].counts == {}
    assert {tuple(r)[1:] for r in d.edges.collect()} == {("G00002BB", "G00001AA", "subsumed"), ("G00002BB", "G00004DD", "+aldi")}
    assert {tuple(r)[1:] for r in d.missing.collect()} == {("G00001AA", 120), ("G00002BB", None)}
    assert {tuple(r)[1:] for r in d.warnings.collect()} == {(5, "early - with a dash"), (2, "inside"), (None, "unread: short line"), (None, "unread: no list")}


def test_subsumption_dump_keeps_equal_lines(spark):
    """Equal lines of the tree and equal warnings of one cluster are a row each, as nodes and edges are."""
    line = "G10000AA Topology -"
    text = f" now\n# NODES - for 910.30\nshort\nshort\n# ENDNODES\n# TREE\n{line}\n  {line}\n# ENDTREE\n# WARNING:3 - odd\n# WARNING:3 - odd\n"
    d = readers.subsumption_dump(readers.subsumption_lines(spark.createDataFrame([(text,)], "value string")))
    assert [tuple(r) for r in d.missing.collect()] == [("910.30", "G10000AA", None)] * 2
    assert sorted(r.message for r in d.warnings.collect()) == ["odd", "odd", "unread: short", "unread: short"]


def test_walks_of_many_rounds_have_small_plans(spark):
    """A chain of 40 rounds and a cycle: all is found, and the plan has a part for each doubling, not for each round."""
    step = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "at int, next int")
    found = hierarchy.walked(spark.createDataFrame([(1, 0), (2, 100)], "id int, at int"), step)
    assert {tuple(r) for r in found.collect()} == {(1, i) for i in range(1, 41)} | {(2, 101)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") < 12


def test_minimal_topologies_follow_only_what_is_below(spark):
    """3,000 topologies below one composition, none above another, are looked up one by one."""
    closure = spark.range(3_000).selectExpr("'b' as ancestor", "concat('t', id) as descendant").unionByName(spark.createDataFrame([("t0", "t1"), ("t1", "t2"), ("t0", "t2")], "ancestor string, descendant string"))
    nodes = spark.range(3_000).selectExpr("concat('t', id) as acc", "'Topology' as level")
    found = hierarchy.minimal_topologies(nodes, closure, spark.createDataFrame([("b",)], "acc string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.topology for r in found.collect()} == {f"t{i}" for i in range(3_000)} - {"t1", "t2"}
    assert not any("acc" in line.split("=")[0] and line.count("acc#") == 2 for line in plan.splitlines() if "Join Inner" in line)


def plain_closure(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in out if b == c and a != d} - out:
        out |= more
    return {(a, b) for a, b in out if a != b}


def test_closure_and_reduction_of_random_graphs(spark):
    """Graphs with many paths of other lengths, with a cycle and a loop, and without edges."""
    rng = np.random.default_rng(1)
    dag = {(int(a), int(b)) for a, b in rng.integers(0, 40, (90, 2)) if a < b} | {(i, i + 1) for i in range(50, 75)}
    for edges in (dag, dag | {(75, 50), (3, 3)}, set()):
        df = spark.createDataFrame(sorted(edges), "parent int, child int")
        found = hierarchy.transitive_closure(df)
        assert sorted(map(tuple, found.collect())) == sorted(plain_closure(edges))
    closed = plain_closure(dag)
    want = {(a, c) for a, c in closed if not any((a, b) in closed and (b, c) in closed for b in range(80))}
    df = spark.createDataFrame(sorted(dag), "parent int, child int")
    assert {tuple(r) for r in hierarchy.transitive_reduction(hierarchy.transitive_closure(df), df).collect()} == want


def test_restricted_graph_equals_plain(spark):
    """Both kinds of edges, landmarks, the root and ancestors of a level, on random graphs."""
    for seed in range(2):
        rng = np.random.default_rng(seed)
        edges = {(f"n{a}", f"n{b}"): str(rng.choice(["subsumed", "subsumed", "+aldi"])) for a, b in rng.integers(0, 30, (70, 2)) if a < b}
        marks = {f"n{i}": (f"n{max(0, i - 5)}" if i % 3 else None, ["Topology", "Saccharide", None][i % 3]) for i in range(30)}
        asked = {f"n{i}" for i in rng.integers(10, 30, 6)}
        strict, every = plain_closure({e for e, k in edges.items() if k == "subsumed"}), plain_closure(edges)
        keep = asked | {marks[a][0] for a in asked} - {None} | {"n0"} | {p for p, c in strict if c in asked and marks[p][1] == "Saccharide"}
        reduced = []
        for closed in (strict, every):
            own = {(a, b) for a, b in closed if a in keep and b in keep}
            reduced.append({(a, c) for a, c in own if not any((a, b) in own and (b, c) in own for b in keep)})
        want = {(*e, "subsumed") for e in reduced[0]} | {(*e, "other") for e in reduced[1] - reduced[0]}
        nodes = spark.createDataFrame([(a, *m) for a, m in marks.items()], "acc string, mark string, level string")
        table = spark.createDataFrame([(*e, k) for e, k in edges.items()], "parent string, child string, kind string")
        got = hierarchy.restrict_graph(nodes, table, spark.createDataFrame([(a,) for a in asked], "acc string"), ["mark"], "n0", ("Saccharide",))
        assert {tuple(r) for r in got.collect()} == want


def test_supporting_residues(spark):
    """A chain 1-2-3-4 with a branch 5 on 2: what lies above 4 and 5, without what is aligned in the same map."""
    residues = spark.createDataFrame([("x", 1, None), ("x", 2, 1), ("x", 3, 2), ("x", 4, 3), ("x", 5, 2)], "acc string, rid int, parent int")
    matches = spark.createDataFrame([("m", 1, "x", 4, "core", 1), ("m", 2, "x", 2, "core", 1), ("m", 1, "x", 5, "core", 2), ("n", 1, "y", 1, "core", 1)], "motif string, motif_rid int, structure string, rid int, type string, idx int")
    enzymes = spark.createDataFrame([("x", i, f"N{i}", s, g, v) for i, s, g, v in [(1, "h", "A", 0), (1, "h", "B", 0), (1, "m", "C", 1), (2, "m", "D", 0), (3, "h", None, 0), (5, "h", "E", 0)]], "acc string, rid int, node_id string, species string, gene string, violations int")
    got = {(r.idx, r.rid): (r.motif_rid, r.human, r.mouse) for r in joins.enzyme_alignments(matches, residues, enzymes, {"human": "h", "mouse": "m"}).collect()}
    assert got == {(1, 2): (2, "-", "D"), (1, 3): (None, "-", "-"), (1, 1): (None, "A,B", "-"), (2, 5): (1, "E", "-"), (2, 2): (None, "-", "D"), (2, 1): (None, "A,B", "-")}


def test_glycosites(spark):
    """One alignment and one class only, wanted samples, the first fitting name, letters without a name; empty tables."""
    kind = "array<struct<protein:string,site:string>>"
    peptides = spark.createDataFrame([("p1", "g", [("Q1", "N52")]), ("p2", "g", [("Q1", "N52")]), ("p3", "g", [("Q1", "N52"), ("Q2", "N7")]), ("p4", "two", [("Q1", "N52")]), ("p5", "g", [("Q2", "X9")]), ("p6", "g", [("Q1", "N52")])], f"pep_id string, glycan string, alignments {kind}")
    glycans = spark.createDataFrame([("g", ["HexNAc2Fuc1", "Hex3", "HexNAc2Hex3", "HexNAc9"], ["N-linked"]), ("two", ["HexNAc1"], ["N-linked", "O-linked"])], "acc string, names array<string>, classes array<string>")
    tgs = spark.createDataFrame([("p2", "s1"), ("p1", "s1"), ("p1", "s1"), ("p3", "s1"), ("p4", "s1"), ("p5", "s1"), ("p6", "s2")], "peptide string, sample string")
    samples = spark.createDataFrame([("s1",)], "sample string")
    got = {tuple(r) for r in library.glycosites(tgs, peptides, glycans, samples).collect()}
    assert got == {("Q1", 52, "Asn", "g", "HexNAc2Hex3", "N-linked", "p1,p2", "Q1@N52"), ("Q2", 9, None, "g", "HexNAc2Hex3", "N-linked", "p5", "Q2@X9")}
    assert "p6" in {p for r in library.glycosites(tgs, peptides, glycans).collect() for p in r.peptides.split(",")}
    assert library.glycosites(tgs.limit(0), peptides, glycans).count() == 0


def test_calibration_of_the_first_document(spark):
    rows = [("a", "2", "1.5:2"), ("a", "1", None), ("a", "3", "9:9"), ("b", "1", "x:1"), ("c", "1", None)]
    assert {tuple(r) for r in library.dia_calibration(spark.createDataFrame(rows, "spectra string, name string, lccalibration string")).collect()} == {("a", 1.5, 2.0), ("b", None, 1.0)}


def test_composition_counts_are_dealt_by_number(spark, monkeypatch):
    """20 items in pieces of 2: one shuffle by acc, into as many partitions as the items ask for; null symbols and several parents count."""
    monkeypatch.setattr(stats, "PART_ROWS", 2)
    rows = [(i % 7, s) for i, s in enumerate(["Man", "Gal", None, "Man", "Fuc"] * 4)]
    items = spark.createDataFrame(rows, "acc int, symbol string")
    parents = spark.createDataFrame([("Man", "Hex"), ("Gal", "Hex"), ("Man", "Any")], "symbol string, parent string")
    got = stats.composition_counts(items, parents)
    want = Counter()
    for acc, symbol in rows:
        for s in (symbol, *{"Man": ("Hex", "Any"), "Gal": ("Hex",)}.get(symbol, ()), "*"):
            want[acc, s] += 1
    assert {(r.acc, r.symbol): r.n for r in got.collect()} == want and got.rdd.getNumPartitions() == 10
    flagged = stats.repeat_flagged_counts(got, got.withColumn("n", F.col("n") + F.when(F.col("symbol") == "Hex", 1).otherwise(0)).where("symbol <> 'Fuc'"))
    assert {(r.acc, r.symbol): r.n for r in flagged.collect()} == {(a, s): f"{n}{'+' if s in ('Hex', 'Fuc', None) else ''}" for (a, s), n in want.items()}


def test_paths_are_joined_by_sorting(spark):
    """No side of a walk or of supporting residues is broadcast."""
    residues = spark.createDataFrame([(1, r, r - 1 if r > 1 else None) for r in range(1, 6)], "acc int, rid int, parent int")
    matches = spark.createDataFrame([("m", 40, 1, 4, "core", 1)], "motif string, motif_rid int, structure int, rid int, type string, idx int")
    enzymes = spark.createDataFrame([(1, r, f"N{r}", "human", "G", 0) for r in range(1, 6)], "acc int, rid int, node_id string, species string, gene string, violations int")
    found = joins.enzyme_alignments(matches, residues, enzymes, {"human": "human"})
    assert {(r.rid, r.motif_rid) for r in found.collect()} == {(4, 40), (3, None), (2, None), (1, None)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
