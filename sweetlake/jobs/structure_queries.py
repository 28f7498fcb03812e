"""Queries on trees that are made of part keys: 3 to 6 residues in a chain or a heap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, motifs
from ..operators import structures as s
from .registry import Tables, query
from .table_queries import text

RESIDUES_SQL = """r AS (SELECT p_partkey AS acc, CAST(i AS INTEGER) AS rid, CASE WHEN i > 1 THEN CAST(CASE WHEN p_partkey % 2 = 1 THEN i // 2 ELSE i - 1 END AS INTEGER) END AS parent,
['GlcNAc', 'Man', 'Gal'][1 + (p_partkey // 7 + i) % 3] AS symbol FROM part, range(1, 7) t(i) WHERE i <= 3 + p_partkey % 4)"""
MASSES = [("GlcNAc", 203.0794), ("Man", 162.0528), ("Gal", 162.0528)]


def residues(t: Tables) -> DataFrame:
    k, i = F.col("p_partkey"), F.col("rid")
    rows = t.part.select(k, F.explode(F.sequence(F.lit(1), (F.lit(3) + k % 4).cast("int"))).alias("rid"))
    return rows.select(
        k.alias("acc"), i, F.when(i > 1, F.when(k % 2 == 1, F.floor(i / 2)).otherwise(i - 1)).cast("int").alias("parent"),
        F.get(F.array(F.lit("GlcNAc"), F.lit("Man"), F.lit("Gal")), (F.floor(k / 7) + i) % 3).alias("symbol"),
        F.when((k + i) % 5 > 0, F.when(k % 11 > 5, "a").otherwise("b")).alias("anomer"), F.when(i % 3 > 0, F.lit(4)).alias("pos"),
    )


def trees(t: Tables) -> DataFrame:
    return s.gathered(residues(t))


@query("J18_subsumption_pairs")
def j18(t):
    """Pairs of class representatives, and each class's members."""
    mass = F.aggregate("residues", F.lit(0.0), lambda m, r: m + F.when(r["symbol"] == "GlcNAc", 203.0794).otherwise(162.0528))
    rows = trees(t).select("acc", mass.alias("mass"), (F.col("acc") % 6 == 1).alias("alditol"), "residues")
    # Compositions, and base compositions of classes of residues, of some trees: the levels above topologies.
    plain = lambda symbol: F.transform("residues", lambda r: F.struct(r["rid"].alias("rid"), F.lit(None).cast("int").alias("parent"), symbol(r).alias("symbol"), F.lit(None).cast("string").alias("anomer"), F.lit(None).cast("int").alias("pos")))
    comp = rows.where("acc % 40 = 0").select((-F.col("acc")).alias("acc"), "mass", F.lit(False).alias("alditol"), plain(lambda r: r["symbol"]).alias("residues"))
    base = rows.where("acc % 80 = 1").select((-F.col("acc")).alias("acc"), "mass", F.lit(False).alias("alditol"), plain(lambda r: F.when(r["symbol"] == "GlcNAc", "HexNAc").otherwise("Hex")).alias("residues"))
    return s.subsumption_classes(rows.unionByName(comp).unionByName(base), classes={"Man": "Hex", "Gal": "Hex", "GlcNAc": "HexNAc"})


@query("J19_align_motifs")
def j19(t):
    """All different trees as motifs on all trees; of every sixth the last residue hangs loose, of every tenth the last two."""
    k, n = F.col("acc"), F.size("residues")
    held = F.when(k % 10 == 7, n - 2).when(k % 6 == 0, n - 1).otherwise(n)
    fields = ("rid", "symbol", "anomer", "pos")
    loose = F.transform("residues", lambda r: F.struct(*(r[c].alias(c) for c in fields), F.when(r["rid"] <= held, r["parent"]).alias("parent"), F.when(r["rid"] > held, F.sequence(F.lit(1), held)).alias("maybe")))
    mass = F.aggregate("residues", F.lit(0.0), lambda m, r: m + F.when(r["symbol"] == "GlcNAc", 203.0794).otherwise(162.0528))
    facts = [(k % 5 == 0).cast("int").alias("n_subst"), mass.alias("mass"), (k % 17 == 0).alias("repeated")]
    whole = trees(t).select("acc", "residues", *facts)
    different = whole.groupBy("residues").agg(F.min_by(F.struct("acc", "n_subst", "mass", "repeated"), "acc").alias("m")).select("m.*", "residues")
    return motifs.align_motifs(different, whole.select("acc", loose.alias("residues"), "n_subst", "mass", "repeated"))


@query("U2_structure_tests", f"WITH {RESIDUES_SQL}, k AS (SELECT r.acc, r.rid, count(c.rid) AS k FROM r LEFT JOIN r c ON c.acc = r.acc AND c.parent = r.rid GROUP BY 1, 2) SELECT acc, count(*) FILTER (k > 1) AS n_branches, count(*) FILTER (k = 0) AS n_leaves, count(*) FILTER (k > 1) > 0 AS branched FROM k GROUP BY 1")
def u2(t):
    return s.structure_tests(residues(t))


DOWN_SQL = "{d} AS (SELECT acc, rid AS top, rid AS node FROM {r} UNION ALL SELECT {d}.acc, {d}.top, {r}.rid FROM {d} JOIN {r} ON {r}.acc = {d}.acc AND {r}.parent = {d}.node)"


@query(
    "U4_trim_leaves",
    f"""WITH RECURSIVE {RESIDUES_SQL}, {DOWN_SQL.format(d="d", r="r")}, gone AS (SELECT d.acc, d.top FROM d JOIN r ON r.acc = d.acc AND r.rid = d.node WHERE d.top > 1 GROUP BY ALL HAVING bool_and(r.symbol IN ('Gal', 'Man'))),
n AS (SELECT r.acc, count(g.top) AS n, coalesce(string_agg(g.top::VARCHAR, ',' ORDER BY g.top), '') AS removed FROM r LEFT JOIN gone g ON g.acc = r.acc AND g.top = r.rid GROUP BY 1)
SELECT acc || CASE WHEN n > 0 THEN 't' || n ELSE '' END AS acc, removed, n::INTEGER AS n_removed FROM n""",
)
def u4(t):
    return s.trim_leaves(trees(t), ["Gal", "Man"]).select("acc", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"), "n_removed")


#: Galactose on GlcNAc goes once, unless a mannose beside it protects it; then mannose goes until none is a leaf.
ENZYMES = [{"symbol": "Gal", "parent": "GlcNAc", "protectors": ["Man"], "once": True, "suffix": "G"}, {"symbol": "Man", "suffix": "M"}]


@query(
    "U4_digest",
    f"""WITH RECURSIVE {RESIDUES_SQL}, one AS (SELECT c.acc, c.rid FROM r c JOIN r p ON p.acc = c.acc AND p.rid = c.parent WHERE c.symbol = 'Gal' AND p.symbol = 'GlcNAc'
AND NOT EXISTS (FROM r k WHERE k.acc = c.acc AND k.parent = c.rid) AND NOT EXISTS (FROM r k WHERE k.acc = c.acc AND k.parent = c.parent AND k.symbol = 'Man')),
rest AS (FROM r ANTI JOIN one USING (acc, rid)), {DOWN_SQL.format(d="d", r="rest")}, two AS (SELECT d.acc, d.top AS rid FROM d JOIN rest ON rest.acc = d.acc AND rest.rid = d.node WHERE d.top > 1 GROUP BY ALL HAVING bool_and(rest.symbol = 'Man')),
n AS (SELECT r.acc, count(one.rid) AS g, count(two.rid) AS m, coalesce(string_agg(r.rid::VARCHAR, ',' ORDER BY r.rid) FILTER (one.rid IS NULL AND two.rid IS NULL), '') AS kept FROM r LEFT JOIN one USING (acc, rid) LEFT JOIN two USING (acc, rid) GROUP BY 1)
SELECT acc || CASE WHEN g > 0 THEN '-G' || g ELSE '' END || CASE WHEN m > 0 THEN '-M' || m ELSE '' END AS acc, g::INTEGER AS n_gal, m::INTEGER AS n_man, kept FROM n""",
)
def u4_digest(t):
    found = s.digest(trees(t), ENZYMES)
    return found.select("acc", F.col("counts")[0].alias("n_gal"), F.col("counts")[1].alias("n_man"), F.array_join(F.transform("residues", lambda r: r["rid"].cast("string")), ",").alias("kept"))


@query(
    "U5_fragment_ions",
    f"""WITH RECURSIVE {RESIDUES_SQL}, m AS (SELECT *, CASE WHEN symbol = 'GlcNAc' THEN 203.0794::DOUBLE ELSE 162.0528::DOUBLE END AS mass FROM r), d AS (SELECT acc, rid AS top, rid AS node FROM r UNION ALL SELECT d.acc, d.top, r.rid FROM d JOIN r ON r.acc = d.acc AND r.parent = d.node),
w AS (SELECT acc, sum(mass) AS total FROM m GROUP BY 1) SELECT d.acc, d.top AS rid, count(*) AS n, round(sum(m.mass), 3) AS mass, round(any_value(total) - sum(m.mass), 3) AS rest FROM d JOIN m ON m.acc = d.acc AND m.rid = d.node JOIN w ON w.acc = d.acc WHERE d.top > 1 GROUP BY 1, 2""",
)
def u5(t):
    ions = s.fragment_ions(residues(t), t.spark.createDataFrame(MASSES, "symbol string, mass double"))
    return ions.select("acc", "rid", "n", F.round("mass", 3).alias("mass"), F.round("rest", 3).alias("rest"))


@query("U6_all_fragments")
def u6(t):
    return s.all_fragments(trees(t))


RULES = [
    {"id": "n-linked", "type": "N-linked", "motifs": ["M1", "M2"], "exceptions": ["M9"]},
    {"id": "hybrid", "type": "N-linked", "subtype": "hybrid", "motifs": ["M3"], "exceptions": ["complex"]},
    {"id": "complex", "type": "N-linked", "subtype": "complex", "motifs": ["M4"], "exceptions": [], "test": "n > 3"},
]


@query(
    "U1_classify",
    """WITH h AS (SELECT l_orderkey AS acc, list(DISTINCT 'M' || (l_suppkey % 10)) AS m, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT acc, list_has_any(m, ['M1', 'M2']) AND NOT list_contains(m, 'M9') AS a, list_contains(m, 'M3') AS b, list_contains(m, 'M4') AND n > 3 AS c FROM h)
SELECT acc, 'n-linked' AS rule, 'N-linked' AS type, '-' AS subtype FROM t WHERE a UNION ALL SELECT acc, 'hybrid', 'N-linked', 'hybrid' FROM t WHERE b AND NOT c UNION ALL SELECT acc, 'complex', 'N-linked', 'complex' FROM t WHERE c""",
)
def u1(t):
    hits = t.lineitem.groupBy(F.col("l_orderkey").alias("acc")).agg(F.collect_set(F.concat(F.lit("M"), text(F.col("l_suppkey") % 10))).alias("motifs"), F.count("*").alias("n"))
    return s.classify(hits, RULES).withColumn("subtype", F.coalesce("subtype", F.lit("-")))


@query("G22_cluster_navigator", "SELECT p_partkey AS cluster, p_partkey + d AS other, CAST((p_partkey + d) % 4 - p_partkey % 4 AS BIGINT) AS step FROM part, (VALUES (1), (5), (6)) v(d) WHERE p_partkey + d <= (SELECT max(p_partkey) FROM part) AND abs((p_partkey + d) % 4 - p_partkey % 4) <= 1")
def g22(t):
    k = F.col("p_partkey")
    lengths = t.part.select(k.alias("cluster"), (k % 4).alias("n"))
    return s.cluster_navigator(lengths, t.part.select(k.alias("cluster"), F.explode(F.array(k + 1, k + 5, k + 6)).alias("other")))


@query(
    "G23_representatives",
    """WITH o AS (SELECT p_partkey AS acc, p_size || '.000' AS g, substr(p_name, 1, 3 + p_partkey % 4) AS code FROM part), l AS (SELECT g, code, min(acc) AS rep FROM o GROUP BY 1, 2),
b AS (SELECT x.g, x.code, arg_min(y.rep, {'l': -length(y.code), 'r': y.rep}) AS t FROM l x JOIN l y ON x.g = y.g AND x.code <> y.code AND contains(y.code, x.code) GROUP BY 1, 2),
r AS (SELECT l.g, l.code, coalesce(t, rep) AS representative FROM l LEFT JOIN b USING (g, code)), n AS (SELECT g, representative, row_number() OVER (PARTITION BY g ORDER BY representative) AS i FROM (SELECT DISTINCT g, representative FROM r))
SELECT acc, representative, g || '.' || i AS label FROM o JOIN r USING (g, code) JOIN n USING (g, representative)""",
)
def g23(t):
    k = F.col("p_partkey")
    return s.representatives(t.part.select(k.alias("acc"), F.col("p_size").cast("double").alias("mass"), F.substr("p_name", F.lit(1), (F.lit(3) + k % 4).cast("int")).alias("code")))


@query(
    "U3_missing_score",
    """WITH r AS (SELECT l_orderkey AS acc, l_linenumber AS rid, l_linenumber = 1 AS root, CASE WHEN l_suppkey % 3 = 0 THEN 2.0 ELSE 0.0 END + CASE WHEN l_suppkey % 4 = 0 THEN 1.0 ELSE 0.0 END + CASE WHEN l_partkey % 5 = 0 THEN 1.0 ELSE 0.0 END + CASE WHEN l_partkey % 2 = 0 THEN 2.0 ELSE 0.0 END AS own,
CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS simple, l_partkey % 11 > 0 AS linked, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)),
l AS (SELECT acc, count(*) AS k, sum(CASE WHEN rid % 3 = 0 THEN 5 ELSE 0.65 / 2 * (simple / 8 * 10) + 5 * (1 - 0.65) * (rid % 3 - 1) / n END) AS loose FROM r WHERE rid <= 4 AND own <> 2 GROUP BY 1),
s AS (SELECT acc, n, sum(own / 8 * 10) AS own, sum(CASE WHEN root THEN 0 WHEN NOT linked THEN 10 ELSE 0.65 * (simple / 8 * 10) END) AS link FROM r GROUP BY 1, 2)
SELECT acc, CAST(floor(10000 * (own / (10.0 * n) * (0.65 / 1.65) + (link + coalesce(loose, 0)) / CASE WHEN n > 1 OR k > 0 THEN 10.0 * (n - 1) + 5 * coalesce(k, 0) ELSE 10 END * (1 - 0.65 / 1.65)) + 1e-9) AS INTEGER) AS score FROM s LEFT JOIN l USING (acc)""",
)
def u3(t):
    one = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m")).select("l_orderkey", "l_linenumber", "m.*")
    p, q, none = F.col("l_partkey"), F.col("l_suppkey"), F.lit(None)
    rows = one.select(
        F.col("l_orderkey").alias("acc"), F.col("l_linenumber").alias("rid"), (F.col("l_linenumber") == 1).alias("is_root"), F.when(q % 3 > 0, "a").alias("anomer"),
        F.array(F.when(q % 4 > 0, "d"), F.lit("d")).alias("config"), F.when(p % 5 > 0, 1).alias("ring_start"), F.lit(5).alias("ring_end"), F.array(F.when(p % 2 > 0, "gal")).alias("stem"), none.cast("array<array<int>>").alias("substituent_pos"),
    )
    links = one.where("l_linenumber > 1 and l_partkey % 11 > 0").select(
        F.col("l_orderkey").alias("acc"), F.col("l_linenumber").alias("child"), F.when(p % 3 > 0, F.array(F.lit(4))).alias("parent_pos"), F.when(p % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("child_pos"),
        F.array(F.lit("o")).alias("parent_type"), F.array(F.lit("d")).alias("child_type"),
    )
    # A substituent on each of the first residues, with 0 to 2 possible parents; those on a residue that lacks 2 are anhydro.
    lacks = F.when(q % 3 == 0, 2).otherwise(0) + F.when(q % 4 == 0, 1).otherwise(0) + F.when(p % 5 == 0, 1).otherwise(0) + F.when(p % 2 == 0, 2).otherwise(0)
    parents = (F.col("l_linenumber") % 3).cast("int")
    loose = one.where("l_linenumber <= 4").select(
        F.col("l_orderkey").alias("acc"), F.col("l_linenumber").alias("sid"), F.when(lacks == 2, "anhydro").otherwise("sulfate").alias("name"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), parents))).alias("i"), (parents > 0).alias("linked"),
        F.when(p % 3 > 0, F.array(F.lit(4))).alias("parent_pos"), F.when(p % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("child_pos"), F.array(F.lit("o")).alias("parent_type"), F.array(F.lit("d")).alias("child_type"),
    )
    return s.missing_score(rows, links, loose)


@query(
    "J20_supporting_residues",
    f"""WITH RECURSIVE {RESIDUES_SQL}, m AS (SELECT acc % 5 AS motif, acc AS structure, CASE WHEN acc % 2 = 0 THEN 'core' ELSE 'substructure' END AS type, 1 + rid % 2 AS idx, rid * 10 AS motif_rid, rid FROM r WHERE (acc + rid) % 3 = 0),
up AS (SELECT acc, rid AS id, parent AS at FROM r WHERE parent IS NOT NULL UNION ALL SELECT up.acc, up.id, r.parent FROM up JOIN r ON r.acc = up.acc AND r.rid = up.at WHERE r.parent IS NOT NULL),
s AS (SELECT DISTINCT motif, structure, type, idx, up.at AS rid FROM m JOIN up ON up.acc = structure AND up.id = m.rid), every AS (FROM m UNION ALL BY NAME (FROM s ANTI JOIN m USING (motif, structure, type, idx, rid))),
e AS (SELECT acc AS structure, rid, 'N' || rid AS node_id, CASE WHEN (acc + 2 * rid) % 5 > 0 THEN 'G' || (acc * rid) % 30 END AS gene, CASE WHEN (acc + rid) % 4 > 1 THEN 'human' ELSE 'mouse' END AS species FROM r WHERE (acc * rid) % 7 > 0),
n AS (SELECT structure, rid, node_id, coalesce(string_agg(DISTINCT gene, ',' ORDER BY gene) FILTER (species = 'human'), '-') AS human, coalesce(string_agg(DISTINCT gene, ',' ORDER BY gene) FILTER (species = 'mouse'), '-') AS mouse FROM e GROUP BY 1, 2, 3)
SELECT motif, coalesce(motif_rid, -1) AS motif_rid, structure, rid, type, idx, node_id, human, mouse FROM every JOIN n USING (structure, rid)""",
)
def j20_support(t):
    r, k, i = residues(t), F.col("acc"), F.col("rid")
    matches = r.where("(acc + rid) % 3 = 0").select((k % 5).alias("motif"), (i * 10).alias("motif_rid"), k.alias("structure"), "rid", F.when(k % 2 == 0, "core").otherwise("substructure").alias("type"), (1 + i % 2).alias("idx"))
    enzymes = r.where("(acc * rid) % 7 > 0").select(
        "acc", "rid", F.concat(F.lit("N"), text("rid")).alias("node_id"), F.when((k + i) % 4 > 1, "human").otherwise("mouse").alias("species"),
        F.concat(F.lit("G"), text(k * i % 30)).alias("gene"), F.when((k + 2 * i) % 5 > 0, 0).otherwise(1).alias("violations"),
    )
    found = joins.enzyme_alignments(matches, r, enzymes, {"human": "human", "mouse": "mouse"})
    return found.withColumn("motif_rid", F.coalesce("motif_rid", F.lit(-1)))


CORES_SQL = """r AS (SELECT k AS acc, i AS rid, CASE i WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN CASE WHEN k % 6 = 0 THEN 4 ELSE 3 END WHEN 6 THEN CASE WHEN k % 2 = 0 THEN 1 ELSE 4 END END AS parent,
CASE WHEN i < 3 THEN CASE WHEN k % 5 = 1 THEN 'HexNAc' ELSE 'GlcNAc' END WHEN i = 6 THEN ['Fuc', 'Gal', 'NeuAc'][1 + k % 3] WHEN i = 5 AND k % 7 = 0 THEN 'Gal' ELSE 'Man' END AS symbol,
CASE WHEN i = 2 AND k % 11 > 0 OR i = 3 AND k % 4 > 0 THEN 'b' WHEN i = 2 OR i = 4 OR i = 6 THEN 'a' END AS anomer, CASE i WHEN 2 THEN 4 WHEN 3 THEN CASE WHEN k % 13 = 0 THEN 3 ELSE 4 END WHEN 4 THEN 3 WHEN 5 THEN CASE WHEN k % 9 = 0 THEN 3 WHEN k % 8 > 0 THEN 6 END END AS pos,
CASE WHEN i = 1 AND k % 10 = 0 THEN 1 ELSE 0 END AS loose, CASE WHEN k % 4 = 1 AND i > 2 + k % 2 THEN 1 WHEN k % 4 = 2 AND i > 2 THEN i % 2 END AS repeat FROM (SELECT p_partkey AS k FROM part), range(1, 7) t(i))"""
#: Named tests, which rules of `classify` can use as columns.
RULE_TESTS = lambda: {
    "n_core": s.rooted(s.N_CORE), "core_gal": s.accepted_core(["GlcNAc"]), "bare_core": s.accepted_core(["GlcNAc", "Gal"], bare=True), "two_kids": s.accepted_core(["GlcNAc", "HexNAc", "Fuc", "Gal", "NeuAc"], bare=True, kids=2),
    "n_man": s.symbol_count(["Man"]), "gal_is_leaf": s.only_leaves(["Gal"]), "no_branch": s.no_branch(), "no_other_branch": s.no_branch(["Fuc"]), "even_repeats": s.even_repeats(),
}


@query(
    "U2_core_tests",
    f"""WITH {CORES_SQL},
arms AS (SELECT acc, parent AS rid FROM r WHERE parent IS NOT NULL AND symbol IN ('Man', 'Hex') AND coalesce(anomer, '') <> 'b' GROUP BY 1, 2 HAVING count(*) FILTER (coalesce(pos, 3) = 3) >= 1 AND count(*) FILTER (coalesce(pos, 6) = 6) >= 1 AND count(*) FILTER (pos IS NULL OR pos IN (3, 6)) >= 2),
cores AS (SELECT DISTINCT a.acc FROM r a JOIN r b ON b.acc = a.acc AND b.parent = a.rid JOIN r m ON m.acc = a.acc AND m.parent = b.rid JOIN arms ON arms.acc = a.acc AND arms.rid = m.rid WHERE a.parent IS NULL AND a.symbol IN ('GlcNAc', 'HexNAc') AND b.symbol IN ('GlcNAc', 'HexNAc')
AND coalesce(b.anomer, '') <> 'a' AND coalesce(b.pos, 4) = 4 AND m.symbol IN ('Man', 'Hex') AND coalesce(m.anomer, '') <> 'a' AND coalesce(m.pos, 4) = 4),
tops AS (SELECT c.acc, bool_and(c.symbol IN ('GlcNAc', 'Fuc', 'NeuAc', 'NeuGc')) AS core_gal, bool_and(c.symbol IN ('GlcNAc', 'Gal')) AND max(p.loose) = 0 AS bare_core, bool_and(c.symbol IN ('GlcNAc', 'HexNAc', 'Fuc', 'Gal', 'NeuAc')) AND max(p.loose) = 0 AND count(*) = 2 AS two_kids FROM r p JOIN r c ON c.acc = p.acc AND c.parent = p.rid WHERE p.parent IS NULL GROUP BY 1),
ways AS (SELECT p.acc, p.rid, p.symbol, count(c.rid) AS n, count(c.rid) FILTER (c.symbol <> 'Fuc') AS others FROM r p LEFT JOIN r c ON c.acc = p.acc AND c.parent = p.rid GROUP BY 1, 2, 3),
w AS (SELECT acc, count(*) FILTER (symbol = 'Man')::INTEGER AS n_man, count(*) FILTER (symbol = 'Gal' AND n > 0) = 0 AS gal_is_leaf, max(n) < 2 AS no_branch, max(others) < 2 AS no_other_branch FROM ways GROUP BY 1),
u AS (SELECT acc, bool_and(n % 2 = 0) AS even FROM (SELECT acc, repeat, count(*) AS n FROM r WHERE repeat IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT acc, acc IN (FROM cores) AS n_core, core_gal, bare_core, two_kids, n_man, gal_is_leaf, no_branch, no_other_branch, coalesce(even, true) AS even_repeats FROM tops JOIN w USING (acc) LEFT JOIN u USING (acc)""",
)
def u2_cores(t):
    k, i = F.col("acc"), F.col("rid")
    rows = t.part.select(F.col("p_partkey").alias("acc"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rid"))
    case = lambda *pairs: reduce(lambda so_far, p: so_far.when(p[0], p[1]), pairs[1:], F.when(*pairs[0]))
    rows = rows.select(
        k, i, case((i == 2, 1), (i == 3, 2), (i == 4, 3), ((i == 5) & (k % 6 == 0), 4), (i == 5, 3), ((i == 6) & (k % 2 == 0), 1), (i == 6, 4)).alias("parent"),
        case(((i < 3) & (k % 5 == 1), "HexNAc"), (i < 3, "GlcNAc"), (i == 6, F.get(F.array(*map(F.lit, ("Fuc", "Gal", "NeuAc"))), (k % 3).cast("int"))), ((i == 5) & (k % 7 == 0), "Gal")).otherwise("Man").alias("symbol"),
        case(((i == 2) & (k % 11 > 0) | (i == 3) & (k % 4 > 0), "b"), (i.isin(2, 4, 6), "a")).alias("anomer"),
        case((i == 2, 4), ((i == 3) & (k % 13 == 0), 3), (i == 3, 4), (i == 4, 3), ((i == 5) & (k % 9 == 0), 3), ((i == 5) & (k % 8 > 0), 6)).alias("pos"),
        F.when((i == 1) & (k % 10 == 0), 1).otherwise(0).alias("loose"), case(((k % 4 == 1) & (i > 2 + k % 2), F.lit(1)), ((k % 4 == 2) & (i > 2), i % 2)).alias("repeat"),
    )
    gathered = rows.groupBy("acc").agg(F.array_sort(F.collect_list(F.struct("rid", "parent", "symbol", "anomer", "pos", "loose", "repeat"))).alias("residues"))
    return gathered.select("acc", *(test.alias(name) for name, test in RULE_TESTS().items()))
