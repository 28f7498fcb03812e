"""Queries on trees over part, supplier and customer keys: the parent of a key is the key halved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import hierarchy as h
from ..operators.components import connected_components
from .registry import Tables, query


def acc(key: Column, prefix: str = "P") -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def half(c: str, by: int = 2) -> Column:
    return F.floor(F.col(c) / by)


EDGES_SQL = "e AS (SELECT 'P' || (p_partkey // 2) AS parent, 'P' || p_partkey AS child, CASE WHEN p_partkey % 3 = 0 THEN '+aldi' ELSE 'subsumed' END AS kind FROM part WHERE p_partkey > 0)"
CLOSURE_SQL = f"WITH RECURSIVE {EDGES_SQL}, c AS (SELECT parent AS ancestor, child AS descendant FROM e UNION SELECT c.ancestor, e.child FROM c JOIN e ON e.parent = c.descendant)"


def edges(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 3 == 0, "+aldi").otherwise("subsumed")
    return t.part.where("p_partkey > 0").select(acc(half("p_partkey")).alias("parent"), acc(F.col("p_partkey")).alias("child"), kind.alias("kind"))


def closure(t: Tables) -> DataFrame:
    return h.transitive_closure(edges(t))


def nodes(t: Tables) -> DataFrame:
    level = F.when(F.col("p_partkey") % 3 == 1, "Topology").when(F.col("p_partkey") % 3 == 2, "Saccharide")
    return t.part.select(acc(F.col("p_partkey")).alias("acc"), F.when(F.col("p_partkey") >= 4, acc(half("p_partkey", 4))).alias("topo"), level.alias("level"), "p_partkey", "p_size")


@query("G1_edges_of_kind", f"WITH {EDGES_SQL} SELECT child AS acc, parent AS other, 'parent' AS what FROM e WHERE kind = '+aldi' UNION ALL SELECT parent, child, 'child' FROM e")
def g1(t):
    return h.parents(edges(t), "+aldi").withColumn("what", F.lit("parent")).unionByName(h.children(edges(t)).withColumn("what", F.lit("child")))


@query(
    "G2_add_mass_roots",
    f"""WITH {EDGES_SQL}, k AS (SELECT parent, child FROM e WHERE CAST(substr(child, 2) AS BIGINT) % 5 <> 0),
n AS (SELECT 'P' || p_partkey AS acc, p_size AS b FROM part), m AS (SELECT 'mass:' || b AS parent, acc AS child FROM n WHERE acc NOT IN (SELECT child FROM k))
SELECT * FROM k UNION ALL SELECT * FROM m UNION ALL SELECT DISTINCT 'root', parent FROM m""",
)
def g2(t):
    n = nodes(t).select("acc", F.col("p_size").cast("string").alias("bucket"))
    return h.add_mass_roots(n, edges(t).where("cast(substring(child, 2) as long) % 5 <> 0"))


@query("G3_transitive_closure", f"{CLOSURE_SQL} SELECT * FROM c")
def g3(t):
    return closure(t)


@query("G4_transitive_reduction", f"{CLOSURE_SQL} SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c a JOIN c b ON a.descendant = b.ancestor WHERE a.ancestor = c.ancestor AND b.descendant = c.descendant)")
def g4(t):
    """The edges and the ways from grandparents, of which the latter go."""
    e = edges(t).select("parent", "child")
    far = e.alias("a").join(e.alias("b"), F.col("a.child") == F.col("b.parent")).select("a.parent", "b.child")
    return h.transitive_reduction(closure(t), e.unionByName(far))


RESTRICTED_SQL = """m AS (SELECT DISTINCT unnest(['P' || p_partkey, CASE WHEN p_partkey >= 4 THEN 'P' || (p_partkey // 4) END]) AS acc FROM part WHERE p_partkey % 7 = 0 UNION SELECT 'P0' UNION SELECT ancestor FROM s WHERE CAST(substr(descendant, 2) AS BIGINT) % 7 = 0 AND CAST(substr(ancestor, 2) AS BIGINT) % 3 = 1 AND ancestor IN (SELECT 'P' || p_partkey FROM part)),
ks AS (FROM s WHERE ancestor IN (FROM m) AND descendant IN (FROM m)), kc AS (FROM c WHERE ancestor IN (FROM m) AND descendant IN (FROM m)),
rs AS (FROM ks WHERE (ancestor, descendant) NOT IN (SELECT (x.ancestor, y.descendant) FROM ks x JOIN ks y ON x.descendant = y.ancestor)),
rc AS (FROM kc WHERE (ancestor, descendant) NOT IN (SELECT (x.ancestor, y.descendant) FROM kc x JOIN kc y ON x.descendant = y.ancestor))"""


@query(
    "G5_restrict_graph",
    f"""{CLOSURE_SQL}, s AS (SELECT parent AS ancestor, child AS descendant FROM e WHERE kind = 'subsumed' UNION SELECT s.ancestor, e.child FROM s JOIN e ON e.parent = s.descendant AND e.kind = 'subsumed'), {RESTRICTED_SQL}
SELECT ancestor AS parent, descendant AS child, 'subsumed' AS kind FROM rs UNION ALL SELECT *, 'other' FROM (FROM rc EXCEPT FROM rs)""",
)
def g5(t):
    return h.restrict_graph(nodes(t), edges(t), nodes(t).where("p_partkey % 7 = 0"), ["topo"], root="P0", levels=("Topology",))


@query("G6_leaf_root_flags", f"WITH {EDGES_SQL} SELECT 'P' || p_partkey AS acc, 'P' || p_partkey NOT IN (SELECT parent FROM e) AS is_leaf, 'P' || p_partkey NOT IN (SELECT child FROM e) AS is_root FROM part")
def g6(t):
    return h.leaf_root_flags(nodes(t), edges(t))


@query("G7_landmark_members", "SELECT 'P' || (p_partkey // 4) AS acc, 'P' || p_partkey AS member FROM part WHERE p_partkey >= 4")
def g7(t):
    return h.landmark_members(nodes(t), closure(t), "topo")


@query(
    "G8_infer_level",
    """WITH f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN 'Saccharide' WHEN p_size % 2 = 0 THEN 'Topology' WHEN p_size % 5 = 0 AND p_size % 3 = 0 THEN 'Topology'
WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'Composition' ELSE 'BaseComposition' END AS own, CASE WHEN p_partkey % 17 = 0 THEN 'Topology' END AS given FROM part)
SELECT 'P' || k AS acc, coalesce(given, own) AS level, given IS NULL AS inferred, coalesce(given <> own, false) AS conflict FROM f""",
)
def g8(t):
    k = F.col("p_partkey")
    flags = t.part.select(
        acc(k).alias("acc"), (k % 11 == 0).alias("anomer"), (k % 13 == 0).alias("position"), (F.col("p_size") % 2 == 0).alias("link"), (F.col("p_size") % 3 == 0).alias("ring"),
        (F.col("p_size") % 5 == 0).alias("single"), F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3").alias("stem"),
    )
    return h.infer_level(flags, t.part.where(k % 17 == 0).select(acc(k).alias("acc"), F.lit("Topology").alias("level")))


@query("G9_pick_landmark", "SELECT 'P' || p_partkey AS acc, CASE WHEN p_partkey % 3 = 0 THEN 'P' || (p_partkey // 4) ELSE 'P' || p_partkey END AS landmark FROM part WHERE p_partkey >= 8")
def g9(t):
    own = t.part.where("p_partkey >= 8")
    marks = own.select(acc(F.col("p_partkey")).alias("acc"), F.explode(F.array(acc(F.col("p_partkey")), acc(half("p_partkey")), acc(half("p_partkey", 4)))).alias("landmark"))
    given = own.where("p_partkey % 3 = 0").select(acc(F.col("p_partkey")).alias("acc"), acc(half("p_partkey", 4)).alias("landmark"))
    return h.pick_landmark(marks, given, closure(t))


@query(
    "G10_compose_levels",
    """WITH t AS (SELECT 'S' || s_suppkey AS acc, 'T' || (s_suppkey // 2) AS topology FROM supplier), c AS (SELECT DISTINCT 'T' || (s_suppkey // 2) AS topology, 'C' || (s_suppkey // 6) AS composition FROM supplier),
b AS (SELECT DISTINCT 'C' || (s_suppkey // 6) AS composition, 'B' || (s_suppkey // 12) AS base_composition FROM supplier)
SELECT acc, topology, composition, base_composition FROM t LEFT JOIN c USING (topology) LEFT JOIN b USING (composition)
UNION SELECT topology, topology, composition, base_composition FROM c LEFT JOIN b USING (composition)
UNION SELECT composition, NULL, composition, base_composition FROM b UNION SELECT base_composition, NULL, NULL, base_composition FROM b""",
)
def g10(t):
    level = lambda name, by, up, up_by: t.supplier.select(acc(half("s_suppkey", by), name).alias("acc"), acc(half("s_suppkey", up_by), up).alias("up")).distinct()
    return h.compose_levels(level("S", 1, "T", 2), level("T", 2, "C", 6), level("C", 6, "B", 12))


@query(
    "G11_subsumption_export",
    f"""{CLOSURE_SQL}, n AS (SELECT 'P' || p_partkey AS acc, ['BaseComposition', 'Composition', 'Topology', 'Saccharide'][1 + p_partkey % 4] AS level, 'P' || (p_partkey // 4) AS topo, 'P' || (p_partkey // 8) AS comp, 'P' || (p_partkey // 16) AS bcomp,
CASE WHEN p_partkey % 9 > 0 THEN p_partkey % 5 * 100 END AS missing, p_partkey % 5 < 3 AS listed FROM part), l AS (SELECT acc FROM n WHERE listed),
d AS (SELECT c.ancestor AS acc, a.level AS mine, x.acc AS value, x.* EXCLUDE (acc) FROM c JOIN n x ON x.acc = c.descendant LEFT JOIN n a ON a.acc = c.ancestor),
x AS (SELECT acc, 'Level' AS property, level AS value FROM n UNION ALL SELECT acc, 'MissingScore', missing::VARCHAR FROM n
UNION ALL SELECT acc, 'BaseComposition', CASE WHEN level = 'BaseComposition' THEN acc ELSE bcomp END FROM n UNION ALL SELECT acc, 'Composition', CASE level WHEN 'Composition' THEN acc WHEN 'BaseComposition' THEN NULL ELSE comp END FROM n
UNION ALL SELECT acc, 'Topology', CASE level WHEN 'Topology' THEN acc WHEN 'Saccharide' THEN topo END FROM n
UNION ALL SELECT parent, 'Subsumes', child FROM e WHERE child IN (FROM l) UNION ALL SELECT child, 'SubsumedBy', parent FROM e WHERE parent IN (FROM l) UNION ALL SELECT descendant, 'Ancestor', ancestor FROM c WHERE ancestor IN (FROM l)
UNION ALL SELECT acc, 'Descendant', value FROM d WHERE listed UNION ALL SELECT acc, 'Leaf', value FROM d WHERE listed AND value NOT IN (SELECT parent FROM e) UNION ALL SELECT acc, 'FullyDetermined', value FROM d WHERE listed AND missing = 0
UNION ALL SELECT acc, 'Compositions', value FROM d WHERE mine = 'BaseComposition' AND level = 'Composition' AND bcomp = acc AND listed
UNION ALL SELECT acc, 'Topologies', value FROM d WHERE level = 'Topology' AND (mine = 'BaseComposition' AND bcomp = acc AND listed OR mine = 'Composition' AND comp = acc)
UNION ALL SELECT acc, 'Saccharides', value FROM d WHERE level = 'Saccharide' AND (mine = 'BaseComposition' AND bcomp = acc AND listed OR mine = 'Composition' AND comp = acc OR mine = 'Topology' AND topo = acc))
SELECT DISTINCT * FROM x WHERE value IS NOT NULL AND acc IN (FROM l)""",
)
def g11(t):
    k = F.col("p_partkey")
    levels = F.get(F.array(*map(F.lit, ("BaseComposition", "Composition", "Topology", "Saccharide"))), (k % 4).cast("int"))
    rows = t.part.select(acc(k).alias("acc"), levels.alias("level"), *(acc(half("p_partkey", by)).alias(c) for c, by in (("topo", 4), ("comp", 8), ("bcomp", 16))), F.when(k % 9 > 0, k % 5 * 100).alias("missing"), k)
    return h.subsumption_export(rows, edges(t), closure(t), rows.where("p_partkey % 5 < 3"))


TAXA_SQL = """d AS (SELECT c_custkey AS acc, r_name AS species, c_mktsegment AS source, c_custkey % 7 AS sourceid, c_nationkey AS taxid FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE NOT (c_custkey % 50 = 0 AND r_name = 'ASIA'))"""


def evidence(t: Tables) -> DataFrame:
    taxa = t.customer.select(F.col("c_custkey").alias("acc"), F.col("c_nationkey").alias("taxid"), F.col("c_mktsegment").alias("source"), (F.col("c_custkey") % 7).cast("string").alias("sourceid"))
    groups = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("taxid"), F.col("r_name").alias("species"))
    blocked = t.customer.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("acc"), F.lit("ASIA").alias("species"))
    return h.species_evidence(taxa, groups, blocked)


@query("G12_species_evidence", f"WITH {TAXA_SQL} SELECT acc, species, source || ':' || sourceid || ':' || taxid AS evidence FROM d")
def g12(t):
    return evidence(t)


@query("G14_species_expanded", f"WITH {TAXA_SQL} SELECT acc, species, source, CAST(sourceid AS VARCHAR) AS sourceid, taxid FROM d")
def g14(t):
    return h.species_expanded(evidence(t))


CUSTOMERS_SQL = """WITH RECURSIVE e AS (SELECT c_custkey // 2 AS parent, c_custkey AS child FROM customer WHERE c_custkey > 0),
c AS (SELECT parent AS ancestor, child AS descendant FROM e UNION SELECT c.ancestor, e.child FROM c JOIN e ON e.parent = c.descendant)"""


def customer_closure(t: Tables) -> DataFrame:
    return h.transitive_closure(t.customer.where("c_custkey > 0").select(half("c_custkey").alias("parent"), F.col("c_custkey").alias("child")))


@query(
    "G13_propagate_species",
    f"""{CUSTOMERS_SQL}, d AS (SELECT c_custkey AS acc, c_nationkey % 4 AS species FROM customer WHERE c_custkey % 3 = 0), m AS (SELECT c_custkey AS acc, c_custkey // 8 AS comp FROM customer),
a AS (SELECT acc, species, 1 AS r FROM d UNION ALL SELECT ancestor, species, 2 FROM d JOIN c ON acc = descendant UNION ALL SELECT m2.acc, species, 3 FROM d JOIN m USING (acc) JOIN m m2 ON m.comp = m2.comp)
SELECT acc, species, CASE min(r) WHEN 1 THEN 'Direct' WHEN 2 THEN 'Subsumption' ELSE 'Composition' END AS kind FROM a GROUP BY 1, 2""",
)
def g13(t):
    direct = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("acc"), (F.col("c_nationkey") % 4).alias("species"))
    return h.propagate_species(direct, customer_closure(t), t.customer.select(F.col("c_custkey").alias("acc"), half("c_custkey", 8).alias("comp")))


@query(
    "G15_propagate_tissue",
    f"""{CUSTOMERS_SQL}, d AS (SELECT c_custkey AS acc, c_nationkey % 3 AS taxid, c_mktsegment AS tissue FROM customer WHERE c_custkey % 4 = 0),
a AS (SELECT acc, taxid, tissue, 1 AS r FROM d UNION ALL SELECT ancestor, taxid, tissue, 0 FROM d JOIN c ON acc = descendant) SELECT acc, taxid, tissue, max(r) = 1 AS direct FROM a GROUP BY 1, 2, 3""",
)
def g15(t):
    direct = t.customer.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("acc"), (F.col("c_nationkey") % 3).alias("taxid"), F.col("c_mktsegment").alias("tissue"))
    return h.propagate_tissue(direct, customer_closure(t))


CLASSES_SQL = f"""{CUSTOMERS_SQL}, d AS (SELECT c_custkey AS acc, c_mktsegment AS type, CASE WHEN c_nationkey % 2 = 1 THEN 'n' || c_nationkey END AS subtype FROM customer WHERE c_custkey % 4 = 0),
a AS (SELECT acc, type, subtype, 1 AS r FROM d UNION ALL SELECT ancestor, type, subtype, 0 FROM d JOIN c ON acc = descendant),
g AS (SELECT acc, type, subtype, max(r) AS r FROM a GROUP BY 1, 2, 3), n AS (SELECT *, max(CASE WHEN subtype IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY acc, type) AS named FROM g)"""


@query("G16_propagate_classes", f"{CLASSES_SQL}, k AS (SELECT acc, type, subtype, r, max(r) OVER (PARTITION BY acc, type) AS m FROM n WHERE subtype IS NOT NULL OR named = 0) SELECT acc, type, subtype, r = 1 AS direct FROM k WHERE m = 0 OR r = 1")
def g16(t):
    return h.propagate_classes(classes(t), customer_closure(t))


def classes(t: Tables) -> DataFrame:
    subtype = F.when(F.col("c_nationkey") % 2 == 1, acc(F.col("c_nationkey"), "n"))
    return t.customer.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("acc"), F.col("c_mktsegment").alias("type"), subtype.alias("subtype"))


@query("W7_prefer_direct", "SELECT o_orderkey AS id, o_custkey AS k, o_orderstatus = 'F' AS direct FROM (SELECT *, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE m = 0 OR o_orderstatus = 'F'")
def w7(t):
    return h.prefer_direct(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), (F.col("o_orderstatus") == "F").alias("direct")), ["k"], "direct")


@query("W8_drop_untyped", "SELECT id, k, s FROM (SELECT *, count(s) OVER (PARTITION BY k) AS n FROM (SELECT o_orderkey AS id, o_custkey AS k, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS s FROM orders)) WHERE s IS NOT NULL OR n = 0")
def w8(t):
    return h.drop_untyped(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("s")), ["k"], "s")


RANK = "CASE WHEN s_suppkey % 7 = 0 THEN 'no rank' WHEN s_suppkey >= 64 THEN 'r6' WHEN s_suppkey >= 32 THEN 'r5' WHEN s_suppkey >= 16 THEN 'r4' WHEN s_suppkey >= 8 THEN 'r3' WHEN s_suppkey >= 4 THEN 'r2' ELSE 'r1' END"
TAXON_SQL = f"""WITH RECURSIVE n AS (SELECT s_suppkey AS tax_id, CASE WHEN s_suppkey > 0 THEN s_suppkey // 2 END AS parent_id, {RANK} AS rank, s_name AS name FROM supplier),
l AS (SELECT tax_id AS id, tax_id AS ancestor, 0 AS step FROM n UNION ALL SELECT l.id, n.parent_id, step + 1 FROM l JOIN n ON l.ancestor = n.tax_id WHERE n.parent_id IS NOT NULL)"""


def taxonomy(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("tax_id"), F.when(F.col("s_suppkey") > 0, half("s_suppkey")).alias("parent_id"), F.expr(RANK).alias("rank"), F.col("s_name").alias("name"))


@query(
    "G17_resolve_taxid",
    """SELECT o_orderkey AS taxid, coalesce(n.s_suppkey, CASE WHEN o_orderkey BETWEEN 1000 AND 1050 AND s2.s_suppkey IS NOT NULL THEN o_orderkey - 1000 END, s3.s_suppkey, -1) AS resolved FROM orders
LEFT JOIN supplier n ON n.s_suppkey = o_orderkey LEFT JOIN supplier s2 ON s2.s_suppkey = o_orderkey - 1000 LEFT JOIN supplier s3 ON s3.s_suppkey = o_custkey""",
)
def g17(t):
    tax = taxonomy(t)
    merged = tax.where("tax_id <= 50").select((F.col("tax_id") + 1000).alias("old_id"), "tax_id")
    ids = t.orders.select(F.col("o_orderkey").alias("taxid"), F.concat(F.lit("  SUPPLIER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" ")).alias("name"))
    return h.resolve_taxid(ids, tax, merged, tax).select("taxid", F.coalesce("resolved", F.lit(-1)).alias("resolved"))


@query("G18_ranked_ancestors", f"{TAXON_SQL} SELECT id, rank, arg_min(ancestor, step) AS ancestor FROM l JOIN n ON ancestor = tax_id WHERE rank <> 'no rank' GROUP BY 1, 2")
def g18(t):
    return h.ranked_ancestors(taxonomy(t).select(F.col("tax_id").alias("id")), taxonomy(t))


@query("G18_lineage", f"{TAXON_SQL} SELECT id, string_agg(name, ';' ORDER BY step DESC) AS lineage FROM l JOIN n ON ancestor = tax_id WHERE rank <> 'no rank' GROUP BY 1")
def g18_lineage(t):
    return h.lineage(taxonomy(t).select(F.col("tax_id").alias("id")), taxonomy(t), taxonomy(t))


@query("G19_taxon_descendants", f"{TAXON_SQL} SELECT ancestor AS id, id AS descendant FROM l WHERE step > 0 AND ancestor IN (2, 3, 5)")
def g19(t):
    tax = taxonomy(t)
    return h.taxon_descendants(tax.where("tax_id in (2, 3, 5)").select(F.col("tax_id").alias("id")), tax)


@query("G20_restrict_to_taxa", f"{TAXON_SQL} SELECT c_custkey AS acc FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 100 IN (SELECT id FROM l WHERE ancestor IN (2, 5))")
def g20(t):
    taxa = t.customer.select(F.col("c_custkey").alias("acc"), (F.col("c_custkey") % 100).alias("taxid"), F.col("c_mktsegment").alias("source"))
    tax = taxonomy(t)
    return h.restrict_to_taxa(taxa.select("acc"), taxa, tax, tax.where("tax_id in (2, 5)").select(F.col("tax_id").alias("id")), "BUILDING")


@query(
    "G21_topology_clusters",
    """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + 10 AS b FROM part WHERE p_partkey % 50 < 40), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS reach FROM s UNION SELECT r.id, s.b FROM r JOIN s ON r.reach = s.a) SELECT id, min(reach) AS component FROM r GROUP BY id""",
)
def g21(t):
    return connected_components(t.part.where("p_partkey % 50 < 40").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 10).alias("dst")))


@query(
    "X2_closure_accessions",
    """WITH RECURSIVE n AS (SELECT p_partkey AS acc FROM part), s AS (SELECT acc FROM n WHERE acc % 97 = 0 AND acc > 500),
g AS (SELECT acc AS a, acc // 2 AS b FROM n WHERE acc > 0 UNION SELECT x.acc, y.acc FROM n x JOIN n y ON x.acc // 8 = y.acc // 8 AND x.acc >= 1000 AND y.acc >= 1000),
r AS (SELECT acc FROM s UNION SELECT g.b FROM r JOIN g ON r.acc = g.a) SELECT acc FROM r WHERE acc NOT IN (SELECT acc FROM s)""",
)
def x2(t):
    n = t.part.select(F.col("p_partkey").alias("acc"))
    tree = h.transitive_closure(n.where("acc > 0").select(half("acc").alias("parent"), F.col("acc").alias("child")))
    return h.closure_accessions(n.where("acc % 97 = 0 and acc > 500"), tree, n.where("acc >= 1000").select("acc", half("acc", 8).alias("mark")))


@query(
    "X4_minimal_topologies",
    f"""{CLOSURE_SQL}, u AS (SELECT ancestor AS acc, descendant AS topology FROM c WHERE ancestor IN ('P2', 'P3', 'P5', 'P8') AND CAST(substr(descendant, 2) AS BIGINT) % 3 = 1)
SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u v JOIN c ON c.ancestor = v.topology AND c.descendant = u.topology WHERE v.acc = u.acc)""",
)
def x4(t):
    return h.minimal_topologies(nodes(t), closure(t), nodes(t).where("p_partkey in (2, 3, 5, 8)"))
