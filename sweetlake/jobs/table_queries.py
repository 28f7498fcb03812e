"""Queries on the relational tables as annotation sources: accessions are customers, annotations are orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import joins, stats, tables
from .registry import Tables, query

#: Annotations: accession o_custkey, type o_orderstatus, property o_orderpriority, value o_orderkey % 50.
EAV_SQL = "SELECT o_custkey AS acc, o_orderstatus AS type, o_orderpriority AS property, CASE o_orderkey % 3 WHEN 0 THEN 'SourceA' WHEN 1 THEN 'SourceB' ELSE 'SourceC' END AS source, CASE WHEN o_orderkey % 4 > 0 THEN 's' || (o_orderkey % 4) END AS sourceid, CAST(o_orderkey % 50 AS VARCHAR) AS value FROM orders"


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def annotations(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(
        F.col("o_custkey").alias("acc"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("property"),
        F.when(k % 3 == 0, "SourceA").when(k % 3 == 1, "SourceB").otherwise("SourceC").alias("source"),
        F.when(k % 4 > 0, F.concat(F.lit("s"), text(k % 4))).alias("sourceid"), F.array(text(k % 50)).alias("value"),
    )


def keys(t: Tables, condition: str, name: str = "acc") -> DataFrame:
    return t.customer.where(condition).select(F.col("c_custkey").alias(name))


@query("P1_set_field", "SELECT c_custkey, CAST(c_nationkey * 2 AS BIGINT) AS c_nationkey FROM customer")
def p1(t):
    return tables.set_field(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", (F.col("c_nationkey") * 2).cast("long"))


@query("P2_add_fields", "SELECT c_custkey, c_custkey + 1 AS a, upper(c_mktsegment) AS b FROM customer")
def p2(t):
    return tables.add_fields(t.customer.select("c_custkey", "c_mktsegment"), {"a": F.col("c_custkey") + 1, "b": F.upper("c_mktsegment")}).drop("c_mktsegment")


@query("P3_replace_from_list", "SELECT c_custkey, 'v' || s_suppkey AS c_name FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer) JOIN supplier ON s_suppkey + 1 = i")
def p3(t):
    values = t.supplier.select((F.col("s_suppkey") + 1).alias("index"), F.concat(F.lit("v"), text("s_suppkey")).alias("value"))
    return tables.replace_from_list(t.customer.select("c_custkey", "c_name", "c_acctbal"), "c_name", values, [F.desc("c_acctbal"), F.asc("c_custkey")]).drop("c_acctbal")


@query("P4_filter_rows", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_nationkey < 10")
def p4(t):
    return tables.filter_rows(t.customer, lambda d: (d["c_acctbal"] > 5000) & (d["c_nationkey"] < 10)).select("c_custkey")


@query("P5_filter_expr", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS n0, CAST(p_partkey % 7 AS VARCHAR) AS n1, p_type FROM part WHERE p_size > 20 AND (p_size = 21 OR p_partkey % 7 = 3) AND p_type <> 'PROMO'")
def p5(t):
    rows = t.part.select("p_partkey", text("p_size").alias("n0"), text(F.col("p_partkey") % 7).alias("n1"), "p_type")
    return tables.filter_expr(rows, "n0 > 20 and (n0 = 21 or exists(n, x -> x = 3) and n1 = 3) and p_type <> 'PROMO'", "n")


@query("P6_rename_with", "SELECT c_custkey AS C_CUSTKEY, c_name AS C_NAME FROM customer")
def p6(t):
    return tables.rename_with(t.customer.select("c_custkey", "c_name"), str.upper)


@query("P7_select_drop", "SELECT s_suppkey, s_name FROM supplier")
def p7(t):
    return tables.select_cols(tables.drop_matching(tables.drop_cols(t.supplier, ["s_nationkey"]), "^s_acct"), ["s_suppkey", "s_name", "absent"])


@query("P8_map_values", "SELECT p_partkey, lower(p_brand) AS p_brand, lower(p_type) AS p_type FROM part")
def p8(t):
    return tables.map_values(t.part.select("p_partkey", "p_brand", "p_type"), F.lower, ["p_brand", "p_type"])


@query("P9_move_cols", "SELECT c_custkey, c_mktsegment, c_name FROM customer")
def p9(t):
    return tables.move_cols(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", ["c_mktsegment"])


@query("P10_keep_listed", "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x IN ('red', 'ring', 'small')), ';') AS names FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'ring', 'small'])")
def p10(t):
    return tables.keep_listed(t.part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(";")).alias("names")), "names", ["red", "ring", "small"])


@query("P11_range_filter", "SELECT count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part WHERE p_retailprice >= 950 AND p_retailprice <= 1000 AND p_size = 11")
def p11(t):
    return tables.range_filter(t.part, {"p_retailprice": 950}, {"p_retailprice": 1000}, {"p_size": 11}).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@query("P12_bounds", "SELECT min(c_custkey) AS min_mass, max(c_custkey) AS max_mass, min(c_acctbal) FILTER (c_acctbal > 0) AS min_permethylated, max(c_acctbal) FILTER (c_acctbal > 0) AS max_permethylated FROM customer")
def p12(t):
    return tables.bounds(t.customer, "c_custkey", "c_acctbal")


@query(
    "P13_valid_crossref",
    """SELECT c_custkey AS acc, c_mktsegment AS resource, CASE WHEN c_custkey % 3 = 0 THEN 'GAG_' || c_nationkey ELSE CAST(c_nationkey AS VARCHAR) END AS entry FROM customer
WHERE CASE c_mktsegment WHEN 'BUILDING' THEN false WHEN 'MACHINERY' THEN c_custkey % 3 > 0 AND c_nationkey > 0 WHEN 'HOUSEHOLD' THEN c_custkey % 3 > 0 AND c_nationkey > 0 WHEN 'FURNITURE' THEN c_custkey % 3 = 0 ELSE true END""",
)
def p13(t):
    entry = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("GAG_"), text("c_nationkey"))).otherwise(text("c_nationkey"))
    rows = t.customer.select(F.col("c_custkey").alias("acc"), F.col("c_mktsegment").alias("resource"), entry.alias("entry"))
    return tables.valid_crossref(rows, "resource", "entry", ["MACHINERY", "HOUSEHOLD"], {"FURNITURE": r"GAG_\d+"}, ["BUILDING"])


@query("P14_annotations_where", f"SELECT acc, property, sourceid, value FROM ({EAV_SQL}) WHERE type = 'F' AND source = 'SourceC'")
def p14(t):
    return tables.annotations_where(annotations(t), type="F", property=None, source="SourceC").select("acc", "property", "sourceid", F.col("value")[0].alias("value"))


@query("P15_export_facet", f"SELECT DISTINCT acc AS Accession, value AS Entry, coalesce(sourceid, 's0') AS SourceID FROM ({EAV_SQL}) WHERE type = 'O' AND property = '1-URGENT'")
def p15(t):
    return tables.export_facet(annotations(t), {"type": "O", "property": "1-URGENT"}, {"acc": "Accession", "value": "Entry", "sourceid": "SourceID"}, "s0")


@query("P16_monocounts", "SELECT o_custkey AS acc, CASE o_orderkey % 3 WHEN 0 THEN '*' WHEN 1 THEN 'Hex' ELSE 'Fuc' END AS symbol, CAST(o_orderkey % 50 AS INTEGER) AS n FROM orders WHERE o_orderstatus <> 'P'")
def p16(t):
    k = F.col("o_orderkey")
    name = F.when(F.col("o_orderstatus") == "P", "Name").when(k % 3 == 0, "MonosaccharideCount").when(k % 3 == 1, "HexCount").otherwise("FucCount")
    return tables.monocounts(t.orders.select(F.col("o_custkey").alias("acc"), name.alias("property"), F.array(text(k % 50)).alias("value")))


@query("P17_by_taxa", "SELECT c_custkey AS acc, c_nationkey AS taxid FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def p17(t):
    return tables.by_taxa(t.customer.select(F.col("c_custkey").alias("acc"), F.col("c_nationkey").alias("taxid")), t.nation.where("n_regionkey = 2").select(F.col("n_nationkey").alias("taxid")))


@query(
    "P18_search_database",
    """SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'HexNAc' || c_nationkey ELSE 'Fuc' || c_nationkey END AS name, round(c_custkey * 10 - 18.0105546, 5) AS mass FROM customer
WHERE c_custkey % 2 = 0 AND c_mktsegment = 'BUILDING' AND c_custkey % 5 > 0 AND c_nationkey % 3 < 2""",
)
def p18(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    base = t.customer.select(k.alias("acc"), n.alias("n"), F.col("c_mktsegment").alias("seg"))
    names = base.select("acc", F.concat(F.when(F.col("acc") % 2 == 0, "HexNAc").otherwise("Fuc"), text("n")).alias("name"))
    classes = base.select("acc", F.when(F.col("seg") == "BUILDING", "N-linked").otherwise("O-linked").alias("type"), F.when(F.col("acc") % 5 == 0, "truncated").alias("subtype"))
    kind = F.when(F.col("n") % 3 == 0, "Direct").when(F.col("n") % 3 == 1, "Subsumption").otherwise("Composition")
    species = base.select("acc", F.lit("human").alias("species"), kind.alias("kind"))
    return tables.search_database(names, classes, species, "human", base.select("acc", (F.col("acc") * 10.0).alias("mass")))


@query(
    "P19_label_glycan_kind",
    """WITH r AS (SELECT l_orderkey AS acc, CASE WHEN l_linenumber <= 2 THEN 'GlcNAc' WHEN l_quantity < 45 THEN 'Man' ELSE 'Gal' END AS s FROM lineitem)
SELECT acc, acc % 2 = 0 AND count(*) FILTER (s = 'GlcNAc') = 2 AND count(*) FILTER (s = 'Man') = count(*) - 2 AND count(*) > 2 AS high_mannose FROM r GROUP BY acc""",
)
def p19(t):
    symbol = F.when(F.col("l_linenumber") <= 2, "GlcNAc").when(F.col("l_quantity") < 45, "Man").otherwise("Gal")
    rows = t.lineitem.select(F.col("l_orderkey").alias("acc"), symbol.alias("symbol"))
    return tables.label_glycan_kind(rows, t.lineitem.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("acc")).distinct())


@query("P20_wide_properties", f"SELECT acc, coalesce(min(value) FILTER (property = '1-URGENT'), '') AS \"1-URGENT\", coalesce(min(value) FILTER (property = '5-LOW'), '') AS \"5-LOW\" FROM ({EAV_SQL}) GROUP BY acc")
def p20(t):
    return tables.wide_properties(annotations(t), ["1-URGENT", "5-LOW"])


@query("L1_sort_table", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
def l1(t):
    return tables.sort_table(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"])


@query("L2_nearest_mass", "SELECT p_partkey, p_retailprice FROM part ORDER BY abs(p_retailprice - 987.65), p_partkey LIMIT 1")
def l2(t):
    return tables.nearest_mass(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", 987.65, ["p_partkey"])


@query(
    "L3_natural_sort",
    """WITH v AS (SELECT DISTINCT o_custkey AS acc, CASE WHEN o_orderkey % 3 = 0 THEN 'x' || (o_orderkey % 12) ELSE CAST(o_orderkey % 12 AS VARCHAR) END AS v, (o_orderkey % 3) || '.' || (o_orderkey % 12) AS d FROM orders)
SELECT acc, (SELECT string_agg(v, ';' ORDER BY TRY_CAST(v AS DOUBLE) IS NULL, TRY_CAST(v AS DOUBLE), v) FROM (SELECT DISTINCT v FROM v w WHERE w.acc = v.acc)) AS natural,
string_agg(d, ';' ORDER BY split_part(d, '.', 1)::INT, split_part(d, '.', 2)::INT) AS dotted FROM v GROUP BY acc""",
)
def l3(t):
    k = F.col("o_orderkey")
    rows = t.orders.groupBy(F.col("o_custkey").alias("acc")).agg(
        F.collect_set(F.when(k % 3 == 0, F.concat(F.lit("x"), text(k % 12))).otherwise(text(k % 12))).alias("v"), F.collect_set(F.concat_ws(".", text(k % 3), text(k % 12))).alias("d")
    )
    return rows.select("acc", F.array_join(tables.natural_sort(F.col("v")), ";").alias("natural"), F.array_join(tables.sort_dotted(F.col("d")), ";").alias("dotted"))


@query("L4_worst_residuals", "SELECT c_custkey, c_acctbal FROM customer WHERE abs(c_acctbal) > 100 ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 25")
def l4(t):
    return tables.worst_residuals(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 25, 100, ["c_custkey"])


@query("X1_required_accessions", "SELECT DISTINCT o_custkey AS acc FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey % 7 <> 0 AND o_custkey % 11 <> 0 AND o_custkey % 13 <> 0")
def x1(t):
    lists = [t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("acc")) for s in ("F", "O")]
    return tables.required_accessions(lists, keys(t, "c_custkey % 7 = 0"), keys(t, "c_custkey % 11 = 0"), keys(t, "c_custkey % 13 = 0"))


def residue_sets(t: Tables) -> DataFrame:
    """Alignment rows whose sets are made of line numbers."""
    of = lambda c, n: F.collect_set(F.when(c, text("l_linenumber"))).alias(n)
    q = F.col("l_quantity")
    parts = {"core": q < 20, "core_strict": q < 15, "substructure": q < 40, "substructure_strict": q < 18, "whole": q < 10, "whole_strict": q < 12, "nonreducing": q > 35, "nonreducing_strict": q > 45}
    return t.lineitem.groupBy(F.col("l_orderkey").alias("structure")).agg(*(of(c, n) for n, c in parts.items()))


CONTAINED = {"core": "q < 20", "core_strict": "q < 15", "substructure": "q < 40", "substructure_strict": "q < 18", "whole": "q < 10", "whole_strict": "q < 12", "nonreducing": "q > 35", "nonreducing_strict": "q > 45"}
CHECK_SQL = (
    "WITH s AS (SELECT l_orderkey AS structure, "
    + ", ".join(f"coalesce(list(DISTINCT l_linenumber) FILTER ({c.replace('q', 'l_quantity')}), []) AS {n}" for n, c in CONTAINED.items())
    + " FROM lineitem GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT structure, '{a}<={b}' AS rule FROM s WHERE NOT list_has_all({b}, {a})" for a, b in tables.CONTAINMENT)
)


@query("X3_check_containment", CHECK_SQL)
def x3(t):
    return tables.check_containment(residue_sets(t), ["structure"])


# Joins


@query("J1_drop_archived", "SELECT o_orderkey, o_custkey AS acc FROM orders WHERE o_custkey % 9 <> 0")
def j1(t):
    return joins.drop_archived(t.orders.select("o_orderkey", F.col("o_custkey").alias("acc")), keys(t, "c_custkey % 9 = 0"))


def archived(t: Tables) -> DataFrame:
    return keys(t, "c_custkey % 9 = 0")


def replaced(t: Tables) -> DataFrame:
    return keys(t, "c_custkey % 18 = 0").withColumn("new_acc", F.col("acc") + 1)


@query("J2_apply_replacements", "SELECT o_orderkey, CASE WHEN o_custkey % 18 = 0 THEN o_custkey + 1 WHEN o_custkey % 9 = 0 THEN -1 ELSE o_custkey END AS acc FROM orders")
def j2(t):
    rows = joins.apply_replacements(t.orders.select("o_orderkey", F.col("o_custkey").alias("acc")), ["acc"], archived(t), replaced(t))
    return rows.select("o_orderkey", F.coalesce("acc", F.lit(-1)).alias("acc"))


@query("J3_retired_report", "SELECT c_custkey AS acc, CASE WHEN c_custkey % 18 = 0 AND c_custkey % 4 = 0 THEN CAST(c_custkey + 1 AS VARCHAR) ELSE '-' END AS replacement FROM customer WHERE c_custkey % 9 = 0 AND c_custkey % 4 < 2")
def j3(t):
    as_text = lambda df: df.select(*(text(c).alias(c) for c in df.columns))
    return joins.retired_report(as_text(keys(t, "c_custkey % 4 < 2")), as_text(archived(t)), as_text(replaced(t))).withColumn("acc", F.col("acc").cast("long"))


@query(
    "J4_crossref_via",
    "SELECT DISTINCT o.o_custkey AS a, l.l_suppkey AS b FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag IN ('A', 'N')",
)
def j4(t):
    a = t.orders.select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("k"))
    b = t.lineitem.select(F.col("l_suppkey").alias("b"), F.col("l_orderkey").alias("k"), "l_returnflag")
    return joins.crossref_via(a, [b.where("l_returnflag = 'A'"), b.where("l_returnflag = 'N'")])


@query("J5_resolve_by_name", "SELECT p_partkey, coalesce(acc, -1) AS acc FROM part LEFT JOIN (SELECT p_name AS name, min(p_partkey) AS acc FROM part WHERE p_size < 3 GROUP BY 1) ON name = p_name")
def j5(t):
    names = t.part.where("p_size < 3").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("acc"))
    return joins.resolve_by_name(t.part.select("p_partkey", "p_name"), names, "p_name", True).select("p_partkey", F.coalesce("acc", F.lit(-1)).alias("acc"))


@query(
    "J6_attach_taxid",
    """WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS taxid, c_custkey % 200 AS protein, 'nation_' || (c_custkey % 30) AS species FROM customer),
j AS (SELECT r.*, CASE WHEN r.id % 50 = 0 THEN 99 END AS fix, s_nationkey AS bp, n_nationkey AS bn FROM r LEFT JOIN supplier ON s_suppkey = protein LEFT JOIN nation ON lower(n_name) = species)
SELECT id, coalesce(fix, taxid, bp, bn, -1) AS taxid, len(list_distinct(list_filter([taxid, bp, bn], lambda x: x IS NOT NULL))) > 1 AS conflict FROM j""",
)
def j6(t):
    k = F.col("c_custkey")
    rows = t.customer.select(k.alias("id"), F.when(k % 3 == 0, F.col("c_nationkey")).alias("taxid"), (k % 200).alias("protein"), F.concat(F.lit("nation_"), text(k % 30)).alias("species"))
    species = t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("taxid"))
    proteins = t.supplier.select(F.col("s_suppkey").alias("protein"), F.col("s_nationkey").alias("taxid"))
    fixes = t.customer.where("c_custkey % 50 = 0").select(k.alias("id"), F.lit(99).alias("taxid"))
    return joins.attach_taxid(rows, species, proteins, fixes).withColumn("taxid", F.coalesce("taxid", F.lit(-1)))


@query("J7_source_ids_to_accessions", "SELECT DISTINCT p_partkey AS acc, c_nationkey AS taxid, c_mktsegment AS source, c_custkey % 40 AS sourceid FROM customer JOIN part ON p_partkey % 40 = c_custkey % 40 AND p_size % 5 = length(c_mktsegment) % 5")
def j7(t):
    taxa = t.customer.select(F.col("c_nationkey").alias("taxid"), F.col("c_mktsegment").alias("source"), (F.col("c_custkey") % 40).alias("sourceid"))
    segments = t.customer.select(F.col("c_mktsegment").alias("source")).distinct()
    ids = t.part.join(segments, F.col("p_size") % 5 == F.length("source") % 5).select("source", (F.col("p_partkey") % 40).alias("sourceid"), F.col("p_partkey").alias("acc"))
    return joins.source_ids_to_accessions(taxa, ids)


@query(
    "J8_two_hop_annotations",
    "WITH i AS (SELECT o_custkey AS acc, CAST(o_orderkey AS VARCHAR) AS id FROM orders UNION SELECT c_custkey, c_name FROM customer), v AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, l_suppkey AS value FROM lineitem UNION ALL SELECT c_name, c_nationkey FROM customer) SELECT DISTINCT acc, value FROM i JOIN v USING (id)",
)
def j8(t):
    mapped = t.orders.select(F.col("o_custkey").alias("acc"), text("o_orderkey").alias("id"))
    values = t.lineitem.select(text("l_orderkey").alias("id"), F.col("l_suppkey").alias("value")).unionByName(t.customer.select(F.col("c_name").alias("id"), F.col("c_nationkey").cast("long").alias("value")))
    return joins.two_hop_annotations(mapped, t.customer.select(F.col("c_custkey").alias("acc"), F.col("c_name").alias("name")), values)


@query(
    "J9_optional_pair_export",
    f"WITH a AS ({EAV_SQL}) SELECT x.acc, x.value AS value1, coalesce(y.value, '') AS value2 FROM (SELECT DISTINCT acc, value FROM a WHERE property = '1-URGENT') x LEFT JOIN (SELECT DISTINCT acc, value FROM a WHERE property = '5-LOW') y USING (acc)",
)
def j9(t):
    return joins.optional_pair_export(annotations(t), "1-URGENT", "5-LOW")


@query(
    "J10_locate_peptides",
    """WITH p AS (SELECT item_id AS pep_id, substr(text, 1 + CAST(item_id % 5 AS BIGINT), 3) AS sequence, unnest([item_id * 3, item_id * 3 + 1]) AS acc FROM benchmark), d AS (SELECT doc_id AS acc, coalesce(text, '') AS s FROM documents),
h AS (SELECT pep_id, acc, unnest(list_transform(list_filter(range(1, length(s) - 1), lambda i: substr(s, i, 3) = sequence), lambda i: {'at': i, 'l': CASE WHEN i = 1 THEN '-' ELSE substr(s, i - 1, 1) END, 'r': CASE WHEN i + 3 > length(s) THEN '-' ELSE substr(s, i + 3, 1) END})) AS x FROM p JOIN d USING (acc))
SELECT pep_id, acc, CAST(x.at AS INTEGER) AS start, CAST(x.at + 2 AS INTEGER) AS "end", x.l AS "left", x.r AS "right", CAST(x.at + 1 AS INTEGER) AS protein_site FROM h""",
)
def j10(t):
    peptides = t.benchmark.select(
        F.col("item_id").alias("pep_id"), F.substr("text", (F.lit(1) + F.col("item_id") % 5).cast("int"), F.lit(3)).alias("sequence"), F.lit(2).alias("site"),
        F.array(F.col("item_id") * 3, F.col("item_id") * 3 + 1).alias("proteins"),
    )
    return joins.locate_peptides(peptides, t.documents.select(F.col("doc_id").alias("acc"), F.coalesce("text", F.lit("")).alias("protein_sequence")))


@query(
    "J12_annotate_genes",
    "WITH f AS (SELECT DISTINCT l_partkey AS gene, unnest([l_suppkey % 10, l_linenumber]) AS id FROM lineitem), n AS (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey <> 4) SELECT p_partkey AS gene, coalesce(string_agg(DISTINCT name, '::' ORDER BY name), '') AS facts FROM part LEFT JOIN f ON gene = p_partkey LEFT JOIN n USING (id) GROUP BY 1",
)
def j12(t):
    facts = t.lineitem.select(F.col("l_partkey").alias("gene"), F.concat_ws("::", text(F.col("l_suppkey") % 10), text("l_linenumber")).alias("ids"))
    names = t.nation.where("n_nationkey <> 4").select(text("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return joins.annotate_genes(t.part.select(F.col("p_partkey").alias("gene")), facts, names)


@query("J13_flag_listed", "SELECT c_custkey AS gene, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS listed FROM customer")
def j13(t):
    return joins.flag_listed(keys(t, "true", "gene"), t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("gene")), "listed")


@query(
    "J14_orthologs",
    "WITH p AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem), s AS (SELECT a AS gene, b AS other FROM p UNION SELECT b, a FROM p), k AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 > 0) SELECT gene, string_agg(CAST(other AS VARCHAR), ';' ORDER BY CAST(other AS VARCHAR)) AS orthologs FROM s WHERE gene IN (SELECT k FROM k) AND other IN (SELECT k FROM k) GROUP BY gene",
)
def j14(t):
    pairs = t.lineitem.select(text("l_partkey").alias("a"), text("l_suppkey").alias("b"))
    genes = t.part.where("p_partkey % 3 > 0").select(text("p_partkey").alias("gene"))
    return joins.orthologs(pairs, genes).withColumn("gene", F.col("gene").cast("long"))


ALIGN_SQL = "a AS (SELECT l_suppkey % 20 AS motif, l_partkey AS structure, CASE l_linenumber % 3 WHEN 0 THEN 'Core' WHEN 1 THEN 'Substructure' ELSE 'Whole' END AS type, l_quantity < 10 AS strict FROM lineitem)"


def alignments(t: Tables) -> DataFrame:
    n = F.col("l_linenumber") % 3
    return t.lineitem.select((F.col("l_suppkey") % 20).alias("motif"), F.col("l_partkey").alias("structure"), F.when(n == 0, "Core").when(n == 1, "Substructure").otherwise("Whole").alias("type"), (F.col("l_quantity") < 10).alias("strict"))


@query(
    "J15_motif_hits",
    f"""WITH {ALIGN_SQL}, m AS (SELECT 'M.' || s_suppkey AS id, s_suppkey % 25 AS motif, CASE s_suppkey % 2 WHEN 0 THEN 'Core' ELSE 'Whole' END AS type FROM supplier), h AS (SELECT DISTINCT structure, id, strict FROM a JOIN m USING (motif, type))
SELECT structure, string_agg(DISTINCT id, ';' ORDER BY id) AS loose, coalesce(string_agg(DISTINCT id, ';' ORDER BY id) FILTER (strict), '') AS strict FROM h GROUP BY 1""",
)
def j15(t):
    k = F.col("s_suppkey")
    motifs = t.supplier.select(F.concat(F.lit("M."), text(k)).alias("motif_id"), (k % 25).alias("structure_acc"), F.when(k % 2 == 0, "Core").otherwise("Whole").alias("alignment"))
    return joins.motif_hits(alignments(t), motifs)


@query(
    "J16_compare_alignments",
    "SELECT p_partkey AS motif, p_size AS structure, array_to_string(list_filter([0, 1, 2, 3], lambda i: [p_size % 2 = 0, p_partkey % 3 = 0, p_size > 10, true][i + 1] <> [p_size % 2 = 0, p_partkey % 5 = 0, p_size > 20, true][i + 1]), ',') AS differing FROM part WHERE p_partkey % 4 > 0 AND ((p_partkey % 3 = 0) <> (p_partkey % 5 = 0) OR (p_size > 10) <> (p_size > 20))",
)
def j16(t):
    yn = lambda *cs: F.array(*(F.when(F.expr(c), "Y").otherwise("N") for c in cs)).alias("yn")
    key = [F.col("p_partkey").alias("motif"), F.col("p_size").alias("structure")]
    new = t.part.select(*key, yn("p_size % 2 = 0", "p_partkey % 3 = 0", "p_size > 10", "true"))
    old = t.part.where("p_partkey % 4 > 0").select(*key, yn("p_size % 2 = 0", "p_partkey % 5 = 0", "p_size > 20", "true"))
    found = joins.compare_alignments(new, old)
    return found.withColumn("differing", F.array_join(F.transform("differing", lambda i: i.cast("string")), ","))


@query(
    "J17_mass_conflicts",
    """WITH a AS (SELECT c_custkey AS acc, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS annotated FROM customer WHERE c_custkey % 5 > 0), b AS (SELECT c_custkey AS acc, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END END AS computed FROM customer WHERE c_custkey % 3 > 0)
SELECT acc, round(coalesce(annotated, -1), 4) AS annotated, round(coalesce(computed, -1), 4) AS computed, CASE WHEN abs(annotated - computed) > 1e-4 THEN 'differs' ELSE 'missing' END AS problem FROM a FULL JOIN b USING (acc) WHERE abs(annotated - computed) > 1e-4 OR (annotated IS NULL AND computed IS NULL)""",
)
def j17(t):
    k, m = F.col("c_custkey"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal"))
    a = t.customer.where("c_custkey % 5 > 0").select(k.alias("acc"), m.alias("mass"))
    b = t.customer.where("c_custkey % 3 > 0").select(k.alias("acc"), (m + F.when(k % 6 == 0, 1).otherwise(0)).alias("mass"))
    return joins.mass_conflicts(a, b).withColumns({c: F.round(F.coalesce(c, F.lit(-1.0)), 4) for c in ("annotated", "computed")})


@query(
    "J20_motif_enzymes",
    """WITH m AS (SELECT DISTINCT l_suppkey % 20 AS motif, l_orderkey AS structure, l_linenumber AS rid FROM lineitem), e AS (SELECT l_orderkey AS structure, l_linenumber AS rid, CASE WHEN l_tax > 0.04 THEN 'human' ELSE 'mouse' END AS species, 'G' || (l_partkey % 30) AS gene FROM lineitem WHERE l_discount < 0.05)
SELECT motif, structure, species, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes FROM m JOIN e USING (structure, rid) GROUP BY 1, 2, 3""",
)
def j20(t):
    matches = t.lineitem.select((F.col("l_suppkey") % 20).alias("motif"), F.col("l_orderkey").alias("structure"), F.col("l_linenumber").alias("rid"))
    enzymes = t.lineitem.select(
        F.col("l_orderkey").alias("acc"), F.col("l_linenumber").alias("rid"), F.when(F.col("l_tax") > 0.04, "human").otherwise("mouse").alias("species"),
        F.concat(F.lit("G"), text(F.col("l_partkey") % 30)).alias("gene"), F.when(F.col("l_discount") < 0.05, 0).otherwise(1).alias("violations"),
    )
    return joins.motif_enzymes(matches, enzymes)


# Aggregations


@query("A1_collect_values", f"SELECT acc, source, string_agg(DISTINCT value, ';' ORDER BY value) AS \"values\" FROM ({EAV_SQL}) GROUP BY 1, 2")
def a1(t):
    return stats.collect_values(annotations(t).withColumn("value", F.explode("value")), ["acc", "source"], "value")


@query(
    "A2_taxon_counts",
    """WITH x AS (SELECT n_nationkey AS taxid, 'annotated' AS level, n_nationkey AS "at" FROM nation UNION ALL SELECT n_nationkey, 'genus', 100 + n_regionkey FROM nation),
d AS (SELECT DISTINCT level, "at", c_mktsegment AS s, c_custkey % 300 AS acc FROM customer JOIN x ON taxid = c_nationkey WHERE c_custkey % 300 % 9 <> 0)
SELECT level, "at", count(*) FILTER (s = 'BUILDING') AS "BUILDING", count(*) FILTER (s = 'MACHINERY') AS "MACHINERY", count(DISTINCT acc) AS total FROM d GROUP BY 1, 2""",
)
def a2(t):
    taxa = t.customer.select((F.col("c_custkey") % 300).alias("acc"), F.col("c_nationkey").alias("taxid"), F.col("c_mktsegment").alias("source"))
    n = t.nation
    expanded = n.select(F.col("n_nationkey").alias("taxid"), F.lit("annotated").alias("level"), F.col("n_nationkey").alias("at")).unionByName(n.select(F.col("n_nationkey").alias("taxid"), F.lit("genus").alias("level"), (F.col("n_regionkey") + 100).alias("at")))
    return stats.taxon_counts(taxa, expanded, archived(t), ["BUILDING", "MACHINERY"])


@query("A9_symbol_frequency", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def a9(t):
    return stats.symbol_frequency(t.part, "p_brand", "p_type")


ITEMS_SQL = "i AS (SELECT l_orderkey AS acc, CASE l_suppkey % 4 WHEN 0 THEN 'Man' WHEN 1 THEN 'Gal' WHEN 2 THEN 'GlcNAc' ELSE 'Fuc' END AS symbol FROM lineitem)"
COUNTS_SQL = f"""{ITEMS_SQL}, o AS (SELECT acc, symbol, count(*) AS n FROM i GROUP BY 1, 2), q AS (SELECT * FROM o UNION ALL SELECT acc, CASE symbol WHEN 'GlcNAc' THEN 'HexNAc' ELSE 'Hex' END, n FROM o WHERE symbol <> 'Fuc' UNION ALL SELECT acc, '*', n FROM o),
counts AS (SELECT acc, symbol, CAST(sum(n) AS BIGINT) AS n FROM q GROUP BY 1, 2)"""


def items(t: Tables) -> DataFrame:
    k = F.col("l_suppkey") % 4
    return t.lineitem.select(F.col("l_orderkey").alias("acc"), F.when(k == 0, "Man").when(k == 1, "Gal").when(k == 2, "GlcNAc").otherwise("Fuc").alias("symbol"))


def roll_ups(t: Tables) -> DataFrame:
    """(symbol, parent): what the items' symbols roll up to."""
    known = items(t).select("symbol").distinct()
    return known.where("symbol <> 'Fuc'").withColumn("parent", F.when(F.col("symbol") == "GlcNAc", "HexNAc").otherwise("Hex"))


@query("A10_composition_counts", f"WITH {COUNTS_SQL} SELECT * FROM counts")
def a10(t):
    return stats.composition_counts(items(t), roll_ups(t))


@query(
    "A11_composition_table",
    f"WITH {COUNTS_SQL}, w AS (SELECT acc, CAST(coalesce(sum(n) FILTER (symbol = 'Hex'), 0) AS BIGINT) AS \"Hex\", CAST(coalesce(sum(n) FILTER (symbol = 'HexNAc'), 0) AS BIGINT) AS \"HexNAc\", CAST(coalesce(sum(n) FILTER (symbol = 'Fuc'), 0) AS BIGINT) AS \"Xxx\", CAST(sum(n) FILTER (symbol = '*') AS BIGINT) AS total FROM counts WHERE symbol <> 'Man' OR acc % 2 = 0 GROUP BY acc) SELECT w.* FROM w WHERE acc NOT IN (SELECT acc FROM counts WHERE symbol = 'Man' AND acc % 2 = 0)",
)
def a11(t):
    c = stats.composition_counts(items(t), roll_ups(t)).where("symbol not in ('Gal', 'GlcNAc') and (symbol <> 'Man' or acc % 2 = 0)")
    return stats.composition_table(c, ["Hex", "HexNAc"])


@query("A12_repeat_flagged_counts", f"WITH {COUNTS_SQL} SELECT acc, symbol, n || CASE WHEN symbol = 'Man' THEN '+' ELSE '' END AS n FROM counts")
def a12(t):
    one = stats.composition_counts(items(t), roll_ups(t))
    return stats.repeat_flagged_counts(one, one.withColumn("n", F.col("n") + F.when(F.col("symbol") == "Man", 1).otherwise(0)))


ELEMENTS = [("Man", "C", 6), ("Man", "H", 10), ("Man", "O", 5), ("Gal", "C", 6), ("Gal", "H", 10), ("Gal", "O", 5), ("GlcNAc", "C", 8), ("GlcNAc", "H", 13), ("GlcNAc", "N", 1), ("GlcNAc", "O", 5)]
MASSES = [("C", 12.0), ("H", 1.00782503223), ("N", 14.00307400443), ("O", 15.99491461957)]
ELEMENT_SQL = f"""{ITEMS_SQL}, t AS (SELECT * FROM (VALUES {", ".join(map(str, ELEMENTS))}) v(symbol, element, n)), el AS (SELECT i.acc, element, CAST(sum(n) AS BIGINT) AS n FROM i JOIN t USING (symbol) WHERE i.acc NOT IN (SELECT acc FROM i WHERE symbol = 'Fuc') GROUP BY 1, 2)"""


def elements(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame(ELEMENTS, "symbol string, element string, n int")
    return stats.elemental_composition(items(t), table)


@query("A16_elemental_composition", f"WITH {ELEMENT_SQL} SELECT acc, string_agg(element || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END, '' ORDER BY element) AS formula FROM el GROUP BY acc")
def a16(t):
    return stats.formula(elements(t))


@query("A17_molecular_weight", f"WITH {ELEMENT_SQL}, m AS (SELECT * FROM (VALUES {', '.join(map(str, MASSES))}) v(element, mass)) SELECT acc, round(CAST(sum(n * CAST(mass AS DOUBLE)) AS DOUBLE), 5) AS mass FROM el JOIN m USING (element) GROUP BY acc")
def a17(t):
    masses = t.spark.createDataFrame(MASSES, "element string, mass double")
    return stats.molecular_weight(elements(t), masses).where("mass is not null").withColumn("mass", F.round("mass", 5))


@query("A18_date_range", "SELECT o_custkey AS acc, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last FROM orders GROUP BY 1")
def a18(t):
    return stats.date_range(t.orders.withColumnRenamed("o_custkey", "acc"), "acc", "o_orderdate").withColumns({c: text(c) for c in ("first", "last")})


@query("A19_multi_sequences", "SELECT o_custkey AS acc, o_orderstatus AS format, count(DISTINCT o_orderkey % 5) AS n FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderkey % 5) > 1")
def a19(t):
    return stats.multi_sequences(t.orders.select(F.col("o_custkey").alias("acc"), F.col("o_orderstatus").alias("format"), (F.col("o_orderkey") % 5).alias("sequence")))


@query(
    "A20_valid_and_replacement",
    """WITH h AS (SELECT c_custkey AS acc, c_custkey % 700 AS own, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 350 ELSE c_custkey % 700 END AS validated, c_custkey % 11 = 0 AS invalid FROM customer), b AS (SELECT validated AS v, min(acc) AS r FROM h WHERE own = validated AND NOT invalid GROUP BY 1)
SELECT acc, own = validated AND NOT invalid AS valid, CASE WHEN own = validated AND NOT invalid THEN -1 ELSE coalesce(r, -1) END AS replacement FROM h LEFT JOIN b ON v = validated""",
)
def a20(t):
    k = F.col("c_custkey")
    rows = t.customer.select(k.alias("acc"), (k % 700).alias("own"), F.when(k % 3 == 0, k % 350).otherwise(k % 700).alias("validated"), (k % 11 == 0).alias("invalid"))
    return stats.valid_and_replacement(rows).withColumn("replacement", F.coalesce("replacement", F.lit(-1)))


@query(
    "A21_name_to_accession",
    "SELECT p_name AS name, coalesce(min(p_partkey) FILTER (p_size > 40), min(p_partkey)) AS acc, count(DISTINCT p_partkey) > 1 AS ambiguous FROM part GROUP BY 1",
)
def a21(t):
    return stats.name_to_accession(t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("acc")), t.part.where("p_size > 40").select(F.col("p_partkey").alias("acc")))


@query(
    "A22_motif_enzyme_rollup",
    """WITH r AS (SELECT l_suppkey % 20 AS motif, l_returnflag AS type, CASE WHEN l_tax > 0.04 THEN 'human' ELSE 'mouse' END AS species, 'G' || (l_partkey % 9) AS gene, CAST(l_linenumber AS VARCHAR) AS rid, CAST(l_orderkey AS VARCHAR) AS s, max(CASE WHEN l_quantity > 49 THEN 'core' ELSE '' END) OVER (PARTITION BY l_suppkey % 20, l_returnflag) AS core FROM lineitem),
g AS (SELECT motif, type, species, core, gene || ':' || string_agg(DISTINCT rid, '+' ORDER BY rid) AS x FROM r GROUP BY motif, type, species, core, gene), s AS (SELECT motif, type, species, array_to_string((list(DISTINCT s ORDER BY s))[1:10], ',') AS structures FROM r GROUP BY 1, 2, 3)
SELECT motif, type, species, core, string_agg(x, ';' ORDER BY x) AS genes, any_value(structures) AS structures FROM g JOIN s USING (motif, type, species) GROUP BY 1, 2, 3, 4""",
)
def a22(t):
    return stats.motif_enzyme_rollup(
        t.lineitem.select(
            (F.col("l_suppkey") % 20).alias("motif"), F.col("l_returnflag").alias("type"), F.when(F.col("l_tax") > 0.04, "human").otherwise("mouse").alias("species"), F.when(F.col("l_quantity") > 49, "core").otherwise("").alias("core"),
            F.concat(F.lit("G"), text(F.col("l_partkey") % 9)).alias("gene"), text("l_linenumber").alias("rid"), text("l_orderkey").alias("structure"),
        )
    )


@query("A24_linear_fit", "SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(corr(l_quantity, l_extendedprice), 6) AS r, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1")
def a24(t):
    f = stats.linear_fit(t.lineitem, "l_suppkey", "l_quantity", "l_extendedprice")
    return f.select("l_suppkey", F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r", 6).alias("r"), "n")


@query("A25_classification_counts", "SELECT o_custkey AS acc, count(DISTINCT o_orderstatus) AS n_types, count(DISTINCT (o_orderstatus, o_orderpriority)) AS n_subtypes, count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS \"n_F\" FROM orders GROUP BY 1")
def a25(t):
    return stats.classification_counts(t.orders.select(F.col("o_custkey").alias("acc"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("subtype")), ["F"])


@query(
    "A26_categorize_messages",
    """WITH m AS (SELECT CASE WHEN regexp_matches(props, '"k": ([0-9])}') THEN 'small' WHEN regexp_matches(props, '"k": ([0-9]+)}') THEN 'large' END AS category, regexp_extract(props, '"k": ([0-9]+)}', 1) AS id FROM events) SELECT category, count(*) AS n, count(DISTINCT id) AS n_ids FROM m GROUP BY 1""",
)
def a26(t):
    return stats.categorize_messages(t.events, "props", {"small": r'"k": ([0-9])\}', "large": r'"k": ([0-9]+)\}'})


@query(
    "A27_expression_category",
    """WITH r AS (SELECT l_partkey AS gene, ['a', 'b', 'c', 'd', 'e', 'f'][1 + l_suppkey % 6] AS grp, CASE WHEN l_partkey % 4 = 0 THEN l_quantity / 100 WHEN l_partkey % 4 = 1 THEN l_quantity * l_quantity * l_quantity / 1000 ELSE l_quantity END AS v FROM lineitem),
w AS (SELECT g.gene, s.grp, coalesce(max(v), 0.0) AS v FROM (SELECT DISTINCT gene FROM r) g CROSS JOIN (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'f']) AS grp) s LEFT JOIN r ON r.gene = g.gene AND r.grp = s.grp GROUP BY 1, 2),
a AS (SELECT gene, list(v ORDER BY v DESC, grp) AS v, first(grp ORDER BY v DESC, grp) AS top FROM w GROUP BY 1)
SELECT gene, CASE WHEN v[1] < 1 THEN 'not detected' WHEN v[1] >= 50 * v[2] THEN 'highly enriched' WHEN v[1] >= 5 * v[2] THEN 'moderately enriched' WHEN (v[1] + v[2]) / 2 > 5 * v[3] OR (v[1] + v[2] + v[3]) / 3 > 5 * v[4] OR (v[1] + v[2] + v[3] + v[4]) / 4 > 5 * v[5] OR (v[1] + v[2] + v[3] + v[4] + v[5]) / 5 > 5 * v[6] THEN 'group enriched' WHEN v[6] >= 1 THEN 'ubiquitous' ELSE 'mixed' END AS category, top FROM a""",
)
def a27(t):
    q, k = F.col("l_quantity"), F.col("l_partkey")
    rows = t.lineitem.select(
        k.alias("gene"), F.get(F.array(*map(F.lit, "abcdef")), F.col("l_suppkey") % 6).alias("grp"), F.when(k % 4 == 0, q / 100).when(k % 4 == 1, q * q * q / 1000).otherwise(q).alias("ntpm")
    )
    return stats.expression_category(rows, list("abcdef"))


@query(
    "A28_signature_diff",
    """WITH o AS (SELECT o_custkey AS acc, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS s FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1), n AS (SELECT o_custkey AS acc, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS s FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 2 = 0 GROUP BY 1),
b AS (SELECT acc, coalesce(o.s, []) AS o, coalesce(n.s, []) AS n FROM o FULL JOIN n USING (acc))
SELECT array_to_string(list_sort(list_filter(n, lambda x: NOT list_contains(o, x))), ';') AS adds, array_to_string(list_sort(list_filter(o, lambda x: NOT list_contains(n, x))), ';') AS removes, count(*) AS size, array_to_string((list(acc ORDER BY acc))[1:10], ',') AS examples FROM b WHERE o <> n GROUP BY o, n""",
)
def a28(t):
    of = lambda c: t.orders.where(c).select(F.col("o_custkey").alias("acc"), F.col("o_orderstatus").alias("cls"))
    d = stats.signature_diff(of("o_orderkey % 3 > 0"), of("o_orderkey % 5 > 0 and o_orderkey % 2 = 0"))
    return d.select(F.array_join("adds", ";").alias("adds"), F.array_join("removes", ";").alias("removes"), "size", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query("A29_residue_index", "SELECT l_orderkey AS acc, l_returnflag AS key, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS residues, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS links FROM lineitem GROUP BY 1, 2")
def a29(t):
    return stats.residue_index(t.lineitem.select(F.col("l_orderkey").alias("acc"), F.col("l_returnflag").alias("key"), text("l_linenumber").alias("rid"), text("l_suppkey").alias("lid")))


@query(
    "A30_enzyme_annotations",
    "WITH r AS (SELECT l_orderkey AS acc, l_returnflag AS species, 'G' || (l_partkey % 9) AS gene, 'U' || (l_partkey % 9) || ':G' || (l_partkey % 9) || ':' || l_linenumber || ':' || 9606 AS d FROM lineitem) SELECT acc, species, string_agg(DISTINCT gene, ';' ORDER BY gene) AS genes, string_agg(DISTINCT d, ';' ORDER BY d) AS details FROM r GROUP BY 1, 2",
)
def a30(t):
    g = text(F.col("l_partkey") % 9)
    return stats.enzyme_annotations(t.lineitem.select(F.col("l_orderkey").alias("acc"), F.col("l_returnflag").alias("species"), F.concat(F.lit("G"), g).alias("gene"), F.concat(F.lit("U"), g).alias("uniprot"), F.col("l_linenumber").alias("id"), F.lit(9606).alias("taxid")))


@query("W9_first_seen", "SELECT * EXCLUDE (r) FROM (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def w9(t):
    return stats.first_seen(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"], ["o_orderkey"])


@query(
    "F15_lod",
    "WITH c AS (SELECT l_suppkey AS k, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS x, count(*) FILTER (l_returnflag = 'R') AS n, count(*) FILTER (l_linestatus = 'F') AS m, count(*) AS total FROM lineitem GROUP BY 1) SELECT k, round(log2((x + 0.5) / (n - x + 0.5)) - log2((m - x + 0.5) / (total - n - m + x + 0.5)), 6) AS lod FROM c",
)
def f15(t):
    r, f = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    c = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.count_if(r & f).alias("x"), F.count_if(r).alias("n"), F.count_if(f).alias("m"), F.count("*").alias("total"))
    return c.select("k", F.round(stats.lod(*(F.col(x) for x in ("x", "n", "m", "total"))), 6).alias("lod"))
