"""Queries of sources and sinks on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import readers, sinks
from .hierarchy_queries import EDGES_SQL, edges
from .registry import Tables, query
from .table_queries import EAV_SQL, annotations, text


@query("S2_clean_rows", "SELECT event_id, nullif(trim(CASE WHEN event_id % 4 = 0 THEN '  ' ELSE ' ' || event_type || ' ' END), '') AS kind FROM events WHERE event_id % 4 > 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 0")
def s2(t):
    return readers.clean_rows(t.events.select("event_id", F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("kind")))


@query(
    "S3_explode_records",
    "SELECT 'S' || p_partkey AS id, 'structure' AS kind, p_size AS taxid, 'P' || (p_partkey % 7) AS pmid FROM part UNION ALL SELECT 'C' || p_partkey, 'composition', p_size, 'P' || (p_partkey % 7) FROM part WHERE p_partkey % 2 = 0",
)
def s3(t):
    k = text("p_partkey")
    records = t.part.select(
        F.array(F.concat(F.lit("S"), k)).alias("structures"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(F.lit("C"), k))).alias("compositions"),
        F.array(F.struct(F.col("p_size").alias("taxid"), F.concat(F.lit("P"), text(F.col("p_partkey") % 7)).alias("pmid"))).alias("references"),
    )
    return readers.explode_records(records)


def normal(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, text("c_custkey")).alias("pm"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("10."), text("c_custkey"))).alias("doi"))
    return readers.normalize_source(rows, {"id": "c_custkey", "acc": "c_custkey", "taxid": "c_nationkey", "pmid": "pm", "doi": "doi", "sourceid": "c_custkey"}, {"source": "SourceD", "tissue": "liver"})


@query("S4_normalize_source", "SELECT CAST(c_custkey AS VARCHAR) AS acc, c_nationkey AS taxid, 'liver' AS tissue, 'SourceD' AS source FROM customer")
def s4(t):
    return normal(t).select("acc", "taxid", "tissue", "source")


@query(
    "S5_source_taxa",
    "SELECT CAST(c_custkey AS VARCHAR) AS acc, c_nationkey AS taxid, 'SourceD' AS source, CAST(c_custkey AS VARCHAR) AS sourceid FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_nationkey, 'PubMed', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_nationkey, 'DOI', '10.' || c_custkey FROM customer WHERE c_custkey % 5 = 0",
)
def s5(t):
    return readers.source_taxa(normal(t))


@query("S6_union_sources", "SELECT CAST(c_custkey AS VARCHAR) AS acc, 'SourceD' AS source FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'SourceC' FROM supplier")
def s6(t):
    other = t.supplier.select(text("s_suppkey").alias("acc"), F.lit("SourceC").alias("source"))
    return readers.union_sources([normal(t), other]).select("acc", "source")


DUMP_SQL = """p AS (SELECT p_partkey AS k, 'G' || lpad(p_partkey::VARCHAR, 5, '0') || 'AA' AS acc, (100 + p_size) || '.00' AS bucket FROM part)
SELECT bucket, 'node' AS kind, acc, bucket || '|' || CASE k % 4 WHEN 0 THEN 'Topology' ELSE 'Saccharide' END || '|' || acc || '|' || CASE WHEN k % 5 > 0 THEN 'C' || k % 5 ELSE '-' END || '|-|'
|| 'Hex=' || k % 9 || ',HexNAc+aldi=1|COMP=true' || CASE WHEN k % 2 = 0 THEN ',HASARCH=G9' ELSE '' END AS detail FROM p
UNION ALL SELECT bucket, 'edge', acc, 'X' || k || ' subsumed' FROM p UNION ALL SELECT bucket, 'edge', acc, 'Y +aldi' FROM p WHERE k % 3 = 0
UNION ALL SELECT bucket, 'missing', acc, CASE WHEN k % 6 = 0 THEN '-' ELSE (k % 600)::VARCHAR END FROM p WHERE k % 7 > 0
UNION ALL SELECT bucket, 'warning', '3', acc || ' is odd - so it says' FROM p WHERE k % 10 = 0 UNION ALL SELECT bucket, 'warning', '-', 'unread: ' || acc || ' broken' FROM p WHERE k % 50 = 0"""


def dump_clusters(t: Tables) -> DataFrame:
    """`value`: a record a mass cluster, as a dump has them: warnings amid nodes, sections without content, lists of edges."""
    k, mass = F.col("p_partkey"), F.concat(text(100 + F.col("p_size")), F.lit(".00"))
    acc = F.concat(F.lit("G"), F.lpad(text(k), 5, "0"), F.lit("AA"))
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    odd = F.when(k % 10 == 0, line("# WARNING:3 - ", acc, " is odd - so it says\n")).otherwise("")
    broken = F.when(k % 50 == 0, line(acc, " broken\n")).otherwise("")
    node = line(odd, broken, acc, " ", mass, " ", F.when(k % 4 == 0, "Topology").otherwise("Saccharide*"), " ", acc, F.when(k % 5 > 0, line(" C", text(k % 5), "*")).otherwise(" None"), " None  COMP ", F.when(k % 2 == 0, "HASARCH:G9 ").otherwise(""), "Hex:", text(k % 9), " HexNAc+aldi:1")
    tree = line("  ", acc, F.when(k % 7 == 0, "*").otherwise(""), " Topology* ", F.when(k % 6 == 0, "-").otherwise(text(k % 600)))
    edge = line(acc, ": X", text(k), F.when(k % 3 == 0, " Y*").otherwise(""))
    rows = t.part.groupBy(mass.alias("mass")).agg(*(F.array_join(F.collect_list(x), "\n").alias(c) for x, c in ((node, "nodes"), (tree, "tree"), (edge, "edges"))))
    head = line(" now - 1 accessions in molecular weight cluster for ", F.col("mass"), "\n# NODES - 1/1 + 0 glycans in molecular weight cluster for ", F.col("mass"), "\n")
    return rows.select(line(head, F.col("nodes"), "\n# ENDNODES\n\n# TREE\n", F.col("tree"), "\n# ENDTREE\nstray\n# EDGES\n", F.col("edges"), "\n# ENDEDGES\n# DONE - Elapsed\n").alias("value"))


def dump_rows(dump: readers.SubsumptionDump) -> DataFrame:
    """(bucket, kind, acc, detail) of all tables of a dump."""
    held = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    node = dump.nodes.select("bucket", F.lit("node").alias("kind"), "acc", F.concat_ws("|", "mw", "level", *map(none, ("topo", "comp", "bcomp")), held("counts"), held("extras")).alias("detail"))
    edge = dump.edges.select("bucket", F.lit("edge").alias("kind"), F.col("parent").alias("acc"), F.concat_ws(" ", "child", "kind").alias("detail"))
    missing = dump.missing.select("bucket", F.lit("missing").alias("kind"), "acc", none("rank").alias("detail"))
    warning = dump.warnings.select("bucket", F.lit("warning").alias("kind"), none("level").alias("acc"), F.col("message").alias("detail"))
    return node.unionByName(edge).unionByName(missing).unionByName(warning)


@query("S7_subsumption_lines", f"WITH {DUMP_SQL}")
def s7(t):
    return dump_rows(readers.subsumption_dump(readers.subsumption_lines(dump_clusters(t))))


@query("S9_term_stanzas", "SELECT 'CHEBI:' || p_partkey AS id, p_name AS name, 'GTC:' || p_size AS xrefs FROM part")
def s9(t):
    value = F.concat(F.lit("[Term]\nid: CHEBI:"), text("p_partkey"), F.lit("\nname: "), "p_name", F.lit("\nxref: GTC:"), text("p_size"), F.lit(" {x}\nxref: OTHER:1"))
    return readers.term_stanzas(t.part.select(value.alias("value")), ["GTC:", "GLY:"]).withColumn("xrefs", F.array_join("xrefs", ";"))


def upserts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(old, new) annotations, where new ones lack, change and add some."""
    k, v = F.col("o_orderkey"), text(F.col("o_orderkey") % 50)
    base = t.orders.select(F.col("o_custkey").alias("acc"), k.alias("k"), F.array(v).alias("value"))
    new = base.where("acc % 3 = 0 and k % 4 > 0").withColumn("value", F.when(F.col("k") % 7 == 0, F.array(F.lit("-1"))).otherwise(F.col("value")))
    return base.where("k % 5 > 0"), new


# Files that a sink writes and a reader reads


@query("S1_S11_export_read_back", "SELECT c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer")
def s1_s11(t):
    path = t.scratch("export")
    sinks.write_export(t.customer.select("c_name", "c_custkey", "c_acctbal", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")), path, ["c_custkey", "c_name", "c_acctbal", "segment"], ["c_name", "c_custkey"])
    return readers.read_delimited(t.spark, path, "\t", "c_custkey long, c_name string, c_acctbal double, segment string")


@query("S3_read_nested_records", "SELECT 'S' || p_partkey AS id, 'structure' AS kind, p_size AS taxid, 'P' || (p_partkey % 7) AS pmid FROM part")
def s3_files(t):
    """A file per p_size, each with one array of records over several lines."""
    record = F.struct(
        F.array(F.concat(F.lit("S"), text("p_partkey"))).alias("structures"), F.array().cast("array<string>").alias("compositions"),
        F.array(F.struct(F.col("p_size").alias("taxid"), F.concat(F.lit("P"), text(F.col("p_partkey") % 7)).alias("pmid"))).alias("references"),
    )
    files = t.part.groupBy("p_size").agg(F.replace(F.to_json(F.collect_list(record)), F.lit("},{"), F.lit("},\n {")).alias("value"))
    path = t.scratch("records")
    files.write.partitionBy("p_size").text(path)
    return readers.read_nested_records(t.spark, f"{path}/*")


@query("S7_read_subsumption_dump", f"WITH {DUMP_SQL}")
def s7_files(t):
    path = t.scratch("dump")
    dump_clusters(t).write.option("lineSep", "# START").text(path)
    return dump_rows(readers.read_subsumption_dump(t.spark, path))


TAXONOMY_SQL = """SELECT 'name' AS kind, n_nationkey AS id, -1 AS other, n_name AS value FROM nation WHERE n_nationkey % 5 < 4
UNION ALL SELECT 'node', n_nationkey, n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'species' END FROM nation UNION ALL SELECT 'merged', n_nationkey + 1000, n_nationkey, '' FROM nation"""


@query("S8_read_taxonomy", TAXONOMY_SQL)
def s8(t):
    folder, k = t.scratch("taxonomy"), F.col("n_nationkey")
    line = lambda *cells: F.concat(F.concat_ws("\t|\t", *cells), F.lit("\t|")).alias("value")
    classes = F.get(F.array(*map(F.lit, ("scientific name", "synonym", "common name", "genbank common name", "authority"))), (k % 5).cast("int"))
    t.nation.select(line(text(k), F.col("n_name"), F.lit(""), classes)).write.text(f"{folder}/names.dmp")
    t.nation.select(line(text(k), text("n_regionkey"), F.when(k % 3 == 0, "no rank").otherwise("species"), F.lit("x"))).write.text(f"{folder}/nodes.dmp")
    t.nation.select(line(text(k + 1000), text(k))).write.text(f"{folder}/merged.dmp")
    names, nodes, merged = readers.read_taxonomy(t.spark, folder)
    none = F.lit(-1)
    rows = names.select(F.lit("name").alias("kind"), F.col("tax_id").alias("id"), none.alias("other"), F.col("name").alias("value"))
    rows = rows.unionByName(nodes.select(F.lit("node").alias("kind"), F.col("tax_id").alias("id"), F.col("parent_id").alias("other"), F.col("rank").alias("value")))
    return rows.unionByName(merged.select(F.lit("merged").alias("kind"), F.col("old_id").alias("id"), F.col("tax_id").alias("other"), F.lit("").alias("value")))


@query("S9_read_term_stanzas", "SELECT 'CHEBI:' || p_partkey AS id, p_name AS name, 'GTC:' || p_size AS xrefs FROM part")
def s9_files(t):
    path = t.scratch("stanzas")
    value = F.concat(F.lit("[Term]\nid: CHEBI:"), text("p_partkey"), F.lit("\nname: "), "p_name", F.lit("\nxref: GTC:"), text("p_size"), F.lit(" {x}\nxref: OTHER:1"))
    t.part.select(value.alias("value")).write.option("lineSep", "\n\n").text(path)
    return readers.read_term_stanzas(t.spark, path, ["GTC:", "GLY:"]).withColumn("xrefs", F.array_join("xrefs", ";"))


@query("S16_upserted_table", """WITH o AS (SELECT o_custkey AS acc, o_orderkey AS k, o_orderkey % 50 AS v FROM orders WHERE o_orderkey % 5 > 0), n AS (SELECT o_custkey AS acc, o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey % 50 END AS v FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 4 > 0)
SELECT acc, k, CAST(v AS VARCHAR) AS value FROM n UNION ALL SELECT acc, k, CAST(v AS VARCHAR) FROM o WHERE acc NOT IN (SELECT acc FROM n)""")
def s16_table(t):
    base, new = upserts(t)
    return sinks.upsert_annotations(base, new, ["acc", "k"])[0].select("acc", "k", F.array_join("value", ";").alias("value"))


@query("S10_read_packed_scans", "SELECT p_partkey, 'hcd' AS mode, CAST(p_size AS DOUBLE) AS rt, p_retailprice AS precmz FROM part UNION ALL SELECT p_partkey, 'etd', 2.5, 1e3 FROM part")
def s10(t):
    packed = F.concat(F.lit("hcd("), text("p_size"), F.lit(",7,"), text("p_retailprice"), F.lit(",0.5);etd(2.5,8,1e3,)"))
    return readers.read_packed_scans(t.part.select("p_partkey", packed.alias("scans")), "scans").select("p_partkey", "mode", "rt", "precmz")


@query("S12_export_sequences", f"SELECT acc, min(value) AS body FROM ({EAV_SQL}) WHERE property = '2-HIGH' GROUP BY 1")
def s12(t):
    return sinks.export_sequences(annotations(t), "2-HIGH")


@query(
    "S13_annotations_to_triples",
    f"""WITH a AS ({EAV_SQL}), k AS (SELECT *, 'data:anno/' || md5(concat_ws('-', acc, type, property, source, sourceid)) AS s FROM a)
SELECT s, 'data:hasGlycan' AS p, 'data:glycan/' || acc AS o FROM k UNION SELECT s, 'data:type', '"' || type || '"' FROM k UNION SELECT s, 'data:property', '"' || property || '"' FROM k
UNION SELECT s, 'data:source', '"' || source || '"' FROM k UNION SELECT s, 'data:sourceid', '"' || sourceid || '"' FROM k WHERE sourceid IS NOT NULL UNION SELECT s, 'data:value', '"' || value || '"' FROM k""",
)
def s13(t):
    return sinks.annotations_to_triples(annotations(t))


@query(
    "S14_alignments_to_triples",
    """WITH a AS (SELECT 'motif:' || l_suppkey || ':' || l_orderkey || ':' || l_linenumber AS s, l_suppkey, l_orderkey, l_linenumber, l_quantity < 10 AS strict, l_partkey FROM lineitem)
SELECT s, 'motif:ids' AS p, CASE WHEN strict THEN 's' ELSE 'i' END || l_partkey AS o FROM a UNION ALL SELECT s, 'motif:a', 'Alignment' FROM a UNION ALL SELECT s, 'motif:motif', CAST(l_suppkey AS VARCHAR) FROM a UNION ALL SELECT s, 'motif:structure', CAST(l_orderkey AS VARCHAR) FROM a
UNION ALL SELECT s, 'motif:type', CAST(l_linenumber AS VARCHAR) FROM a UNION ALL SELECT s, 'motif:strict', CAST(strict AS VARCHAR) FROM a
UNION ALL SELECT 'motif:' || md5(c_custkey || ':' || c_mktsegment || ':' || c_nationkey), unnest(['motif:glycan', 'motif:class', 'motif:subclass', 'motif:source']), unnest([CAST(c_custkey AS VARCHAR), c_mktsegment, CAST(c_nationkey AS VARCHAR), 'x']) FROM customer""",
)
def s14(t):
    n = text("l_partkey")
    align = t.lineitem.select(
        F.col("l_suppkey").alias("motif"), F.col("l_orderkey").alias("structure"), text("l_linenumber").alias("type"), (F.col("l_quantity") < 10).alias("strict"), F.concat(F.lit("i"), n).alias("ids"), F.concat(F.lit("s"), n).alias("strict_ids")
    )
    classes = t.customer.select(F.col("c_custkey").alias("acc"), F.col("c_mktsegment").alias("type"), text("c_nationkey").alias("subtype"), F.lit("x").alias("source"))
    return sinks.alignments_to_triples(align, classes)


@query(
    "S15_viewer_nodes",
    f"""WITH {EDGES_SQL}, k AS (SELECT parent AS acc, '"children":[' || string_agg('"' || child || '"', ',' ORDER BY child) || ']' AS children, '"edgetype":{{' || string_agg('"' || child || '":"other"', ',' ORDER BY child) FILTER (kind <> 'subsumed') || '}}' AS types FROM e GROUP BY 1),
n AS (SELECT 'P' || p_partkey AS acc, p_partkey AS k, ['basecomposition', 'composition', 'topology', 'saccharide', 'molecular weight'][1 + p_size % 5] AS level, p_name FROM part WHERE p_partkey % 3 > 0)
SELECT acc, '{{' || concat_ws(',', CASE WHEN k % 4 = 0 THEN '"archetype":"P' || k // 4 || '"' END, children, '"count":{{"Hex":' || k % 9 || ',"HexNAc":2}}', types, CASE WHEN k % 7 = 0 THEN '"inrestriction":true' END, '"level":"' || level || '"', CASE WHEN k % 5 > 0 THEN '"score":' || k % 5 END,
CASE WHEN k % 2 = 0 THEN '"syms":["' || p_name || '"]' END) || '}}' AS document FROM n LEFT JOIN k USING (acc) WHERE level <> 'molecular weight'""",
)
def s15(t):
    k = F.col("p_partkey")
    acc = F.concat(F.lit("P"), text(k)).alias("acc")
    level = F.get(F.array(*map(F.lit, (*sinks.VIEWER_LEVELS, "molecular weight"))), (F.col("p_size") % 5).cast("int"))
    counts = F.when(k % 3 > 0, F.create_map(F.lit("HexNAc"), F.lit(2).cast("long"), F.lit("Hex"), (k % 9).cast("long")))
    nodes = t.part.select(acc, level.alias("level"), counts.alias("counts"), F.when(k % 5 > 0, k % 5).alias("score"), F.when(k % 4 == 0, F.concat(F.lit("P"), text(F.floor(k / 4)))).alias("archetype"))
    return sinks.viewer_nodes(nodes, edges(t), t.part.where("p_partkey % 2 = 0").select(acc, F.col("p_name").alias("name")), t.part.where("p_partkey % 7 = 0").select(acc))


@query(
    "S16_upsert_annotations",
    """WITH o AS (SELECT o_custkey AS acc, o_orderkey AS k, o_orderkey % 50 AS v FROM orders WHERE o_orderkey % 5 > 0), n AS (SELECT o_custkey AS acc, o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey % 50 END AS v FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 4 > 0)
SELECT acc, k, CASE WHEN o.v IS NULL THEN 'created' WHEN n.v IS NULL THEN 'deleted' ELSE 'updated' END AS change FROM o FULL JOIN n USING (acc, k) WHERE o.v IS NULL OR (n.v IS NULL AND acc IN (SELECT acc FROM n)) OR o.v <> n.v""",
)
def s16(t):
    return sinks.upsert_annotations(*upserts(t), ["acc", "k"])[1]


@query(
    "W14_assign_ids",
    """WITH e AS (SELECT p_partkey AS key, p_partkey + 1 AS n FROM part WHERE p_partkey % 3 > 0 AND p_partkey < 300), f AS (SELECT p_partkey AS key, row_number() OVER (ORDER BY p_partkey) AS k FROM part WHERE p_partkey NOT IN (SELECT key FROM e)),
u AS (SELECT i AS n, row_number() OVER (ORDER BY i) AS k FROM range(1, 100000) r(i) WHERE i NOT IN (SELECT n FROM e))
SELECT key, 'TG' || lpad(CAST(n AS VARCHAR), 6, '0') AS id FROM e UNION ALL SELECT key, 'TG' || lpad(CAST(u.n AS VARCHAR), 6, '0') FROM f JOIN u USING (k)""",
)
def w14(t):
    key = F.col("p_partkey")
    old = t.part.where("p_partkey % 3 > 0 and p_partkey < 300").select(key.alias("key"), F.concat(F.lit("TG"), F.lpad(text(key + 1), 6, "0")).alias("id"))
    return sinks.assign_ids(t.part.select(key.alias("key")), old, "TG")


@query("F18_chromatogram_json", "SELECT user_id AS peptide, CAST(event_id % 3 AS BIGINT) AS charge, count(DISTINCT event_type) AS series, count(*) AS points FROM events GROUP BY 1, 2")
def f18(t):
    rows = t.events.select(F.col("user_id").alias("peptide"), (F.col("event_id") % 3).alias("charge"), F.col("event_type").alias("label"), F.col("event_id").cast("double").alias("rt"), F.col("value").alias("int"))
    parsed = F.from_json("document", "series array<struct<label:string,points:array<struct<rt:double,int:double>>>>")["series"]
    docs = sinks.chromatogram_json(rows).select("peptide", "charge", parsed.alias("s"))
    return docs.select("peptide", "charge", F.size("s").cast("long").alias("series"), F.aggregate("s", F.lit(0), lambda n, x: n + F.size(x["points"])).cast("long").alias("points"))
