"""Queries of the column functions: compositions are made of part sizes, names of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as f
from ..operators import fdr
from .registry import Tables, query

COMPOSITION = "'comp_HexNAc' || p_size || 'Hex(' || (p_partkey % 9) || ')Fuc' || (p_partkey % 3) || CASE WHEN p_size % 7 = 0 THEN 'Hex4' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN 'HexNAc+aldi1' ELSE '' END"
HEX = "CASE WHEN p_size % 7 = 0 THEN 4 ELSE p_partkey % 9 END"


def compositions(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_size", F.expr(COMPOSITION).alias("text"))


@query("F1_parse_composition", f"SELECT p_partkey, CAST(p_size AS INTEGER) AS hexnac, CAST({HEX} AS INTEGER) AS hex, CAST(p_partkey % 3 AS INTEGER) AS fuc FROM part")
def f1(t):
    c = f.parse_composition(F.col("text"))
    return compositions(t).select("p_partkey", c["HexNAc"].alias("hexnac"), c["Hex"].alias("hex"), c["Fuc"].alias("fuc"))


PART = "CASE WHEN {n} > 0 THEN '{s}' || '{a}' || {n} || '{b}' ELSE '' END"


def formatted(names: tuple[str, str, str], a: str = "", b: str = "") -> str:
    return " || ".join(PART.format(n=n, s=s, a=a, b=b) for s, n in zip(names, ("p_size", f"({HEX})", "(p_partkey % 3)")))


@query(
    "F2_format_composition",
    f"SELECT p_partkey, {formatted(('HexNAc', 'Hex', 'Fuc'))} AS short, {formatted(('HexNAc', 'Hex', 'Fuc'), '(', ')')} AS bracketed, {formatted(('N', 'H', 'F'))} AS letter, 'HexNAc' || p_size || 'Hex' || ({HEX}) AS \"full\" FROM part",
)
def f2(t):
    c = f.parse_composition(F.col("text"))
    return compositions(t).select("p_partkey", *(f.format_composition(c, s).alias(s) for s in ("short", "bracketed", "letter")), f.format_composition(c, "full", ("HexNAc", "Hex")).alias("full"))


@query("F3_button_counts", f"SELECT p_partkey, CAST({HEX} AS INTEGER) AS hex, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS xxx FROM part")
def f3(t):
    c = f.button_counts(F.col("text"))
    return compositions(t).select("p_partkey", c["Hex"].alias("hex"), F.coalesce(F.try_element_at(c, F.lit("Xxx")), F.lit(0)).alias("xxx"))


SEQUENCE = "'2,3/[' || p_brand || '][' || p_type || ']/1-2-2/a' || CASE WHEN p_size % 3 = 0 THEN '?-?' ELSE '4-b1' END || CASE WHEN p_size % 4 = 0 THEN '~n' ELSE '' END"


@query(
    "F4_sequence_facets",
    "SELECT p_partkey, p_brand || ';' || p_type AS skeletons, CASE WHEN p_brand = 'Brand#1' THEN p_type ELSE p_brand || CASE WHEN p_type = 'PROMO' THEN '' ELSE ';' || p_type END END AS unknown, p_size % 3 = 0 AS bad_link, p_size % 4 = 0 AS repeats FROM part WHERE NOT (p_brand = 'Brand#1' AND p_type = 'PROMO')",
)
def f4(t):
    x = f.sequence_facets(F.expr(SEQUENCE), ["Brand#1", "PROMO"])
    rows = t.part.where("not (p_brand = 'Brand#1' and p_type = 'PROMO')").select("p_partkey", x.alias("x"))
    return rows.select("p_partkey", F.array_join("x.skeletons", ";").alias("skeletons"), F.array_join("x.unknown", ";").alias("unknown"), "x.bad_link", "x.repeats")


@query(
    "F5_composition_sequence",
    f"""WITH c AS (SELECT p_partkey, p_size AS n, {HEX} AS h FROM part)
SELECT p_partkey, CASE WHEN h > 0 THEN '2,' || (n + h) || '/[axxxxh][uxxxx]/' || repeat('1-', CAST(h AS BIGINT)) || repeat('2-', n - 1) || '2' ELSE '1,' || n || '/[uxxxx]/' || repeat('1-', n - 1) || '1' END AS sequence FROM c""",
)
def f5(t):
    c = f.parse_composition(F.col("text"))
    return compositions(t).select("p_partkey", f.composition_sequence(c, {"Hex": "axxxxh", "HexNAc": "uxxxx"}).alias("sequence"))


@query("F6_fragment_label", "SELECT p_partkey, CAST(p_size + 1 + p_partkey % 2 AS INTEGER) AS number, CASE WHEN p_partkey % 3 = 0 THEN 'y' ELSE 'b' END AS series FROM part")
def f6(t):
    label = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'Y' ELSE 'B' END || '[H' || p_size || 'N' || CASE WHEN p_partkey % 2 = 1 THEN 'F' ELSE '' END || ']'")
    return t.part.select("p_partkey", f.fragment_label(label).alias("x")).select("p_partkey", "x.number", "x.series")


@query("F7_symbol_counts", "SELECT p_partkey, CAST(p_size AS INTEGER) AS H, CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 0 END AS F FROM part")
def f7(t):
    symbol = F.expr("'H' || p_size || CASE WHEN p_partkey % 2 = 1 THEN 'F' ELSE '' END")
    return t.part.select("p_partkey", f.symbol_counts(symbol, "HF").alias("x")).select("p_partkey", "x.H", "x.F")


AMINO_SQL = ", ".join(f"('{k}', {v})" for k, v in f.AMINO.items())


@query(
    "F8_peptide_mass",
    f"""WITH m AS (SELECT * FROM (VALUES {AMINO_SQL}) v(c, mass)), p AS (SELECT p_partkey, upper(regexp_replace(p_name, '[^acdefghiklmnpqrstvwy]', '', 'g')) AS s FROM part), e AS (SELECT p_partkey, unnest(string_split(s, '')) AS c FROM p)
SELECT p_partkey, round(18.01056 + sum(CAST(mass AS DOUBLE)), 5) AS mass FROM e JOIN m USING (c) GROUP BY 1""",
)
def f8(t):
    sequence = F.upper(F.regexp_replace("p_name", "[^acdefghiklmnpqrstvwy]", ""))
    return t.part.select("p_partkey", F.round(f.peptide_mass(sequence), 5).alias("mass"))


@query(
    "F9_peptide_key",
    "SELECT p_partkey, upper(p_type) || '|' || least('G' || p_size, 'G20') || '@N1,' || greatest('G' || p_size, 'G20') || '@N1|15.995@M' || (p_size % 3) AS key, substr(p_type, 1, 1) || '[ox]' || substr(p_type, 2) AS name FROM part",
)
def f9(t):
    g = lambda n: F.struct(F.concat(F.lit("G"), n.cast("string")).alias("acc"), F.lit("N1").alias("site"))
    mods = F.array(F.struct(F.lit(15.9949).alias("delta"), F.concat(F.lit("M"), (F.col("p_size") % 3).cast("string")).alias("site")))
    name = f.peptide_name(F.col("p_type"), F.array(F.struct(F.lit(1).alias("site"), F.lit("ox").alias("text"))))
    return t.part.select("p_partkey", f.peptide_key(F.upper("p_type"), F.array(g(F.col("p_size")), g(F.lit(20))), mods).alias("key"), name.alias("name"))


@query("F10_precursor_mass", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_linenumber - 1.0078 * l_linenumber, 4) AS mass FROM lineitem")
def f10(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(f.precursor_mass(F.col("l_quantity"), F.col("l_linenumber")), 4).alias("mass"))


@query("F11_sequence_hash", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def f11(t):
    return t.documents.select("doc_id", *(f.sequence_hash(F.col("text"), k).alias(k) for k in ("sha256", "md5", "sha1")))


REPAIR_SQL = "text"
for _old, _new in f.REPAIRS:
    REPAIR_SQL = f"replace({REPAIR_SQL}, '{_old}', '{_new}')"


@query("F12_clean_iupac", f"SELECT doc_id, md5({REPAIR_SQL}) AS cleaned FROM (SELECT doc_id, replace(replace(text, 'an', 'α'), 'e ', '(→') AS text FROM documents)")
def f12(t):
    text = F.replace(F.replace("text", F.lit("an"), F.lit("α")), F.lit("e "), F.lit("(→"))
    return t.documents.select("doc_id", F.md5(f.clean_iupac(text)).alias("cleaned"))


@query("F13_normalize_name", "SELECT page_id, lower(regexp_replace(trim(regexp_replace(url, '[/.]', '  ', 'g')), '\\s+', ' ', 'g')) AS name FROM pages")
def f13(t):
    return t.pages.select("page_id", f.normalize_name(F.regexp_replace("url", "[/.]", "  ")).alias("name"))


@query("F14_phred", "SELECT l_orderkey, l_linenumber, round(-10 * log10(greatest(l_discount, 0.001)), 6) AS phred FROM lineitem")
def f14(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(fdr.phred(F.col("l_discount"), 0.001), 6).alias("phred"))


@query("F16_retention_transform", "SELECT event_id, round(value / 60 * 2.5 + 1, 6) AS nrt, round((value - 1) / 2.5 * 60, 6) AS rt, round(1 + (value - 2) * 3 / 4, 6) AS line FROM events")
def f16(t):
    v, lit = F.col("value"), F.lit
    return t.events.select("event_id", F.round(f.retention_nrt(v, lit(2.5), lit(1)), 6).alias("nrt"), F.round(f.retention_rt(v, lit(2.5), lit(1)), 6).alias("rt"), F.round(f.two_point(v, lit(2), lit(1), lit(6), lit(4)), 6).alias("line"))


@query("F17_chance_any", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 12 >= 1 THEN 1.0 ELSE round(1 - pow(1 - l_discount * 12, l_linenumber), 9) END AS chance FROM lineitem")
def f17(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(f.chance_any(F.col("l_discount") * 12, F.col("l_linenumber")), 9).alias("chance"))
