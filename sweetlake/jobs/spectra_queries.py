"""Queries on lineitem, part and events as scored results, libraries and series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fdr, library, models
from ..operators.chromatograms import specificity_by_label
from .chromatogram_queries import SCORE, SCORE_SQL
from .registry import Tables, query
from .table_queries import text

TIES = ["l_orderkey", "l_linenumber"]
SCORED_SQL = """
scored AS (SELECT l_partkey AS grp, l_extendedprice AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS decoy, l_orderkey, l_linenumber FROM lineitem),
best AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, l_orderkey, l_linenumber) AS r FROM scored) WHERE r = 1),
by_score AS (SELECT score, count(*) FILTER (decoy = 0) AS t, count(*) FILTER (decoy = 1) AS d FROM best GROUP BY score),
cum AS (SELECT score, CAST(sum(t) OVER (ORDER BY score DESC) AS BIGINT) AS targets, CAST(sum(d) OVER (ORDER BY score DESC) AS BIGINT) AS decoys FROM by_score),
points AS (SELECT score, targets, CASE WHEN targets > 0 THEN decoys::DOUBLE / 1 / targets END AS fdr FROM cum),
worse AS (SELECT *, coalesce(min(fdr) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS least FROM points),
curve AS (SELECT score, fdr, targets FROM worse WHERE fdr < least AND fdr < 1)
"""


def scored(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_partkey").alias("grp"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("decoy"), *TIES
    )


def best(t: Tables) -> DataFrame:
    return fdr.best_per_group(scored(t), ["grp"], "score", TIES)


@query("W1_best_per_group", f"WITH {SCORED_SQL} SELECT grp, score, decoy, l_orderkey, l_linenumber FROM best")
def w1(t):
    return best(t)


@query("W2_passing", f"WITH {SCORED_SQL} SELECT grp, score, decoy, l_orderkey, l_linenumber FROM best WHERE decoy = 0 AND score >= 90000")
def w2(t):
    return fdr.passing(scored(t), 90000, ["grp"], "score", TIES)


@query("A13_fdr_curve", f"WITH {SCORED_SQL} SELECT score, round(fdr, 9) AS fdr, targets FROM curve")
def a13(t):
    return fdr.fdr_curve(best(t)).select("score", F.round("fdr", 9).alias("fdr"), "targets")


QVALUE = "coalesce((SELECT min(fdr) FROM curve WHERE curve.score <= best.score), 1.0)"


@query("A14_assign_qvalue", f"WITH {SCORED_SQL} SELECT grp, score, decoy, round({QVALUE}, 9) AS qvalue FROM best")
def a14(t):
    b = best(t)
    return fdr.assign_qvalue(b, fdr.fdr_curve(b)).select("grp", "score", "decoy", F.round("qvalue", 9).alias("qvalue"))


@query(
    "A14_score_at",
    f"WITH {SCORED_SQL} SELECT coalesce((SELECT min(score) FROM curve WHERE fdr < 0.4), (SELECT max(score) FROM curve)) AS score, (SELECT count(*) FROM best WHERE decoy = 0 AND score >= 95000) AS targets",
)
def a14_scalars(t):
    b = best(t)
    return fdr.score_at(fdr.fdr_curve(b), 0.4).join(F.broadcast(fdr.targets_at(b, 95000)))


@query(
    "A15_separate_fdr",
    """WITH s AS (SELECT l_extendedprice AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS decoy FROM lineitem WHERE l_linestatus = 'F' OR l_returnflag = 'R'),
by_score AS (SELECT score, count(*) FILTER (decoy = 0) AS t, count(*) FILTER (decoy = 1) AS d FROM s GROUP BY score),
cum AS (SELECT score, CAST(sum(t) OVER (ORDER BY score DESC) AS BIGINT) AS targets, CAST(sum(d) OVER (ORDER BY score DESC) AS BIGINT) AS decoys FROM by_score),
points AS (SELECT score, targets, CASE WHEN targets > 0 THEN decoys::DOUBLE / 2 / targets END AS fdr FROM cum),
worse AS (SELECT *, coalesce(min(fdr) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS least FROM points)
SELECT score, round(fdr, 9) AS fdr, targets FROM worse WHERE fdr < least AND fdr < 1""",
)
def a15(t):
    rows = t.lineitem.select(F.col("l_extendedprice").alias("score"), "l_returnflag", "l_linestatus")
    decoys = rows.where("l_returnflag = 'R'")
    halves = [decoys.where("l_linestatus = 'F'"), decoys.where("l_linestatus <> 'F'")]
    return fdr.separate_fdr(rows.where("l_linestatus = 'F' and l_returnflag <> 'R'"), halves).select("score", F.round("fdr", 9).alias("fdr"), "targets")


@query(
    "W6_bh_fdr",
    """WITH p AS (SELECT l_suppkey AS id, count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*) AS p FROM lineitem GROUP BY 1),
r AS (SELECT id, p, count(*) OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM p),
raw AS (SELECT *, least(1.0, p * n / k) AS raw FROM r)
SELECT id, round(p, 9) AS p, round(min(raw) OVER (ORDER BY p DESC), 9) AS bh, round(least(1.0, p * n), 9) AS bonferroni FROM raw""",
)
def w6(t):
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("p"))
    both = fdr.bonferroni(fdr.bh_fdr(p))
    return both.select("id", *(F.round(c, 9).alias(c) for c in ("p", "bh", "bonferroni")))


MEDIANS_SQL = "medians AS (SELECT l_partkey AS pep, l_linenumber % 3 AS z1, l_suppkey AS tr, median(l_quantity) AS intensity FROM lineitem WHERE l_discount > 0 GROUP BY ALL)"


def medians(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_partkey").alias("pep"), (F.col("l_linenumber") % 3).alias("z1"), F.col("l_suppkey").alias("tr"), "l_quantity", F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("nrt")
    )
    return library.transition_medians(rows, ["pep", "z1", "tr"], "l_quantity", "nrt")


@query("A3_transition_medians", f"WITH {MEDIANS_SQL} SELECT pep, z1, tr, round(intensity, 6) AS intensity FROM medians")
def a3(t):
    return medians(t).withColumn("intensity", F.round("intensity", 6))


@query(
    "A4_peptide_nrt",
    """SELECT l_partkey AS pep_id, round(median(l_discount), 6) AS nrt, count(*) AS nobs FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""",
)
def a4(t):
    tgs = t.lineitem.select(F.col("l_partkey").alias("pep_id"), F.col("l_orderkey").alias("tg_id"), F.col("l_discount").alias("nrt"))
    bad = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("tg_id"))
    return library.peptide_nrt(tgs, bad).withColumn("nrt", F.round("nrt", 6))


LIBRARY_SQL = f"""{MEDIANS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY pep, z1 ORDER BY intensity DESC, tr) AS rank, max(intensity) OVER (PARTITION BY pep, z1) AS top FROM medians),
whole AS (SELECT *, max(CASE WHEN rank = 4 THEN intensity END) OVER (PARTITION BY pep, z1) AS nth FROM ranked),
lib AS (SELECT pep, z1, tr, intensity, CAST(rank AS INTEGER) AS rank, CAST(round(1000 * intensity / top) AS INTEGER) AS relative FROM whole WHERE nth >= 0.1 * top AND rank <= 10)"""


@query("W3_transition_library", f"WITH {LIBRARY_SQL} SELECT * REPLACE (round(intensity, 6) AS intensity) FROM lib")
def w3(t):
    return library.transition_library(medians(t), ["pep", "z1"], "tr").withColumn("intensity", F.round("intensity", 6))


@query(
    "W4_add_decoys",
    f"""WITH {LIBRARY_SQL}, d AS (SELECT 0 AS i, 0.0::DOUBLE AS shift UNION ALL SELECT 1, 5.5 UNION ALL SELECT 2, -7.25)
SELECT CASE WHEN i > 0 THEN 'DECOY' || i || '_' || pep ELSE CAST(pep AS VARCHAR) END AS name, z1, rank, round(pep + shift, 6) AS mz1, round(tr + shift, 6) AS mz2, CAST(i > 0 AS INTEGER) AS decoy FROM lib, d""",
)
def w4(t):
    lib = library.transition_library(medians(t), ["pep", "z1"], "tr")
    rows = lib.select(F.col("pep").cast("string").alias("name"), "z1", "rank", F.col("pep").cast("double").alias("mz1"), F.col("tr").cast("double").alias("mz2"))
    return library.add_decoys(rows, [5.5, -7.25], ["mz1", "mz2"], "name").withColumns({c: F.round(c, 6) for c in ("mz1", "mz2")})


@query(
    "W5_relative_area",
    "SELECT l_orderkey, l_linenumber, l_suppkey, round(1000 * l_quantity / max(l_quantity) OVER (PARTITION BY l_partkey, l_linenumber % 3), 6) AS relative_area FROM lineitem",
)
def w5(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", (F.col("l_linenumber") % 3).alias("z1"), "l_quantity")
    return library.relative_area(rows, ["l_partkey", "z1"], "l_quantity").select("l_orderkey", "l_linenumber", "l_suppkey", F.round("relative_area", 6).alias("relative_area"))


CONFUSABLE_SQL = """p AS (SELECT p_partkey AS key, p_retailprice AS prod, CAST(p_size AS DOUBLE) AS nrt, CAST(p_partkey % 100 AS DOUBLE) AS prec, p_brand, p_type FROM part),
n AS (SELECT a.key, count(b.key) AS n FROM p a LEFT JOIN p b ON a.key <> b.key AND abs(a.prod - b.prod) < 2.05 AND abs(a.nrt - b.nrt) < 3 AND abs(a.prec - b.prec) < 30 GROUP BY 1)"""


def confusable(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("prod"), F.col("p_size").cast("double").alias("nrt"), (F.col("p_partkey") % 100).cast("double").alias("prec"))
    return library.confusable_transitions(rows, "key", {"prod": 2.05, "nrt": 3, "prec": 30})


@query("J11_confusable_transitions", f"WITH {CONFUSABLE_SQL} SELECT key, n FROM n")
def j11(t):
    return confusable(t)


@query(
    "A7_label_specificity",
    f"""WITH {CONFUSABLE_SQL}, s AS (SELECT p.p_type AS glycan, p.p_brand || '*' AS label, n.n = 0 AS good FROM p JOIN n USING (key)), scored AS (SELECT grouping(glycan) = 0 AS by_glycan, glycan, label, row_number() OVER () AS k,
count(*) FILTER (good) AS n_specific, count(*) FILTER (NOT good) AS n_other, count(*) AS total, (SELECT CAST(floor(0.13 * count(*) + 0.5) AS BIGINT) FROM s) AS _bad, (SELECT count(*) FROM s) AS _all FROM s GROUP BY GROUPING SETS ((label), (glycan, label))),
{SCORE_SQL} SELECT by_glycan, glycan, label, n_specific, n_other, total, round(100.0 * n_specific / total, 6) AS percent_specific, round(100.0 * n_other / total, 6) AS percent_other, {SCORE} AS score FROM odds""",
)
def a7(t):
    tr = t.part.select(F.col("p_partkey").alias("key"), F.concat("p_brand", F.lit("**")).alias("label"), F.col("p_type").alias("glycan"))
    tr = tr.join(confusable(t), "key").withColumn("specific", F.col("n") == 0)
    found = specificity_by_label(tr, "glycan", "label", "specific")
    return found.withColumns({x: F.round(x, 6) for x in ("percent_specific", "percent_other")} | {"score": F.round("score", 3)})


@query(
    "A5_library_stats",
    """SELECT count(DISTINCT l_suppkey) AS proteins, count(DISTINCT l_partkey % 97) AS glycans, count(DISTINCT (l_suppkey, l_linenumber)) AS sites,
count(DISTINCT (l_suppkey, l_linenumber, l_partkey % 97)) AS site_glycans, count(DISTINCT l_partkey) AS glycopeptides FROM lineitem""",
)
def a5(t):
    rows = t.lineitem.select("l_suppkey", (F.col("l_partkey") % 97).alias("glycan"), "l_linenumber", "l_partkey")
    return library.library_stats(rows, "l_suppkey", "glycan", "l_linenumber", "l_partkey")


@query(
    "A6_glycosites",
    """WITH p AS (SELECT l_partkey AS pep, min(l_suppkey % 40) AS g, list(DISTINCT {'protein': 'Q' || (l_suppkey % 300), 'site': ['N', 'S', 'T', 'X'][1 + l_linenumber % 4] || (l_linenumber * 10)}) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
g AS (SELECT i AS acc, CASE WHEN i % 3 = 0 THEN '' WHEN i % 3 = 1 THEN 'HexNAc' || i || 'Hex5' ELSE 'HexNAc' || i END AS composition, CASE WHEN i % 5 > 0 THEN 'N-linked' END AS class FROM range(40) t(i)),
s AS (SELECT DISTINCT l_partkey AS pep FROM lineitem WHERE l_linestatus = 'F'), r AS (SELECT a[1].protein AS protein, CAST(substr(a[1].site, 2) AS INTEGER) AS position, CASE substr(a[1].site, 1, 1) WHEN 'N' THEN 'Asn' WHEN 'S' THEN 'Ser' WHEN 'T' THEN 'Thr' END AS amino_acid, acc AS glycan, composition, class, a[1].protein || '@' || a[1].site AS site, pep
FROM p JOIN s USING (pep) JOIN g ON g.acc = p.g WHERE len(a) = 1 AND class IS NOT NULL) SELECT * EXCLUDE (pep), string_agg(pep::VARCHAR, ',' ORDER BY pep::VARCHAR) AS peptides FROM r GROUP BY ALL""",
)
def a6(t):
    place = F.struct(F.concat(F.lit("Q"), text(F.col("l_suppkey") % 300)).alias("protein"), F.concat(F.get(F.array(*map(F.lit, "NSTX")), (F.col("l_linenumber") % 4).cast("int")), text(F.col("l_linenumber") * 10)).alias("site"))
    peptides = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("pep_id")).agg(F.min(F.col("l_suppkey") % 40).alias("glycan"), F.collect_set(place).alias("alignments"))
    tgs = t.lineitem.select(F.col("l_partkey").alias("peptide"), F.col("l_linestatus").alias("sample"))
    i = F.col("acc")
    two = F.concat(F.lit("HexNAc"), text(i))
    names = F.when(i % 3 == 0, F.array(F.lit("FucHexNAc2"))).when(i % 3 == 1, F.array(F.lit("Hex5"), F.concat(two, F.lit("Hex5")), F.lit("HexNAc9"))).otherwise(F.array(F.lit("HexNAc1Fuc1"), two))
    keys = t.lineitem.select((F.col("l_suppkey") % 40).alias("acc")).distinct()
    glycans = keys.select("acc", names.alias("names"), F.when(i % 5 > 0, F.array(F.lit("N-linked"))).otherwise(F.array(F.lit("N-linked"), F.lit("O-linked"))).alias("classes"))
    return library.glycosites(tgs, peptides, glycans, t.lineitem.where("l_linestatus = 'F'").select(F.col("l_linestatus").alias("sample")))


@query(
    "A31_dia_calibration",
    """WITH d AS (SELECT o_custkey AS spectra, o_orderkey AS name, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 7) || '.5:' || (o_orderkey % 11) END AS c FROM orders)
SELECT spectra, CAST(split_part(arg_min(c, name), ':', 1) AS DOUBLE) AS slope, CAST(split_part(arg_min(c, name), ':', 2) AS DOUBLE) AS intercept FROM d WHERE c IS NOT NULL GROUP BY 1""",
)
def a31_calibration(t):
    k = F.col("o_orderkey")
    return library.dia_calibration(t.orders.select(F.col("o_custkey").alias("spectra"), k.alias("name"), F.when(k % 3 > 0, F.concat(text(k % 7), F.lit(".5:"), text(k % 11))).alias("lccalibration")))


@query(
    "A31_dia_groups",
    """WITH f AS (SELECT l_orderkey, l_suppkey, 100.0::DOUBLE * l_quantity / max(l_quantity) OVER (PARTITION BY l_orderkey) AS i FROM lineitem)
SELECT l_orderkey, count(*) AS n, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY i DESC, l_suppkey) AS ids, CAST(round(sum(i), 4) AS DOUBLE) AS total FROM f WHERE i > 0 GROUP BY 1""",
)
def a31(t):
    g = library.dia_groups(t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity"), ["l_orderkey"], "l_suppkey", "l_quantity")
    total = F.aggregate("transitions", F.lit(0.0), lambda s, x: s + x["intensity"])
    return g.select("l_orderkey", "n", F.array_join(F.transform("transitions", lambda x: x["id"].cast("string")), ",").alias("ids"), F.round(total, 4).alias("total"))


@query(
    "J21_transition_groups",
    """WITH pep AS (SELECT p_name || '/' || p_size AS key, min(p_partkey) AS pep FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1),
r AS (SELECT DISTINCT pep, l_linenumber % 3 AS z1, l_orderkey % 5 AS spectra, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN pep ON pep.key = p_name || '/' || p_size)
SELECT pep, z1, spectra, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS ids FROM r GROUP BY 1, 2, 3""",
)
def j21(t):
    key = F.concat_ws("/", "p_name", F.col("p_size").cast("string"))
    peptides = t.part.select(key.alias("key"), F.col("p_partkey").alias("pep"))
    rows = t.lineitem.join(t.part.select("p_partkey", key.alias("key")), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("key", (F.col("l_linenumber") % 3).alias("z1"), (F.col("l_orderkey") % 5).alias("spectra"), "l_suppkey")
    g = library.transition_groups(rows, peptides, "key", "pep", ["z1", "spectra"], ["l_suppkey"])
    return g.select("pep", "z1", "spectra", "n", F.array_join(F.transform("transitions", lambda x: x["l_suppkey"].cast("string")), ",").alias("ids"))


@query("U12_retention_model")
def u12(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("pep"), F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("c"), (F.col("l_extendedprice") / 1000).alias("rt"))
    fitted, _ = models.retention_model(rows, "pep", "rt", ["a", "c"], threshold=40)
    return fitted.select("l_orderkey", "l_linenumber", "fitted", "residual", "good")


@query("U12_retention_runs")
def u12_runs(t):
    """Two runs from the fit of each peptide's mean value."""
    group = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tg")
    rows = t.lineitem.select(group, F.col("l_suppkey").alias("seq"), F.col("l_partkey").alias("pep"), (F.col("l_discount") * 100).cast("int").alias("c"), F.col("l_quantity").cast("double").alias("n"), (F.col("l_extendedprice") / 1000).cast("double").alias("rt"))
    rows, names = models.with_categories(rows, ["c"])
    xs = [*names, "n"]
    known = rows.groupBy("seq", "pep").agg(*(F.avg(c).alias(c) for c in (*xs, "rt")))
    best, _ = models.retention_runs(rows, "tg", "seq", "pep", "rt", xs, known, threshold=40, choose=50_000, runs=2, seed=1)
    return best.select("tg", "run", "fitted", "residual", "good")


@query("U13_lattice_fdr")
def u13(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("s1"), F.col("l_quantity").alias("s2"), (F.col("l_returnflag") == "R").cast("int").alias("decoy"))
    return models.assign_lattice_fdr(rows, models.lattice_fdr(rows, ["s1", "s2"]))


@query("U13_lattice_fdr_of_one_score", f"WITH {SCORED_SQL} SELECT grp, score, decoy, round({QVALUE}, 9) AS fdr FROM best")
def u13_one(t):
    """A lattice of one score, with a step for each point of its curve, gives q-values."""
    b = best(t)
    return models.assign_lattice_fdr(b, models.lattice_fdr(b, ["score"], points=5_000)).select("grp", "score", "decoy", F.round("fdr", 9).alias("fdr"))
