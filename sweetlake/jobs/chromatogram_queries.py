"""Queries on events as chromatograms: series user_id, rt in minutes of the day, intensity value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chromatograms as c
from .registry import Tables, query
from .table_queries import ELEMENT_SQL, elements, text

XIC_SQL = "x AS (SELECT user_id AS series, CAST(event_id AS DOUBLE) / 100 AS rt, value AS int FROM events), a AS (SELECT series, rt AS apex_rt, int AS apex_int FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY int DESC, rt) AS r FROM x) WHERE r = 1)"


def xic(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("series"), (F.col("event_id").cast("double") / 100).alias("rt"), F.col("value").alias("int"))


@query("W10_apex_window", f"WITH {XIC_SQL} SELECT series, rt, int, apex_rt FROM x JOIN a USING (series) WHERE abs(rt - apex_rt) <= 15")
def w10(t):
    return c.apex_window(xic(t), 15).select("series", "rt", "int", "apex_rt")


SLOPE_SQL = f"{XIC_SQL}, s AS (SELECT series, rt, int, apex_rt, apex_int, regr_slope(int, rt) OVER (PARTITION BY series ORDER BY rt ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) / pow(10.0, floor(log10(greatest(apex_int, 1.0)))) AS slope, count(*) OVER (PARTITION BY series ORDER BY rt ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS n FROM x JOIN a USING (series) WHERE abs(rt - apex_rt) <= 15)"


@query("W11_local_slope", f"WITH {SLOPE_SQL} SELECT series, rt, round(slope, 4) + 0.0 AS slope FROM s WHERE n > 1")
def w11(t):
    return c.local_slope(c.apex_window(xic(t), 15)).where("slope is not null").select("series", "rt", (F.round("slope", 4) + 0.0).alias("slope"))


@query(
    "W12_peak_bounds",
    f"WITH {SLOPE_SQL} SELECT series, coalesce(max(rt) FILTER (q AND rt < apex_rt), -1) AS \"left\", coalesce(min(rt) FILTER (q AND rt > apex_rt), -1) AS \"right\" FROM (SELECT *, n > 1 AND abs(slope) < 1.5 AND int <= 0.3 * apex_int AS q FROM s) GROUP BY 1",
)
def w12(t):
    found = c.peak_bounds(c.local_slope(c.apex_window(xic(t), 15)), 1.5, 0.3)
    return found.select("series", *(F.coalesce(x, F.lit(-1.0)).alias(x) for x in ("left", "right")))


@query(
    "W13_rt_neighborhood",
    f"WITH {XIC_SQL}, n AS (SELECT series, count(*) FILTER (abs(rt - apex_rt) <= 2) AS n1, count(*) FILTER (abs(rt - apex_rt) <= 4) AS n2, count(*) FILTER (abs(rt - apex_rt) <= 9) AS n3 FROM x JOIN a USING (series) GROUP BY 1) SELECT series, CASE WHEN n1 >= 8 THEN 2.0 WHEN n2 >= 8 THEN 4.0 WHEN n3 >= 8 THEN 9.0 ELSE -1.0 END::DOUBLE AS width FROM n",
)
def w13(t):
    x = xic(t)
    found = c.rt_neighborhood(x, c.apex(x).select("series", F.col("apex_rt").alias("centre")), [2, 4, 9])
    return found.select("series", F.coalesce("width", F.lit(-1.0)).alias("width"))


#: Tails of the hypergeometric by their definition, for rows of SCORED (n_other, total, _bad, _all and an id k).
SCORE_SQL = """terms AS (SELECT *, unnest(generate_series(greatest(0, total + _bad - _all), least(total, _bad))) AS i FROM scored WHERE total >= 10),
tails AS (SELECT k, coalesce(sum(p) FILTER (i <= n_other), 0) AS low, coalesce(sum(p) FILTER (i >= n_other), 0) AS high FROM (SELECT k, i, n_other,
exp(lgamma(_bad + 1) - lgamma(i + 1) - lgamma(_bad - i + 1) + lgamma(_all - _bad + 1) - lgamma(total - i + 1) - lgamma(_all - _bad - total + i + 1) - lgamma(_all + 1) + lgamma(total + 1) + lgamma(_all - total + 1)) AS p FROM terms) GROUP BY k),
odds AS (SELECT *, CASE WHEN _bad - n_other >= 0 AND _all - total - _bad + n_other >= 0 THEN log2((n_other + 0.5) / (total - n_other + 0.5)) - log2((_bad - n_other + 0.5) / (_all - total - _bad + n_other + 0.5)) END AS lod FROM scored LEFT JOIN tails USING (k))"""
SCORE = "round(CASE WHEN total < 10 THEN NULL WHEN _bad > 0 AND coalesce(lod < 0, true) THEN -10 * log10(greatest(least(low, 1), 1e-100)) ELSE 10 * log10(greatest(least(high, 1), 1e-100)) END, 3)"
SPECIFIC_SQL = f"""{XIC_SQL}, m AS (SELECT series, arg_min(int, rt) AS f, max(int) FILTER (d < 1) AS i, max(int) FILTER (d >= 1 AND d < 6) AS o FROM (SELECT *, round(abs(round(rt, 3) - round(apex_rt, 3)), 6) AS d FROM x JOIN a USING (series)) GROUP BY 1),
found AS (SELECT series, greatest(f, i) AS inside, greatest(f, o) AS outside, round(100 * greatest(f, o) / greatest(f, i), 2) AS percent FROM m)"""


@query("A8_chromatogram_specificity", f"WITH {SPECIFIC_SQL} SELECT *, percent < 50 AS specific FROM found")
def a8(t):
    x = xic(t)
    return c.chromatogram_specificity(x, c.apex(x).select("series", F.col("apex_rt").alias("centre")))


@query(
    "A8_label_rollup",
    f"""WITH {SPECIFIC_SQL}, r AS (SELECT *, 'G' || (series % 7) AS glycan, 'Y' || (series % 11) AS label, percent < 50 AS good FROM found), scored AS (SELECT glycan IS NOT NULL AS by_glycan, glycan, label, row_number() OVER () AS k,
count(*) FILTER (good) AS n_specific, count(*) FILTER (NOT good) AS n_other, count(*) AS total, median(inside) AS inside, median(percent) AS percent, (SELECT count(*) FROM r WHERE NOT good) AS _bad, (SELECT count(*) FROM r) AS _all FROM r WHERE good IS NOT NULL GROUP BY GROUPING SETS ((label), (glycan, label))),
{SCORE_SQL} SELECT by_glycan, glycan, label, n_specific, n_other, total, round(100.0 * n_other / total, 6) AS percent_other, round(inside, 6) AS median_inside, round(percent, 6) AS median_percent, {SCORE} AS score FROM odds""",
)
def a8_labels(t):
    rows = a8(t).withColumns({"glycan": F.concat(F.lit("G"), text(F.col("series") % 7)), "label": F.concat(F.lit("Y"), text(F.col("series") % 11), F.lit("*"))})
    found = c.specificity_by_label(rows, "glycan", "label", "specific", {"median_inside": "inside", "median_percent": "percent"}, background=None)
    numbers = {x: F.round(x, 6) for x in ("percent_other", "median_inside", "median_percent")} | {"score": F.round("score", 3)}
    return found.withColumns(numbers).drop("percent_specific")


@query(
    "U11_fit_peak",
    f"""WITH {XIC_SQL}, p AS (SELECT series, rt, int, avg(rt) OVER (PARTITION BY series) AS mid, max(int) OVER (PARTITION BY series) AS top FROM x JOIN a USING (series) WHERE abs(rt - apex_rt) <= 15 AND int > 0),
q AS (SELECT series, mid, count(DISTINCT rt) AS n, sum(w * x ** 0) AS s0, sum(w * x ** 1) AS s1, sum(w * x ** 2) AS s2, sum(w * x ** 3) AS s3, sum(w * x ** 4) AS s4, sum(w * x ** 0 * ln(int)) AS t0, sum(w * x ** 1 * ln(int)) AS t1, sum(w * x ** 2 * ln(int)) AS t2 FROM (SELECT *, rt - mid AS x, (int / top) ** 2 AS w FROM p) GROUP BY 1, 2),
f AS (SELECT series, mid, (t2 * (s2 * s0 - s1 * s1) - s3 * (t1 * s0 - s1 * t0) + s2 * (t1 * s1 - s2 * t0)) / d AS a, (s4 * (t1 * s0 - s1 * t0) - t2 * (s3 * s0 - s1 * s2) + s2 * (s3 * t0 - t1 * s2)) / d AS b, (s4 * (s2 * t0 - t1 * s1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2)) / d AS c FROM (SELECT *, (s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2)) AS d FROM q WHERE n >= 4) WHERE d <> 0),
g AS (SELECT series, mid - b / (2 * a) AS apex, 6 * sqrt(-1 / (2 * a)) AS width, exp(least(700, c - b * b / (4 * a))) AS height FROM f WHERE a < 0)
SELECT series, round(apex, 4) AS apex, round(width, 4) AS width, round(height, 3) AS height, round(height * width / 6 * sqrt(2 * pi()), 3) AS area, round(coalesce(corr(height * exp(-18 * ((rt - apex) / width) ** 2), int), 0), 4) AS r FROM p JOIN g USING (series) WHERE width <= 100 GROUP BY series, apex, width, height""",
)
def u11(t):
    found = c.fit_peak(c.apex_window(xic(t), 15), 100)
    return found.withColumns({x: F.round(x, n) for x, n in (("apex", 4), ("width", 4), ("height", 3), ("area", 3), ("r", 4))})


@query("U8_robust_fit")
def u8(t):
    return c.robust_fit(t.lineitem, "l_suppkey", "l_quantity", "l_extendedprice", good=0.9)


@query(
    "U9_binom_tail",
    """WITH k AS (SELECT l_suppkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS x FROM lineitem GROUP BY 1), i AS (SELECT k, n, x, unnest(generate_series(x, n)) AS i FROM k)
SELECT k, round(least(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.3) + (n - i) * ln(0.7)))), 8) AS tail FROM i GROUP BY 1""",
)
def u9(t):
    k = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("x"))
    return k.select("k", F.round(c.binom_tail("x", "n", F.lit(0.3)), 8).alias("tail"))


@query(
    "U9_hypergeom_tail",
    """WITH k AS (SELECT l_suppkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS x, count(*) FILTER (l_returnflag = 'R') AS g, count(*) FILTER (l_linestatus = 'F') AS m FROM lineitem GROUP BY 1), i AS (SELECT *, unnest(generate_series(greatest(x, m + g - n, 0), least(g, m))) AS i FROM k)
SELECT k, round(least(1.0, sum(exp(lgamma(g + 1) - lgamma(i + 1) - lgamma(g - i + 1) + lgamma(n - g + 1) - lgamma(m - i + 1) - lgamma(n - g - m + i + 1) - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1)))), 8) AS tail FROM i GROUP BY 1""",
)
def u9_hypergeom(t):
    r, f = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    k = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(r & f).alias("x"), F.count_if(r).alias("g"), F.count_if(f).alias("m"))
    return k.select("k", F.round(c.hypergeom_tail("x", "n", "g", "m"), 8).alias("tail"))


@query(
    "U10_poisson_binomial_tail",
    "SELECT l_orderkey AS id, round(1 - exp(sum(ln(1 - l_discount))) + 1e-12, 8) AS tail, round(1 - exp(sum(ln(1 - l_discount))) * (1 + sum(l_discount / (1 - l_discount))) + 1e-12, 8) AS two FROM lineitem GROUP BY 1",
)
def u10(t):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_discount").alias("p"))
    return rows.select("id", *(F.round(c.poisson_binomial_tail("p", F.lit(k)) + 1e-12, 8).alias(name) for k, name in ((1, "tail"), (2, "two"))))


#: Natural chances of extra neutrons.
ISOTOPES = {"C": [0.9893, 0.0107], "H": [0.999885, 0.000115], "N": [0.99636, 0.00364], "O": [0.99757, 0.00038, 0.00205]}


@query(
    "U7_isotope_pattern",
    f"""WITH {ELEMENT_SQL}, r AS (SELECT acc, n, CASE element WHEN 'C' THEN 0.0107 / 0.9893 WHEN 'H' THEN 0.000115 / 0.999885 WHEN 'N' THEN 0.00364 / 0.99636 ELSE 0.00038 / 0.99757 END::DOUBLE AS a, CASE WHEN element = 'O' THEN 0.00205 / 0.99757 ELSE 0 END::DOUBLE AS b FROM el)
SELECT acc, round(sum(n * a), 6) AS first, round(sum(n * b) + (sum(n * a) ** 2 - sum(n * a * a)) / 2, 6) AS second FROM r GROUP BY acc""",
)
def u7(t):
    found = c.isotope_pattern(elements(t), ISOTOPES, cutoff=0)
    return found.select("acc", *(F.round(F.col("pattern")[k] / F.col("pattern")[0], 6).alias(name) for k, name in ((1, "first"), (2, "second"))))


@query("A23_phenotype_enrichment")
def a23(t):
    residues = t.lineitem.select((F.col("l_suppkey") % 20).alias("motif"), F.col("l_orderkey").alias("rid"))
    genes = t.lineitem.select(F.col("l_orderkey").alias("rid"), text(F.col("l_partkey") % 400).alias("gene"))
    pheno = t.part.select(text(F.col("p_partkey") % 400).alias("gene"), F.col("p_brand").alias("phenotype")).distinct()
    return c.phenotype_enrichment(residues, genes, pheno, 3)


@query("A16_formula_check", f"WITH {ELEMENT_SQL} SELECT acc, element, n FROM el")
def a16_elements(t):
    return elements(t).where("n is not null")


