"""Chromatogram series (series, rt, int): windows, slopes, bounds, peak and retention fits, exact tails."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .ordered import with_position
from .stats import lod


def apex(xic: DataFrame, series: str = "series") -> DataFrame:
    """(series, apex_rt, apex_int): the most intense point, ties to the earliest; combined before the shuffle."""
    best = F.max_by(F.struct("rt", "int"), F.struct("int", -F.col("rt")))
    return xic.groupBy(series).agg(best.alias("a")).select(series, F.col("a.rt").alias("apex_rt"), F.col("a.int").alias("apex_int"))


def apex_window(xic: DataFrame, half: float = 1.5, series: str = "series") -> DataFrame:
    """Points within `half` of the most intense point, with the apex."""
    return xic.join(apex(xic, series), series).where(F.abs(F.col("rt") - F.col("apex_rt")) <= half)


def local_slope(windowed: DataFrame, before: int = 0, after: int = 4, series: str = "series") -> DataFrame:
    """Least-squares slope over neighbouring points, scaled by the apex's order of magnitude.

    Moments are taken about running means, point by point, so late times cancel nothing."""
    w = Window.partitionBy(series).orderBy("rt").rowsBetween(-before, after)
    x, y = F.col("rt").cast("double"), F.col("int").cast("double")
    points = F.collect_list(F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))).over(w)

    def add(s: Column, p: Column) -> Column:
        n = s["n"] + 1
        mx, my = s["mx"] + (p["x"] - s["mx"]) / n, s["my"] + (p["y"] - s["my"]) / n
        return F.struct(n.alias("n"), mx.alias("mx"), my.alias("my"), (s["xy"] + (p["x"] - s["mx"]) * (p["y"] - my)).alias("xy"), (s["xx"] + (p["x"] - mx) * (p["x"] - s["mx"])).alias("xx"))

    start = F.struct(*(F.lit(0.0).alias(c) for c in ("n", "mx", "my", "xy", "xx")))
    slope = F.aggregate(points, start, add, lambda s: F.when(s["xx"] > 0, s["xy"] / s["n"] / (s["xx"] / s["n"])))
    return windowed.withColumn("slope", slope / F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(F.col("apex_int"), F.lit(1.0))))))


def peak_bounds(sloped: DataFrame, flat: float = 0.1, low: float = 0.2, series: str = "series") -> DataFrame:
    """(series, left, right): the last flat low point before the apex and the first after it."""
    quiet = (F.abs("slope") < flat) & (F.col("int") <= low * F.col("apex_int"))
    return sloped.groupBy(series).agg(
        F.max(F.when(quiet & (F.col("rt") < F.col("apex_rt")), F.col("rt"))).alias("left"), F.min(F.when(quiet & (F.col("rt") > F.col("apex_rt")), F.col("rt"))).alias("right")
    )


def rt_neighborhood(xic: DataFrame, centres: DataFrame, widths: list[float], least: int = 8, series: str = "series") -> DataFrame:
    """(series, width): the narrowest window around each centre (series, centre) with at least `least` points; null if none."""
    near = lambda w: F.count_if(F.abs(F.col("rt") - F.col("centre")) <= w)
    counted = xic.join(centres, series).groupBy(series).agg(F.array(*(F.struct(F.lit(float(w)).alias("w"), near(w).alias("n")) for w in widths)).alias("c"))
    return counted.select(series, F.get(F.filter("c", lambda x: x["n"] >= least), F.lit(0))["w"].alias("width"))


def chromatogram_specificity(xic: DataFrame, centres: DataFrame, inner: float = 1, outer: float = 6, threshold: float = 50, series: str = "series") -> DataFrame:
    """(series, inside, outside, percent, specific): the largest points nearer than `inner`, and from there to below `outer`.

    The first point of a series starts both maxima; times are rounded to 3 decimals, percent to 2.  A fragment is
    specific where the outside is below `threshold` percent of the inside; an inside of 0 has neither (null)."""
    joined = xic.join(centres, series)
    d = F.round(F.abs(F.round("rt", 3) - F.round("centre", 3)), 6)
    found = joined.groupBy(series).agg(
        F.min_by("int", "rt").alias("first"), F.max(F.when(d < inner, F.col("int"))).alias("i"), F.max(F.when((d >= inner) & (d < outer), F.col("int"))).alias("o")
    )
    inside, outside = F.greatest("first", "i"), F.greatest("first", "o")
    pct = F.when(inside != 0, F.round(100 * outside / inside, 2))
    return found.select(series, inside.alias("inside"), outside.alias("outside"), pct.alias("percent"), (pct < threshold).alias("specific"))


def fit_peak(windowed: DataFrame, widest: float = 3.5, series: str = "series") -> DataFrame:
    """(series, apex, width, height, area, r): Gaussian by the parabola of log intensity, with intensities as weights; width is
    6 sigma, and peaks wider than `widest`, not concave or of fewer than 4 times are left out.  r is the correlation of
    model and intensities, 0 where either is constant.

    A parabola's sums are those of eight products, so points are summed where they lie, and a series of any size is a row."""
    points = windowed.where("int > 0").select(series, F.col("rt").cast("double").alias("rt"), F.col("int").cast("double").alias("int"))
    middle = points.groupBy(series).agg(F.avg("rt").alias("_mid"), F.max("int").alias("_max"), F.count_distinct("rt").alias("_n")).where("_n >= 4").drop("_n")
    x, w = F.col("rt") - F.col("_mid"), F.pow(F.col("int") / F.col("_max"), 2)
    powers = [F.sum(w * F.pow(x, F.lit(k))).alias(f"_s{k}") for k in range(5)] + [F.sum(w * F.pow(x, F.lit(k)) * F.log("int")).alias(f"_t{k}") for k in range(3)]
    sums = points.join(middle, series).groupBy(series, "_mid").agg(*powers)
    s, t = [F.col(f"_s{k}") for k in range(5)], [F.col(f"_t{k}") for k in range(3)]

    def det(m: list[list[Column]]) -> Column:
        (a, b, c), (d, e, f), (g, h, i) = m
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    rows = [[s[4], s[3], s[2]], [s[3], s[2], s[1]], [s[2], s[1], s[0]]]
    right = [t[2], t[1], t[0]]
    whole = det(rows)
    a, b, c = (F.try_divide(det([[right[j] if k == m else rows[j][k] for k in range(3)] for j in range(3)]), whole) for m in range(3))
    found = sums.select(series, "_mid", a.alias("_a"), b.alias("_b"), c.alias("_c")).where("_a < 0")
    sigma = F.sqrt(-1 / (2 * F.col("_a")))
    height = F.exp(F.least(F.lit(700.0), F.col("_c") - F.col("_b") * F.col("_b") / (4 * F.col("_a"))))
    fits = found.select(series, (F.col("_mid") - F.col("_b") / (2 * F.col("_a"))).alias("apex"), (6 * sigma).alias("width"), height.alias("height")).where(F.col("width") <= widest)
    model = F.col("height") * F.exp(-18 * F.pow((F.col("rt") - F.col("apex")) / F.col("width"), 2))
    near = points.join(fits, series).groupBy(series, "apex", "width", "height").agg(F.corr(model, "int").alias("r"))
    r = F.when(F.col("r").isNull() | F.isnan("r"), 0.0).otherwise(F.col("r"))
    return near.select(series, "apex", "width", "height", (F.col("height") * F.col("width") / 6 * math.sqrt(2 * math.pi)).alias("area"), r.alias("r"))


def robust_fit(points: DataFrame, key: str, x: str, y: str, good: float = 0.99, least: float = 0.5, most: int = 20) -> DataFrame:
    """(key, slope, intercept, r, n, removed): the point of the largest residual goes until r exceeds `good`.

    A key fails, with null results, below three points, after `most` removals, or where r starts below `least`.
    The points of a key, two numbers each, must fit a task."""

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna()
        xs, ys = p["x"].to_numpy(float), p["y"].to_numpy(float)
        order = np.lexsort((ys, xs))
        xs, ys, removed, result = xs[order], ys[order], 0, (None, None, None)
        while len(xs) >= 3 and xs.std() > 0 and ys.std() > 0 and removed <= most:
            slope, intercept = np.polyfit(xs, ys, 1)
            r = float(np.corrcoef(xs, ys)[0, 1])
            if removed == 0 and abs(r) < least:
                break
            if abs(r) > good:
                result = (float(slope), float(intercept), r)
                break
            keep = np.arange(len(xs)) != np.abs(ys - slope * xs - intercept).argmax()
            xs, ys, removed = xs[keep], ys[keep], removed + 1
        return pd.DataFrame({"key": p["key"].iloc[:1].tolist(), "slope": [result[0]], "intercept": [result[1]], "r": [result[2]], "n": [len(xs)], "removed": [removed]}) if len(p) else pd.DataFrame(columns=["key", "slope", "intercept", "r", "n", "removed"])

    rows = points.select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return rows.groupBy("key").applyInPandas(fit, "key string, slope double, intercept double, r double, n long, removed int")


def _stirling_rest(n: float) -> float:
    """log n! less its Stirling approximation."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n > 0 else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where both are near."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, j = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        if (now := total + term / (2 * j + 1)) == total:
            return total
        total, j = now, j + 1


def _log_binomial(x: int, n: int, p: float) -> float:
    """Log of the chance of x hits in n trials, by deviances, so that its error does not grow with n."""
    if p in (0.0, 1.0):
        return 0.0 if x == n * p else -math.inf
    if x in (0, n):
        return n * (math.log1p(-p) if x == 0 else math.log(p))
    rest = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return rest + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def _summed(log_first: float, ratio, i: int, end: int, step: int) -> float:
    """The chance of i and of what follows it up to `end`, by the ratios of neighbouring chances, which fall: terms
    are taken until they add nothing, some standard deviations, however large the counts are."""
    total, last, size = 1.0, 1.0, 64
    while i != end and last > 1e-18 * total:
        k = np.arange(i, end, step)[:size] if abs(end - i) <= size else np.arange(i, i + step * size, step)
        terms = last * np.cumprod(ratio(k.astype(float)))
        total, last, i, size = total + float(terms.sum()), float(terms[-1]), i + step * len(k), min(2 * size, 1 << 14)
    return math.exp(log_first + math.log(total))


def _tails(x: int, lo: int, hi: int, mode: int, log_chance, up, down) -> tuple[float, float]:
    """P(X <= x) and P(X >= x); the tail away from the mode is summed, the other is its complement."""
    if x < lo or x > hi:
        return (0.0, 1.0) if x < lo else (1.0, 0.0)
    if x <= mode:
        low = _summed(log_chance(x), down, x, lo, -1)
        return min(1.0, low), 1.0 if x == lo else max(0.0, 1 - low + math.exp(log_chance(x)))
    high = _summed(log_chance(x), up, x, hi, 1)
    return 1.0 if x == hi else max(0.0, 1 - high + math.exp(log_chance(x))), min(1.0, high)


def hypergeom_tails(x: int, total: int, good: int, drawn: int) -> tuple[float, float]:
    """P(X <= x) and P(X >= x) of x good ones among `drawn` of `total`."""
    n, g, m = int(total), int(good), int(drawn)
    p = m / n if n else 0.0

    def log_chance(i: int) -> float:
        return _log_binomial(i, g, p) + _log_binomial(m - i, n - g, p) - _log_binomial(m, n, p)

    up = lambda i: (g - i) * (m - i) / ((i + 1) * (n - g - m + i + 1))
    down = lambda i: i * (n - g - m + i) / ((g - i + 1) * (m - i + 1))
    return _tails(int(x), max(0, m + g - n), min(g, m), (g + 1) * (m + 1) // (n + 2), log_chance, up, down)


def binom_tails(x: int, n: int, p: float) -> tuple[float, float]:
    """P(X <= x) and P(X >= x) of n draws at chance p."""
    x, n = int(x), int(n)
    if p <= 0 or p >= 1:
        certain = n if p >= 1 else 0
        return float(certain <= x), float(certain >= x)
    up = lambda i: (n - i) / (i + 1) * (p / (1 - p))
    down = lambda i: i / (n - i + 1) * ((1 - p) / p)
    return _tails(x, 0, n, int((n + 1) * p), lambda i: _log_binomial(i, n, p), up, down)


def _each(tails, side: int, *columns: pd.Series) -> pd.Series:
    """One tail of each row; equal rows are worked out once, a null gives null."""
    rows, memo = list(zip(*columns)), {}
    for r in set(rows):
        memo[r] = None if any(v is None or v != v for v in r) else tails(*r)[side]
    return pd.Series([memo[r] for r in rows], dtype="float64")


@F.pandas_udf(DoubleType())
def hypergeom_tail(x: pd.Series, total: pd.Series, good: pd.Series, drawn: pd.Series) -> pd.Series:
    """P(X >= x) of x good ones among `drawn` of `total`."""
    return _each(hypergeom_tails, 1, x, total, good, drawn)


@F.pandas_udf(DoubleType())
def hypergeom_low(x: pd.Series, total: pd.Series, good: pd.Series, drawn: pd.Series) -> pd.Series:
    """P(X <= x) of x good ones among `drawn` of `total`."""
    return _each(hypergeom_tails, 0, x, total, good, drawn)


@F.pandas_udf(DoubleType())
def binom_tail(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= x) of n draws at chance p."""
    return _each(binom_tails, 1, x, n, p)


#: Chances that a distribution leaves out: so small that all of them together are nothing beside the least score, 1e-30.
NOTHING = 1e-60


def _held(start: int, chances: np.ndarray) -> tuple[int, np.ndarray]:
    """A distribution without the ends that are nothing."""
    there = np.flatnonzero(chances >= NOTHING)
    return start + int(there[0]), chances[there[0] : there[-1] + 1]


def _binomial(n: int, p: float) -> tuple[int, np.ndarray]:
    """(first number of hits, chances from there on) in n trials at chance p, by ratios of neighbours from the mode."""
    if p <= 0 or p >= 1:
        return n if p >= 1 else 0, np.ones(1)
    mode, far = min(n, int((n + 1) * p)), 1 + math.ceil(math.sqrt(-n * math.log(NOTHING) / 2))  # by Hoeffding's bound
    i, j = np.arange(mode, min(n, mode + far), dtype=float), np.arange(mode, max(0, mode - far), -1, dtype=float)
    up, down = np.cumprod((n - i) / (i + 1) * (p / (1 - p))), np.cumprod(j / (n - j + 1) * ((1 - p) / p))
    return _held(mode - len(down), math.exp(_log_binomial(mode, n, p)) * np.concatenate((down[::-1], [1.0], up)))


def _trials_tail(groups: list[tuple[float, int]], least: int) -> float:
    """P(X >= least) of trials given as (chance, number): binomials are folded one into the other.

    Chances below NOTHING are left out, so the work grows with the spread of the numbers, not with these."""
    low, pmf = 0, np.ones(1)
    for p, n in sorted(groups, key=lambda g: g[1]):
        start, more = _binomial(n, p)
        low, pmf = _held(low + start, np.convolve(pmf, more))
    return min(1.0, float(pmf[max(0, least - low) :].sum()))


#: Trials of a row up to which its distribution is followed trial by trial, for all rows of a batch at once.
FEW = 64


@F.pandas_udf(DoubleType())
def poisson_binomial_tail(probs: pd.Series, k: pd.Series) -> pd.Series:
    """P(X >= k) of independent trials with these chances: a direct sum over the exact distribution.

    Rows of few trials go through them together, with one state for k and more hits; in rows of many, trials of one chance are one
    binomial, so the work grows with the number of different chances."""
    sizes, least, out = probs.map(len).to_numpy(int), np.maximum(k.to_numpy(int), 0), np.ones(len(probs))
    for top in np.unique(least):
        at = np.flatnonzero((least == top) & (sizes <= FEW))
        if not len(at) or top == 0:
            continue
        if top > FEW:
            out[at] = 0.0
            continue
        chances = np.zeros((len(at), sizes[at].max()))
        chances[np.arange(chances.shape[1]) < sizes[at][:, None]] = np.concatenate([np.asarray(probs.iloc[i], float) for i in at])
        state = np.zeros((len(at), top + 1))
        state[:, 0] = 1.0
        for p in chances.T:
            moved = state[:, :-1] * p[:, None]
            state[:, :-1] -= moved
            state[:, 1:] += moved
        out[at] = state[:, top]
    for i in np.flatnonzero((sizes > FEW) & (least > 0)):
        values, counts = np.unique(np.asarray(probs.iloc[i], float), return_counts=True)
        out[i] = _trials_tail(list(zip(values.tolist(), counts.tolist())), int(least[i]))
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def counted_trials_tail(trials: pd.Series, k: pd.Series) -> pd.Series:
    """P(X >= k) of independent trials, given as (chance, number of trials)."""
    return pd.Series([_trials_tail([(float(g["p"]), int(g["n"])) for g in groups], int(least)) for groups, least in zip(trials, k)], dtype="float64")


def spec_score(other: Column, total: Column, background: Column, every: Column) -> Column:
    """Signed score of `other` non-specific ones of `total`, where `background` of `every` are: positive where they are rarer
    than that (log odds below 0, or undefined), by the lower tail of the hypergeometric, else negative, by the upper."""
    tail = lambda p: 10 * F.log10(F.greatest(p, F.lit(1e-100)))
    rarer = (background > 0) & F.coalesce(lod(other, total, background, every) < 0, F.lit(True))
    return F.when(rarer, -tail(hypergeom_low(other, every, background, total))).otherwise(tail(hypergeom_tail(other, every, background, total)))


def specificity_by_label(
    rows: DataFrame, glycan: str, label: str, specific: str, values: dict[str, str] | None = None, background: float | None = 0.13, least: int = 10
) -> DataFrame:
    """Per label and per (glycan, label), in one pass: n_specific, n_other, total, the share of either in percent, exact
    medians of `values` (new name -> column) and the score of levels with at least `least` rows (else null).

    A star at the end of a label goes.  by_glycan tells the levels apart (glycan is null in the other, or where it is
    unknown).  Rows whose `specific` is null are of no level but count among all; the background is so large a share of all rows,
    rounded, or without one the non-specific rows themselves."""
    n_all = F.count("*").alias("_all")
    bad = F.count_if(~F.col(specific)) if background is None else F.floor(F.count("*") * background + 0.5)
    facts = rows.agg(n_all, bad.cast("long").alias("_bad"))  # one row
    clean = rows.where(F.col(specific).isNotNull()).withColumn(label, F.regexp_replace(label, r"\*$", ""))
    good = F.col(specific)
    counts = [F.count_if(good).alias("n_specific"), F.count_if(~good).alias("n_other"), F.count("*").alias("total")]
    medians = [F.median(c).alias(name) for name, c in (values or {}).items()]
    level = clean.groupingSets([[F.col(label)], [F.col(glycan), F.col(label)]], glycan, label).agg((F.grouping(glycan) == 0).alias("by_glycan"), *counts, *medians)
    shares = {f"percent_{k}": 100 * F.col(f"n_{k}") / F.col("total") for k in ("specific", "other")}
    scored = level.join(F.broadcast(facts)).withColumns(shares).withColumn("score", F.when(F.col("total") >= least, spec_score(F.col("n_other"), F.col("total"), F.col("_bad"), F.col("_all"))))
    return scored.select("by_glycan", glycan, label, "n_specific", "n_other", "total", *shares, *(values or {}), "score")


def isotope_pattern(elements: DataFrame, isotopes: dict[str, list[float]], most: int = 6, cutoff: float = 1e-9) -> DataFrame:
    """(acc, pattern): relative intensities of the monoisotopic peak and those up to +5 neutrons.

    elements: acc, element, n; isotopes: element -> chances of 0, 1, 2.. extra neutrons."""

    def power(base: np.ndarray, n: int) -> np.ndarray:
        out = np.ones(1)
        while n:
            if n & 1:
                out = np.convolve(out, base)[:most]
            base, n = np.convolve(base, base)[:most], n >> 1
            base = np.where(base < cutoff, 0, base)
        return out

    @F.pandas_udf(ArrayType(DoubleType()))
    def pattern(counts: pd.Series) -> pd.Series:
        rows = []
        for entries in counts:
            total = np.ones(1)
            for e in entries:
                total = np.convolve(total, power(np.array(isotopes[e["element"]]), int(e["n"])))[:most]
            total = np.pad(total, (0, most - len(total)))
            rows.append((total / total.max()).tolist())
        return pd.Series(rows)

    held = elements.where(F.col("element").isin(*isotopes) & (F.col("n") > 0)).groupBy("acc").agg(F.array_sort(F.collect_list(F.struct("element", F.col("n").cast("long").alias("n")))).alias("c"))
    return held.select("acc", pattern("c").alias("pattern"))


def phenotype_enrichment(motif_residues: DataFrame, residue_genes: DataFrame, gene_pheno: DataFrame, least: float = 30) -> DataFrame:
    """(motif, phenotype, hits, score): residues of a motif with a gene of the phenotype, scored by the tail of the
    Poisson-binomial over each residue's chance of having one by its number of genes.

    motif_residues: motif, rid; residue_genes: rid, gene; gene_pheno: gene, phenotype."""
    genes = gene_pheno.select("gene").distinct().count()
    share = gene_pheno.groupBy("phenotype").agg((F.count_distinct("gene") / F.lit(max(1, genes))).alias("p"))
    known = residue_genes.join(gene_pheno.select("gene").distinct(), "gene", "left_semi")
    size = known.groupBy("rid").agg(F.count_distinct("gene").alias("k"))
    # A residue's phenotypes are bits of numbered words, joined by OR, and residues of a motif with the same bits are counted.
    numbers = with_position(gene_pheno.select("phenotype").distinct(), [F.asc("phenotype")], "at").select("phenotype", F.floor((F.col("at") - 1) / 64).alias("word"), ((F.col("at") - 1) % 64).cast("int").alias("bit"))
    carried = gene_pheno.join(numbers, "phenotype").groupBy("gene", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    held = residue_genes.join(carried, "gene").groupBy("rid", "word").agg(F.bit_or("bits").alias("bits"))
    alike = motif_residues.distinct().join(held, "rid").groupBy("motif", "word", "bits").agg(F.count("*").alias("n"))
    each = alike.select("motif", "word", "n", F.explode(F.expr("filter(sequence(0, 63), i -> getbit(bits, i) = 1)")).alias("bit"))
    hits = each.groupBy("motif", "word", "bit").agg(F.sum("n").alias("hits")).join(numbers, ["word", "bit"]).select("motif", "phenotype", "hits")
    # Residues of a motif with the same number of genes have one chance: they are counted, not listed.
    counted = motif_residues.distinct().join(size, "rid").groupBy("motif", "k").agg(F.count("*").alias("n"))
    trials = counted.groupBy("motif").agg(F.collect_list(F.struct("k", "n")).alias("ks"))
    rows = hits.join(trials, "motif").join(share, "phenotype")
    chance = F.transform("ks", lambda x: F.struct(F.when(F.col("p") >= 1, 1.0).otherwise(1 - F.pow(1 - F.col("p"), x["k"])).alias("p"), x["n"].alias("n")))
    scored = rows.withColumn("tail", counted_trials_tail(chance, F.col("hits")))
    return scored.select("motif", "phenotype", "hits", (-10 * F.log10(F.greatest("tail", F.lit(1e-30)))).alias("score")).where(F.col("score") >= least)


