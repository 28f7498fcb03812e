"""Target/decoy statistics: best per group, FDR curve, q-values, multiple testing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .ordered import running


def best_per_group(df: DataFrame, group: list[str], score: str, ties: list[str], descending: bool = True) -> DataFrame:
    """The top row of each group by score (null scores last), ties to the least of `ties`.

    An aggregate of structs, so rows are combined before the shuffle.  The whole order is one
    struct: score and negated ties are compared by max_by, or score and ties by min_by.
    """
    row = F.struct(*df.columns)
    if descending:
        first = df.groupBy(*group, score).agg(F.min_by(row, F.struct(*ties)).alias("row"))
        best = first.groupBy(*group).agg(F.max_by("row", score).alias("row"))
    else:
        best = df.groupBy(*group).agg(F.min_by(row, F.struct(score, *ties)).alias("row"))
    return best.select("row.*")


def passing(df: DataFrame, threshold: float, group: list[str], score: str, ties: list[str], decoy: str = "decoy") -> DataFrame:
    """Best rows per group that are no decoys and score at least `threshold`."""
    return best_per_group(df, group, score, ties).where((F.col(decoy) == 0) & (F.col(score) >= threshold))


def fdr_curve(scored: DataFrame, ndecoys: int = 1, score: str = "score", decoy: str = "decoy") -> DataFrame:
    """(score, fdr, targets): kept points of the FDR curve.

    Ties are grouped first.  FDR = decoys / ndecoys / targets, cumulated from the best score; a
    point is kept where it lies strictly below 1 and below all points of worse scores.
    """
    by_score = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(decoy) == 0).alias("t"), F.count_if(F.col(decoy) != 0).alias("d")
    )
    # One range partition serves both ways: sums from the best score on, then the least FDR from the worst on; a row a range
    # carries either to the other ranges.
    ranges = cut_lineage(by_score.repartitionByRange(F.col("score").desc()).withColumn("_range", F.spark_partition_id()))
    local = Window.partitionBy("_range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = Window.orderBy("_range")
    before, after = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    totals = ranges.groupBy("_range").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    earlier = F.broadcast(totals.select("_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("t", "d"))))
    summed = ranges.join(earlier, "_range").select("_range", "score", *((F.sum(c).over(local) + F.col(f"_{c}")).alias(c) for c in ("t", "d")))
    points = summed.select("_range", "score", F.col("t").alias("targets"), F.when(F.col("t") > 0, F.col("d") / F.lit(ndecoys) / F.col("t")).alias("fdr"))
    least = points.groupBy("_range").agg(F.min("fdr").alias("least"))
    later = F.broadcast(least.select("_range", F.min("least").over(after).alias("_least")))
    worse = Window.partitionBy("_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.least(F.min("fdr").over(worse), "_least"), F.lit(1.0))
    kept = points.join(later, "_range").withColumn("below", below).where((F.col("fdr") < 1) & (F.col("fdr") < F.col("below")))
    return kept.select("score", "fdr", "targets")


def assign_qvalue(scored: DataFrame, curve: DataFrame, score: str = "score") -> DataFrame:
    """scored with qvalue: the FDR at the highest kept score that is not above; 1 if there is none."""
    every = scored.select(F.col(score).alias("_s"), F.lit(None).cast("double").alias("fdr")).unionByName(curve.select(F.col("score").alias("_s"), "fdr"))
    by_score = every.where("_s is not null").groupBy("_s").agg(F.min("fdr").alias("fdr"))
    found = running(by_score, [F.col("_s").asc()], {"q": ("min", "fdr")}).select("_s", F.coalesce("q", F.lit(1.0)).alias("qvalue"))
    return scored.join(found, F.col(score) == F.col("_s"), "left").drop("_s").withColumn("qvalue", F.coalesce("qvalue", F.lit(1.0)))


def score_at(curve: DataFrame, q: float) -> DataFrame:
    """One row: the loosest kept score with FDR below q, else the best kept score."""
    return curve.agg(F.coalesce(F.min(F.when(F.col("fdr") < q, F.col("score"))), F.max("score")).alias("score"))


def targets_at(scored: DataFrame, threshold: float, score: str = "score", decoy: str = "decoy") -> DataFrame:
    """One row: targets that score at least `threshold`."""
    return scored.agg(F.count_if((F.col(decoy) == 0) & (F.col(score) >= threshold)).alias("targets"))


def separate_fdr(targets: DataFrame, decoys: list[DataFrame], score: str = "score") -> DataFrame:
    """FDR curve where the decoy flag is given by the input a row comes from."""
    flagged = [targets.select(score, F.lit(0).alias("decoy"))] + [d.select(score, F.lit(1).alias("decoy")) for d in decoys]
    return fdr_curve(reduce(DataFrame.unionByName, flagged), len(decoys), score)


def bh_fdr(df: DataFrame, p: str = "p") -> DataFrame:
    """Benjamini-Hochberg values as `bh`; the reverse running minimum is taken only for more than two values.

    A value's rank is the number of p up to it, ties by the last; ranks come from distinct p."""
    n = df.where(F.col(p).isNotNull()).agg(F.count("*").alias("n"))
    ranked = running(df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("c")), [F.col("_p").asc()], {"rank": ("sum", "c")})
    raw = ranked.join(F.broadcast(n)).withColumn("raw", F.least(F.lit(1.0), F.col("_p") * F.col("n") / F.col("rank")))  # n: one row
    steps = running(raw, [F.col("_p").desc()], {"least": ("min", "raw")})
    value = F.when(F.col("n") > 2, F.col("least")).otherwise(F.col("raw"))
    return df.join(steps.select("_p", value.alias("bh")), F.col(p) == F.col("_p"), "left").drop("_p")


def bonferroni(df: DataFrame, p: str = "p") -> DataFrame:
    """p times the number of values, at most 1, as `bonferroni`."""
    n = df.agg(F.count(p).alias("_n"))
    return df.join(F.broadcast(n)).withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("_n"))).drop("_n")


def phred(p: Column, floor: float = 1e-30) -> Column:
    """-10 log10 of p, which is at least `floor`."""
    return -10 * F.log10(F.greatest(p, F.lit(floor)))
