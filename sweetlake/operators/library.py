"""Transition libraries: medians, relative intensities, decoys, confusable transitions, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transition_medians(tgs: DataFrame, keys: list[str], value: str, nrt: str | None = None) -> DataFrame:
    """Exact median intensity of each transition; rows without normalised retention time are dropped."""
    kept = tgs if nrt is None else tgs.where(F.col(nrt).isNotNull())
    return kept.groupBy(*keys).agg(F.median(value).alias("intensity"))


def peptide_nrt(tgs: DataFrame, bad: DataFrame, peptide: str = "pep_id", group: str = "tg_id", nrt: str = "nrt") -> DataFrame:
    """Median nrt and number of observations over transition groups that are not bad."""
    kept = tgs.join(bad.select(F.col(group).alias("_bad")).distinct(), F.col(group) == F.col("_bad"), "left_anti")
    return kept.groupBy(peptide).agg(F.median(nrt).alias("nrt"), F.count(nrt).alias("nobs"))


def transition_library(medians: DataFrame, group: list[str], transition: str, least: int = 4, most: int = 10, ratio: float = 0.1) -> DataFrame:
    """Groups whose least-th intensity is at least `ratio` of the first; their top `most`, relative to the first in thousandths."""
    w = Window.partitionBy(*group).orderBy(F.col("intensity").desc(), transition)
    ranked = medians.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(least, most))
    whole = Window.partitionBy(*group)
    top = F.max("intensity").over(whole)
    nth = F.max(F.when(F.col("rank") == least, F.col("intensity"))).over(whole)
    return (
        ranked.withColumn("_top", top)
        .withColumn("_nth", nth)
        .where((F.col("_nth") >= ratio * F.col("_top")) & (F.col("rank") <= most))
        .withColumn("relative", F.round(1000 * F.col("intensity") / F.col("_top")).cast("int"))
        .drop("_top", "_nth")
    )


def add_decoys(library: DataFrame, offsets: list[float], mz: list[str], name: str) -> DataFrame:
    """Each row and a copy per offset with shifted m/z, a prefixed name and a decoy flag."""
    shifts = F.array(F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("by")), *(F.struct(F.lit(i + 1).alias("i"), F.lit(float(o)).alias("by")) for i, o in enumerate(offsets)))
    wide = library.withColumn("_d", F.explode(shifts))
    moved = {c: F.col(c) + F.col("_d.by") for c in mz}
    prefix = F.when(F.col("_d.i") > 0, F.concat(F.lit("DECOY"), F.col("_d.i"), F.lit("_"), F.col(name))).otherwise(F.col(name))
    return wide.withColumns(moved | {name: prefix, "decoy": (F.col("_d.i") > 0).cast("int")}).drop("_d")


def relative_area(fragments: DataFrame, group: list[str], area: str) -> DataFrame:
    """1000 times the area over the largest of its group."""
    return fragments.withColumn("relative_area", 1000 * F.col(area) / F.max(area).over(Window.partitionBy(*group)))


def confusable_transitions(tr: DataFrame, key: str, axes: dict[str, float], slices: int = 1) -> DataFrame:
    """(key, n): other transitions that lie strictly within all tolerances.

    A range join by bins of the tolerance on every axis: one side is dealt to the 3^d bins
    around its own, then an exact test.  It is symmetric, unlike a scan that stops short of its
    first row.  Transitions of equal values are one point with their number, as they confuse alike.  Dense bins are
    cut into `slices` by the point on the wide side and replicated.
    """
    bins = {a: F.floor(F.col(a) / F.lit(float(t))) for a, t in axes.items()}
    base = tr.select(key, *axes)
    points = base.dropna(subset=[*axes]).groupBy(*axes).agg(F.count("*").alias("_m"))
    one = points.withColumns({f"_b{a}": b for a, b in bins.items()}).withColumn("_s", F.pmod(F.xxhash64(*axes), F.lit(slices)))
    other = points.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    for a, b in bins.items():
        other = other.withColumn(f"_b{a}", F.explode(F.sequence(b - 1, b + 1)))
    other = other.select(*(F.col(a).alias(f"_x{a}") for a in axes), "_s", *(f"_b{a}" for a in axes))
    near = [F.abs(F.col(a) - F.col(f"_x{a}")) < t for a, t in axes.items()]
    pairs = one.join(other, ["_s", *(f"_b{a}" for a in axes)])
    for test in near:
        pairs = pairs.where(test)
    counted = pairs.groupBy(*(F.col(f"_x{a}").alias(a) for a in axes)).agg((F.sum("_m") - 1).alias("n"))  # all but itself
    return base.join(counted, [*axes], "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def library_stats(df: DataFrame, protein: str, glycan: str, site: str, glycopeptide: str) -> DataFrame:
    """Distinct proteins, glycans, sites, (protein, site, glycan) and glycopeptides, in one pass."""
    return df.agg(
        F.count_distinct(protein).alias("proteins"),
        F.count_distinct(glycan).alias("glycans"),
        F.count_distinct(F.struct(protein, site)).alias("sites"),
        F.count_distinct(F.struct(protein, site, glycan)).alias("site_glycans"),
        F.count_distinct(glycopeptide).alias("glycopeptides"),
    )


#: Three-letter names of amino acids.
AMINO_ACIDS = {
    "A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "E": "Glu", "Q": "Gln", "G": "Gly", "H": "His", "I": "Ile",
    "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val",
}


def glycosites(tgs: DataFrame, peptides: DataFrame, glycans: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(protein, position, amino_acid, glycan, composition, class, peptides, site): a row a site and glycan, with the distinct
    peptides that show it, sorted and comma-joined.

    tgs: peptide, sample; peptides: pep_id, glycan (of its first site), alignments (array of protein and site, as N52); glycans:
    acc, names, classes; samples: sample, those wanted (all without it).  Only peptides with one alignment count, and glycans of one
    class.  The composition is the first name with HexNAc and without Fuc, empty without one; site is protein@site."""
    wanted = tgs if samples is None else tgs.join(samples.select("sample").distinct(), "sample", "left_semi")
    seen = wanted.select(F.col("peptide").alias("pep_id")).distinct()
    one = peptides.where(F.size("alignments") == 1).join(seen, "pep_id", "left_semi").select("pep_id", F.col("glycan").alias("acc"), F.col("alignments")[0].alias("a"))
    named = F.filter("names", lambda n: n.contains("HexNAc") & ~n.contains("Fuc"))
    kind = glycans.where(F.size("classes") == 1).select("acc", F.coalesce(F.get(named, F.lit(0)), F.lit("")).alias("composition"), F.col("classes")[0].alias("class"))
    letter = F.substring("a.site", 1, 1)
    names = F.create_map(*(F.lit(x) for pair in AMINO_ACIDS.items() for x in pair))
    rows = one.join(kind, "acc").select(F.col("a.protein").alias("protein"), F.substr("a.site", F.lit(2)).cast("int").alias("position"), F.try_element_at(names, letter).alias("amino_acid"), F.col("acc").alias("glycan"), "composition", "class", F.concat("a.protein", F.lit("@"), "a.site").alias("site"), "pep_id")
    keys = [c for c in rows.columns if c not in ("pep_id", "site")]
    return rows.groupBy(*keys, "site").agg(F.array_join(F.sort_array(F.collect_set(F.col("pep_id").cast("string"))), ",").alias("peptides")).select(*keys, "peptides", "site")


def dia_calibration(documents: DataFrame) -> DataFrame:
    """(spectra, slope, intercept): of each spectra the calibration `slope:intercept` of its first document that has one.

    documents: spectra, name (their order), lccalibration."""
    first = documents.where("lccalibration is not null").groupBy("spectra").agg(F.min_by(F.split("lccalibration", ":"), F.struct("name", "lccalibration")).alias("c"))
    return first.select("spectra", *(F.get("c", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("slope", "intercept"))))


def dia_groups(fragments: DataFrame, keys: list[str], transition: str, area: str) -> DataFrame:
    """Transitions of each group with intensity = relative area / 10, the positive ones, largest first, and their number."""
    rows = relative_area(fragments, keys, area).withColumn("intensity", F.col("relative_area") / 10).where("intensity > 0")
    pair = F.struct((-F.col("intensity")).alias("neg"), F.col(transition).alias("id"), "intensity")
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.struct(x["id"].alias("id"), x["intensity"].alias("intensity"))).alias("transitions"), F.count("*").alias("n"))


def transition_groups(rows: DataFrame, peptides: DataFrame, key: str, peptide: str, group: list[str], transition: list[str]) -> DataFrame:
    """Resolve peptides by canonical key, drop unknown and ambiguous keys, and gather each group's distinct transitions."""
    one = peptides.groupBy(F.col(key).alias("_key")).agg(F.min(peptide).alias("_pep"), F.count_distinct(peptide).alias("_n")).where("_n = 1")
    known = rows.join(one, F.col(key) == F.col("_key")).withColumn(peptide, F.col("_pep")).drop("_key", "_pep", "_n")
    return known.groupBy(peptide, *group).agg(F.sort_array(F.collect_set(F.struct(*transition))).alias("transitions")).withColumn("n", F.size("transitions"))


def lookup(values: Column, names: dict[str, float]) -> Column:
    """A literal map's value for each key."""
    return F.element_at(F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(float(v))))), values)
