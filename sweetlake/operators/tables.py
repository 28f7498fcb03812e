"""Table algebra on annotation sources: columns, predicates, facets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_position


def set_field(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """A computed column, replaced in place or appended."""
    return df.withColumn(name, expr)


def add_fields(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Several computed columns, all from the old ones."""
    return df.withColumns(exprs)


def replace_from_list(df: DataFrame, field: str, values: DataFrame, order: list[Column], value: str = "value", index: str = "index") -> DataFrame:
    """The k-th row by `order` takes the k-th value; rows stop at the shorter side.  values: (index from 1, value)."""
    at = with_position(df, order, "_at")
    return at.join(values.select(F.col(index).alias("_at"), F.col(value).alias("_new")), "_at").withColumn(field, F.col("_new")).drop("_at", "_new")


def filter_rows(df: DataFrame, predicate: Callable[[DataFrame], Column]) -> DataFrame:
    return df.where(predicate(df))


def filter_expr(df: DataFrame, text: str, numbered: str | None = None, most: int = 20) -> DataFrame:
    """Rows where a SQL text holds; string columns whose values are all numbers count as numbers, and
    `numbered` stands for the array of columns numbered0 to numbered20."""
    strings = [c for c, kind in df.dtypes if kind == "string"]
    numeric = lambda c: F.col(c).try_cast("double")
    if strings:
        row = df.agg(*(F.coalesce(F.bool_and(F.col(c).isNull() | numeric(c).isNotNull()), F.lit(False)).alias(c) for c in strings)).first()
        strings = [c for c in strings if row[c]]
    out = df.select(F.struct("*").alias("_row"), *(numeric(c).alias(c) if c in strings else F.col(c) for c in df.columns))
    if numbered:
        out = out.withColumn(numbered, F.array(*(c for c in (f"{numbered}{i}" for i in range(most + 1)) if c in df.columns)))
    return out.where(F.expr(text)).select("_row.*")


def rename_with(df: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    return df.withColumnsRenamed({c: fn(c) for c in df.columns})


def select_cols(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*(c for c in keep if c in df.columns))


def drop_cols(df: DataFrame, drop: list[str]) -> DataFrame:
    return df.drop(*drop)


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    import re

    return df.drop(*(c for c in df.columns if re.search(pattern, c)))


def map_values(df: DataFrame, fn: Callable[[Column], Column], cols: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in cols or df.columns})


def move_cols(df: DataFrame, anchor: str, cols: list[str], after: bool = True) -> DataFrame:
    """Columns moved to just after, or before, the anchor."""
    rest = [c for c in df.columns if c not in cols]
    at = rest.index(anchor) + after
    return df.select(*rest[:at], *cols, *rest[at:])


def keep_listed(df: DataFrame, col: str, allowed: list[str], sep: str = ";") -> DataFrame:
    """Values of a packed list that are allowed; rows without any go."""
    kept = F.array_intersect(F.split(col, sep), F.array(*map(F.lit, allowed)))
    return df.withColumn("_kept", kept).where(F.size("_kept") > 0).withColumn(col, F.array_join("_kept", sep)).drop("_kept")


def range_filter(df: DataFrame, least: dict | None = None, most: dict | None = None, equal: dict | None = None) -> DataFrame:
    """Rows within inclusive bounds and with equal values, as pushed-down predicates."""
    for c, v in (least or {}).items():
        df = df.where(F.col(c) >= v)
    for c, v in (most or {}).items():
        df = df.where(F.col(c) <= v)
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v)
    return df


def bounds(df: DataFrame, mass: str, permethylated: str) -> DataFrame:
    """One row: least and largest mass, and permethylated mass where that is positive."""
    some = F.when(F.col(permethylated) > 0, F.col(permethylated))
    return df.agg(F.min(mass).alias("min_mass"), F.max(mass).alias("max_mass"), F.min(some).alias("min_permethylated"), F.max(some).alias("max_permethylated"))


def valid_crossref(df: DataFrame, resource: str, entry: str, numeric: list[str], patterns: dict[str, str], excluded: list[str]) -> DataFrame:
    """Cross references valid for their resource: positive integers, a pattern, or not excluded."""
    r, e = F.col(resource), F.col(entry)
    ok = F.when(r.isin(excluded), F.lit(False)).when(r.isin(numeric), F.coalesce(F.expr(f"try_cast(`{entry}` as bigint)") > 0, F.lit(False)))
    for name, pattern in patterns.items():
        ok = ok.when(r == name, e.rlike(f"^(?:{pattern})$"))
    return df.where(ok.otherwise(e.isNotNull()))


def annotations_where(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows with the given type, property, source or sourceid; None means any."""
    for c, v in wanted.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def export_facet(annotations: DataFrame, wanted: dict, names: dict[str, str], default_sourceid: str | None = None) -> DataFrame:
    """A per-resource export: annotations of a facet, one row per value, distinct, columns renamed."""
    rows = annotations_where(annotations, **wanted).withColumn("value", F.explode("value"))
    if default_sourceid is not None:
        rows = rows.withColumn("sourceid", F.coalesce("sourceid", F.lit(default_sourceid)))
    return rows.select(*(F.col(c).alias(n) for c, n in names.items())).distinct()


def monocounts(annotations: DataFrame, suffix: str = "Count", total: str = "MonosaccharideCount") -> DataFrame:
    """(acc, symbol, n): property XCount as X, the total as *."""
    rows = annotations.where(F.col("property").endswith(suffix)).withColumn("n", F.explode("value")).withColumn("n", F.col("n").cast("int"))
    symbol = F.when(F.col("property") == total, "*").otherwise(F.regexp_replace("property", f"{suffix}$", ""))
    return rows.select("acc", symbol.alias("symbol"), "n")


def by_taxa(taxa: DataFrame, ids: DataFrame, taxid: str = "taxid") -> DataFrame:
    return taxa.join(ids.select(taxid).distinct(), taxid, "left_semi")


def search_database(names: DataFrame, classes: DataFrame, species: DataFrame, wanted: str, masses: DataFrame, water: float = 18.0105546) -> DataFrame:
    """(name, mass): composition names without Fuc, N-linked and not truncated, of the species directly or by
    subsumption; mass less water, by mass.

    names: acc, name; classes: acc, type, subtype; species: acc, species, kind; masses: acc, mass."""
    n_linked = classes.where("type = 'N-linked'").select("acc").distinct()
    truncated = classes.where("subtype = 'truncated'").select("acc").distinct()
    of = species.where((F.col("species") == wanted) & F.col("kind").isin("Direct", "Subsumption")).select("acc").distinct()
    kept = names.where(~F.col("name").contains("Fuc")).join(n_linked, "acc", "left_semi").join(truncated, "acc", "left_anti").join(of, "acc", "left_semi")
    return kept.join(masses, "acc").select("name", F.round(F.col("mass") - water, 5).alias("mass")).distinct().orderBy("mass", "name")


def label_glycan_kind(residues: DataFrame, core: DataFrame) -> DataFrame:
    """(acc, high_mannose): two GlcNAc and only Man besides, on a glycan with the core."""
    n = residues.groupBy("acc").agg(F.count_if(F.col("symbol") == "GlcNAc").alias("g"), F.count_if(F.col("symbol") == "Man").alias("m"), F.count("*").alias("all"))
    marked = n.join(core.select("acc", F.lit(True).alias("core")).distinct(), "acc", "left")
    return marked.select("acc", (F.coalesce("core", F.lit(False)) & (F.col("g") == 2) & (F.col("m") == F.col("all") - 2) & (F.col("m") > 0)).alias("high_mannose"))


def wide_properties(annotations: DataFrame, properties: list[str], empty: str = "") -> DataFrame:
    """One row per accession and a column per property (least value), empty where absent."""
    value = F.array_min("value")
    picks = [F.coalesce(F.min(F.when(F.col("property") == p, value)), F.lit(empty)).alias(p) for p in properties]
    return annotations.groupBy("acc").agg(*picks)


def sort_table(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*keys)


def nearest_mass(df: DataFrame, mass: str, target: float, ties: list[str]) -> DataFrame:
    """The row closest in mass."""
    return df.orderBy(F.abs(F.col(mass) - target), *ties).limit(1)


def natural_sort(values: Column) -> Column:
    """Numbers first, by value, then text."""
    keyed = F.transform(values, lambda v: F.struct(v.try_cast("double").isNull().alias("text"), v.try_cast("double").alias("n"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def sort_dotted(values: Column) -> Column:
    """Dotted ids by their numeric parts."""
    keyed = F.transform(values, lambda v: F.struct(F.transform(F.split(v, r"\."), lambda p: p.try_cast("int")).alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def worst_residuals(df: DataFrame, residual: str, k: int, threshold: float, ties: list[str], seed: int | None = None) -> DataFrame:
    """The k largest absolute residuals above a threshold; with a seed, a draw weighted by their size."""
    rows = df.where(F.abs(residual) > threshold)
    key = F.abs(residual) if seed is None else -F.log(F.rand(seed)) / F.abs(residual) * -1
    return rows.orderBy(key.desc(), *ties).limit(k)


def required_accessions(lists: list[DataFrame], known: DataFrame, excluded: DataFrame, archived: DataFrame) -> DataFrame:
    """Distinct accessions of all lists that are not known, excluded or archived."""
    from functools import reduce

    every = reduce(DataFrame.union, [x.select("acc") for x in lists]).distinct()
    for gone in (known, excluded, archived):
        every = every.join(gone.select("acc").distinct(), "acc", "left_anti")
    return every


#: The 13 containment rules between the residue sets of an alignment: the first lies within the second.
CONTAINMENT = [
    ("core_strict", "core"), ("substructure_strict", "substructure"), ("whole_strict", "whole"), ("nonreducing_strict", "nonreducing"),
    ("whole", "core"), ("whole", "substructure"), ("core", "substructure"), ("nonreducing", "substructure"),
    ("whole_strict", "core_strict"), ("whole_strict", "substructure_strict"), ("core_strict", "substructure_strict"),
    ("nonreducing_strict", "substructure_strict"), ("whole", "nonreducing"),
]


def check_containment(align: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule) of rows where the first set of a rule is not within the second; a null set is empty."""
    sets = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    broken = [F.when(F.size(F.array_except(sets(a), sets(b))) > 0, f"{a}<={b}") for a, b in CONTAINMENT]
    return align.select(*keys, F.explode(F.array_compact(F.array(*broken))).alias("rule"))
