"""Aggregations over annotations, compositions, classes and genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collect_values(df: DataFrame, keys: list[str], value: str, sep: str = ";") -> DataFrame:
    """Sorted distinct values per key as one list text."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(F.col(value).cast("string"))), sep).alias("values"))


def taxon_counts(taxa: DataFrame, expanded: DataFrame, archived: DataFrame, sources: list[str]) -> DataFrame:
    """Distinct accessions per level and taxon, one column per source and the distinct total over sources.

    taxa: acc, taxid, source; expanded: taxid, level, at (as annotated, species, genus).  Rows are made
    distinct before the pivot; the total is a count of its own, not a sum."""
    live = taxa.join(archived.select("acc").distinct(), "acc", "left_anti").join(expanded, "taxid").select("level", "at", "source", "acc").distinct()
    by = live.groupBy("level", "at").pivot("source", sources).agg(F.count("acc")).na.fill(0)
    total = live.groupBy("level", "at").agg(F.count_distinct("acc").alias("total"))
    return by.join(total, ["level", "at"])


def symbol_frequency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of (a, b) by a, count descending, b."""
    return df.groupBy(a, b).agg(F.count("*").alias("n")).orderBy(a, F.desc("n"), b)


#: Items that are counted in one partition.
PART_ROWS = 500_000


def composition_counts(items: DataFrame, parents: DataFrame) -> DataFrame:
    """(acc, symbol, n): counts with roll-up to parent symbols, and the total as *, which counts no roll-up.

    items: acc, symbol; parents: symbol, parent, a vocabulary that is broadcast.  Items are dealt out by acc once, to as many
    partitions as their number asks for, so that the counts that a task holds do not grow with the input."""
    parts = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // PART_ROWS))
    own = items.repartition(parts, "acc").groupBy("acc", "symbol").agg(F.count("*").alias("n"))
    ups = parents.groupBy("symbol").agg(F.collect_list(F.struct("parent")).alias("_ups"))
    none = F.array().cast("array<struct<parent:string>>")
    listed = F.concat(F.array("symbol"), F.transform(F.coalesce("_ups", none), lambda u: u["parent"]), F.array(F.lit("*")))
    return own.join(F.broadcast(ups), "symbol", "left").select("acc", F.explode(listed).alias("symbol"), "n").groupBy("acc", "symbol").agg(F.sum("n").alias("n"))


def composition_table(counts: DataFrame, listed: list[str], others: str = "Xxx") -> DataFrame:
    """Wide table of the listed symbols; the rest goes to `others`; rows that do not add up to * are dropped."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("symbol") == s, F.col("n"))), F.lit(0))
    rest = F.coalesce(F.sum(F.when(~F.col("symbol").isin(*listed, "*"), F.col("n"))), F.lit(0))
    wide = counts.groupBy("acc").agg(*(n(s).alias(s) for s in listed), rest.alias(others), n("*").alias("total"))
    added = sum((F.col(s) for s in listed), F.col(others))
    return wide.where(added == F.col("total"))


def repeat_flagged_counts(one: DataFrame, two: DataFrame) -> DataFrame:
    """(acc, symbol, n) as text: the count for one repeat, with + where two repeats give another."""
    # An accession's few counts are one list, so that counts that are dealt out by acc stay where they are.
    lists = lambda df, name: df.groupBy("acc").agg(F.collect_list(F.struct("symbol", "n")).alias(name))
    each = lists(one, "_one").join(lists(two, "_two"), "acc", "left").select("acc", "_two", F.inline("_one"))
    both = each.withColumn("m", F.get(F.filter("_two", lambda x: x["symbol"] == F.col("symbol")), F.lit(0))["n"])
    return both.select("acc", "symbol", F.concat(F.col("n").cast("string"), F.when(F.col("n").eqNullSafe(F.col("m")), "").otherwise("+")).alias("n"))


def elemental_composition(residues: DataFrame, table: DataFrame) -> DataFrame:
    """(acc, element, n): elements over all residues; a glycan with an unknown residue has null counts.

    residues: acc, symbol; table: symbol, element, n."""
    known = table.groupBy("symbol").agg(F.collect_list(F.struct("element", "n")).alias("parts"))
    # A glycan's symbols, of which there are few, are one row, so that only the counts of symbols are shuffled.
    counted = residues.groupBy("acc", "symbol").agg(F.count("*").alias("c")).join(known, "symbol", "left")
    whole = counted.groupBy("acc").agg(F.bool_or(F.col("parts").isNull()).alias("_bad"), F.flatten(F.collect_list(F.transform("parts", lambda p: F.struct(p["element"].alias("element"), (F.col("c") * p["n"]).alias("n"))))).alias("parts"))
    total = lambda e: F.aggregate(F.filter("parts", lambda p: p["element"] == e), F.lit(0).cast("long"), lambda s, p: s + p["n"])
    each = whole.withColumn("element", F.explode(F.array_distinct(F.transform("parts", lambda p: p["element"]))))
    return each.select("acc", "element", F.when(~F.col("_bad"), total(F.col("element"))).alias("n"))


def formula(elements: DataFrame) -> DataFrame:
    """(acc, formula): element symbols, sorted, with counts above one."""
    part = F.concat("element", F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise(""))
    return elements.where("n > 0").groupBy("acc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element", part.alias("p")))), lambda x: x["p"]), "").alias("formula"))


def molecular_weight(elements: DataFrame, masses: DataFrame) -> DataFrame:
    """(acc, mass): sum of count times element mass; null if any count is unknown."""
    rows = elements.join(masses, "element", "left").withColumn("m", F.col("n") * F.col("mass"))
    return rows.groupBy("acc").agg(F.when(F.bool_and(F.col("m").isNotNull()), F.sum("m")).alias("mass"))


def date_range(events: DataFrame, acc: str, at: str) -> DataFrame:
    """First and last date per accession."""
    return events.groupBy(acc).agg(F.min(F.to_date(at)).alias("first"), F.max(F.to_date(at)).alias("last"))


def multi_sequences(seqs: DataFrame) -> DataFrame:
    """(acc, format, n) with more than one distinct sequence."""
    return seqs.groupBy("acc", "format").agg(F.count_distinct("sequence").alias("n")).where("n > 1")


def valid_and_replacement(hashes: DataFrame) -> DataFrame:
    """(acc, valid, replacement): an accession is valid if its own hash is the validated one; others take
    the valid accession of their validated hash, or null.  hashes: acc, own, validated, invalid."""
    ok = hashes.withColumn("valid", (F.col("own") == F.col("validated")) & ~F.col("invalid"))
    best = ok.where("valid").groupBy(F.col("validated").alias("_h")).agg(F.min("acc").alias("_to"))
    by_acc = ok.groupBy("acc").agg(F.bool_or("valid").alias("valid"), F.min("validated").alias("_h"))
    return by_acc.join(best, "_h", "left").select("acc", F.coalesce("valid", F.lit(False)).alias("valid"), F.when(F.col("valid"), None).otherwise(F.col("_to")).alias("replacement"))


def name_to_accession(names: DataFrame, preferred: DataFrame) -> DataFrame:
    """(name, acc, ambiguous): the only candidate, else the least preferred-listed one, else the least."""
    marked = names.select("name", "acc").distinct().join(preferred.select("acc", F.lit(0).alias("_p")).distinct(), "acc", "left")
    order = F.struct(F.coalesce("_p", F.lit(1)), "acc")
    return marked.groupBy("name").agg(F.min_by("acc", order).alias("acc"), (F.count("*") > 1).alias("ambiguous"))


def classification_counts(cls: DataFrame, named: list[str]) -> DataFrame:
    """Numbers of types and subtypes per accession, and of subtypes per named type."""
    of = [F.count_distinct(F.when(F.col("type") == t, F.col("subtype"))).alias(f"n_{t}") for t in named]
    return cls.groupBy("acc").agg(F.count_distinct("type").alias("n_types"), F.count_distinct("type", "subtype").alias("n_subtypes"), *of)


def categorize_messages(messages: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """(category, n, ids): the first pattern that matches names the category; its captured ids are distinct."""
    category, captured = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, p in reversed(patterns.items()):
        category = F.when(F.col(text).rlike(p), name).otherwise(category)
        captured = F.when(F.col(text).rlike(p), F.regexp_extract(text, p, 1)).otherwise(captured)
    rows = messages.select(category.alias("category"), captured.alias("id"))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


def linear_fit(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Slope, intercept, correlation and number of points per key."""
    return points.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.regr_count(y, x).alias("n"))


def expression_category(rows: DataFrame, groups: list[str]) -> DataFrame:
    """(gene, category, top) over all groups, missing ones 0: not detected, highly enriched (the first is at
    least 50 times the second), moderately (5 times), group enriched (the mean of the first 2 to 5 is more
    than 5 times the next), ubiquitous (all at least 1), else mixed.  rows: gene, grp, ntpm."""
    wide = rows.groupBy("gene").agg(*(F.coalesce(F.max(F.when(F.col("grp") == g, F.col("ntpm"))), F.lit(0.0)).alias(f"_{i}") for i, g in enumerate(groups)))
    pairs = F.array(*(F.struct((-F.col(f"_{i}")).alias("neg"), F.lit(g).alias("g")) for i, g in enumerate(groups)))
    ranked = wide.select("gene", F.array_sort(pairs).alias("s"))
    v = F.transform("s", lambda x: -x["neg"])
    ranked = ranked.withColumn("v", v)
    at = lambda i: F.get("v", F.lit(i))
    category = F.when(at(0) < 1, "not detected").when(at(0) >= 50 * at(1), "highly enriched").when(at(0) >= 5 * at(1), "moderately enriched")
    for k in range(2, min(5, len(groups) - 1) + 1):
        mean = F.aggregate(F.slice("v", 1, k), F.lit(0.0), lambda s, x: s + x) / k
        category = category.when(mean > 5 * at(k), "group enriched")
    category = category.when(at(len(groups) - 1) >= 1, "ubiquitous").otherwise("mixed")
    return ranked.select("gene", category.alias("category"), F.get("s", F.lit(0))["g"].alias("top"))


def signature_diff(old: DataFrame, new: DataFrame, examples: int = 10) -> DataFrame:
    """Accessions grouped by (old class set, new class set) where they differ: adds, removes, number, examples."""
    sets = lambda df, n: df.groupBy("acc").agg(F.sort_array(F.collect_set("cls")).alias(n))
    none = F.array().cast("array<string>")
    both = sets(old, "o").join(sets(new, "n"), "acc", "full").select("acc", F.coalesce("o", none).alias("o"), F.coalesce("n", none).alias("n")).where("o <> n")
    # The first accessions are taken of salted parts of a group, then of these.
    part = Window.partitionBy("o", "n", F.pmod(F.xxhash64("acc"), F.lit(64))).orderBy("acc")
    first = both.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= examples)
    first = first.groupBy("o", "n").agg(F.slice(F.sort_array(F.collect_list("acc")), 1, examples).alias("examples"))
    grouped = both.groupBy("o", "n").agg(F.count("*").alias("size")).join(first, ["o", "n"])
    return grouped.select(F.array_except("n", "o").alias("adds"), F.array_except("o", "n").alias("removes"), "size", "examples").orderBy(F.desc("size"))


def residue_index(items: DataFrame) -> DataFrame:
    """(acc, key, residues, links): sorted ids per structure and key.  items: acc, key, rid, lid."""
    ids = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return items.groupBy("acc", "key").agg(ids("rid").alias("residues"), ids("lid").alias("links"))


def enzyme_annotations(rows: DataFrame) -> DataFrame:
    """(acc, species, genes, details) with details uniprot:gene:id:taxid."""
    detail = F.concat_ws(":", "uniprot", "gene", F.col("id").cast("string"), F.col("taxid").cast("string"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ";")
    return rows.groupBy("acc", "species").agg(joined("gene").alias("genes"), joined(detail).alias("details"))


def motif_enzyme_rollup(rows: DataFrame, sample: int = 10) -> DataFrame:
    """(motif, type, species, core, genes, structures): gene:residues lists and the first structures; core is
    the group's.  rows: motif, type, species, core, gene, rid, structure."""
    rows = rows.withColumn("core", F.max("core").over(Window.partitionBy("motif", "type")))
    genes = rows.groupBy("motif", "type", "species", "core", "gene").agg(F.array_join(F.sort_array(F.collect_set("rid")), "+").alias("rids"))
    some = rows.groupBy("motif", "type", "species", "core").agg(F.array_join(F.slice(F.sort_array(F.collect_set("structure")), 1, sample), ",").alias("structures"))
    listed = genes.groupBy("motif", "type", "species", "core").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "gene", "rids"))), ";").alias("genes"))
    return listed.join(some, ["motif", "type", "species", "core"])


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the least by order."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row")).select("row.*")


def lod(x: Column, n: Column, k: Column, m: Column) -> Column:
    """Log odds, base 2, of x in n against k - x in m - n, each cell with half a count more; null for a negative cell."""
    a, b, c, d = x, n - x, k - x, (m - n) - (k - x)
    odds = F.log2((a + 0.5) / (b + 0.5)) - F.log2((c + 0.5) / (d + 0.5))
    return F.when((a >= 0) & (b >= 0) & (c >= 0) & (d >= 0), odds)
