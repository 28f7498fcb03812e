"""Exports: sorted tables, sequences, triples, viewer documents; upserts and stable ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running, with_position


def write_export(df: DataFrame, path: str, cols: list[str], sort_cols: list[str]) -> None:
    """Header TSV in a fixed column order, range-sorted over files."""
    df.select(*cols).orderBy(*sort_cols).write.csv(path, sep="\t", header=True)


def export_sequences(annotations: DataFrame, prop: str) -> DataFrame:
    """(acc, body): one text per accession for one sequence format."""
    rows = annotations.where(F.col("property") == prop)
    return rows.groupBy("acc").agg(F.min(F.array_min("value")).alias("body"))


def quoted(text: Column) -> Column:
    """A literal with backslashes, quotes and line ends escaped."""
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.concat(F.lit('"'), text, F.lit('"'))


def annotations_to_triples(annotations: DataFrame, ns: str = "data:") -> DataFrame:
    """(s, p, o) of annotations: four facets and every value of each."""
    key = F.concat_ws("-", "acc", "type", "property", "source", "sourceid")
    subject = F.concat(F.lit(f"{ns}anno/"), F.md5(key))
    pair = lambda p, o: F.struct(F.lit(ns + p).alias("p"), o.alias("o"))
    facets = F.array(
        pair("hasGlycan", F.concat(F.lit(f"{ns}glycan/"), F.col("acc").cast("string"))),
        *(pair(c, quoted(F.col(c))) for c in ("type", "property", "source", "sourceid")),
    )
    values = F.transform("value", lambda v: F.struct(F.lit(ns + "value").alias("p"), quoted(v).alias("o")))
    return annotations.select(subject.alias("s"), F.explode(F.concat(facets, values)).alias("x")).where("x.o is not null").select("s", "x.p", "x.o").distinct()


def alignments_to_triples(align: DataFrame, classes: DataFrame, ns: str = "motif:") -> DataFrame:
    """(s, p, o): six predicates per hit, where the strict ids stand in for the inclusive ones if strict holds, and four per class row.

    align: motif, structure, type, strict, ids, strict_ids; classes: acc, type, subtype, source."""
    text = lambda c: F.col(c).cast("string")
    hit = F.concat(F.lit(ns), F.concat_ws(":", text("motif"), text("structure"), "type"))
    best = F.when(F.col("strict"), F.col("strict_ids")).otherwise(F.col("ids"))
    pair = lambda p, o: F.struct(F.lit(ns + p).alias("p"), o.alias("o"))
    hits = F.array(pair("a", F.lit("Alignment")), pair("motif", text("motif")), pair("structure", text("structure")), pair("type", F.col("type")), pair("strict", text("strict")), pair("ids", best))
    cls = F.array(pair("glycan", text("acc")), pair("class", F.col("type")), pair("subclass", F.col("subtype")), pair("source", F.col("source")))
    rows = [align.select(hit.alias("s"), F.explode(hits).alias("x")), classes.select(F.concat(F.lit(ns), F.md5(F.concat_ws(":", text("acc"), "type", "subtype"))).alias("s"), F.explode(cls).alias("x"))]
    return reduce(DataFrame.unionByName, rows).where("x.o is not null").select("s", "x.p", "x.o")


#: Levels of nodes that a viewer shows.
VIEWER_LEVELS = ("basecomposition", "composition", "topology", "saccharide")


def viewer_nodes(nodes: DataFrame, edges: DataFrame, synonyms: DataFrame, restriction: DataFrame | None = None) -> DataFrame:
    """(acc, document): a JSON object a node, with sorted keys: archetype, children (of any kind), count (symbols), edgetype
    (`other` for children by other edges), inrestriction, level, score, syms.

    nodes: acc, level, counts (map), score, archetype; edges: parent, child, kind; synonyms: acc, name; restriction: acc.  Nodes
    without counts or of no viewer's level are dropped, and keys that are empty, unknown or false are omitted.  A child by edges
    of both kinds is no other one."""
    listed = lambda c: F.nullif(F.sort_array(c), F.array().cast("array<string>"))
    one = edges.groupBy("parent", F.col("child").cast("string").alias("child")).agg(F.bool_or(F.col("kind") == "subsumed").alias("strict"))
    other = F.collect_list(F.when(~F.col("strict"), F.col("child")))
    kids = one.groupBy(F.col("parent").alias("acc")).agg(listed(F.collect_list("child")).alias("children"), listed(other).alias("others"))
    names = synonyms.where("name is not null").groupBy("acc").agg(listed(F.collect_set("name")).alias("syms"))
    rows = nodes.where(F.col("counts").isNotNull() & F.col("level").isin(*VIEWER_LEVELS)).join(kids, "acc", "left").join(names, "acc", "left")
    if restriction is not None:
        rows = rows.join(restriction.select("acc", F.lit(True).alias("inrestriction")).distinct(), "acc", "left")
    else:
        rows = rows.withColumn("inrestriction", F.lit(None).cast("boolean"))
    edgetype = F.map_from_entries(F.transform("others", lambda c: F.struct(c, F.lit("other"))))
    count = F.map_from_entries(F.array_sort(F.map_entries("counts")))
    fields = ["archetype", "children", count.alias("count"), edgetype.alias("edgetype"), "inrestriction", "level", F.col("score").cast("int").alias("score"), "syms"]
    return rows.select("acc", F.to_json(F.struct(*fields)).alias("document"))


def upsert_annotations(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table, report): new annotations replace all of their accessions; the report names created, updated and
    deleted keys.  Unchanged rows are the old ones; accessions that `new` does not mention are kept."""
    mark = lambda df, n: df.select(*keys, F.col("value").alias(n), F.array_sort("value").alias(f"_{n}"), F.lit(True).alias(f"_in_{n}"))
    named = new.select("acc").distinct().withColumn("_mentioned", F.lit(True))
    both = mark(old, "was").join(mark(new, "is"), keys, "full").join(named, "acc", "left")
    change = (
        F.when(F.col("_in_was").isNull(), "created")
        .when(F.col("_in_is").isNull() & F.col("_mentioned").isNotNull(), "deleted")
        .when(F.col("_in_is").isNotNull() & ~F.col("_was").eqNullSafe(F.col("_is")), "updated")
    )
    told = both.withColumn("change", change)
    table = told.where("change is null or change <> 'deleted'").select(*keys, F.when(F.col("change").isNotNull(), F.col("is")).otherwise(F.col("was")).alias("value"))
    return table, told.where("change is not null").select(*keys, "change")


def assign_ids(new_keys: DataFrame, existing: DataFrame, prefix: str, width: int = 6, key: str = "key") -> DataFrame:
    """(key, id): known keys keep their id; new ones, in order, take the smallest unused numbers, then go on after the largest.

    existing: key, id = prefix and a number.  Gaps are found next to used numbers, so no full sequence is built.
    A number of more than `width` digits keeps them all."""
    number = existing.select(F.col(key), F.regexp_extract("id", r"([0-9]+)$", 1).cast("long").alias("n"))
    fresh = with_position(new_keys.select(key).distinct().join(existing.select(key), key, "left_anti"), [F.asc(key)], "k")
    used = with_position(number.select("n").distinct(), [F.asc("n")], "rank").select("n", (F.col("n") - F.col("rank")).alias("holes"))
    # The k-th unused number is k plus the used numbers below it: those with fewer than k holes before them.
    steps = used.groupBy("holes").agg(F.count("*").alias("c"))
    both = fresh.select(F.col("k").alias("at"), F.lit(1).alias("side"), key, F.lit(0).cast("long").alias("c")).unionByName(steps.select((F.col("holes") + 1).alias("at"), F.lit(0).alias("side"), F.lit(None).cast(dict(fresh.dtypes)[key]).alias(key), "c"))

    numbered = running(both, [F.asc("at"), F.asc("side"), F.asc(key)], {"below": ("sum", "c")}).where("side = 1")
    named = numbered.select(key, F.concat(F.lit(prefix), F.format_string(f"%0{width}d", F.col("at") + F.col("below"))).alias("id"))
    kept = existing.join(new_keys.select(key).distinct(), key, "left_semi").select(key, "id")
    return kept.unionByName(named)


def chromatogram_json(fragments: DataFrame) -> DataFrame:
    """(peptide, charge, document): nested JSON with each fragment's series.  fragments: peptide, charge, label, rt, int."""
    series = fragments.groupBy("peptide", "charge", "label").agg(F.array_sort(F.collect_list(F.struct("rt", "int"))).alias("points"))
    docs = series.groupBy("peptide", "charge").agg(F.array_sort(F.collect_list(F.struct("label", "points"))).alias("series"))
    return docs.select("peptide", "charge", F.to_json(F.struct("peptide", "charge", "series")).alias("document"))


