"""Joins of accessions, cross references, peptides and genes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import followed


def drop_archived(df: DataFrame, archived: DataFrame, acc: str = "acc") -> DataFrame:
    """Rows whose accession is not retired.  Spark broadcasts the list where its size allows."""
    return df.join(archived.select(F.col("acc").alias("_gone")).distinct(), F.col(acc) == F.col("_gone"), "left_anti")


def apply_replacements(df: DataFrame, cols: list[str], archived: DataFrame, replaced: DataFrame) -> DataFrame:
    """In any accession column, replaced accessions take the new one and other archived ones become null."""
    fate = archived.select("acc").distinct().join(replaced.groupBy("acc").agg(F.min("new_acc").alias("new_acc")), "acc", "full")
    for c in cols:
        own = fate.select(F.col("acc").alias("_a"), F.col("new_acc").alias("_new"))
        df = df.join(own, F.col(c) == F.col("_a"), "left").withColumn(c, F.when(F.col("_a").isNull(), F.col(c)).otherwise(F.col("_new"))).drop("_a", "_new")
    return df


def retired_report(known: DataFrame, archived: DataFrame, replaced: DataFrame) -> DataFrame:
    """(acc, replacement): known accessions that are retired, with a replacement that is known too, else -."""
    own = known.select("acc").distinct()
    good = replaced.join(own.select(F.col("acc").alias("new_acc")), "new_acc", "left_semi").groupBy("acc").agg(F.min("new_acc").alias("new_acc"))
    return own.join(archived.select("acc").distinct(), "acc", "left_semi").join(good, "acc", "left").select("acc", F.coalesce("new_acc", F.lit("-")).alias("replacement"))


def crossref_via(a_to_k: DataFrame, b_to_k: list[DataFrame]) -> DataFrame:
    """(a, b) linked through a shared third id, of two or more sources of links."""
    from functools import reduce

    links = reduce(DataFrame.unionByName, [x.select("b", "k") for x in b_to_k]).distinct()
    return a_to_k.select("a", "k").join(links, "k").select("a", "b").distinct()


def resolve_by_name(df: DataFrame, names: DataFrame, column: str, keep_unmatched: bool) -> DataFrame:
    """Add acc by name; names that are unknown give null or drop the row."""
    one = names.groupBy(F.col("name").alias("_name")).agg(F.min("acc").alias("acc"))
    return df.join(one, F.col(column) == F.col("_name"), "left" if keep_unmatched else "inner").drop("_name")


def attach_taxid(df: DataFrame, species: DataFrame, proteins: DataFrame, fixes: DataFrame) -> DataFrame:
    """taxid: a fix of the row's id, else the explicit one, else the protein's, else the species name's; and
    whether its sources disagree.  df: id, taxid, protein, species."""
    by_name = species.groupBy(F.lower("name").alias("_s")).agg(F.min("taxid").alias("_by_name"))
    by_protein = proteins.select(F.col("protein").alias("_p"), F.col("taxid").alias("_by_protein"))
    fixed = fixes.select(F.col("id").alias("_i"), F.col("taxid").alias("_fix"))
    rows = df.join(fixed, F.col("id") == F.col("_i"), "left").join(by_protein, F.col("protein") == F.col("_p"), "left").join(by_name, F.lower("species") == F.col("_s"), "left")
    found = F.array_compact(F.array("taxid", "_by_protein", "_by_name"))
    return rows.select("id", F.coalesce("_fix", "taxid", "_by_protein", "_by_name").alias("taxid"), (F.size(F.array_distinct(found)) > 1).alias("conflict"))


def source_ids_to_accessions(taxa: DataFrame, ids: DataFrame) -> DataFrame:
    """(acc, taxid, source, sourceid) of all accessions of each source's own ids.

    Both sides are made distinct first: then no row comes twice, and the join has no more rows than the result."""
    facts, names = taxa.select("taxid", "source", "sourceid").distinct(), ids.select("source", "sourceid", "acc").distinct()
    return facts.join(names, ["source", "sourceid"]).select("acc", "taxid", "source", "sourceid")


def two_hop_annotations(acc_to_id: DataFrame, names: DataFrame, id_to_value: DataFrame) -> DataFrame:
    """(acc, value) through mapped ids and through composition names that serve as ids."""
    ids = acc_to_id.select("acc", "id").unionByName(names.select("acc", F.col("name").alias("id"))).distinct()
    return ids.join(id_to_value, "id").select("acc", "value").distinct()


def optional_pair_export(annotations: DataFrame, first: str, second: str) -> DataFrame:
    """All (value1, value2) of two properties per accession; value2 empty where there is none."""
    values = lambda p, n: annotations.where(F.col("property") == p).select("acc", F.explode("value").alias(n)).distinct()
    return values(first, "value1").join(values(second, "value2"), "acc", "left").withColumn("value2", F.coalesce("value2", F.lit("")))


def occurrences(text: Column, part: Column) -> Column:
    """1-based starts of all occurrences, overlapping ones too; none of an empty part.

    The text is split before each occurrence in one scan; a piece starts where those before it end."""
    ahead = F.concat(F.lit("(?="), F.concat(F.lit("\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(")"))
    pieces = F.transform(F.split(text, ahead), lambda x: F.length(x))
    summed = F.aggregate(pieces, F.array(F.lit(1)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    starts = F.slice(summed, 1, F.greatest(F.lit(1), F.size(summed) - 1))
    # The first piece starts with the part only where the text does.
    return F.when(F.length(part) > 0, F.filter(starts, lambda i: (i > 1) | F.startswith(text, part))).otherwise(F.array().cast("array<int>"))


def locate_peptides(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """Every occurrence of a peptide in its named proteins: start, end, flanking residues or -, and its site there.

    peptides: pep_id, sequence, site (residue number), proteins array; proteins: acc, protein_sequence.
    Later repeats count too, wherever they lie."""
    pairs = peptides.select("pep_id", "sequence", "site", F.explode("proteins").alias("acc")).distinct().join(proteins, "acc")
    hits = pairs.withColumn("start", F.explode(occurrences(F.col("protein_sequence"), F.col("sequence"))))
    end = F.col("start") + F.length("sequence") - 1
    flank = lambda at: F.coalesce(F.nullif(F.substr("protein_sequence", at, F.lit(1)), F.lit("")), F.lit("-"))
    return hits.select(
        "pep_id", "acc", "start", end.alias("end"),
        F.when(F.col("start") == 1, "-").otherwise(flank(F.greatest(F.lit(1), F.col("start") - 1))).alias("left"),
        flank(end + 1).alias("right"),
        (F.col("start") + F.col("site") - 1).alias("protein_site"),
    )


def annotate_genes(genes: DataFrame, facts: DataFrame, names: DataFrame, sep: str = "::") -> DataFrame:
    """genes with all names of their facts, two hops away, as one sorted list; every row of a gene counts.

    facts: gene, ids packed by sep; names: id, name."""
    each = facts.select("gene", F.explode(F.split("ids", sep)).alias("id")).distinct().join(names, "id")
    listed = each.groupBy("gene").agg(F.array_join(F.sort_array(F.collect_set("name")), sep).alias("facts"))
    return genes.join(listed, "gene", "left").withColumn("facts", F.coalesce("facts", F.lit("")))


def flag_listed(genes: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    """Whether a gene is in a list."""
    return genes.join(listed.select("gene", F.lit(True).alias("_in")).distinct(), "gene", "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")


def orthologs(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, orthologs) of the symmetric pairs between known genes."""
    known = genes.select("gene").distinct()
    both = pairs.select(F.col("a").alias("gene"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("gene"), F.col("a").alias("other")))
    kept = both.join(known, "gene", "left_semi").join(known.withColumnRenamed("gene", "other"), "other", "left_semi")
    return kept.groupBy("gene").agg(F.array_join(F.sort_array(F.collect_set("other")), ";").alias("orthologs"))


def compare_alignments(new: DataFrame, old: DataFrame) -> DataFrame:
    """(motif, structure, differing): positions, from 0, at which two vectors of Y/N differ, for keys in both."""
    both = new.select("motif", "structure", F.col("yn").alias("n")).join(old.select("motif", "structure", F.col("yn").alias("o")), ["motif", "structure"])
    at = F.filter(F.transform("n", lambda x, i: F.when(x != F.get(F.col("o"), i), i)), lambda i: i.isNotNull())
    return both.select("motif", "structure", at.alias("differing")).where(F.size("differing") > 0)


def mass_conflicts(a: DataFrame, b: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(acc, annotated, computed, problem): masses that differ, and accessions with neither."""
    both = a.select("acc", F.col("mass").alias("annotated")).join(b.select("acc", F.col("mass").alias("computed")), "acc", "full")
    problem = F.when(F.abs(F.col("annotated") - F.col("computed")) > tolerance, "differs").when(F.col("annotated").isNull() & F.col("computed").isNull(), "missing")
    return both.withColumn("problem", problem).where("problem is not null")


#: Parts in which a set's structures are listed at most, and bytes of text that a task sends on at once, about.
SLICES, SENT = 16, 8_000_000


def motif_hits(align: DataFrame, motifs: DataFrame) -> DataFrame:
    """(structure, loose, strict): sorted motif ids whose alignment type holds for each structure.

    align: motif, structure, type, strict (one row per holding alignment); motifs: motif_id, structure_acc, alignment.
    A structure's alignments are made one set first.  Each different set is looked up once (or once a slice of its structures), where its
    two lists leave the job: neither ids nor lists are shuffled or sorted.  For that the motifs are sent to each of a few parts of the
    sets, ids in order, and a task holds them as numbers while it goes through its part."""
    kind = F.to_json(F.struct("motif", "type")).alias("kind")
    own = motifs.select("motif_id", F.col("structure_acc").alias("motif"), F.col("alignment").alias("type"))
    known = align.join(own.select("motif", "type").distinct(), ["motif", "type"], "left_semi").select("structure", kind, "strict")
    sets = known.groupBy("structure").agg(F.sort_array(F.collect_set("kind")).alias("l"), F.sort_array(F.collect_set(F.when(F.col("strict"), F.col("kind")))).alias("s"))
    sets = sets.select("structure", F.struct("l", "s").alias("held"))
    at = [F.sha2(F.to_json("held"), 256).alias("set"), F.pmod(F.xxhash64("structure"), F.lit(SLICES)).alias("slice")]
    different = sets.groupBy(*at).agg(F.first("held").alias("held"), F.collect_list(F.struct("structure")).alias("structures"))
    parts = 4 * align.sparkSession.sparkContext.defaultParallelism
    every = own.where("motif_id is not null and motif is not null and type is not null").groupBy("motif_id").agg(F.collect_set(kind).alias("kinds"))
    every = every.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "motif_id", "kinds")
    dealt = every.unionByName(different.select(F.pmod(F.xxhash64("set", "slice"), F.lit(parts)).cast("int").alias("part"), "held", "structures"), allowMissingColumns=True)
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions(F.col("structures").isNotNull(), "motif_id").select(F.col("motif_id").cast("string"), "kinds", "held", "structures")
    return dealt.mapInArrow(_listed, T.StructType([align.schema["structure"], T.StructField("loose", T.StringType()), T.StructField("strict", T.StringType())]))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Structures with their two lists.  Motifs come first, in order; their places stand for them."""
    names, places, ready = [], defaultdict(list), None
    for batch in batches:
        is_set = pc.is_valid(batch.column("structures"))
        for name, kinds in zip(*(batch.filter(pc.invert(is_set)).column(c).to_pylist() for c in ("motif_id", "kinds"))):
            for kind in kinds:
                places[kind].append(len(names))
            names.append(name)
        batch = batch.filter(is_set)
        if not len(batch):
            continue
        if ready is None:
            ready = pa.array(names, pa.string()), {k: np.array(v) for k, v in places.items()}, np.array([len(n.encode()) + 1 for n in names], int)
        ids, where, sizes = ready
        found: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        size = 0
        for held, structures in zip(batch.column("held").to_pylist(), batch.column("structures")):
            two = []
            for kinds in (held["l"], held["s"]):
                taken = np.zeros(len(ids), bool)
                for kind in kinds:
                    if kind in where:
                        taken[where[kind]] = True
                two.append(np.flatnonzero(taken))
            each = sum(int(sizes[t].sum()) for t in two) + 1
            values, step = pc.struct_field(structures.values, 0), max(1, SENT // each)
            for start in range(0, len(values), step):
                found.append((*two, values.slice(start, step)))
                size += each * len(found[-1][2])
                if size >= SENT:
                    yield _texts(found, ids)
                    found, size = [], 0
        if found:
            yield _texts(found, ids)


def _texts(found: list[tuple[np.ndarray, np.ndarray, pa.Array]], ids: pa.Array) -> pa.RecordBatch:
    """The lists of some sets as texts, at each of their structures."""
    again = pa.array(np.repeat(np.arange(len(found)), [len(s) for *_, s in found]))
    texts = []
    for taken in list(zip(*found))[:2]:
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, taken)]), pa.int32()), ids.take(pa.array(np.concatenate(taken))))
        texts.append(pc.binary_join(lists, ";").take(again))
    return pa.RecordBatch.from_arrays([pa.concat_arrays([s for *_, s in found]), *texts], ["structure", "loose", "strict"])


def motif_enzymes(matches: DataFrame, node_enzymes: DataFrame) -> DataFrame:
    """(motif, structure, species, genes): enzymes, without rule violations, of the aligned residues.

    matches: motif, structure, rid; node_enzymes: acc, rid, species, gene, violations."""
    clean = node_enzymes.where("violations = 0").select(F.col("acc").alias("structure"), "rid", "species", "gene")
    return matches.join(clean, ["structure", "rid"]).groupBy("motif", "structure", "species").agg(F.array_join(F.sort_array(F.collect_set("gene")), ",").alias("genes"))


def enzyme_alignments(matches: DataFrame, residues: DataFrame, node_enzymes: DataFrame, species: dict[str, str]) -> DataFrame:
    """(motif, motif_rid, structure, rid, type, idx, node_id, genes by species): aligned residues and those that support them,
    with the enzymes without rule violations; `-` where a species has none.

    matches: motif, motif_rid, structure, rid, type, idx (the number of the map); residues: acc, rid, parent; node_enzymes:
    acc, rid, node_id, species, gene, violations (a null gene for a node without enzyme); species: new column -> name.  The residues
    on the paths from aligned ones to the root support them, as far as they are not aligned themselves in that map; they have no
    motif_rid.  A residue that no node is known for has no row.  Paths are followed once for each residue, by doubling jumps."""
    key = ["motif", "structure", "type", "idx"]
    place = matches.select(F.col("structure").alias("acc"), F.col("rid").alias("id"), F.col("rid").alias("at"), F.lit(0).alias("step")).distinct()
    up = followed(place, residues.select("acc", F.col("rid").alias("at"), F.col("parent").alias("next")), ["acc"]).where("step > 0")
    above = up.select(F.col("acc").alias("structure"), F.col("id").alias("rid"), F.col("at").alias("above"))
    aligned = matches.select(*key, "rid").distinct()
    # Sizes of rows that were exploded are guessed far too small: without the hints Spark would broadcast whole sides.
    support = aligned.join(above.hint("merge"), ["structure", "rid"]).select(*key, F.col("above").alias("rid")).distinct().join(aligned.hint("merge"), [*key, "rid"], "left_anti")
    rows = matches.select(*key, "motif_rid", "rid").unionByName(support, allowMissingColumns=True)
    clean = F.when(F.col("violations") == 0, F.col("gene"))
    listed = {c: F.coalesce(F.nullif(F.array_join(F.sort_array(F.collect_set(F.when(F.col("species") == name, clean))), ","), F.lit("")), F.lit("-")).alias(c) for c, name in species.items()}
    nodes = node_enzymes.groupBy(F.col("acc").alias("structure"), "rid", "node_id").agg(*listed.values())
    return rows.join(nodes.hint("merge"), ["structure", "rid"]).select("motif", "motif_rid", "structure", "rid", "type", "idx", "node_id", *species)
