"""Subsumption and taxonomy hierarchies: closure, reduction, landmarks, propagation of evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage, followed


def edges_of_kind(edges: DataFrame, kind: str | None) -> DataFrame:
    """Edges of one kind; of any kind where kind is None."""
    return edges if kind is None else edges.where(F.col("kind") == kind)


def parents(edges: DataFrame, kind: str | None = None) -> DataFrame:
    return edges_of_kind(edges, kind).select(F.col("child").alias("acc"), F.col("parent").alias("other"))


def children(edges: DataFrame, kind: str | None = None) -> DataFrame:
    return edges_of_kind(edges, kind).select(F.col("parent").alias("acc"), F.col("child").alias("other"))


def add_mass_roots(nodes: DataFrame, edges: DataFrame, root: str = "root") -> DataFrame:
    """Edges and those from a mass node to each parentless node of its bucket, and from the root to mass nodes.

    nodes: (acc, bucket), both strings."""
    tops = nodes.join(edges.select(F.col("child").alias("acc")).distinct(), "acc", "left_anti")
    mass = tops.select(F.concat(F.lit("mass:"), "bucket").alias("parent"), F.col("acc").alias("child"))
    top = mass.select(F.lit(root).alias("parent"), F.col("parent").alias("child")).distinct()
    return edges.select("parent", "child").unionByName(mass).unionByName(top)


def transitive_closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant) pairs. A round joins only the ends of paths of one length, twice that of the round before, with
    all pairs so far, which gives the new ones; rounds grow with the logarithm of the longest path.  Cycles do no harm."""
    paths = cut_lineage(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).where("parent <> child").distinct())
    far = paths  # ends of paths of just the round's length
    after = lambda rest: rest.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("to"))
    joined = lambda rest: far.join(after(rest), "descendant").select("ancestor", F.col("to").alias("descendant")).where("ancestor <> descendant").distinct()
    while True:
        new = cut_lineage(joined(paths).join(paths, ["ancestor", "descendant"], "left_anti"))
        if new.isEmpty():  # a shortest path that is not there would be a new one, or begin with one
            return paths
        far = cut_lineage(joined(far))
        paths = paths.unionByName(new)


def add_piece(pieces: list[tuple[int, DataFrame]], new: DataFrame) -> None:
    """Adds a table to (level, table) pieces; two of one level are written as one of the next, so that after n rounds a plan has
    log n pieces and a row was written as often."""
    level = 0
    while pieces and pieces[-1][0] == level:
        new, level = cut_lineage(pieces.pop()[1].unionByName(new).repartition(*new.columns)), level + 1
    pieces.append((level, new))


def walked(start: DataFrame, step: DataFrame) -> DataFrame:
    """(id, at) of all that `step` (at, next) reaches from `start` (id, at), without the start; only what is new is followed."""
    step = cut_lineage(step.select("at", "next").distinct())
    begin = front = cut_lineage(start.select("id", "at").distinct())
    pieces = [(0, begin)]
    while True:
        seen = reduce(DataFrame.unionByName, (p for _, p in pieces))
        front = cut_lineage(front.join(step, "at").select("id", F.col("next").alias("at")).distinct().join(seen, ["id", "at"], "left_anti"))
        if front.isEmpty():
            return seen.join(begin, ["id", "at"], "left_anti")
        add_piece(pieces, front)


def transitive_reduction(closure: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Pairs of a closure with no node between.

    With the edges (parent, child) that it is the closure of, only these are looked at: no other pair can remain."""
    first = closure if edges is None else edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).where("parent <> child").distinct()
    after = closure.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("to"))
    between = first.join(after, "descendant").select("ancestor", F.col("to").alias("descendant")).distinct()
    return first.join(between, ["ancestor", "descendant"], "left_anti")


def kept_edges(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """(parent, child) of kept nodes between which a path leads over nodes that are not kept, or none at all.

    Only the part of the graph that is not kept is closed."""
    pairs = edges.select("parent", "child").where("parent <> child").distinct()
    up, down = (keep.select(F.col("acc").alias(c)).distinct().withColumn(f"{c}_kept", F.lit(True)) for c in ("parent", "child"))
    named = cut_lineage(pairs.join(up, "parent", "left").join(down, "child", "left").select("parent", "child", F.coalesce("parent_kept", F.lit(False)).alias("from_kept"), F.coalesce("child_kept", F.lit(False)).alias("to_kept")))
    inner = transitive_closure(named.where("not from_kept and not to_kept")).select(F.col("ancestor").alias("child"), "descendant")
    into = named.where("from_kept and not to_kept").select("parent", "child")
    reach = into.unionByName(into.join(inner, "child").select("parent", F.col("descendant").alias("child"))).withColumnRenamed("child", "mid")
    out = named.where("not from_kept and to_kept").select(F.col("parent").alias("mid"), "child")
    return named.where("from_kept and to_kept").select("parent", "child").unionByName(reach.join(out, "mid").select("parent", "child")).distinct()


def restrict_graph(nodes: DataFrame, edges: DataFrame, keep: DataFrame, landmarks: list[str], root: str | None = None, levels: tuple[str, ...] = ()) -> DataFrame:
    """(parent, child, kind): the graph of the kept nodes, their landmark nodes and the root, reduced twice.

    nodes: acc, level and the landmark columns (topology, composition, base composition, mass, archetype); edges: parent,
    child, kind; keep: acc.  Kept are also the ancestors of `keep` of the given levels, by edges of kind subsumed.  Edges
    of kind subsumed are those that remain of such paths, edges of kind other those that remain of paths of any kind and are not
    among the first.  Nodes that are not kept are stepped over; the graph has no cycles."""
    strict = edges_of_kind(edges, "subsumed")
    asked = keep.select("acc").distinct()
    marks = nodes.join(asked, "acc", "left_semi").select(F.explode(F.array("acc", *landmarks)).alias("acc")).where("acc is not null")
    if root is not None:
        marks = marks.unionByName(marks.sparkSession.createDataFrame([(root,)], "acc string"))
    if levels:
        above = walked(asked.select(F.lit(0).alias("id"), F.col("acc").alias("at")), strict.select(F.col("child").alias("at"), F.col("parent").alias("next"))).select(F.col("at").alias("acc"))
        marks = marks.unionByName(above.join(nodes.where(F.col("level").isin(*levels)).select("acc"), "acc", "left_semi"))
    chosen = cut_lineage(marks.distinct())
    reduced = []
    for some in (strict, edges):
        direct = cut_lineage(kept_edges(some, chosen))
        reduced.append(cut_lineage(transitive_reduction(transitive_closure(direct), direct)))
    own, every = (r.select(F.col("ancestor").alias("parent"), F.col("descendant").alias("child")) for r in reduced)
    return own.withColumn("kind", F.lit("subsumed")).unionByName(every.join(own, ["parent", "child"], "left_anti").withColumn("kind", F.lit("other")))


def leaf_root_flags(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(acc, is_leaf, is_root) by presence among parents and children."""
    up = edges.select(F.col("parent").alias("acc")).distinct().withColumn("_p", F.lit(True))
    down = edges.select(F.col("child").alias("acc")).distinct().withColumn("_c", F.lit(True))
    return nodes.select("acc").join(up, "acc", "left").join(down, "acc", "left").select("acc", F.col("_p").isNull().alias("is_leaf"), F.col("_c").isNull().alias("is_root"))


def landmark_members(nodes: DataFrame, closure: DataFrame, landmark: str) -> DataFrame:
    """(acc, member): descendants whose landmark is the node."""
    own = nodes.where(F.col(landmark).isNotNull()).select(F.col("acc").alias("descendant"), F.col(landmark).alias("ancestor"))
    return closure.join(own, ["ancestor", "descendant"], "left_semi").select(F.col("ancestor").alias("acc"), F.col("descendant").alias("member"))


def infer_level(features: DataFrame, annotated: DataFrame) -> DataFrame:
    """(acc, level, inferred, conflict): the annotated level, else one from structure flags.

    features: acc, anomer, position, link, ring, single, stem (booleans).  The order of tests is
    fixed: anomer or non-trivial parent position, any link, single residue with ring, stem."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = (
        F.when(on("anomer") | on("position"), "Saccharide")
        .when(on("link"), "Topology")
        .when(on("single") & on("ring"), "Topology")
        .when(on("stem"), "Composition")
        .otherwise("BaseComposition")
    )
    both = features.join(annotated.select("acc", F.col("level").alias("given")), "acc", "left").withColumn("own", own)
    return both.select("acc", F.coalesce("given", "own").alias("level"), F.col("given").isNull().alias("inferred"), F.coalesce(F.col("given") != F.col("own"), F.lit(False)).alias("conflict"))


def pick_landmark(candidates: DataFrame, annotated: DataFrame, closure: DataFrame) -> DataFrame:
    """(acc, landmark): the annotated candidate, else the one that is an ancestor... of none: the one all others subsume.

    candidates: (acc, landmark).  A candidate that every other candidate is an ancestor of is the most specific."""
    pairs = candidates.alias("x").join(candidates.alias("y"), F.col("x.acc") == F.col("y.acc")).select(F.col("x.acc").alias("acc"), F.col("x.landmark").alias("descendant"), F.col("y.landmark").alias("ancestor"))
    above = pairs.join(closure, ["ancestor", "descendant"], "left_semi").groupBy("acc", F.col("descendant").alias("landmark")).agg(F.count("*").alias("n"))
    size = candidates.groupBy("acc").agg((F.count("*") - 1).alias("others"))
    ranked = candidates.join(above, ["acc", "landmark"], "left").join(size, "acc").join(annotated.select("acc", F.col("landmark").alias("given")), "acc", "left")
    fits = F.when(F.col("landmark") == F.col("given"), 0).when(F.coalesce("n", F.lit(0)) == F.col("others"), 1)
    return ranked.withColumn("fits", fits).where("fits is not null").groupBy("acc").agg(F.min_by("landmark", F.struct("fits", "landmark")).alias("landmark"))


def compose_levels(topo: DataFrame, comp: DataFrame, bcomp: DataFrame) -> DataFrame:
    """(acc, topology, composition, base_composition) by composing three maps (acc, up); levels map to themselves."""
    t = topo.select("acc", F.col("up").alias("topology"))
    c = comp.select(F.col("acc").alias("topology"), F.col("up").alias("composition"))
    b = bcomp.select(F.col("acc").alias("composition"), F.col("up").alias("base_composition"))
    down = t.join(c, "topology", "left").join(b, "composition", "left").select("acc", "topology", "composition", "base_composition")
    of_topo = c.join(b, "composition", "left").select(F.col("topology").alias("acc"), "topology", "composition", "base_composition")
    null = F.lit(None)
    of_comp = b.select(F.col("composition").alias("acc"), null.cast("string").alias("topology"), "composition", "base_composition")
    of_base = b.select(F.col("base_composition").alias("acc"), null.cast("string").alias("topology"), null.cast("string").alias("composition"), "base_composition")
    typed = [x.select("acc", *(F.col(k).cast("string").alias(k) for k in ("topology", "composition", "base_composition"))) for x in (down, of_topo, of_comp, of_base)]
    return reduce(DataFrame.unionByName, typed).distinct()


def subsumption_export(nodes: DataFrame, edges: DataFrame, closure: DataFrame, accs: DataFrame) -> DataFrame:
    """Long (acc, property, value) of listed nodes: level, landmarks, members, relatives, scores.

    nodes: acc, level, topo, comp, bcomp, missing.  Level and MissingScore are the node's; BaseComposition, Composition and
    Topology its landmarks, itself at its own level.  Compositions, Topologies and Saccharides are its descendants of that
    level of which it is the landmark (for a base composition only listed ones).  Subsumes, SubsumedBy (neighbours),
    Ancestor, Descendant, Leaf (descendants without children) and FullyDetermined (those of score 0) are listed nodes.
    The closure is read once upward and once downward; a node's facts come to it before it is dealt out."""
    text_of = lambda df, *cols: df.select(*(F.col(c).cast("string").alias(c) for c in cols))
    facts = nodes.select(*(F.col(c).cast("string").alias(c) for c in ("acc", "level", "topo", "comp", "bcomp")), F.col("missing").cast("int").alias("missing"))
    listed = text_of(accs, "acc").distinct()
    edge, pairs = text_of(edges, "parent", "child"), text_of(closure, "ancestor", "descendant")
    ask = lambda c: listed.select(F.col("acc").alias(c))
    row = lambda name, value: F.struct(F.lit(name).alias("property"), value.cast("string").alias("value"))
    out = lambda df, *rows: df.select("acc", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("acc", "x.property", "x.value").where("value is not null")
    level, acc = F.col("level"), F.col("acc")
    low = lambda own, mark, *under: F.when(level == own, acc).when(level.isin(*under), F.col(mark))
    own = out(
        facts.join(listed, "acc", "left_semi"), row("Level", level), row("MissingScore", F.col("missing")), row("BaseComposition", low("BaseComposition", "bcomp", "Composition", "Topology", "Saccharide")),
        row("Composition", low("Composition", "comp", "Topology", "Saccharide")), row("Topology", low("Topology", "topo", "Saccharide")),
    )
    near = edge.join(ask("parent"), "parent", "left_semi").join(ask("child"), "child", "left_semi")
    beside = near.select(F.col("parent").alias("acc"), F.lit("Subsumes").alias("property"), F.col("child").alias("value")).unionByName(near.select(F.col("child").alias("acc"), F.lit("SubsumedBy").alias("property"), F.col("parent").alias("value")))
    above = pairs.join(ask("descendant"), "descendant", "left_semi").join(ask("ancestor"), "ancestor", "left_semi").select(F.col("descendant").alias("acc"), F.lit("Ancestor").alias("property"), F.col("ancestor").alias("value"))
    inner = edge.select(F.col("parent").alias("acc")).distinct().withColumn("inner", F.lit(True))
    there = facts.join(inner, "acc", "left").join(listed.withColumn("listed", F.lit(True)), "acc", "left")
    there = there.select(F.col("acc").alias("descendant"), level.alias("d_level"), "topo", "comp", "bcomp", "missing", F.col("inner").isNull().alias("leaf"), F.col("listed").isNotNull().alias("listed"))
    down = pairs.join(ask("ancestor"), "ancestor", "left_semi").join(there, "descendant").join(facts.select(acc.alias("ancestor"), "level"), "ancestor", "left").withColumnRenamed("ancestor", "acc")
    value, held = F.col("descendant"), F.col("listed")
    of = lambda mine, mark: (level == mine) & (F.col(mark) == acc)
    member = lambda name, d_level, *tests: F.when((F.col("d_level") == d_level) & reduce(Column.__or__, tests), row(name, value))
    base, comp, topo = of("BaseComposition", "bcomp") & held, of("Composition", "comp"), of("Topology", "topo")
    under = out(
        down, F.when(held, row("Descendant", value)), F.when(held & F.col("leaf"), row("Leaf", value)), F.when(held & (F.col("missing") == 0), row("FullyDetermined", value)),
        member("Compositions", "Composition", base), member("Topologies", "Topology", base, comp), member("Saccharides", "Saccharide", base, comp, topo),
    )
    return reduce(DataFrame.unionByName, (own, beside, above, under)).distinct()


def species_evidence(taxa: DataFrame, groups: DataFrame, blocked: DataFrame) -> DataFrame:
    """(acc, species, evidence): direct evidence per species group, without blocked (acc, species) pairs.

    taxa: acc, taxid, source, sourceid; groups: taxid, species."""
    rows = taxa.join(groups, "taxid").join(blocked, ["acc", "species"], "left_anti")
    text = F.concat_ws(":", "source", "sourceid", F.col("taxid").cast("string"))
    return rows.groupBy("acc", "species").agg(F.array_join(F.array_sort(F.collect_set(text)), ";").alias("evidence"))


def propagate_species(direct: DataFrame, closure: DataFrame, comp: DataFrame) -> DataFrame:
    """(acc, species, kind): Direct, else Subsumption at ancestors, else Composition among members of a Direct row's composition.

    Direct > Subsumption > Composition; Composition starts from Direct rows only."""
    d = direct.select("acc", "species").distinct()
    up = d.join(closure.select(F.col("descendant").alias("acc"), "ancestor"), "acc").select(F.col("ancestor").alias("acc"), "species")
    of = comp.where("comp is not null").select("acc", "comp")
    same = d.join(of, "acc").select("comp", "species").distinct().join(of, "comp").select("acc", "species")
    ranked = d.withColumn("r", F.lit(1)).unionByName(up.withColumn("r", F.lit(2))).unionByName(same.withColumn("r", F.lit(3)))
    names = F.array(F.lit("Direct"), F.lit("Subsumption"), F.lit("Composition"))
    return ranked.groupBy("acc", "species").agg(F.min("r").alias("r")).select("acc", "species", F.get(names, F.col("r") - 1).alias("kind"))


def species_expanded(evidence: DataFrame) -> DataFrame:
    """Evidence text split back into (acc, species, source, sourceid, taxid)."""
    rows = evidence.select("acc", "species", F.explode(F.split("evidence", ";")).alias("e"))
    part = lambda i: F.regexp_extract("e", r"^([^:]*):(.*):([0-9]+)$", i)
    return rows.where(F.col("e").rlike(r":[0-9]+$")).select("acc", "species", part(1).alias("source"), part(2).alias("sourceid"), part(3).cast("int").alias("taxid"))


def prefer_direct(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Where a key has any direct row, its other rows go."""
    return df.withColumn("_any", F.max(F.col(flag).cast("int")).over(Window.partitionBy(*keys))).where((F.col("_any") == 0) | F.col(flag)).drop("_any")


def drop_untyped(df: DataFrame, keys: list[str], subtype: str) -> DataFrame:
    """A blank subtype stays only where its type has no subtype."""
    named = F.max(F.col(subtype).isNotNull().cast("int")).over(Window.partitionBy(*keys))
    return df.withColumn("_named", named).where(F.col(subtype).isNotNull() | (F.col("_named") == 0)).drop("_named")


def propagate(direct: DataFrame, closure: DataFrame, values: list[str]) -> DataFrame:
    """(acc, values, direct): rows and their inheritance by all ancestors; direct evidence replaces inherited."""
    d = direct.select("acc", *values, F.lit(True).alias("direct"))
    up = direct.join(closure.select(F.col("descendant").alias("acc"), "ancestor"), "acc").select(F.col("ancestor").alias("acc"), *values, F.lit(False).alias("direct"))
    return d.unionByName(up).groupBy("acc", *values).agg(F.max("direct").alias("direct"))


def propagate_tissue(direct: DataFrame, closure: DataFrame) -> DataFrame:
    """(taxid, tissue) inherited by ancestors."""
    return propagate(direct, closure, ["taxid", "tissue"])


def propagate_classes(direct: DataFrame, closure: DataFrame) -> DataFrame:
    """(type, subtype) inherited by ancestors; blank subtypes go where the type has one, then direct rows win per type."""
    return prefer_direct(drop_untyped(propagate(direct, closure, ["type", "subtype"]), ["acc", "type"], "subtype"), ["acc", "type"], "direct")


def normalize_name(c: Column) -> Column:
    """White space collapsed and trimmed, lower case."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def resolve_taxid(ids: DataFrame, nodes: DataFrame, merged: DataFrame, names: DataFrame) -> DataFrame:
    """ids (taxid, name) with `resolved`: the current id, else what it was merged into, else by normalised name."""
    now = nodes.select(F.col("tax_id").alias("taxid"), F.col("tax_id").alias("_now")).distinct()
    old = merged.select(F.col("old_id").alias("taxid"), F.col("tax_id").alias("_merged"))
    by_name = names.groupBy(normalize_name(F.col("name")).alias("_key")).agg(F.min("tax_id").alias("_named"))
    rows = ids.withColumn("_key", normalize_name(F.col("name"))).join(now, "taxid", "left").join(old, "taxid", "left").join(by_name, "_key", "left")
    return rows.withColumn("resolved", F.coalesce("_now", "_merged", "_named")).drop("_now", "_merged", "_named", "_key")


def lineage_pairs(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, ancestor, step) for each distinct id that is a node and itself (step 0), up to the root whatever the depth."""
    known = nodes.select(F.col("tax_id").alias("at")).distinct()
    start = ids.select("id", F.col("id").alias("at"), F.lit(0).alias("step")).distinct().join(known, "at", "left_semi")
    up = nodes.where("parent_id <> tax_id").select(F.col("tax_id").alias("at"), F.col("parent_id").alias("next"))
    return followed(start, up, []).select("id", F.col("at").alias("ancestor"), "step")


def ranked_ancestors(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, rank, ancestor): each id's nearest ancestor, itself included, of every rank; unranked nodes are ignored."""
    ranks = nodes.where("rank is not null and rank not in ('', 'no rank')").select(F.col("tax_id").alias("ancestor"), "rank")
    return lineage_pairs(ids, nodes).join(ranks, "ancestor").groupBy("id", "rank").agg(F.min_by("ancestor", "step").alias("ancestor"))


def lineage(ids: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(id, lineage): names of ranked ancestors from the top, `;`-joined."""
    ranked = nodes.where("rank is not null and rank not in ('', 'no rank')").select(F.col("tax_id").alias("ancestor"))
    named = lineage_pairs(ids, nodes).join(ranked, "ancestor").join(names.select(F.col("tax_id").alias("ancestor"), "name"), "ancestor")
    top = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("step", "name")))), lambda x: x["name"])
    return named.groupBy("id").agg(F.array_join(top, ";").alias("lineage"))


def taxon_descendants(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, descendant) of all descendants, walked down from the ids."""
    edges = nodes.where("parent_id is not null and parent_id <> tax_id").select(F.col("parent_id").alias("at"), F.col("tax_id").alias("next"))
    return walked(ids.select("id", F.col("id").alias("at")), edges).select("id", F.col("at").alias("descendant"))


def restrict_to_taxa(glycans: DataFrame, taxa: DataFrame, nodes: DataFrame, ids: DataFrame, resource: str) -> DataFrame:
    """Glycans with a taxon in or under the ids and a row of the given resource."""
    under = lineage_pairs(taxa.select(F.col("taxid").alias("id")), nodes).join(ids.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("id").alias("taxid")).distinct()
    good = taxa.join(under, "taxid", "left_semi").select("acc").distinct()
    listed = taxa.where(F.col("source") == resource).select("acc").distinct()
    return glycans.join(good, "acc", "left_semi").join(listed, "acc", "left_semi")


def closure_accessions(accs: DataFrame, closure: DataFrame, landmark: DataFrame) -> DataFrame:
    """Accessions that ancestors and members of the same landmark add to `accs`, until nothing is added.

    landmark: (acc, mark)."""
    start = cut_lineage(accs.select("acc").distinct())
    up = closure.select(F.col("descendant").alias("acc"), F.col("ancestor").alias("new"))
    have, front, marks = start, start, None
    while True:  # only what is new is followed, and a landmark's members come once
        above = front.join(up, "acc").select(F.col("new").alias("acc"))
        met = front.join(landmark, "acc").select("mark").distinct()
        met = cut_lineage(met if marks is None else met.join(marks, "mark", "left_anti"))
        marks = met if marks is None else marks.unionByName(met)
        beside = landmark.join(met, "mark", "left_semi").select("acc")
        front = cut_lineage(above.unionByName(beside).distinct().join(have, "acc", "left_anti"))
        if front.isEmpty():
            return have.join(start, "acc", "left_anti")
        have = have.unionByName(front)


def minimal_topologies(nodes: DataFrame, closure: DataFrame, base: DataFrame) -> DataFrame:
    """(acc, topology): topologies under each base composition that have no ancestor among them.

    nodes: acc, level."""
    topo = nodes.where("level = 'Topology'").select(F.col("acc").alias("descendant"))
    under = closure.join(base.select(F.col("acc").alias("ancestor")), "ancestor", "left_semi").join(topo, "descendant", "left_semi").select(F.col("ancestor").alias("acc"), F.col("descendant").alias("topology"))
    # Each topology is followed down, not held against all others of its composition.
    covered = under.join(closure.select(F.col("ancestor").alias("topology"), "descendant"), "topology").select("acc", F.col("descendant").alias("topology")).distinct()
    return under.join(covered, ["acc", "topology"], "left_anti")
