"""Motif alignment: where a motif's residues can lie in a structure, undetermined ones included.

motifs, structures: acc, residues (array of structs rid, parent, symbol, anomer, pos and, optionally, maybe: the
possible parents of a residue without a known one) and, optionally, n_subst, mass and repeated.

A motif's links lie on links of the structure, inclusively also on possible ones.  Unknown values of the motif accept
anything; unknown anomers and positions of the structure fit any, unless `strict`.  Where several floating parts are equal (same
residues, same possible parents, no part's possible parent among their own residues) any of them can stand for any other,
so only the number in use is followed: for each motif residue on each structure residue, all vectors of how many parts of each
kind the motif below it takes, and all that the rest of the motif takes.  A pair of both that takes no more parts than
there are proves that the residue is matched.  All maps are so covered without being listed, and nothing is capped.

Defined results: a parent that is no residue of the structure counts as none; a structure without exactly one residue
that has neither parent nor possible parent (a composition) aligns with nothing; parents that form a cycle are an error;
repeated residue numbers are one residue, the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .structures import known

#: Kinds of alignment.
KINDS = ("core", "substructure", "whole", "nonreducing")
#: Structures that a worker keeps prepared.
KEPT = 5_000

Usage = tuple  # parts of each kind that are taken


class Shape:
    """Residues and links of a structure: node, parent, kids, maybe by residue number; `up` has children before parents."""

    def __init__(self, residues):
        self.node, self.parent, self.maybe = {}, {}, {}
        for r in residues:
            rid, parent = int(r["rid"]), known(r["parent"])
            self.node[rid] = (known(r["symbol"]), known(r["anomer"]), known(r["pos"]))
            self.parent[rid] = parent
            asked = r["maybe"] if "maybe" in r and r["maybe"] is not None else ()
            self.maybe[rid] = frozenset(int(m) for m in asked if m == m and m is not None) if parent is None else frozenset()
        self.kids: dict[int, list[int]] = {rid: [] for rid in self.node}
        for rid, parent in self.parent.items():
            if parent in self.kids:
                self.kids[parent].append(rid)
            else:
                self.parent[rid] = None
        self.maybe = {rid: frozenset(x for x in m if x in self.node) for rid, m in self.maybe.items()}
        tops = [rid for rid, parent in self.parent.items() if parent is None]
        fixed = [rid for rid in tops if not self.maybe[rid]]
        self.root = fixed[0] if len(fixed) == 1 else None
        down = list(tops)
        for rid in down:
            down.extend(self.kids[rid])
        if len(down) != len(self.node):
            raise ValueError("parents form a cycle")
        self.up = down[::-1]
        self.parts = [rid for rid in tops if self.maybe[rid]]

    def below(self, rid: int) -> list[int]:
        """A residue and all under it, equal branches in any order, others in the order of what they hold."""
        out = [rid]
        for at in out:
            out.extend(sorted(self.kids[at], key=lambda k: repr(self.form[k])))
        return out

    def classes(self) -> list[list[int]]:
        """Floating parts by kind."""
        self.form: dict[int, int] = {}
        seen: dict[tuple, int] = {}  # what is under a residue -> a number
        for rid in self.up:
            own = (self.node[rid], tuple(sorted(self.form[k] for k in self.kids[rid])))
            self.form[rid] = seen.setdefault(own, len(seen))
        asked = frozenset().union(*self.maybe.values())
        found: dict[tuple, list[int]] = {}
        for rid in self.parts:
            alone = rid if asked.intersection(self.below(rid)) else None
            found.setdefault((self.form[rid], self.maybe[rid], alone), []).append(rid)
        return list(found.values())


class Target(Shape):
    """A structure to align with. Of equal floating parts the first stands for all; `same` has the others' residues."""

    def __init__(self, residues):
        super().__init__(residues)
        kinds = self.classes()
        self.none = (0,) * len(kinds)
        self.counts = tuple(map(len, kinds))
        self.same = {rid: [rid] for rid in self.node}
        self.loose: dict[int, list[tuple[int, int]]] = {rid: [] for rid in self.node}  # (part, kind) that may hang on a residue
        others = set()
        for k, (first, *rest) in enumerate(kinds):
            own = self.below(first)
            for part in rest:
                for a, b in zip(own, self.below(part)):
                    self.same[a].append(b)
                    others.add(b)
            for rid in self.maybe[first]:
                self.loose[rid].append((first, k))
        self.rows = [rid for rid in self.up if rid not in others]

    def plus(self, *usages: Usage) -> Usage | None:
        """Parts taken in all, None if that is more than there are."""
        total = tuple(map(sum, zip(*usages))) if self.counts else ()
        return total if all(t <= c for t, c in zip(total, self.counts)) else None


def accepted(general: tuple, special: tuple, strict: bool) -> bool:
    """Whether a motif's residue can lie on a structure's; an anomer or position that the structure does not tell fits unless strict."""
    return all(g is None or g == s or (k > 0 and s is None and not strict) for k, (g, s) in enumerate(zip(general, special)))


class Alignment:
    """All maps of a motif into a structure, by inside and outside usages; loose: possible links count as links;
    ends: a motif residue without children lies only on one without."""

    def __init__(self, motif: Shape, target: Target, strict: bool, loose: bool, ends: bool):
        self.motif, self.target, self.loose = motif, target, loose
        self.options = {}
        self.inside: dict[tuple[int, int], set[Usage]] = {}
        for j in target.rows:
            self.options[j] = [(t, 1 << b, target.none) for b, t in enumerate(target.kids[j])]
            if loose:
                self.options[j] += [(part, 0, tuple(int(x == k) for x in range(len(target.counts)))) for part, k in target.loose[j]]
        for i in motif.up:
            for j in target.rows:
                if accepted(motif.node[i], target.node[j], strict) and not (ends and not motif.kids[i] and target.kids[j]):
                    states = self.steps(motif.kids[i], j)[-1]
                    if states:
                        self.inside[i, j] = {u for _, u in states}

    def steps(self, kids: list[int], j: int) -> list[set[tuple[int, Usage]]]:
        """After each of the children in order: (places taken among j's links, parts taken) of all ways to put them."""
        out = [{(0, self.target.none)}]
        for c in kids:
            now = set()
            for t, bit, cost in self.options[j]:
                for v in self.inside.get((c, t), ()):
                    for mask, u in out[-1]:
                        if not mask & bit and (w := self.target.plus(u, v, cost)) is not None:
                            now.add((mask | bit, w))
            out.append(now)
        return out

    def roots(self) -> list[int]:
        """Residues on which the motif's root can lie."""
        return [j for j in self.target.rows if (self.motif.root, j) in self.inside]

    def matched(self, root: int) -> tuple[set[int], set[str]]:
        """Residues and links of all maps that put the motif's root there. A link is parent-child, a possible one -child."""
        plus, of = self.target.plus, self.target
        outside: dict[tuple[int, int], set[Usage]] = {(self.motif.root, root): {of.none}}
        ids, links = set(of.same[root]), set()
        todo = [(self.motif.root, root)]
        for i, j in todo:
            kids = self.motif.kids[i]
            front, back = self.steps(kids, j), self.steps(kids[::-1], j)[::-1]
            for a, c in enumerate(kids):
                for t, bit, cost in self.options[j]:
                    if (c, t) not in self.inside:
                        continue
                    rest = {w for m, u in front[a] for n, v in back[a + 1] if not m & n and not (m | n) & bit and (w := plus(u, v, cost)) is not None}
                    fit = {w for r in rest for o in outside[i, j] if (w := plus(r, o)) is not None and any(plus(w, v) is not None for v in self.inside[c, t])}
                    if fit:
                        if (c, t) not in outside:
                            todo.append((c, t))
                        outside.setdefault((c, t), set()).update(fit)
                        ids.update(of.same[t])
                        links.update(f"{'' if of.parent[q] is None else of.parent[q]}-{q}" for q in of.same[t])
        return ids, links


def alignments(motif: Shape, target: Target, equal: bool = True, repeated: bool = False) -> Iterator[tuple[str, bool, list[int], list[str]]]:
    """(kind, strict, residues, links) of all kinds that hold; strict, without possible links, only where inclusive holds.

    equal: substituents and mass do not speak against a whole match; repeated: one of both has repeats."""
    if motif.root is None or target.root is None or motif.parts or len(motif.node) > len(target.node):
        return
    order = lambda links: sorted(links, key=lambda x: (int(x.split("-")[1]), x))
    ends = True
    for strict in (False, True):
        found = Alignment(motif, target, strict, not strict, False)
        hits = {j: found.matched(j) for j in found.roots()}
        if not hits:
            return
        if target.root in hits:
            ids, links = hits[target.root]
            yield "core", strict, sorted(ids), order(links)
            if equal and not repeated and len(motif.node) == len(target.node):
                yield "whole", strict, sorted(ids), order(links)
        ids, links = (set().union(*x) for x in zip(*hits.values()))
        yield "substructure", strict, sorted(ids), order(links)
        if ends and not repeated:
            found = Alignment(motif, target, strict, not strict, True)
            hits = {j: found.matched(j) for j in found.roots()}
            if hits:
                ids, links = (set().union(*x) for x in zip(*hits.values()))
                yield "nonreducing", strict, sorted(ids), order(links)
            ends = bool(hits)


def _described(df: DataFrame, acc: str, residues: str) -> list[Column]:
    """Columns of one side, with those that a table may lack."""
    there = set(df.columns)
    extra = {"n_subst": F.lit(0), "mass": F.lit(None), "repeated": F.lit(False)}
    kinds = {"n_subst": "int", "mass": "double", "repeated": "boolean"}
    facts = [F.coalesce(F.col(c) if c in there else default, default).cast(kinds[c]).alias(f"{residues}_{c}") for c, default in extra.items()]
    return [F.col("acc").alias(acc), F.col("residues").alias(residues), F.size("residues").alias(f"{residues}_n"), *facts]


def align_motifs(motifs: DataFrame, structures: DataFrame, slices: int = 8) -> DataFrame:
    """(motif, structure, type, strict, ids, links): every kind of alignment of every motif that holds, with the residues
    and links of all its maps.

    A motif meets only structures that have its rarest known symbol, are not smaller and have all its known symbols; a
    motif of unknown symbols only meets all.  Structures are cut by hash into slices, to which motifs are copied, so that
    a common symbol is many tasks.  Equal structures are aligned once, and what is found comes back to all of them."""
    facts = [c for c in ("residues", "n_subst", "mass", "repeated") if c in structures.columns]
    named = structures.select("acc", F.sha2(F.to_json(F.struct(*facts)), 256).alias("_class"), *facts)
    members = named.select("_class", F.col("acc").alias("structure"))
    structures = named.groupBy("_class").agg(F.first(F.struct(*facts)).alias("r")).select(F.col("_class").alias("acc"), "r.*")
    symbols = F.array_compact(F.array_distinct(F.transform("residues", lambda r: r["symbol"])))
    theirs = structures.select(*_described(structures, "structure", "s"), symbols.alias("s_symbols"), F.pmod(F.xxhash64("acc"), F.lit(slices)).cast("int").alias("slice"))
    met = theirs.withColumn("symbol", F.explode(F.concat("s_symbols", F.array(F.lit("")))))
    mine = motifs.select(*_described(motifs, "motif", "m"), symbols.alias("symbols"))
    each = mine.withColumn("symbol", F.explode(F.when(F.size("symbols") > 0, F.col("symbols")).otherwise(F.array(F.lit("")))))
    counts = met.groupBy("symbol").agg(F.count("*").alias("count"))
    rarest = each.join(counts, "symbol", "left").groupBy("motif").agg(F.min_by("symbol", F.struct(F.coalesce("count", F.lit(0)), "symbol")).alias("symbol"))
    sent = mine.join(rarest, "motif").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    pairs = sent.join(met, ["symbol", "slice"]).where((F.col("m_n") <= F.col("s_n")) & (F.size(F.array_except("symbols", "s_symbols")) == 0))
    whole = (F.col("m_n_subst") == F.col("s_n_subst")) & F.round("m_mass", 4).eqNullSafe(F.round("s_mass", 4))
    rows = pairs.select("motif", "structure", "m", "s", whole.alias("equal"), (F.col("m_repeated") | F.col("s_repeated")).alias("repeated"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes: dict = {}
        targets: dict = {}
        for df in batches:
            out = []
            if len(targets) > KEPT:
                targets.clear()
            for name, structure, m, s, equal, repeated in df.itertuples(index=False):
                if name not in shapes:
                    shapes[name] = Shape(m)
                if structure not in targets:
                    targets[structure] = Target(s)
                for kind, strict, ids, links in alignments(shapes[name], targets[structure], equal, repeated):
                    out.append((name, structure, kind, strict, ",".join(map(str, ids)), ",".join(links)))
            yield pd.DataFrame(out, columns=["motif", "structure", "type", "strict", "ids", "links"])

    found = rows.mapInPandas(run, f"motif {dict(motifs.dtypes)['acc']}, structure string, type string, strict boolean, ids string, links string")
    return found.withColumnRenamed("structure", "_class").join(members, "_class").select("motif", "structure", "type", "strict", "ids", "links")
