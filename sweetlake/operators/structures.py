"""Structure trees as residue tables: comparison, fragments, trimming, classes.

residues: acc, rid (root 1), parent (null for the root), symbol, anomer, pos; null symbol, anomer or pos is unknown.
An unknown value of the more general side accepts anything; a known one does not accept unknown.  A structure with
several residues without parent is undetermined; one without any link is a composition.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .lineage import followed

#: Mass of the two hydrogens by which a structure with alditol stands above that without.
ALDITOL = 2.015650070

Node = tuple  # (symbol, anomer, pos)


def known(value):
    """The value, None for a missing one; whole numbers as int however pandas holds them."""
    if value is None or value != value:
        return None
    return int(value) if isinstance(value, float) else value


class Tree:
    """A tree, or the parts of an undetermined structure, of (symbol, anomer, pos) by residue number.

    A parent that is no residue of the structure counts as none; parents that form a cycle are an error."""

    def __init__(self, residues):
        self.node = {int(r["rid"]): (known(r["symbol"]), known(r["anomer"]), known(r["pos"])) for r in residues}
        self.kids = {r: [] for r in self.node}
        # Optional fields: substituents (name, pos) of a residue, and the residue on which a repeat unit's end hangs the next unit.
        self.subst = {int(r["rid"]): [(x["name"], known(x["pos"])) for x in r["subst"]] for r in residues if "subst" in r and r["subst"] is not None and len(r["subst"])}
        self.bridge = {int(r["rid"]): int(r["bridge"]) for r in residues if "bridge" in r and known(r["bridge"]) is not None}
        self.tops = []
        for rid, parent in {int(r["rid"]): known(r["parent"]) for r in residues}.items():
            (self.tops if parent not in self.kids else self.kids[parent]).append(rid)
        self.tops.sort()
        self.root = self.tops[0] if self.tops else None
        down = list(self.tops)
        for rid in down:
            down.extend(self.kids[rid])
        if len(down) != len(self.node):
            raise ValueError("parents form a cycle")


def accepts(general: Node, special: Node, strict: bool, classes: dict[str, str] | None = None) -> bool:
    """Whether a residue accepts another; a symbol that is a class accepts its members."""
    if strict:
        return general == special and None not in general
    member = general[0] is not None and (classes or {}).get(special[0]) == general[0]
    return all(g is None or g == s or (member and k == 0) for k, (g, s) in enumerate(zip(general, special)))


def same_substituents(general: list[tuple], special: list[tuple]) -> bool:
    """Whether both have as many substituents of each name, and the special one has all positions that the general one knows."""
    names = lambda xs: Counter(n for n, _ in xs)
    return names(general) == names(special) and not Counter(x for x in general if x[1] is not None) - Counter(special)


def subsumes_tree(a: Tree, b: Tree, classes: dict[str, str] | None = None) -> bool:
    """Whether all residues of a accept those of b, one to one, and each of a's links is a link of b.

    A composition accepts any structure of fitting residues.  A tree's root lies on the root.  The parts of an
    undetermined structure lie anywhere; one that has links accepts no composition.  Substituents must be those of the residue
    that a residue lies on.  Of two structures with repeats the bridges must lie on each other; one with and one without, or an
    undetermined one with repeats, are not decided and so not accepted."""
    if len(a.node) != len(b.node) or not a.node or len(a.bridge) != len(b.bridge):
        return False
    if a.bridge and (len(a.tops) > 1 or len(b.tops) > 1):
        return False
    order, todo = [], [(t, None) for t in sorted(a.tops, key=lambda t: not a.kids[t])]
    while todo:
        i, parent = todo.pop(0)
        order.append((i, parent))
        todo = [(k, i) for k in a.kids[i]] + todo
    ok = lambda i, j: accepts(a.node[i], b.node[j], False, classes) and same_substituents(a.subst.get(i, []), b.subst.get(j, []))
    bridged = lambda: all(b.bridge.get(at[i]) == at.get(k) for i, k in a.bridge.items())
    at: dict[int, int] = {}
    loose = [i for i, parent in order if parent is None and not a.kids[i]] if len(a.tops) > 1 else []
    tight = [(i, parent) for i, parent in order if i not in loose]

    def rest(used: set) -> bool:
        """Residues without links take what is left: a matching, not a search."""
        taken: dict[int, int] = {}

        def place(i: int, tried: set) -> bool:
            for j in b.node:
                if j not in used and j not in tried and ok(i, j):
                    tried.add(j)
                    if j not in taken or place(taken[j], tried):
                        taken[j] = i
                        return True
            return False

        return all(place(i, set()) for i in loose)

    def options(k: int) -> Iterator[int]:
        i, parent = tight[k]
        if parent is not None:
            return iter(b.kids[at[parent]])
        return iter(list(b.node) if len(a.tops) > 1 else b.tops if len(b.tops) == 1 else [])

    # Residues with links are put one after the other; the last that has another place is moved when one finds none.
    used: set[int] = set()
    stack = [options(0)] if tight else []
    if not tight:
        return rest(used)
    while stack:
        i = tight[len(stack) - 1][0]
        if i in at:
            used.discard(at.pop(i))
        j = next((j for j in stack[-1] if j not in used and ok(i, j)), None)
        if j is None:
            stack.pop()
            continue
        at[i] = j
        used.add(j)
        if len(stack) < len(tight):
            stack.append(options(len(stack)))
        elif bridged() and rest(used):
            return True
    return False


def gathered(residues: DataFrame) -> DataFrame:
    """(acc, residues): one bounded array per structure."""
    return residues.groupBy("acc").agg(F.array_sort(F.collect_list(F.struct("rid", "parent", "symbol", "anomer", "pos"))).alias("residues"))


def subsumption_pairs(structures: DataFrame, slices: int = 8, classes: dict[str, str] | None = None, both: bool = False) -> DataFrame:
    """(parent, child, kind): pairs in one rounded-mass bucket of which the parent accepts the child.

    structures: acc, mass, alditol (boolean), residues (optionally with subst, an array of name and pos, and bridge); classes: symbol -> its class, which as a symbol accepts it.
    One with alditol enters a second bucket, without it, only as the child; those edges are +aldi.  Pairs must agree
    in size and, where the parent's symbols are all known, in classes before trees are compared.  Hot buckets are
    cut: the child side by hash into slices, to which the parent side is copied.  Equal pairs of one
    mass go from the smaller accession to the larger, or, with `both`, both ways."""
    classes = classes or {}
    bucket = lambda m: F.concat_ws("/", F.format_number(m, 2), F.size("residues").cast("string"))
    of = lambda c: reduce(lambda so_far, kv: F.when(c == kv[0], kv[1]).otherwise(so_far), classes.items(), c)
    kinds = F.array_join(F.array_sort(F.transform("residues", lambda r: of(r["symbol"]))), ",")
    base = structures.select("acc", "mass", "alditol", "residues", kinds.alias("kinds"))
    parent = base.select(
        F.col("acc").alias("parent"), bucket(F.col("mass")).alias("bucket"), F.col("kinds").alias("p_kinds"), F.exists("residues", lambda r: r["symbol"].isNull()).alias("open"),
        F.col("residues").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
    )
    own = F.struct(bucket(F.col("mass")).alias("bucket"), F.lit("subsumed").alias("kind"))
    extra = F.when(F.col("alditol"), F.struct(bucket(F.col("mass") - ALDITOL).alias("bucket"), F.lit("+aldi").alias("kind")))
    child = base.select(F.col("acc").alias("child"), F.col("kinds").alias("c_kinds"), F.col("residues").alias("c"), F.pmod(F.xxhash64("acc"), F.lit(slices)).cast("int").alias("slice"), F.explode(F.array_compact(F.array(own, extra))).alias("b"))
    child = child.select("child", "c_kinds", "c", "slice", "b.bucket", "b.kind")
    pairs = parent.join(child, ["bucket", "slice"]).where("parent <> child and (open or p_kinds = c_kinds)")

    @F.pandas_udf("boolean")
    def subsumes(general: pd.Series, special: pd.Series) -> pd.Series:
        return pd.Series([subsumes_tree(Tree(g), Tree(s), classes) for g, s in zip(general, special)], dtype=bool)

    down = pairs.where(subsumes("p", "c"))
    if not both:  # an alditol's pair comes one way only, and stays
        down = down.withColumn("equal", subsumes("c", "p")).where(~F.col("equal") | (F.col("parent") < F.col("child")) | (F.col("kind") == "+aldi"))
    return down.select("parent", "child", "kind")


def subsumption_classes(structures: DataFrame, slices: int = 8, classes: dict[str, str] | None = None) -> DataFrame:
    """(parent, child, kind): `subsumption_pairs` of class representatives, and a row of kind `same` from each representative to
    every other member of its class.

    A class has all structures of equal residues, substituents and bridges, equal rounded mass and equal alditol; its least accession
    stands for it.  Every pair of structures follows: members take their class's rows; of two members of one class, or of two classes
    that are told both ways, the smaller accession is the parent.  So trees are compared once a pair of different ones, and rows grow with structures, not with their pairs."""
    keyed = structures.withColumns({"_own": F.format_number("mass", 2), "_plain": F.when(F.col("alditol"), F.format_number(F.col("mass") - ALDITOL, 2))})
    same = [F.col(c) for c in ("_own", "_plain", "alditol", "residues")]
    named = keyed.select("acc", "mass", "alditol", "residues", F.sha2(F.to_json(F.struct(*same)), 256).alias("_class"))
    first = named.groupBy("_class").agg(F.min_by(F.struct("acc", "mass", "alditol", "residues"), "acc").alias("r"))
    pairs = subsumption_pairs(first.select("r.*"), slices, classes, both=True)
    members = named.select("acc", "_class").join(first.select("_class", F.col("r.acc").alias("parent")), "_class").where("acc <> parent")
    return pairs.unionByName(members.select("parent", F.col("acc").alias("child"), F.lit("same").alias("kind")))


def cleaved(tree: Tree, enzyme: dict) -> list[int]:
    """Residues that an enzyme takes off a tree, in order; the tree loses them.

    enzyme: symbol; optionally anomer and parent, which the leaf and the residue that it hangs on must not contradict,
    protectors (symbols that, also on that residue, protect the leaf) and once (only what can go at the start goes).
    An unknown symbol or anomer contradicts nothing, so it also protects.  A residue without parent is never taken."""
    fits = lambda i, symbol, anomer=None: tree.node[i][0] in (None, symbol) and (anomer is None or tree.node[i][1] in (None, anomer))
    up = {k: i for i, kids in tree.kids.items() for k in kids}

    def can_go(i: int) -> bool:
        if i not in up or tree.kids[i] or not fits(i, enzyme["symbol"], enzyme.get("anomer")):
            return False
        if enzyme.get("parent") and not fits(up[i], enzyme["parent"]):
            return False
        return not any(k != i and fits(k, p) for p in enzyme.get("protectors", ()) for k in tree.kids[up[i]])

    todo, gone = sorted(i for i in tree.node if can_go(i)), []
    while todo:
        i = todo.pop()
        if i not in up or not enzyme.get("once") and not can_go(i):
            continue
        parent = up.pop(i)
        tree.kids[parent].remove(i)
        del tree.node[i], tree.kids[i]
        gone.append(i)
        if not enzyme.get("once"):  # the residue above may be a leaf now, and one beside it no longer protected
            todo += [k for k in (parent, *tree.kids[parent]) if can_go(k)]
    return gone


def digest(structures: DataFrame, enzymes: list[dict], together: bool = False) -> DataFrame:
    """(acc, cut, counts, residues): structures after enzymes (see `cleaved`) in turn; `together`: all in turn until none takes any.

    cut: what each enzyme took, sorted; counts: how many, one count an enzyme; residues: what is left.  acc gets -suffix and
    count for each enzyme with a suffix that took any.  Helper code sees one structure at a time."""

    @F.pandas_udf(ArrayType(ArrayType(IntegerType())))
    def taken(residues: pd.Series) -> pd.Series:
        out = []
        for rs in residues:
            tree, gone = Tree(rs), [[] for _ in enzymes]
            while True:
                now = [cleaved(tree, e) for e in enzymes]
                for so_far, more in zip(gone, now):
                    so_far += more
                if not together or not any(now):
                    break
            out.append([sorted(g) for g in gone])
        return pd.Series(out)

    rows = structures.select("acc", "residues", taken("residues").alias("cut"))
    counts = F.transform("cut", lambda x: F.size(x))
    name = F.concat(F.col("acc").cast("string"), *(F.when(counts[k] > 0, F.concat(F.lit("-" + e["suffix"]), counts[k].cast("string"))).otherwise("") for k, e in enumerate(enzymes) if e.get("suffix")))
    kept = F.filter("residues", lambda r: ~F.array_contains(F.flatten("cut"), r["rid"]))
    return rows.select(name.alias("acc"), "cut", counts.alias("counts"), kept.alias("residues"))


def trim_leaves(structures: DataFrame, symbols: list[str], once: bool = False, suffix: str = "t") -> DataFrame:
    """(acc, removed, residues, n_removed): leaves of the symbols are removed, repeatedly unless `once`; unknown ones stay.

    Without conditions that is what hangs below the root under symbols of the list only, so no search is needed."""
    listed = F.array(*map(F.lit, symbols))

    @F.pandas_udf(ArrayType(IntegerType()))
    def gone(residues: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for rs, allowed in zip(residues, names):
            tree, allowed, down = Tree(rs), set(allowed), []
            down += tree.tops
            for i in down:
                down += tree.kids[i]
            free, tops = set(), set(tree.tops)
            for i in reversed(down):
                if i not in tops and tree.node[i][0] in allowed and (not tree.kids[i] or not once and free.issuperset(tree.kids[i])):
                    free.add(i)
            out.append(sorted(free))
        return pd.Series(out)

    rows = structures.withColumn("removed", gone("residues", listed))
    kept = F.filter("residues", lambda r: ~F.array_contains("removed", r["rid"]))
    name = F.when(F.size("removed") > 0, F.concat(F.col("acc").cast("string"), F.lit(suffix), F.size("removed").cast("string"))).otherwise(F.col("acc").cast("string"))
    return rows.select(name.alias("acc"), "removed", kept.alias("residues"), F.size("removed").alias("n_removed"))


def fragment_ions(residues: DataFrame, masses: DataFrame) -> DataFrame:
    """(acc, rid, n, mass, rest): size and mass of the subtree cut at each link, and of its complement.

    Each residue is followed up to the root by doubling jumps, so rows grow with residues times depth and rounds
    with the logarithm of the depth.  A part with a residue of unknown mass has a null mass."""
    node = residues.join(masses, "symbol", "left").select("acc", "rid", "parent", "mass")
    jump = node.select("acc", F.col("rid").alias("at"), F.col("parent").alias("next"))
    above = followed(node.select("acc", F.col("rid").alias("id"), F.col("rid").alias("at"), F.lit(0).alias("step")), jump, ["acc"])
    tops = node.where("parent is not null").select("acc", F.col("rid").alias("at"))
    mass = F.when(F.count("mass") == F.count("*"), F.sum("mass"))
    cut = above.join(tops, ["acc", "at"], "left_semi").join(node.select("acc", F.col("rid").alias("id"), "mass"), ["acc", "id"]).groupBy("acc", F.col("at").alias("rid")).agg(F.count("*").alias("n"), mass.alias("mass"))
    total = node.groupBy("acc").agg(mass.alias("total"))
    return cut.join(total, "acc").select("acc", "rid", "n", "mass", (F.col("total") - F.col("mass")).alias("rest"))


def pieces(residues) -> Iterator[tuple[list[int], int]]:
    """(residues, links cut around it) of every connected piece of a tree, one after the other.

    For each top residue, undecided residues are left out or taken with their children, so memory is that of the
    tree, however many pieces there are."""
    tree = Tree(residues)
    for top in tree.node:
        todo = [((top,), int(top not in tree.tops), tuple(tree.kids[top]))]
        while todo:
            held, cuts, open_ = todo.pop()
            if not open_:
                yield sorted(held), cuts
            else:
                todo.append((held, cuts + 1, open_[1:]))
                todo.append(((*held, open_[0]), cuts, (*open_[1:], *tree.kids[open_[0]])))


def all_fragments(structures: DataFrame, batch: int = 10_000) -> DataFrame:
    """(acc, ids, n_cleavages): every connected piece with the number of links cut around it.

    There may be exponentially many of a structure, so they leave its task in batches as they are found."""
    kind = dict(structures.dtypes)["acc"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, rows = ["acc", "ids", "n_cleavages"], []
        for df in batches:
            for acc, residues in zip(df["acc"], df["residues"]):
                for ids, cuts in pieces(residues):
                    rows.append((acc, ",".join(map(str, ids)), cuts))
                    if len(rows) == batch:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        yield pd.DataFrame(rows, columns=columns)

    return structures.select("acc", "residues").mapInPandas(run, f"acc {kind}, ids string, n_cleavages int")


def structure_tests(residues: DataFrame) -> DataFrame:
    """(acc, n_branches, n_leaves, branched): residues with several children, and with none."""
    kids = residues.where("parent is not null").groupBy("acc", F.col("parent").alias("rid")).agg(F.count("*").alias("k"))
    both = residues.select("acc", "rid").join(kids, ["acc", "rid"], "left")
    found = both.groupBy("acc").agg(F.count_if(F.col("k") > 1).alias("n_branches"), F.count_if(F.col("k").isNull()).alias("n_leaves"))
    return found.withColumn("branched", F.col("n_branches") > 0)


#: A core as a pattern: symbols, an anomer that a residue may not have, positions (an unknown one fits), how many children
#: at least fit each pattern below.
N_CORE = {
    "symbols": ["GlcNAc", "HexNAc"],
    "kids": [{"symbols": ["GlcNAc", "HexNAc"], "not_anomer": "a", "pos": [4], "kids": [{"symbols": ["Man", "Hex"], "not_anomer": "a", "pos": [4], "kids": [
        {"symbols": ["Man", "Hex"], "not_anomer": "b", "pos": [3]}, {"symbols": ["Man", "Hex"], "not_anomer": "b", "pos": [6]}, {"symbols": ["Man", "Hex"], "not_anomer": "b", "pos": [3, 6], "at_least": 2},
    ]}]}],
}


def _root() -> Column:
    """The root as an array of one residue; none for a structure without exactly one residue without parent."""
    tops = F.filter("residues", lambda r: r["parent"].isNull())
    return F.when(F.size(tops) == 1, tops).otherwise(F.slice(tops, 1, 0))


def _kids(r: Column) -> Column:
    return F.filter("residues", lambda k: k["parent"] == r["rid"])


def _one_of(r: Column, symbols: list[str]) -> Column:
    return F.coalesce(r["symbol"].isin(*symbols), F.lit(False))


def _held(r: Column, pattern: dict) -> Column:
    ok = _one_of(r, pattern["symbols"])
    if "not_anomer" in pattern:
        ok = ok & ~r["anomer"].eqNullSafe(F.lit(pattern["not_anomer"]))
    if "pos" in pattern:
        ok = ok & F.coalesce(r["pos"].isin(*pattern["pos"]), F.lit(True))
    for below in pattern.get("kids", ()):
        ok = ok & (F.size(F.filter(_kids(r), lambda k: _held(k, below))) >= below.get("at_least", 1))  # noqa: B023
    return ok


def rooted(pattern: dict) -> Column:
    """Whether the root of `residues` holds a pattern (see N_CORE)."""
    return F.exists(_root(), lambda r: _held(r, pattern))


def accepted_core(symbols: list[str], bare: bool = False, kids: int | None = None, also: tuple[str, ...] = ("Fuc", "NeuAc", "NeuGc")) -> Column:
    """Whether all children of the root have one of the symbols, or of `also`; a bare core has none of the latter and no loose
    substituent on the root (field `loose` of a residue, their number); kids: as many children as that."""
    fine = [*symbols, *(() if bare else also)]
    ok = lambda r: F.forall(_kids(r), lambda k: _one_of(k, fine)) & (F.coalesce(r["loose"], F.lit(0)) == 0 if bare else F.lit(True)) & (F.size(_kids(r)) == kids if kids is not None else F.lit(True))
    return F.exists(_root(), ok)


def symbol_count(symbols: list[str]) -> Column:
    return F.size(F.filter("residues", lambda r: _one_of(r, symbols)))


def only_leaves(symbols: list[str]) -> Column:
    """Whether no residue of the symbols has children."""
    return ~F.exists("residues", lambda r: _one_of(r, symbols) & (F.size(_kids(r)) > 0))


def no_branch(besides: list[str] | None = None) -> Column:
    """Whether no residue has several children, those of the symbols `besides` left aside."""
    return ~F.exists("residues", lambda r: F.size(F.filter(_kids(r), lambda k: ~_one_of(k, besides or [""]))) > 1)


def even_repeats() -> Column:
    """Whether each repeat unit (field `repeat` of a residue, its number) has an even number of residues."""
    units = F.array_distinct(F.array_compact(F.transform("residues", lambda r: r["repeat"])))
    return F.forall(units, lambda u: F.size(F.filter("residues", lambda r: r["repeat"] == u)) % 2 == 0)


def classify(hits: DataFrame, rules: list[dict]) -> DataFrame:
    """(acc, rule, type, subtype) of every matching rule: any of its motifs, none of its exceptions, and its test.

    hits: acc, motifs (array) and columns of the tests; a rule: id, type, subtype, motifs, exceptions (motifs or
    ids of other rules), test (SQL text or None).  Rules are evaluated in the order of their dependence."""
    by_id, order = {r["id"]: r for r in rules}, []

    def visit(r: dict, path: tuple = ()) -> None:
        if r["id"] in path:
            raise ValueError(f"rules depend on each other: {path}")
        if r not in order:
            for e in r.get("exceptions", ()):
                if e in by_id:
                    visit(by_id[e], (*path, r["id"]))
            order.append(r)

    for r in rules:
        visit(r)
    truth: dict[str, Column] = {}
    listed = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    for r in order:
        ok = F.arrays_overlap("motifs", listed(r["motifs"]))
        for e in r.get("exceptions", ()):
            ok = ok & ~(truth[e] if e in by_id else F.array_contains("motifs", e))
        if r.get("test"):
            ok = ok & F.expr(r["test"])
        truth[r["id"]] = F.coalesce(ok, F.lit(False))
    named = [F.when(truth[r["id"]], F.struct(F.lit(r["id"]).alias("rule"), F.lit(r["type"]).alias("type"), F.lit(r.get("subtype")).cast("string").alias("subtype"))) for r in rules]
    return hits.select("acc", F.explode(F.array_compact(F.array(*named))).alias("x")).select("acc", "x.rule", "x.type", "x.subtype")


def cluster_navigator(lengths: DataFrame, matches: DataFrame) -> DataFrame:
    """(cluster, other, step): matching clusters whose representatives have one residue less, as many or one more.

    lengths: cluster, n; matches: cluster, other."""
    a, b = lengths.select("cluster", "n"), lengths.select(F.col("cluster").alias("other"), F.col("n").alias("m"))
    return matches.join(a, "cluster").join(b, "other").where("abs(m - n) <= 1 and cluster <> other").select("cluster", "other", (F.col("m") - F.col("n")).alias("step"))


def representatives(rows: DataFrame) -> DataFrame:
    """(acc, representative, label): within a group of equal masses (3 decimals), identical codes go to their least
    accession, then codes contained in another go to the least such; labels are group.number."""
    own = rows.withColumn("g", F.format_number("mass", 3)).select("acc", "g", "code")
    least = own.groupBy("g", "code").agg(F.min("acc").alias("rep"))
    wider = least.alias("x").join(least.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.code") != F.col("y.code")) & F.col("y.code").contains(F.col("x.code")))
    best = wider.groupBy(F.col("x.g").alias("g"), F.col("x.code").alias("code")).agg(F.min_by(F.col("y.rep"), F.struct(-F.length("y.code"), F.col("y.rep"))).alias("to"))
    reps = least.join(best, ["g", "code"], "left").select("g", "code", F.coalesce("to", "rep").alias("representative"))
    numbered = reps.select("g", "representative").distinct().withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("representative")))
    return own.join(reps, ["g", "code"]).join(numbered, ["g", "representative"]).select("acc", "representative", F.concat_ws(".", "g", F.col("i").cast("string")).alias("label"))


#: Fixed value: weight of a link's own parameters against its undetermined parents.
SIMPLE = 0.65


def missing_score(residues: DataFrame, links: DataFrame, substituents: DataFrame | None = None) -> DataFrame:
    """(acc, score): incompleteness from 0 to 10000, of a residue part and a link part.

    residues: acc, rid, is_root, anomer, config and stem (arrays with null entries), ring_start, ring_end,
    substituent_pos (array of position arrays); links: acc, child, parent_pos, child_pos, parent_type, child_type
    (arrays), one row per possible parent.  A residue that is not the root and has no link counts in full;
    so does every link of a structure without any connected residue.

    substituents: those that are no part of their residue's name: acc, sid, name, and linked (false for one without any
    parent) with the columns of a link, one row per possible parent.  Each weighs half a link; anhydro ones are left out."""
    lacking = lambda c: F.col(c).isNull().cast("double")
    config = F.coalesce(2.0 * F.size(F.filter("config", lambda x: x.isNull())) / F.nullif(F.size("config"), F.lit(0)), F.lit(2.0))
    ring = F.when(F.coalesce(F.col("anomer"), F.lit("")) != "open", lacking("ring_start") + lacking("ring_end")).otherwise(0.0)
    stem = F.when(F.coalesce(F.exists("stem", lambda x: x.isNull()), F.lit(True)), 2.0).otherwise(0.0)
    positions = F.aggregate(F.coalesce("substituent_pos", F.array().cast("array<array<int>>")), F.lit(0.0), lambda s, p: s + F.when(p.isNull(), 2.0).when(F.size(p) > 1, 1.0).otherwise(0.0))
    own = (2 * lacking("anomer") + config + ring + stem + positions) / 8 * 10
    vague = lambda c: F.when(F.col(c).isNull(), 2.0).when(F.size(c) > 1, 1.0).otherwise(0.0)
    several = lambda c: F.when(F.size(c) > 1, 2.0).otherwise(0.0)
    simple = (vague("parent_pos") + vague("child_pos") + several("parent_type") + several("child_type")) / 8 * 10
    by_child = links.groupBy("acc", F.col("child").alias("rid")).agg(F.avg(simple).alias("simple"), F.count("*").alias("parents"))
    size = residues.groupBy("acc").agg(F.count("*").alias("n"))
    rows = residues.withColumn("own", own).join(by_child, ["acc", "rid"], "left").join(size, "acc")
    link = F.when(F.col("parents").isNull(), F.when(F.col("is_root"), 0.0).otherwise(10.0)).otherwise(SIMPLE * F.col("simple") + 10 * (1 - SIMPLE) * (F.col("parents") - 1) / F.col("n"))
    total = rows.groupBy("acc").agg(F.sum("own").alias("own"), F.sum(link).alias("link"), F.first("n").alias("n"))
    if substituents is None:
        total = total.withColumns({"k": F.lit(0), "loose": F.lit(0.0)})
    else:
        each = substituents.where(~F.col("name").eqNullSafe(F.lit("anhydro"))).groupBy("acc", "sid").agg(F.avg(F.when(F.col("linked"), simple)).alias("simple"), F.count_if(F.col("linked")).alias("parents")).join(size, "acc")
        half = F.when(F.col("parents") == 0, 5.0).otherwise(SIMPLE / 2 * F.col("simple") + 5 * (1 - SIMPLE) * (F.col("parents") - 1) / F.col("n"))
        total = total.join(each.groupBy("acc").agg(F.count("*").alias("k"), F.sum(half).alias("loose")), "acc", "left").fillna({"k": 0, "loose": 0.0})
    w = SIMPLE / (1 + SIMPLE)
    whole = F.when((F.col("n") > 1) | (F.col("k") > 0), 10.0 * (F.col("n") - 1) + 5 * F.col("k")).otherwise(10.0)
    share = (F.col("link") + F.col("loose")) / whole
    return total.select("acc", F.floor(10000 * (F.col("own") / (10.0 * F.col("n")) * w + share * (1 - w)) + 1e-9).cast("int").alias("score"))
