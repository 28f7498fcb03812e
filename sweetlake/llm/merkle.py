"""Merkle manifest of a data set, with every row's proof (operator 11).

A row's leaf is a SHA-256 over its fields.  The leaves of a group, by id, form a tree of fan-out
3, and so do the groups' roots, by group name.  Trees are cut into superblocks of 3^6
consecutive nodes.  Going up, each superblock is reduced to one node, and superblocks of those
again, until a group has one; only nodes travel, never texts.  Going down, the siblings that lie
above a superblock (its outer nodes) are handed to it: its nodes and outer nodes are cogrouped,
and one call of applyInPandas reduces the block, joins the proofs and folds the claimed leaves.

A group of any size spreads over its superblocks, so a source that holds a third of all rows
costs no task more than another.  A proof is text: levels parted by commas, in each the siblings
left and right of the path parted by a bar, e.g. "|bbcc,aa|".

Defined results: a null field counts as `-`; a null group is a group, before all others; null
ids come first, repeated ids by their leaves; equal rows are leaves of their own; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Children of a node, and levels that a superblock spans.
FAN, SPAN = 3, 6
NODE = "key string, i long, h string, n long"
OUTER = "key string, block long, path string, subroot string, root string"
PROVED = "id string, leaf string, subroot string, root string, proof string, folded_root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """Digest of the fields' values, each with its length in bytes in front; `-` for null."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with i, the place within the key by `order` from 0, and n, the rows of the key.

    Rows are dealt by range of (key, order), sorted and numbered within each range; a small table of counts by range
    and key carries places on, so that no key needs a task of its own."""
    kept = rows.columns
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    ranges = rows.repartitionByRange(common.parts(rows), *by).sortWithinPartitions(*by)
    placed = common.written(ranges.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "places")
    counts = placed.groupBy("_range", key).agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    # A row a range and key: within a key as many as it has ranges.
    here = Window.partitionBy(key)
    before = here.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_range", key, (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_c").over(here).alias("n"))
    return placed.join(bases, ["_range", key]).select(*kept, (F.col("_at") + F.col("_base")).alias("i"), "n")


def levels_of(nodes: list[str], n: int, span: int) -> list[list[str]]:
    """All levels of a superblock of a group of n nodes, its nodes first: up to one node where it holds all of them, else `span` levels up."""
    levels = [nodes]
    while len(levels[-1]) > 1 if n <= FAN**span else len(levels) <= span:
        below = levels[-1]
        levels.append([digest("".join(below[j : j + FAN])) for j in range(0, len(below), FAN)])
    return levels


def siblings(levels: list[list[str]], j: int) -> list[tuple[str, str]]:
    """Siblings left and right of node j's path, level by level."""
    found = []
    for level in levels[:-1]:
        first = j - j % FAN
        found.append(("".join(level[first:j]), "".join(level[j + 1 : first + FAN])))
        j //= FAN
    return found


def reduced(nodes: DataFrame, span: int) -> DataFrame:
    """The node above each superblock."""
    size = FAN**span

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        n = int(p["n"].iloc[0])
        top = levels_of(p["h"].tolist(), n, span)[-1][0]
        return pd.DataFrame({"key": [p["key"].iloc[0]], "i": [int(p["i"].iloc[0]) // size], "h": [top], "n": [-(-n // size)]})

    return nodes.select("key", "i", "h", "n", F.floor(F.col("i") / size).alias("block")).groupBy("key", "block").applyInPandas(run, NODE)


def rounds(nodes: DataFrame, span: int) -> list[DataFrame]:
    """nodes, then what superblocks are reduced to, again and again; each holds the keys that had several nodes before."""
    tables = [nodes]
    while not (several := tables[-1].where("n > 1")).isEmpty():
        tables.append(common.written(reduced(several, span), "nodes"))
    return tables


def roots(tables: list[DataFrame]) -> DataFrame:
    """(key, h): the one node that remains of each key."""
    ones = [t.where("n = 1").select("key", "h") for t in tables]
    out = ones[0]
    for t in ones[1:]:
        out = out.unionByName(t)
    return out


def with_path(nodes: DataFrame, outer: DataFrame, span: int) -> DataFrame:
    """Outer nodes of the superblock below each node: the node's own siblings, then those of the superblock that it is in."""

    def run(p: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        levels = levels_of(p["h"].tolist(), int(p["n"].iloc[0]), span)
        up = above.iloc[0]
        paths = [",".join([*("|".join(s) for s in siblings(levels, j)), *([up["path"]] if up["path"] else [])]) for j in range(len(p))]
        return pd.DataFrame({"key": p["key"], "block": p["i"], "path": paths, "subroot": up["subroot"], "root": up["root"]})

    return _cogrouped(nodes.select("key", "i", "h", "n"), outer, span).applyInPandas(run, OUTER)


def _cogrouped(nodes: DataFrame, outer: DataFrame, span: int):
    # Both sides may come of one table, so columns of the other are named anew.
    above = outer.select(F.col("key").alias("up_key"), F.col("block").alias("up_block"), "path", "subroot", "root")
    return nodes.withColumn("block", F.floor(F.col("i") / FAN**span)).groupBy("key", "block").cogroup(above.groupBy("up_key", "up_block"))


def outer_nodes(tables: list[DataFrame], tops: DataFrame, span: int) -> DataFrame:
    """Outer nodes of the superblocks of tables[0], from those of each key's root (key, path, subroot, root)."""
    below = None
    whole = tops.withColumn("block", F.lit(0).cast("long")).select("key", "block", "path", "subroot", "root")
    outer = None
    for t in [*(t.where("n > 1") for t in reversed(tables[1:])), tables[0]]:
        # Keys with one superblock take what lies above their root; others what their superblocks' nodes have above them.
        single = whole.join(t.where(F.col("n") <= FAN**span).select("key").distinct(), "key", "left_semi")
        outer = single if outer is None else single.unionByName(with_path(below, outer, span))
        below = t
    return outer


def manifest(leaves: DataFrame, span: int = SPAN) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root) of leaves (id, grp, leaf, claimed): folded_root is what the claimed
    leaf gives with the true leaf's siblings, and equals root exactly if the claim is true."""
    # A text order of keys that is the order of groups: null first, then bytewise.
    named = leaves.select("id", "leaf", "claimed", F.coalesce(F.concat(F.lit("="), "grp"), F.lit("-")).alias("key"))
    placed = common.written(numbered(named, "key", ["id", "leaf", "claimed"]), "leaves").withColumn("h", F.col("leaf"))
    below = rounds(placed, span)
    groups = roots(below).select(F.lit("").alias("key"), F.col("key").alias("group"), "h")
    above = common.written(numbered(groups, "key", ["group"]), "groups")
    top = rounds(above, span)
    root = roots(top).select("key", F.lit("").alias("path"), F.col("h").alias("subroot"), F.col("h").alias("root"))
    paths = with_path(above, outer_nodes(top, root, span), span).select(F.col("block").alias("i"), "path", "root")
    tops = common.written(above.join(paths, "i").select(F.col("group").alias("key"), "path", F.col("h").alias("subroot"), "root"), "tops")

    def prove(p: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        levels = levels_of(p["h"].tolist(), int(p["n"].iloc[0]), span)
        up = up.iloc[0]
        out = [tuple(s.split("|")) for s in up["path"].split(",") if s]
        proofs, folded = [], []
        for j, h in enumerate(p["claimed"]):
            path = siblings(levels, j) + out
            for left, right in path:
                h = digest(left + h + right)
            proofs.append(",".join(map("|".join, path)))
            folded.append(h)
        return pd.DataFrame({"id": p["id"], "leaf": p["leaf"], "subroot": up["subroot"], "root": up["root"], "proof": proofs, "folded_root": folded})

    # Ids travel as text: pandas holds whole numbers beside nulls as floats.
    return _cogrouped(placed.withColumn("id", F.col("id").cast("string")), outer_nodes(below, tops, span), span).applyInPandas(prove, PROVED)


def proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: leaves, roots and proofs of all documents, folded from texts of which half have lost their line feeds."""
    docs = common.table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    claim = F.when(tampered, leaf(*fields[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(leaf(*fields))
    leaves = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").alias("grp"), leaf(*fields).alias("leaf"), claim.alias("claimed"))
    proof = F.sha2(F.translate("proof", "|,", ""), 256)
    return manifest(leaves).select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: DuckDB: levels by a recursive CTE, siblings by joins on the path's run, folds by list_reduce.
PROOFS_SQL = """
WITH RECURSIVE bits(v, c, k) AS (
  SELECT v, v, 0 FROM range(256) t(v) UNION ALL
  SELECT v, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
codes AS (SELECT list(c ORDER BY v) AS code FROM bits WHERE k = 8),
docs AS (
  SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, replace(text, chr(10), '') AS cut,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c // 256, code[xor(c % 256, b) + 1])), 4294967295) % 2 = 0 AS tampered FROM documents, codes),
leaves AS (
  SELECT doc_id, coalesce('=' || source, '-') AS grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || CASE WHEN coalesce(tampered, false) THEN coalesce(strlen(cut) || ':' || cut, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS claimed FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS i FROM leaves),
low(grp, l, i, h, n) AS (
  SELECT grp, 0, i, leaf, count(*) OVER (PARTITION BY grp) FROM placed UNION ALL
  SELECT grp, any_value(l) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY grp, i // 3),
subs AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS g FROM low WHERE n = 1),
high(l, i, h, n) AS (
  SELECT 0, g, subroot, count(*) OVER () FROM subs UNION ALL
  SELECT any_value(l) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY i // 3),
depth AS (SELECT grp, max(l) AS d FROM low GROUP BY grp),
own AS (SELECT p.grp, p.i, p.leaf, p.claimed, p.doc_id, s.subroot, s.g FROM placed p JOIN subs s USING (grp)),
ups AS (SELECT o.grp, o.i, unnest(range(0, d.d)) AS l, 3 ** unnest(range(0, d.d)) AS width FROM own o JOIN depth d USING (grp)),
steps AS (
  SELECT u.grp, u.i, u.l, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i < u.i // u.width::BIGINT), '') || '|' || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i > u.i // u.width::BIGINT), '') AS step
  FROM ups u JOIN low n ON n.grp = u.grp AND n.l = u.l AND n.i // 3 = u.i // u.width::BIGINT // 3 GROUP BY ALL),
inner_path AS (SELECT grp, i, list(step ORDER BY l) AS path FROM steps GROUP BY grp, i),
over_ups AS (SELECT g, unnest(range(0, (SELECT max(l) FROM high))) AS l, 3 ** unnest(range(0, (SELECT max(l) FROM high))) AS width FROM subs),
over_steps AS (
  SELECT u.g, u.l, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i < u.g // u.width::BIGINT), '') || '|' || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i > u.g // u.width::BIGINT), '') AS step
  FROM over_ups u JOIN high n ON n.l = u.l AND n.i // 3 = u.g // u.width::BIGINT // 3 GROUP BY ALL),
outer_path AS (SELECT g, list(step ORDER BY l) AS path FROM over_steps GROUP BY g),
proved AS (
  SELECT o.*, (SELECT h FROM high WHERE n = 1) AS root, list_concat(coalesce(a.path, []), coalesce(b.path, [])) AS path
  FROM own o LEFT JOIN inner_path a ON a.grp = o.grp AND a.i = o.i LEFT JOIN outer_path b ON b.g = o.g),
folded AS (SELECT *, list_reduce(list_prepend(claimed, path), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root FROM proved)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
