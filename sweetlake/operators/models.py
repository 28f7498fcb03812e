"""Retention model with group effects and the multi-score FDR lattice: sums by Spark, small solves on the driver."""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fdr import fdr_curve
from .lineage import written
from .ordered import with_position


def retention_model(tgs: DataFrame, peptide: str, y: str, xs: list[str], threshold: float = 5.0) -> tuple[DataFrame, dict[str, float]]:
    """(rows with fitted, residual and good, coefficients): least squares on peptide effects and shared columns.

    Peptide effects are eliminated by group means, so only the sums of the shared columns' products, a row of
    len(xs) squared numbers, reach the driver.  Rows move between good and bad by |residual| <= threshold until
    no row moves.  Should a split of the rows come back (they move in a cycle), the fit ends there with a warning.
    A peptide without good rows takes the mean effect of the others; rows
    with a null in y or a shared column are left out, and rows without a peptide take that mean but no part in the fit.

    Whether a row is good follows from the last fit alone, so a round keeps a row a peptide, and the rows are never written: they are
    dealt out by peptide once, a peptide of very many rows in slices, and kept by the executors.  A round goes once over the rows of those
    peptides some row of which may move: each keeps how far its rows are from the threshold, and rests until the fit has moved as far."""
    rows = tgs.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in (y, *xs))))
    spark, n = rows.sparkSession, len(xs)
    ends = rows.agg(F.count("*").alias("_n"), *(F.coalesce(f(c).cast("double"), F.lit(0.0)).alias(f"{name}{c}") for c in (y, *xs) for name, f in (("m_", F.avg), ("l_", F.min), ("h_", F.max)))).first()
    shift = [ends[f"m_{c}"] for c in (y, *xs)]
    reach = [max(ends[f"h_{c}"] - m, m - ends[f"l_{c}"]) for c, m in zip((y, *xs), shift)]
    many = spark.sparkContext.defaultParallelism
    hot = rows.where(F.col(peptide).isNotNull()).groupBy(F.col(peptide).alias("_p")).agg(F.count("*").alias("_n")).where(F.col("_n") > SLICE)
    hot = written(hot.select("_p", F.ceil(F.col("_n") / SLICE).alias("_slices")), "hot")  # at most a row for so many rows
    sliced = not hot.isEmpty()
    own = rows.where(F.col(peptide).isNotNull()).select(F.col(peptide).alias("_p"), *((F.col(c).cast("double") - F.lit(m)).alias(f"_{k}") for k, (c, m) in enumerate(zip((y, *xs), shift))))
    key = ["_p", "_slice"] if sliced else ["_p"]
    if sliced:
        own = own.join(F.broadcast(hot), "_p", "left").withColumn("_slice", F.pmod(F.xxhash64(*(f"_{k}" for k in range(n + 1))), F.coalesce("_slices", F.lit(1)))).drop("_slices")
    kept = own.repartition(many * -(-ends["_n"] // (SLICE * many)) or 1, *key).sortWithinPartitions(*key).persist()

    values = {f"s{k}": F.col(f"_{k}") for k in range(n + 1)}
    values |= {f"q{i}_{j}": F.col(f"_{i}") * F.col(f"_{j}") for i in range(1, n + 1) for j in range(n + 1) if not 0 < j < i}
    fits = ["e", *(f"b{k}" for k in range(1, n + 1))]
    left = lambda end: reduce(Column.__sub__, (F.col(f"b{k}{end}") * F.col(f"_{k}") for k in range(1, n + 1)), F.col("_0") - F.col(f"e{end}"))
    hashed = F.xxhash64(*(f"_{k}" for k in range(n + 1)))
    marks = {"h0": F.pmod(hashed, F.lit(2**31)), "h1": F.pmod(F.shiftright(hashed, 31), F.lit(2**31))}

    def sums(df: DataFrame, now: Column, was: Column, off: Column) -> DataFrame:
        """(_p, ...): number of good rows, their sums, how many rows moved, the least distance of a row from the threshold, and the fit."""
        every = [F.count_if(now).alias("n"), *(F.coalesce(F.sum(F.when(now, v)), F.lit(zero)).alias(c) for vs, zero in ((values, 0.0), (marks, 0)) for c, v in vs.items())]
        every += [F.count_if(now != was).alias("moved"), F.min(F.abs(off - F.lit(float(threshold)))).alias("margin"), *(F.first(c).alias(c) for c in fits)]
        out = df.groupBy(*key).agg(*every)
        if sliced:
            again = {"margin": F.min, **dict.fromkeys(fits, F.first)}
            out = out.groupBy("_p").agg(*(again.get(c, F.sum)(c).alias(c) for c in out.columns if c not in key))
        return out

    start = kept.withColumns({c: F.lit(None).cast("double") for c in fits})
    table = sums(start, F.lit(True), F.lit(True), F.lit(float(threshold)))
    table = written(table.join(hot, "_p", "left") if sliced else table, "peptides")
    few = -(-table.count() // 100_000) or 1
    over = lambda c: F.col(c) / F.nullif(F.col("n"), F.lit(0))
    whole = [F.sum(F.col(c) - F.col(f"s{i}") * over(f"s{j}")).alias(c) for c in values if c[0] == "q" for i, j in [c[1:].split("_")]]
    whole += [*(F.sum(over(f"s{k}")).alias(f"m{k}") for k in range(n + 1)), F.count_if(F.col("n") > 0).alias("peptides")]
    whole += [F.sum("moved").alias("moved"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "h0", "h1"))]
    total, b, overall, seen = table.agg(*whole).first(), np.zeros(n), 0.0, set()
    while True:
        a = np.array([[total[f"q{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(1, n + 1)] for i in range(1, n + 1)]).reshape(n, n)
        b = np.linalg.lstsq(a, np.array([total[f"q{k}_0"] or 0.0 for k in range(1, n + 1)]), rcond=None)[0] if n else b
        overall = (total.m0 - sum(float(v) * total[f"m{k + 1}"] for k, v in enumerate(b))) / total.peptides if total.peptides else 0.0
        fit = spark.createDataFrame([(float(overall), *map(float, b))], ", ".join(f"{c}_new double" for c in fits))  # data: as literals it would make each round new code
        effect = F.coalesce(reduce(Column.__sub__, (F.col(f"b{k}_new") * over(f"s{k}") for k in range(1, n + 1)), over("s0")), F.col("e_new"))
        fitted = table.crossJoin(F.broadcast(fit)).withColumn("e_new", effect)
        moved = reduce(Column.__add__, (F.abs(F.col(f"b{k}_new") - F.col(f"b{k}")) * reach[k] for k in range(1, n + 1)), F.abs(F.col("e_new") - F.col("e")))
        rests = F.coalesce(moved + 1e-9 * (threshold + sum(reach)) < 0.99 * F.col("margin"), F.lit(False))
        ask = fitted.where(~rests).select("_p", *(["_slices"] if sliced else []), *fits, *(f"{c}_new" for c in fits))
        if sliced:
            ask = ask.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_slices", F.lit(1)) - 1))).drop("_slices")
        off = F.abs(left("_new"))
        was = F.coalesce(F.abs(left("")) <= threshold, F.lit(True))  # all rows start good
        asked = kept.join(ask, key).select(*key, *(f"_{k}" for k in range(n + 1)), (off <= threshold).alias("_now"), was.alias("_was"), off.alias("_off"), *(F.col(f"{c}_new").alias(c) for c in fits))
        found = sums(asked, F.col("_now"), F.col("_was"), F.col("_off"))
        names = [c for c in found.columns if c != "_p"]
        both = table.join(found.select("_p", *(F.col(c).alias(f"_f_{c}") for c in names)), "_p", "left")
        is_new = F.col("_f_n").isNotNull()
        after = both.select("_p", *(["_slices"] if sliced else []), *(F.when(is_new, F.col(f"_f_{c}")).otherwise(F.lit(0) if c == "moved" else F.col(c)).alias(c) for c in names))
        after = written(after.repartition(few), "peptides")
        total = after.agg(*whole).first()
        mark = (total.n, total.h0, total.h1)
        if total.moved and mark in seen:
            warnings.warn("retention_model: rows move between good and bad in a cycle", stacklevel=2)
        if not total.moved or mark in seen:
            break
        seen.add(mark)
        table = after
    kept.unpersist()
    line = reduce(Column.__add__, (F.lit(float(v)) * (F.col(x) - F.lit(m)) for v, x, m in zip(b, xs, shift[1:])), F.lit(shift[0]))
    effects = fitted.select(F.col("_p").alias(peptide), F.col("e_new").alias("_effect"))
    state = rows.join(effects, peptide, "left").withColumn("fitted", F.coalesce("_effect", F.lit(float(overall))) + line).withColumn("residual", F.col(y) - F.col("fitted")).drop("_effect")
    return state.withColumn("good", F.abs("residual") <= threshold), dict(zip(xs, map(float, b)))


#: Rows that a task of the retention model is given, about, and rows of a peptide beyond which it is sliced.
SLICE = 1_000_000


def with_categories(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """rows with an indicator column for each whole value of the columns above their least, and the names of these."""
    ends = rows.agg(*(x for c in columns for x in (F.min(c).cast("long").alias(f"lo_{c}"), F.max(c).cast("long").alias(f"hi_{c}")))).first()
    new = {f"{c}_{v}": (F.col(c) == v).cast("double") for c in columns if ends[f"lo_{c}"] is not None for v in range(ends[f"lo_{c}"] + 1, ends[f"hi_{c}"] + 1)}
    return rows.withColumns(new) if new else rows, list(new)


def _sums(good: DataFrame, by: str, sequence: str, y: str, xs: list[str], shift: dict[str, float]) -> DataFrame:
    """(by, sequence, _v0, ...): number of rows, sums of y and of the shared columns, of products of these, and of these with y.

    Columns are measured from `shift`, near their means, against cancellation."""
    at = {c: F.col(c) - F.lit(shift[c]) for c in (y, *xs)}
    terms = [F.lit(1.0), *at.values(), *(at[a] * at[b] for a, b in itertools.combinations_with_replacement(xs, 2)), *(at[x] * at[y] for x in xs)]
    return good.groupBy(by, sequence).agg(*(F.sum(term).alias(f"_v{k}") for k, term in enumerate(terms)))


def _solved(sums: DataFrame, by: str, n: int) -> dict[int, list[float]]:
    """Coefficients of the n shared columns, a list a value of `by`.  Sequence effects are eliminated batch by batch in tasks, so
    a row of some n squared numbers a batch and fit reaches the driver."""
    upper = np.triu_indices(n)

    def eliminated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, rows in batch.groupby(by):
                v = rows.iloc[:, 2:].to_numpy(float)
                s = v[:, 1 : n + 2]
                inner = (s / v[:, :1]).T @ s
                yield pd.DataFrame({"k": [k], "g": [v[:, n + 2 :].sum(0) - np.concatenate([inner[1:, 1:][upper], inner[1:, 0]])]})

    total: dict[int, np.ndarray] = {}
    for r in sums.mapInPandas(eliminated, "k int, g array<double>").collect():
        total[r.k] = total.get(r.k, 0) + np.array(r.g)
    solved = {}
    for k, g in total.items():
        a = np.zeros((n, n))
        a[upper] = a.T[upper] = g[: len(upper[0])]
        solved[k] = np.linalg.lstsq(a, g[len(upper[0]) :], rcond=1e-12)[0].tolist() if n else []
    return solved


def _effects(sums: DataFrame, by: str, sequence: str, y: str, xs: list[str], shift: dict[str, float], solved: dict[int, list[float]]) -> DataFrame:
    """(by, sequence, _effect): what the coefficients leave of a sequence's mean."""
    mean = lambda k, c: F.col(f"_v{k + 1}") / F.col("_v0") + F.lit(shift[c])
    line = _line({x: mean(k + 1, x) for k, x in enumerate(xs)})
    return _with_coefficients(sums.where(F.col(sequence).isNotNull()), by, solved).select(by, sequence, (mean(0, y) - line).alias("_effect"))


def _with_coefficients(df: DataFrame, by: str, solved: dict[int, list[float]]) -> DataFrame:
    """df with the coefficients _b of the row's fit, of which there are as many as runs.  They are data: as literals they would make each round new code."""
    table = pa.table({by: pa.array(solved, pa.int32()), "_b": pa.array(solved.values(), pa.list_(pa.float64()))})
    return df.join(F.broadcast(df.sparkSession.createDataFrame(table)), by, "left")


def _line(columns: dict[str, Column]) -> Column:
    """The shared columns' part of a fit by _b; 0 without one."""
    return reduce(Column.__add__, (F.coalesce(F.get("_b", F.lit(k)), F.lit(0.0)) * c for k, c in enumerate(columns.values())), F.lit(0.0))


#: Rows of a sequence that are kept together at most, and rows that a task is given, about.
PIECE, SHARE = 20_000, 250_000


def retention_runs(
    tgs: DataFrame, group: str, sequence: str, peptide: str, y: str, xs: list[str], known: DataFrame | None = None,
    threshold: float = 5.0, choose: int = 10, runs: int = 1, heuristic: str = "weighted", seed: int = 0,
) -> tuple[DataFrame, list[dict]]:
    """(rows of the best run with run, fitted, residual and good; a summary of each run): a retention model from several starts.

    known: sequence, xs and y of peptides whose value is known: rows further than `threshold` from their fit start bad (all start
    good without it).  In each round a run fits its good rows, takes back every bad row nearer than `threshold`, and calls
    at most `choose` of the good ones beyond it bad: drawn by residual (weighted) or evenly (uniform), the worst, or all.  A run ends
    when none moves, or with a warning when a split of its rows comes back.  All runs are fitted in one job a round.  Best is the
    run with the fewest peptides that have only bad rows, ties to the first.

    The rows are dealt out once, in pieces of a sequence; a round passes over them twice, for the rows that may move and for the sums of the good
    ones then, and writes a byte a row and run and a few sums a piece.  Long sequences are in several pieces, whose sums are added.

    Draws are hashes of seed, run, round and group, so results do not depend on partitions; rows of one group move together.
    A sequence without good rows has no effect (0).  Rows with a null in y or a shared column are left out."""
    if heuristic not in ("weighted", "uniform", "worst", "all"):
        raise KeyError(heuristic)
    columns = [y, *xs]
    rows = tgs.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in columns)))
    ends = rows.agg(F.count("*").alias("_n"), *(F.coalesce(F.avg(c), F.lit(0.0)).cast("double").alias(f"m_{c}") for c in columns)).first()
    means = {c: ends[f"m_{c}"] for c in columns}
    if known is None:
        first = rows.withColumn("_good", F.lit(True))
    else:
        given = known.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in columns))).withColumn("_run", F.lit(0))
        sums = written(_sums(given, "_run", sequence, y, xs, means), "sums")
        solved = _solved(sums, "_run", len(xs))
        effects = _effects(sums, "_run", sequence, y, xs, means, solved)
        first = _with_coefficients(rows.withColumn("_run", F.lit(0)), "_run", solved).join(effects, ["_run", sequence], "left")
        residual = F.col(y) - F.coalesce("_effect", F.lit(0.0)) - _line({x: F.col(x) for x in xs})
        first = first.withColumn("_good", F.abs(residual) <= threshold).select(*rows.columns, "_good")
    spark = rows.sparkSession
    cut = first.withColumns({"_hash": F.xxhash64(group), "_owner": F.monotonically_increasing_id()})
    order = Window.partitionBy(sequence).orderBy("_hash")
    cut = cut.withColumns({"_cut": F.floor((F.row_number().over(order) - 1) / PIECE), "_owner": F.first("_owner").over(order)})
    packed = cut.groupBy(sequence, "_owner", "_cut").agg(F.collect_list(F.struct(*rows.columns, "_good", "_hash")).alias("_rows"))
    packed = written(packed.select(F.monotonically_increasing_id().alias("_piece"), "_owner", (F.col("_cut") == 0).alias("_first"), F.col(sequence).isNotNull().alias("_own"), "_rows"), "pieces")
    inner = {"_y": y, **{f"_x{k}": x for k, x in enumerate(xs)}}
    plain = packed.select("_piece", "_owner", "_first", "_own", *(F.col("_rows")[c].cast("array<double>").alias(k) for k, c in inner.items()), F.col("_rows")["_good"].alias("_start"), F.col("_rows")["_hash"].alias("_hash"), F.col("_rows")[group].alias("_group"))
    many = spark.sparkContext.defaultParallelism
    kept = plain.repartition(many * -(-ends["_n"] // (SHARE * many)) or 1, "_piece").persist()
    split = ends["_n"] > PIECE and not packed.where("not _first").isEmpty()
    shift, kind = np.array([means[c] for c in columns]), rows.schema[group].dataType.simpleString()
    field = rows.schema[group].dataType.simpleString()
    found_as = f"_run int, far long, near long, bad long, mark long, found array<struct<k0:double,k1:double,at:{field}>>"
    shift = np.array([means[c] for c in columns])
    open_runs, summary, seen, ended, turn, few = [*range(runs)] if ends["_n"] else [], {}, {}, {}, 0, False
    state = written(kept.mapInArrow(_moving(None, shift, threshold, open_runs, {}), STATE), "state") if open_runs else None
    while open_runs:
        held, state = [*open_runs], _totals(state) if split else state
        at = Fit(turn, held, _solved_pieces(state, len(held), len(columns)))
        both = kept.join(state.select("_piece", "_flags", "_sums"), "_piece")
        look = lambda listed: both.mapInArrow(_looking(at, shift, threshold, heuristic, seed, listed), found_as)  # noqa: B023, E731
        looked = look(few).toArrow()
        counts = looked.drop_columns(["found"]).to_pandas()
        far = {}
        for run in held:
            own = counts[counts["_run"] == run]
            far[run], near, bad, mark = (sum(map(int, own[c])) for c in ("far", "near", "bad", "mark"))
            back = (bad, mark % 2**64) in seen.setdefault(run, set())
            seen[run].add((bad, mark % 2**64))
            if back and far[run] + near:
                warnings.warn(f"retention_runs: rows of run {run} move in a cycle", stacklevel=2)
            if back or not far[run] + near:
                open_runs.remove(run)
                ended.setdefault(turn, (at, state, []))[2].append(run)
                summary[run] = {"run": run, "rounds": turn + 1, "bad": bad, "coefficients": dict(zip(xs, at.solved[held.index(run)].tolist()))}
        if open_runs:
            drawn = {}
            if heuristic != "all":
                small = max(far[run] for run in open_runs) <= choose
                if few and small:
                    each = looked.select(["_run", "found"])
                    drawn = {run: pc.list_flatten(each.filter(pc.equal(each["_run"], run))["found"].combine_chunks()).field("at") for run in open_runs}
                else:
                    found = written(look(True), "far").select("_run", F.explode("found").alias("f")).select("_run", "f.*")
                    for run in open_runs:
                        beyond = found.where(F.col("_run") == run)
                        if far[run] > choose:
                            beyond = with_position(beyond, [F.asc("k0"), F.asc("k1"), F.asc("at")]).where(F.col("position") <= choose)
                        drawn[run] = beyond.select("at").toArrow()["at"].combine_chunks()  # at most `choose` rows a run
                few = small
            state = written(both.mapInArrow(_moving(at, shift, threshold, open_runs, drawn), STATE), "state")
        turn += 1
    kept.unpersist()
    parts = []
    for at, state, done in ended.values():
        fits = plain.join(state.select("_piece", "_flags", "_sums"), "_piece").mapInArrow(_fitted(at, shift, done), "_piece long, _run int, _fits array<struct<good:boolean,fitted:double,residual:double>>")
        each = packed.select("_piece", "_rows").join(fits.hint("merge"), "_piece").select("_run", F.explode(F.arrays_zip("_rows", "_fits")).alias("_r"))
        parts.append(each.select(*(F.col("_r")["_rows"][c].alias(c) for c in rows.columns), "_run", F.col("_r")["_fits"].alias("_f")).select(*rows.columns, "_run", "_f.*"))
    none = rows.where(F.lit(False)).withColumns({"_run": F.lit(0), "good": F.lit(True), "fitted": F.lit(0.0), "residual": F.lit(0.0)})
    every = reduce(DataFrame.unionByName, parts) if parts else none
    squares = F.sum(F.when(F.col("good"), F.col("residual") ** 2))
    lost = every.groupBy("_run", peptide).agg(F.bool_or("good").alias("any"), squares.alias("squares"), F.count_if("good").alias("n"))
    for r in lost.groupBy("_run").agg(F.count_if(~F.col("any")).alias("lost"), F.sqrt(F.sum("squares") / F.nullif(F.sum("n"), F.lit(0))).alias("rms")).collect():
        summary[r["_run"]] |= {"rms": r.rms, "lost_peptides": r.lost}
    stats = [summary[k] for k in sorted(summary)]
    best = min(stats, key=lambda s: (s["lost_peptides"], s["run"]))["run"] if stats else 0
    return every.where(F.col("_run") == best).withColumnRenamed("_run", "run"), stats


#: What is written a round: a piece's flags of good rows, a byte a row and run; its number of good rows, sums of y and of the shared columns,
#: for each run; the sums of their products over a batch of pieces, with its first piece.
STATE = "_piece long, _owner long, _first boolean, _flags binary, _sums array<double>, _cross array<double>"


class Fit(NamedTuple):
    """The fits of a round: its number, the runs in the written state, and their coefficients."""

    turn: int
    held: list[int]
    solved: list[np.ndarray]


def _totals(state: DataFrame) -> DataFrame:
    """state with the sums of all pieces of the same sequence at each of them."""
    pieces = F.collect_list(F.struct("_piece", "_first", "_flags", "_cross")).alias("_p")
    each = state.groupBy("_owner").agg(pieces, F.collect_list("_sums").alias("_s"))
    total = F.aggregate(F.slice("_s", F.lit(2), F.size("_s")), F.element_at("_s", 1), lambda a, b: F.zip_with(a, b, lambda x, z: x + z))
    return each.select("_owner", total.alias("_sums"), F.explode("_p").alias("_p")).select("_owner", "_p.*", "_sums")


def _solved_pieces(state: DataFrame, runs: int, n: int) -> list[np.ndarray]:
    """Coefficients of the shared columns for each run.  Sequence effects are eliminated in tasks; n squared numbers a batch and run reach the driver."""

    def eliminated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("_first").to_numpy(zero_copy_only=False)
            total = batch.column("_cross").flatten().to_numpy().reshape(-1, runs, n, n).sum(0)
            sums = batch.column("_sums").flatten().to_numpy().reshape(len(batch), runs, n + 1)[first]
            s = sums[:, :, 1:]
            total = total - np.einsum("prk,prl->rkl", s / np.maximum(sums[:, :, :1], 1), s)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["g"])

    rows = state.select("_first", "_sums", "_cross").mapInArrow(eliminated, "g array<double>").toArrow()["g"]
    total = sum((np.array(g.as_py()).reshape(runs, n, n) for g in rows), np.zeros((runs, n, n)))
    return [np.linalg.lstsq(a[1:, 1:], a[1:, 0], rcond=1e-12)[0] if n > 1 else np.zeros(0) for a in total]


class Pieces:
    """A batch of pieces: columns y and xs of their rows, measured from `shift`, near their means, against cancellation."""

    def __init__(self, batch: pa.RecordBatch, shift: np.ndarray):
        flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
        self.batch, self.shift = batch, shift
        self.lengths = pc.list_value_length(batch.column("_y")).to_numpy().astype(int)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.z = np.stack([flat(name) for name in ("_y", *(f"_x{k}" for k in range(len(shift) - 1)))]) - shift[:, None]

    def flags(self, runs: int) -> np.ndarray:
        """Whether each row is good, a column a run."""
        flags = pa.concat_arrays([self.batch.column("_flags").cast(pa.binary())])
        ends = np.frombuffer(flags.buffers()[1], np.int32)[flags.offset : flags.offset + len(flags) + 1]
        return np.frombuffer(flags.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, runs).astype(bool)

    def residual(self, at: Fit, run: int) -> np.ndarray:
        """What the run's fit leaves of y."""
        k = at.held.index(run)
        b, sums = at.solved[k], self.batch.column("_sums").flatten().to_numpy().reshape(len(self.batch), len(at.held), -1)[:, k]
        mean = sums[:, 1:] / np.maximum(sums[:, :1], 1)
        own = self.batch.column("_own").to_numpy(zero_copy_only=False) & (sums[:, 0] > 0)
        effect = np.where(own, mean[:, 0] - mean[:, 1:] @ b, self.shift[1:] @ b - self.shift[0])
        return self.z[0] - np.repeat(effect, self.lengths) - b @ self.z[1:]

    def mark(self, good: np.ndarray) -> int:
        """A number for the set of good rows; those of batches add up."""
        row = np.arange(good.size) - np.repeat(self.starts, self.lengths)
        piece = np.repeat(self.batch.column("_piece").to_numpy(), self.lengths)
        return int(_mixed(_mixed(piece.astype(np.uint64)) + row.astype(np.uint64))[good].sum(dtype=np.uint64).astype(np.int64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits from 64 bits, all of which depend on all (the finisher of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _looking(at: Fit, shift: np.ndarray, threshold: float, heuristic: str, seed: int, listed: bool):
    """For each batch and run how many rows may move, and, if listed, the good ones beyond the threshold with the order in which they are drawn."""

    def looking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = Pieces(batch, shift)
            flags, group = pieces.flags(len(at.held)), batch.column("_group").flatten()
            kind = pa.list_(pa.struct([("k0", pa.float64()), ("k1", pa.float64()), ("at", group.type)]))
            for k, run in enumerate(at.held):
                off, good = abs(pieces.residual(at, run)), flags[:, k]
                far = np.flatnonzero(good & (off > threshold))
                found = pa.nulls(1, kind)
                if listed:
                    salt = np.zeros(1, np.uint64)
                    for x in (seed, run, at.turn):
                        salt = _mixed(salt + np.array([x], np.int64).astype(np.uint64))
                    hashed = batch.column("_hash").flatten().take(pa.array(far)).to_numpy().astype(np.uint64)
                    u = ((_mixed(hashed ^ salt) >> np.uint64(11)) + 0.5) / 2.0**53
                    first = {"weighted": -np.log(u) / off[far], "uniform": -np.log(u), "worst": -off[far]}[heuristic]
                    struct = pa.StructArray.from_arrays([pa.array(first), pa.array(u), group.take(pa.array(far))], fields=list(kind.value_type))
                    found = pa.ListArray.from_arrays(pa.array([0, len(far)], pa.int32()), struct, type=kind)
                near = int((~good & (off < threshold)).sum())
                yield pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), *(pa.array([x], pa.int64()) for x in (len(far), near, int((~good).sum()), pieces.mark(good))), found], ["_run", "far", "near", "bad", "mark", "found"])

    return looking


def _moving(at: Fit | None, shift: np.ndarray, threshold: float, runs: list[int], drawn: dict[int, pa.Array]):
    """The state after a round: bad rows near the fit are good, groups that were drawn (without draws all rows beyond the threshold) bad.  Without a fit the rows are as they start."""

    def moving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = Pieces(batch, shift)
            if at is None:
                good = np.repeat(batch.column("_start").flatten().to_numpy(zero_copy_only=False)[:, None], len(runs), 1)
            else:
                before, group, good = pieces.flags(len(at.held)), batch.column("_group").flatten(), np.empty((pieces.z.shape[1], len(runs)), bool)
                for k, run in enumerate(runs):
                    off, was = abs(pieces.residual(at, run)), before[:, at.held.index(run)]
                    leaves = pc.is_in(group, value_set=drawn[run].cast(group.type)).to_numpy(zero_copy_only=False) if run in drawn else was & (off > threshold)
                    good[:, k] = (was | (off < threshold)) & ~leaves
            n, sums, cross = len(shift), [], []
            for k in range(len(runs)):
                z = pieces.z * good[:, k]
                sums.append(np.concatenate([np.add.reduceat(good[None, :, k], pieces.starts, axis=1, dtype=float), np.add.reduceat(z, pieces.starts, axis=1)]).T)
                cross.append(z @ z.T)
            ends = np.concatenate([[0], np.cumsum(pieces.lengths) * len(runs)]).astype(np.int32)
            flags = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(good.astype(np.uint8).tobytes())])
            listed = lambda each, values: pa.ListArray.from_arrays(pa.array(each, pa.int32()), pa.array(np.ravel(values)))
            own = listed(np.arange(len(batch) + 1) * len(runs) * (n + 1), np.stack(sums, 1))
            whole = listed(np.minimum(np.arange(len(batch) + 1), 1) * len(runs) * n * n, np.stack(cross))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_piece", "_owner", "_first")), flags, own, whole], ["_piece", "_owner", "_first", "_flags", "_sums", "_cross"])

    return moving


def _fitted(at: Fit, shift: np.ndarray, runs: list[int]):
    """A row a piece and run: whether each of its rows is good, the fitted value and the residual."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = Pieces(batch, shift)
            flags, ends = pieces.flags(len(at.held)), pa.array(np.append(pieces.starts, pieces.z.shape[1]), pa.int32())
            for run in runs:
                left = pieces.residual(at, run)
                fits = pa.StructArray.from_arrays([pa.array(flags[:, at.held.index(run)]), pa.array(pieces.z[0] + shift[0] - left), pa.array(left)], ["good", "fitted", "residual"])
                yield pa.RecordBatch.from_arrays([batch.column("_piece"), pa.array([run] * len(batch), pa.int32()), pa.ListArray.from_arrays(ends, fits)], ["_piece", "_run", "_fits"])

    return fitted


def _moved(effects: DataFrame, solved: dict, old_effects: DataFrame, old: dict, by: str, sequence: str, centre: np.ndarray, reach: np.ndarray, runs: list[int]) -> tuple[DataFrame, float]:
    """(by, sequence, _move): no row's fitted value has moved further between two fits; and the same for rows of no such sequence.

    That is the move at the centre of the shared columns, and that of the coefficients times the reach from there."""
    none = [0.0] * len(centre)
    step = {r: np.array(solved.get(r, none)) - np.array(old.get(r, none)) for r in runs}
    at, far = [float(d @ centre) for d in step.values()], [float(abs(d) @ reach) for d in step.values()]
    table = pa.table({by: pa.array(step, pa.int32()), "_centre": pa.array(at, pa.float64()), "_reach": pa.array(far, pa.float64())})
    both = effects.join(old_effects.withColumnRenamed("_effect", "_old"), [by, sequence], "full").join(F.broadcast(effects.sparkSession.createDataFrame(table)), by)
    own = F.abs(F.coalesce("_effect", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0)) + F.col("_centre")) + F.col("_reach")
    return both.select(by, sequence, own.alias("_move")), max(abs(c) + r for c, r in zip(at, far))


#: Critical points of a score by default, as many as its lattice has steps.
POINTS = 10


def critical_points(scored: DataFrame, score: str, points: int = POINTS, ndecoys: int = 1, decoy: str = "decoy") -> list[float]:
    """Thresholds of a score, best first: the kept points of its FDR curve and its worst value; of more than `points` the best and the worst stay."""
    kept = [r[0] for r in fdr_curve(scored, ndecoys, score, decoy).orderBy(F.col("score").desc()).limit(points).select("score").collect()]
    worst = scored.agg(F.min(score)).first()[0]
    every = [*kept, *([worst] if worst is not None and worst not in kept else [])]
    return list(map(float, every if len(every) <= points else [*every[: points - 1], worst]))


def _step(score: str, points: list[float]) -> Column:
    """Place of the best threshold that a score reaches."""
    return F.size(F.filter(F.array(*map(F.lit, points)), lambda p: p > F.col(score)))


def lattice_fdr(scored: DataFrame, dims: list[str], target: float | None = None, points: int = POINTS, ndecoys: int = 1, decoy: str = "decoy") -> dict:
    """The lattice of several scores: its thresholds (points), and a path through it (trace).

    Each score has its critical points as steps.  Spark counts targets and decoys per cell; the driver holds the lattice, at
    most points to the power of the scores.  A corner accepts what reaches all its thresholds; its FDR is the least of the corners
    that are looser in every score, at most 1.  The path goes from the loosest corner, or from the one with most targets at an
    FDR of at most `target`, always to the tighter neighbour (in one score or several) with the most targets, ties to the one that moves
    later scores, up to the tightest corner.  trace has the corners where the FDR changes, tightest first: thresholds, steps, fdr,
    targets, decoys.  Rows with a null score are left out; without rows, or with none at the target, the trace is empty."""
    kept = scored.where(reduce(Column.__and__, (F.col(d).isNotNull() for d in dims)))
    steps = {d: critical_points(kept, d, points, ndecoys, decoy) for d in dims}
    if not all(steps.values()):
        return {"points": steps, "trace": []}
    cells = kept.groupBy(*(_step(d, steps[d]).alias(f"_{d}") for d in dims)).agg(F.count_if(F.col(decoy) == 0).alias("t"), F.count_if(F.col(decoy) != 0).alias("d")).collect()
    shape = tuple(len(steps[d]) for d in dims)
    t, n = np.zeros(shape), np.zeros(shape)
    for r in cells:
        at = tuple(r[f"_{d}"] for d in dims)
        t[at], n[at] = r.t, r.d
    for axis in range(len(dims)):
        t, n = np.cumsum(t, axis), np.cumsum(n, axis)
    fdr = np.where(t > 0, n / ndecoys / np.maximum(t, 1), 1.0)
    for axis in range(len(dims)):
        fdr = np.flip(np.minimum.accumulate(np.flip(fdr, axis), axis), axis)
    fdr = np.minimum(fdr, 1.0)
    at = tuple(x - 1 for x in shape)
    if target is not None:
        reached = np.where(fdr <= target, t, -1)
        at = tuple(map(int, np.unravel_index(int(reached.argmax()), shape)))
        if reached[at] <= 0:
            return {"points": steps, "trace": []}
    path = [at]
    while any(path[-1]):
        ways = [m for m in range(1, 1 << len(dims)) if all(path[-1][k] for k in range(len(dims)) if m >> k & 1)]
        back = [tuple(x - (m >> k & 1) for k, x in enumerate(path[-1])) for m in ways]
        path.append(max(zip((t[b] for b in back), ways, back))[2])
    corners = [p for k, p in enumerate(path) if k in (0, len(path) - 1) or fdr[p] != fdr[path[k - 1]]]
    row = lambda p: {"thresholds": {d: steps[d][i] for d, i in zip(dims, p)}, "steps": p, "fdr": float(fdr[p]), "targets": int(t[p]), "decoys": int(n[p])}
    return {"points": steps, "trace": [row(p) for p in corners[::-1]]}


def assign_lattice_fdr(scored: DataFrame, lattice: dict) -> DataFrame:
    """scored with fdr: that of the tightest corner of the trace all of whose thresholds a row's scores reach; 1 without one.

    The trace, at most as many corners as all scores have steps, goes into the expression."""
    reached = [F.when(reduce(Column.__and__, (F.col(d) >= v for d, v in c["thresholds"].items())), c["fdr"]) for c in lattice["trace"]]
    return scored.withColumn("fdr", F.coalesce(*reached, F.lit(1.0)))


def accepted_by(scored: DataFrame, thresholds: dict[str, float], decoy: str = "decoy") -> DataFrame:
    """Targets that reach every threshold."""
    return scored.where(F.col(decoy) == 0).where(reduce(Column.__and__, (F.col(d) >= v for d, v in thresholds.items())))
