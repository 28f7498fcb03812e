"""Retention model and score lattice on small inputs with known answers."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweetlake.operators import fdr, models


def test_retention_model(spark):
    rng = np.random.default_rng(5)
    effect = rng.normal(50, 20, 12)
    rows = []
    for i in range(240):
        p, a, c = i % 12, float(rng.normal()), float(rng.integers(0, 3))
        rows.append((f"p{p}", a, c, float(effect[p] + 3 * a - 2 * c + (80 if i in (17, 101) else 0))))
    df = spark.createDataFrame([*rows, ("p1", None, 1.0, 5.0)], "pep string, a double, c double, rt double")
    out, b = models.retention_model(df, "pep", "rt", ["a", "c"], threshold=25)
    assert abs(b["a"] - 3) < 1e-6 and abs(b["c"] + 2) < 1e-6
    got = out.collect()
    assert len(got) == 240 and sum(not r.good for r in got) == 2 and max(abs(r.residual) for r in got if r.good) < 1e-6


def plain_lattice(rows, dims, target, points, ndecoys=1):
    """rows: (scores.., decoy). Trace (thresholds, fdr, targets, decoys) and the FDR of each row, from the definition."""
    rate = lambda t, d: d / ndecoys / t if t else 1e20
    steps = []
    for k in range(dims):
        values = sorted({r[k] for r in rows}, reverse=True)
        raw = [rate(*(sum(r[k] >= v and r[-1] == x for r in rows) for x in (0, 1))) for v in values]
        mono = [min(1.0, *raw[i:]) for i in range(len(raw))]
        crit = [v for i, v in enumerate(values) if i == len(values) - 1 or mono[i] != mono[i + 1]]
        steps.append(crit if len(crit) <= points else [*crit[: points - 1], crit[-1]])
    corners = list(itertools.product(*(range(len(s)) for s in steps)))
    count = {c: tuple(sum(r[-1] == x and all(r[k] >= steps[k][i] for k, i in enumerate(c)) for r in rows) for x in (0, 1)) for c in corners}
    fdr = {c: min(1.0, *(rate(*count[o]) for o in corners if all(x >= y for x, y in zip(o, c)))) for c in corners}
    at = corners[-1]
    if target is not None:
        fit = [c for c in corners if fdr[c] <= target and count[c][0]]
        if not fit:
            return [], [1.0] * len(rows)
        at = max(fit, key=lambda c: (count[c][0], [-x for x in c]))
    path = [at]
    while any(at):
        back = [tuple(x - y for x, y in zip(at, m)) for m in itertools.product((0, 1), repeat=dims) if any(m)]
        at = max((b for b in back if min(b) >= 0), key=lambda b: (count[b][0], sum(2**k for k in range(dims) if b[k] < at[k])))
        path.append(at)
    kept = [c for k, c in enumerate(path) if k in (0, len(path) - 1) or fdr[c] != fdr[path[k - 1]]][::-1]
    trace = [(tuple(steps[k][i] for k, i in enumerate(c)), fdr[c], *count[c]) for c in kept]
    return trace, [next((f for v, f, _, _ in trace if all(r[k] >= x for k, x in enumerate(v))), 1.0) for r in rows]


@pytest.mark.parametrize(("dims", "target", "points"), [(1, None, 500), (1, 0.2, 4), (2, None, 6), (2, 0.15, 6), (3, None, 4), (2, -1.0, 5)])
def test_lattice_equals_plain(spark, dims, target, points):
    rng = np.random.default_rng(dims + points)
    rows = [(*(float(np.round(rng.normal(1.5 * (i % 3 > 0)), 1)) for _ in range(dims)), int(i % 3 == 0)) for i in range(150)]
    names = [f"s{k}" for k in range(dims)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, {', '.join(n + ' double' for n in names)}, decoy int")
    found = models.lattice_fdr(df, names, target, points)
    trace, each = plain_lattice(rows, dims, target, points)
    assert [(tuple(c["thresholds"][n] for n in names), c["fdr"], c["targets"], c["decoys"]) for c in found["trace"]] == trace
    assert [r.fdr for r in models.assign_lattice_fdr(df, found).orderBy("id").collect()] == each
    assert (target == -1.0) == (not trace)


def test_lattice_of_one_score_gives_qvalues(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(float(np.round(rng.normal(1.5 * (i % 3 > 0)), 2)), int(i % 3 == 0)) for i in range(400)] + [(None, 0)], "s double, decoy int")
    got = models.assign_lattice_fdr(fdr.assign_qvalue(df, fdr.fdr_curve(df, score="s"), "s"), models.lattice_fdr(df, ["s"], points=400)).collect()
    assert all(r.fdr == r.qvalue for r in got) and len({r.fdr for r in got}) > 5
    assert models.lattice_fdr(df.limit(0), ["s"])["trace"] == []


def runs_data(spark):
    """30 sequences of 1 or 2 peptides; some groups far off, for a few sequences most of them, all to one side."""
    rng = np.random.default_rng(12)
    rows, known, wrong = [], [], set()
    for q in range(30):
        effect = float(rng.normal(60, 25))
        for i in range(9):
            c, n = int(rng.integers(0, 3)), float(rng.integers(3, 12))
            y = effect + 1.5 * (c > 0) + 4.0 * (c > 1) - 2 * n + float(rng.normal(0, 0.3))
            off = i < (5 if q % 6 == 0 else q % 3)
            if off:
                wrong.add((q, i))
            rows.append((q * 100 + i, f"q{q}", f"p{q}-{i % 2}", c, n, y + (40 + i if off else 0)))
            if i < 2 or i > 6:
                known.append((f"q{q}", c, n, y))
    schema = "tg int, seq string, pep string, s int, total double, nrt double"
    df = spark.createDataFrame([*rows, (9_999, "q1", "p1-0", 1, None, 3.0)], schema)
    return rows, wrong, *models.with_categories(df, ["s"]), spark.createDataFrame(known, "seq string, s int, total double, nrt double")


def fitted_plain(rows, good):
    """Residual of each row by one least-squares fit of all columns over the good rows."""
    names = sorted({r[1] for r in rows})
    a = np.array([[*(r[1] == n for n in names), r[3] == 1, r[3] == 2, r[4]] for r in rows], float)
    y = np.array([r[5] for r in rows])
    beta = np.linalg.lstsq(a[good], y[good], rcond=1e-12)[0]
    return y - a @ beta


@pytest.mark.parametrize("heuristic", ["weighted", "uniform", "worst", "all"])
def test_retention_runs_end_where_no_row_moves(spark, heuristic):
    rows, wrong, df, names, known = runs_data(spark)
    xs = [*names, "total"]
    best, stats = models.retention_runs(df, "tg", "seq", "pep", "nrt", xs, threshold=8.0, choose=25, runs=3, heuristic=heuristic, seed=4)
    got = {r.tg: r for r in best.collect()}
    assert got.keys() == {r[0] for r in rows} and names == ["s_1", "s_2"]
    good = np.array([got[r[0]].good for r in rows])
    residual = fitted_plain(rows, good)
    assert max(abs(residual - np.array([got[r[0]].residual for r in rows]))[good]) < 1e-6
    assert max(abs(residual[good])) <= 8 <= min(abs(residual[~good]))
    lost = lambda ok: len({r[2] for r in rows} - {r[2] for r, g in zip(rows, ok) if g})
    chosen = next(s for s in stats if s["run"] == next(iter(got.values())).run)
    assert chosen["lost_peptides"] == lost(good) == min(s["lost_peptides"] for s in stats)


def test_retention_runs_from_known_values_find_the_planted_rows(spark):
    """From all good, five far rows of nine pull a sequence to their side; known values of others start it right."""
    rows, wrong, df, names, known = runs_data(spark)
    given, _ = models.with_categories(known, ["s"])
    ask = lambda **kw: models.retention_runs(df, "tg", "seq", "pep", "nrt", [*names, "total"], threshold=8.0, choose=10, **kw)
    bad = lambda out: {(r.tg // 100, r.tg % 100) for r in out.where("not good").collect()}
    right, stats = ask(known=given, runs=2, seed=3)
    assert bad(right) == wrong and stats[0]["bad"] == len(wrong) and abs(stats[0]["coefficients"]["total"] + 2) < 0.1
    alone, one = ask(runs=1, seed=3)
    assert bad(alone) != wrong
    # Draws depend on seed, run, round and group alone.
    facts = lambda stats: [(s["run"], s["rounds"], s["bad"], s["lost_peptides"]) for s in stats]
    _, several = models.retention_runs(df.repartition(3), "tg", "seq", "pep", "nrt", [*names, "total"], threshold=8.0, choose=10, runs=3, seed=3)
    assert facts(several)[0] == facts(one)[0] and len(several) == 3


def test_retention_runs_of_no_rows(spark):
    df = spark.createDataFrame([], "tg int, seq string, pep string, total double, nrt double")
    assert models.retention_runs(df, "tg", "seq", "pep", "nrt", ["total"], runs=2)[0].count() == 0


def test_retention_runs_take_few_jobs_a_round(spark):
    """40 rows that are called bad one by one: a round is few jobs, of which one writes flags and sums."""
    rows = [(i, f"q{i % 4}", f"p{i}", float(i % 7), 10.0 * (i % 4) + 3 * (i % 7) + (30 + i if i % 5 == 0 else 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "tg int, seq string, pep string, n double, nrt double").localCheckpoint()
    spark.sparkContext.setJobGroup("retention", "rounds")
    best, stats = models.retention_runs(df, "tg", "seq", "pep", "nrt", ["n"], threshold=12.0, choose=10, heuristic="worst")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("retention"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stats[0]["rounds"] > 3 and best.where("not good").count() == stats[0]["bad"] == 40
    assert jobs <= 30 + 10 * stats[0]["rounds"]


def test_retention_runs_of_long_sequences_in_pieces(spark, monkeypatch):
    """Sequences in pieces of two rows, one of them null, are fitted as whole ones; groups of several rows and unknown columns stay as they are."""
    rows, wrong, df, names, known = runs_data(spark)
    df = df.withColumn("seq", F.when(F.col("seq") != "q7", F.col("seq"))).withColumn("tg", F.col("tg") - F.col("tg") % 3).withColumn("more", F.array("tg"))
    ask = lambda: models.retention_runs(df, "tg", "seq", "pep", "nrt", [*names, "total"], threshold=8.0, choose=7, runs=2, seed=5)
    facts = lambda out: sorted((r.tg, r.pep, r.total, r.nrt, r.good, round(r.residual, 6), round(r.fitted, 6), r.more) for r in out.collect())
    whole, stats = ask()
    monkeypatch.setattr(models, "PIECE", 2)
    cut, again = ask()
    assert facts(cut) == facts(whole) and len(facts(cut)) == len(rows) and [(s["rounds"], s["bad"]) for s in again] == [(s["rounds"], s["bad"]) for s in stats]


def test_retention_model_reads_its_rows_a_few_times(spark, monkeypatch):
    """Even values, of which the threshold keeps a part that drifts for rounds: the input is computed no more often for that.  Peptides of many rows in slices give the same."""
    rng = np.random.default_rng(7)
    rows = [(i, f"p{i % 4}" if i % 100 else None, float(rng.integers(0, 9)), float(rng.uniform(0, 104))) for i in range(2_400)]
    calls = spark.sparkContext.accumulator(0)

    def counted(x):
        calls.add(1)
        return x

    df = spark.createDataFrame(rows, "id int, pep string, a double, rt double").coalesce(2)
    df = df.withColumn("rt", F.udf(counted, "double").asNondeterministic()("rt"))
    out, b = models.retention_model(df, "pep", "rt", ["a"], threshold=40)
    used, got = calls.value, {r.id: r for r in out.collect()}
    # Rounds of a plain version, with the rows without a peptide aside.
    own = [r for r in rows if r[1]]
    x, y, q = np.array([r[2] for r in own]), np.array([r[3] for r in own]), np.array([int(r[1][1]) for r in own])
    a, good, rounds = np.stack([x, *(q == k for k in range(4))], 1).astype(float), np.ones(len(own), bool), 0
    while True:
        beta, rounds = np.linalg.lstsq(a[good], y[good], rcond=None)[0], rounds + 1
        now = abs(y - a @ beta) <= 40
        if (now == good).all():
            break
        good = now
    assert rounds > 6 and used <= 4 * len(rows) and b["a"] == pytest.approx(beta[0])
    assert [got[r[0]].good for r in own] == good.tolist() and len(got) == len(rows)
    assert all(got[r[0]].fitted == pytest.approx(beta[1:].mean() + beta[0] * r[2]) for r in rows if not r[1])
    monkeypatch.setattr(models, "SLICE", 100)
    again, c = models.retention_model(df, "pep", "rt", ["a"], threshold=40)
    assert c["a"] == pytest.approx(beta[0]) and {r.id for r in again.where("good").collect()} == {k for k, r in got.items() if r.good}
