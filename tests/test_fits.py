"""Fits and tails against plain versions, and rules that no SQL twin covers."""

import itertools
import math
import random
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweetlake.operators import chromatograms
from sweetlake.operators import chromatograms as c
from sweetlake.operators import hierarchy, lineage, models, structures
from sweetlake.operators.joins import occurrences


def test_fit_peak_finds_the_gaussian(spark):
    rows = [(s, x / 10, h * math.exp(-((x / 10 - top) ** 2) / (2 * w**2))) for s, top, w, h in ((1, 5.0, 0.4, 100.0), (2, 4.2, 0.3, 7.0), (3, 5.0, 2.0, 9.0)) for x in range(30, 71)]
    rows += [(4, 1.0, 5.0), (4, 2.0, 6.0), (4, 2.0, 6.0)] + [(5, float(x), 1.0 + x * x) for x in range(6)]
    got = {r.series: r for r in c.fit_peak(spark.createDataFrame(rows, "series long, rt double, int double")).collect()}
    assert set(got) == {1, 2}  # 3 is too wide, 4 has too few places, 5 is not concave
    for s, top, w, h in ((1, 5.0, 0.4, 100.0), (2, 4.2, 0.3, 7.0)):
        r = got[s]
        assert (r.apex, r.width, r.height, r.area) == pytest.approx((top, 6 * w, h, h * w * math.sqrt(2 * math.pi)), rel=1e-6) and r.r > 0.999


def plain_tail(chances, least):
    return sum(math.prod(p if x else 1 - p for p, x in zip(chances, xs)) for xs in itertools.product((0, 1), repeat=len(chances)) if sum(xs) >= least)


def test_slopes_of_late_times_do_not_cancel(spark):
    """A line of slope 3 has it at any time, however late."""
    df = spark.createDataFrame([(s, at + i / 100, 7 + 3 * (i / 100)) for s, at in ((1, 0.0), (2, 2.0**20), (3, 2.0**30)) for i in range(8)], "series int, rt double, int double")
    got = c.local_slope(df.withColumn("apex_int", F.lit(1.0))).where("slope is not null").collect()
    assert len(got) == 21 and all(r.slope == pytest.approx(3, rel=1e-4) for r in got)


def test_tails_equal_enumeration(spark):
    cases = [([0.1, 0.1, 0.3], 2), ([0.0, 1.0, 0.5, 0.5], 2), ([0.25] * 6, 0), ([0.9], 2), ([], 0)]
    df = spark.createDataFrame([(i, p, k) for i, (p, k) in enumerate(cases)], "i int, p array<double>, k int")
    got = {r.i: r.tail for r in df.select("i", c.poisson_binomial_tail("p", "k").alias("tail")).collect()}
    assert all(got[i] == pytest.approx(plain_tail(p, k), abs=1e-12) for i, (p, k) in enumerate(cases))


def test_phenotype_enrichment_equals_plain(spark):
    rng = np.random.default_rng(4)
    residues = sorted({(f"m{rng.integers(3)}", int(rng.integers(12))) for _ in range(30)})
    genes = sorted({(int(rng.integers(12)), f"g{rng.integers(8)}") for _ in range(24)})
    pheno = sorted({(f"g{rng.integers(8)}", f"p{rng.integers(3)}") for _ in range(9)})
    of = lambda pairs: {k: {b for a, b in pairs if a == k} for k, _ in pairs}
    motifs, held = of(residues), of(genes)
    known = {g for g, _ in pheno}
    want = {}
    for m, rids in motifs.items():
        for p in {p for _, p in pheno}:
            carriers = {g for g, q in pheno if q == p}
            ks = [len(held.get(r, set()) & known) for r in rids if held.get(r, set()) & known]
            hits = sum(bool(held.get(r, set()) & carriers) for r in rids)
            if hits:
                want[m, p] = (hits, -10 * math.log10(max(1e-30, plain_tail([1 - (1 - len(carriers) / len(known)) ** k for k in ks], hits))))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = c.phenotype_enrichment(df(residues, "motif string, rid int"), df(genes, "rid int, gene string"), df(pheno, "gene string, phenotype string"), least=-1)
    got = {(r.motif, r.phenotype): (r.hits, r.score) for r in found.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_phenotypes_of_many_residues_and_many_phenotypes(spark):
    """200,000 residues of one motif and 150 phenotypes: rows are a motif's kinds of residues, and folding takes seconds."""
    residues = spark.range(200_000).selectExpr("'m' as motif", "id as rid")
    genes = spark.range(200_000).selectExpr("id as rid", "explode(array(id % 150, if(id % 3 = 0, (id + 1) % 150, null))) as gene").where("gene is not null")
    pheno = spark.range(150).selectExpr("id as gene", "concat('p', id) as phenotype")
    start = time.time()
    got = {r.phenotype: r.hits for r in c.phenotype_enrichment(residues, genes, pheno, least=-1).collect()}
    counts = {f"p{k}": sum(1 for i in range(200_000) if i % 150 == k or i % 3 == 0 and (i + 1) % 150 == k) for k in (0, 1, 2, 149)}
    assert len(got) == 150 and {k: got[k] for k in counts} == counts and time.time() - start < 60


def test_large_trials_take_milliseconds():
    """Halves of 400,000 trials of two chances: the tail is that of the normal limit, by symmetry about one half."""
    start = time.time()
    assert c._trials_tail([(0.25, 200_000), (0.75, 200_000)], 200_000) == pytest.approx(0.5, abs=2e-3)
    assert c._trials_tail([(0.5, 1_000_000)], 500_001) + c._trials_tail([(0.5, 1_000_000)], 500_000) == pytest.approx(1, abs=1e-9)
    assert time.time() - start < 5


def test_rows_of_few_trials_go_together(spark):
    """200,000 rows of 3 trials and one of 200, with tails that keep their digits when they are small."""
    df = spark.range(200_000).selectExpr("array(1e-5d, 2e-5d, 3e-5d) as p", "3 as k").unionByName(spark.createDataFrame([([0.5] * 200, 200)], "p array<double>, k int"))
    start = time.time()
    got = sorted(r.t for r in df.select(c.poisson_binomial_tail("p", "k").alias("t")).distinct().collect())
    assert got == pytest.approx([0.5**200, 6e-15], rel=1e-9) and time.time() - start < 5


def test_occurrences_overlap_and_quote(spark):
    cases = [("aaaa", "aa"), ("a.b.a.b", ".b"), ("x\\Ey\\E", "\\E"), ("", "a"), ("abc", ""), ("\U0001f600a\U0001f600a", "a"), ("same", "same"), ("ab", "abc"), ("(?=a", "(?=")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, t string, p string")
    got = {r.i: list(r.at) for r in df.select("i", occurrences(F.col("t"), F.col("p")).alias("at")).collect()}
    assert got == {i: [k + 1 for k in range(len(t)) if p and t.startswith(p, k)] for i, (t, p) in enumerate(cases)}


def test_long_lineages_and_cycles(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i > 1 else 1, "genus" if i == 2 else "no rank") for i in range(1, 101)], "tax_id int, parent_id int, rank string")
    ids = spark.createDataFrame([(100,), (7,), (999,)], "id int")
    got = hierarchy.lineage_pairs(ids, nodes).collect()
    assert {(r.id, r.ancestor, r.step) for r in got} == {(i, a, i - a) for i in (100, 7) for a in range(1, i + 1)}
    assert {(r.id, r.ancestor) for r in hierarchy.ranked_ancestors(ids, nodes).collect()} == {(100, 2), (7, 2)}
    circle = spark.createDataFrame([(1, 2, ""), (2, 3, ""), (3, 1, "")], "tax_id int, parent_id int, rank string")
    with pytest.raises(ValueError):
        hierarchy.lineage_pairs(spark.createDataFrame([(1,)], "id int"), circle)


def test_closure_of_accessions_runs_to_its_end(spark):
    """A chain in which each accession brings the next by its landmark."""
    n = 30
    landmark = spark.createDataFrame([(i, i // 2) for i in range(n)] + [(i, 1000 + (i + 1) // 2) for i in range(n)], "acc int, mark int")
    none = spark.createDataFrame([], "ancestor int, descendant int")
    got = hierarchy.closure_accessions(spark.createDataFrame([(0,)], "acc int"), none, landmark)
    assert {r.acc for r in got.collect()} == set(range(1, n))


def test_retention_model_converges_or_warns(spark):
    rows = [(f"p{i % 3}", float(i), 2.0 * i + 5 * (i % 3) + (50.0 if i == 7 else 0.1 * (i % 2))) for i in range(30)]
    fitted, coefficients = models.retention_model(spark.createDataFrame(rows, "pep string, x double, rt double"), "pep", "rt", ["x"])
    assert coefficients["x"] == pytest.approx(2.0, abs=0.01)
    assert [r.x for r in fitted.where("not good").collect()] == [7.0]


def test_retention_model_writes_no_rows(spark):
    """20,000 rows of 5 peptides: what a fit leaves in the shared folder is a row a peptide and round."""
    import pathlib

    folder = pathlib.Path(lineage.shared_folder(spark).removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before, df = size(), spark.range(20_000).selectExpr("id % 5 as pep", "double(id % 97) as a", "double(id % 5 + 2 * (id % 97) + if(id % 100 = 3, 60, 0)) as rt")
    fitted, b = models.retention_model(df, "pep", "rt", ["a"])
    assert fitted.where("not good").count() == 200 and b["a"] == pytest.approx(2) and size() - before < 100_000


def test_scratch_is_cleared(spark):
    df = lineage.written(spark.range(5), "gone")
    assert df.count() == 5 and lineage.WRITTEN[spark.sparkContext.applicationId]
    mine = lineage.WRITTEN[spark.sparkContext.applicationId][-1]
    others = lineage.WRITTEN.pop(spark.sparkContext.applicationId)[:-1]
    lineage.WRITTEN[spark.sparkContext.applicationId] = [mine]
    lineage.clear_scratch(spark)
    lineage.WRITTEN[spark.sparkContext.applicationId] = others
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(mine)


def exact_tails(x, pmf):
    return sum(p for i, p in pmf.items() if i <= x), sum(p for i, p in pmf.items() if i >= x)


def test_tails_equal_exact_sums():
    """Every outcome of many small cases, by whole-number combinatorics."""
    for n, g, m in itertools.product((1, 2, 7, 30), (0, 1, 3, 15, 30), (0, 1, 5, 29, 30)):
        if g <= n and m <= n:
            pmf = {i: math.comb(g, i) * math.comb(n - g, m - i) / math.comb(n, m) for i in range(max(0, m + g - n), min(g, m) + 1)}
            for x in range(-1, n + 2):
                assert chromatograms.hypergeom_tails(x, n, g, m) == pytest.approx(exact_tails(x, pmf), rel=1e-11, abs=1e-15)
    for n, p in itertools.product((0, 1, 2, 9, 40), (0.0, 0.013, 0.5, 0.99, 1.0)):
        pmf = {i: math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)}
        for x in range(-1, n + 2):
            assert chromatograms.binom_tails(x, n, p) == pytest.approx(exact_tails(x, pmf), rel=1e-11, abs=1e-15)


def test_tails_of_very_large_counts_take_milliseconds():
    """Against exact fractions in the far tail, and the normal limit near the mean; the work grows with the spread only."""
    began = time.process_time()
    n, p = 10**8, 0.13
    low, high = chromatograms.binom_tails(int(n * p), n, p)
    assert abs(low - 0.5) < 1e-3 and abs(low + high - 1) < 1e-3
    low, high = chromatograms.hypergeom_tails(13 * 10**6 + 9_000, 10**9, 13 * 10**7, 10**8)
    assert abs(high - 0.5 * math.erfc(9_000 / math.sqrt(2 * 10**8 * 0.13 * 0.87 * 0.9))) < 1e-4
    assert chromatograms.binom_tails(10**7, n, p) == (0.0, 1.0)
    assert time.process_time() - began < 0.2
    exact = sum(Fraction(math.comb(1_000, i), 2**1_000) for i in range(700, 1_001))
    assert chromatograms.binom_tails(700, 1_000, 0.5)[1] == pytest.approx(float(exact), rel=1e-11)


def test_specificity_levels_and_scores(spark):
    """Labels with and without a star, an unknown glycan beside the roll-up, rows that are neither, few rows without score."""
    rows = [("g1", "Y1*", True, 4.0)] * 9 + [("g1", "Y1", False, 1.0)] * 3 + [(None, "Y1", False, None)] * 2 + [("g2", "B2**", False, 8.0)] * 3 + [("g2", "B2*", None, 9.0)] * 3
    got = {(r.by_glycan, r.glycan, r.label): r for r in chromatograms.specificity_by_label(spark.createDataFrame(rows, "glycan string, label string, good boolean, x double"), "glycan", "label", "good", {"mid": "x"}).collect()}
    assert got.keys() == {(False, None, "Y1"), (False, None, "B2*"), (True, "g1", "Y1"), (True, None, "Y1"), (True, "g2", "B2*")}
    whole = got[False, None, "Y1"]
    assert (whole.n_specific, whole.n_other, whole.total, whole.mid, got[True, None, "Y1"].mid) == (9, 5, 14, 4.0, None)
    assert got[False, None, "B2*"].score is None and got[True, None, "Y1"].total == 2
    # 3 of all 20 rows are the background: 5 of 14 are more than may be, so the log odds are undefined and the lower tail is 1.
    assert whole.score == 0.0
    x, n, bad, every = 3, 12, 3, 20
    high = sum(math.comb(bad, i) * math.comb(every - bad, n - i) for i in range(x, bad + 1)) / math.comb(every, n)
    assert got[True, "g1", "Y1"].score == pytest.approx(10 * math.log10(high))
    assert got[True, "g1", "Y1"].percent_other == 25.0


def test_specificity_borders(spark):
    x = spark.createDataFrame([("s", -9.0, 1.0), ("s", -1.0, 7.0), ("s", 0.9994, 20.0), ("s", 1.0, 8.0), ("s", 6.0, 99.0), ("z", 0.0, 0.0)], "series string, rt double, int double")
    c = spark.createDataFrame([("s", 0.0), ("z", 0.0)], "series string, centre double")
    got = {r.series: tuple(r)[1:] for r in chromatograms.chromatogram_specificity(x, c).collect()}
    assert got == {"s": (20.0, 8.0, 40.0, True), "z": (0.0, 0.0, None, None)}


def test_robust_fit_equals_plain(spark):
    """Keys that fit at once, after removals, never, and with too few, constant or missing points; ties and repeated rows."""
    rng = np.random.default_rng(4)
    data = {}
    for k in range(24):
        x = np.round(rng.uniform(0, 20, int(rng.integers(1, 40))), 1)
        y = 3 * x + 1 + rng.normal(0, [0.1, 4, 40][k % 3], len(x)) + 60 * (rng.random(len(x)) < 0.1)
        data[f"k{k}"] = [(float(a), float(b)) for a, b in zip(x, y)]
    data |= {"flat": [(1.0, 2.0)] * 5, "two": [(1.0, 1.0), (2.0, 2.0)], "twice": [(float(i), float(i * i)) for i in range(6)] * 2}

    def plain(points):
        points, removed = sorted(points), 0
        while len(points) >= 3 and removed <= 20:
            xs, ys = map(np.array, zip(*points))
            if xs.std() == 0 or ys.std() == 0:
                break
            r = np.corrcoef(xs, ys)[0, 1]
            if removed == 0 and abs(r) < 0.5:
                break
            slope, intercept = np.polyfit(xs, ys, 1)
            if abs(r) > 0.95:
                return slope, intercept, r, len(points), removed
            points.pop(int(np.abs(ys - slope * xs - intercept).argmax()))
            removed += 1
        return None, None, None, len(points), removed

    rows = [(k, *p) for k, ps in data.items() for p in ps] + [("two", None, 5.0)]
    got = {r.key: tuple(r)[1:] for r in c.robust_fit(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y", good=0.95).collect()}
    assert got.keys() == data.keys() and sum(g[0] is not None for g in got.values()) > 8
    for k, points in data.items():
        assert got[k] == pytest.approx(plain(points), nan_ok=True) if got[k][0] is not None else got[k] == plain(points)


def test_isotope_patterns_equal_the_whole_convolution(spark):
    elements = {"a": {"C": 6, "H": 12, "O": 6}, "b": {"N": 1}, "c": {"C": 40, "O": 30, "N": 5, "H": 66}}
    chances = {"C": [0.9893, 0.0107], "H": [0.999885, 0.000115], "N": [0.99636, 0.00364], "O": [0.99757, 0.00038, 0.00205]}
    df = spark.createDataFrame([(a, e, n) for a, es in elements.items() for e, n in es.items()], "acc string, element string, n int")
    for r in c.isotope_pattern(df, chances, cutoff=0).collect():
        whole = np.ones(1)
        for e, n in elements[r.acc].items():
            for _ in range(n):
                whole = np.convolve(whole, chances[e])
        want = np.pad(whole, (0, 6))[:6]
        assert r.pattern == pytest.approx((want / want.max()).tolist(), rel=1e-9)


def test_pieces_equal_all_connected_sets():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 7)
        up = {i: None if i == 1 or rng.random() < 0.15 else rng.randint(1, i - 1) for i in range(1, n + 1)}
        found = {tuple(ids): cuts for ids, cuts in structures.pieces([{"rid": i, "parent": p, "symbol": None, "anomer": None, "pos": None} for i, p in up.items()])}
        want = {}
        for k in range(1, n + 1):
            for ids in itertools.combinations(range(1, n + 1), k):
                inside = sum(up[i] in ids for i in ids)
                if inside == k - 1:
                    want[ids] = sum(p is not None and (i in ids) != (p in ids) for i, p in up.items())
        assert found == want


def test_no_row_moves_past_the_bound_of_its_sequence(spark):
    """Two fits of rows of many sequences, one of which only the later fit has: the bound holds for each row, and is not far from it."""
    rng = np.random.default_rng(2)
    rows = [(0, int(s), float(x), float(3 * x + s + e)) for s, x, e in zip(rng.integers(0, 9, 400), rng.uniform(5, 9, 400), rng.normal(0, 5, 400))]
    df = spark.createDataFrame(rows, "_run int, seq int, x double, y double")
    shift = {"x": 7.0, "y": 20.0}
    fits = []
    for kept in ("seq < 8 and y < 26", "y < 29"):
        sums = models._sums(df.where(kept), "_run", "seq", "y", ["x"], shift).localCheckpoint()
        solved = models._solved(sums, "_run", 1)
        effects = models._effects(sums, "_run", "seq", "y", ["x"], shift, solved)
        fits.append((effects, solved, {r.seq: r._effect for r in effects.collect()}))
    (e0, b0, f0), (e1, b1, f1) = fits
    moved, _ = models._moved(e1, b1, e0, b0, "_run", "seq", np.array([7.0]), np.array([2.0]), [0])
    bound = {r.seq: r._move for r in moved.collect()}
    for _, s, x, _ in rows:
        real = abs(f1[s] + b1[0][0] * x - f0.get(s, 0.0) - b0[0][0] * x)
        assert real <= bound[s] + 1e-9 <= real + 4 * abs(b1[0][0] - b0[0][0]) + 1e-6
    assert set(bound) == set(range(9))
