"""Genomic operators against NumPy and brute force on small seeded data."""

import itertools
import math
import struct
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from allelica.functions import distributions as D
from allelica.operators import association, decay, gwas, ld, prediction, qc, relational, segmentation
from allelica.operators import haplotypes as H
from allelica.plans import pipeline
from allelica.sources import readers, writers
from tests.conftest import rows


@pytest.fixture(scope="module")
def panel():
    """80 samples x 24 variants in three blocks of eight with shared haplotypes; two per cent missing."""
    rng = np.random.default_rng(7)
    blocks = []
    for _ in range(3):
        founders = rng.integers(0, 2, (4, 8))
        pick = rng.integers(0, 4, (80, 2))
        blocks.append(founders[pick[:, 0]] + founders[pick[:, 1]])
    x = np.concatenate(blocks, 1).astype(float)
    x[rng.random(x.shape) < 0.02] = np.nan
    info = pd.DataFrame({"SNP": [f"rs{i}" for i in range(24)], "CHR": ["chr1"] * 16 + ["2"] * 8, "POS": [1000 + 900 * i + 60_000 * (i // 8) for i in range(24)], "REF": ["A", "G", "C", "T"] * 6, "ALT": ["T", "C", "A", "G"] * 6})
    return x, info


@pytest.fixture(scope="module")
def geno(spark, panel):
    return readers.from_matrix(spark, *panel).cache()


def numpy_r2(x):
    m = np.where(np.isfinite(x), x, np.nanmean(x, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.corrcoef(m, rowvar=False) ** 2
    return np.nan_to_num(r)


def test_distributions():
    assert D.t_two_sided(np.array([2.228, 12.706]), np.array([10, 1])) == pytest.approx([0.05, 0.05], abs=1e-4)
    assert D.f_upper(np.array([4.103]), 2, 10)[0] == pytest.approx(0.05, abs=1e-4)
    assert D.chi2_upper(np.array([3.841, 11.07]), np.array([1, 5])) == pytest.approx([0.05, 0.05], abs=1e-4)
    assert D.norm_quantile(np.array([0.975]))[0] == pytest.approx(1.959964, abs=1e-6)
    assert D.norm_two_sided(np.array([1.959964]))[0] == pytest.approx(0.05, abs=1e-7)


def test_pair_r2_tiles_match_numpy(spark, geno, panel):
    x, info = panel
    r = numpy_r2(x)
    v = ld.variant_major(geno)
    for tile in (512, 3):
        got = {(a["snp_i"], a["snp_j"]): a["r2"] for a in ld.pair_r2(v, tile=tile).collect()}
        want = {(f"rs{i}", f"rs{j}"): r[i, j] for i, j in itertools.combinations(range(24), 2) if (i < 16) == (j < 16)}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
        near = {(a["snp_i"], a["snp_j"]) for a in ld.pair_r2(v, 5000, 0.2, tile).collect()}
        assert near == {k for k, w in want.items() if w >= 0.2 and abs(info["POS"][int(k[1][2:])] - info["POS"][int(k[0][2:])]) <= 5000}


def test_r2_of_constant_and_missing_variants(spark):
    g = spark.createDataFrame([(s, "1", p, f"v{p}", d) for p, ds in {1: [1, 1, 1], 2: [0, 1, 2], 3: [None, None, None], 4: [0, 1, 2]}.items() for s, d in zip("abc", ds)], "sample_id string, chr string, pos int, snp string, dosage int")
    got = {(a["snp_i"], a["snp_j"]): a["r2"] for a in ld.pair_r2(ld.variant_major(g)).collect()}
    assert got[("v2", "v4")] == pytest.approx(1) and got[("v1", "v2")] == 0 and got[("v2", "v3")] == 0
    assert ld.pair_r2(ld.variant_major(g.limit(0))).count() == 0


def test_boundary_scan_brute(spark, geno, panel):
    x, _ = panel
    r = numpy_r2(x)
    v = ld.variant_major(geno)
    got = {a["snp"]: a["valid"] for a in ld.boundary_scan(ld.pair_r2(v, threshold=0.3), v, 4, 0.3).collect()}
    for lo, hi in ((0, 16), (16, 24)):
        for c in range(lo, hi - 1):
            cross = any(r[i, j] >= 0.3 for i in range(max(lo, c - 3), c + 1) for j in range(c + 1, min(hi, c + 5)))
            assert got[f"rs{c}"] == int(not cross)


def test_whitening():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 30))
    v = a @ a.T / 30
    for m in ("eigen", "chol"):
        w = ld.whitener(v, m)
        assert np.allclose(w @ v @ w.T, np.eye(12), atol=1e-8)
    # without full rank: the Cholesky factor of the bent matrix, the identity on the eigenvectors that are kept
    low = a[:, :5] @ a[:, :5].T
    w = ld.whitener(low, "chol")
    assert np.allclose(w @ (0.99 * low + 0.01 * np.eye(12)) @ w.T, np.eye(12), atol=1e-8)
    w = ld.whitener(low)
    assert np.allclose(np.linalg.eigvalsh(w @ low @ w.T)[-5:], 1) and np.linalg.matrix_rank(w) == 5


def test_segmentation_finds_planted_blocks(spark, geno):
    b = segmentation.segment(ld.variant_major(geno), cut=0.1, mode="density").collect()
    assert len(b) >= 3
    for x, y in itertools.combinations(sorted(b, key=lambda r: (r["chr"], r["start_ix"])), 2):
        assert x["chr"] != y["chr"] or x["end_ix"] < y["start_ix"]
    assert all(r["length_bp"] == r["end_bp"] - r["start_bp"] + 1 for r in b)


def test_forced_cuts_are_weak_and_joined_again(spark):
    v = spark.createDataFrame([("1", 1000 * (i + 1), f"v{i:02}") for i in range(24)], "chr string, pos int, snp string")
    strong = [(i, j) for lo, hi in ((0, 7), (7, 16), (16, 24)) for i, j in itertools.combinations(range(lo, hi), 2)] + [(6, 7), (15, 16)]
    pairs = spark.createDataFrame([("1", f"v{i:02}", f"v{j:02}", 1.0) for i, j in strong], "chr string, snp_i string, snp_j string, r2 double")
    piece = {r["snp"]: r["piece"] for r in segmentation.cut_points(v, longest=10, pairs=pairs).collect()}
    sizes = [sum(p == q for q in piece.values()) for p in set(piece.values())]
    # the stretches of five from 5 on hold one cut each: those of blocks at the blocks' ends
    assert max(sizes) <= 10 and piece["v06"] != piece["v07"] and piece["v15"] != piece["v16"]
    rng = np.random.default_rng(3)
    one, two = rng.integers(0, 3, 60), rng.integers(0, 3, 60)
    # every variant alike is a block over all forced cuts; two blocks linked by no pair stay two
    g = [(f"s{s}", "1", 1000 * (i + 1), f"v{i:02}", int(one[s])) for i in range(34) for s in range(60)]
    g += [(f"s{s}", "2", 1000 * (i + 1), f"w{i:02}", int((one if i < 13 else two)[s])) for i in range(26) for s in range(60)]
    d = ld.variant_major(spark.createDataFrame(g, "sample_id string, chr string, pos int, snp string, dosage int"))
    for mode in ("density", "maximal"):
        b = segmentation.segment(d, mode=mode, longest=10).collect()
        got = sorted((r["chr"], r["start_ix"], r["end_ix"], r["n_snps"], r["start_bp"], r["end_rsid"]) for r in b)
        assert got == [("1", 1, 34, 34, 1000, "v33"), ("2", 1, 13, 13, 1000, "w12"), ("2", 14, 26, 13, 14000, "w25")]


def test_appended_variants_far_off_and_leftover_blocks(spark):
    rng = np.random.default_rng(5)
    kinds = rng.integers(0, 3, (60, 60))
    # a block of 5, 25 unlike variants, one like the block, 3 alike in none, then two blocks that both claim variant 41
    which = [0] * 5 + list(range(10, 35)) + [0] + [1] * 3 + [2] * 6 + [3] * 6
    cols = [kinds[k] for k in which]
    g = [(f"s{s}", "1", 1000 * (i + 1), f"v{i + 1:02}", int(c[s])) for i, c in enumerate(cols) for s in range(60)]
    v = ld.variant_major(spark.createDataFrame(g, "sample_id string, chr string, pos int, snp string, dosage int"))
    blocks = spark.createDataFrame([("1", 1, 5), ("1", 35, 38), ("1", 42, 46)], "chr string, start_ix int, end_ix int")
    strong = spark.createDataFrame([("1", f"v{i:02}", f"v{j:02}") for i in range(1, 47) for j in range(i + 1, 47) if which[i - 1] == which[j - 1]] + [("1", f"v{i:02}", "v41") for i in range(35, 39)] + [("1", "v39", f"v{j:02}") for j in range(42, 47)], "chr string, snp_i string, snp_j string")
    got = sorted((r["start_ix"], r["end_ix"], r["end_rsid"], r["n_snps"]) for r in segmentation.append_rare(blocks, strong, v).collect())
    assert got == [(1, 31, "v31", 31), (32, 34, "v34", 3), (35, 40, "v40", 6), (41, 46, "v46", 6)]


def test_cliques_and_scheduling():
    adj = np.zeros((6, 6), bool)
    for i, j in ((0, 1), (0, 2), (1, 2), (2, 3), (4, 5)):
        adj[i, j] = adj[j, i] = True
    assert segmentation.maximal_cliques(adj) == [[0, 1, 2], [2, 3], [4, 5]]
    assert segmentation.maximal_cliques(adj, 1) is None
    got = segmentation.heaviest_disjoint([(0, 4, 3), (3, 8, 4), (5, 9, 3), (10, 11, 1)])
    assert sum(w for _, _, w in got) == 7 and got == [(0, 4, 3), (5, 9, 3), (10, 11, 1)]
    r = np.kron(np.eye(2), np.ones((3, 3)))
    assert sorted(segmentation.louvain(r - np.eye(6)).tolist()) == [0, 0, 0, 1, 1, 1]


def test_overlap_is_split():
    r = np.eye(30)
    r[:16, :16] = 0.9
    r[16:, 16:] = 0.95
    out = segmentation.resolve_overlap([(1, 18), (15, 28)], r, 5)
    assert out == [(1, 15), (16, 28)]
    assert segmentation.resolve_overlap([(0, 10), (2, 5)], r) == [(0, 10)]


def test_imputation_rules(spark):
    g = spark.createDataFrame([(f"s{i}", "1", 1, "a", d) for i, d in enumerate([0, 0, 2, 2, None])] + [(f"s{i}", "1", 2, "b", d) for i, d in enumerate([2, 2, 0, None, None])], "sample_id string, chr string, pos int, snp string, dosage int")
    fill = {(r["snp"], m): r["fill"] for m in ("mean_rounded", "mode") for r in qc.fill_values(qc.variant_stats(g), m).collect()}
    assert fill == {("a", "mean_rounded"): 1, ("b", "mean_rounded"): 1, ("a", "mode"): 1, ("b", "mode"): 2}
    assert qc.impute(g, 0.7).select("snp").distinct().count() == 1
    with pytest.raises(ValueError):
        qc.impute(g, 0, "none")


BLOCKS = "block_id string, chr string, start_bp int, end_bp int, n_snps int"


def test_haplotype_family(spark, geno, panel):
    x, info = panel
    b = spark.createDataFrame([("b1", "1", 1000, 8000, 8), ("b2", "1", 60000, 90000, 8)], BLOCKS)
    h = H.extract(geno, b)
    want = {f"ind{i + 1}": "".join("." if np.isnan(v) else str(int(v)) for v in x[i, :8]) for i in range(80)}
    assert {r["sample_id"]: r["hap"] for r in h.where("block_id = 'b1'").collect()} == want
    full = [v for v in want.values() if "." not in v]
    p = np.array(list(pd.Series(full).value_counts())) / len(full)
    d = H.diversity(h).where("block_id = 'b1'").first()
    assert d["he"] == pytest.approx(len(full) / (len(full) - 1) * (1 - (p**2).sum())) and d["shannon"] == pytest.approx(-(p * np.log(p)).sum())
    g = H.relationship(H.features(h, H.alleles(h, 0.05)), cells=400)
    m, ids = prediction.square(g)
    assert len(ids) == 80 and g.count() == 80 * 81 // 2 and np.allclose(m, m.T) and np.linalg.eigvalsh(m).min() > -1e-8
    for how in ("nearest", "rare_to_other", "tree_based"):
        c = H.collapse(h, 0.05, how)
        assert c.count() == h.count()
    dip = H.diplotypes_unphased(h)
    assert dip.count() == h.count() and dip.where("missing and diplotype is not null and not phase_ambiguous").where("hap1 like '%.%'").count() == 0
    assert H.extract(geno.limit(0), b).count() == 0
    assert H.network(h).groupBy("block_id").count().count() == 2


def test_unphased_resolution(spark):
    h = spark.createDataFrame([("b", "1", 1, 3, 3, s, v) for s, v in (("p", "000"), ("q", "222"), ("r", "111"), ("s", "0.1"))], "block_id string, chr string, start_bp int, end_bp int, n_snps int, sample_id string, hap string")
    got = {r["id"]: r for r in H.diplotypes_unphased(h).collect()}
    assert (got["r"]["hap1"], got["r"]["hap2"], got["r"]["phase_ambiguous"]) == ("000", "111", False)
    assert got["p"]["diplotype"] == "000/000" and got["s"]["missing"] and got["s"]["hap1"] is None


def test_relational(spark):
    pts = spark.createDataFrame([("1", p, f"s{p}") for p in (1, 5, 10, 11, 99)] + [("2", 5, "t"), (None, 5, "u"), ("1", None, "v")], "chr string, pos int, snp string")
    iv = spark.createDataFrame([("a", "1", 5, 10), ("b", "1", 10, 60), ("c", "1", 7, 7), ("d", "1", None, 9)], "block_id string, chr string, start_bp int, end_bp int").withColumnRenamed("chr", "chr")
    got = {(r["snp"], r["block_id"]) for r in relational.range_join(pts, iv).collect()}
    assert got == {("s5", "a"), ("s10", "a"), ("s10", "b"), ("s11", "b")}
    assert relational.range_join(pts, iv, how="left").count() == 4 + 5
    near = {r["snp"]: (r["block_label"], r["distance"]) for r in relational.nearest_interval(pts, iv.where("start_bp is not null"), "snp").collect()}
    assert near["s1"] == ("a*", 4) and near["s99"] == ("b*", 39) and near["s5"] == ("a", 0) and near["t"] == (None, None)
    p = spark.createDataFrame([(i, v) for i, v in enumerate([0.01, 0.02, 0.02, None, 0.5, 1.0])], "i int, p double")
    q = {r["i"]: r["q"] for r in relational.bh_adjust(p, "p", "q").collect()}
    assert q[0] == pytest.approx(0.02 * 5 / 3) and q[1] == pytest.approx(0.02 * 5 / 3) and q[3] is None and q[5] == 1.0
    isl = relational.islands(spark.createDataFrame([("g", x) for x in (1, 3, 9, 10)], "g string, x int"), ["g"], "x", 2)
    assert rows(isl) == [("g", 1, 1), ("g", 10, 2), ("g", 3, 1), ("g", 9, 2)]


def test_iou(spark):
    a = spark.createDataFrame([("x", "1", 0, 100), ("y", "1", 200, 300), ("z", "2", 1, 2)], "block_id string, chr string, start_bp int, end_bp int")
    b = spark.createDataFrame([("x", "1", 0, 100), ("w", "1", 210, 310), ("q", "1", 150, 210)], "block_id string, chr string, start_bp int, end_bp int")
    got = {r["block_id_pop1"]: (r["block_id_pop2"], r["match_type"]) for r in relational.iou_match(a, b).collect()}
    assert got == {"x": ("x", "exact"), "y": ("w", "position"), "z": (None, "pop1_only")}


def test_reml_satisfies_equations():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(60, 200))
    k = z @ z.T / 200
    u = np.linalg.cholesky(k + 1e-6 * np.eye(60)) @ rng.normal(size=60)
    y = 2 + u + rng.normal(size=60) * 0.5
    f = prediction.reml(y, k)
    h = k + f["lam"] * np.eye(60)
    assert np.allclose(f["u"], k @ np.linalg.solve(h, y - f["beta"][0]))
    assert 0.3 < f["h2"] < 1 and np.corrcoef(f["u"], u)[0, 1] > 0.7


def test_wald_matches_least_squares(spark, geno):
    b = spark.createDataFrame([("b1", "1", 1000, 8000, 8)], BLOCKS)
    h = H.extract(geno, b)
    f = H.features(h, H.alleles(h, 0.05))
    y = spark.createDataFrame([(f"ind{i + 1}", "T", float((i * 7) % 11)) for i in range(80)], "sample_id string, trait string, y double")
    got = association.wald_scan(f, y).collect()
    wide = f.toPandas().pivot(index="sample_id", columns="hap_id", values="dose").astype(float)
    wide = wide.fillna(wide.mean())
    yy = pd.Series({f"ind{i + 1}": float((i * 7) % 11) for i in range(80)}).reindex(wide.index).to_numpy()
    for r in got:
        a = np.column_stack([np.ones(80), wide[r["hap_id"]]])
        beta, rss = np.linalg.lstsq(a, yy, rcond=None)[:2]
        se = math.sqrt(rss[0] / 78 * np.linalg.inv(a.T @ a)[1, 1])
        assert r["effect"] == pytest.approx(beta[1]) and r["se"] == pytest.approx(se) and 0 <= r["p_wald"] <= 1
    t = association.block_tests(f, y).first()
    assert t["status"] == "ok" and 0 <= t["p_omnibus"] <= 1
    adj = association.adjusted(association.wald_scan(f, y), association.effective_tests(f))
    assert adj.where("p_fdr < p_wald - 1e-12").count() == 0 and adj.where("meff < 1").count() == 0


def test_diplotype_effects(spark):
    d = [("b", "1", 1, 5, f"i{i}", h, g, f"{h}/{g}", h != g, False, False) for i, (h, g) in enumerate([("0", "0")] * 6 + [("0", "1")] * 6 + [("1", "1")] * 6)]
    dip = spark.createDataFrame(d, "block_id string, chr string, start_bp int, end_bp int, id string, hap1 string, hap2 string, diplotype string, heterozygous boolean, phase_ambiguous boolean, missing boolean")
    y = spark.createDataFrame([(f"i{i}", "T", [1.0, 3.0, 2.0][i // 6] + (i % 2) * 0.1) for i in range(18)], "sample_id string, trait string, y double")
    r = association.dominance(association.diplotype_means(dip, y)).first()
    assert r["a"] == pytest.approx(0.5) and r["d"] == pytest.approx(1.5) and r["d_over_a"] == pytest.approx(3) and r["overdominance"]
    assert association.diplotype_anova(dip, y).first()["p_omnibus"] < 1e-6


def test_epistasis_recovers_planted_pair(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 3, (80, 20)).astype(float)
    info = pd.DataFrame({"SNP": [f"s{i}" for i in range(20)], "CHR": "1", "POS": [1000 + 3000 * i for i in range(20)]})
    g = readers.from_matrix(spark, x, info)
    y = 2 * x[:, 5] + 3 * x[:, 12] + 4 * x[:, 5] * x[:, 12] + rng.normal(size=80)
    p = spark.createDataFrame([(f"ind{i + 1}", "T", float(v)) for i, v in enumerate(y)], "sample_id string, trait string, y double")
    b = spark.createDataFrame([("b", "1", 1, 100000, 20)], BLOCKS)
    top = association.block_epistasis(g, b, p).orderBy("p_wald").first()
    assert (top["snp_i"], top["snp_j"]) == ("s5", "s12") and top["p_bonf"] < 1e-6
    las = association.fine_map(g, ("1", 1, 100000), p, "lasso").where("selected").orderBy(F.desc(F.abs("coef"))).first()
    assert (las["snp_i"], las["snp_j"]) == ("s5", "s12")


def test_decay_curve_and_fits(spark, geno):
    v = ld.variant_major(geno)
    c = decay.bin_curve(decay.sampled_pairs(v, 100_000), 100_000, 10)
    f = decay.fitted_curve(c, 80)
    assert f.count() == c.count() and f.where("r2_hw is null").count() == 0
    y, k = decay.hill_weir(np.array([1e4, 5e4, 1e5, 1e6]), decay.hill_weir(np.array([1e4, 5e4, 1e5, 1e6]), np.zeros(4), 80, np.ones(4))[0], 80, np.ones(4))
    assert np.isfinite(y).all() and k > 0
    # never at or above, never below, and a curve that crosses
    assert decay.decay_distance(c, 2.0).where("not censored").count() == 0 and decay.decay_distance(c, -1.0).where("not censored").count() == 0
    bumpy = spark.createDataFrame([("1", i, 10.0 * i, y) for i, y in enumerate([0.5, 0.3, 0.05, 0.2])] + [("2", i, 10.0 * i, y) for i, y in enumerate([0.5, 0.3, 0.1, 0.0])], "chr string, bin int, dist_bp double, r2_mean double")
    assert {r["chr"]: (r["decay_dist_bp"], r["censored"]) for r in decay.decay_distance(bumpy, 0.15).collect()} == {"1": (20.0, False), "2": (pytest.approx(17.5), False)}


def test_numeric_hapmap_vcf_round_trip(spark, geno, panel, tmp_path):
    x, info = panel
    n = 6
    ids = [f"ind{i + 1}" for i in range(n)]
    cell = lambda v, d: d if np.isnan(v) else str(int(v))
    csv = tmp_path / "g.csv"
    csv.write_text("SNP,CHR,POS,REF,ALT," + ",".join(ids) + "\n" + "".join(",".join([*map(str, info.iloc[j]), *[cell(x[i, j], "NA") for i in range(n)]]) + "\n" for j in range(24)) + "bad,1,2\n")
    want = rows(geno.where(F.col("sample_id").isin(ids)).select("sample_id", "snp", "chr", "pos", "dosage"))
    assert rows(readers.read_genotypes(spark, str(csv), clean=True).select("sample_id", "snp", "chr", "pos", "dosage")) == want
    hmp = tmp_path / "g.hmp.txt"
    two = lambda j, v: "NN" if np.isnan(v) else info["REF"][j] * (2 - int(v)) + info["ALT"][j] * int(v)
    hmp.write_text("\t".join(readers.HAPMAP + ids) + "\n" + "".join("\t".join([info["SNP"][j], f"{info['REF'][j]}/{info['ALT'][j]}", info["CHR"][j], str(info["POS"][j]), *["x"] * 7, *[two(j, x[i, j]) for i in range(n)]]) + "\n" for j in range(24)))
    assert rows(readers.read_genotypes(spark, str(hmp)).select("sample_id", "snp", "chr", "pos", "dosage")) == want
    writers.write_vcf(geno.where(F.col("sample_id").isin(ids)), f"{tmp_path}/out.vcf", ids)
    assert rows(readers.read_vcf(spark, f"{tmp_path}/out.vcf").select("sample_id", "snp", "chr", "pos", "dosage")) == want
    assert readers.clean_rows(spark, str(csv), ",")[1].first()["removed"] == 1


def test_vcf_calls(spark, tmp_path):
    f = tmp_path / "p.vcf"
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\td\te\n"
    f.write_text(head + "chr1\t5\t.\tA\tT\t.\t.\t.\tGT\t0|1:35\t./.\t1/2\t1\t.|1\n")
    got = {r["sample_id"]: (r["snp"], r["dosage"]) for r in readers.read_vcf(spark, str(f)).collect()}
    assert got == {"a": ("1_5", 1), "b": ("1_5", None), "c": ("1_5", 2), "d": ("1_5", 1), "e": ("1_5", None)}
    ph = {r["sample_id"]: (r["a1"], r["a2"]) for r in readers.read_phased_vcf(spark, str(f)).collect()}
    assert ph["a"] == (0, 1) and ph["e"] == (None, None) and ph["c"] == (None, None)


def test_bed(spark, panel, tmp_path):
    x, info = panel
    code = {0: 3, 1: 2, 2: 0}
    raw = b"\x6c\x1b\x01"
    for j in range(24):
        two = [1 if np.isnan(v) else code[int(v)] for v in x[:, j]]
        raw += bytes(sum(two[i + k] << (2 * k) for k in range(4) if i + k < 80) for i in range(0, 80, 4))
    (tmp_path / "g.bed").write_bytes(raw)
    (tmp_path / "g.bim").write_text("".join(f"{info['CHR'][j]} {info['SNP'][j]} 0 {info['POS'][j]} {info['ALT'][j]} {info['REF'][j]}\n" for j in range(24)))
    (tmp_path / "g.fam").write_text("".join(f"F ind{i + 1} 0 0 0 -9\n" for i in range(80)))
    got = {(r["sample_id"], r["snp"]): r["dosage"] for r in readers.read_bed(spark, f"{tmp_path}/g.bed", 7).collect()}
    assert len(got) == 80 * 24 and struct.calcsize("i") == 4
    assert all((got[f"F_ind{i + 1}", f"rs{j}"] is None) if np.isnan(x[i, j]) else got[f"F_ind{i + 1}", f"rs{j}"] == x[i, j] for i in range(80) for j in range(24))


def test_formats_and_errors(spark):
    assert [readers.detect_format(p) for p in ("a.hmp.txt", "b.vcf.gz", "c.bed", "d.csv")] == ["hapmap", "vcf", "bed", "numeric"]
    for bad in ("x.gds", "x.xyz"):
        with pytest.raises(ValueError):
            readers.detect_format(bad)
    with pytest.raises(ValueError):
        readers.normalize_pheno(spark.createDataFrame([("a", 1.0)], "id string, t double"), "nope")


def test_pipeline_and_post_gwas(spark, geno):
    r = pipeline.run(spark, geno, cut=0.1)
    assert r.blocks.count() >= 3 and r.defects.first()["n_repeated"] == 0
    hits = geno.select("snp", "chr", "pos").distinct().withColumn("p", F.when(F.col("snp") == "rs3", 1e-9).otherwise(0.5)).withColumn("beta", F.lit(0.2)).withColumn("trait", F.lit("T"))
    reg = gwas.qtl_regions(hits, r.blocks, geno.select("chr", "pos", "snp").distinct(), 5e-8, 2)
    assert [x["lead_marker"] for x in reg.collect()] == ["rs3"]
    assert gwas.export_bed(reg, 10).first()["start"] >= 0
    eff = geno.select("snp").distinct().withColumn("effect", F.lit(0.1))
    imp = prediction.block_importance(prediction.local_gebv(r.genotypes, r.blocks, eff))
    rank = gwas.rank_blocks(r.diversity, reg, imp)
    assert rank.count() == r.diversity.count()
    assert gwas.integrate(reg, imp, r.diversity).where("priority_score > 3").count() == 0


def test_stream_rates(spark, tmp_path):
    from allelica.streaming.calls import plate_rates

    df = spark.sql("select timestamp'2024-01-01 00:00:00' as called_at, 'p' as plate, gt from values ('0/0'), ('./.'), (null) t(gt)")
    df.write.parquet(f"{tmp_path}/in")
    assert plate_rates(df).first()["n_missing"] == 2
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = plate_rates(s).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select n_calls from rates").first()[0] == 3


def test_haplotypes_of_samples_without_a_row(spark):
    rows_ = [("a", 1, 0), ("a", 3, 2), ("b", 1, 0), ("b", 2, 2), ("c", 1, 0), ("c", 2, 1), ("c", 3, None), ("d", 1, 1), ("d", 2, 1), ("d", 3, 1), ("d", 3, 1), ("e", 2, 2), ("e", 2, 0), ("e", 1, 0)]
    g = spark.createDataFrame([(s, "1", p, f"v{p}", x) for s, p, x in rows_], "sample_id string, chr string, pos int, snp string, dosage int")
    b = spark.createDataFrame([("k", "1", 1, 3)], "block_id string, chr string, start_bp int, end_bp int")
    assert {r["sample_id"]: r["hap"] for r in H.extract(g, b).collect()} == {"a": "0.2", "b": "02.", "c": "01.", "d": "111", "e": "00."}


def _haps(spark, rows_, more=""):
    return spark.createDataFrame([("k", "1", 1, 3, 3, *r) for r in rows_], f"block_id string, chr string, start_bp int, end_bp int, n_snps long, sample_id string, hap string{more}")


def test_rare_alleles_are_pooled_if_rare_in_both(spark):
    rows_ = [(f"s{i}", "000", "x") for i in range(200)] + [("s300", "111", "x")] + [(f"t{i}", "222", "y") for i in range(2)] + [("t9", "000", "y")] + [("u1", "333", "z")]
    h = _haps(spark, rows_, ", grp string")
    r = H.compare_populations(h, "grp", "x", "y", 0.02, permutations=0).first()
    # 222 is under 2 % of all, but not of y; 111 is rare in both
    assert (r["n_alleles"], r["dominant_g2"]) == (3, "222") and abs(r["max_freq_diff"] - 2 / 3) < 1e-9
    few = H.compare_populations(h, "grp", "x", "z", 0.02, permutations=10).first()
    assert (few["n1"], few["n2"], few["fst_simple"], few["divergent"]) == (201, 1, None, False)


def test_tree_collapse(spark):
    def of(counts):
        rows_ = [(f"s{i}_{h}", h) for h, n in counts.items() for i in range(n)]
        return {r["hap"]: r["collapsed"] for r in H.collapse(_haps(spark, rows_), 0.05, "tree_based").collect()}

    # one common allele: all rare ones end at it, also those cut off from its cluster
    assert of({"000000": 50, "000001": 1, "111111": 1}) == {"000000": "000000", "000001": "000000", "111111": "000000"}
    # two: by cluster, or to the nearest
    got = of({"00000000": 40, "11110000": 40, "00000001": 1, "11111111": 1})
    assert got["00000001"] == "00000000" and got["11111111"] == "11110000"


def test_concordance_counts_freedom_and_keeps_blocks(spark):
    cols = "block_id string, trait string, allele string, effect double, se double"
    a = spark.createDataFrame([("k", "t", "0", 1.0, 0.5), ("k", "t", "1", 2.0, 0.5), ("m", "t", "0", 1.0, 0.5), ("n", "t", "0", 1.0, 0.5), ("o", "t", "5", 1.0, 0.1)], cols)
    b = spark.createDataFrame([("k", "t", "0", 1.5, 0.5), ("k", "t", "1", 1.5, 0.5), ("m", "t", "0", 1.0, 0.5), ("p", "t", "0", 1.0, 0.5), ("o", "t", "6", 1.0, 0.1)], cols)
    got = {r["block_id"]: r for r in gwas.compare_effects(a, b).collect()}
    assert set(got) == {"k", "m", "n", "o", "p"}
    assert (got["k"]["q_df"], got["k"]["replicated"]) == (1, True) and abs(got["k"]["q_stat"] - 1.0) < 1e-9 and got["k"]["i2"] == 0
    assert (got["m"]["q_df"], got["m"]["q_p"], got["m"]["replicated"]) == (0, None, False)
    assert [(got[k]["n_alleles_pop1"], got[k]["n_alleles_pop2"], got[k]["n_shared_alleles"], got[k]["q_df"]) for k in "nop"] == [(1, 0, 0, None), (1, 1, 0, None), (0, 1, 0, None)]


def test_dense_cores_leave_first():
    rng = np.random.default_rng(3)
    r2 = (rng.random((40, 40)) < 0.6).astype(float)
    r2 = np.maximum(r2, r2.T)
    pos = np.arange(40) * 100
    full, made = segmentation.bins_of(r2, pos, most=10**6)
    assert made == "density"
    cored, made = segmentation.bins_of(r2, pos, most=20)
    assert made == "density, cores first" and len({v for g in cored for v in g}) == sum(map(len, cored))
    with pytest.raises(ValueError):
        segmentation.bins_of(r2, pos, mode="other")


def test_decay_in_one_call(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 3, (60, 40))
    rows_ = []
    for c in ("1", "2"):
        for j in range(40):
            x = np.where(rng.random(60) < 0.8, base[:, j // 5 * 5], base[:, j])
            rows_ += [(f"s{i}", c, 1000 * (j + 1), f"{c}_{j}", int(x[i])) for i in range(60)]
    v = ld.variant_major(spark.createDataFrame(rows_, "sample_id string, chr string, pos int, snp string, dosage int"))
    d = decay.decay(v, r2_threshold="both", n_pairs=200, max_dist=20_000, n_bins=10, n_unlinked=400)
    assert {r["chr"] for r in d.distance.collect()} == {"1", "2", "GENOME"} and d.critical_r2 >= 0.1
    n = {r["chr"]: r["count"] for r in d.pairs.groupBy("chr").count().collect()}
    assert all(60 <= k <= 200 for k in n.values())
    s = decay.decay(v, sampling="sliding", r2_threshold=None, n_pairs=100, max_dist=20_000, window=10, fit="none")
    assert s.distance is None and s.curve.count() > 0


def test_block_haplotypes_in_one_call(spark):
    rng = np.random.default_rng(8)
    haps_, y = [], {}
    for i in range(60):
        y[f"s{i}"] = float(rng.normal())
        for k in range(6):
            h = str(rng.integers(0, 3)) * 3
            y[f"s{i}"] += 3.0 * (k == 2 and h == "000")
            haps_.append((f"b{k}", str(1 + k // 3), 100 * k, 100 * k + 50, 3, f"s{i}", h))
    haps = spark.createDataFrame(haps_, "block_id string, chr string, start_bp int, end_bp int, n_snps long, sample_id string, hap string")
    pheno = spark.createDataFrame([(s, "t", v) for s, v in y.items()], "sample_id string, trait string, y double")
    for scope in association.SCOPES:
        r = association.test_blocks(haps, pheno, metric="p_simplem_sidak", scope=scope)
        a = r.alleles.toPandas()
        assert len(a) == 18 and ((a["p_simplem_sidak"] <= 0.05) == a["significant"]).all() and (a["p_simplem"] >= a["p_wald"]).all()
        b = r.blocks.toPandas().set_index("block_id")
        assert b["p_omnibus"].idxmin() == "b2" and ((b["p_omnibus_simplem_sidak"] <= 0.05) == b["significant_omnibus"]).all()
        # three alleles of a block sum to one: two tests
        assert (a["meff"] == {"chromosome": 6, "global": 12, "block": 2}[scope]).all() and (b["meff"] == {"chromosome": 3, "global": 6, "block": 1}[scope]).all()
    m = association.test_blocks(haps, pheno, n_pcs=None, pcs_most=2).models.toPandas()
    assert list(m.sort_values("n_pcs")["n_pcs"]) == [0, 1, 2] and m["selected"].sum() == 1 and m["lambda_gc"].notna().all()
    none = association.test_blocks(haps, pheno.limit(5))
    assert none.alleles.count() == 0 and none.blocks.count() == 0 and "p_simplem" in none.alleles.columns
    with pytest.raises(ValueError):
        association.test_blocks(haps, pheno, metric="p")


def test_interactions_match_single_regressions():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (50, 7)).astype(float)
    x[:, 5], x[:, 6] = x[:, 0], 1.0
    y = rng.normal(size=50) + x[:, 1] * x[:, 3]
    got = {(i, j): (e, s) for i, j, e, s, _, _ in association.interaction_scan(x, y)}
    assert not any(6 in k for k in got) and (0, 5) not in got
    for (i, j), (e, s) in got.items():
        a = np.column_stack([np.ones(50), x[:, i], x[:, j], (x[:, i] - x[:, i].mean()) * (x[:, j] - x[:, j].mean())])
        b = np.linalg.lstsq(a, y, rcond=None)[0]
        se = np.sqrt(((y - a @ b) ** 2).sum() / 46 * np.linalg.inv(a.T @ a)[3, 3])
        assert np.allclose((e, s), (b[3], se))
    assert set(got) == {(i, j) for i in range(6) for j in range(i + 1, 6)} - {(0, 5)}


def test_lines_of_another_width(spark, tmp_path):
    (tmp_path / "g.csv").write_text("SNP,CHR,POS,REF,ALT,a,b\nv1,1,5,A,T,0,2\nv2,1,9,A,T,1\n")
    with pytest.raises(Exception, match="another width"):
        readers.read_numeric(spark, str(tmp_path / "g.csv")).collect()
    assert readers.read_numeric(spark, str(tmp_path / "g.csv"), clean=True).count() == 2


def most_rows(df):
    """Rows of the collected ``df``, and the most that any operator of its plan put out."""
    got, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind, m = node.getClass().getSimpleName(), node.metrics().get("numOutputRows")
        most = max(most, m.get().value() if m.isDefined() else 0)
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return got, most


def test_block_ranges_without_pairs(spark, tmp_path):
    """Nested blocks over all variants: 400 x 400 pairs, none of which is formed."""
    from allelica.plans import haplotype_queries

    tile = 1 << 20
    places = [("1", 5000 * i) for i in range(400)] + [("2", 7), ("2", 9), ("2", 5 * tile), (None, 8), ("2", None)]
    snps = spark.createDataFrame([(f"s{i}", c, p, "A", "C") for i, (c, p) in enumerate(places)], "snp string, chr string, pos int, ref_allele string, alt_allele string")
    bounds = [("1", 5000 * i, 5000 * (799 - i)) for i in range(400)] + [("2", 7, 7), ("2", 8, 8), ("2", 9, 7), ("2", 8, 6 * tile), ("2", tile, 4 * tile), ("3", 1, 9), ("2", 10, 5 * tile), (None, 1, 9), ("2", None, 9)]
    blocks = spark.createDataFrame([("panel1", c, s, e, 1) for c, s, e in bounds], "panel string, chr string, start_bp int, end_bp int, n_snps int")
    snps.write.parquet(f"{tmp_path}/snp_info.parquet")
    blocks.write.parquet(f"{tmp_path}/ld_blocks.parquet")
    want = set()
    for c, s, e in bounds:
        inside = [p for k, p in places if None not in (c, k, p, s, e) and k == c and min(s, e) <= p <= max(s, e)]
        if inside:
            want.add((f"block_{c}_{min(s, e)}_{max(s, e)}", min(inside), max(inside), len(inside)))
    df = haplotype_queries.block_snp_ranges(spark, str(tmp_path))
    got, most = most_rows(df)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert 400 <= most < 10_000 and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def crowded(spark, path):
    """300 hits in 300 nested blocks and a few odd rows as tables in ``path``: hits, variants and blocks."""
    snps = [("1", 5000 * i + 5) for i in range(300)] + [("2", p) for p in (7, 9, 11)]
    hits = [("1", 5000 * i + 5, f"s{i % 250}", 0.1 * (i % 7), 1e-9 * (1 + i * 37 % 101), "TraitA" if i % 3 else "TraitB") for i in range(300)]
    hits += [("1", 50_000, None, None, 1e-9, None), ("1", 50_000, "s10", 0.3, 1e-9, "TraitC"), ("1", 50_000, "a", None, 1e-6, "TraitA"), ("2", 20_011, "t", 0.5, 1e-5, None), ("2", 5, None, 0.5, 1e-5, None), ("2", 9, "u", 0.5, 0.5, "TraitA"), ("2", 9, "u", 0.5, None, "TraitA"), (None, 9, "v", 0.5, 1e-9, "TraitA"), ("2", None, "v", 0.5, 1e-9, "TraitA")]
    blocks = [("1", 5000 * i + 5, 5000 * (599 - i)) for i in range(299)] + [("2", 6, 11), ("2", 7, 9), ("2", 5, 11), ("1", 400, 4900), ("3", 1, 9), ("2", None, 9)]
    spark.createDataFrame([(f"s{i}", c, p, "A", "C") for i, (c, p) in enumerate(snps)], "snp string, chr string, pos int, ref_allele string, alt_allele string").write.parquet(f"{path}/snp_info.parquet")
    spark.createDataFrame([("panel1", c, s, e, 1) for c, s, e in blocks], "panel string, chr string, start_bp int, end_bp int, n_snps int").write.parquet(f"{path}/ld_blocks.parquet")
    spark.createDataFrame([(i, m, c, p, b, 0.1, q, t) for i, (c, p, m, b, q, t) in enumerate(hits)], "rec_id int, marker string, chr string, pos int, beta double, se double, p double, trait string").write.parquet(f"{path}/example_gwas.parquet")
    return hits, snps, blocks


def brute_regions(hits, snps, blocks, decay):
    """Per block with hits: chr, bounds, widening, lead, distinct markers in order, traits, by pairs of all."""
    first = lambda x: (x is not None, x)
    out = {}
    for c, s, e in blocks:
        d = (60_000 if c == "1" else 20_000) if decay else 0
        if s is None or sum(k == c and s <= p <= e for k, p in snps) < 3:
            continue
        own = [h for h in hits if None not in (h[0], h[1], h[4]) and h[0] == c and h[4] <= 1e-4 and s - d <= h[1] <= e + d]
        if own:
            lead = min(((p, pos, first(m), first(b)) for _, pos, m, b, p, _ in own))
            marks = sorted({(pos, first(m), first(b)) for _, pos, m, b, _, _ in own})
            out[f"block_{c}_{s}_{e}"] = (c, s, e, d, sum(k == c and s <= p <= e for k, p in snps), lead, [m[1][1] for m in marks], sorted({t for *_, t in own if t is not None}))
    return out


def in_few_rows(df, want):
    got, most = most_rows(df)
    assert len(got) == len(want) and {tuple(r) for r in got} == set(want)
    assert most < 30_000  # 300 x 300 pairs would be 90,000


def test_export_biomart_without_pairs(spark, tmp_path):
    from allelica.plans import io_queries

    x = brute_regions(*crowded(spark, tmp_path), False)
    assert len(x) > 290
    places = Counter(f"{v[0]}:{v[5][1]}:{v[5][1]}" for v in x.values())
    in_few_rows(io_queries.export_biomart(spark, str(tmp_path)).groupBy("region").count(), places.items())


def test_primary_hits_without_pairs(spark, tmp_path):
    from allelica.plans import trait_queries

    groups = {}
    for k, v in brute_regions(*crowded(spark, tmp_path), True).items():
        lo, hi = max(v[5][1] - v[3], 1), v[5][1] + v[3]
        groups.setdefault((v[0], v[5][2][1]), []).append((abs((v[1] + v[2]) / 2 - (lo + hi) / 2), k))
    in_few_rows(trait_queries.qtl_primary_hits(spark, str(tmp_path)), [(k, m, len(g), (a, k) == min(g)) for (_, m), g in groups.items() for a, k in g])


def test_export_bed_without_pairs(spark, tmp_path):
    from allelica.plans import trait_queries

    x = brute_regions(*crowded(spark, tmp_path), True)
    in_few_rows(trait_queries.export_bed(spark, str(tmp_path)), [(f"chr{v[0]}", max(0, max(v[5][1] - v[3], 1) - 501), v[5][1] + v[3] + 500, k, min(1000, int(-math.log10(v[5][0]) * 10 + 0.5)), ".") for k, v in x.items()])


def region_rows(x):
    return [(k, v[1] - v[3], v[2] + v[3], v[4], len({m for m in v[6] if m is not None}), v[5][2][1], v[5][0], max(v[5][1] - v[3], 1), v[5][1] + v[3], v[5][3][1], ";".join(m for m in v[6] if m is not None), ",".join(v[7]) or None, len(v[7]), len(v[7]) > 1) for k, v in x.items()]


def test_regions_decay_without_pairs(spark, tmp_path):
    from allelica.plans import trait_queries

    x = brute_regions(*crowded(spark, tmp_path), True)
    in_few_rows(trait_queries.qtl_regions_decay(spark, str(tmp_path)), region_rows(x))


def test_regions_without_pairs(spark, tmp_path):
    from allelica.plans import trait_queries

    x = brute_regions(*crowded(spark, tmp_path), False)
    in_few_rows(trait_queries.qtl_regions(spark, str(tmp_path)), region_rows(x))


def exchanges(df):
    """Shuffles and broadcasts of the plan, each as often as it is planned, before any is found to be the same as another."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_primary_hits_short_plan(spark, tmp_path):
    from allelica.plans import trait_queries

    crowded(spark, tmp_path)
    assert exchanges(trait_queries.qtl_primary_hits(spark, str(tmp_path))) < 20


def test_export_bed_short_plan(spark, tmp_path):
    from allelica.plans import trait_queries

    crowded(spark, tmp_path)
    assert exchanges(trait_queries.export_bed(spark, str(tmp_path))) < 20


def test_regions_short_plan(spark, tmp_path):
    from allelica.plans import trait_queries

    crowded(spark, tmp_path)
    assert exchanges(trait_queries.qtl_regions(spark, str(tmp_path))) < 20


def test_export_bed_no_sums_of_windows(spark, tmp_path):
    from allelica.plans import trait_queries

    crowded(spark, tmp_path)
    plan = trait_queries.export_bed(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    # a sum over the nodes of a window sorts rows as wide as a block, several a window
    assert "SortAggregate" not in plan and "sig" not in plan
    # the decay table needs no Python workers, which count as the driver's where all is one process
    assert "ExistingRDD" not in trait_queries._decay(spark)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("threshold", [1e-4, None])
def test_lead_regions_as_qtl_regions(spark, threshold):
    rng = np.random.default_rng(5)
    hits = [(f"m{i}", str(rng.integers(1, 4)), int(rng.integers(1, 400)), 0.1, float(rng.choice([0.0, 1e-9, 3e-6, 0.5])), "T") for i in range(300)]
    hits += [("a", "4", 7, 0.1, 1e-6, "T"), ("b", "5", 7, None, 1e-6, None), ("c", "5", 9, 0.1, 1e-6, "T"), ("d", None, 9, 0.1, 1e-6, "T"), ("e", "1", None, 0.1, 1e-6, "T"), ("f", "1", 9, 0.1, None, "T")]
    bounds = [(c, *sorted(rng.integers(1, 420, 2).tolist())) for c in "12345" for _ in range(60)]
    g = spark.createDataFrame(hits, "snp string, chr string, pos int, beta double, p double, trait string")
    b = spark.createDataFrame([(f"b{i}", c, s, e) for i, (c, s, e) in enumerate(bounds)] + [("b0", *bounds[0])], "block_id string, chr string, start_bp int, end_bp int")
    v = spark.createDataFrame([(f"s{i}", c, i) for c in "12345" for i in range(1, 420, 3)], "snp string, chr string, pos int")
    d = spark.createDataFrame([("1", 30.0), ("1", 30.0), ("2", 5.0), ("GENOME", 1.0)], "chr string, decay_dist_bp double")
    for decay in (None, d):
        got = gwas.lead_regions(g, b, v, threshold, 3, decay)
        want = gwas.qtl_regions(g, b, v, threshold, 3, decay).select(*got.columns)
        assert got.dtypes == want.dtypes and rows(got) == rows(want) and len(rows(got)) > 150
