"""Genomic prediction: mixed model by restricted likelihood, marker effects, block values, cross-validation, stability.

The n x n part of a mixed model is solved in one task per trait (n samples, bounded by ``SAMPLES_MAX``); everything that
grows with variants or haplotypes is aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from allelica.functions.distributions import t_two_sided
from allelica.operators.relational import range_join

SAMPLES_MAX = 20_000


def reml(y: np.ndarray, k: np.ndarray, x: np.ndarray | None = None) -> dict:
    """y = X beta + u + e, u ~ N(0, s K): restricted likelihood maximised over the ratio of variances by a grid and golden
    section on the eigenvalues of SKS. Returns beta, u, h2, ll, lam (error over genetic variance)."""
    n = len(y)
    x = np.ones((n, 1)) if x is None else x
    q, _ = np.linalg.qr(x)
    s = np.eye(n) - q @ q.T
    off = np.sqrt(n)
    val, vec = np.linalg.eigh(s @ (k + off * np.eye(n)) @ s)
    keep = np.argsort(val)[::-1][: n - x.shape[1]]
    theta, u = val[keep] - off, vec[:, keep]
    omega = (u.T @ y) ** 2
    df = n - x.shape[1]

    def nll(t: float) -> float:
        lam = np.exp(t)
        d = np.maximum(theta, 0) + lam
        return 0.5 * (df * np.log((omega / d).sum()) + np.log(d).sum())

    grid = np.linspace(-12, 12, 61)
    t = grid[int(np.argmin([nll(v) for v in grid]))]
    lo, hi, g = t - 0.5, t + 0.5, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if nll(a) < nll(b) else (a, hi)
    lam = float(np.exp((lo + hi) / 2))
    h = k + lam * np.eye(n)
    hx = np.linalg.solve(h, np.column_stack([x, y]))
    beta = np.linalg.solve(x.T @ hx[:, :-1], x.T @ hx[:, -1])
    blup = k @ np.linalg.solve(h, y - x @ beta)
    return {"beta": beta, "u": blup, "h2": 1 / (1 + lam), "ll": -nll((lo + hi) / 2), "lam": lam}


def square(grm: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Dense symmetric matrix and sample order of a relationship table (sample_i <= sample_j, g)."""
    t = grm.toArrow()
    i, j = (t.column(c).combine_chunks().cast(pa.string()) for c in ("sample_i", "sample_j"))
    names = pa.array(sorted(set(pc.unique(i).to_pylist()) | set(pc.unique(j).to_pylist())), pa.string())
    if len(names) > SAMPLES_MAX:
        raise ValueError(f"{len(names)} samples; a mixed model takes {SAMPLES_MAX}")
    a, b = (np.asarray(pc.index_in(v, value_set=names), dtype="int64") for v in (i, j))
    m = np.zeros((len(names), len(names)))
    m[a, b] = m[b, a] = np.asarray(t.column("g"), dtype=float)
    ids = names.to_pylist()
    return m, ids


def gblup(grm: DataFrame, pheno: DataFrame, bend: float = 1e-3) -> DataFrame:
    """trait, sample_id, gebv, observed: values of all samples of the relationship, those without phenotype predicted."""
    k, ids = square(grm)
    k = k + bend * np.eye(len(k))
    shared = grm.sparkSession.sparkContext.broadcast((k, ids))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, ids = shared.value
        y = pdf.groupby("sample_id")["y"].mean().reindex(ids).to_numpy(float)
        seen = np.isfinite(y)
        if seen.sum() < 10:
            return pd.DataFrame(columns=["trait", "sample_id", "gebv", "observed"])
        fit = reml(y[seen], k[np.ix_(seen, seen)])
        h = k[np.ix_(seen, seen)] + fit["lam"] * np.eye(seen.sum())
        u = k[:, seen] @ np.linalg.solve(h, y[seen] - fit["beta"][0])
        return pd.DataFrame({"trait": pdf["trait"].iloc[0], "sample_id": ids, "gebv": u, "observed": seen})

    return pheno.where("y is not null").groupBy("trait").applyInPandas(run, "trait string, sample_id string, gebv double, observed boolean")


def training_sizes(grm: DataFrame, pheno: DataFrame) -> DataFrame:
    """trait, n_train, n_predict: samples of the relationship with and without a phenotype."""
    ids = grm.select(F.col("sample_i").alias("sample_id")).unionByName(grm.select(F.col("sample_j").alias("sample_id"))).distinct()
    y = pheno.where("y is not null").select("trait", "sample_id").distinct()
    n = ids.agg(F.count(F.lit(1)).alias("_n"))
    return y.join(ids, "sample_id").groupBy("trait").agg(F.count(F.lit(1)).alias("n_train")).join(F.broadcast(n)).select("trait", "n_train", (F.col("_n") - F.col("n_train")).alias("n_predict"))


def cross_validate(grm: DataFrame, pheno: DataFrame, k: int = 5, n_rep: int = 1, seed: int = 42, bend: float = 1e-3) -> DataFrame:
    """trait, rep, fold, n_train, n_test, pa (correlation of predicted and observed), rmse. Folds by hashed rank."""
    g, ids = square(grm)
    g = g + bend * np.eye(len(g))
    shared = grm.sparkSession.sparkContext.broadcast((g, ids))
    p = pheno.where(F.col("y").isNotNull() & F.col("sample_id").isin(ids) if len(ids) <= 500 else F.col("y").isNotNull()).groupBy("trait", "sample_id").agg(F.avg("y").alias("y"))
    reps = p.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_rep)))).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, ids = shared.value
        rep, fold = int(pdf["rep"].iloc[0]), int(pdf["fold"].iloc[0])
        y = pdf.set_index("sample_id")["y"].reindex(ids).to_numpy(float)
        seen = np.flatnonzero(np.isfinite(y))
        which = np.empty(len(seen), int)
        which[np.random.default_rng(seed * 1000 + rep).permutation(len(seen))] = np.arange(len(seen)) % k + 1
        test, train = seen[which == fold], seen[which != fold]
        if len(test) < 2 or len(train) < 5:
            return pd.DataFrame(columns=["trait", "rep", "fold", "n_train", "n_test", "pa", "rmse"])
        fit = reml(y[train], g[np.ix_(train, train)])
        h = g[np.ix_(train, train)] + fit["lam"] * np.eye(len(train))
        pred = fit["beta"][0] + g[np.ix_(test, train)] @ np.linalg.solve(h, y[train] - fit["beta"][0])
        sd = pred.std() * y[test].std()
        pa = float(((pred - pred.mean()) * (y[test] - y[test].mean())).mean() / sd) if sd > 0 else None
        return pd.DataFrame({"trait": [pdf["trait"].iloc[0]], "rep": [rep], "fold": [fold], "n_train": [len(train)], "n_test": [len(test)], "pa": [pa], "rmse": [float(np.sqrt(((pred - y[test]) ** 2).mean()))]})

    return reps.groupBy("trait", "rep", "fold").applyInPandas(run, "trait string, rep int, fold int, n_train int, n_test int, pa double, rmse double")


def cv_means(cv: DataFrame) -> DataFrame:
    return cv.groupBy("trait").agg(F.avg("pa").alias("pa"), F.avg("rmse").alias("rmse"), F.stddev_samp("pa").alias("pa_sd"), F.stddev_samp("rmse").alias("rmse_sd"))


def backsolve(geno: DataFrame, gebv: DataFrame, grm: DataFrame) -> DataFrame:
    """snp, effect: M'(G + 1e-6 I)^-1 u / (2 sum p(1-p)) from values of samples; the sum over samples is an aggregation."""
    k, ids = square(grm)
    vals = {r["sample_id"]: r["gebv"] for r in gebv.select("sample_id", "gebv").collect()}
    w = np.linalg.solve(k + 1e-6 * np.eye(len(k)), np.array([vals.get(s, 0.0) for s in ids]))
    wt = geno.sparkSession.createDataFrame([(s, float(v)) for s, v in zip(ids, w)], "sample_id string, _w double")
    st = geno.groupBy("snp").agg((F.avg("dosage") / 2).alias("_p")).withColumn("_p", F.least(F.greatest("_p", F.lit(1e-8)), F.lit(1 - 1e-8)))
    denom = st.agg((2 * F.sum(F.col("_p") * (1 - F.col("_p")))).alias("_d"))
    d = geno.join(st, "snp").join(F.broadcast(wt), "sample_id")
    z = F.coalesce(F.col("dosage").cast("double"), 2 * F.col("_p")) - 2 * F.col("_p")
    return d.groupBy("snp").agg(F.sum(z * F.col("_w")).alias("_s")).join(F.broadcast(denom)).select("snp", (F.col("_s") / F.col("_d")).alias("effect"))


def local_gebv(geno: DataFrame, blocks: DataFrame, effects: DataFrame) -> DataFrame:
    """block_id, chr, start_bp, end_bp, n_snps, sample_id, local_gebv = sum of (dosage - 1) effect over the block's variants.

    A missing dosage adds nothing; variants without an effect are left out.
    """
    snps = geno.select("chr", "pos", "snp").distinct().join(effects.select("snp", "effect"), "snp")
    b = range_join(snps, blocks.select("block_id", "chr", "start_bp", "end_bp"))
    b = b.withColumn("n_snps", F.count(F.lit(1)).over(W.partitionBy("block_id"))).withColumnRenamed("snp", "_s").withColumnRenamed("chr", "_c").withColumnRenamed("pos", "_p")
    d = geno.join(b, (geno["snp"] == b["_s"]) & (geno["chr"] == b["_c"]) & (geno["pos"] == b["_p"]))
    return d.groupBy("block_id", F.col("_c").alias("chr"), "start_bp", "end_bp", "n_snps", "sample_id").agg(F.coalesce(F.sum((F.col("dosage") - 1) * F.col("effect")), F.lit(0.0)).alias("local_gebv"))


def block_importance(local: DataFrame, least: float = 0.9) -> DataFrame:
    """Variance of local values per block, scaled by the largest; important from ``least`` on."""
    v = local.groupBy("block_id", "chr", "start_bp", "end_bp", "n_snps").agg(F.var_samp("local_gebv").alias("var_local_gebv"))
    most = v.agg(F.max("var_local_gebv").alias("_m"))
    return v.join(F.broadcast(most)).withColumn("var_scaled", F.try_divide("var_local_gebv", "_m")).withColumn("important", F.coalesce(F.col("var_scaled") >= least, F.lit(False))).drop("_m")


def importance_over_traits(per_trait: DataFrame, rule: str = "any") -> DataFrame:
    """block_id, var_scaled_mean, n_traits_important, important_any, important_all, important from rows per trait and block."""
    d = per_trait.groupBy("block_id").agg(F.avg("var_scaled").alias("var_scaled_mean"), F.sum(F.col("important").cast("int")).alias("n_traits_important"), F.count(F.lit(1)).alias("_n"))
    any_, all_ = F.col("n_traits_important") > 0, F.col("n_traits_important") == F.col("_n")
    pick = {"any": any_, "all": all_, "mean": F.col("var_scaled_mean") >= 0.9}[rule]
    return d.withColumn("important_any", any_).withColumn("important_all", all_).withColumn("important", pick).drop("_n")


def stability(local: DataFrame, pheno_env: DataFrame) -> DataFrame:
    """Finlay-Wilkinson regression per block: each environment's mean of local values of its samples on the environment's
    mean phenotype: b, b_se, r2_fw, s2d, p_b1, stable.

    ``local`` has env, block_id, sample_id, local_gebv. Two environments leave no error: b_se, p_b1 and stable are null.
    """
    env = pheno_env.groupBy("env").agg(F.avg("y").alias("x"))
    m = local.groupBy("block_id", "env").agg(F.avg("local_gebv").alias("y")).join(env, "env")
    g = m.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    g = g.where("sxx / (n - 1) >= 1e-10")
    sse = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    g = g.withColumn("s2d", F.when(F.col("n") > 2, sse / (F.col("n") - 2))).withColumn("r2_fw", F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy"))).withColumn("b_se", F.sqrt(F.col("s2d") / F.col("sxx")))

    @F.pandas_udf("double")
    def p(b: pd.Series, se: pd.Series, n: pd.Series) -> pd.Series:
        ok = se.notna() & (se > 0)
        out = pd.Series(np.nan, index=b.index)
        if ok.any():
            out[ok] = t_two_sided((b[ok] - 1) / se[ok], n[ok] - 2)
        return out

    g = g.withColumn("p_b1", p("b", "b_se", "n")).withColumn("p_b1", F.when(~F.isnan("p_b1"), F.col("p_b1")))
    return g.select("block_id", "n", "b", "b_se", "r2_fw", "s2d", "p_b1", (F.col("p_b1") >= 0.05).alias("stable"))


def allele_effects(kept: DataFrame, snps: DataFrame, effects: DataFrame) -> DataFrame:
    """Effect of each allele: sum of dosage times variant effect over its string, with effect_rank (1: largest, ties to
    nine decimals share the least). Alleles whose length differs from the block's variants with an effect are dropped."""
    v = range_join(snps.select("chr", "pos", "snp").join(effects.select("snp", "effect"), "snp"), kept.select("block_id", "chr", "start_bp", "end_bp").distinct())
    v = v.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("pos", "snp", "effect"))).alias("_v"))
    d = kept.join(v, "block_id").where(F.length("hap") == F.size("_v"))
    total = F.aggregate(F.zip_with(F.split("hap", ""), F.col("_v"), lambda c, x: F.coalesce(F.try_to_number(c, F.lit("9")).cast("double"), F.lit(0.0)) * x["effect"]), F.lit(0.0), lambda a, x: a + x)
    d = d.withColumn("allele_effect", total)
    return d.select("block_id", "chr", "start_bp", "end_bp", F.col("hap").alias("allele"), F.col("freq").alias("frequency"), "allele_effect", F.size("_v").alias("n_snps_block"), F.rank().over(W.partitionBy("block_id").orderBy(F.desc(F.round("allele_effect", 9) + 0.0))).alias("effect_rank"))


def stacking(haps: DataFrame, effects: DataFrame, normalize: bool = True) -> DataFrame:
    """id, stacking_index, n_blocks_scored, mean_block_score, rank: sum over blocks of the effects of a sample's alleles
    (an unknown allele adds 0), min-max scaled to 0..1. Ties in rank go by id."""
    e = effects.select("block_id", F.col("allele").alias("hap"), "allele_effect")
    d = haps.where(~F.contains("hap", F.lit("."))).join(e, ["block_id", "hap"], "left")
    s = d.groupBy("sample_id", "block_id").agg(F.sum(F.coalesce("allele_effect", F.lit(0.0))).alias("score"))
    t = s.groupBy(F.col("sample_id").alias("id")).agg(F.sum("score").alias("_t"), F.count(F.lit(1)).alias("n_blocks_scored"), F.avg("score").alias("mean_block_score"))
    if normalize:
        m = t.agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
        t = t.join(F.broadcast(m)).withColumn("stacking_index", F.coalesce(F.try_divide(F.col("_t") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)))
    else:
        t = t.withColumn("stacking_index", F.col("_t"))
    return t.select("id", "stacking_index", "n_blocks_scored", "mean_block_score", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("_t"), "id")).alias("rank"))


def stacking_scores(haps: DataFrame, effects: DataFrame, block_ids: list[str]) -> DataFrame:
    """id and one column score_<block> per named block: the wide form of the block scores behind ``stacking``."""
    e = effects.select("block_id", F.col("allele").alias("hap"), "allele_effect")
    d = haps.where(~F.contains("hap", F.lit("."))).join(e, ["block_id", "hap"], "left")
    w = d.groupBy(F.col("sample_id").alias("id")).pivot("block_id", block_ids).agg(F.sum(F.coalesce("allele_effect", F.lit(0.0))))
    return w.select("id", *[F.col(f"`{b}`").alias(f"score_{b}") for b in block_ids])


def parent_inventory(haps: DataFrame, candidates: DataFrame, kept: DataFrame, effects: DataFrame | None = None) -> DataFrame:
    """id, block columns, allele, dosage, allele_freq, allele_effect, is_rare (freq < .10) for every candidate (``id``),
    block and common allele; dosage is null where the candidate's haplotype is incomplete."""
    h = haps.join(candidates.select(F.col("id").alias("sample_id")).distinct(), "sample_id", "left_semi")
    per = h.groupBy("block_id", "chr", "start_bp", "end_bp", "sample_id").agg(F.collect_list("hap").alias("_h"), F.max(F.contains("hap", F.lit("."))).alias("_m"))
    a = kept.groupBy("block_id").agg(F.collect_list(F.struct("hap", "freq")).alias("_a"))
    d = per.join(a, "block_id").select("block_id", "chr", "start_bp", "end_bp", F.col("sample_id").alias("id"), "_h", "_m", F.explode("_a").alias("a"))
    d = d.select("id", "block_id", "chr", "start_bp", "end_bp", F.col("a.hap").alias("allele"), F.when(~F.col("_m"), F.size(F.filter("_h", lambda x: x == F.col("a.hap")))).alias("dosage"), F.col("a.freq").alias("allele_freq"), (F.col("a.freq") < 0.1).alias("is_rare"))
    if effects is not None:
        return d.join(effects.select("block_id", "allele", "allele_effect"), ["block_id", "allele"], "left")
    return d.withColumn("allele_effect", F.lit(None).cast("double"))
