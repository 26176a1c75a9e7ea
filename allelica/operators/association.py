"""Association of block alleles with traits, diplotype effects, multiple testing, and interactions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from allelica.functions.distributions import f_upper, p_f, p_t, q_norm, t_two_sided
from allelica.functions.keys import materialize
from allelica.operators.prediction import reml, square
from allelica.operators.relational import bh_adjust, range_join, running_sum


def wald_scan(features: DataFrame, pheno: DataFrame, pvalues: bool = True) -> DataFrame:
    """trait, hap_id, n, allele_freq_tested, effect, se, t_stat, df (and p_wald): single-allele regression from sums.

    Missing doses take the allele's mean among the tested samples of the trait; alleles whose sum of squares is at most
    1e-10 are left out. The scan is one aggregation.
    """
    y = pheno.where("y is not null").groupBy("trait", "sample_id").agg(F.avg("y").alias("y"))
    d = features.join(y, "sample_id")
    # mean-imputed doses leave the sums of observed ones: x - mean is 0 where missing
    g = d.groupBy("trait", "block_id", "hap_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dose").alias("mx"), F.sum(F.col("dose") * F.col("dose")).alias("sxx"), F.sum("dose").alias("sx"), F.count("dose").alias("nx"), F.sum(F.col("dose") * F.col("y")).alias("sxy"), F.sum(F.when(F.col("dose").isNotNull(), F.col("y"))).alias("syx"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    ss = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    xx = F.col("sxx") - F.col("sx") * F.col("mx")
    xy = F.col("sxy") - F.col("mx") * F.col("syx")
    g = g.withColumn("_xx", xx).where("_xx > 1e-10 and n > 2").withColumn("effect", xy / F.col("_xx"))
    rss = F.greatest(ss - F.col("effect") * F.col("effect") * F.col("_xx"), F.lit(0.0))
    g = g.withColumn("df", F.col("n") - 2).withColumn("se", F.sqrt(rss / F.col("df") / F.col("_xx"))).withColumn("t_stat", F.try_divide("effect", "se"))
    out = g.select("trait", "block_id", "hap_id", "n", (F.col("mx") / 2).alias("allele_freq_tested"), "effect", "se", "t_stat", "df")
    return out.withColumn("p_wald", p_t(F.col("t_stat"), F.col("df"))) if pvalues else out


NULL_MODEL = "trait string, n_pcs int, sample_id string, y double, bic double, h2 double"


def null_models(pheno: DataFrame, grm: DataFrame, n_pcs: list[int], bend: float = 1e-3) -> DataFrame:
    """trait, n_pcs, sample_id, y, bic, h2: phenotypes minus fixed effects and polygenic values of the null mixed model with
    as many leading eigenvectors as covariates. Traits with fewer than 10 samples more than covariates are left out."""
    k, ids = square(grm)
    k = k + bend * np.eye(len(k))
    shared = grm.sparkSession.sparkContext.broadcast((k, ids, np.linalg.eigh(k)[1][:, ::-1][:, : max(n_pcs)].copy()))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, ids, pcs = shared.value
        m, y = int(pdf["n_pcs"].iloc[0]), pdf.groupby("sample_id")["y"].mean().reindex(ids).to_numpy(float)
        seen = np.isfinite(y)
        n = int(seen.sum())
        if n < 10 + m:
            return pd.DataFrame(columns=[c.split()[0] for c in NULL_MODEL.split(", ")])
        x = np.column_stack([np.ones(n), pcs[seen, :m]])
        f = reml(y[seen], k[np.ix_(seen, seen)], x)
        bic = -2 * f["ll"] + (m + 3) * np.log(n)
        return pd.DataFrame({"trait": pdf["trait"].iloc[0], "n_pcs": m, "sample_id": np.array(ids)[seen], "y": y[seen] - x @ f["beta"] - f["u"], "bic": bic, "h2": f["h2"]})

    d = pheno.where("y is not null").select("trait", "sample_id", "y", F.explode(F.array(*[F.lit(m) for m in n_pcs])).alias("n_pcs"))
    return d.groupBy("trait", "n_pcs").applyInPandas(run, NULL_MODEL)


def residuals(pheno: DataFrame, grm: DataFrame, n_pcs: int = 0, bend: float = 1e-3) -> DataFrame:
    """trait, sample_id, y: residuals of the null mixed model (``n_pcs`` leading eigenvectors as covariates; -1: as many as
    the BIC of 0..10 favours)."""
    d = null_models(pheno, grm, list(range(11)) if n_pcs < 0 else [n_pcs], bend)
    if n_pcs < 0:
        d = materialize(d, "models")
        best = d.groupBy(F.col("trait").alias("_t")).agg(F.min(F.struct("bic", "n_pcs"))["n_pcs"].alias("_k"))
        d = d.join(F.broadcast(best), F.expr("trait = _t and n_pcs = _k"))
    return d.select("trait", "sample_id", "y")


def model_table(models: DataFrame, features: DataFrame, method: str = "bic_lambda") -> DataFrame:
    """trait, n_pcs, bic, h2, lambda_gc, score, selected of ``null_models``: inflation from a scan of all alleles, and the
    score by ``method`` (bic; lambda: distance of the inflation from 1; bic_lambda: that and a hundredth of the scaled BIC).
    The least score is selected, ties go to fewer covariates."""
    one = models.groupBy("trait", "n_pcs").agg(F.max("bic").alias("bic"), F.max("h2").alias("h2"))
    key = F.concat_ws("\x1f", "trait", F.col("n_pcs").cast("string"))
    scan = wald_scan(features, models.select(key.alias("trait"), "sample_id", "y"))
    chi = F.pow(q_norm(F.col("p_wald") / 2), F.lit(2))
    lam = scan.groupBy(F.col("trait").alias("_key")).agg((F.median(chi) / 0.4549364231195724).alias("lambda_gc"))
    d = one.join(lam, key == F.col("_key"), "left").drop("_key")
    w = W.partitionBy("trait")
    low, high, off = F.min("bic").over(w), F.max("bic").over(w), F.abs(F.col("lambda_gc") - 1)
    score = {"bic": F.col("bic"), "lambda": off, "bic_lambda": off + 0.01 * (F.col("bic") - low) / (high - low + 1e-10)}[method]
    d = d.withColumn("score", score)
    return d.withColumn("selected", F.row_number().over(w.orderBy(F.col("score").asc_nulls_last(), "n_pcs")) == 1)


def pc_selection(pheno: DataFrame, grm: DataFrame, most: int = 10) -> DataFrame:
    """trait, n_pcs, bic, h2, selected (least BIC) for 0..most leading eigenvectors as covariates."""
    d = null_models(pheno, grm, list(range(most + 1))).groupBy("trait", "n_pcs").agg(F.max("bic").alias("bic"), F.max("h2").alias("h2"))
    return d.withColumn("selected", F.col("bic") == F.min("bic").over(W.partitionBy("trait")))


def _pivot(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Samples x alleles with means for missing doses, y, and the alleles; columns without variance are left out."""
    w = pdf.pivot_table(index="sample_id", columns="hap_id", values="dose", aggfunc="first", dropna=False).sort_index(axis=1)
    x = w.to_numpy(float)
    x = np.where(np.isfinite(x), x, np.nanmean(x, 0))
    y = pdf.groupby("sample_id")["y"].first().reindex(w.index).to_numpy(float) if "y" in pdf else np.zeros(len(w))
    keep = x.var(0) > 1e-10
    return x[:, keep], y, [c for c, k in zip(w.columns, keep) if k]


def block_tests(features: DataFrame, pheno: DataFrame) -> DataFrame:
    """trait, block_id, n_alleles_tested, f_stat, df1, df2, p_omnibus, var_explained, status: all alleles of a block at once.

    One allele is dropped where they are collinear. Status is ok, skipped_no_alleles or insufficient_df.
    """
    y = pheno.where("y is not null").groupBy("trait", "sample_id").agg(F.avg("y").alias("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, names = _pivot(pdf)
        head = (pdf["trait"].iloc[0], pdf["block_id"].iloc[0])
        if not names:
            row = (*head, 0, None, None, None, None, None, "skipped_no_alleles")
        else:
            a = np.column_stack([np.ones(len(x)), x])
            beta, _, rank, _ = np.linalg.lstsq(a, y, rcond=None)
            sse, sst = ((y - a @ beta) ** 2).sum(), ((y - y.mean()) ** 2).sum()
            df1, df2 = int(rank) - 1, len(y) - int(rank)
            if df1 < 1 or df2 < 1 or sst <= 0:
                row = (*head, len(names), None, None, None, None, None, "insufficient_df")
            else:
                f = float(((sst - sse) / df1) / max(sse / df2, 1e-300))
                row = (*head, len(names), f, df1, df2, float(f_upper(np.array([f]), df1, df2)[0]), float(1 - sse / sst), "ok")
        return pd.DataFrame([row], columns=["trait", "block_id", "n_alleles_tested", "f_stat", "df1", "df2", "p_omnibus", "var_explained", "status"])

    d = features.join(y, "sample_id")
    return d.groupBy("trait", "block_id").applyInPandas(run, "trait string, block_id string, n_alleles_tested int, f_stat double, df1 int, df2 int, p_omnibus double, var_explained double, status string")


def effective_tests(features: DataFrame, by: str = "block_id", cut: float = 0.995, most: int = 1000) -> DataFrame:
    """``by`` and meff: eigenvalues of the alleles' correlation that make up ``cut`` of the total, in chunks of ``most``."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, _, names = _pivot(pdf)
        n = 0
        for s in range(0, len(names), most):
            part = x[:, s : s + most]
            val = np.sort(np.abs(np.linalg.eigvalsh(np.atleast_2d(np.corrcoef(part, rowvar=False)))))[::-1]
            n += int(np.searchsorted(np.cumsum(val) / val.sum(), cut - 1e-12) + 1)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "meff": [max(1, n)]})

    return features.groupBy(by).applyInPandas(run, f"{by} string, meff int")


SCOPES = ("chromosome", "global", "block")
METRICS = ("p_wald", "p_fdr", "p_simplem", "p_simplem_sidak")


def scoped_meff(features: DataFrame, places: DataFrame, scope: str, cut: float = 0.995, most: int = 1000) -> DataFrame:
    """trait, scope_id, meff: effective tests of the columns (trait, sample_id, hap_id, dose) of a scope. ``places`` has each
    column's hap_id, block_id, chr and start_bp. Scopes are cut into chunks of ``most`` columns in order of their place, each
    one task, and the chunks' numbers are added up."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope: {scope}")
    p = running_sum(places.select("hap_id", "block_id", "chr", "start_bp").distinct(), "chr", "start_bp", ["start_bp", "hap_id"], F.lit(1), "_rank")
    if scope == "global":
        n = p.groupBy(F.col("chr").alias("_c")).agg(F.max("_rank").alias("_n"))
        # one row a chromosome
        n = n.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        p = p.join(F.broadcast(n), F.expr("chr = _c")).withColumn("_rank", F.col("_rank") + F.col("_before")).withColumn("scope_id", F.lit("all"))
    else:
        p = p.withColumn("scope_id", F.col("chr" if scope == "chromosome" else "block_id"))
    p = p.select(F.col("hap_id").alias("_h"), "scope_id", F.floor((F.col("_rank") - 1) / most).alias("_chunk"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, _, names = _pivot(pdf.drop(columns=["y"], errors="ignore"))
        n = 0
        if names:
            r = np.nan_to_num(np.atleast_2d(np.corrcoef(x, rowvar=False)))
            np.fill_diagonal(r, 1.0)
            val = np.sort(np.abs(np.linalg.eigvalsh(r)))[::-1]
            n = int(np.searchsorted(np.cumsum(val) / val.sum(), cut - 1e-12) + 1)
        return pd.DataFrame({"trait": [pdf["trait"].iloc[0]], "scope_id": [pdf["scope_id"].iloc[0]], "meff": [n]})

    d = features.join(p, F.col("hap_id") == F.col("_h")).select("trait", "scope_id", "_chunk", "sample_id", "hap_id", F.col("dose").cast("double").alias("dose"))
    d = d.groupBy("trait", "scope_id", "_chunk").applyInPandas(run, "trait string, scope_id string, meff int")
    return d.groupBy("trait", "scope_id").agg(F.greatest(F.sum("meff"), F.lit(1)).cast("int").alias("meff"))


def block_scores(features: DataFrame) -> DataFrame:
    """trait, sample_id, hap_id (the block's id), dose: first principal component of a block's alleles (trait, block_id,
    sample_id, hap_id, dose); the allele itself where there is one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf.pivot_table(index="sample_id", columns="hap_id", values="dose", aggfunc="first", dropna=False).sort_index(axis=1)
        x = w.to_numpy(float)
        if x.shape[1] > 1:
            x = np.nan_to_num(x - np.nanmean(x, 0))
            x = x @ np.linalg.svd(x, full_matrices=False)[2][:1].T
        return pd.DataFrame({"trait": pdf["trait"].iloc[0], "sample_id": w.index, "hap_id": pdf["block_id"].iloc[0], "dose": x[:, 0]})

    d = features.select("trait", "block_id", "sample_id", "hap_id", F.col("dose").cast("double").alias("dose"))
    return d.groupBy("trait", "block_id").applyInPandas(run, "trait string, sample_id string, hap_id string, dose double")


def _levels(tests: DataFrame, meff: DataFrame, key: str, p: str, out: str, alpha: float) -> DataFrame:
    """Adds meff, the level and the p-values by it (Bonferroni and Sidak), and the FDR over all tests."""
    d = bh_adjust(materialize(tests, "tests"), p, f"{out}fdr")
    d = d.join(meff.select(F.col("trait").alias("_t"), F.col("scope_id").alias("_s"), "meff"), F.expr(f"trait = _t and {key} = _s"), "left").drop("_t", "_s", key).withColumn("meff", F.coalesce("meff", F.lit(1)))
    d = d.withColumn("alpha_simplem", alpha / F.col("meff")).withColumn("alpha_simplem_sidak", 1 - F.pow(F.lit(1 - alpha), 1 / F.col("meff")))
    return d.withColumn(f"{out}simplem", F.least(F.lit(1.0), F.col(p) * F.col("meff"))).withColumn(f"{out}simplem_sidak", 1 - F.pow(1 - F.col(p), F.col("meff")))


@dataclass(frozen=True)
class BlockTests:
    alleles: DataFrame
    blocks: DataFrame
    models: DataFrame


def test_blocks(
    haps: DataFrame, pheno: DataFrame, n_pcs: int | None = 0, top_n: int | None = None, min_freq: float = 0.05, alpha: float = 0.05, metric: str = "p_wald", scope: str = "chromosome", cut: float = 0.995,
    most: int = 1000, pcs_most: int = 10, select_by: str = "bic_lambda", phased: bool = False,
) -> BlockTests:
    """Association of block haplotypes with traits in one call.

    alleles: every allele's regression on the residuals of the null mixed model (haplotype relationship, ``n_pcs`` leading
    eigenvectors; None searches 0..``pcs_most`` per trait by ``select_by``) with p_wald, p_fdr, meff, alpha_simplem(_sidak),
    p_simplem, p_simplem_sidak and ``significant``: the p-value named by ``metric`` is at most ``alpha``. blocks: the same for
    the joint test of a block's alleles (p_omnibus...). models: the search's table. Effective tests are counted per
    ``scope`` among the samples with the trait; at block scope a block's joint test is one. Without alleles or phenotypes
    (10 samples at least) all tables are empty with their columns.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    from allelica.operators import haplotypes as H

    kept = materialize(H.alleles(haps, min_freq, top_n), "kept")
    feats = materialize(H.features(haps, kept), "features")
    grm = materialize(H.relationship(feats, phased, bend=True), "grm")
    models = materialize(null_models(pheno, grm, [n_pcs] if n_pcs is not None else list(range(pcs_most + 1))), "models")
    table = materialize(model_table(models, feats, select_by), "model_table")
    best = table.where("selected").select(F.col("trait").alias("_t"), F.col("n_pcs").alias("_k"))
    resid = models.join(F.broadcast(best), F.expr("trait = _t and n_pcs = _k")).select("trait", "sample_id", "y")
    places = kept.select("hap_id", "block_id", "chr", "start_bp", "end_bp", F.col("hap").alias("allele"), F.col("freq").alias("allele_freq"))
    x = feats.join(resid.select("trait", "sample_id"), "sample_id")
    key = {"chromosome": F.col("chr"), "global": F.lit("all"), "block": F.col("block_id")}[scope]

    a = wald_scan(feats, resid).drop("block_id").join(places, "hap_id").withColumn("_key", key)
    a = _levels(a, scoped_meff(x, places, scope, cut, most), "_key", "p_wald", "p_", alpha).withColumn("significant", F.coalesce(F.col(metric) <= alpha, F.lit(False)))
    where = places.select("block_id", "chr", "start_bp", "end_bp").distinct()
    b = block_tests(feats, resid).join(where, "block_id").withColumn("_key", key)
    if scope == "block":
        n = b.select("trait", F.col("block_id").alias("scope_id"), F.lit(1).alias("meff"))
    else:
        n = scoped_meff(block_scores(x), where.select(F.col("block_id").alias("hap_id"), "block_id", "chr", "start_bp"), scope, cut, most)
    b = _levels(b, n, "_key", "p_omnibus", "p_omnibus_", alpha)
    b = b.withColumn("significant_omnibus", F.coalesce(F.col("p_omnibus" if metric == "p_wald" else metric.replace("p_", "p_omnibus_", 1)) <= alpha, F.lit(False)))
    return BlockTests(a, b, table)


test_blocks.__test__ = False  # not a test case


def adjusted(tests: DataFrame, meff: DataFrame, p: str = "p_wald", alpha: float = 0.05) -> DataFrame:
    """Adds p_fdr (over all tests), p_bonf (per trait), meff, p_simplem = p meff, p_simplem_sidak = 1 - (1 - p)^meff, significant."""
    # ranking reads the tests several times
    d = bh_adjust(materialize(tests, "tests"), p, "p_fdr").withColumn("_n", F.count(p).over(W.partitionBy("trait")))
    total = meff.agg(F.sum("meff").alias("meff"))
    d = d.join(F.broadcast(total))
    d = d.withColumn("p_bonf", F.least(F.lit(1.0), F.col(p) * F.col("_n"))).withColumn("p_simplem", F.least(F.lit(1.0), F.col(p) * F.col("meff"))).withColumn("p_simplem_sidak", 1 - F.pow(1 - F.col(p), F.col("meff")))
    return d.withColumn("significant", F.coalesce(F.col("p_fdr") <= alpha, F.lit(False))).drop("_n")


def diplotype_means(dips: DataFrame, pheno: DataFrame, min_n: int = 3) -> DataFrame:
    """block_id, trait, hap1, hap2, diplotype, n, n_total, mean_blue, se_mean of diplotypes with at least ``min_n`` samples."""
    y = pheno.where("y is not null").groupBy("trait", F.col("sample_id").alias("id")).agg(F.avg("y").alias("y"))
    d = dips.where("diplotype is not null").join(y, "id")
    g = d.groupBy("block_id", "trait", "hap1", "hap2", "diplotype").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_blue"), (F.stddev_samp("y") / F.sqrt(F.count(F.lit(1)))).alias("se_mean"))
    g = g.withColumn("n_total", F.sum("n").over(W.partitionBy("block_id", "trait")))
    return g.where(F.col("n") >= min_n)


def dominance(means: DataFrame) -> DataFrame:
    """block_id, trait, allele_a, allele_b, mean_aa, mean_ab, mean_bb, a, d, d_over_a (null if |a| <= 1e-10), overdominance."""
    hom = means.where("hap1 = hap2").select("block_id", "trait", "hap1", "mean_blue")
    het = means.where("hap1 <> hap2").select("block_id", "trait", F.col("hap1").alias("allele_a"), F.col("hap2").alias("allele_b"), F.col("mean_blue").alias("mean_ab"))
    aa = hom.withColumnRenamed("hap1", "allele_a").withColumnRenamed("mean_blue", "mean_aa")
    bb = hom.withColumnRenamed("hap1", "allele_b").withColumnRenamed("mean_blue", "mean_bb")
    d = het.join(aa, ["block_id", "trait", "allele_a"]).join(bb, ["block_id", "trait", "allele_b"])
    d = d.withColumn("a", (F.col("mean_bb") - F.col("mean_aa")) / 2).withColumn("d", F.col("mean_ab") - (F.col("mean_aa") + F.col("mean_bb")) / 2)
    d = d.withColumn("d_over_a", F.when(F.abs("a") > 1e-10, F.col("d") / F.col("a")))
    return d.withColumn("overdominance", F.coalesce(F.abs("d_over_a") > 1, F.lit(False))).select("block_id", "trait", "allele_a", "allele_b", "mean_aa", "mean_ab", "mean_bb", "a", "d", "d_over_a", "overdominance")


def diplotype_anova(dips: DataFrame, pheno: DataFrame, min_n: int = 3, pvalues: bool = True) -> DataFrame:
    """block_id, trait, n_diplotypes, f_stat, df1, df2 (and p_omnibus, p_fdr per trait): one-way analysis from group sums."""
    m = _anova_groups(dips, pheno, min_n)
    g = m.groupBy("block_id", "trait").agg(F.count(F.lit(1)).alias("n_diplotypes"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    g = g.withColumn("df1", F.col("n_diplotypes") - 1).withColumn("df2", F.col("n") - F.col("n_diplotypes")).where("df1 > 0 and df2 > 0")
    f = F.try_divide((F.col("between") - F.col("s") * F.col("s") / F.col("n")) / F.col("df1"), (F.col("ss") - F.col("between")) / F.col("df2"))
    g = g.select("block_id", "trait", "n_diplotypes", f.alias("f_stat"), "df1", "df2")
    if not pvalues:
        return g
    return bh_adjust(materialize(g.withColumn("p_omnibus", p_f(F.col("f_stat"), F.col("df1"), F.col("df2"))), "tests"), "p_omnibus", "p_omnibus_fdr", ["trait"])


def _anova_groups(dips: DataFrame, pheno: DataFrame, min_n: int) -> DataFrame:
    y = pheno.where("y is not null").groupBy("trait", F.col("sample_id").alias("id")).agg(F.avg("y").alias("y"))
    return dips.where("diplotype is not null").join(y, "id").groupBy("block_id", "trait", "diplotype").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss")).where(F.col("n") >= min_n)


def interaction_scan(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, float, float, float, float]]:
    """(i, j, effect, se, t, p) of the product term of each column pair in y ~ 1 + xi + xj + xi xj (centred product). The
    normal equations of one column with all later ones are solved as a stack."""
    n, p, out = len(y), x.shape[1], []
    if n <= 4 or p < 2:
        return out
    c, yc = x - x.mean(0), y - y.mean()
    var = x.var(0)
    for i in range(p - 1):
        js = np.flatnonzero((var >= 1e-10) & (np.arange(p) > i))
        if var[i] < 1e-10 or not len(js):
            continue
        z = c[:, [i]] * c[:, js]
        js, z = js[z.var(0) >= 1e-10], z[:, z.var(0) >= 1e-10]
        # all columns centred: the constant drops out of the equations
        zc, m = z - z.mean(0), len(js)
        ci, cj = c[:, i], c[:, js]
        q, r = np.empty((m, 3, 3)), np.empty((m, 3))
        q[:, 0, 0], q[:, 1, 1], q[:, 2, 2] = ci @ ci, (cj * cj).sum(0), (zc * zc).sum(0)
        q[:, 0, 1] = q[:, 1, 0] = ci @ cj
        q[:, 0, 2] = q[:, 2, 0] = ci @ zc
        q[:, 1, 2] = q[:, 2, 1] = (cj * zc).sum(0)
        r[:, 0], r[:, 1], r[:, 2] = ci @ yc, cj.T @ yc, zc.T @ yc
        ok = np.linalg.cond(q) <= 1e12 if m else np.zeros(0, bool)
        if not ok.any():
            continue
        js, q, r = js[ok], q[ok], r[ok]
        inv = np.linalg.inv(q)
        b = np.einsum("mij,mj->mi", inv, r)
        s2 = np.maximum(yc @ yc - (b * r).sum(1), 0) / (n - 4)
        se = np.sqrt(np.maximum(s2 * inv[:, 2, 2], 0))
        good = se > 0
        t = b[good, 2] / se[good]
        pv = t_two_sided(t, n - 4) if len(t) else t
        out += [(i, int(j), float(e), float(s), float(v), float(w)) for j, e, s, v, w in zip(js[good], b[good, 2], se[good], t, pv)]
    return out


EPISTASIS = "block_id string, trait string, snp_i string, snp_j string, pos_i int, pos_j int, dist_bp int, aa_effect double, se double, t_stat double, p_wald double, meff int, p_bonf double, p_simplem double"


def block_epistasis(geno: DataFrame, blocks: DataFrame, pheno: DataFrame, maf: float = 0.05, most: int | None = None, seed: int = 42) -> DataFrame:
    """Interactions of variant pairs within each block, with Bonferroni, effective-test and FDR values per block and trait.

    Variants below ``maf`` are left out. With ``most`` a block with more variants has that many drawn by hash; without it all
    pairs are tested. One task handles one block and trait.
    """
    snps = geno.groupBy("chr", "pos", "snp").agg((F.avg("dosage") / 2).alias("f")).where(F.least(F.col("f"), 1 - F.col("f")) >= maf).drop("f")
    b = range_join(snps, blocks.select("block_id", "chr", "start_bp", "end_bp"))
    if most is not None:
        b = b.withColumn("_r", F.row_number().over(W.partitionBy("block_id").orderBy(F.xxhash64("snp", F.lit(seed)), "snp"))).where(F.col("_r") <= most)
    b = b.select("block_id", F.col("snp").alias("_s"), F.col("chr").alias("_c"))
    y = pheno.where("y is not null").groupBy("trait", "sample_id").agg(F.avg("y").alias("y"))
    d = geno.join(b, (F.col("snp") == F.col("_s")) & (F.col("chr") == F.col("_c"))).join(y, "sample_id").select("block_id", "trait", "sample_id", "pos", "snp", "dosage", "y")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf[["pos", "snp"]].drop_duplicates().sort_values(["pos", "snp"])
        w = pdf.pivot_table(index="sample_id", columns="snp", values="dosage", aggfunc="first", dropna=False)[names["snp"]]
        x = w.to_numpy(float)
        x = np.where(np.isfinite(x), x, np.nanmean(x, 0))
        y = pdf.groupby("sample_id")["y"].first().reindex(w.index).to_numpy(float)
        got = interaction_scan(x, y)
        pos, snp = names["pos"].to_numpy(), names["snp"].to_numpy()
        c = x - x.mean(0)
        z = np.stack([c[:, g[0]] * c[:, g[1]] for g in got], 1) if got else np.zeros((len(y), 0))
        meff = 0
        for s in range(0, z.shape[1], 1000):
            val = np.sort(np.abs(np.linalg.eigvalsh(np.atleast_2d(np.corrcoef(z[:, s : s + 1000], rowvar=False)))))[::-1]
            meff += int(np.searchsorted(np.cumsum(val) / val.sum(), 0.995 - 1e-12) + 1)
        head = (pdf["block_id"].iloc[0], pdf["trait"].iloc[0])
        rows = [(*head, snp[i], snp[j], int(pos[i]), int(pos[j]), int(pos[j] - pos[i]), e, se, t, p, meff, min(1.0, p * len(got)), min(1.0, p * meff)) for i, j, e, se, t, p in got]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in EPISTASIS.split(", ")])

    out = d.groupBy("block_id", "trait").applyInPandas(run, EPISTASIS)
    return bh_adjust(materialize(out, "pairs"), "p_wald", "p_fdr", ["block_id", "trait"])


def block_by_block(features: DataFrame, pheno: DataFrame, query: DataFrame) -> DataFrame:
    """Interactions of query alleles (hap_id) with the alleles of all other blocks: block_i, allele_i, block_j, allele_j,
    trait, aa_effect, se, t_stat, p_wald. The stated queries are a set of checked size (at most 1000), sent to all tasks."""
    ids = [r[0] for r in query.select("hap_id").distinct().limit(1001).collect()]
    if len(ids) > 1000:
        raise ValueError("more than 1000 query alleles; run them in blocks")
    y = pheno.where("y is not null").groupBy("trait", "sample_id").agg(F.avg("y").alias("y"))
    q = features.where(F.col("hap_id").isin(ids)).select("sample_id", F.struct(F.col("block_id").alias("b"), F.col("hap_id").alias("h"), F.col("dose").cast("double").alias("x")).alias("q"))
    qs = q.groupBy("sample_id").agg(F.collect_list("q").alias("qs"))
    d = features.join(y, "sample_id").join(qs, "sample_id").groupBy("trait", "block_id", "hap_id").agg(F.collect_list(F.struct("sample_id", F.col("dose").cast("double").alias("x"), "y", "qs")).alias("rows"))

    def run(batches):
        for pdf in batches:
            out = []
            for trait, block, hap, rows in zip(pdf["trait"], pdf["block_id"], pdf["hap_id"], pdf["rows"]):
                xj = np.array([np.nan if r["x"] is None else r["x"] for r in rows], float)
                yy = np.array([r["y"] for r in rows], float)
                per: dict = {}
                for i, r in enumerate(rows):
                    for e in r["qs"]:
                        if e["b"] != block:
                            per.setdefault((e["b"], e["h"]), np.full(len(rows), np.nan))[i] = np.nan if e["x"] is None else e["x"]
                for (b, h), xi in sorted(per.items()):
                    both = np.stack([xi, xj], 1)
                    both = np.where(np.isfinite(both), both, np.nanmean(both, 0))
                    for _, _, eff, se, t, p in interaction_scan(both, yy):
                        out.append((b, h, block, hap, trait, eff, se, t, p))
            yield pd.DataFrame(out, columns=["block_i", "allele_i", "block_j", "allele_j", "trait", "aa_effect", "se", "t_stat", "p_wald"])

    r = d.mapInPandas(run, "block_i string, allele_i string, block_j string, allele_j string, trait string, aa_effect double, se double, t_stat double, p_wald double")
    r = bh_adjust(materialize(r, "pairs"), "p_wald", "p_fdr", ["trait"]).withColumn("_n", F.count("p_wald").over(W.partitionBy("trait")))
    return r.withColumn("p_bonf", F.least(F.lit(1.0), F.col("p_wald") * F.col("_n"))).drop("_n")


def lasso(x: np.ndarray, y: np.ndarray, folds: int = 5, n_lambda: int = 40, seed: int = 42) -> np.ndarray:
    """Coefficients at the largest penalty within one standard error of the best in cross-validation (coordinate descent)."""
    def path(x: np.ndarray, y: np.ndarray, lams: np.ndarray) -> np.ndarray:
        xx, b, r, out = (x**2).mean(0), np.zeros(x.shape[1]), y.copy(), []
        for lam in lams:
            for _ in range(200):
                move = 0.0
                for j in range(x.shape[1]):
                    if xx[j] == 0:
                        continue
                    rho = (x[:, j] @ r) / len(y) + xx[j] * b[j]
                    new = np.sign(rho) * max(abs(rho) - lam, 0) / xx[j]
                    if new != b[j]:
                        r += x[:, j] * (b[j] - new)
                        move = max(move, abs(new - b[j]))
                        b[j] = new
                if move < 1e-6:
                    break
            out.append(b.copy())
        return np.array(out)

    mu, sd = x.mean(0), x.std(0)
    z = np.where(sd > 1e-10, (x - mu) / np.where(sd > 1e-10, sd, 1), 0)
    c = y - y.mean()
    top = np.abs(z.T @ c).max() / len(y)
    if top <= 0:
        return np.zeros(x.shape[1])
    lams = top * np.logspace(0, -2.5, n_lambda)
    fold = np.random.default_rng(seed).permutation(len(y)) % folds
    err = np.array([[((c[fold == k] - z[fold == k] @ b) ** 2).mean() for b in path(z[fold != k], c[fold != k], lams)] for k in range(folds)])
    m, se = err.mean(0), err.std(0, ddof=1) / np.sqrt(folds)
    best = int(m.argmin())
    pick = int(np.flatnonzero(m <= m[best] + se[best])[0])
    return np.where(sd > 1e-10, path(z, c, lams[: pick + 1])[-1] / np.where(sd > 1e-10, sd, 1), 0)


def fine_map(geno: DataFrame, block: tuple[str, int, int], resid: DataFrame, method: str = "auto", limit: int = 200) -> DataFrame:
    """Interactions in one block (chr, start, end) on residuals (sample_id, y): all pairs up to ``limit`` variants, beyond
    it (or with method lasso) a LASSO on variants and products. Columns snp_i, snp_j, pos_i, pos_j, dist_bp, coef, p_wald, selected."""
    d = geno.where((F.col("chr") == block[0]) & F.col("pos").between(block[1], block[2])).join(resid.select("sample_id", "y"), "sample_id").select("sample_id", "pos", "snp", "dosage", "y")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf[["pos", "snp"]].drop_duplicates().sort_values(["pos", "snp"])
        w = pdf.pivot_table(index="sample_id", columns="snp", values="dosage", aggfunc="first", dropna=False)[names["snp"]]
        x = w.to_numpy(float)
        x = np.where(np.isfinite(x), x, np.nanmean(x, 0))
        y = pdf.groupby("sample_id")["y"].first().reindex(w.index).to_numpy(float)
        pos, snp = names["pos"].to_numpy(), names["snp"].to_numpy()
        if method == "pairwise" or method == "auto" and len(snp) <= limit:
            rows = [(snp[i], snp[j], int(pos[i]), int(pos[j]), int(pos[j] - pos[i]), e, p, p <= 0.05) for i, j, e, _, _, p in interaction_scan(x, y)]
        else:
            c = x - x.mean(0)
            i, j = np.triu_indices(len(snp), 1)
            coef = lasso(np.column_stack([x, c[:, i] * c[:, j]]), y)[len(snp) :]
            rows = [(snp[a], snp[b], int(pos[a]), int(pos[b]), int(pos[b] - pos[a]), float(v), None, v != 0) for a, b, v in zip(i, j, coef)]
        return pd.DataFrame(rows, columns=["snp_i", "snp_j", "pos_i", "pos_j", "dist_bp", "coef", "p_wald", "selected"])

    return d.groupBy(F.lit(1).alias("one")).applyInPandas(lambda p: run(p), "snp_i string, snp_j string, pos_i int, pos_j int, dist_bp int, coef double, p_wald double, selected boolean")


def qq_table(tests: DataFrame, p: str = "p_wald") -> DataFrame:
    """trait, expected and observed -log10 p, and lambda_gc (median chi-square over its expectation): data of a QQ plot."""
    w = W.partitionBy("trait").orderBy(p)
    n = F.count(F.lit(1)).over(W.partitionBy("trait"))
    d = tests.where(F.col(p).isNotNull()).withColumn("_i", F.row_number().over(w)).withColumn("expected", -F.log10(F.col("_i") / (n + 1))).withColumn("observed", -F.log10(F.greatest(F.col(p), F.lit(1e-300))))
    m = tests.groupBy(F.col("trait").alias("_t")).agg((F.median(F.col("t_stat") * F.col("t_stat")) / 0.4549364231195724).alias("lambda_gc"))
    return d.join(F.broadcast(m), F.col("trait") == F.col("_t")).select("trait", "hap_id", "expected", "observed", "lambda_gc")
