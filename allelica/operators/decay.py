"""Decay of r2 with distance: binned curve, LOESS and Hill-Weir fits, decay distance, unlinked threshold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelica.functions.keys import materialize
from allelica.operators.ld import cross_r2, pair_r2, whitened
from allelica.operators.relational import running_sum


def sampled_pairs(variants: DataFrame, max_dist: int, n_pairs: int | None = None, seed: int = 42) -> DataFrame:
    """chr, dist_bp, r2 of pairs up to ``max_dist`` apart; with ``n_pairs`` about as many per chromosome, drawn by hash.

    The draw comes before the computation: variants of a chromosome are thinned so that about four times as many pairs are
    left as are wanted (the pairs are counted from the variants per stretch of ``max_dist``), only these meet, and of their
    pairs ``n_pairs`` are kept. A chromosome with fewer pairs gives all."""
    if n_pairs is None:
        return pair_r2(variants, max_dist).select("chr", "dist_bp", "r2")
    n = variants.groupBy("chr", F.floor(F.col("pos") / max_dist).alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    # a variant meets those of its own stretch and half of those of the next and the last
    own = n.groupBy("chr").agg(F.sum(F.col("_n") * F.col("_n") / 2).alias("_own"))
    nxt = n.select(F.col("chr").alias("_c"), (F.col("_b") - 1).alias("_b2"), F.col("_n").alias("_n2"))
    side = n.join(nxt, F.expr("chr = _c and _b = _b2")).groupBy(F.col("chr").alias("_c")).agg(F.sum(F.col("_n") * F.col("_n2") / 2).alias("_side"))
    keep = own.join(side, F.expr("chr = _c"), "left").select(F.col("chr").alias("_c"), F.sqrt(F.lit(4.0 * n_pairs) / (F.col("_own") + F.coalesce("_side", F.lit(0.0)))).alias("_share"))
    thin = variants.join(keep, F.expr("chr = _c")).where(F.pmod(F.xxhash64("snp", "pos", F.lit(seed)), F.lit(1_000_000)) < F.col("_share") * 1_000_000).select(*variants.columns)
    d = pair_r2(thin, max_dist)
    w = W.partitionBy("chr").orderBy(F.xxhash64("snp_i", "snp_j", F.lit(seed)), "snp_i", "snp_j")
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_pairs).select("chr", "dist_bp", "r2")


def sliding_pairs(variants: DataFrame, window: int = 50, stride: int | None = None) -> DataFrame:
    """Pairs inside windows of ``window`` consecutive variants that start every ``stride`` variants."""
    from allelica.operators.ld import matrix, r2_matrix

    stride = max(window, stride or window)
    r = running_sum(variants, "chr", "pos", ["pos", "snp"], F.lit(1), "_i").withColumn("_i", F.col("_i") - 1)
    r = r.withColumn("_w", F.floor(F.col("_i") / stride)).where(F.col("_i") % stride < window)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        x, _ = matrix(pdf["sample_ids"].tolist(), pdf["dosages"].tolist())
        m, pos = r2_matrix(x), pdf["pos"].to_numpy()
        i, j = np.triu_indices(len(pos), 1)
        return pd.DataFrame({"chr": pdf["chr"].iloc[0], "dist_bp": pos[j] - pos[i], "r2": m[i, j]})

    return r.groupBy("chr", "_w").applyInPandas(run, "chr string, dist_bp int, r2 double")


def bin_curve(pairs: DataFrame, max_dist: int, n_bins: int = 100) -> DataFrame:
    """chr, bin, dist_bp (middle), r2_mean, r2_median, n_pairs: equal-width bins, the last closed."""
    width = max_dist / n_bins
    b = F.least(F.floor(F.col("dist_bp") / width), F.lit(n_bins - 1)).cast("int")
    d = pairs.where(F.col("dist_bp") <= max_dist).groupBy("chr", b.alias("bin")).agg(F.avg("r2").alias("r2_mean"), F.median("r2").alias("r2_median"), F.count(F.lit(1)).alias("n_pairs"))
    return d.withColumn("dist_bp", (F.col("bin") + 0.5) * width)


def loess(x: np.ndarray, y: np.ndarray, w: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Local quadratic fit with tricube weights over the nearest ``span`` of the points."""
    k, out = max(4, int(np.ceil(span * len(x)))), np.empty(len(x))
    for i, x0 in enumerate(x):
        d = np.abs(x - x0)
        h = np.sort(d)[min(k, len(x)) - 1] or 1.0
        u = np.clip(1 - (d / (h * 1.0001)) ** 3, 0, None) ** 3 * w
        s = np.sqrt(u)
        a = np.stack([np.ones_like(x), x - x0, (x - x0) ** 2], 1) * s[:, None]
        out[i] = np.linalg.lstsq(a, y * s, rcond=None)[0][0]
    return out


def hill_weir_at(c: float, x: np.ndarray, n: int) -> np.ndarray:
    rho = c * x / 1e6
    return (10 + rho) / ((2 + rho) * (11 + rho)) + 1 / n


def hill_weir(x: np.ndarray, y: np.ndarray, n: int, w: np.ndarray) -> tuple[np.ndarray, float]:
    """E[r2] = (10 + rho) / ((2 + rho)(11 + rho)) + 1/n with rho = C x (Mb): the C of least squares, by golden section on log C."""
    f = lambda c: hill_weir_at(c, x, n)
    lo, hi, g = -8.0, 16.0, (5**0.5 - 1) / 2
    err = lambda t: float((w * (y - f(np.exp(t))) ** 2).sum())
    grid = np.linspace(lo, hi, 49)
    t = grid[int(np.argmin([err(v) for v in grid]))]
    lo, hi = t - 0.5, t + 0.5
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if err(a) < err(b) else (a, hi)
    c = float(np.exp((lo + hi) / 2))
    return f(c), c


def fitted_curve(curve: DataFrame, n_samples: int, pairs: DataFrame | None = None, grain: int = 10_000) -> DataFrame:
    """The curve with r2_loess (from five bins on) and r2_hw, neither below 0. With ``pairs`` Hill-Weir is fitted to these (10
    or more, of positive distance), as sums per ``grain``-th of the largest distance, whose least squares differ from the
    single pairs' by a constant; otherwise to the bins' means. A chromosome's curve has at most n_bins rows."""
    if pairs is not None:
        top = pairs.agg(F.max("dist_bp").alias("_top"))
        fine = pairs.where("dist_bp > 0").join(F.broadcast(top)).groupBy("chr", F.floor(F.col("dist_bp") * grain / (F.col("_top") + 1)).alias("_g"))
        fine = fine.agg(F.avg("dist_bp").alias("x"), F.avg("r2").alias("y"), F.count(F.lit(1)).alias("w")).groupBy(F.col("chr").alias("_c")).agg(F.collect_list(F.struct("x", "y", "w")).alias("_fine"))
        curve = curve.join(fine, F.col("chr") == F.col("_c"), "left").drop("_c")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        x, y, w = pdf["dist_bp"].to_numpy(float), pdf["r2_mean"].to_numpy(float), pdf["n_pairs"].to_numpy(float)
        out = pdf.drop(columns=["_fine"], errors="ignore")
        out["r2_loess"] = np.maximum(0, loess(x, y, np.ones_like(w))) if len(x) >= 5 else np.nan
        out["r2_hw"] = np.nan
        fine = pdf["_fine"].iloc[0] if "_fine" in pdf else [{"x": a, "y": b, "w": c} for a, b, c in zip(x, y, w)]
        if fine is not None and sum(f["w"] for f in fine) >= 10:
            c = hill_weir(*(np.array([f[k] for f in fine], float) for k in "xy"), n_samples, np.array([f["w"] for f in fine], float))[1]
            out["r2_hw"] = np.maximum(0, hill_weir_at(c, x, n_samples))
        return out

    fields = [f for f in curve.schema.fields if f.name != "_fine"]
    out = curve.groupBy("chr").applyInPandas(run, T.StructType([*fields, T.StructField("r2_loess", T.DoubleType()), T.StructField("r2_hw", T.DoubleType())]))
    return out.withColumn("r2_loess", F.when(~F.isnan("r2_loess"), F.col("r2_loess"))).withColumn("r2_hw", F.when(~F.isnan("r2_hw"), F.col("r2_hw")))


def decay_distance(curve: DataFrame, threshold: float, col: str = "r2_mean") -> DataFrame:
    """chr, decay_dist_bp, censored: where the curve falls below the threshold. If all bins at or above it lie before the
    first one below, by linear interpolation between the last of those and that one, otherwise that bin's distance; the
    last bin's (censored) if the curve is never below or never at or above it."""
    y, at = F.col(col), F.struct("bin", "dist_bp", F.col(col).alias("y"))
    d = curve.groupBy("chr").agg(F.min(F.when(y < threshold, at)).alias("b"), F.max(F.when(y >= threshold, at)).alias("a"), F.max("dist_bp").alias("_end"))
    cross = F.col("a.dist_bp") + (threshold - F.col("a.y")) * (F.col("b.dist_bp") - F.col("a.dist_bp")) / (F.col("b.y") - F.col("a.y"))
    censored = F.col("a").isNull() | F.col("b").isNull()
    return d.select("chr", F.when(censored, F.col("_end")).when(F.col("a.bin") < F.col("b.bin"), cross).otherwise(F.col("b.dist_bp")).alias("decay_dist_bp"), censored.alias("censored"))


def unlinked_threshold(variants: DataFrame, pctile: float = 95.0, n_unlinked: int = 50_000) -> DataFrame:
    """One row: critical_r2, the percentile of r2 between chromosomes, and n_pairs."""
    return cross_r2(variants, n_unlinked).agg(F.percentile("r2", F.lit(pctile / 100)).alias("critical_r2"), F.count(F.lit(1)).alias("n_pairs"))


@dataclass(frozen=True)
class Decay:
    pairs: DataFrame
    curve: DataFrame
    critical_r2: float | None
    distance: DataFrame | None


def decay(
    variants: DataFrame, sampling: str = "random", r2_threshold: str | float | None = 0.1, n_pairs: int = 50_000, max_dist: int = 5_000_000, window: int = 50, n_bins: int = 100, fit: str = "both",
    pctile: float = 95.0, n_unlinked: int = 50_000, method: str = "r2", seed: int = 42,
) -> Decay:
    """Decay of a panel in one call.

    ``sampling``: random pairs, or sliding windows of ``window`` variants whose stride gives about ``n_pairs`` pairs a
    chromosome. ``r2_threshold``: a number, ``percentile`` (of unlinked pairs), ``both`` (the larger of .1 and the
    percentile) or None for no distance. ``method``: r2, or rV2 of whitened variants. The distance is read off the LOESS
    curve, without one off the fitted, else the mean (``fit``: loess, nonlinear, both, none); the row GENOME has the median.
    """
    if method == "rV2":
        variants = materialize(whitened(variants), "whitened")
    elif method != "r2":
        raise ValueError(f"unknown method: {method}")
    if sampling == "random":
        pairs = sampled_pairs(variants, max_dist, n_pairs, seed)
    elif sampling == "sliding":
        most = variants.groupBy("chr").count().agg(F.max("count")).first()[0] or 0
        pairs = sliding_pairs(variants, window, max(window, int(most * window * (window - 1) / 2 // max(1, n_pairs)))).where(F.col("dist_bp") <= max_dist)
    else:
        raise ValueError(f"unknown sampling: {sampling}")
    pairs = materialize(pairs, "pairs")
    curve = bin_curve(pairs, max_dist, n_bins)
    if fit != "none":
        n = variants.agg(F.max(F.size("dosages"))).first()[0] or 1
        curve = materialize(fitted_curve(curve, n, pairs), "curve")
    critical = None if r2_threshold is None else r2_threshold if isinstance(r2_threshold, (int, float)) else None
    if r2_threshold in ("percentile", "both"):
        got = unlinked_threshold(variants, pctile, n_unlinked).first()["critical_r2"]
        critical = max(0.1, got or 0.0) if r2_threshold == "both" else got
    if critical is None:
        return Decay(pairs, curve, None, None)
    y = {"loess": F.coalesce("r2_loess", "r2_mean"), "nonlinear": F.coalesce("r2_hw", "r2_mean"), "both": F.coalesce("r2_loess", "r2_hw", "r2_mean")} if fit != "none" else {"none": F.col("r2_mean")}
    dist = decay_distance(curve.withColumn("_y", y[fit]), float(critical), "_y")
    whole = dist.agg(F.lit("GENOME").alias("chr"), F.median("decay_dist_bp").alias("decay_dist_bp"), F.lit(False).alias("censored"))
    return Decay(pairs, curve, float(critical), dist.unionByName(whole))
