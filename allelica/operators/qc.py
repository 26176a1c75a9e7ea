"""Call rate, imputation by group statistics, allele frequency and variance filters on long genotypes.

Input: sample_id, snp, chr, pos, dosage (0, 1, 2, null). Every statistic is one map-side combined aggregation per variant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.functions.keys import require_columns

KEY = ["chr", "pos", "snp"]


def variant_stats(geno: DataFrame) -> DataFrame:
    """Per variant: n_samples, n_obs, n0, n1, n2, call_rate, freq (of the counted allele), maf, polymorphic.

    Without any call freq and maf are null and polymorphic is false.
    """
    require_columns(geno, *KEY, "dosage")
    d = geno.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_samples"), F.count("dosage").alias("n_obs"), *[F.count_if(F.col("dosage") == i).alias(f"n{i}") for i in range(3)], F.sum("dosage").alias("_s"), F.min("dosage").alias("_lo"), F.max("dosage").alias("_hi"))
    freq = F.try_divide(F.col("_s"), 2 * F.col("n_obs"))
    return d.select(*KEY, "n_samples", "n_obs", "n0", "n1", "n2", (F.col("n_obs") / F.col("n_samples")).alias("call_rate"), freq.alias("freq"), F.when(freq.isNotNull(), F.least(freq, 1 - freq)).alias("maf"), F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)).alias("polymorphic"))


def maf_filter(geno: DataFrame, cut: float = 0.05) -> DataFrame:
    """Statistics of the variants kept: polymorphic with maf >= cut."""
    return variant_stats(geno).where(F.col("polymorphic") & (F.col("maf") >= cut))


def fill_values(stats: DataFrame, method: str) -> DataFrame:
    """snp keys with ``fill``: floor(mean + 0.5) within 0..2, or the unique commonest dosage (``mode``; ties: the mean rule).

    A variant without calls has fill 0.
    """
    mean = F.least(F.greatest(F.floor((F.col("n1") + 2 * F.col("n2")) / F.greatest(F.col("n_obs"), F.lit(1)) + 0.5), F.lit(0)), F.lit(2))
    if method == "mode":
        a, b, c = F.col("n0"), F.col("n1"), F.col("n2")
        fill = F.when((a > b) & (a > c), 0).when((b > a) & (b > c), 1).when((c > a) & (c > b), 2).otherwise(mean)
    elif method == "mean_rounded":
        fill = mean
    else:
        raise ValueError(f"unknown imputation method: {method}")
    return stats.select(*KEY, fill.cast("int").alias("fill"))


def impute(geno: DataFrame, min_callrate: float = 0.0, method: str = "mean_rounded") -> DataFrame:
    """Genotypes of variants with call_rate >= min_callrate, nulls filled; ``imputed`` marks them.

    ``method`` none raises if a kept variant has nulls. Every sample of a variant is filled alike.
    """
    stats = variant_stats(geno).where(F.col("call_rate") >= min_callrate)
    if method == "none":
        if not stats.where("n_obs < n_samples").isEmpty():
            raise ValueError("missing genotypes and imputation switched off")
        fill = stats.select(*KEY, F.lit(0).alias("fill"))
    else:
        fill = fill_values(stats, method)
    fill = fill.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("fill").alias("_fill"))
    d = geno.join(fill, F.expr(" and ".join(f"{k} <=> _{k}" for k in KEY)))
    return d.select(*[c for c in geno.columns if c != "dosage"], F.coalesce("dosage", "_fill").cast("int").alias("dosage"), F.col("dosage").isNull().alias("imputed"))


def sample_stats(geno: DataFrame) -> DataFrame:
    """Per sample: n_snps, n_obs, heterozygosity."""
    return geno.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_snps"), F.count("dosage").alias("n_obs"), F.try_divide(F.count_if(F.col("dosage") == 1), F.count("dosage")).alias("heterozygosity"))


def check_haplotypes(features: DataFrame, info: DataFrame) -> DataFrame:
    """Counts of defects in a feature table (hap_id, sample_id, dose) and its allele table: null doses, repeated hap ids,
    features without allele, alleles without feature. One row."""
    a = features.agg(F.count_if(F.col("dose").isNull()).alias("n_null"))
    b = info.groupBy("hap_id").count().agg(F.count_if(F.col("count") > 1).alias("n_repeated"))
    ids = features.select("hap_id").distinct()
    c = ids.join(info.select("hap_id"), "hap_id", "left_anti").agg(F.count(F.lit(1)).alias("n_unknown"))
    e = info.select("hap_id").distinct().join(ids, "hap_id", "left_anti").agg(F.count(F.lit(1)).alias("n_unused"))
    return a.join(b).join(c).join(e)
