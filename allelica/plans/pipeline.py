"""From a genotype file to blocks, haplotypes, diversity and features as one lazy composition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelica.functions.keys import materialize
from allelica.operators import haplotypes as H
from allelica.operators import ld, qc, segmentation
from allelica.operators import prediction as P
from allelica.sources import readers


@dataclass(frozen=True)
class Result:
    genotypes: DataFrame
    blocks: DataFrame
    haplotypes: DataFrame
    diversity: DataFrame
    alleles: DataFrame
    features: DataFrame
    defects: DataFrame


def run(spark: SparkSession, source: str | DataFrame, maf_cut: float = 0.05, min_callrate: float = 0.0, impute: str = "mean_rounded", cut: float = 0.5, mode: str = "density", min_snps: int = 3, min_freq: float = 0.01, top_n: int | None = None, encoding: str = "additive_012", chromosomes: list[str] | None = None, phased: DataFrame | None = None) -> Result:
    """Filter, impute, segment, extract. Imputed genotypes and blocks are written once, since several results read them.

    With ``phased`` (a1, a2 per variant) haplotypes are its gametes; it must hold every kept variant.
    """
    geno = readers.read_genotypes(spark, source) if isinstance(source, str) else source
    if chromosomes is not None:
        geno = geno.where(F.col("chr").isin(chromosomes))
    kept = qc.maf_filter(geno, maf_cut).where(F.col("call_rate") >= min_callrate).select(*[F.col(k).alias(f"_{k}") for k in qc.KEY])
    geno = geno.join(kept, F.expr("chr <=> _chr and pos <=> _pos and snp <=> _snp"), "left_semi")
    geno = materialize(qc.impute(geno, min_callrate, impute), "imputed")
    blocks = segmentation.segment(ld.variant_major(geno), cut, mode, maf=maf_cut)
    blocks = materialize(blocks.withColumn("block_id", F.concat_ws("_", F.lit("block"), "chr", "start_bp", "end_bp")), "blocks")
    if phased is not None:
        haps = H.extract_phased(readers.check_aligned(phased, geno), blocks, min_snps)
    else:
        haps = H.extract(geno, blocks, min_snps)
    kept_alleles = H.alleles(haps, min_freq, top_n)
    feats = H.features(haps, kept_alleles, encoding)
    return Result(geno, blocks, haps, H.diversity(haps, phased is not None), kept_alleles, feats, qc.check_haplotypes(feats, kept_alleles))


@dataclass(frozen=True)
class Prediction:
    relationship: DataFrame
    gebv: DataFrame
    effects: DataFrame
    importance: DataFrame
    overall: DataFrame


def predict(geno: DataFrame, blocks: DataFrame, pheno: DataFrame, rule: str = "any", min_freq: float = 0.01, top_n: int | None = None, min_snps: int = 3, bend: bool = True) -> Prediction:
    """Haplotype-based prediction per trait: relationship, values of all samples, variant effects, importance of each block
    per trait and over the traits (``rule``: any, all, mean)."""
    haps = H.extract(geno, blocks, min_snps)
    grm = materialize(H.relationship(H.features(haps, H.alleles(haps, min_freq, top_n)), bend=bend), "grm")
    gebv = materialize(P.gblup(grm, pheno), "gebv")
    effects = importance = None
    for r in gebv.select("trait").distinct().orderBy("trait").collect():
        e = P.backsolve(geno, gebv.where(F.col("trait") == r["trait"]), grm)
        i = P.block_importance(P.local_gebv(geno, blocks, e)).withColumn("trait", F.lit(r["trait"]))
        e = e.withColumn("trait", F.lit(r["trait"]))
        effects = e if effects is None else effects.unionByName(e)
        importance = i if importance is None else importance.unionByName(i)
    if importance is None:
        raise ValueError("no trait has enough phenotyped samples")
    return Prediction(grm, gebv, effects, importance, P.importance_over_traits(importance, rule))
