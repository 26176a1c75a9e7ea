"""Writers of result tables and matrices. Long tables are pivoted to one column per sample only here."""

from __future__ import annotations

import hashlib
import json
import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.functions.keys import materialize


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """One header per part file, NULL as NA."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").option("sep", sep).csv(path)


def haplotype_numeric(features: DataFrame, alleles: DataFrame, samples: list[str]) -> DataFrame:
    """hap_id, chr, start_bp, end_bp, n_snps, alleles, frequency, then each sample's dose."""
    meta = alleles.select("hap_id", "chr", "start_bp", "end_bp", "n_snps", F.col("hap").alias("alleles"), F.col("freq").alias("frequency"))
    wide = features.groupBy("hap_id").pivot("sample_id", samples).agg(F.first("dose"))
    return meta.join(wide, "hap_id")


def haplotype_character(haps: DataFrame, decoded: DataFrame, samples: list[str]) -> DataFrame:
    """Cells: the allele's bases if the sample carries it, - if not, . if its haplotype is incomplete."""
    a = decoded.select("hap_id", F.col("block_id").alias("_b"), "chr", "start_bp", "end_bp", "n_snps", F.col("hap").alias("_h"), F.col("nucleotide_sequence").alias("Alleles"))
    d = a.join(haps.select("block_id", "sample_id", "hap"), F.col("_b") == F.col("block_id"))
    cell = F.when(F.contains("hap", F.lit(".")), ".").when(F.col("hap") == F.col("_h"), F.col("Alleles")).otherwise("-")
    # phased samples have two rows: the carried copy shows
    d = d.groupBy("hap_id", "chr", "start_bp", "end_bp", "n_snps", "Alleles", "sample_id").agg(F.max(cell).alias("cell"))
    return d.groupBy("hap_id", "chr", "start_bp", "end_bp", "n_snps", "Alleles").pivot("sample_id", samples).agg(F.first("cell"))


def vcf_lines(geno: DataFrame, samples: list[str]) -> DataFrame:
    """Lines (value) of a VCF body, in order of chromosome and position; null dosages are ./., missing,
    empty or equal alleles A and T."""
    some = lambda c: F.when(F.trim(c) != "", F.col(c))
    ref = F.coalesce(some("ref_allele"), F.lit("A"))
    alt = F.coalesce(some("alt_allele"), F.when(ref == "T", "A").otherwise("T"))
    alt = F.when(alt == ref, F.when(ref == "T", "A").otherwise("T")).otherwise(alt)
    gt = F.when(F.col("dosage") == 0, "0/0").when(F.col("dosage") == 1, "0/1").when(F.col("dosage") == 2, "1/1").otherwise("./.")
    d = geno.groupBy("chr", "pos", "snp", ref.alias("r"), alt.alias("a")).agg(F.map_from_entries(F.collect_list(F.struct("sample_id", gt.alias("g")))).alias("m"))
    cells = F.array_join(F.transform(F.array(*[F.lit(s) for s in samples]), lambda s: F.coalesce(F.try_element_at("m", s), F.lit("./."))), "\t")
    return d.orderBy("chr", "pos").select(F.concat_ws("\t", "chr", F.col("pos").cast("string"), "snp", "r", "a", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), cells).alias("value"))


def write_vcf(geno: DataFrame, path: str, samples: list[str]) -> None:
    """Compressed text parts, sorted; the header lines are a part of their own."""
    head = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    first = geno.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1)
    first.unionByName(vcf_lines(geno, samples)).write.mode("overwrite").option("compression", "gzip").text(path)


def fingerprint(**parameters) -> str:
    return hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


def cached(df: DataFrame, path: str, **parameters) -> DataFrame:
    """``df`` from ``path`` if one with equal parameters was written there, otherwise written now."""
    spark, at = df.sparkSession, f"{path}/{fingerprint(**parameters)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def phase(vcf: str, out: str, jar: str, java: str = "java", memory: str = "8g", **options) -> str:
    """Runs an external phasing program (a jar that takes gt= and out=); returns the phased file's path."""
    cmd = [java, f"-Xmx{memory}", "-jar", jar, f"gt={vcf}", f"out={out}", *[f"{k.replace('_', '-')}={v}" for k, v in options.items() if v is not None]]
    done = subprocess.run(cmd, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"phasing failed ({done.returncode}): {done.stderr[-500:]}")
    return f"{out}.vcf.gz"


__all__ = ["write_csv", "haplotype_numeric", "haplotype_character", "vcf_lines", "write_vcf", "fingerprint", "cached", "phase", "materialize"]
