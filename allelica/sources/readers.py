"""Readers of genotype files into long DataFrames (sample_id, snp, chr, pos, ref_allele, alt_allele, dosage).

Text formats are split and decoded in generated code; a sample column becomes a row by position, so a file of any width
needs no wide schema. Lines are the unit of parallelism; binary PLINK files are read in ranges of whole variants.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelica.functions.keys import plain_chr, variant_id

MISSING = ("NA", "N", "NN", "./.", ".|.", ".", "", "--")
OUT = ["sample_id", "snp", "chr", "pos", "ref_allele", "alt_allele", "dosage"]
# Leading columns of a HapMap file.
HAPMAP = ["rs", "alleles", "chrom", "pos", "strand", "assembly", "center", "protLSID", "assayLSID", "panelLSID", "QCcode"]


def detect_format(path: str) -> str:
    """hapmap, vcf, bed, parquet or numeric by the file's name."""
    p = path.lower()
    for ends, kind in (((".hmp.txt", ".hmp.txt.gz"), "hapmap"), ((".vcf", ".vcf.gz"), "vcf"), ((".bed",), "bed"), ((".parquet",), "parquet"), ((".csv", ".txt", ".csv.gz", ".txt.gz"), "numeric")):
        if p.endswith(ends):
            return kind
    if p.endswith(".gds"):
        raise ValueError("GDS files need a library that isn't available; convert to VCF or BED")
    raise ValueError(f"unknown genotype format: {path}")


def read_genotypes(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Genotypes of a file in any supported format."""
    kind = format or detect_format(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    return {"hapmap": read_hapmap, "vcf": read_vcf, "bed": read_bed, "numeric": read_numeric}[kind](spark, path, **options)


def _lines(spark: SparkSession, path: str, sep: str, mark: str = "", need: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Lines without the header, and the header's fields. The header is the first line, or in any part of the file the first
    that starts with ``mark`` and has the fields ``need``."""
    lines = spark.read.text(path)
    some = lines.where(~F.startswith("value", F.lit("##")) & (F.trim("value") != "") & F.startswith("value", F.lit(mark)))
    names = F.transform(F.split(F.upper(F.regexp_replace("value", "\r$", "")), f"\\Q{sep}\\E"), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    first = some.where(F.array_size(F.array_intersect(names, F.array(*[F.lit(n) for n in need]))) == len(need)).first() if need else None
    first = first or some.first()
    if first is None:
        raise ValueError(f"no header in {path}")
    head = first["value"].rstrip("\r")
    body = lines.where((F.regexp_replace("value", "\r$", "") != F.lit(head)) & ~F.startswith("value", F.lit("##")) & (F.trim("value") != ""))
    return body.select(F.split(F.regexp_replace("value", "\r$", ""), f"\\Q{sep}\\E", -1).alias("f")), [h.strip().strip('"') for h in head.split(sep)]


def clean_rows(spark: SparkSession, path: str, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(lines with as many fields as the header, one row of total, removed, kept)."""
    body, head = _lines(spark, path, sep)
    ok = F.size("f") == len(head)
    return body.where(ok), body.agg(F.count(F.lit(1)).alias("total"), F.count_if(~ok).alias("removed"), F.count_if(ok).alias("kept"))


def _of_width(body: DataFrame, n: int, clean: bool) -> DataFrame:
    """Lines of ``n`` fields. A line of another width is an error, or is left out if ``clean``."""
    if clean:
        return body.where(F.size("f") == n)
    text = F.concat(F.lit(f"a line of another width than the header's {n}: "), F.substring(F.array_join("f", " "), 1, 80))
    return body.where(F.when(F.size("f") == n, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def _samples(ids: list[str], first: int) -> Column:
    """Rows of a line's sample columns: exploded pairs of sample id and value."""
    names = F.array(*[F.lit(s) for s in ids])
    return F.explode(F.arrays_zip(names.alias("sample_id"), F.slice("f", first + 1, len(ids)).alias("v"))).alias("s")


def _base(snp: Column, chrom: Column, pos: Column, ref: Column, alt: Column) -> list[Column]:
    c, p = plain_chr(chrom), F.try_to_number(pos, F.lit("9999999999")).cast("int")
    return [variant_id(snp, c, p).alias("snp"), c.alias("chr"), p.alias("pos"), ref.alias("ref_allele"), alt.alias("alt_allele")]


def _get(i: int) -> Column:
    return F.get("f", F.lit(i))


def read_numeric(spark: SparkSession, path: str, sep: str = ",", na: tuple[str, ...] = MISSING, sample_ids: list[str] | None = None, clean: bool = False) -> DataFrame:
    """SNP, CHR, POS[, REF, ALT], then one dosage column per sample. A line of another width than the header's is an error,
    with ``clean`` it is left out (``clean_rows`` counts such lines)."""
    body, head = _lines(spark, path, sep, need=("SNP", "CHR", "POS"))
    up = [h.upper() for h in head]
    for need in ("SNP", "CHR", "POS"):
        if need not in up:
            raise ValueError(f"missing column {need} in {path}")
    first = 1 + max(up.index(c) for c in ("SNP", "CHR", "POS", "REF", "ALT") if c in up)
    at = lambda c: _get(up.index(c)) if c in up else F.lit(None).cast("string")
    d = _of_width(body, len(head), clean).select(*_base(at("SNP"), at("CHR"), at("POS"), at("REF"), at("ALT")), _samples(sample_ids or head[first:], first))
    v = F.trim("s.v")
    return d.select("*", F.col("s.sample_id").alias("sample_id"), F.when(~v.isin(*na), F.expr("try_cast(trim(s.v) as double)")).cast("int").alias("dosage")).select(*OUT)


def read_hapmap(spark: SparkSession, path: str, sample_ids: list[str] | None = None, strict: bool = False, clean: bool = False) -> DataFrame:
    """Eleven leading columns, then two-letter calls; the dosage counts letters equal to ALT (second of ``alleles``).
    ``strict``: calls with any other letter than REF and ALT are missing. ``clean``: as in ``read_numeric``."""
    body, head = _lines(spark, path, "\t")
    alleles = F.split(_get(1), "/")
    ref, alt = F.get(alleles, F.lit(0)), F.get(alleles, F.lit(1))
    d = _of_width(body, len(head), clean).select(*_base(_get(0), _get(2), _get(3), ref, alt), _samples(sample_ids or head[len(HAPMAP) :], len(HAPMAP)))
    v = F.upper(F.trim("s.v"))
    n = (F.substring(v, 1, 1) == F.col("alt_allele")).cast("int") + (F.substring(v, 2, 1) == F.col("alt_allele")).cast("int")
    ok = ~v.isin(*MISSING) & (F.length(v) == 2)
    if strict:
        ok = ok & F.substring(v, 1, 1).isin(F.col("ref_allele"), F.col("alt_allele")) & F.substring(v, 2, 1).isin(F.col("ref_allele"), F.col("alt_allele"))
    return d.select("*", F.col("s.sample_id").alias("sample_id"), F.when(ok, n).alias("dosage")).select(*OUT)


def _vcf(spark: SparkSession, path: str, clean: bool = False) -> DataFrame:
    body, head = _lines(spark, path, "\t", "#CHROM\t")
    if len(head) < 10:
        raise ValueError(f"no VCF header with samples in {path}")
    d = _of_width(body, len(head), clean).select(*_base(_get(2), _get(0), _get(1), _get(3), _get(4)), _samples(head[9:], 9))
    return d.select("*", F.col("s.sample_id").alias("sample_id"), F.substring_index("s.v", ":", 1).alias("gt"))


def read_vcf(spark: SparkSession, path: str, biallelic_only: bool = False, clean: bool = False) -> DataFrame:
    """Number of non-zero alleles of each call; null unless every allele is a number. Haploid calls count as they are.
    ``clean``: as in ``read_numeric``."""
    d = _vcf(spark, path, clean)
    if biallelic_only:
        d = d.where(~F.contains("alt_allele", F.lit(",")))
    parts = F.split("gt", "[/|]")
    dose = F.aggregate(parts, F.lit(0), lambda a, x: a + x.rlike("[1-9]").cast("int"))
    return d.withColumn("dosage", F.when(F.col("gt").rlike("^[0-9]+([/|][0-9]+)*$"), dose)).select(*OUT)


def read_phased_vcf(spark: SparkSession, path: str, min_maf: float | None = None) -> DataFrame:
    """Gametes of phased calls a|b: OUT and a1, a2 (0/1), both null if either is missing or the call isn't phased."""
    d = _vcf(spark, path)
    ok = F.col("gt").rlike("^[0-9]+\\|[0-9]+$")
    one = lambda i: F.when(ok, F.get(F.split("gt", "\\|"), F.lit(i)).rlike("[1-9]").cast("int"))
    d = d.withColumn("a1", one(0)).withColumn("a2", one(1)).withColumn("dosage", F.col("a1") + F.col("a2")).select(*OUT, "a1", "a2")
    if min_maf is not None:
        f = d.groupBy("chr", "pos", "snp").agg((F.avg("dosage") / 2).alias("_f")).where(F.least(F.col("_f"), 1 - F.col("_f")) >= min_maf).select(F.col("chr").alias("_c"), F.col("pos").alias("_p"), F.col("snp").alias("_s"))
        d = d.join(f, F.expr("chr <=> _c and pos <=> _p and snp <=> _s"), "left_semi")
    return d


def read_bed(spark: SparkSession, path: str, variants_per_task: int = 4096) -> DataFrame:
    """PLINK binary: .bed with .bim and .fam beside it. Dosage counts the second .bim allele column's partner as PLINK's
    A1; sample ids are FID_IID. Each task decodes a range of whole variants."""
    import numpy as np
    import pandas as pd

    stem = path[: -len(".bed")]
    fam = spark.read.text(f"{stem}.fam").where(F.trim("value") != "").select(F.split(F.trim("value"), "\\s+").alias("f"))
    ids = [f"{r['f'][0]}_{r['f'][1]}" for r in fam.collect()]
    n_bytes = math.ceil(len(ids) / 4)
    local = path.removeprefix("file://").removeprefix("file:")
    with open(local, "rb") as f:
        if f.read(3) != b"\x6c\x1b\x01":
            raise ValueError(f"{path} isn't a variant-major PLINK file")
    n = (os.path.getsize(local) - 3) // n_bytes
    bim = spark.read.text(f"{stem}.bim").where(F.trim("value") != "")
    bim = bim.select(F.monotonically_increasing_id().alias("_o"), F.split(F.trim("value"), "\\s+").alias("f"))
    # order of lines in the file: one rank over the ids of the (small) variant list
    from pyspark.sql import Window as W

    bim = bim.select((F.row_number().over(W.orderBy("_o")) - 1).alias("ix"), *_base(_get(1), _get(0), _get(3), _get(5), _get(4)))

    def decode(batches):
        for pdf in batches:
            for s in pdf["id"]:
                a, z = int(s) * variants_per_task, min(n, (int(s) + 1) * variants_per_task)
                with open(local, "rb") as f:
                    f.seek(3 + a * n_bytes)
                    raw = np.frombuffer(f.read((z - a) * n_bytes), "uint8").reshape(z - a, n_bytes)
                two = (raw[:, :, None] >> np.array([0, 2, 4, 6], "uint8")) & 3
                two = two.reshape(z - a, -1)[:, : len(ids)]
                dose = np.array([2, -1, 1, 0])[two]
                yield pd.DataFrame({"bix": np.repeat(np.arange(a, z), len(ids)), "sample_id": ids * (z - a), "d": dose.ravel()})

    tasks = math.ceil(n / variants_per_task)
    d = spark.range(0, tasks, 1, max(1, tasks)).mapInPandas(decode, "bix int, sample_id string, d int")
    return d.join(bim, d["bix"] == bim["ix"]).select("*", F.when(F.col("d") >= 0, F.col("d")).alias("dosage")).select(*OUT)


def from_matrix(spark: SparkSession, matrix, snp_info, sample_ids: list[str] | None = None) -> DataFrame:
    """Long genotypes from a samples x variants array and a pandas table with SNP, CHR, POS[, REF, ALT]. NaN is missing."""
    import numpy as np
    import pandas as pd

    m = np.asarray(matrix, float)
    info = snp_info.rename(columns=str.upper)
    for need in ("SNP", "CHR", "POS"):
        if need not in info:
            raise ValueError(f"missing column {need}")
    if m.shape[1] != len(info):
        raise ValueError(f"{m.shape[1]} columns but {len(info)} variants")
    ids = sample_ids or [f"ind{i + 1}" for i in range(len(m))]
    k = m.shape[0]
    pdf = pd.DataFrame({"sample_id": np.tile(ids, m.shape[1]), "snp": np.repeat(info["SNP"].astype(str).to_numpy(), k), "chr": np.repeat(info["CHR"].astype(str).to_numpy(), k), "pos": np.repeat(info["POS"].to_numpy(int), k), "ref_allele": np.repeat(info.get("REF", pd.Series([None] * len(info))).to_numpy(object), k), "alt_allele": np.repeat(info.get("ALT", pd.Series([None] * len(info))).to_numpy(object), k), "d": m.T.ravel()})
    d = spark.createDataFrame(pdf, "sample_id string, snp string, chr string, pos int, ref_allele string, alt_allele string, d double")
    return d.select("*", F.when(~F.isnan("d"), F.col("d")).cast("int").alias("dosage")).withColumn("chr", plain_chr("chr")).select(*OUT)


def store(geno: DataFrame, path: str) -> DataFrame:
    """Parquet copy partitioned by chromosome, reopened: chromosome and position filters then prune files and row groups."""
    geno.repartitionByRange("chr", "pos").sortWithinPartitions("chr", "pos").write.mode("overwrite").partitionBy("chr").parquet(path)
    return geno.sparkSession.read.option("inferPartitionColumnTypes", "false").schema(geno.schema).parquet(path)


def read_chunk(geno: DataFrame, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of a stretch of a chromosome."""
    d = geno.where(F.col("chr") == chrom)
    if start is not None:
        d = d.where(F.col("pos") >= start)
    return d.where(F.col("pos") <= end) if end is not None else d


def describe(geno: DataFrame) -> DataFrame:
    """Variants and samples per chromosome."""
    return geno.groupBy("chr").agg(F.countDistinct("pos", "snp").alias("n_snps"), F.countDistinct("sample_id").alias("n_samples"))


def normalize_pheno(df: DataFrame, id_col: str, traits: list[str] | None = None) -> DataFrame:
    """sample_id, trait, y from a table with one column per trait (all numeric columns but the id, if none are named)."""
    kinds = dict(df.dtypes)
    traits = traits or [c for c in df.columns if c != id_col and kinds[c].split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")]
    missing = [c for c in [id_col, *traits] if c not in df.columns]
    if missing or not traits:
        raise ValueError(f"missing column(s): {', '.join(missing) or 'no numeric trait'}")
    d = df.select(F.col(id_col).cast("string").alias("sample_id"), *[F.col(c).cast("double").alias(c) for c in traits])
    d = d.unpivot("sample_id", traits, "trait", "y")
    return d.withColumn("y", F.when(~F.isnan("y"), F.col("y")))


def check_aligned(phased: DataFrame, geno: DataFrame) -> DataFrame:
    """``phased`` if it holds every variant of ``geno``; ValueError with the number of unmatched ones otherwise."""
    key = ["chr", "pos", "snp"]
    n = geno.select(*key).distinct().join(phased.select(*key).distinct(), key, "left_anti").count()
    if n:
        raise ValueError(f"{n} variants have no phased counterpart")
    return phased
