"""Queries of the writers' tables, the whole pipeline and the stream operator."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from allelica.functions.keys import shared_dir, table
from allelica.operators import gwas, prediction, segmentation
from allelica.operators import haplotypes as H
from allelica.plans import fixtures as X
from allelica.plans import pipeline
from allelica.plans.haplotype_queries import _haps
from allelica.plans.trait_queries import _REG0
from allelica.sources import readers, writers
from allelica.streaming import calls


def _samples(spark, d):
    return [r[0] for r in X.geno(spark, d).select("sample_id").distinct().orderBy("sample_id").collect()]


def export_hap_numeric(spark, d):
    h = _haps(spark, d)
    k = H.alleles(h, 0.05)
    return writers.haplotype_numeric(H.features(h, k), k, _samples(spark, d))


def export_hap_character(spark, d):
    h = _haps(spark, d)
    return writers.haplotype_character(h, H.decode(H.alleles(h, 0.05), X.snps(spark, d)), _samples(spark, d))


def _full(spark, d):
    s = X.snps(spark, d).select(F.col("snp").alias("_s"), "ref_allele", "alt_allele")
    return X.geno(spark, d).join(s, F.col("snp") == F.col("_s")).drop("_s")


def export_vcf_lines(spark, d):
    return writers.vcf_lines(_full(spark, d), _samples(spark, d))


_LONG = ["sample_id", "snp", "chr", "pos", "ref_allele", "alt_allele", "dosage"]


def _known(geno):
    return geno.select(*_LONG[:-1], F.coalesce("dosage", F.lit(-1)).alias("dosage"))


def source_vcf(spark, d):
    """The panel written as VCF to the shared folder and read again."""
    at = f"{shared_dir(spark)}/allelica/{uuid.uuid4().hex}.vcf"
    writers.write_vcf(_full(spark, d), at, _samples(spark, d))
    return _known(readers.read_genotypes(spark, at))


def source_numeric(spark, d):
    """The panel as a numeric table of one column per sample, likewise."""
    at = f"{shared_dir(spark)}/allelica/{uuid.uuid4().hex}.csv"
    g = _full(spark, d).groupBy("snp", "chr", "pos", "ref_allele", "alt_allele").agg(F.array_sort(F.collect_list(F.struct("sample_id", F.coalesce(F.col("dosage").cast("string"), F.lit("NA")).alias("v")))).alias("_a"))
    lines = g.select(F.concat_ws(",", "snp", "chr", F.col("pos").cast("string"), "ref_allele", "alt_allele", F.array_join("_a.v", ",")).alias("value"))
    head = spark.createDataFrame([(",".join(["SNP", "CHR", "POS", "REF", "ALT", *_samples(spark, d)]),)], "value string").coalesce(1)
    head.unionByName(lines).write.text(at)
    return _known(readers.read_genotypes(spark, at))


def source_store(spark, d):
    """The panel's store, one stretch of a chromosome read."""
    return _known(readers.read_chunk(readers.store(_full(spark, d).select(*_LONG), f"{shared_dir(spark)}/allelica/store-{uuid.uuid4().hex}"), "2", 1000, 6_000_000))


def pipeline_diversity(spark, d):
    return pipeline.run(spark, _full(spark, d)).diversity


def pipeline_features(spark, d):
    return pipeline.run(spark, _full(spark, d)).features


def haplotype_prediction(spark, d):
    """Block importance over both traits."""
    return pipeline.predict(X.geno(spark, d), X.blocks(spark, d), X.pheno(spark, d)).overall


def blocks_with_singletons(spark, d):
    return segmentation.with_singletons(X.real_blocks(spark, d), X.real_snps(spark, d))


def export_biomart(spark, d):
    return gwas.export_regions(gwas.qtl_regions(X.real_gwas(spark, d), X.real_blocks(spark, d), X.real_snps(spark, d), 1e-4), "biomart")


def stacking_scores(spark, d):
    h = _haps(spark, d)
    e = prediction.allele_effects(H.alleles(h, 0.02), X.snps(spark, d), X.snps(spark, d).select("snp", "effect"))
    return prediction.stacking_scores(h, e, [r["block_id"] for r in X.blocks(spark, d).collect()])


def backend_summary(spark, d):
    return readers.describe(X.real_calls(spark, d))


def pheno_long(spark, d):
    c = table(spark, d, "example_phenotype").select("rec_id", "trait1", "trait2")
    return readers.normalize_pheno(c, "rec_id").groupBy("trait").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("n_obs"))


def stream_plate_rates(spark, d):
    return calls.plate_rates(table(spark, d, "vcf_calls")).groupBy("plate").agg(F.sum("n_calls").alias("n_calls"), F.sum("n_missing").alias("n_missing"))


QUERIES = {f.__name__: f for f in (haplotype_prediction, blocks_with_singletons, export_biomart, stacking_scores, export_hap_numeric, export_hap_character, export_vcf_lines, source_vcf, source_numeric, source_store, pipeline_diversity, pipeline_features, backend_summary, pheno_long, stream_plate_rates)}
_PANEL = f"with {X.GENO_SQL} select sample_id, g.snp, g.chr, g.pos, ref_allele, alt_allele, coalesce(dosage, -1) as dosage from geno g join snps s on g.snp = s.snp"
SQL = {
    "source_vcf": _PANEL, "source_numeric": _PANEL, "source_store": _PANEL + " where g.chr = '2' and g.pos between 1000 and 6000000",
    "blocks_with_singletons": f"with {X.REAL_SNP_SQL}, {X.real_block_sql()} select chr, start_bp::int as start_bp, end_bp::int as end_bp, n_snps from blocks union all select chr, pos, pos, 1 from snps s where not exists (select 1 from blocks m where m.chr = s.chr and s.pos between m.start_bp and m.end_bp)",
    "export_biomart": f"with {_REG0} select chr || ':' || lead_pos || ':' || lead_pos as region from rg",
    "backend_summary": f"with {X.REAL_CALL_SQL} select chr, count(distinct (pos, snp)) as n_snps, count(distinct sample_id) as n_samples from geno group by 1",
    "export_vcf_lines": f"with {X.GENO_SQL} select concat_ws(chr(9), g.chr, g.pos::varchar, g.snp, any_value(ref_allele), any_value(alt_allele), '.', 'PASS', '.', 'GT', string_agg(case dosage when 0 then '0/0' when 1 then '0/1' when 2 then '1/1' else './.' end, chr(9) order by sample_id)) as value from geno g join snps s on g.snp = s.snp group by g.chr, g.pos, g.snp",
    "pheno_long": "select 'trait1' as trait, count(*) as n, count(*) filter (not isnan(trait1)) as n_obs from example_phenotype union all select 'trait2', count(*), count(*) filter (not isnan(trait2)) from example_phenotype",
    "stream_plate_rates": "select plate, count(*) as n_calls, count(*) filter (not coalesce(regexp_matches(trim(split_part(gt, ':', 1)), '^[0-9]+[/|][0-9]+$'), false)) as n_missing from vcf_calls group by 1",
}
