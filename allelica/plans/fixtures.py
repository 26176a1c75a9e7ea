"""The inputs of the registered queries, as DataFrames and as SQL.

The association results, blocks, variants, calls and phenotypes are the given tables, cleaned. Their calls cover few variants
of each sample, so the operators that need a dense panel have one derived from ``embeddings``: a sample per row, half as many
variants in blocks of 8 on four chromosomes, about one per cent of the dosages missing. ``label`` is the population group, and
the panel's association results and effects follow simple rules, so that both engines see the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelica.functions.keys import loose_key, plain_chr, table, variant_id


def n_variants(spark: SparkSession, d: str) -> int:
    """Variants of the panel: half the samples, in whole blocks of 8 for each of four chromosomes, 64 at least."""
    return max(64, table(spark, d, "embeddings").count() // 64 * 32)


def geno(spark: SparkSession, d: str) -> DataFrame:
    """sample_id, vec_id, grp, j, snp, chr, pos, dosage (null where missing)."""
    v = n_variants(spark, d)
    e = table(spark, d, "embeddings").selectExpr("vec_id", "embedding", "label as grp", f"explode(sequence(0, {v - 1})) as j")
    at = "cast(embedding[cast({} as int)] as double)"
    own = f"case when j % 8 > 0 then 0.3D * {at.format('j % 64')} else 0.0D end"
    e = e.selectExpr("vec_id", "grp", "j", f"{at.format('floor(j / 8) % 64')} + 0.8D * {at.format('(floor(j / 8) * 7 + 3) % 63')} + {own} as x")
    return e.selectExpr(
        "concat('ind', lpad(vec_id, 7, '0')) as sample_id", "vec_id", "grp", "j", "concat('rs', j) as snp", f"cast(cast(1 + floor(j * 4 / {v}) as int) as string) as chr",
        "cast(1000 + j * 1000 + floor(j / 8) * 50000 as int) as pos",
        "cast(case when (vec_id * 31 + j * 17) % 97 = 0 then null when x < -0.06 then 0 when x > 0.06 then 2 else 1 end as int) as dosage",
    )


def snps(spark: SparkSession, d: str) -> DataFrame:
    """snp, chr, pos, ref_allele, alt_allele, j, effect: one row a variant of the panel."""
    v = n_variants(spark, d)
    return spark.range(v).selectExpr(
        "concat('rs', id) as snp", f"cast(cast(1 + floor(id * 4 / {v}) as int) as string) as chr", "cast(1000 + id * 1000 + floor(id / 8) * 50000 as int) as pos",
        "element_at(array('A', 'G', 'C', 'T'), cast(id % 4 + 1 as int)) as ref_allele", "element_at(array('T', 'C', 'A', 'G'), cast(id % 4 + 1 as int)) as alt_allele",
        "cast(id as int) as j", "cast((id * 29) % 41 - 20 as double) / 100D as effect",
    )


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """block_id, chr, start_bp, end_bp, n_snps: the panel's blocks of eight variants."""
    v = n_variants(spark, d)
    b = spark.range(v // 8).selectExpr(f"cast(cast(1 + floor(id * 32 / {v}) as int) as string) as chr", "cast(1000 + id * 58000 as int) as start_bp", "cast(8000 + id * 58000 as int) as end_bp", "8 as n_snps")
    return b.select(F.concat_ws("_", F.lit("block"), "chr", "start_bp", "end_bp").alias("block_id"), "chr", "start_bp", "end_bp", "n_snps")


def gwas(spark: SparkSession, d: str) -> DataFrame:
    """snp, chr, pos, beta, se, p, trait of the panel."""
    return snps(spark, d).selectExpr(
        "snp", "chr", "pos", "cast((j * 37) % 101 - 50 as double) / 100D as beta", "0.05D + cast((j * 13) % 7 as double) / 100D as se",
        "1e-9D * (1 + (j * 7919) % 1000) as p", "case when j % 3 = 0 then 'TraitA' else 'TraitB' end as trait",
    )


def pheno(spark: SparkSession, d: str) -> DataFrame:
    """sample_id, trait, y from example_blues (long form), references compared loosely; null, NaN and sentinel values have no
    row."""
    b = table(spark, d, "example_blues").select(loose_key("id").alias("sample_id"), F.col("yld").alias("YLD"), F.col("res").alias("RES"))
    return b.unpivot("sample_id", ["YLD", "RES"], "trait", "y").where("sample_id is not null and not isnan(y) and abs(y) < 99")


def real_snps(spark: SparkSession, d: str) -> DataFrame:
    """snp, chr, pos, ref_allele, alt_allele of snp_info: one row per place, the first identifier and alleles by string."""
    c = plain_chr("chr")
    s = table(spark, d, "snp_info").select(c.alias("chr"), "pos", variant_id("snp", c, F.col("pos")).alias("snp"), "ref_allele", "alt_allele").where("chr is not null and pos is not null")
    return s.groupBy("chr", "pos").agg(F.min("snp").alias("snp"), F.min("ref_allele").alias("ref_allele"), F.min("alt_allele").alias("alt_allele"))


def real_blocks(spark: SparkSession, d: str, which: str = "true") -> DataFrame:
    """block_id, chr, start_bp, end_bp, n_snps of the panels' block table, equal ones of several panels once. ``which``: a
    condition on the panel's number ``k``."""
    b = table(spark, d, "ld_blocks").withColumn("k", F.expr("cast(substring(panel, 6) as int)")).where(which)
    b = b.select(plain_chr("chr").alias("chr"), F.least("start_bp", "end_bp").alias("start_bp"), F.greatest("start_bp", "end_bp").alias("end_bp"), "n_snps", (F.col("start_bp") + F.col("end_bp")).alias("_ok"))
    b = b.where("chr is not null and _ok is not null").groupBy("chr", "start_bp", "end_bp").agg(F.max("n_snps").alias("n_snps"))
    return b.select(F.concat_ws("_", F.lit("block"), "chr", "start_bp", "end_bp").alias("block_id"), "chr", "start_bp", "end_bp", "n_snps")


def real_gwas(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, snp, chr, pos, beta, se, p, trait of example_gwas; a p outside 0..1 is none."""
    return table(spark, d, "example_gwas").select("rec_id", F.trim("marker").alias("snp"), plain_chr("chr").alias("chr"), "pos", "beta", "se", F.expr("case when p >= 0 and p <= 1 then p end").alias("p"), "trait")


def real_calls(spark: SparkSession, d: str) -> DataFrame:
    """sample_id, chr, pos, snp, dosage of vcf_calls, one row a call; a call without a genotype is missing. Calls without a
    place are left out."""
    c, gt = plain_chr("chr"), F.trim(F.split_part("gt", F.lit(":"), F.lit(1)))
    dose = F.aggregate(F.split(gt, "[/|]"), F.lit(0), lambda a, x: a + x.rlike("[1-9]").cast("int"))
    d = table(spark, d, "vcf_calls").select("sample_id", c.alias("chr"), "pos", F.concat_ws("_", c, F.col("pos").cast("string")).alias("snp"), F.when(gt.rlike("^[0-9]+[/|][0-9]+$"), dose).alias("dosage"))
    return d.where("chr is not null and pos is not null")


PLAIN = "trim(regexp_replace(trim(chr), '^chr', '', 'i'))"
NV_SQL = "nv as (select greatest(64, count(*) // 64 * 32)::int as v from embeddings), vs as (select unnest(range((select v from nv))) as j)"
SNP_SQL = f"""{NV_SQL}, snps as (select 'rs' || j as snp, (1 + j * 4 // v)::varchar as chr, (1000 + j * 1000 + (j // 8) * 50000)::int as pos,
  (['A', 'G', 'C', 'T'])[j % 4 + 1] as ref_allele, (['T', 'C', 'A', 'G'])[j % 4 + 1] as alt_allele, j::int as j, ((j * 29) % 41 - 20)::double / 100 as effect from vs, nv)"""
GENO_SQL = f"""{SNP_SQL},
geno0 as (select vec_id, label as grp, j, embedding[(j // 8) % 64 + 1]::double + 0.8::double * embedding[((j // 8) * 7 + 3) % 63 + 1]::double + case when j % 8 > 0 then 0.3::double * embedding[j % 64 + 1]::double else 0.0 end as x from embeddings, vs),
geno as (select 'ind' || lpad(vec_id::varchar, 7, '0') as sample_id, vec_id, grp, j::int as j, 'rs' || j as snp, (1 + j * 4 // v)::varchar as chr, (1000 + j * 1000 + (j // 8) * 50000)::int as pos,
  (case when (vec_id * 31 + j * 17) % 97 = 0 then null when x < -0.06 then 0 when x > 0.06 then 2 else 1 end)::int as dosage from geno0, nv)"""
BLOCK_SQL = """blocks as (select 'block_' || chr || '_' || start_bp || '_' || end_bp as block_id, * from (
  select (1 + j * 4 // v)::varchar as chr, (1000 + (j // 8) * 58000)::int as start_bp, (8000 + (j // 8) * 58000)::int as end_bp, 8::int as n_snps from vs, nv where j % 8 = 0))"""
GWAS_SQL = """gwas as (select snp, chr, pos, ((j * 37) % 101 - 50)::double / 100 as beta, 0.05::double + ((j * 13) % 7)::double / 100 as se,
  1e-9::double * (1 + (j * 7919) % 1000) as p, case when j % 3 = 0 then 'TraitA' else 'TraitB' end as trait from snps)"""
PHENO_SQL = """pheno as (select * from (select lower(trim(id)) as sample_id, 'YLD' as trait, yld as y from example_blues union all select lower(trim(id)), 'RES', res from example_blues)
  where sample_id is not null and not isnan(y) and abs(y) < 99)"""
HAP_SQL = f"""{GENO_SQL},
{BLOCK_SQL},
hap as (select block_id, b.chr, start_bp, end_bp, sample_id, any_value(grp) as grp, string_agg(coalesce(dosage::varchar, '.'), '' order by pos) as hap from geno g join blocks b on g.chr = b.chr and g.pos between start_bp and end_bp group by all),
cnt as (select block_id, chr, start_bp, end_bp, hap, count(*) as n from hap where not contains(hap, '.') group by all),
frq as (select *, n::double / sum(n) over (partition by block_id) as freq, row_number() over (partition by block_id order by n desc, hap) as hap_rank from cnt)"""
REAL_SNP_SQL = f"""snps as (select chr, pos, min(snp) as snp, min(ref_allele) as ref_allele, min(alt_allele) as alt_allele from (
  select {PLAIN} as chr, pos, case when snp is null or trim(snp) in ('', '.') then {PLAIN} || '_' || pos else snp end as snp, ref_allele, alt_allele from snp_info) where chr is not null and pos is not null group by 1, 2)"""


def real_block_sql(name: str = "blocks", which: str = "true") -> str:
    return f"""{name} as (select 'block_' || chr || '_' || start_bp || '_' || end_bp as block_id, * from (
  select {PLAIN} as chr, least(start_bp, end_bp) as start_bp, greatest(start_bp, end_bp) as end_bp, max(n_snps) as n_snps from (select *, substr(panel, 6)::int as k from ld_blocks) where {which} and {PLAIN} is not null and start_bp is not null and end_bp is not null group by 1, 2, 3))"""


REAL_GWAS_SQL = f"gwas as (select rec_id, trim(marker) as snp, {PLAIN} as chr, pos, beta, se, case when p >= 0 and p <= 1 then p end as p, trait from example_gwas)"
REAL_CALL_SQL = f"""geno as (select sample_id, chr, pos, chr || '_' || pos as snp, case when regexp_matches(g, '^[0-9]+[/|][0-9]+$') then (regexp_matches(regexp_extract(g, '^[0-9]+'), '[1-9]')::int + regexp_matches(regexp_extract(g, '[0-9]+$'), '[1-9]')::int) end as dosage
  from (select sample_id, {PLAIN} as chr, pos, trim(split_part(gt, ':', 1)) as g from vcf_calls) where chr is not null and pos is not null)"""
