"""Queries of the general data problems, over whole tables, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelica.functions.keys import loose_key, plain_chr, table, variant_id
from allelica.operators import imputation, intervals, orphans, parsing, skew


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "ld_blocks").select("panel", plain_chr("chr").alias("chr"), "start_bp", "end_bp")
    return intervals.periods_and_gaps(blocks, ["panel", "chr"], "start_bp", "end_bp")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_orphans(spark, d).select("tab", "period", "rec_id")


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """References to samples and to variants of the three tables."""

    def kids(tab: str, ref) -> DataFrame:
        return table(spark, d, tab).select(F.lit(tab).alias("tab"), "rec_id", ref.alias("ref"), "recorded_at", F.date_format("recorded_at", "yyyy-MM").alias("period"))

    people = kids("example_blues", loose_key("id")).unionByName(kids("example_phenotype", loose_key("sample_id")))
    return people, kids("example_gwas", loose_key("marker", drop_chr=True))


def p2_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Orphan records of the three tables with their reference."""
    samples = table(spark, d, "samples").select(loose_key("sample_id").alias("ref"), F.col("registered_at").alias("since"), F.col("removed_at").alias("until"))
    snps = table(spark, d, "snp_info")
    name = variant_id("snp", plain_chr("chr"), F.col("pos"))
    # a variant without id and place has no key
    name = F.when(F.col("snp").isNull() | F.trim("snp").isin("", "."), F.when(F.col("chr").isNotNull() & F.col("pos").isNotNull(), name)).otherwise(name)
    snps = snps.select(loose_key(name, drop_chr=True).alias("ref"), F.col("added_at").alias("since"), F.col("withdrawn_at").alias("until"))
    people, markers = _references(spark, d)
    a = orphans.orphan_references(people, samples, "ref", "recorded_at", "rec_id", "since", "until")
    b = orphans.orphan_references(markers, snps, "ref", "recorded_at", "rec_id", "since", "until")
    return a.unionByName(b)


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """References, orphans and missing keys per table and month, also of months without orphans."""
    people, markers = _references(spark, d)
    refs = people.unionByName(markers).where("ref is not null").groupBy("tab", "period").agg(F.count(F.lit(1)).alias("n_references"))
    n = p2_orphans(spark, d).groupBy(F.col("tab").alias("_t"), F.col("period").alias("_p")).agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("ref").alias("n_keys"))
    out = refs.join(n, F.expr("tab = _t and period <=> _p"), "left")
    return out.select("tab", "period", "n_references", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), F.coalesce("n_keys", F.lit(0)).alias("n_keys"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_parsed(spark, d).where("reason is not null").select("line_id", "reason")


def p3_parsed(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_variants(table(spark, d, "raw_variants"), table(spark, d, "chrom_list"))


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid rows, typed."""
    return p3_parsed(spark, d).where("reason is null").select("line_id", "snp", "chr", "pos", "ref_allele", "alt_allele")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return imputation.fill_genotypes(table(spark, d, "vcf_calls"), table(spark, d, "samples")).select("call_id", "dosage")


def p4_dosages(spark: SparkSession, d: str) -> DataFrame:
    return imputation.all_dosages(table(spark, d, "vcf_calls"), table(spark, d, "samples"))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per plain chromosome: rows, distinct positions, commonest position and position quartiles."""
    snps = table(spark, d, "snp_info").select(plain_chr("chr").alias("chr"), "pos")
    return skew.per_key_profile(snps, "chr", "pos")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    prof = skew.per_key_profile(table(spark, d, "snp_info").select(plain_chr("chr").alias("chr"), "pos"), "chr", "pos", ())
    total = prof.agg(F.sum("n_rows").alias("_total"))
    return prof.where("chr is not null").join(F.broadcast(total), F.col("n_rows") * 20 >= F.col("_total")).select("chr")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_report, p3_found, p3_loaded, p4_found, p4_dosages, p5_found, p5_profile)}

_CHR = "trim(regexp_replace(trim(chr), '^chr', '', 'i'))"
_P1 = f"""
with b as (select panel, {_CHR} as chr, least(start_bp, end_bp) s, greatest(start_bp, end_bp) e from ld_blocks
           where panel is not null and chr is not null and start_bp is not null and end_bp is not null),
f as (select *, max(e) over (partition by panel, chr order by s, e rows between unbounded preceding and 1 preceding) m from b),
g as (select *, sum(case when m is null or s > m + 1 then 1 else 0 end) over (partition by panel, chr order by s, e rows unbounded preceding) r from f),
p as (select panel, chr, min(s) s, max(e) e from g group by panel, chr, r),
n as (select *, lead(s) over (partition by panel, chr order by s) nx from p)
select panel, chr, 'period' as kind, s as start_bp, e as end_bp from n
union all select panel, chr, 'gap', e + 1, nx - 1 from n where nx is not null"""
_P2 = f"""
with s as (select lower(trim(sample_id)) k, registered_at a, removed_at b from samples where sample_id is not null),
v as (select regexp_replace(lower(trim(case when snp is null or trim(snp) in ('', '.') then {_CHR} || '_' || pos else snp end)), '^chr', '') k, added_at a, withdrawn_at b from snp_info),
c as (select 'example_blues' tab, rec_id, lower(trim(id)) k, recorded_at t from example_blues
      union all select 'example_phenotype', rec_id, lower(trim(sample_id)), recorded_at from example_phenotype),
m as (select 'example_gwas' tab, rec_id, regexp_replace(lower(trim(marker)), '^chr', '') k, recorded_at t from example_gwas),
o as (select * from c where k is not null and not exists (select 1 from s where s.k = c.k and s.a <= c.t and (s.b is null or s.b > c.t))
      union all select * from m where k is not null and not exists (select 1 from v where v.k = m.k and v.a <= m.t and (v.b is null or v.b > m.t)))"""
_FIELDS = """
with r as (select line_id, sep, regexp_replace(line, '\\r$', '') as t from raw_variants),
s as (select *, case sep when ',' then '^(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*$'
                         when ';' then '^(?:"(?:[^"]|"")*"|[^";]*)(?:;(?:"(?:[^"]|"")*"|[^";]*))*$'
                         else '^(?:"(?:[^"]|"")*"|[^"\\t]*)(?:\\t(?:"(?:[^"]|"")*"|[^"\\t]*))*$' end as re,
      case sep when ',' then '(?:^|,)("(?:[^"]|"")*"|[^",]*)' when ';' then '(?:^|;)("(?:[^"]|"")*"|[^";]*)' else '(?:^|\\t)("(?:[^"]|"")*"|[^"\\t]*)' end as fe from r),
q as (select line_id, sep, t, case when t is null then null else regexp_matches(t, re) end as good, regexp_extract_all(case when left(t, 1) = sep then sep || t else t end, fe, 1) as f from s),
u as (select line_id, good, len(f) as n, list_transform(f, lambda x: case when x[1] = '"' then replace(substr(x, 2, len(x) - 2), '""', '"') else x end) as f from q),
p as (select line_id, good, n, trim(f[1], ' ') as snp, trim(regexp_replace(trim(f[2], ' '), '^chr', '', 'i'), ' ') as chr, trim(f[3], ' ') as pos, trim(f[4], ' ') as ref_allele, trim(f[5], ' ') as alt_allele from u),
z as (select p.*, case when not good then 'quoting' when n is null or n <> 5 then 'columns'
             when regexp_matches(snp, '[\\s\\x00-\\x1f\\x7f-\\x9f]') or c.chr is null or not regexp_matches(pos, '^[0-9]+$')
                  or try_cast(pos as hugeint) is null or try_cast(pos as hugeint) not between 1 and c.length_bp then 'value' end as reason
      from p left join chrom_list c on c.chr = p.chr)"""
SQL = {
    "p1_found": _P1,
    "p2_found": _P2 + " select tab, strftime(t, '%Y-%m') as period, rec_id from o",
    "p2_report": _P2 + """, r as (select tab, strftime(t, '%Y-%m') as period, count(*) n from (select * from c union all select * from m) where k is not null group by 1, 2),
q as (select tab, strftime(t, '%Y-%m') as period, count(*) n, count(distinct k) ks from o group by 1, 2)
select r.tab, r.period, r.n as n_references, coalesce(q.n, 0) as n_orphans, coalesce(ks, 0) as n_keys from r left join q on r.tab = q.tab and r.period is not distinct from q.period""",
    "p3_found": _FIELDS + " select line_id, reason from z where reason is not null",
    "p3_loaded": _FIELDS + " select line_id, snp, chr, cast(pos as integer) as pos, ref_allele, alt_allele from z where reason is null",
    "p5_found": f"select chr from (select {_CHR} as chr, count(*) n from snp_info group by 1) where chr is not null and n >= 0.05 * (select count(*) from snp_info)",
    "p5_profile": f"""
with b as (select {_CHR} as chr, pos from snp_info),
w as (select chr, pos, count(*) w from b group by all),
n as (select chr, sum(w)::bigint as n_rows, coalesce(sum(w) filter (pos is not null), 0)::bigint as n_values, count(pos) as n_distinct, max(w) filter (pos is not null) as mode_count from w group by 1),
o as (select chr, pos, row_number() over (partition by chr order by pos) r, count(*) over (partition by chr) t from b where pos is not null),
q as (select chr, min(pos) filter (r >= greatest(1, ceil(0.25 * t))) as p25, min(pos) filter (r >= greatest(1, ceil(0.5 * t))) as p50, min(pos) filter (r >= greatest(1, ceil(0.75 * t))) as p75 from o group by 1),
m as (select w.chr, min(pos) as mode_value from w join n on w.chr is not distinct from n.chr and w.w = n.mode_count where pos is not null group by 1)
select n.chr, n_rows, n_values, n_distinct, mode_value, mode_count, p25, p50, p75
from n left join q on n.chr is not distinct from q.chr left join m on n.chr is not distinct from m.chr""",
}
