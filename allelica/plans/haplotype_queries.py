"""Queries of quality control and haplotypes on the derived genotypes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelica.operators import haplotypes as H
from allelica.operators import qc
from allelica.plans import fixtures as X
from allelica.plans.fixtures import BLOCK_SQL, GENO_SQL, HAP_SQL, REAL_CALL_SQL, REAL_SNP_SQL, real_block_sql


def _haps(spark, d):
    return H.extract(X.geno(spark, d), X.blocks(spark, d))


def _haps_with_group(spark, d):
    g = X.geno(spark, d).select("sample_id", "grp").distinct()
    return _haps(spark, d).join(g, "sample_id")


def qc_call_rate(spark, d):
    return qc.variant_stats(X.real_calls(spark, d)).select("chr", "pos", "snp", "n_samples", "n_obs", F.round("call_rate", 6).alias("call_rate"))


def qc_maf(spark, d):
    return qc.maf_filter(X.real_calls(spark, d)).select("snp", "n0", "n1", "n2", F.round("maf", 6).alias("maf"))


def _imputed(method):
    def run(spark, d):
        return qc.impute(X.real_calls(spark, d), 0.9, method).groupBy("snp").agg(F.sum("dosage").alias("sum_dosage"), F.count_if("imputed").alias("n_imputed"))

    return run


def qc_sample_stats(spark, d):
    return qc.sample_stats(X.real_calls(spark, d)).select("sample_id", "n_snps", "n_obs", F.round("heterozygosity", 6).alias("heterozygosity"))


def block_snp_ranges(spark, d):
    return H.block_ranges(X.real_snps(spark, d), X.real_blocks(spark, d))


def hap_extract(spark, d):
    return _haps(spark, d).select("block_id", "sample_id", "hap")


def hap_diversity(spark, d):
    r = H.diversity(_haps(spark, d))
    return r.select("block_id", "chr", "start_bp", "end_bp", "n_snps", "n_ind", "n_haplotypes", F.round("he", 6).alias("he"), F.round("shannon", 6).alias("shannon"), "n_eff_alleles", F.round("freq_dominant", 6).alias("freq_dominant"), "sweep_flag")


def hap_diversity_genome(spark, d):
    r = H.with_genome_row(H.diversity(_haps(spark, d))).where("block_id = 'GENOME'")
    return r.select("block_id", F.round("he", 5).alias("he"), F.round("shannon", 5).alias("shannon"), F.round("n_haplotypes", 4).alias("n_haplotypes"))


def hap_topn_alleles(spark, d):
    return H.alleles(_haps(spark, d), 0.01, 5).select("block_id", "hap", "n", "hap_rank", F.round("freq", 6).alias("freq"), F.round("freq_kept", 6).alias("freq_kept"))


def _features(encoding):
    def run(spark, d):
        h = _haps(spark, d)
        return H.features(h, H.alleles(h, 0.02), encoding).where("dose is not null").select("sample_id", "hap_id", "dose")

    return run


def hap_features_scaled(spark, d):
    h = _haps(spark, d)
    z = H.scaled(H.features(h, H.alleles(h, 0.02)))
    return z.groupBy("hap_id").agg(F.round(F.sum(F.col("z") * F.col("z")), 4).alias("ss"), F.count(F.lit(1)).alias("n"))


def hap_grm(spark, d):
    h = _haps(spark, d)
    g = H.relationship(H.features(h, H.alleles(h, 0.02)))
    return g.select("sample_i", "sample_j", F.round("g", 6).alias("g"))


def hap_decode_iupac(spark, d):
    return H.decode(H.alleles(_haps(spark, d), 0.01), X.snps(spark, d)).select("block_id", "hap", "hap_rank", "nucleotide_sequence", "snp_positions", "snp_alleles")


def hap_collapse_other(spark, d):
    return H.collapse(_haps(spark, d), 0.05, "rare_to_other").groupBy("block_id", "collapsed").agg(F.count(F.lit(1)).alias("n"))


def hap_collapse_nearest(spark, d):
    return H.collapse(_haps(spark, d), 0.05, "nearest").groupBy("block_id", "collapsed").agg(F.count(F.lit(1)).alias("n"))


def hap_collapse_tree(spark, d):
    return H.collapse(_haps(spark, d), 0.05, "tree_based").groupBy("block_id", "collapsed").agg(F.count(F.lit(1)).alias("n"))


def hap_harmonize(spark, d):
    h = _haps_with_group(spark, d)
    return H.harmonize_report(H.harmonize(h.where("grp < 3"), h.where("grp >= 3"))).withColumn("mean_hamming_dist", F.round("mean_hamming_dist", 6))


def hap_windows(spark, d):
    return H.windows(X.geno(spark, d), 20000, 10000, 5)


def hap_fst(spark, d):
    r = H.compare_populations(_haps_with_group(spark, d), "grp", 0, 1, permutations=0)
    return r.select("block_id", "n1", "n2", "n_alleles", F.round("fst_simple", 6).alias("fst_simple"), F.round("max_freq_diff", 6).alias("max_freq_diff"), "dominant_g1", "dominant_g2")


def hap_population_test(spark, d):
    return H.compare_populations(_haps_with_group(spark, d), "grp", 0, 1)


def hap_network(spark, d):
    return H.network(_haps(spark, d))


def _phased(spark, d):
    g = X.geno(spark, d)
    return g.withColumn("a1", F.floor(F.col("dosage") / 2).cast("int")).withColumn("a2", (F.col("dosage") - F.floor(F.col("dosage") / 2)).cast("int"))


def hap_diversity_phased(spark, d):
    r = H.diversity(H.extract_phased(_phased(spark, d), X.blocks(spark, d)), phased=True)
    return r.select("block_id", "n_haplotypes", F.round("he", 6).alias("he"), F.round("freq_dominant", 6).alias("freq_dominant"))


def diplotype_phased(spark, d):
    g = H.diplotypes_phased(H.as_pairs(H.extract_phased(_phased(spark, d), X.blocks(spark, d))))
    return g.where("not missing").select("block_id", "id", "hap1", "hap2", "diplotype", "heterozygous")


def diplotype_unphased(spark, d):
    return H.diplotypes_unphased(_haps(spark, d))


QUERIES = {f.__name__: f for f in (qc_call_rate, qc_maf, qc_sample_stats, block_snp_ranges, hap_extract, hap_diversity, hap_diversity_genome, hap_topn_alleles, hap_features_scaled, hap_grm, hap_decode_iupac, hap_collapse_other, hap_collapse_nearest, hap_collapse_tree, hap_harmonize, hap_windows, hap_fst, hap_population_test, hap_network, hap_diversity_phased, diplotype_phased, diplotype_unphased)} | {
    "qc_impute_mean": _imputed("mean_rounded"), "qc_impute_mode": _imputed("mode"), "hap_features": _features("additive_012"), "hap_presence": _features("presence_01"),
}

_STAT = """st as (select chr, pos, snp, count(*) n_samples, count(dosage) n_obs, count(*) filter (dosage = 0) n0, count(*) filter (dosage = 1) n1, count(*) filter (dosage = 2) n2, sum(dosage) s from geno group by all)"""
_MEAN = "least(greatest(floor(s::double / n_obs + 0.5), 0), 2)"
_MODE = f"case when n0 > n1 and n0 > n2 then 0 when n1 > n0 and n1 > n2 then 1 when n2 > n0 and n2 > n1 then 2 else {_MEAN} end"


def _imp(fill):
    return f"with {REAL_CALL_SQL}, {_STAT}, f as (select snp, {fill} as fill from st where n_obs::double / n_samples >= 0.9) select g.snp, sum(coalesce(dosage, fill))::bigint as sum_dosage, count(*) filter (dosage is null) as n_imputed from geno g join f on g.snp = f.snp group by 1"


_DIV = """div as (select block_id, chr, start_bp, end_bp, 8::bigint as n_snps, sum(n)::bigint as n_ind, count(*) as n_haplotypes, sum(n) / (sum(n) - 1) * (1 - sum(freq * freq)) as he, -sum(freq * ln(freq)) as shannon,
  round(1 / sum(freq * freq), 3) as n_eff_alleles, max(freq) as freq_dominant from frq group by all)"""
_FEAT = """kept as (select *, block_id || '_hap' || hap_rank as hap_id from frq where freq >= 0.02),
feat as (select sample_id, h.block_id, hap_id, case when not contains(h.hap, '.') then (h.hap = k.hap)::int end as dose from hap h join kept k on h.block_id = k.block_id)"""
_GAM = f"""{GENO_SQL}, {BLOCK_SQL},
gam as (select block_id, sample_id, c, string_agg(coalesce(case c when 1 then dosage // 2 else dosage - dosage // 2 end::varchar, '.'), '' order by pos) as g from geno x join blocks b on x.chr = b.chr and pos between start_bp and end_bp, (values (1), (2)) v(c) group by all)"""
_IUPAC = "case substr(hap, i, 1) when '0' then ref_allele when '2' then alt_allele when '1' then coalesce(map {'AG': 'R', 'CT': 'Y', 'CG': 'S', 'AT': 'W', 'GT': 'K', 'AC': 'M'}[least(ref_allele, alt_allele) || greatest(ref_allele, alt_allele)], 'N') else 'N' end"
SQL = {
    "qc_call_rate": f"with {REAL_CALL_SQL}, {_STAT} select chr, pos, snp, n_samples, n_obs, round(n_obs::double / n_samples, 6) as call_rate from st",
    "qc_maf": f"with {REAL_CALL_SQL}, {_STAT}, m as (select *, least(s::double / (2 * n_obs), 1 - s::double / (2 * n_obs)) maf from st) select snp, n0, n1, n2, round(maf, 6) as maf from m where maf >= 0.05 and (n0 > 0)::int + (n1 > 0)::int + (n2 > 0)::int > 1",
    "qc_impute_mean": _imp(_MEAN), "qc_impute_mode": _imp(_MODE),
    "qc_sample_stats": f"with {REAL_CALL_SQL} select sample_id, count(*) as n_snps, count(dosage) as n_obs, round(count(*) filter (dosage = 1)::double / count(dosage), 6) as heterozygosity from geno group by 1",
    "block_snp_ranges": f"with {REAL_SNP_SQL}, {real_block_sql()} select block_id, min(pos) as first_pos, max(pos) as last_pos, count(*) as n_snps from snps s join blocks b on s.chr = b.chr and pos between start_bp and end_bp group by 1",
    "hap_extract": f"with {HAP_SQL} select block_id, sample_id, hap from hap",
    "hap_diversity": f"with {HAP_SQL}, {_DIV} select block_id, chr, start_bp, end_bp, n_snps, n_ind, n_haplotypes, round(he, 6) as he, round(shannon, 6) as shannon, n_eff_alleles, round(freq_dominant, 6) as freq_dominant, freq_dominant >= 0.9 as sweep_flag from div",
    "hap_diversity_genome": f"with {HAP_SQL}, {_DIV} select 'GENOME' as block_id, round(avg(he), 5) as he, round(avg(shannon), 5) as shannon, round(avg(n_haplotypes), 4) as n_haplotypes from div",
    "hap_topn_alleles": f"with {HAP_SQL}, k as (select * from frq where freq >= 0.01 and hap_rank <= 5) select block_id, hap, n, hap_rank::int as hap_rank, round(freq, 6) as freq, round(n::double / sum(n) over (partition by block_id), 6) as freq_kept from k",
    "hap_features": f"with {HAP_SQL}, {_FEAT} select sample_id, hap_id, dose from feat where dose is not null", "hap_presence": f"with {HAP_SQL}, {_FEAT} select sample_id, hap_id, least(dose, 1) as dose from feat where dose is not null",
    "hap_features_scaled": f"with {HAP_SQL}, {_FEAT}, s as (select *, avg(dose) over (partition by hap_id) m, stddev_samp(dose) over (partition by hap_id) sd from feat), z as (select hap_id, coalesce(case when sd > 0 then (dose - m) / sd end, 0) z from s) select hap_id, round(sum(z * z), 4) as ss, count(*) as n from z group by 1",
    "hap_grm": f"with {HAP_SQL}, {_FEAT}, f2 as (select * from feat), m as (select hap_id, avg(dose) mn from f2 group by 1 having min(dose) < max(dose)), z as (select sample_id, f2.hap_id, coalesce(dose, mn) - mn as z from f2 join m on f2.hap_id = m.hap_id), dn as (select 2 * sum(mn * (1 - mn)) dn from m) select a.sample_id as sample_i, b.sample_id as sample_j, round(sum(a.z * b.z) / any_value(dn), 6) as g from z a join z b on a.hap_id = b.hap_id and a.sample_id <= b.sample_id, dn group by 1, 2",
    "hap_decode_iupac": f"with {HAP_SQL}, k as (select * from frq where freq >= 0.01), v as (select block_id, s.*, row_number() over (partition by block_id order by pos) i from snps s join blocks b on s.chr = b.chr and pos between start_bp and end_bp) select k.block_id, hap, hap_rank::int as hap_rank, string_agg({_IUPAC}, '' order by i) as nucleotide_sequence, string_agg(pos::varchar, ';' order by i) as snp_positions, string_agg(ref_allele || '/' || alt_allele, ';' order by i) as snp_alleles from k join v on k.block_id = v.block_id group by 1, 2, 3",
    "hap_collapse_other": f"with {HAP_SQL} select h.block_id, case when freq <= 0.05 then '<other>' else h.hap end as collapsed, count(*) as n from hap h left join frq f on h.block_id = f.block_id and h.hap = f.hap group by 1, 2",
    "hap_collapse_nearest": f"with {HAP_SQL}, m as (select r.block_id, r.hap, c.hap as c, row_number() over (partition by r.block_id, r.hap order by hamming(r.hap, c.hap), c.n desc, c.hap) k from frq r join frq c on r.block_id = c.block_id and r.freq <= 0.05 and c.freq > 0.05) select h.block_id, coalesce(m.c, h.hap) as collapsed, count(*) as n from hap h left join m on h.block_id = m.block_id and h.hap = m.hap and k = 1 group by 1, 2",
    "hap_harmonize": f"with {HAP_SQL}, r0 as (select block_id, hap, count(*) n from hap where grp >= 3 and not contains(hap, '.') group by all), r as (select * from (select *, n::double / sum(n) over (partition by block_id) f from r0) where f >= 0.02), t as (select distinct block_id, hap from hap where grp < 3 and not contains(hap, '.')), b as (select t.block_id, t.hap, min(hamming(t.hap, r.hap)) dd from t left join r on t.block_id = r.block_id group by all), o as (select h.block_id, case when dd = 0 then 'exact' when dd <= 1 then 'nearest' else 'novel' end how, dd from hap h join b on h.block_id = b.block_id and h.hap = b.hap where grp < 3) select block_id, count(*) filter (how = 'exact') as n_exact, count(*) filter (how = 'nearest') as n_nearest, count(*) filter (how = 'novel') as n_novel, round(avg(dd) filter (how = 'nearest'), 6) as mean_hamming_dist from o group by 1",
    "hap_windows": f"with {GENO_SQL}, e as (select chr, min(pos) lo, max(pos) hi from geno group by 1), w as (select chr, unnest(range(lo, hi + 1, 10000))::int as ws from e), v as (select w.chr, ws, count(*) n_snps from w join snps s on s.chr = w.chr and pos between ws and ws + 19999 group by all having count(*) >= 5), h as (select v.chr, ws, n_snps, sample_id, string_agg(coalesce(dosage::varchar, '.'), '' order by pos) hap from v join geno g on g.chr = v.chr and pos between ws and ws + 19999 group by all), c as (select chr, ws, n_snps, hap, count(*) n from h where not contains(hap, '.') group by all), p as (select *, n::double / sum(n) over (partition by chr, ws) p from c) select chr, ws as win_start, ws + 19999 as win_end, ws + 9999.5::double as win_mid, n_snps, sum(n)::bigint as n_ind, count(*) as n_haplotypes, round(sum(n) / (sum(n) - 1) * (1 - sum(p * p)), 4) as he, round(-sum(p * ln(p)), 4) as shannon, round(1 / sum(p * p), 3) as n_eff_alleles, round(max(p), 4) as freq_dominant, max(p) >= 0.9 as sweep_flag from p group by chr, ws, n_snps having sum(n) >= 2",
    "hap_fst": f"with {HAP_SQL}, c as (select block_id, hap, count(*) filter (grp = 0) c1, count(*) filter (grp = 1) c2 from hap where grp in (0, 1) and not contains(hap, '.') group by all), f as (select *, sum(c1) over (partition by block_id) n1, sum(c2) over (partition by block_id) n2 from c), r as (select *, coalesce(c1::double / nullif(n1, 0) < 0.02, true) and coalesce(c2::double / nullif(n2, 0) < 0.02, true) as rare from f), s as (select *, min(rare::int) over (partition by block_id) all_rare from r), a as (select block_id, n1, n2, case when rare and all_rare = 0 then 'other' else hap end allele, sum(c1) c1, sum(c2) c2 from s group by all), q as (select *, c1::double / n1 f1, c2::double / n2 f2, (c1 + c2)::double / (n1 + n2) p from a where n1 > 1 and n2 > 1), u as (select *, (n1 * (f1 - p) ^ 2 + n2 * (f2 - p) ^ 2) / (n1 + n2 - 1) s2 from q) select block_id, n1::bigint as n1, n2::bigint as n2, count(*) as n_alleles, round(least(greatest(avg(case when p * (1 - p) <> 0 then s2 / (p * (1 - p)) else 0 end), 0), 1), 6) as fst_simple, round(max(abs(f1 - f2)), 6) as max_freq_diff, first(allele order by c1 desc, allele) as dominant_g1, first(allele order by c2 desc, allele) as dominant_g2 from u group by block_id, n1, n2 union all select distinct block_id, n1::bigint, n2::bigint, null, null, null, null, null from a where n1 < 2 or n2 < 2",
    "hap_diversity_phased": f"with {_GAM}, c as (select block_id, g, count(*) n from gam where not contains(g, '.') group by all), p as (select *, n::double / sum(n) over (partition by block_id) p from c) select block_id, count(*) as n_haplotypes, round(sum(n) / (sum(n) - 1) * (1 - sum(p * p)), 6) as he, round(max(p), 6) as freq_dominant from p group by 1",
    "diplotype_phased": f"with {_GAM}, p as (select block_id, sample_id as id, max(g) filter (c = 1) g1, max(g) filter (c = 2) g2 from gam group by all), m as (select *, contains(g1, '.') or contains(g2, '.') as missing from p) select block_id, id, case when not missing then least(g1, g2) end as hap1, case when not missing then greatest(g1, g2) end as hap2, case when not missing then least(g1, g2) || '/' || greatest(g1, g2) end as diplotype, case when not missing then g1 <> g2 end as heterozygous from m where not missing",
}
