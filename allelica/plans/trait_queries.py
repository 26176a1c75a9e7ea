"""Queries of association results, prediction, association tests and interactions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelica.functions.keys import materialize
from allelica.operators import association as A
from allelica.operators import gwas as G
from allelica.operators import haplotypes as H
from allelica.operators import prediction as P
from allelica.operators import relational as R
from allelica.plans import fixtures as X
from allelica.plans.fixtures import BLOCK_SQL, GENO_SQL, GWAS_SQL, HAP_SQL, PHENO_SQL, REAL_GWAS_SQL, REAL_SNP_SQL, real_block_sql
from allelica.plans.haplotype_queries import _DIV, _FEAT, _GAM, _haps, _phased


def _decay(spark):
    # a list of Python would start a Python worker per core
    return spark.sql("values ('1', 60000D), ('GENOME', 20000D) as (chr, decay_dist_bp)")


def _panel_regions(spark, d):
    return G.qtl_regions(X.gwas(spark, d), X.blocks(spark, d), X.snps(spark, d), 2e-7, 3)


def _regions(spark, d, decay=True, of=G.qtl_regions):
    return of(X.real_gwas(spark, d), X.real_blocks(spark, d), X.real_snps(spark, d), 1e-4, 3, _decay(spark) if decay else None)


_REGION = ["block_id", "search_start", "search_end", "n_snps_block", "n_sig_markers", "lead_marker", "lead_p", "candidate_region_start", "candidate_region_end", "lead_beta", "sig_markers", "traits", "n_traits", "pleiotropic"]


def qtl_regions(spark, d):
    return _regions(spark, d, False).select(*_REGION)


def qtl_regions_decay(spark, d):
    return _regions(spark, d).select(*_REGION)


def qtl_primary_hits(spark, d):
    return G.primary_hits(_regions(spark, d)).select("block_id", "lead_marker", "n_sig_blocks_in_window", "is_primary_hit")


def export_bed(spark, d):
    return G.export_bed(_regions(spark, d, of=G.lead_regions), 500)


def _local(spark, d):
    return P.local_gebv(X.geno(spark, d), X.blocks(spark, d), X.snps(spark, d).select("snp", "effect"))


def local_gebv(spark, d):
    return _local(spark, d).select("block_id", "sample_id", (F.round("local_gebv", 6) + 0.0).alias("local_gebv"))


def block_importance(spark, d):
    return P.block_importance(_local(spark, d)).select("block_id", "n_snps", F.round("var_local_gebv", 6).alias("var_local_gebv"), F.round("var_scaled", 6).alias("var_scaled"), "important")


def rank_blocks(spark, d):
    r = G.rank_blocks(H.diversity(_haps(spark, d)), _panel_regions(spark, d), P.block_importance(_local(spark, d)))
    return r.select("block_id", "use_case", "has_gwas_hit", "is_diverse", F.round("rank_score", 6).alias("rank_score"))


def rank_blocks_diversity(spark, d):
    return G.rank_blocks(H.diversity(_haps(spark, d)), top=5).select("block_id", F.round("rank_score", 6).alias("rank_score"))


def integrate_priority(spark, d):
    r = G.integrate(_panel_regions(spark, d), P.block_importance(_local(spark, d)), H.diversity(_haps(spark, d)))
    return r.select("block_id", "has_gwas_hit", "is_important", "is_diverse", "priority_score", "recommendation")


def _kept(spark, d):
    return H.alleles(_haps(spark, d), 0.02)


def decompose_effects(spark, d):
    e = P.allele_effects(_kept(spark, d), X.snps(spark, d), X.snps(spark, d).select("snp", "effect"))
    return e.select("block_id", "allele", F.round("frequency", 6).alias("frequency"), F.round("allele_effect", 6).alias("allele_effect"), "effect_rank")


def _effects(spark, d):
    return P.allele_effects(_kept(spark, d), X.snps(spark, d), X.snps(spark, d).select("snp", "effect"))


def stacking_index(spark, d):
    s = P.stacking(_haps(spark, d), _effects(spark, d))
    return s.select("id", (F.round("stacking_index", 6) + 0.0).alias("stacking_index"), "n_blocks_scored", (F.round("mean_block_score", 6) + 0.0).alias("mean_block_score"))


def parent_inventory(spark, d):
    c = X.geno(spark, d).select(F.col("sample_id").alias("id")).distinct()
    i = P.parent_inventory(_haps(spark, d), c, _kept(spark, d), _effects(spark, d))
    return i.where("dosage is not null").select("id", "block_id", "allele", "dosage", F.round("allele_freq", 6).alias("allele_freq"), F.round("allele_effect", 6).alias("allele_effect"), "is_rare")


def _feat(spark, d):
    h = _haps(spark, d)
    return H.features(h, H.alleles(h, 0.02))


def wald_scan(spark, d):
    w = A.wald_scan(_feat(spark, d), X.pheno(spark, d), pvalues=False)
    return w.select("trait", "hap_id", "n", F.round("effect", 6).alias("effect"), F.round("se", 6).alias("se"), F.round("t_stat", 5).alias("t_stat"))


def bh_fdr(spark, d):
    return R.bh_adjust(X.real_gwas(spark, d), "p", "p_fdr", ["trait"]).select("rec_id", "trait", F.round("p_fdr", 9).alias("p_fdr"))


def bonferroni(spark, d):
    meff = spark.createDataFrame([(100,), (23,)], "meff int")
    t = A.adjusted(X.real_gwas(spark, d).where("trait is not null"), meff, "p")
    return t.select("rec_id", *[F.round(c, 9).alias(c) for c in ("p_bonf", "p_simplem", "p_simplem_sidak", "p_fdr")], "significant")


def _dips(spark, d):
    return H.diplotypes_phased(H.as_pairs(H.extract_phased(_phased(spark, d), X.blocks(spark, d))))


def diplotype_means(spark, d):
    m = A.diplotype_means(_dips(spark, d), X.pheno(spark, d))
    return m.select("block_id", "trait", "diplotype", "n", "n_total", F.round("mean_blue", 10).alias("mean_blue"), F.round("se_mean", 8).alias("se_mean"))


def dominance_table(spark, d):
    t = A.dominance(A.diplotype_means(_dips(spark, d), X.pheno(spark, d)))
    return t.select("block_id", "trait", "allele_a", "allele_b", *[F.round(c, 10).alias(c) for c in ("mean_aa", "mean_ab", "mean_bb", "a", "d")], "overdominance")


def diplotype_anova(spark, d):
    a = A.diplotype_anova(_dips(spark, d), X.pheno(spark, d), pvalues=False)
    return a.select("block_id", "trait", "n_diplotypes", F.round("f_stat", 5).alias("f_stat"), "df1", "df2")


def diplotype_omnibus(spark, d):
    return A.diplotype_anova(_dips(spark, d), X.pheno(spark, d))


def _pop_effects(spark, d, which):
    h = H.extract(X.geno(spark, d).where("grp < 5" if which == 0 else "grp >= 5"), X.blocks(spark, d))
    k = H.alleles(h, 0.02)
    w = A.wald_scan(H.features(h, k), X.pheno(spark, d), pvalues=False)
    return w.join(k.select(F.col("hap_id").alias("_h"), F.col("hap").alias("allele")), F.col("hap_id") == F.col("_h")).select("block_id", "trait", "allele", "effect", "se")


def concordance_ivw(spark, d):
    c = G.compare_effects(_pop_effects(spark, d, 0), _pop_effects(spark, d, 1), pvalues=False)
    return c.select("block_id", "trait", "n_alleles_pop1", "n_alleles_pop2", "n_shared_alleles", F.round("direction_agreement", 6).alias("direction_agreement"), *[F.round(x, 4).alias(x) for x in ("meta_effect", "meta_se", "q_stat", "i2")], F.coalesce("q_df", F.lit(-1)).alias("q_df"))


def concordance_full(spark, d):
    return G.compare_effects(_pop_effects(spark, d, 0), _pop_effects(spark, d, 1), X.blocks(spark, d), X.blocks(spark, d))


def concordance_gwas(spark, d):
    a = G.qtl_regions(X.gwas(spark, d), X.blocks(spark, d), X.snps(spark, d), 5e-7)
    b = G.qtl_regions(X.gwas(spark, d).withColumn("beta", F.col("beta") * 0.85 + 0.01), X.blocks(spark, d), X.snps(spark, d), 5e-7)
    return G.compare_gwas(a, b)


def _env(spark, d):
    """Four environments, each with a quarter of the samples."""
    y = X.pheno(spark, d).where("trait = 'YLD'").withColumn("env", F.concat(F.lit("env"), F.expr("try_cast(substring(sample_id, 4) as int) % 4")))
    return y.where("env is not null").select("env", "sample_id", "y")


def stability_fw(spark, d):
    e = _env(spark, d)
    loc = _local(spark, d).join(e.select("env", "sample_id"), "sample_id")
    s = P.stability(loc, e)
    return s.select("block_id", "n", *[F.round(c, 5).alias(c) for c in ("b", "r2_fw", "s2d", "b_se")])


def stability_tests(spark, d):
    e = _env(spark, d)
    return P.stability(_local(spark, d).join(e.select("env", "sample_id"), "sample_id"), e)


def _grm(spark, d):
    return materialize(H.relationship(_feat(spark, d)), "grm")


def gblup(spark, d):
    return P.gblup(_grm(spark, d), X.pheno(spark, d))


def cv_prediction(spark, d):
    return P.cv_means(P.cross_validate(_grm(spark, d), X.pheno(spark, d), 5, 1))


def backsolved_effects(spark, d):
    g = _grm(spark, d)
    u = P.gblup(g, X.pheno(spark, d).where("trait = 'YLD'"))
    return P.backsolve(X.geno(spark, d), u, g)


def block_omnibus(spark, d):
    return A.block_tests(_feat(spark, d), A.residuals(X.pheno(spark, d), _grm(spark, d)))


def allele_tests(spark, d):
    f = _feat(spark, d)
    return A.adjusted(A.wald_scan(f, A.residuals(X.pheno(spark, d), _grm(spark, d))), A.effective_tests(f))


def _block_tests(spark, d):
    return A.test_blocks(_haps(spark, d), X.pheno(spark, d), n_pcs=None, metric="p_simplem", scope="chromosome", pcs_most=2)


def block_haplotype_alleles(spark, d):
    return _block_tests(spark, d).alleles


def block_haplotype_blocks(spark, d):
    return _block_tests(spark, d).blocks


def pc_model_selection(spark, d):
    return A.pc_selection(X.pheno(spark, d), _grm(spark, d), 5)


def effective_tests(spark, d):
    return A.effective_tests(_feat(spark, d))


def qq_data(spark, d):
    q = A.qq_table(A.wald_scan(_feat(spark, d), X.pheno(spark, d)))
    return q.select("trait", "hap_id", F.round("expected", 9).alias("expected"), F.round("lambda_gc", 6).alias("lambda_gc"))


def block_epistasis(spark, d):
    return A.block_epistasis(X.geno(spark, d), X.blocks(spark, d), X.pheno(spark, d).where("trait = 'YLD'"))


def block_by_block_epistasis(spark, d):
    f = _feat(spark, d)
    return A.block_by_block(f, X.pheno(spark, d).where("trait = 'YLD'"), f.where("hap_id like '%_hap1'"))


def fine_map_lasso(spark, d):
    return A.fine_map(X.geno(spark, d), ("1", 1000, 8000), X.pheno(spark, d).where("trait = 'YLD'"), "lasso")


QUERIES = {f.__name__: f for f in (qtl_regions, qtl_regions_decay, qtl_primary_hits, export_bed, local_gebv, block_importance, rank_blocks, rank_blocks_diversity, integrate_priority, decompose_effects, stacking_index, parent_inventory, wald_scan, bh_fdr, bonferroni, diplotype_means, dominance_table, diplotype_anova, diplotype_omnibus, concordance_ivw, concordance_full, concordance_gwas, stability_fw, stability_tests, gblup, cv_prediction, backsolved_effects, block_omnibus, allele_tests, block_haplotype_alleles, block_haplotype_blocks, pc_model_selection, effective_tests, qq_data, block_epistasis, block_by_block_epistasis, fine_map_lasso)}


def _reg(ext: str) -> str:
    return f"""{REAL_SNP_SQL}, {REAL_GWAS_SQL}, {real_block_sql('blocks0')},
bn as (select b.block_id, count(*) as nb from blocks0 b join snps s on s.chr = b.chr and s.pos between b.start_bp and b.end_bp group by 1 having count(*) >= 3),
bx as (select b.*, nb, ({ext})::int as ext from blocks0 b join bn on bn.block_id = b.block_id),
hit as (select b.block_id, b.chr, start_bp, end_bp, ext, nb, g.snp, g.pos, g.p, g.beta, g.trait from bx b join gwas g on g.chr = b.chr and g.pos between start_bp - ext and end_bp + ext where p <= 1e-4),
mk as (select block_id, string_agg(snp, ';' order by pos, snp, beta nulls first) as sig_markers from (select distinct block_id, pos, snp, beta from hit) group by 1),
reg as (select h.block_id, chr, start_bp, end_bp, ext, start_bp - ext as search_start, end_bp + ext as search_end, nb as n_snps_block, count(distinct snp) as n_sig_markers, (list({{'s': snp, 'p': pos, 'b': beta}} order by p, pos, snp nulls first, beta nulls first))[1] as ld, min(p) as lead_p,
  coalesce(any_value(sig_markers), '') as sig_markers, array_to_string(list_sort(list_distinct(list(trait) filter (trait is not null))), ',') as traits, count(distinct trait)::int as n_traits from hit h left join mk on mk.block_id = h.block_id group by all),
rg as (select *, ld.s as lead_marker, ld.p as lead_pos, ld.b as lead_beta from reg)"""


_REG0 = _reg("0")
_REGSEL = "select block_id, search_start, search_end, n_snps_block, n_sig_markers, lead_marker, lead_p, greatest(lead_pos - ext, 1) as candidate_region_start, lead_pos + ext as candidate_region_end, lead_beta, sig_markers, traits, n_traits, n_traits > 1 as pleiotropic from rg"
_EXT = "case when chr = '1' then 60000 else 20000 end"
_LOC = f"{GENO_SQL}, {BLOCK_SQL}, loc as (select block_id, b.chr, start_bp, end_bp, sample_id, coalesce(sum((dosage - 1) * effect), 0) as v from geno g join snps s on g.snp = s.snp join blocks b on g.chr = b.chr and g.pos between start_bp and end_bp group by all)"
_IMP = "imp0 as (select block_id, 8::bigint as n_snps, var_samp(v) as vv from loc group by 1), imp as (select *, vv / max(vv) over () as vs from imp0)"
_EFF = f"""{HAP_SQL}, kept as (select * from frq where freq >= 0.02), v as (select block_id, effect, row_number() over (partition by block_id order by pos) i from snps s join blocks b on s.chr = b.chr and pos between start_bp and end_bp),
eff as (select k.block_id, hap as allele, any_value(freq) as frequency, sum(substr(hap, i::int, 1)::double * effect) as allele_effect from kept k join v on k.block_id = v.block_id group by 1, 2)"""
_Y = "y as (select trait, sample_id, avg(y) as y from pheno where y is not null group by 1, 2)"


def _wald(where: str, name: str) -> str:
    return f"""h{name} as (select block_id, chr, start_bp, end_bp, sample_id, hap from hap where {where}), c{name} as (select block_id, hap, count(*) n from h{name} where not contains(hap, '.') group by all),
k{name} as (select * from (select *, n::double / sum(n) over (partition by block_id) f, row_number() over (partition by block_id order by n desc, hap) r from c{name}) where f >= 0.02),
d{name} as (select h.sample_id, k.block_id, k.hap as allele, k.block_id || '_hap' || k.r as hap_id, case when not contains(h.hap, '.') then (h.hap = k.hap)::int end as dose from h{name} h join k{name} k on h.block_id = k.block_id),
j{name} as (select d.*, trait, y, coalesce(dose, avg(dose) over (partition by hap_id, trait)) as x from d{name} d join y on d.sample_id = y.sample_id),
w{name} as (select trait, block_id, allele, hap_id, count(*) n, sum(x * x) - sum(x) * sum(x) / count(*) xx, sum(x * y) - sum(x) * sum(y) / count(*) xy, sum(y * y) - sum(y) * sum(y) / count(*) ss from j{name} group by all having sum(x * x) - sum(x) * sum(x) / count(*) > 1e-10),
t{name} as (select *, xy / xx as effect, sqrt(greatest(ss - xy * xy / xx, 0) / (n - 2) / xx) as se from w{name})"""


_DIP = f"{_GAM}, {PHENO_SQL}, {_Y}, p as (select block_id, sample_id, max(g) filter (c = 1) g1, max(g) filter (c = 2) g2 from gam group by all), dp as (select block_id, sample_id, least(g1, g2) h1, greatest(g1, g2) h2, least(g1, g2) || '/' || greatest(g1, g2) as diplotype from p where not contains(g1, '.') and not contains(g2, '.')), dm0 as (select block_id, trait, h1, h2, diplotype, count(*) n, avg(y) m, stddev_samp(y) / sqrt(count(*)) se, sum(y) s, sum(y * y) ss from dp join y on dp.sample_id = y.sample_id group by all), dm as (select * from (select *, sum(n) over (partition by block_id, trait) nt from dm0) where n >= 3)"
SQL = {
    "qtl_regions": f"with {_reg('0')} {_REGSEL}", "qtl_regions_decay": f"with {_reg(_EXT)} {_REGSEL}",
    "export_bed": f"with {_reg(_EXT)} select 'chr' || chr as chrom, greatest(0, greatest(lead_pos - ext, 1) - 1 - 500)::int as start, (lead_pos + ext + 500)::int as \"end\", block_id as name, least(1000, round(-log10(lead_p) * 10))::int as score, '.' as strand from rg",
    "qtl_primary_hits": f"with {_reg(_EXT)}, m as (select *, abs((start_bp + end_bp) / 2.0::double - (greatest(lead_pos - ext, 1) + lead_pos + ext) / 2.0::double) as away from rg) select block_id, lead_marker, count(*) over (partition by chr, lead_marker) as n_sig_blocks_in_window, row_number() over (partition by chr, lead_marker order by away, block_id) = 1 as is_primary_hit from m",
    "local_gebv": f"with {_LOC} select block_id, sample_id, round(v, 6) + 0.0::double as local_gebv from loc",
    "block_importance": f"with {_LOC}, {_IMP} select block_id, n_snps, round(vv, 6) as var_local_gebv, round(vs, 6) as var_scaled, vs >= 0.9 as important from imp",
    "rank_blocks": f"with {HAP_SQL}, {_DIV}, {GWAS_SQL}, loc as (select block_id, sample_id, coalesce(sum((dosage - 1) * effect), 0) as v from geno g join snps s on g.snp = s.snp join blocks b on g.chr = b.chr and g.pos between start_bp and end_bp group by all), {_IMP}, q as (select distinct block_id from blocks b join gwas g on g.chr = b.chr and g.pos between start_bp and end_bp where p <= 2e-7) select d.block_id, 'phenotype' as use_case, q.block_id is not null as has_gwas_hit, he >= 0.3 as is_diverse, round(vs + 0.001 * (q.block_id is not null)::int + 0.001 * (he >= 0.3)::int, 6) as rank_score from div d join imp i on d.block_id = i.block_id left join q on q.block_id = d.block_id",
    "rank_blocks_diversity": f"with {HAP_SQL}, {_DIV} select block_id, round(he + n_eff_alleles / max(n_eff_alleles) over () / 10, 6) as rank_score from div order by he + n_eff_alleles / max(n_eff_alleles) over () / 10 desc, block_id limit 5",
    "integrate_priority": f"with {HAP_SQL}, {_DIV}, {GWAS_SQL}, loc as (select block_id, sample_id, coalesce(sum((dosage - 1) * effect), 0) as v from geno g join snps s on g.snp = s.snp join blocks b on g.chr = b.chr and g.pos between start_bp and end_bp group by all), {_IMP}, q as (select distinct block_id from blocks b join gwas g on g.chr = b.chr and g.pos between start_bp and end_bp where p <= 2e-7), e as (select d.block_id, q.block_id is not null g, vs >= 0.9 m, he >= 0.3 d from div d join imp i on d.block_id = i.block_id left join q on q.block_id = d.block_id) select block_id, g as has_gwas_hit, m as is_important, d as is_diverse, g::int + m::int + d::int as priority_score, case when g and m and d then 'all three lines of evidence' when g and m then 'association and prediction, little diversity' when g and d then 'association with diversity' when m and d then 'prediction with diversity' when g then 'association only' when m then 'prediction only' when d then 'diversity only' else 'none' end as recommendation from e",
    "decompose_effects": f"with {_EFF} select block_id, allele, round(frequency, 6) as frequency, round(allele_effect, 6) as allele_effect, (rank() over (partition by block_id order by round(allele_effect, 9) desc))::int as effect_rank from eff",
    "stacking_index": f"with {_EFF}, s as (select sample_id as id, h.block_id, coalesce(allele_effect, 0) as sc from hap h left join eff e on h.block_id = e.block_id and h.hap = e.allele where not contains(hap, '.')), t as (select id, sum(sc) t, count(*) n, avg(sc) m from s group by 1) select id, round((t - min(t) over ()) / (max(t) over () - min(t) over ()), 6) + 0.0::double as stacking_index, n as n_blocks_scored, round(m, 6) + 0.0::double as mean_block_score from t",
    "parent_inventory": f"with {_EFF} select sample_id as id, h.block_id, e.allele, (h.hap = e.allele)::int as dosage, round(frequency, 6) as allele_freq, round(allele_effect, 6) as allele_effect, frequency < 0.1 as is_rare from hap h join eff e on h.block_id = e.block_id where not contains(h.hap, '.')",
    "wald_scan": f"with {HAP_SQL}, {PHENO_SQL}, {_Y}, {_wald('true', '0')} select trait, hap_id, n, round(effect, 6) as effect, round(se, 6) as se, round(effect / se, 5) as t_stat from t0",
    "qq_data": f"with {HAP_SQL}, {PHENO_SQL}, {_Y}, {_wald('true', '0')}, t as (select trait, hap_id, effect / se as t from t0), r as (select *, row_number() over (partition by trait order by abs(t) desc) i, count(*) over (partition by trait) n, median(t * t) over (partition by trait) m from t) select trait, hap_id, round(-log10(i / (n + 1.0::double)), 9) as expected, round(m / 0.4549364231195724, 6) as lambda_gc from r",
    "bh_fdr": f"with {REAL_GWAS_SQL}, r as (select *, count(*) over (partition by trait) n, count(*) over (partition by trait order by p range unbounded preceding) k from gwas where p is not null), a as (select rec_id, least(1, min(p * n / k) over (partition by trait order by p desc range unbounded preceding)) as p_fdr from r) select g.rec_id, trait, round(p_fdr, 9) as p_fdr from gwas g left join a on a.rec_id = g.rec_id",
    "bonferroni": f"with {REAL_GWAS_SQL}, t as (select * from gwas where trait is not null), r as (select *, count(*) over () n, count(*) over (order by p range unbounded preceding) k from t where p is not null), a as (select rec_id, least(1, min(p * n / k) over (order by p desc range unbounded preceding)) as p_fdr from r) select t.rec_id, round(least(1.0::double, p * count(p) over (partition by trait)), 9) as p_bonf, round(least(1.0::double, p * 123), 9) as p_simplem, round(1 - pow(1 - p, 123), 9) as p_simplem_sidak, round(p_fdr, 9) as p_fdr, coalesce(p_fdr <= 0.05, false) as significant from t left join a on a.rec_id = t.rec_id",
    "diplotype_means": f"with {_DIP} select block_id, trait, diplotype, n, nt::bigint as n_total, round(m, 10) as mean_blue, round(se, 8) as se_mean from dm",
    "dominance_table": f"with {_DIP}, t as (select x.block_id, x.trait, x.h1 as allele_a, x.h2 as allele_b, a.m as aa, x.m as ab, b.m as bb from dm x join dm a on a.block_id = x.block_id and a.trait = x.trait and a.h1 = x.h1 and a.h2 = x.h1 join dm b on b.block_id = x.block_id and b.trait = x.trait and b.h1 = x.h2 and b.h2 = x.h2 where x.h1 <> x.h2) select block_id, trait, allele_a, allele_b, round(aa, 10) as mean_aa, round(ab, 10) as mean_ab, round(bb, 10) as mean_bb, round((bb - aa) / 2, 10) as a, round(ab - (aa + bb) / 2, 10) as d, coalesce(abs(bb - aa) / 2 > 1e-10 and abs((ab - (aa + bb) / 2) / ((bb - aa) / 2)) > 1, false) as overdominance from t",
    "diplotype_anova": f"with {_DIP}, g as (select block_id, trait, count(*) k, sum(n) n, sum(s) s, sum(ss) ss, sum(s * s / n) bt from dm group by all) select block_id, trait, k as n_diplotypes, round((bt - s * s / n) / (k - 1) / ((ss - bt) / (n - k)), 5) as f_stat, k - 1 as df1, (n - k)::bigint as df2 from g where k > 1 and n > k",
    "concordance_ivw": f"with {HAP_SQL}, {PHENO_SQL}, {_Y}, {_wald('grp < 5', '1')}, {_wald('grp >= 5', '2')}, n1 as (select block_id, trait, count(*) n from t1 group by all), n2 as (select block_id, trait, count(*) n from t2 group by all), s as (select a.block_id, a.trait, a.effect e1, b.effect e2, 1 / (a.se * a.se) w1, 1 / (b.se * b.se) w2 from t1 a join t2 b on a.block_id = b.block_id and a.trait = b.trait and a.allele = b.allele where a.se > 0 and b.se > 0), b as (select *, (e1 * w1 + e2 * w2) / (w1 + w2) b from s), g as (select block_id, trait, count(*) k, avg((sign(e1) = sign(e2))::int) da, sum(b * (w1 + w2)) / sum(w1 + w2) me, sqrt(1 / sum(w1 + w2)) ms, sum(w1 * (e1 - b) ^ 2 + w2 * (e2 - b) ^ 2) q from b group by all), h as (select coalesce(n1.block_id, n2.block_id) block_id, coalesce(n1.trait, n2.trait) trait, coalesce(n1.n, 0) a1, coalesce(n2.n, 0) a2 from n1 full join n2 on n1.block_id = n2.block_id and n1.trait = n2.trait) select h.block_id, h.trait, a1 as n_alleles_pop1, a2 as n_alleles_pop2, coalesce(k, 0) as n_shared_alleles, round(da, 6) as direction_agreement, round(me, 4) as meta_effect, round(ms, 4) as meta_se, round(q, 4) as q_stat, round(case when q > 0 then 100 * greatest(0, (q - (k - 1)) / q) when k is not null then 0 end, 4) as i2, coalesce(k - 1, -1) as q_df from h left join g on h.block_id = g.block_id and h.trait = g.trait",
    "stability_fw": f"with {_LOC}, {PHENO_SQL}, e as (select 'env' || (try_cast(substr(sample_id, 4) as int) % 4) as env, sample_id, y from pheno where trait = 'YLD' and try_cast(substr(sample_id, 4) as int) is not null), x as (select env, avg(y) x from e group by 1), m as (select block_id, l.env, avg(v) y from (select block_id, v, env from loc join e on loc.sample_id = e.sample_id) l group by all), j as (select block_id, x, y from m join x on m.env = x.env), g as (select block_id, count(*) n, regr_sxx(y, x) sxx, regr_syy(y, x) syy, regr_sxy(y, x) sxy from j group by 1) select block_id, n, round(sxy / sxx, 5) as b, round(sxy * sxy / (sxx * syy), 5) as r2_fw, round(greatest(syy - sxy * sxy / sxx, 0) / (n - 2), 5) as s2d, round(sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx), 5) as b_se from g",
}
