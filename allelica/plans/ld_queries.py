"""Queries of disequilibrium, its decay, and segmentation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelica.operators import decay, ld, segmentation
from allelica.operators import relational as R
from allelica.plans import fixtures as X
from allelica.plans.fixtures import GENO_SQL, REAL_GWAS_SQL, REAL_SNP_SQL, real_block_sql


#: The panel's blocks are planted: cliques find them, and the extension of the cliques adds nothing.
_PLANTED = f"with {GENO_SQL} select chr, (j - (chr::int - 1) * v // 4 + 1)::int as start_ix, (j - (chr::int - 1) * v // 4 + 8)::int as end_ix, snp as start_rsid, 'rs' || (j + 7) as end_rsid, pos as start_bp, pos + 7000 as end_bp, 8 as n_snps, 7001 as length_bp from snps, nv where j % 8 = 0"


def _v(spark, d):
    return ld.variant_major(X.geno(spark, d))


def ld_r2_dense(spark, d):
    return ld.pair_r2(_v(spark, d)).select("snp_i", "snp_j", F.round("r2", 6).alias("r2"))


def ld_r2_tiled(spark, d):
    """Strong pairs with tiles of 16 variants, so that bins and tiles have neighbours."""
    return ld.pair_r2(_v(spark, d), 300_000, 0.05, tile=16).select("snp_i", "snp_j", F.round("r2", 6).alias("r2"))


def ld_r2_sparse(spark, d):
    return ld.pair_r2(_v(spark, d), 60_000, 0.01).select("snp_i", "snp_j", "dist_bp", F.round("r2", 6).alias("r2"))


def ld_col_r2(spark, d):
    return ld.column_r2(_v(spark, d), "rs5").select("snp", F.round("r2", 6).alias("r2"))


def ld_adjacency(spark, d):
    return ld.pair_r2(_v(spark, d), threshold=0.5).select("snp_i", "snp_j")


def ld_boundary_scan(spark, d):
    v = _v(spark, d)
    return ld.boundary_scan(ld.pair_r2(v, threshold=0.5), v, 5, 0.5).select("snp", "valid")


def ld_band_pairs(spark, d):
    return R.band_pairs(X.real_snps(spark, d), 60_000).select("snp_i", "snp_j", "dist_bp")


def ld_whitened(spark, d):
    return ld.pair_r2(ld.whitened(_v(spark, d)), 60_000)


def decay_bins(spark, d):
    c = decay.bin_curve(ld.pair_r2(_v(spark, d), 200_000), 200_000, 20)
    return c.select("chr", "bin", F.round("dist_bp", 3).alias("dist_bp"), F.round("r2_mean", 6).alias("r2_mean"), F.round("r2_median", 6).alias("r2_median"), "n_pairs")


def decay_crossing(spark, d):
    c = decay.bin_curve(ld.pair_r2(_v(spark, d), 200_000), 200_000, 20)
    return decay.decay_distance(c, 0.1).withColumn("decay_dist_bp", F.round("decay_dist_bp", 3))


def decay_fits(spark, d):
    return decay.decay(_v(spark, d), max_dist=200_000, n_bins=20).curve


def decay_sliding(spark, d):
    return decay.bin_curve(decay.sliding_pairs(_v(spark, d), 16), 200_000, 20)


def unlinked_percentile(spark, d):
    return decay.unlinked_threshold(_v(spark, d), n_unlinked=1_000_000).withColumn("critical_r2", F.round("critical_r2", 6))


def ld_blocks_density(spark, d):
    return segmentation.segment(_v(spark, d))


def ld_blocks_louvain(spark, d):
    return segmentation.segment(_v(spark, d), mode="louvain")


def ld_blocks_extended(spark, d):
    v = _v(spark, d)
    return segmentation.append_rare(segmentation.segment(v, cut=0.6), ld.pair_r2(v, threshold=0.4), v, cut=0.4)


def tune_ld_params(spark, d):
    return segmentation.tune(_v(spark, d), X.gwas(spark, d).where("p < 5e-7"), [{"cut": c, "mode": m} for c in (0.3, 0.5, 0.65) for m in ("density", "louvain")])


def blocks_summary_rollup(spark, d):
    return segmentation.summarise(X.real_blocks(spark, d))


def blocks_iou_match(spark, d):
    return R.iou_match(X.real_blocks(spark, d, "k % 2 = 0"), X.real_blocks(spark, d, "k % 2 = 1")).select("block_id_pop1", F.coalesce("block_id_pop2", F.lit("-")).alias("block_id_pop2"), F.round("overlap_ratio", 6).alias("overlap_ratio"), "match_type")


def gwas_assign_nearest(spark, d):
    return R.nearest_interval(X.real_gwas(spark, d), X.real_blocks(spark, d), "rec_id").select("rec_id", "block_label", F.coalesce("distance", F.lit(-1)).alias("distance"), "forced")


QUERIES = {f.__name__: f for f in (ld_r2_dense, ld_r2_tiled, ld_r2_sparse, ld_col_r2, ld_adjacency, ld_boundary_scan, ld_band_pairs, ld_whitened, decay_bins, decay_crossing, decay_fits, decay_sliding, unlinked_percentile, ld_blocks_density, ld_blocks_louvain, ld_blocks_extended, tune_ld_params, blocks_summary_rollup, blocks_iou_match, gwas_assign_nearest)}

_R2 = f"""{GENO_SQL},
z as (select chr, pos, j, snp, sample_id, coalesce(dosage - avg(dosage) over (partition by snp), 0.0) as z from geno),
ss as (select snp, sum(z * z) as s from z group by 1),
pr as (select a.chr, b.chr as chr_j, a.snp as snp_i, a.j as i, a.pos as pos_i, b.snp as snp_j, b.j as j, b.pos as pos_j, sum(a.z * b.z) as c from z a join z b on a.sample_id = b.sample_id and a.j < b.j group by all),
r2 as (select pr.*, pos_j - pos_i as dist_bp, least(c * c / (x.s * y.s), 1) as r2 from pr join ss x on x.snp = snp_i join ss y on y.snp = snp_j)"""
_SAME = "chr = chr_j"
_BIN = f"""{_R2}, bn as (select chr, least(floor(dist_bp / 10000), 19)::int as bin, avg(r2) m, median(r2) md, count(*) n from r2 where {_SAME} and dist_bp <= 200000 group by all)"""
SQL = {
    "ld_r2_dense": f"with {_R2} select snp_i, snp_j, round(r2, 6) as r2 from r2 where {_SAME}",
    "ld_r2_tiled": f"with {_R2} select snp_i, snp_j, round(r2, 6) as r2 from r2 where {_SAME} and dist_bp <= 300000 and r2 >= 0.05",
    "ld_r2_sparse": f"with {_R2} select snp_i, snp_j, dist_bp, round(r2, 6) as r2 from r2 where {_SAME} and dist_bp <= 60000 and r2 >= 0.01",
    "ld_col_r2": f"with {_R2} select s.snp, round(coalesce(r2, 0), 6) as r2 from snps s left join r2 on (snp_i = 'rs5' and snp_j = s.snp) or (snp_j = 'rs5' and snp_i = s.snp)",
    "ld_adjacency": f"with {_R2} select snp_i, snp_j from r2 where {_SAME} and r2 >= 0.5",
    "ld_boundary_scan": f"with {_R2} select snp, (not exists (select 1 from r2 where r2 >= 0.5 and r2.chr = r2.chr_j and r2.chr = s.chr and r2.i between s.j - 4 and s.j and r2.j between s.j + 1 and s.j + 5))::int as valid from snps s where s.j not in (select max(j) from snps group by chr)",
    "ld_blocks_density": _PLANTED.replace("7001 as length_bp", "7001 as length_bp, 'density' as method"), "ld_blocks_extended": _PLANTED,
    "ld_band_pairs": f"with {REAL_SNP_SQL} select a.snp as snp_i, b.snp as snp_j, b.pos - a.pos as dist_bp from snps a join snps b on a.chr = b.chr and b.pos > a.pos and b.pos - a.pos <= 60000",
    "decay_bins": f"with {_BIN} select chr, bin, (bin + 0.5::double) * 10000 as dist_bp, round(m, 6) as r2_mean, round(md, 6) as r2_median, n as n_pairs from bn",
    "decay_crossing": f"with {_BIN}, k as (select *, (bin + 0.5::double) * 10000 x from bn), f as (select chr, min(bin) filter (m < 0.1) b, max(bin) filter (m >= 0.1) a, max(x) e from k group by 1) select f.chr, round(case when a is null or b is null then e when a < b then ka.x + (0.1 - ka.m) * (kb.x - ka.x) / (kb.m - ka.m) else kb.x end, 3) as decay_dist_bp, a is null or b is null as censored from f left join k kb on f.chr = kb.chr and f.b = kb.bin left join k ka on f.chr = ka.chr and f.a = ka.bin",
    "unlinked_percentile": f"with {_R2} select round(quantile_cont(r2, 0.95), 6) as critical_r2, count(*) as n_pairs from r2 where not {_SAME}",
    "blocks_summary_rollup": f"with {real_block_sql()}, n as (select chr, end_bp - start_bp + 1 as n from blocks) select coalesce(chr, 'GENOME') as chr, count(*) as n_blocks, min(n) as min_bp, median(n) as median_bp, avg(n) as mean_bp, max(n) as max_bp, sum(n)::bigint as total_bp_covered from n group by rollup (chr)",
    "blocks_iou_match": f"with {real_block_sql('blocks', 'k % 2 = 0')}, {real_block_sql('moved', 'k % 2 = 1')}, p as (select a.block_id as a, b.block_id as b, b.start_bp as s, greatest(0, least(a.end_bp, b.end_bp) - greatest(a.start_bp, b.start_bp))::double / greatest(1, greatest(a.end_bp, b.end_bp) - least(a.start_bp, b.start_bp)) as iou from blocks a join moved b on a.chr = b.chr and a.start_bp <= b.end_bp and b.start_bp <= a.end_bp), q as (select *, row_number() over (partition by a order by iou desc, s, b) k from p) select block_id as block_id_pop1, case when iou >= 0.5 then b else '-' end as block_id_pop2, round(case when iou >= 0.5 then iou end, 6) as overlap_ratio, case when iou >= 0.5 then case when a = b then 'exact' else 'position' end else 'pop1_only' end as match_type from blocks left join q on a = block_id and k = 1",
    "gwas_assign_nearest": f"with {REAL_GWAS_SQL}, {real_block_sql()}, c as (select g.rec_id, pos, block_id, start_bp, end_bp, case when pos between start_bp and end_bp then 0 else greatest(start_bp - pos, pos - end_bp) end as d from gwas g left join blocks b on g.chr = b.chr and pos is not null), k as (select *, row_number() over (partition by rec_id order by d, start_bp, block_id) r from c) select rec_id, block_id || case when d > 0 then '*' else '' end as block_label, coalesce(d, -1)::int as distance, coalesce(d > 0, false) as forced from k where r = 1",
}
