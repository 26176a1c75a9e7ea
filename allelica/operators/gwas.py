"""Association results against blocks: candidate regions, ranking, integration, export, agreement of two populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from allelica.functions.distributions import p_chi2, p_norm, q_norm
from allelica.functions.keys import materialize
from allelica.operators.relational import interval_ranks, iou_match, running_sum


def qtl_regions(gwas: DataFrame, blocks: DataFrame, snps: DataFrame, p_threshold: float | None = 5e-8, min_snps: int = 3, decay: DataFrame | None = None) -> DataFrame:
    """Blocks with significant hits in their search window (the block, widened by the chromosome's decay distance if
    ``decay`` (chr, decay_dist_bp; GENOME as fallback) is given).

    Per block: hits, lead marker (least p, then position), its p and beta, candidate region (lead +/- decay), markers and
    betas joined by ``;`` in order of position, traits by ``,`` (null if none is known), n_traits, pleiotropic. Blocks with fewer than
    ``min_snps`` variants are left out; a null p is no hit.
    """
    b = _windows(blocks, snps, min_snps, decay)
    g = _over_hits(_hits(gwas, p_threshold).select("chr", "pos", "snp", "beta", "p", "trait"), b)
    lo, hi = _candidate()
    return g.select(
        "block_id", "chr", "start_bp", "end_bp", "search_start", "search_end", "ld_decay_bp", "n_snps_block", "n_sig_markers", F.col("lead.snp").alias("lead_marker"), F.col("lead.p").alias("lead_p"),
        lo.alias("candidate_region_start"), hi.alias("candidate_region_end"), ((hi - lo + 1) / 1000).alias("candidate_region_size_kb"), F.col("lead.beta").alias("lead_beta"),
        F.col("_s").alias("sig_markers"), F.col("_b").alias("sig_betas"), F.when(F.size("_t") > 0, F.array_join("_t", ",")).alias("traits"), F.size("_t").alias("n_traits"), (F.size("_t") > 1).alias("pleiotropic"),
    )


def lead_regions(gwas: DataFrame, blocks: DataFrame, snps: DataFrame, p_threshold: float | None = 5e-8, min_snps: int = 3, decay: DataFrame | None = None) -> DataFrame:
    """block_id, chr, ld_decay_bp, lead_p, candidate_region_start and candidate_region_end of ``qtl_regions``, without what
    else is found there: neither markers nor traits are gathered, and no rows are summed up per window.

    Positions with hits are numbered on their chromosome. Numbers are halved again and again; at each level a number has the
    lead from it to the end of a left half, or from the start of a right half to it. First and last number of a window are in
    either half of one level, the lead is the less of their two.
    """
    b = _windows(blocks, snps, min_snps, decay).select("block_id", "chr", "search_start", "search_end", "ld_decay_bp")
    at = materialize(_hits(gwas, p_threshold).where("chr is not null and pos is not null").groupBy("chr", "pos").agg(F.min("p").alias("p")), "places")
    most = at.groupBy(F.col("chr").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    nodes = running_sum(at, "chr", "pos", ["pos"], F.lit(1), "_r").join(most.hint("merge"), F.col("chr") == F.col("_c"))
    nodes = nodes.withColumn("_r", F.col("_r").cast("long") - 1).withColumn("_k", F.explode(F.expr("sequence(1, length(bin(_n - 1)))"))).withColumn("_half", F.expr("shiftright(_r, _k - 1)"))
    inward = W.partitionBy("chr", "_k", "_half").orderBy(F.expr("if(_half % 2 = 1, _r, -_r)")).rowsBetween(W.unboundedPreceding, 0)
    nodes = materialize(nodes.select("chr", "_k", "_r", F.min(F.struct("p", "pos")).over(inward).alias("lead")), "leads")
    x = interval_ranks(at, b, "pos", "search_start", "search_end").select("block_id", "chr", "ld_decay_bp", "before", (F.col("through") - 1).alias("last"))
    x = x.withColumn("level", F.expr("length(bin(before ^ last))"))
    for i, end in enumerate(("before", "last")):
        n = nodes.select(F.col("chr").alias(f"_c{i}"), F.col("_k").alias(f"_k{i}"), F.col("_r").alias(f"_r{i}"), F.col("lead").alias(f"_l{i}"))
        x = x.join(n.hint("merge"), F.expr(f"chr = _c{i} and level = _k{i} and {end} = _r{i}")).drop(f"_c{i}", f"_k{i}", f"_r{i}", end)
    x = x.select("block_id", "chr", "ld_decay_bp", F.least("_l0", "_l1").alias("lead"))
    lo, hi = _candidate()
    return x.select("block_id", "chr", "ld_decay_bp", F.col("lead.p").alias("lead_p"), lo.alias("candidate_region_start"), hi.alias("candidate_region_end"))


def _hits(gwas: DataFrame, p_threshold: float | None) -> DataFrame:
    return gwas.where(F.col("p").isNotNull() & ((F.col("p") <= p_threshold) if p_threshold is not None else F.lit(True)))


def _candidate() -> tuple[Column, Column]:
    """Bounds of the candidate region: the lead's position +/- decay."""
    return F.greatest(F.col("lead.pos") - F.col("ld_decay_bp"), F.lit(1)), F.col("lead.pos") + F.col("ld_decay_bp")


def _windows(blocks: DataFrame, snps: DataFrame, min_snps: int, decay: DataFrame | None) -> DataFrame:
    """Distinct blocks of ``min_snps`` variants or more with n_snps_block, ld_decay_bp, search_start and search_end."""
    b = blocks.select("block_id", "chr", "start_bp", "end_bp")
    n = interval_ranks(snps, b).groupBy("block_id").agg(F.sum(F.col("through") - F.col("before")).alias("n_snps_block")).where(F.col("n_snps_block") >= min_snps)
    b = b.join(n.hint("merge"), "block_id")
    if decay is not None:
        own = decay.where("chr <> 'GENOME'").select(F.col("chr").alias("_c"), F.col("decay_dist_bp").alias("_d"))
        all_ = decay.where("chr = 'GENOME'").agg(F.max("decay_dist_bp").alias("_g"))
        b = b.join(own, F.col("chr") == F.col("_c"), "left").join(F.broadcast(all_)).withColumn("ld_decay_bp", F.coalesce("_d", "_g", F.lit(0)).cast("int")).drop("_c", "_d", "_g")
    else:
        b = b.withColumn("ld_decay_bp", F.lit(0))
    b = b.distinct().withColumn("search_start", F.col("start_bp") - F.col("ld_decay_bp")).withColumn("search_end", F.col("end_bp") + F.col("ld_decay_bp"))
    # windows and places of hits are read several times; written once, no plan is so long that it fills the driver
    return materialize(b, "windows")


def _over_hits(hits: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks with hits in search_start..search_end: n_sig_markers, lead (the least p, pos, snp, beta), markers _s and betas _b
    of distinct hits in order of position, joined by ``;``, traits _t.

    Positions with hits are numbered on their chromosome and summed up in nodes of 1, 2, 4, ... numbers; a window is put
    together from the few nodes that tile its numbers, not from all of its hits. Markers of one place only are counted,
    those of several are kept by name, as they count once.
    """
    hit, here = F.struct("pos", "snp", "beta"), hits.where("chr is not null and pos is not null")
    at = here.groupBy("chr", "pos").agg(F.min(F.struct("p", "pos", "snp", "beta")).alias("lead"), F.array_sort(F.collect_set(hit)).alias("m"), F.collect_set("trait").alias("t"))
    text = lambda a: F.when(F.exists(a, lambda x: x.isNotNull()), F.array_join(a, ";"))
    at = at.select("chr", "pos", "lead", text(F.col("m.snp")).alias("s"), text(F.transform("m.beta", lambda x: F.format_number(x, 2))).alias("b"), "t")
    names = here.where("snp is not null").select("chr", "pos", "snp").distinct().withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("chr", "snp")))
    names = names.groupBy(F.col("chr").alias("_c"), F.col("pos").alias("_p")).agg(F.count_if(F.col("_n") == 1).alias("u"), F.collect_list(F.when(F.col("_n") > 1, F.col("snp"))).alias("d"))
    at = materialize(at.join(names.hint("merge"), F.expr("chr = _c and pos = _p"), "left").drop("_c", "_p"), "hits")
    most = at.groupBy(F.col("chr").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    nodes = running_sum(at, "chr", "pos", ["pos"], F.lit(1), "_r").join(most.hint("merge"), F.col("chr") == F.col("_c"))
    nodes = nodes.withColumn("_r", F.col("_r").cast("long") - 1).withColumn("_k", F.explode(F.expr("sequence(0, cast(floor(log2(_n)) as int))")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(c).alias("v")))), lambda x: x["v"]), ";")
    any_of = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    some = lambda c: F.when(F.count(c) > 0, joined(c))
    nodes = nodes.groupBy("chr", "_k", F.expr("shiftright(_r, _k)").alias("_i")).agg(
        F.min("lead").alias("lead"), some("s").alias("s"), some("b").alias("b"), F.sum("u").alias("u"), any_of("d").alias("d"), any_of("t").alias("t"),
    )
    nodes = nodes.select(F.col("chr").alias("_nc"), F.col("_k").alias("_nk"), F.col("_i").alias("_ni"), "lead", "s", "b", "u", "d", "t")
    # of each size at most one node at either end: the numbers before..through - 1 from the outside in
    tiles = """flatten(transform(sequence(0, cast(floor(log2(through - before)) as int)), k -> filter(array(
      struct(k, shiftright(before + shiftleft(1L, k) - 1, k) as i, shiftright(before + shiftleft(1L, k) - 1, k) % 2 = 1 as own), struct(k, shiftright(through, k) - 1 as i, shiftright(through, k) % 2 = 1 as own)),
      x -> x.own and shiftright(before + shiftleft(1L, k) - 1, k) < shiftright(through, k))))"""
    key = ["block_id", "chr", "start_bp", "end_bp", "search_start", "search_end", "ld_decay_bp", "n_snps_block"]
    x = interval_ranks(at, b, "pos", "search_start", "search_end").select(*key, F.explode(F.expr(tiles)).alias("_x")).select(*key, F.col("_x.k").alias("_k"), F.col("_x.i").alias("_i"))
    x = x.withColumn("_r", F.expr("shiftleft(_i, _k)")).join(nodes.hint("merge"), F.expr("chr = _nc and _k = _nk and _i = _ni"))
    n = F.coalesce(F.sum("u"), F.lit(0)) + F.size(any_of("d"))
    return x.groupBy(*key).agg(F.min("lead").alias("lead"), joined("s").alias("_s"), joined("b").alias("_b"), F.array_sort(any_of("t")).alias("_t"), n.alias("n_sig_markers"))


def primary_hits(regions: DataFrame) -> DataFrame:
    """Adds n_sig_blocks_in_window (blocks that share the lead marker) and is_primary_hit (its own block, or the nearest)."""
    w = W.partitionBy("chr", "lead_marker")
    mid = F.abs((F.col("start_bp") + F.col("end_bp")) / 2 - (F.col("candidate_region_start") + F.col("candidate_region_end")) / 2)
    d = regions.withColumn("n_sig_blocks_in_window", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(mid, "block_id")))
    return d.withColumn("is_primary_hit", F.col("_r") == 1).drop("_r")


def integrate(regions: DataFrame, importance: DataFrame, diversity: DataFrame, he_threshold: float = 0.3) -> DataFrame:
    """Blocks of either input with gwas hit, prediction importance and diversity as a score 0..3 and a recommendation."""
    q = regions.select("block_id", "chr", "start_bp", "end_bp", "lead_marker", "lead_p", "lead_beta", "n_sig_markers")
    i = importance.select(F.col("block_id").alias("_i"), F.col("chr").alias("_c"), F.col("start_bp").alias("_s"), F.col("end_bp").alias("_e"), "var_scaled", "important")
    v = diversity.select("block_id", "he", "sweep_flag")
    d = q.join(i, q["block_id"] == i["_i"], "full")
    d = d.select(F.coalesce("block_id", "_i").alias("block_id"), F.coalesce("chr", "_c").alias("chr"), F.coalesce("start_bp", "_s").alias("start_bp"), F.coalesce("end_bp", "_e").alias("end_bp"), F.col("lead_marker").isNotNull().alias("has_gwas_hit"), "lead_marker", "lead_p", "lead_beta", F.coalesce("n_sig_markers", F.lit(0)).alias("n_sig_markers"), F.coalesce("important", F.lit(False)).alias("is_important"), "var_scaled")
    d = d.join(v, "block_id", "left").withColumn("is_diverse", F.coalesce(F.col("he") >= he_threshold, F.lit(False)))
    g, m, e = F.col("has_gwas_hit"), F.col("is_important"), F.col("is_diverse")
    d = d.withColumn("priority_score", g.cast("int") + m.cast("int") + e.cast("int"))
    text = F.when(g & m & e, "all three lines of evidence").when(g & m, "association and prediction, little diversity").when(g & e, "association with diversity").when(m & e, "prediction with diversity").when(g, "association only").when(m, "prediction only").when(e, "diversity only").otherwise("none")
    return d.withColumn("recommendation", text)


def rank_blocks(diversity: DataFrame, regions: DataFrame | None = None, importance: DataFrame | None = None, he_threshold: float = 0.3, top: int | None = None) -> DataFrame:
    """Blocks by rank_score: with prediction var_scaled + .001 hit + .001 diverse; with associations hit + He / 10; else
    He + n_eff / max n_eff / 10. Ties by block id."""
    d = diversity.select("block_id", "chr", "start_bp", "end_bp", "n_snps", "he", "n_eff_alleles", "freq_dominant", "sweep_flag").withColumn("is_diverse", F.col("he") >= he_threshold)
    if regions is not None:
        r = regions.groupBy("block_id").agg(F.first("lead_marker").alias("lead_marker"), F.first("lead_beta").alias("lead_beta"), F.first("n_sig_markers").alias("n_sig_markers"))
        d = d.join(r, "block_id", "left").withColumn("has_gwas_hit", F.col("lead_marker").isNotNull())
    else:
        d = d.withColumn("has_gwas_hit", F.lit(False))
    if importance is not None:
        d = d.join(importance.select("block_id", "var_scaled", F.col("important").alias("is_important")), "block_id", "left")
        score = F.coalesce("var_scaled", F.lit(0.0)) + 0.001 * F.col("has_gwas_hit").cast("int") + 0.001 * F.col("is_diverse").cast("int")
        use = "phenotype"
    elif regions is not None:
        score, use = F.col("has_gwas_hit").cast("int") + F.col("he") / 10, "gwas"
    else:
        most = d.agg(F.max("n_eff_alleles").alias("_m"))
        d = d.join(F.broadcast(most))
        score, use = F.col("he") + F.col("n_eff_alleles") / F.col("_m") / 10, "diversity_only"
    d = d.withColumn("use_case", F.lit(use)).withColumn("rank_score", score).drop("_m")
    d = d.orderBy(F.desc("rank_score"), "block_id")
    return d.limit(top) if top is not None else d


def export_bed(regions: DataFrame, padding: int = 0, prefix: str = "chr", lead_only: bool = False) -> DataFrame:
    """chrom, start (0-based, not below 0), end, name, score, strand of regions or of their lead markers."""
    s, e = (F.col("candidate_region_start"), F.col("candidate_region_end")) if not lead_only else (F.col("candidate_region_start") + F.col("ld_decay_bp"), F.col("candidate_region_end") - F.col("ld_decay_bp"))
    return regions.select(F.concat(F.lit(prefix), "chr").alias("chrom"), F.greatest(F.lit(0), s - 1 - padding).cast("int").alias("start"), (e + padding).cast("int").alias("end"), F.col("block_id").alias("name"), F.least(F.lit(1000), F.round(-F.log10("lead_p") * 10)).cast("int").alias("score"), F.lit(".").alias("strand"))


def export_regions(regions: DataFrame, form: str = "bed", padding: int = 0, prefix: str = "chr") -> DataFrame:
    """Regions as ``bed`` rows, as a ``csv`` table of 1-based bounds, or as ``biomart`` strings chr:start:end (1-based)."""
    if form == "bed":
        return export_bed(regions, padding, prefix)
    s, e = F.greatest(F.lit(1), F.col("candidate_region_start") - padding), F.col("candidate_region_end") + padding
    if form == "csv":
        return regions.select("block_id", "chr", s.cast("int").alias("start"), e.cast("int").alias("end"), "lead_marker", "lead_p", "traits")
    if form == "biomart":
        return regions.select(F.concat_ws(":", "chr", s.cast("int").cast("string"), e.cast("int").cast("string")).alias("region"))
    raise ValueError(f"unknown form: {form}")


def _meta(e1: Column, s1: Column, e2: Column, s2: Column) -> tuple[Column, Column]:
    """(inverse-variance estimate, its standard error) of two effects."""
    w1, w2 = F.try_divide(F.lit(1.0), s1 * s1), F.try_divide(F.lit(1.0), s2 * s2)
    return F.try_divide(e1 * w1 + e2 * w2, w1 + w2), F.sqrt(F.try_divide(F.lit(1.0), w1 + w2))


def compare_effects(a: DataFrame, b: DataFrame, blocks_a: DataFrame | None = None, blocks_b: DataFrame | None = None, overlap_min: float = 0.5, direction: float = 0.75, min_shared: int = 1, pvalues: bool = True) -> DataFrame:
    """Agreement of allele effects (block_id, trait, allele, effect, se) of two populations per trait and block, for blocks
    of either population.

    Alleles are matched by their string. With block tables, blocks are matched by overlap, otherwise by id; the block_id is
    that of the first population where there is one. Returns counts, effect_correlation (three shared alleles or more),
    direction_agreement, directionally_concordant, meta_effect, meta_se, q_stat, q_df (shared alleles less one), i2, and with
    ``pvalues`` meta_p, q_p (null at one shared allele), replicated. Shared alleles without a positive standard error on both
    sides are left out of all but enough_shared. Blocks without a shared allele have nulls.
    """
    x = a.select(F.col("block_id").alias("b1"), "trait", "allele", F.col("effect").alias("e1"), F.col("se").alias("s1"))
    y = b.select(F.col("block_id").alias("b2"), F.col("trait").alias("_t"), F.col("allele").alias("_a"), F.col("effect").alias("e2"), F.col("se").alias("s2"))
    if blocks_a is not None and blocks_b is not None:
        m = iou_match(blocks_a, blocks_b, overlap_min).where("block_id_pop2 is not null").select("block_id_pop1", "block_id_pop2", "overlap_ratio", "match_type")
    else:
        m = x.select(F.col("b1").alias("block_id_pop1")).distinct().withColumn("block_id_pop2", F.col("block_id_pop1")).withColumn("overlap_ratio", F.lit(1.0)).withColumn("match_type", F.lit("exact"))
    n1 = x.groupBy("b1", "trait").agg(F.count(F.lit(1)).alias("n_alleles_pop1")).join(m, F.col("b1") == F.col("block_id_pop1"), "left").drop("block_id_pop1")
    n2 = y.groupBy("b2", "_t").agg(F.count(F.lit(1)).alias("n_alleles_pop2"))
    head = n1.join(n2, (F.col("block_id_pop2") == F.col("b2")) & (F.col("trait") == F.col("_t")), "full")
    head = head.select("b1", F.col("b2"), F.coalesce("trait", "_t").alias("_trait"), "overlap_ratio", "match_type", F.coalesce("n_alleles_pop1", F.lit(0)).alias("n_alleles_pop1"), F.coalesce("n_alleles_pop2", F.lit(0)).alias("n_alleles_pop2"))
    z = x.join(m, x["b1"] == m["block_id_pop1"]).join(y, (y["b2"] == m["block_id_pop2"]) & (x["trait"] == y["_t"]) & (x["allele"] == y["_a"])).select("b1", "b2", "trait", "e1", "s1", "e2", "s2")
    good = (F.col("s1") > 0) & (F.col("s2") > 0) & F.col("e1").isNotNull() & F.col("e2").isNotNull()
    z = z.withColumn("_ok", F.coalesce(good, F.lit(False)))
    eff, _ = _meta(F.col("e1"), F.col("s1"), F.col("e2"), F.col("s2"))
    z = z.withColumn("_b", eff).withColumn("_w1", F.try_divide(F.lit(1.0), F.col("s1") * F.col("s1"))).withColumn("_w2", F.try_divide(F.lit(1.0), F.col("s2") * F.col("s2")))
    z = z.withColumn("_q", F.col("_w1") * (F.col("e1") - F.col("_b")) ** 2 + F.col("_w2") * (F.col("e2") - F.col("_b")) ** 2)
    use = lambda c: F.when(F.col("_ok"), c)
    e1, e2, w12, n = use(F.col("e1")), use(F.col("e2")), use(F.col("_w1") + F.col("_w2")), F.count_if("_ok")
    g = z.groupBy(F.col("b1").alias("_g1"), F.col("b2").alias("_g2"), F.col("trait").alias("_gt")).agg(
        F.count(F.lit(1)).alias("_all"), n.alias("_n"), F.when(n >= 3, F.try_divide(F.covar_pop(e1, e2), F.stddev_pop(e1) * F.stddev_pop(e2))).alias("effect_correlation"),
        F.avg(use((F.signum("e1") == F.signum("e2")).cast("double"))).alias("direction_agreement"), F.try_divide(F.sum(F.col("_b") * w12), F.sum(w12)).alias("meta_effect"),
        F.sqrt(F.try_divide(F.lit(1.0), F.sum(w12))).alias("meta_se"), F.sum(use(F.col("_q"))).alias("q_stat"),
    )
    g = head.join(g, F.expr("b1 = _g1 and b2 = _g2 and _trait = _gt"), "left").drop("_g1", "_g2", "_gt").withColumnRenamed("_trait", "trait")
    g = g.withColumn("n_shared_alleles", F.coalesce("_n", F.lit(0))).withColumn("enough_shared", F.coalesce(F.col("_all") >= min_shared, F.lit(False)))
    g = g.withColumn("q_df", F.when(F.col("_all").isNotNull(), F.greatest(F.col("n_shared_alleles") - 1, F.lit(0)))).withColumn("i2", F.when(F.col("q_stat") > 0, 100 * F.greatest(F.lit(0.0), (F.col("q_stat") - F.col("q_df")) / F.col("q_stat"))).when(F.col("_all").isNotNull(), 0.0))
    g = g.withColumn("directionally_concordant", F.coalesce(F.col("direction_agreement") >= direction, F.lit(False))).drop("_all", "_n")
    g = g.withColumn("block_id", F.coalesce("b1", "b2")).withColumnRenamed("b2", "block_id_pop2").drop("b1")
    if pvalues:
        g = g.withColumn("meta_p", p_norm(F.col("meta_effect") / F.col("meta_se"))).withColumn("q_p", F.when(F.col("q_df") > 0, p_chi2(F.col("q_stat"), F.col("q_df"))))
        g = g.withColumn("replicated", F.coalesce(F.col("enough_shared") & F.col("directionally_concordant") & (F.col("q_p") > 0.05), F.lit(False)))
    return g


def compare_gwas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lead markers of two populations' regions (block_id, lead_marker, lead_beta, lead_p): standard errors derived as
    |beta| / |quantile(p / 2)|, inverse-variance meta effect and p, replicated = same direction and meta_p <= 0.05."""
    def side(d: DataFrame, n: str) -> DataFrame:
        se = F.try_divide(F.abs("lead_beta"), F.abs(q_norm(F.col("lead_p") / 2)))
        return d.select(F.col("block_id").alias(f"_b{n}"), F.col("lead_marker").alias(f"lead_marker_pop{n}"), F.col("lead_p").alias(f"lead_p_pop{n}"), F.col("lead_beta").alias(f"_e{n}"), se.alias(f"se_derived_pop{n}"), F.col("pleiotropic").alias(f"_p{n}"))

    x, y = side(a, "1"), side(b, "2")
    d = x.join(y, F.col("_b1") == F.col("_b2"))
    eff, se = _meta(F.col("_e1"), F.col("se_derived_pop1"), F.col("_e2"), F.col("se_derived_pop2"))
    d = d.withColumn("meta_effect", eff).withColumn("meta_se", se).withColumn("meta_p", p_norm(F.try_divide(F.col("meta_effect"), F.col("meta_se"))))
    same = F.signum("_e1") == F.signum("_e2")
    return d.select(F.col("_b1").alias("block_id"), "lead_marker_pop1", "lead_marker_pop2", "lead_p_pop1", "lead_p_pop2", "se_derived_pop1", "se_derived_pop2", (F.col("_p1") & F.col("_p2")).alias("both_pleiotropic"), same.alias("directionally_concordant"), "meta_effect", "meta_se", "meta_p", (same & (F.col("meta_p") <= 0.05)).alias("replicated"))
