"""Haplotypes of linkage blocks: extraction, diversity, alleles, features, relationship, comparison.

A haplotype is the string of a sample's dosages in a block, ``.`` where missing. Where phase is known the input has two
gametes per sample, each a string of 0/1; every function that counts alleles takes gametes as separate rows (``copy``).
Groups that are gathered are a sample's variants in one block, which a block's size bounds; everything else is
aggregation by (block, haplotype).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from allelica.functions.keys import materialize
from allelica.operators.relational import interval_ranks, range_join

BLOCK = ["block_id", "chr", "start_bp", "end_bp"]
# Two-base codes of heterozygous calls.
IUPAC = {"AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M"}


def block_variants(snps: DataFrame, blocks: DataFrame, min_snps: int = 1) -> DataFrame:
    """Variants of each block that holds at least ``min_snps``: block columns, n_snps, snp, pos and the snps' other columns."""
    b = blocks.select(F.col("block_id"), F.col("chr"), "start_bp", "end_bp")
    d = range_join(snps, b)
    n = d.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_snps")).where(F.col("n_snps") >= min_snps)
    return d.join(n, "block_id")


def block_ranges(snps: DataFrame, blocks: DataFrame) -> DataFrame:
    """block_id, first_pos, last_pos, n_snps of each block that holds a variant, without pairing blocks and variants."""
    v = interval_ranks(snps, blocks.select("block_id", "chr", "start_bp", "end_bp"))
    return v.groupBy("block_id").agg(F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.sum(F.col("through") - F.col("before")).alias("n_snps"))


def extract(geno: DataFrame, blocks: DataFrame, min_snps: int = 3, na: str = ".") -> DataFrame:
    """block columns, n_snps, sample_id, hap: one row per block and sample.

    Variants are in order of position, then id. Blocks with fewer than ``min_snps`` variants are left out. A variant for which
    the sample has no row is missing, like a null dosage; of repeated rows the lowest dosage counts. A sample without any
    row in a block has no haplotype there.
    """
    snps = geno.select("chr", "pos", "snp").distinct()
    keys = block_variants(snps, blocks, min_snps).select(*BLOCK, "n_snps", F.col("snp").alias("_snp"), F.col("pos").alias("_pos"))
    keys = keys.withColumn("_o", F.row_number().over(W.partitionBy("block_id").orderBy("_pos", "_snp"))).withColumnRenamed("chr", "_chr")
    d = geno.join(keys, (geno["chr"] == keys["_chr"]) & (geno["pos"] == keys["_pos"]) & (geno["snp"] == keys["_snp"]))
    d = d.groupBy("block_id", geno["chr"], "start_bp", "end_bp", "n_snps", "sample_id")
    d = d.agg(F.array_sort(F.collect_set(F.struct("_o", F.coalesce(F.col("dosage").cast("string"), F.lit(na)).alias("d")))).alias("_a"))
    # of the rows of one variant the first in order; "." sorts before digits, so a known dosage is looked for first
    at = lambda i: F.coalesce(F.get(F.filter("_a", lambda x: (x["_o"] == i) & (x["d"] != na)), F.lit(0))["d"], F.lit(na))
    whole = (F.size("_a") == F.col("n_snps")) & (F.size(F.array_distinct("_a._o")) == F.col("n_snps"))
    text = F.when(whole, F.array_join(F.col("_a.d"), "")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.col("n_snps").cast("int")), at), ""))
    return d.select(*BLOCK, "n_snps", "sample_id", text.alias("hap"))


def extract_phased(phased: DataFrame, blocks: DataFrame, min_snps: int = 3) -> DataFrame:
    """Gametes from a1/a2 per variant: block columns, n_snps, sample_id, copy (1, 2), hap; ``.`` where missing."""
    one = phased.select("*", F.explode(F.array(F.struct(F.lit(1).alias("copy"), F.col("a1").alias("dosage")), F.struct(F.lit(2).alias("copy"), F.col("a2").alias("dosage")))).alias("g"))
    one = one.select("chr", "pos", "snp", F.struct("sample_id", "g.copy").alias("sample_id"), F.col("g.dosage").alias("dosage"))
    return extract(one, blocks, min_snps).select(*BLOCK, "n_snps", "sample_id.sample_id", "sample_id.copy", "hap")


def as_pairs(gametes: DataFrame) -> DataFrame:
    """block_id, sample_id, hap of phased gametes as ``g1|g2``."""
    g = gametes.groupBy(*BLOCK, "n_snps", "sample_id").agg(F.max(F.when(F.col("copy") == 1, F.col("hap"))).alias("g1"), F.max(F.when(F.col("copy") == 2, F.col("hap"))).alias("g2"))
    return g.select(*BLOCK, "n_snps", "sample_id", "g1", "g2", F.concat_ws("|", "g1", "g2").alias("hap"))


def counts(haps: DataFrame, na: str = ".") -> DataFrame:
    """block columns, n_snps, hap, n: complete haplotypes and how many carry them."""
    return haps.where(~F.contains("hap", F.lit(na))).groupBy(*BLOCK, "n_snps", "hap").agg(F.count(F.lit(1)).alias("n"))


def diversity(haps: DataFrame, phased: bool = False) -> DataFrame:
    """n_ind, n_haplotypes, He, Shannon, n_eff_alleles, freq_dominant, sweep_flag per block, over complete haplotypes.

    Phased input has two rows a sample; n_ind then counts samples, He is corrected by the number of gametes. A block
    without a complete haplotype is left out.
    """
    total = F.sum("n").over(W.partitionBy("block_id"))
    c = counts(haps).withColumn("p", F.col("n") / total)
    d = c.groupBy(*BLOCK, "n_snps").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("n_haplotypes"), F.sum(F.col("p") * F.col("p")).alias("_p2"), (-F.sum(F.col("p") * F.log("p"))).alias("shannon"), F.max("p").alias("freq_dominant"))
    n = F.col("_n")
    he = F.when(n > 1, n / (n - 1) * (1 - F.col("_p2"))).otherwise(1 - F.col("_p2"))
    return d.select(*BLOCK, "n_snps", (n / (2 if phased else 1)).cast("long").alias("n_ind"), "n_haplotypes", he.alias("he"), "shannon", F.round(1 / F.col("_p2"), 3).alias("n_eff_alleles"), "freq_dominant", (F.col("freq_dominant") >= 0.9).alias("sweep_flag"), F.lit(phased).alias("phased"))


def with_genome_row(div: DataFrame) -> DataFrame:
    """Diversity and a GENOME row of means."""
    num = ["n_ind", "n_haplotypes", "he", "shannon", "n_eff_alleles", "freq_dominant"]
    g = div.agg(F.lit("GENOME").alias("block_id"), F.avg("n_snps").alias("n_snps"), *[F.avg(c).alias(c) for c in num])
    return div.select("block_id", "chr", "start_bp", "end_bp", F.col("n_snps").cast("double").alias("n_snps"), *[F.col(c).cast("double").alias(c) for c in num]).unionByName(g, allowMissingColumns=True)


def alleles(haps: DataFrame, min_freq: float = 0.01, top_n: int | None = None) -> DataFrame:
    """Allele table: block columns, n_snps, hap, n, freq (of all complete haplotypes), freq_kept (of those kept), hap_rank, hap_id.

    Ranks go by count, ties by string; kept are alleles with freq >= min_freq, at most top_n a block.
    """
    w = W.partitionBy("block_id")
    d = counts(haps).withColumn("freq", F.col("n") / F.sum("n").over(w)).withColumn("hap_rank", F.row_number().over(w.orderBy(F.desc("n"), "hap")))
    d = d.where(F.col("freq") >= min_freq)
    if top_n is not None:
        d = d.where(F.col("hap_rank") <= top_n)
    d = d.withColumn("freq_kept", F.col("n") / F.sum("n").over(w))
    return d.withColumn("hap_id", F.concat(F.col("block_id"), F.lit("_hap"), F.col("hap_rank").cast("string")))


def features(haps: DataFrame, kept: DataFrame, encoding: str = "additive_012") -> DataFrame:
    """sample_id, hap_id, dose for every sample and kept allele of its blocks; null where the sample's haplotype is
    incomplete. Unphased: 1 if it is the allele; phased rows (``copy``): number of copies; presence_01 caps at 1."""
    per = haps.groupBy("block_id", "sample_id").agg(F.collect_list("hap").alias("_h"), F.max(F.contains("hap", F.lit("."))).alias("_miss"))
    k = kept.groupBy("block_id").agg(F.collect_list(F.struct("hap_id", "hap")).alias("_k"))
    d = per.join(k, "block_id").select("block_id", "sample_id", "_h", "_miss", F.explode("_k").alias("k"))
    dose = F.size(F.filter("_h", lambda x: x == F.col("k.hap")))
    if encoding == "presence_01":
        dose = F.least(dose, F.lit(1))
    elif encoding != "additive_012":
        raise ValueError(f"unknown encoding: {encoding}")
    return d.select("sample_id", "block_id", F.col("k.hap_id").alias("hap_id"), F.when(~F.col("_miss"), dose).cast("int").alias("dose"))


def scaled(features: DataFrame) -> DataFrame:
    """Features as z-scores per allele; 0 where the allele doesn't vary or the dose is missing."""
    s = features.groupBy("hap_id").agg(F.avg("dose").alias("_m"), F.stddev_samp("dose").alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("dose") - F.col("_m")) / F.col("_s"))
    return features.join(s, "hap_id").select("sample_id", "block_id", "hap_id", F.coalesce(z, F.lit(0.0)).alias("z"))


def relationship(features: DataFrame, phased: bool = False, bend: bool = False, cells: int = 8_000_000) -> DataFrame:
    """VanRaden relationship of samples from allele doses: sample_i <= sample_j, g.

    Alleles that are missing in all or don't vary are dropped, missing doses take the mean; G = ZZ' / (2 sum p(1-p)),
    Z = dose - s p, s = 2 if phased or any dose exceeds 1, otherwise 1. ``bend`` adds .001 to the diagonal. Samples are
    cut into tiles and each pair of tiles is one matrix product in one task, whose size ``cells`` bounds; pairs of
    samples are only ever made as output.
    """
    # read by the statistics and by the tiles
    features = materialize(features.select("sample_id", "hap_id", "dose"), "doses")
    s = 2 if phased or features.where("dose > 1").limit(1).count() else 1
    stats = features.groupBy("hap_id").agg(F.avg("dose").alias("_m"), F.min("dose").alias("_lo"), F.max("dose").alias("_hi")).where("_lo < _hi")
    p = F.least(F.greatest(F.col("_m") / s, F.lit(1e-6)), F.lit(1 - 1e-6))
    stats = stats.select("hap_id", "_m", p.alias("_p"))
    total = stats.agg(F.sum(F.col("_p") * (1 - F.col("_p"))), F.count(F.lit(1))).first()
    denom, n_alleles = 2 * (total[0] or 1.0), max(1, total[1])
    n = features.select(F.approx_count_distinct("sample_id")).first()[0]
    tiles = max(1, -(-n * n_alleles // cells), -(-n // 1000))
    z = features.join(stats, "hap_id").select(F.xxhash64("hap_id").alias("hap_id"), "sample_id", (F.coalesce(F.col("dose").cast("double"), F.col("_m")) - s * F.col("_p")).alias("z"))
    rows = z.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("hap_id", "z"))).alias("_v")).select("sample_id", F.col("_v.hap_id").alias("h"), F.col("_v.z").alias("z"))
    rows = rows.withColumn("_t", F.pmod(F.xxhash64("sample_id"), F.lit(tiles)).cast("int"))
    rows = rows.withColumn("_u", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select("sample_id", "h", "z", "_t", F.least("_t", "_u").alias("a"), F.greatest("_t", "_u").alias("b"))

    def product(key, pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["h"].map(len).to_numpy()
        row, names = np.repeat(np.arange(len(pdf)), size), np.concatenate(pdf["h"].tolist())
        own, col = np.unique(names, return_inverse=True)
        m = np.zeros((len(pdf), len(own)))
        m[row, col] = np.concatenate(pdf["z"].tolist())
        name, tile = pdf["sample_id"].to_numpy(), pdf["_t"].to_numpy()
        left, right = np.flatnonzero(tile == key[0]), np.flatnonzero(tile == key[1])
        g = m[left] @ m[right].T / denom
        x, y = np.repeat(name[left], len(right)), np.tile(name[right], len(left))
        keep = x <= y if key[0] == key[1] else np.ones(len(x), bool)
        lo, hi = np.where(x <= y, x, y)[keep], np.where(x <= y, y, x)[keep]
        return pd.DataFrame({"sample_i": lo, "sample_j": hi, "g": g.ravel()[keep] + np.where(bend & (lo == hi), 0.001, 0.0)})

    return rows.groupBy("a", "b").applyInPandas(lambda key, pdf: product(key, pdf), "sample_i string, sample_j string, g double")


def iupac(het: Column, ref: Column, alt: Column) -> Column:
    """Base of a dosage character: REF for 0, ALT for 2, the two-base code (N where there is none) for 1, N otherwise."""
    pair = F.concat(F.least(ref, alt), F.greatest(ref, alt))
    table = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    return F.when(het == "0", ref).when(het == "2", alt).when(het == "1", F.coalesce(F.try_element_at(table, pair), F.lit("N"))).otherwise("N")


def decode(kept: DataFrame, snps: DataFrame, phased: bool = False) -> DataFrame:
    """Adds nucleotide_sequence, snp_positions and snp_alleles to the allele table. In phased gametes 1 means ALT."""
    b = kept.select(*BLOCK).distinct()
    v = block_variants(snps, b).groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("pos", "snp", "ref_allele", "alt_allele"))).alias("_v"))

    def base(c: Column, x: Column) -> Column:
        if phased:
            return F.when(c == "0", x["ref_allele"]).when(c == "1", x["alt_allele"]).otherwise("N")
        return iupac(c, x["ref_allele"], x["alt_allele"])

    seq = F.array_join(F.zip_with(F.split("hap", ""), F.col("_v"), base), "")
    return kept.join(v, "block_id").select(*kept.columns, seq.alias("nucleotide_sequence"), F.array_join(F.transform("_v", lambda x: x["pos"].cast("string")), ";").alias("snp_positions"), F.array_join(F.transform("_v", lambda x: F.concat_ws("/", x["ref_allele"], x["alt_allele"])), ";").alias("snp_alleles"))


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ; null for strings of unequal length."""
    same = F.length(a) == F.length(b)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(same, F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def collapse(haps: DataFrame, min_freq: float = 0.05, how: str = "nearest") -> DataFrame:
    """Adds ``collapsed``: rare alleles (freq <= min_freq) become the nearest common one (ties: the commoner, then by
    string), ``<other>``, or by ``tree_based`` the common one they join first in an average-linkage tree.

    Incomplete haplotypes and blocks without a common allele stay as they are. Only alleles are paired, rare with common
    of one block; samples are joined to the result.
    """
    w = W.partitionBy("block_id")
    c = counts(haps).withColumn("freq", F.col("n") / F.sum("n").over(w))
    rare, common = c.where(F.col("freq") <= min_freq), c.where(F.col("freq") > min_freq)
    if how == "rare_to_other":
        has = common.select("block_id").distinct()
        m = rare.join(has, "block_id", "left_semi").select("block_id", "hap", F.lit("<other>").alias("_to"))
    elif how == "nearest":
        x = rare.select("block_id", "hap").join(common.select("block_id", F.col("hap").alias("_c"), F.col("n").alias("_n")), "block_id")
        x = x.withColumn("_d", hamming(F.col("hap"), F.col("_c"))).where("_d is not null")
        m = x.groupBy("block_id", "hap").agg(F.min(F.struct("_d", (-F.col("_n")).alias("m"), "_c")).alias("b")).select("block_id", "hap", F.col("b._c").alias("_to"))
    elif how == "tree_based":
        m = c.groupBy("block_id").applyInPandas(lambda pdf: _tree(pdf, min_freq), "block_id string, hap string, _to string")
    else:
        raise ValueError(f"unknown way to collapse: {how}")
    return haps.join(m, ["block_id", "hap"], "left").withColumn("collapsed", F.coalesce("_to", "hap")).drop("_to").select(*haps.columns, "collapsed")


def _tree(pdf: pd.DataFrame, min_freq: float) -> pd.DataFrame:
    """Average-linkage clusters of a block's alleles, cut half a step below the least distance of two common alleles (with
    one common allele: at half the largest distance; never below 0.5). A rare allele takes the commonest common member of
    its cluster, or where that has none the nearest common allele (ties: the commoner, then by string)."""
    pdf = pdf.sort_values(["n", "hap"], ascending=[False, True])
    haps, freq = pdf["hap"].tolist(), pdf["freq"].tolist()
    chars = np.array([list(h.ljust(max(map(len, haps)))) for h in haps])
    d = (chars[:, None, :] != chars[None, :, :]).sum(2).astype(float)
    common = [i for i, f in enumerate(freq) if f > min_freq]
    out: list[tuple[str, str]] = []
    if common and len(common) < len(haps):
        cut = max(0.5, min((d[i, j] for i in common for j in common if i < j), default=d.max() * 0.5 + 0.5) - 0.5)
        members, dist = {i: [i] for i in range(len(haps))}, d.copy()
        np.fill_diagonal(dist, np.inf)
        while len(members) > 1:
            i, j = sorted(int(v) for v in np.unravel_index(np.argmin(dist), dist.shape))
            if dist[i, j] > cut:
                break
            a, b = len(members[i]), len(members[j])
            dist[i] = dist[:, i] = (a * dist[i] + b * dist[j]) / (a + b)
            dist[i, i], dist[j], dist[:, j] = np.inf, np.inf, np.inf
            members[i] += members.pop(j)
        for cluster in members.values():
            own = [k for k in cluster if k in common]
            for r in cluster:
                if r not in common:
                    # alleles are in order of count and string, so the least index wins ties
                    out.append((haps[r], haps[min(own) if own else min(common, key=lambda k: (d[r, k], k))]))
    return pd.DataFrame({"block_id": pdf["block_id"].iloc[0], "hap": [x for x, _ in out], "_to": [x for _, x in out]}, columns=["block_id", "hap", "_to"]).astype(str)


def harmonize(target: DataFrame, ref: DataFrame, min_freq_ref: float = 0.02, max_hamming: int = 1) -> DataFrame:
    """Target haplotypes labelled by the reference population's alleles: block_id, sample_id, hap, harmonized, how
    (exact, nearest, novel), hamming. Novel ones become ``<novel>``; incomplete ones stay, ``how`` null."""
    w = W.partitionBy("block_id")
    r = counts(ref).withColumn("freq", F.col("n") / F.sum("n").over(w)).where(F.col("freq") >= min_freq_ref).select("block_id", F.col("hap").alias("_r"), F.col("n").alias("_n"))
    t = counts(target).select("block_id", "hap")
    x = t.join(r, "block_id", "left").withColumn("_d", hamming(F.col("hap"), F.col("_r")))
    x = x.groupBy("block_id", "hap").agg(F.min(F.when(F.col("_d").isNotNull(), F.struct("_d", (-F.col("_n")).alias("m"), "_r"))).alias("b"))
    how = F.when(F.col("b._d") == 0, "exact").when(F.col("b._d") <= max_hamming, "nearest").otherwise("novel")
    x = x.select("block_id", "hap", how.alias("how"), F.when(how == "novel", "<novel>").otherwise(F.col("b._r")).alias("_to"), F.when(how != "novel", F.col("b._d")).alias("hamming"))
    return target.join(x, ["block_id", "hap"], "left").select("block_id", "sample_id", "hap", F.coalesce("_to", "hap").alias("harmonized"), "how", "hamming")


def harmonize_report(h: DataFrame) -> DataFrame:
    return h.where("how is not null").groupBy("block_id").agg(F.count_if(F.col("how") == "exact").alias("n_exact"), F.count_if(F.col("how") == "nearest").alias("n_nearest"), F.count_if(F.col("how") == "novel").alias("n_novel"), F.avg(F.when(F.col("how") == "nearest", F.col("hamming"))).alias("mean_hamming_dist"))


def windows(geno: DataFrame, window_bp: int, step_bp: int, min_snps: int = 5) -> DataFrame:
    """Diversity in sliding windows of position that start at a chromosome's first variant; windows with fewer than
    ``min_snps`` variants or fewer than two complete samples are left out."""
    ends = geno.groupBy("chr").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    win = ends.select("chr", F.explode(F.expr(f"sequence(lo, hi, {step_bp})")).alias("start_bp")).withColumn("end_bp", F.col("start_bp") + F.lit(window_bp - 1))
    win = win.select(F.concat_ws("_", F.lit("win"), "chr", "start_bp", "end_bp").alias("block_id"), "chr", F.col("start_bp").cast("int"), F.col("end_bp").cast("int"))
    d = diversity(extract(geno, win, min_snps)).where("n_ind >= 2")
    mid = (F.col("start_bp") + F.col("end_bp")) / 2
    return d.select("chr", F.col("start_bp").alias("win_start"), F.col("end_bp").alias("win_end"), mid.alias("win_mid"), "n_snps", "n_ind", "n_haplotypes", F.round("he", 4).alias("he"), F.round("shannon", 4).alias("shannon"), "n_eff_alleles", F.round("freq_dominant", 4).alias("freq_dominant"), "sweep_flag")


def compare_populations(haps: DataFrame, group: str, a, b, min_freq: float = 0.02, permutations: int = 2000, seed: int = 42) -> DataFrame:
    """Two groups' haplotypes per block: n1, n2, n_alleles, fst_simple, max_freq_diff, dominant_g1, dominant_g2, chisq_p, divergent.

    Alleles whose frequency is below min_freq in both groups are pooled as ``other`` (unless all are). FST is the mean over
    alleles of S^2 / (p(1-p)), 0 for an allele that doesn't vary, clipped to 0..1. The p-value is by permutation with a fixed
    seed. Blocks in which a group has fewer than two complete haplotypes have nulls. Ties for the dominant allele go to the
    first by string.
    """
    d = haps.where(F.col(group).isin(a, b) & ~F.contains("hap", F.lit(".")))
    c = d.groupBy(*BLOCK, "hap").agg(F.count_if(F.col(group) == a).alias("c1"), F.count_if(F.col(group) == b).alias("c2"))
    w = W.partitionBy("block_id")
    c = c.withColumn("n1", F.sum("c1").over(w)).withColumn("n2", F.sum("c2").over(w))
    rare = F.coalesce(F.try_divide("c1", "n1") < min_freq, F.lit(True)) & F.coalesce(F.try_divide("c2", "n2") < min_freq, F.lit(True))
    c = c.withColumn("_rare", rare).withColumn("_all", F.min(F.col("_rare").cast("int")).over(w) == 1)
    c = c.withColumn("allele", F.when(F.col("_rare") & ~F.col("_all"), "other").otherwise(F.col("hap")))
    c = c.groupBy(*BLOCK, "n1", "n2", "allele").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    few = c.where("n1 < 2 or n2 < 2").select(*BLOCK, "n1", "n2").distinct()
    n1, n2 = F.col("n1"), F.col("n2")
    c = c.where("n1 > 1 and n2 > 1").withColumn("f1", F.col("c1") / n1).withColumn("f2", F.col("c2") / n2)
    p = (n1 * F.col("f1") + n2 * F.col("f2")) / (n1 + n2)
    s2 = (n1 * (F.col("f1") - p) ** 2 + n2 * (F.col("f2") - p) ** 2) / (n1 + n2 - 1)
    c = c.withColumn("_fst", F.coalesce(F.try_divide(s2, p * (1 - p)), F.lit(0.0))).withColumn("_diff", F.abs(F.col("f1") - F.col("f2")))
    out = c.groupBy(*BLOCK, "n1", "n2").agg(
        F.count(F.lit(1)).alias("n_alleles"), F.least(F.greatest(F.avg("_fst"), F.lit(0.0)), F.lit(1.0)).alias("fst_simple"), F.max("_diff").alias("max_freq_diff"),
        F.min(F.struct((-F.col("c1")).alias("x"), "allele"))["allele"].alias("dominant_g1"), F.min(F.struct((-F.col("c2")).alias("x"), "allele"))["allele"].alias("dominant_g2"),
        F.collect_list("c1").alias("_c1"), F.collect_list("c2").alias("_c2"),
    )
    if not permutations:
        return out.drop("_c1", "_c2").unionByName(few, allowMissingColumns=True)

    @F.pandas_udf("double")
    def chi(x: pd.Series, y: pd.Series) -> pd.Series:
        res = []
        for u, v in zip(x, y):
            t = np.array([u, v], float)
            rows, cols = t.sum(1), t.sum(0)
            e = np.outer(rows, cols) / t.sum()
            stat = ((t - e) ** 2 / np.where(e > 0, e, 1)).sum()
            rng = np.random.default_rng(seed)
            first = rng.multivariate_hypergeometric(cols.astype(int), int(rows[0]), size=permutations)
            sim = np.stack([first, cols - first], 1)
            res.append((1 + (((sim - e) ** 2 / np.where(e > 0, e, 1)).sum((1, 2)) >= stat - 1e-9).sum()) / (permutations + 1))
        return pd.Series(res)

    out = out.withColumn("chisq_p", chi("_c1", "_c2")).drop("_c1", "_c2")
    out = out.unionByName(few, allowMissingColumns=True)
    return out.withColumn("divergent", F.coalesce((F.col("fst_simple") > 0.1) & (F.col("chisq_p") < 0.05), F.lit(False)))


def network(haps: DataFrame, min_freq: float = 0.01) -> DataFrame:
    """Minimum spanning tree of each block's alleles by Hamming distance: block_id, hap_a, hap_b, dist, and both counts."""
    kept = alleles(haps, min_freq)

    def prim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hap_rank")
        h, n = pdf["hap"].tolist(), pdf["n"].tolist()
        c = np.array([list(x) for x in h])
        d = (c[:, None, :] != c[None, :, :]).sum(2)
        near, frm, out = d[0].copy().astype(float), np.zeros(len(h), int), []
        near[0] = np.inf
        for _ in range(len(h) - 1):
            k = int(near.argmin())
            out.append((pdf["block_id"].iloc[0], h[frm[k]], h[k], int(d[frm[k], k]), int(n[frm[k]]), int(n[k])))
            better = (d[k] < near) & np.isfinite(near)
            near[better], frm[better] = d[k][better], k
            near[k] = np.inf
        return pd.DataFrame(out, columns=["block_id", "hap_a", "hap_b", "dist", "n_a", "n_b"])

    return kept.groupBy("block_id").applyInPandas(prim, "block_id string, hap_a string, hap_b string, dist int, n_a long, n_b long")


def diplotypes_phased(pairs: DataFrame) -> DataFrame:
    """block_id, id, hap1, hap2, diplotype (smaller/larger), heterozygous, phase_ambiguous, missing from g1/g2."""
    miss = F.contains("g1", F.lit(".")) | F.contains("g2", F.lit(".")) | F.col("g1").isNull() | F.col("g2").isNull()
    lo, hi = F.least("g1", "g2"), F.greatest("g1", "g2")
    return pairs.select(*BLOCK, F.col("sample_id").alias("id"), F.when(~miss, lo).alias("hap1"), F.when(~miss, hi).alias("hap2"), F.when(~miss, F.concat_ws("/", lo, hi)).alias("diplotype"), F.when(~miss, lo != hi).alias("heterozygous"), F.lit(False).alias("phase_ambiguous"), miss.alias("missing"))


def diplotypes_unphased(haps: DataFrame, max_het: int = 10) -> DataFrame:
    """Diplotypes from dosage strings. Homozygous strings give gametes directly; one heterozygous site is unambiguous; up
    to ``max_het`` sites every phase is scored by the gametes' frequencies among the unambiguous samples of the block (as
    gametes, so 2 counts as 1), ties stay ambiguous with the first phase; beyond it the phase is left open."""
    c = counts(haps)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = pdf.iloc[0]
        freq: dict[str, float] = {}
        for h, n in zip(pdf["hap"], pdf["n"]):
            if h.count("1") <= 1:
                for g in (h.replace("1", "0").replace("2", "1"), "".join("1" if x in "12" else "0" for x in h)):
                    freq[g] = freq.get(g, 0) + n
        rows = []
        for h in pdf["hap"]:
            het = [i for i, x in enumerate(h) if x == "1"]
            base = ["1" if x == "2" else "0" for x in h]
            if len(het) <= 1:
                other = base.copy()
                for i in het:
                    other[i] = "1"
                a, b, amb = "".join(base), "".join(other), False
            elif len(het) > max_het:
                a = b = None
                amb = True
            else:
                best: list[tuple[float, str, str]] = []
                for m in range(2 ** (len(het) - 1)):
                    x, y = base.copy(), base.copy()
                    for k, i in enumerate(het):
                        up = k == 0 or (m >> (k - 1)) & 1
                        (x if up else y)[i] = "1"
                    best.append((freq.get("".join(x), 0) * freq.get("".join(y), 0) + 1e-6 * (freq.get("".join(x), 0) + freq.get("".join(y), 0)), "".join(x), "".join(y)))
                top = max(v[0] for v in best)
                ties = [v for v in best if v[0] == top]
                _, a, b = ties[0]
                amb = len(ties) > 1
            if a is not None:
                a, b = min(a, b), max(a, b)
            rows.append((block["block_id"], h, a, b, amb))
        return pd.DataFrame(rows, columns=["block_id", "hap", "hap1", "hap2", "phase_ambiguous"])

    r = c.groupBy("block_id").applyInPandas(run, "block_id string, hap string, hap1 string, hap2 string, phase_ambiguous boolean")
    d = haps.join(r, ["block_id", "hap"], "left")
    return d.select(*BLOCK, F.col("sample_id").alias("id"), "hap1", "hap2", F.when(F.col("hap1").isNotNull(), F.concat_ws("/", "hap1", "hap2")).alias("diplotype"), (F.col("hap1") != F.col("hap2")).alias("heterozygous"), F.coalesce("phase_ambiguous", F.lit(False)).alias("phase_ambiguous"), F.contains("hap", F.lit(".")).alias("missing"))
