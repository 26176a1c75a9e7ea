"""Linkage blocks by cliques of variants in strong disequilibrium.

A chromosome is first cut where no strong pair crosses within a window (a distributed scan of the sparse pairs), and runs
longer than ``longest`` are cut at the weakest places; each piece is then segmented in one task of bounded size: graph
of strong pairs, greedy cliques (or communities), and the heaviest set of disjoint index ranges, repeated on what is left.
The two blocks beside a cut that was forced on a run are then segmented again as one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from allelica.functions.keys import materialize
from allelica.operators import ld
from allelica.operators.relational import range_join, ranked, running_sum

#: Maximal cliques that are listed at once; their number can be exponential. Where a piece has more, its densest
#: neighbourhoods are taken out as groups first, and its blocks say so (``method``).
CLIQUES_MAX = 20_000


def maximal_cliques(adj: np.ndarray, most: int = CLIQUES_MAX) -> list[list[int]] | None:
    """Maximal cliques of two or more nodes (pivoting search, sorted), or None if there are more than ``most``."""
    near = [set(np.flatnonzero(r).tolist()) for r in adj]
    out: list[list[int]] = []
    stack = [([], {i for i in range(len(adj)) if near[i]}, set())]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            if len(r) > 1:
                out.append(sorted(r))
                if len(out) > most:
                    return None
            continue
        pivot = max(sorted(p | x), key=lambda v: len(near[v] & p))
        for v in sorted(p - near[pivot]):
            stack.append(([*r, v], p & near[v], x & near[v]))
            p, x = p - {v}, x | {v}
    return sorted(out)


def louvain(weight: np.ndarray) -> np.ndarray:
    """Community of each node by modularity (local moving and aggregation until nothing gains); deterministic. Communities
    that are not connected are split."""
    n = len(weight)
    label, w, groups = np.arange(n), weight.astype(float).copy(), [[i] for i in range(n)]
    while True:
        k, total = w.sum(1), w.sum()
        if total <= 0:
            break
        com, moved = np.arange(len(w)), False
        sums = k.copy()
        improved = True
        while improved:
            improved = False
            for v in range(len(w)):
                own = com[v]
                sums[own] -= k[v]
                link = np.bincount(com, w[v], len(w))
                link[own] -= w[v, v]
                gain = link - k[v] * sums / total
                best = int(gain.argmax())
                if gain[best] <= gain[own] + 1e-12:
                    best = own
                sums[best] += k[v]
                if best != own:
                    com[v], improved, moved = best, True, True
        if not moved:
            break
        names = {c: i for i, c in enumerate(sorted(set(com.tolist())))}
        com = np.array([names[c] for c in com])
        merged: list[list[int]] = [[] for _ in names]
        for v, c in enumerate(com):
            merged[c] += groups[v]
        ind = np.zeros((len(w), len(names)))
        ind[np.arange(len(w)), com] = 1
        w, groups = ind.T @ w @ ind, merged
    at = 0
    for g in groups:
        left = set(g)
        while left:
            seen, todo = set(), [min(left)]
            while todo:
                v = todo.pop()
                if v in seen:
                    continue
                seen.add(v)
                todo += [u for u in np.flatnonzero(weight[v]).tolist() if u in left and u not in seen]
            for v in seen:
                label[v] = at
            at += 1
            left -= seen
    return label


def bins_of(r2: np.ndarray, pos: np.ndarray, cut: float = 0.5, mode: str = "density", gap: int = 40_000, most: int = CLIQUES_MAX) -> tuple[list[list[int]], str]:
    """Groups of variants in strong disequilibrium, disjoint, and how they were made. density: cliques by size / (span_kb +
    1); maximal: by size; louvain: communities with weight 1 / (distance_kb + 1). Groups are split where neighbours are more
    than ``gap`` apart. While there are more than ``most`` maximal cliques, the neighbours of the variant whose neighbours are
    most linked among each other (of the 30 % with most neighbours) are a group and leave the graph."""
    if mode not in ("density", "maximal", "louvain"):
        raise ValueError(f"unknown mode: {mode}")
    adj = r2 >= cut
    np.fill_diagonal(adj, False)

    def split(g: list[int]) -> list[list[int]]:
        out = [[g[0]]]
        for a, b in zip(g, g[1:]):
            if pos[b] - pos[a] > gap:
                out.append([])
            out[-1].append(b)
        return [x for x in out if len(x) > 1]

    if mode == "louvain":
        lab = louvain(np.where(adj, 1 / (np.abs(pos[:, None] - pos[None, :]) / 1000 + 1), 0))
        return [s for c in sorted(set(lab.tolist())) for s in split(np.flatnonzero(lab == c).tolist())], mode
    out, left = [], np.arange(len(pos))
    cliques = maximal_cliques(adj, most)
    while cliques is None:
        a = adj[np.ix_(left, left)].astype(float)
        deg = a.sum(1)
        dense = np.where((deg >= np.quantile(deg, 0.7)) & (deg > 1), (a @ a * a).sum(1) / np.maximum(1, deg * (deg - 1)), -1)
        core = np.flatnonzero(a[int(dense.argmax())])
        out += split(left[core].tolist())
        left = np.delete(left, core)
        mode_used = f"{mode}, cores first"
        cliques = maximal_cliques(adj[np.ix_(left, left)], most)
    made = mode if len(left) == len(pos) else mode_used
    pool = [s for c in cliques for s in split(left[c].tolist())]
    while pool:
        score = [len(c) / ((pos[c[-1]] - pos[c[0]]) / 1000 + 1) if mode == "density" else len(c) for c in pool]
        best = set(pool[int(np.argmax(score))])
        out.append(sorted(best))
        pool = [c for c in ([v for v in c if v not in best] for c in pool) if len(c) > 1]
    return out, made


def heaviest_disjoint(ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weighted interval scheduling: disjoint (start, end, weight) of largest total weight."""
    r = sorted(set(ranges), key=lambda x: (x[1], x[0]))
    ends = [x[1] for x in r]
    best, pick = [0] * (len(r) + 1), []
    for i, (s, _, w) in enumerate(r):
        j = int(np.searchsorted(ends, s, side="left"))
        pick.append((best[j] + w > best[i], j))
        best[i + 1] = max(best[i], best[j] + w)
    out, i = [], len(r)
    while i > 0:
        take, j = pick[i - 1]
        if take:
            out.append(r[i - 1])
            i = j
        else:
            i -= 1
    return out[::-1]


def blocks_of(groups: list[list[int]]) -> list[tuple[int, int]]:
    """Disjoint index ranges from groups: ranges of overlapping groups are joined into candidates, the heaviest disjoint
    ones are kept, their variants removed, and so on until no group of two is left."""
    out, pool = [], [g for g in groups if len(g) > 1]
    while pool:
        spans = sorted((g[0], g[-1], i) for i, g in enumerate(pool))
        cand: dict[tuple[int, int], int] = {}
        for s, e, i in spans:
            cand[s, e] = max(cand.get((s, e), 0), len(pool[i]))
        # runs of ranges that share a position: their union weighs all members
        run, members, hi = [], set(), -1
        for s, e, i in [*spans, (1 << 60, 1 << 60, -1)]:
            if run and s > hi:
                cand[run[0][0], hi] = max(cand.get((run[0][0], hi), 0), len(members))
                run, members, hi = [], set(), -1
            if i >= 0:
                run.append((s, e))
                members |= set(pool[i])
                hi = max(hi, e)
        got = heaviest_disjoint([(s, e, w) for (s, e), w in cand.items()])
        taken = [(s, e) for s, e, _ in got]
        out += taken
        pool = [h for h in ([v for v in g if not any(s <= v <= e for s, e in taken)] for g in pool) if len(h) > 1]
        pool = [h for h in pool if not any(h[0] <= e and s <= h[-1] for s, e in out)]
    return sorted(out)


def resolve_overlap(blocks: list[tuple[int, int]], r2: np.ndarray, k: int = 10) -> list[tuple[int, int]]:
    """Blocks without overlap. In an overlap each variant scores mean r2 with the last ``k`` of the left core minus that
    with the first ``k`` of the right one; the cut is after the last place where the running sum is not negative (none:
    all go right). A block inside another is merged into it."""
    todo, out = sorted(blocks, key=lambda b: (b[0], -b[1])), []
    for b in todo:
        if not out or out[-1][1] < b[0]:
            out.append(b)
            continue
        a = out[-1]
        if b[1] <= a[1]:
            continue
        left, right = np.arange(a[0], b[0])[-k:], np.arange(a[1] + 1, b[1] + 1)[:k]
        mid = np.arange(b[0], a[1] + 1)
        if not len(left):
            out[-1] = (a[0], max(a[1], b[1]))
            continue
        score = np.cumsum(r2[np.ix_(mid, left)].mean(1) - (r2[np.ix_(mid, right)].mean(1) if len(right) else 0))
        ok = np.flatnonzero(score >= 0)
        cut = b[0] + (int(ok[-1]) + 1 if len(ok) else 0)
        out[-1] = (a[0], cut - 1)
        out.append((cut, b[1]))
    return [b for b in out if b[1] >= b[0]]


def cut_points(variants: DataFrame, cut: float = 0.5, leng: int = 200, longest: int = 1500, max_bp: int = 5_000_000, pairs: DataFrame | None = None) -> DataFrame:
    """chr, pos, snp, rank, run, piece: runs end where no strong pair crosses. A run of more than ``longest`` variants is cut
    into pieces of at most that many: in each of its stretches of ``longest / 2``, but for the first and the last, after the
    variant that fewest strong pairs cross."""
    pairs = ld.pair_r2(variants, max_bp, cut) if pairs is None else pairs
    # both are read several times; written, they keep the plan (and the driver's memory) from growing with each reading
    scan = materialize(ld.boundary_scan(pairs, variants, leng, cut).select(F.col("chr").alias("_c"), F.col("snp").alias("_s"), "valid", "crossing"), "scan")
    r = ranked(variants).join(scan, F.expr("chr = _c and snp = _s"), "left").drop("_c", "_s")
    r = running_sum(r, "chr", "pos", ["pos", "snp"], F.coalesce("valid", F.lit(0)), "run").withColumn("run", F.col("run") - F.coalesce("valid", F.lit(0)))
    r = materialize(r, "runs")
    # a variant's place in its run, from the run's first rank
    first = r.groupBy(F.col("chr").alias("_c"), F.col("run").alias("_run")).agg(F.min("rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    r = r.join(first, F.expr("chr = _c and run = _run")).drop("_c", "_run")
    half = max(1, longest // 2)
    r = r.withColumn("_at", F.col("rank") - F.col("_first")).withColumn("_slot", F.floor(F.col("_at") / half)).withColumn("_slots", F.when(F.col("_n") > longest, F.floor((F.col("_n") - 1) / half) - 1).otherwise(0))
    weak = r.where("_slot between 1 and _slots").groupBy(F.col("chr").alias("_c"), F.col("run").alias("_run"), F.col("_slot").alias("_k")).agg(F.min(F.struct("crossing", "_at"))["_at"].alias("_cut"))
    r = r.join(weak, F.expr("chr = _c and run = _run and _slot = _k"), "left")
    before = F.greatest(F.lit(0), F.least(F.col("_slot") - 1, F.col("_slots"))) + F.coalesce((F.col("_at") > F.col("_cut")).cast("int"), F.lit(0))
    return r.select("chr", "pos", "snp", "rank", "run", F.concat_ws(":", "run", before).alias("piece"))


_COLUMNS = {"chr": "string", "start_ix": "int", "end_ix": "int", "start_rsid": "string", "end_rsid": "string", "start_bp": "int", "end_bp": "int", "n_snps": "int", "length_bp": "int", "method": "string"}
_SCHEMA = ", ".join(f"{k} {v}" for k, v in _COLUMNS.items())


def _blocks(pdf: pd.DataFrame, cut: float, mode: str, gap: int) -> list[tuple]:
    """Rows of ``_COLUMNS``: blocks of a piece's variants (in order of ix), in order."""
    x, _ = ld.matrix(pdf["sample_ids"].tolist(), pdf["dosages"].tolist())
    r2, pos, ix, snp = ld.r2_matrix(x), pdf["pos"].to_numpy(), pdf["ix"].to_numpy(), pdf["snp"].to_numpy()
    groups, made = bins_of(r2, pos, cut, mode, gap)
    found = resolve_overlap(blocks_of(groups), r2)
    return [(pdf["chr"].iloc[0], int(ix[s]), int(ix[e]), snp[s], snp[e], int(pos[s]), int(pos[e]), e - s + 1, int(pos[e] - pos[s] + 1), made) for s, e in found]


def segment(variants: DataFrame, cut: float = 0.5, mode: str = "density", leng: int = 200, longest: int = 1500, gap: int = 40_000, maf: float = 0.05, max_bp: int = 5_000_000, pairs: DataFrame | None = None, metric: str = "r2") -> DataFrame:
    """Blocks: chr, start_ix, end_ix (over all variants of the chromosome, in order), start_rsid, end_rsid, start_bp,
    end_bp, n_snps, length_bp, method. ``metric``: r2, or rV2 (of the kept variants whitened by their kinship). Variants below ``maf`` or without variance take part in no graph but count in the indices.
    ``pairs``: r2 of pairs that are computed already, at least those with r2 >= cut."""
    if pairs is None:
        # read by the frequency filter, the pairs, the ranks and the pieces
        variants = materialize(variants, "variants")
    ranks = ranked(variants, "ix")
    f = F.aggregate("dosages", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + F.coalesce(x, F.lit(0.0))).alias("s"), (a["n"] + x.isNotNull().cast("int")).alias("n")), lambda a: F.try_divide(a["s"], 2 * a["n"]))
    good = variants.withColumn("_f", f).where(F.least(F.col("_f"), 1 - F.col("_f")) >= maf).drop("_f")
    if metric == "rV2":
        good = materialize(ld.whitened(good), "whitened")
    elif metric != "r2":
        raise ValueError(f"unknown metric: {metric}")
    pieces = cut_points(good, cut, leng, longest, max_bp, pairs).select(F.col("chr").alias("_c"), F.col("snp").alias("_s"), "run", "piece")
    # read by the segmentation and by the search for forced cuts
    pieces = materialize(pieces.join(ranks.select("chr", "snp", "ix"), F.expr("chr = _c and snp = _s")).select("_c", "_s", "run", "piece", "ix"), "pieces")
    d = good.join(pieces, F.expr("chr = _c and snp = _s")).drop("_c", "_s")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ix").reset_index(drop=True)
        return pd.DataFrame(_blocks(pdf, cut, mode, gap), columns=[*_COLUMNS]).assign(run=pdf["run"][0], piece=pdf["piece"][0])

    b = d.groupBy("chr", "piece").applyInPandas(run, f"{_SCHEMA}, run int, piece string")
    if pieces.where("piece not like '%:0'").isEmpty():
        return b.drop("run", "piece")
    return _joined(materialize(b, "blocks"), d, cut, mode, gap)


def _joined(blocks: DataFrame, d: DataFrame, cut: float, mode: str, gap: int) -> DataFrame:
    """Blocks after the two on either side of each forced cut have been segmented again as one, from the left: where a piece
    is a single block, the last block of the left union goes into the next. Such a chain is one task; others are pairs."""
    w = W.partitionBy("chr").orderBy("start_ix")
    linked = (F.lag("run").over(w) == F.col("run")) & (F.lag("piece").over(w) != F.col("piece"))
    b = blocks.withColumn("_new", F.when(linked, 0).otherwise(1)).withColumn("chain", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    chains = b.groupBy(F.col("chr").alias("_c"), "chain").agg(F.min("start_ix").alias("_lo"), F.max("end_ix").alias("_hi"), F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(F.struct("start_ix", "end_ix"))).alias("_b")).where("_n > 1")
    alone = b.join(chains.select("_c", F.col("chain").alias("_k")), F.expr("chr = _c and chain = _k"), "left_anti").select(*_COLUMNS)
    x = d.join(chains, F.expr("chr = _c and ix between _lo and _hi"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ix").reset_index(drop=True)
        parts, out, last = [(p["start_ix"], p["end_ix"]) for p in pdf["_b"][0]], [], []
        at = parts[0][0]
        for _, end in parts[1:]:
            found = _blocks(pdf[(pdf["ix"] >= at) & (pdf["ix"] <= end)], cut, mode, gap)
            out, last = out + found[:-1], found[-1:]
            at = last[0][1] if last else end + 1
        return pd.DataFrame(out + last, columns=[*_COLUMNS])

    return alone.unionByName(x.groupBy("chr", "chain").applyInPandas(run, _SCHEMA))


def append_rare(blocks: DataFrame, pairs: DataFrame, snps: DataFrame, share: float = 0.6, cut: float = 0.5, mode: str = "density", gap: int = 40_000) -> DataFrame:
    """Blocks extended to the furthest variant before the neighbouring block that is strong with more than ``share`` of the
    block's variants (pairs: all strong pairs). Where extensions meet, the union of these blocks is segmented anew, and so
    are the variants that stay between blocks, rare ones too (``snps`` has their dosages)."""
    r = materialize(ranked(snps, "ix"), "ranks")
    blocks = materialize(blocks.select("chr", "start_ix", "end_ix"), "blocks")
    w = W.partitionBy("chr").orderBy("start_ix")
    b = blocks.withColumn("_lo", F.coalesce(F.lag("end_ix").over(w), F.lit(0))).withColumn("_hi", F.coalesce(F.lead("start_ix").over(w), F.lit(1 << 30)))
    both = pairs.select("chr", "snp_i", "snp_j").withColumn("p", F.explode(F.array(F.struct("snp_i", "snp_j"), F.struct(F.col("snp_j").alias("snp_i"), F.col("snp_i").alias("snp_j"))))).select("chr", "p.snp_i", "p.snp_j")
    i, j = r.select(F.col("chr").alias("c1"), F.col("snp").alias("s1"), F.col("ix").alias("i")), r.select(F.col("chr").alias("c2"), F.col("snp").alias("s2"), F.col("ix").alias("j"))
    edges = both.join(i, F.expr("chr = c1 and snp_i = s1")).join(j, F.expr("chr = c2 and snp_j = s2")).select("chr", "i", "j")
    n = range_join(edges, b, "j", "start_ix", "end_ix").where("i > _lo and i < _hi and not i between start_ix and end_ix").groupBy("chr", "start_ix", "end_ix", "i").agg(F.countDistinct("j").alias("n"))
    ext = n.where(F.col("n") > share * (F.col("end_ix") - F.col("start_ix") + 1)).groupBy("chr", "start_ix", "end_ix").agg(F.min("i").alias("_a"), F.max("i").alias("_z"))
    d = blocks.join(ext, ["chr", "start_ix", "end_ix"], "left").select("chr", F.least("start_ix", F.coalesce("_a", "start_ix")).alias("start_ix"), F.greatest("end_ix", F.coalesce("_z", "end_ix")).alias("end_ix"), F.col("start_ix").alias("_own"))
    # blocks whose extensions meet are one extent; an extension ends before the next block, so only neighbours meet
    w = W.partitionBy("chr").orderBy("_own")
    d = d.withColumn("_new", F.when(F.col("start_ix") <= F.lag("end_ix").over(w), 0).otherwise(1)).withColumn("_k", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    d = materialize(d.groupBy("chr", "_k").agg(F.min("start_ix").alias("start_ix"), F.max("end_ix").alias("end_ix"), F.count(F.lit(1)).alias("_n")), "extents")
    # every variant's last extent that starts before it; those in a single extended block are settled
    starts = d.select(F.col("chr").alias("_c"), F.col("start_ix").alias("_s"))
    at = running_sum(r.join(starts, F.expr("chr = _c and ix = _s"), "left"), "chr", "pos", ["pos", "snp"], F.col("_s").isNotNull().cast("int"), "_at")
    at = at.join(d.select(F.col("chr").alias("_c1"), "_k", "end_ix", "_n"), F.expr("chr = _c1 and _at = _k"), "left").withColumn("_in", F.coalesce(F.expr("ix <= end_ix"), F.lit(False)))
    at = at.where("not _in or _n > 1").select(F.col("chr").alias("_c"), F.col("snp").alias("_s"), F.concat_ws("\x1f", "chr", "_at", "_in").alias("_region"))
    left = snps.join(at, F.expr("chr = _c and snp = _s")).drop("chr", "_c", "_s").withColumnRenamed("_region", "chr").select("chr", "pos", "snp", "sample_ids", "dosages")
    new = segment(left, cut, mode, gap=gap, maf=0.0).select(F.split("chr", "\x1f")[0].alias("chr"), "start_rsid", "end_rsid")
    i, j = i.withColumnRenamed("i", "start_ix"), j.withColumnRenamed("j", "end_ix")
    new = new.join(i, F.expr("chr = c1 and start_rsid = s1")).join(j, F.expr("chr = c2 and end_rsid = s2")).select("chr", "start_ix", "end_ix")
    d = d.where("_n = 1").select("chr", "start_ix", "end_ix").unionByName(new)
    s = r.select(F.col("chr").alias("c1"), F.col("ix").alias("i"), F.col("snp").alias("start_rsid"), F.col("pos").alias("start_bp"))
    e = r.select(F.col("chr").alias("c2"), F.col("ix").alias("j"), F.col("snp").alias("end_rsid"), F.col("pos").alias("end_bp"))
    return d.join(s, F.expr("chr = c1 and start_ix = i")).join(e, F.expr("chr = c2 and end_ix = j")).select("chr", "start_ix", "end_ix", "start_rsid", "end_rsid", "start_bp", "end_bp", (F.col("end_ix") - F.col("start_ix") + 1).alias("n_snps"), (F.col("end_bp") - F.col("start_bp") + 1).alias("length_bp"))


def with_singletons(blocks: DataFrame, snps: DataFrame) -> DataFrame:
    """Blocks (chr, start_bp, end_bp, n_snps) and one of a single variant for every variant in none. Repeated variants
    count once; variants without a place make no block."""
    s = snps.where("chr is not null and pos is not null").select("chr", "pos", "snp").distinct()
    inside = range_join(s, blocks.select("chr", "start_bp", "end_bp")).select(F.col("chr").alias("_c"), F.col("pos").alias("_p"), F.col("snp").alias("_s")).distinct()
    alone = s.join(inside, F.expr("chr = _c and pos = _p and snp <=> _s"), "left_anti")
    one = alone.select("chr", F.col("pos").alias("start_bp"), F.col("pos").alias("end_bp"), F.lit(1).alias("n_snps"))
    return blocks.select("chr", "start_bp", "end_bp", "n_snps").unionByName(one)


def summarise(blocks: DataFrame) -> DataFrame:
    """chr (GENOME for all), n_blocks, min_bp, median_bp, mean_bp, max_bp, total_bp_covered."""
    n = F.col("end_bp") - F.col("start_bp") + 1
    d = blocks.withColumn("_n", n).rollup("chr").agg(F.grouping("chr").alias("_g"), F.count(F.lit(1)).alias("n_blocks"), F.min("_n").alias("min_bp"), F.median("_n").alias("median_bp"), F.avg("_n").alias("mean_bp"), F.max("_n").alias("max_bp"), F.sum("_n").alias("total_bp_covered"))
    return d.select(F.when(F.col("_g") == 1, "GENOME").otherwise(F.col("chr")).alias("chr"), "n_blocks", "min_bp", "median_bp", "mean_bp", "max_bp", "total_bp_covered")


def tune(variants: DataFrame, gwas: DataFrame, grid: list[dict], band: tuple[int, int] = (50_000, 500_000)) -> DataFrame:
    """Score of every parameter set: row, n_blocks, n_outside, n_forced, n_unassigned, median_block_bp, penalty_bp, best.

    Hits outside blocks are forced to the nearest (n_outside counts them, n_unassigned those on chromosomes without a
    block). Best: no forced or unassigned hit with fewest blocks, otherwise the least (unassigned, forced, blocks,
    penalty); the penalty is the median's distance from the band."""
    from allelica.operators.relational import nearest_interval

    spark, out = variants.sparkSession, None
    if grid:
        # the strong pairs of the lowest cut serve all parameter sets
        variants = materialize(variants, "variants")
        pairs = materialize(ld.pair_r2(variants, 5_000_000, min(p.get("cut", 0.5) for p in grid)), "pairs")
    for i, p in enumerate(grid):
        b = materialize(segment(variants, pairs=pairs, **p).select(F.concat_ws("_", F.lit("block"), "chr", "start_bp", "end_bp").alias("block_id"), "chr", "start_bp", "end_bp"), "blocks")
        a = nearest_interval(gwas, b, "snp").agg(F.count_if("forced").alias("n_forced"), F.count_if(F.col("block_id").isNull()).alias("n_unassigned"))
        m = b.agg(F.count(F.lit(1)).alias("n_blocks"), F.median(F.col("end_bp") - F.col("start_bp") + 1).alias("median_block_bp"))
        s = a.join(m).select(F.lit(i).alias("row"), F.lit(str(sorted(p.items()))).alias("params"), "n_blocks", (F.col("n_forced") + F.col("n_unassigned")).alias("n_outside"), "n_forced", "n_unassigned", "median_block_bp", F.greatest(F.lit(0.0), band[0] - F.col("median_block_bp"), F.col("median_block_bp") - band[1]).alias("penalty_bp"))
        out = s if out is None else out.unionByName(s)
    if out is None:
        return spark.createDataFrame([], "row int, params string, n_blocks long, n_outside long, n_forced long, n_unassigned long, median_block_bp double, penalty_bp double, best boolean")
    r = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("n_unassigned", "n_forced", "n_blocks", "penalty_bp", "row"))
    return out.withColumn("best", r == 1)


#: Parameter sets that are tried where none are given.
GRID = [{"cut": c, "leng": 1000, "longest": 10_000, "gap": 2_000_000} for c in (0.65, 0.70, 0.75, 0.80)]


def tuned(variants: DataFrame, gwas: DataFrame, grid: list[dict] | None = None, band: tuple[int, int] = (50_000, 500_000)) -> tuple[DataFrame, DataFrame]:
    """(scores of all parameter sets, blocks by the best)."""
    grid = GRID if grid is None else grid
    scores = materialize(tune(variants, gwas, grid, band), "scores")
    best = scores.where("best").first()
    if best is None:
        raise ValueError("no parameter sets")
    return scores, segment(variants, **grid[best["row"]])
