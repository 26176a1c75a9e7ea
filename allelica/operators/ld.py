"""Linkage disequilibrium of variant pairs, from variant-major genotypes.

A variant is one row with its dosages in sample order. Pairs are computed in tiles: variants of a chromosome are filed in
position bins (as wide as the largest distance) and bins are cut into tiles of about ``TILE`` variants; every pair of tiles
that can hold a pair becomes one task group of at most two tiles, in which all r2 come from one matrix product. A group's
size is thus bounded by the tile and the number of samples, however many variants a chromosome or a bin has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.operators.relational import ranked, running_sum

TILE = 512


def variant_major(geno: DataFrame) -> DataFrame:
    """chr, pos, snp, sample_ids, dosages: one row a variant, samples in order of their id. Samples without a row for a
    variant are missing in it, as if their dosage were null."""
    d = geno.groupBy("chr", "pos", "snp").agg(F.array_sort(F.collect_list(F.struct("sample_id", F.col("dosage").cast("double").alias("d")))).alias("_a"))
    return d.select("chr", "pos", "snp", F.col("_a.sample_id").alias("sample_ids"), F.col("_a.d").alias("dosages"))


def matrix(ids: list, values: list, order: dict | None = None) -> tuple[np.ndarray, dict]:
    """samples x variants with NaN where missing. The common case, all variants with the same samples, needs no lookup."""
    if order is None:
        first = ids[0]
        if all(len(i) == len(first) and np.array_equal(i, first) for i in ids):
            return np.array([np.asarray(v, float) for v in values]).T, {s: k for k, s in enumerate(first)}
        order = {s: k for k, s in enumerate(sorted({s for i in ids for s in i}))}
    out = np.full((len(order), len(ids)), np.nan)
    for j, (i, v) in enumerate(zip(ids, values)):
        out[[order[s] for s in i], j] = np.asarray(v, float)
    return out, order


def standardize(x: np.ndarray) -> np.ndarray:
    """Columns mean-imputed and scaled by n - 1; columns without variance (sd <= 1e-10) become 0."""
    with np.errstate(invalid="ignore"):
        seen = np.isfinite(x)
        mean = np.where(seen, x, 0).sum(0) / np.maximum(seen.sum(0), 1)
    z = np.where(seen, x - mean, 0.0)
    sd = np.sqrt((z**2).sum(0) / max(1, len(x) - 1))
    return np.where(sd > 1e-10, z / np.where(sd > 1e-10, sd, 1), 0.0)


def r2_matrix(x: np.ndarray, y: np.ndarray | None = None, digits: int | None = None) -> np.ndarray:
    """Squared correlation of columns, capped at 1; the diagonal is 0 when y is not given."""
    a = standardize(x)
    b = a if y is None else standardize(y)
    r = np.minimum((a.T @ b / max(1, len(x) - 1)) ** 2, 1.0)
    if y is None:
        np.fill_diagonal(r, 0.0)
    return r if digits is None else np.round(r, digits)


def pair_r2(variants: DataFrame, max_bp: int | None = None, threshold: float = 0.0, tile: int = TILE) -> DataFrame:
    """chr, snp_i, pos_i, snp_j, pos_j, dist_bp, r2 for pairs of a chromosome with pos_i <= pos_j (ties by id), at most
    ``max_bp`` apart (all pairs without it) and r2 >= threshold. A variant with a null position is in no pair."""
    v = variants.where("pos is not null and chr is not null")
    width = max_bp or (1 << 31)
    v = v.withColumn("_bin", F.floor(F.col("pos") / F.lit(width)).cast("long"))
    size = v.groupBy(F.col("chr").alias("_c"), F.col("_bin").alias("_b")).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_tiles"))
    nxt = size.select(F.col("_c").alias("_c2"), (F.col("_b") - 1).alias("_b2"), F.col("_tiles").alias("_after"))
    prv = size.select(F.col("_c").alias("_c3"), (F.col("_b") + 1).alias("_b3"), F.col("_tiles").alias("_before"))
    size = size.join(nxt, F.expr("_c = _c2 and _b = _b2"), "left").join(prv, F.expr("_c = _c3 and _b = _b3"), "left").select("_c", "_b", "_tiles", F.coalesce("_after", F.lit(0)).alias("_after"), F.coalesce("_before", F.lit(0)).alias("_before"))
    d = v.join(size, F.expr("chr = _c and _bin = _b"))
    d = d.withColumn("_tile", F.pmod(F.xxhash64("snp"), F.col("_tiles")).cast("int"))
    # the groups a tile is part of: with each tile of its own bin, of the next bin and of the bin before
    own = "transform(sequence(0, _tiles - 1), t -> named_struct('b1', _bin, 't1', least(t, _tile), 'b2', _bin, 't2', greatest(t, _tile)))"
    after = "transform(filter(sequence(0, _after), t -> t < _after), t -> named_struct('b1', _bin, 't1', _tile, 'b2', _bin + 1, 't2', t))"
    before = "transform(filter(sequence(0, _before), t -> t < _before), t -> named_struct('b1', _bin - 1, 't1', t, 'b2', _bin, 't2', _tile))"
    parts = own if max_bp is None else f"concat({own}, {after}, {before})"
    d = d.select("chr", "pos", "snp", "sample_ids", "dosages", "_bin", "_tile", F.explode(F.expr(parts)).alias("g"))
    schema = "chr string, snp_i string, pos_i int, snp_j string, pos_j int, dist_bp int, r2 double"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "snp"], kind="stable")
        x, _ = matrix(pdf["sample_ids"].tolist(), pdf["dosages"].tolist())
        pos, name = pdf["pos"].to_numpy(), pdf["snp"].to_numpy()
        side = (pdf["_bin"].to_numpy() == key[1]) & (pdf["_tile"].to_numpy() == key[2])
        same = key[1:3] == key[3:5]
        r = r2_matrix(x)
        i, j = np.triu_indices(len(pos), 1)
        ok = (pos[j] - pos[i] <= width) & (r[i, j] >= threshold)
        if not same:
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        return pd.DataFrame({"chr": key[0], "snp_i": name[i], "pos_i": pos[i], "snp_j": name[j], "pos_j": pos[j], "dist_bp": pos[j] - pos[i], "r2": r[i, j]})

    return d.groupBy("chr", F.col("g.b1").alias("b1"), F.col("g.t1").alias("t1"), F.col("g.b2").alias("b2"), F.col("g.t2").alias("t2")).applyInPandas(run, schema)


def column_r2(variants: DataFrame, snp: str) -> DataFrame:
    """snp, r2 of every variant with one of them (itself: 0). The query variant is one row, sent to all tasks."""
    q = variants.where(F.col("snp") == snp).limit(1).collect()
    if not q:
        raise ValueError(f"unknown variant: {snp}")
    q_ids, q_val = list(q[0]["sample_ids"]), list(q[0]["dosages"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, _ = matrix([q_ids, *pdf["sample_ids"].tolist()], [q_val, *pdf["dosages"].tolist()])
                r = r2_matrix(x[:, :1], x[:, 1:])[0]
                yield pd.DataFrame({"chr": pdf["chr"], "pos": pdf["pos"], "snp": pdf["snp"], "r2": np.where(pdf["snp"] == snp, 0.0, r)})

    return variants.mapInPandas(run, "chr string, pos int, snp string, r2 double")


def cross_r2(variants: DataFrame, n_unlinked: int = 50_000, seed: int = 42, most_chr: int = 1000) -> DataFrame:
    """r2 of about ``n_unlinked`` pairs of variants on different chromosomes: snp_i, snp_j, r2. As many variants of each
    chromosome as give that many pairs, drawn by hash, of at most ``most_chr`` chromosomes, drawn likewise.

    This is the unlinked background: a stated sample, the operator's purpose. Its matrix, in one task, has about
    ``sqrt(2 n_unlinked)`` columns and one per chromosome at most, however large the panel is.
    """
    from pyspark.sql import Window as W

    chrs = variants.select("chr").distinct().orderBy(F.xxhash64("chr", F.lit(seed)), "chr").limit(most_chr)
    c = max(2, chrs.count())
    n_side = int(np.ceil(np.sqrt(2 * n_unlinked / (c * (c - 1)))))
    d = variants.join(F.broadcast(chrs), "chr", "left_semi")
    d = d.withColumn("_r", F.row_number().over(W.partitionBy("chr").orderBy(F.xxhash64("snp", F.lit(seed)), "snp"))).where(F.col("_r") <= n_side)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chr", "pos", "snp"])
        x, _ = matrix(pdf["sample_ids"].tolist(), pdf["dosages"].tolist())
        r, c, s = r2_matrix(x), pdf["chr"].to_numpy(), pdf["snp"].to_numpy()
        i, j = np.triu_indices(len(s), 1)
        ok = c[i] != c[j]
        return pd.DataFrame({"snp_i": s[i[ok]], "snp_j": s[j[ok]], "r2": r[i[ok], j[ok]]})

    return d.groupBy(F.lit(0).alias("one")).applyInPandas(lambda p: run(p), "snp_i string, snp_j string, r2 double")


def boundary_scan(pairs: DataFrame, snps: DataFrame, half: int, threshold: float) -> DataFrame:
    """chr, pos, snp, rank, valid, crossing: valid is 1 if no pair of variants across the cut after this variant, within
    ``half`` variants on either side, has r2 >= threshold; crossing counts them. The last variant of a chromosome is no cut.

    A strong pair (i, j) blocks the cuts max(i, j - half) .. min(j - 1, i + half - 1); blocked stretches are counted by a
    running sum of their ends.
    """
    ranks = ranked(snps)
    a = ranks.select(F.col("snp").alias("snp_i"), F.col("rank").alias("i"), F.col("chr").alias("_c"))
    b = ranks.select(F.col("snp").alias("snp_j"), F.col("rank").alias("j"), F.col("chr").alias("_d"))
    strong = pairs.where(F.col("r2") >= threshold).join(a, (F.col("chr") == F.col("_c")) & (pairs["snp_i"] == a["snp_i"])).join(b, (F.col("chr") == F.col("_d")) & (pairs["snp_j"] == b["snp_j"])).select("chr", "i", "j")
    strong = strong.where(F.col("j") - F.col("i") <= 2 * half - 1)
    lo, hi = F.greatest("i", F.col("j") - half), F.least(F.col("j") - 1, F.col("i") + half - 1)
    ends = strong.where(lo <= hi).select("chr", F.explode(F.array(F.struct(lo.alias("at"), F.lit(1).alias("v")), F.struct((hi + 1).alias("at"), F.lit(-1).alias("v")))).alias("e"))
    ends = ends.groupBy(F.col("chr").alias("_c"), F.col("e.at").alias("_at")).agg(F.sum("e.v").alias("_v"))
    d = ranks.join(ends, F.expr("chr = _c and rank = _at"), "left").drop("_c", "_at")
    d = running_sum(d, "chr", "pos", ["pos", "snp"], F.coalesce("_v", F.lit(0)), "_n")
    last = ranks.groupBy(F.col("chr").alias("_c")).agg(F.max("rank").alias("_last"))
    d = d.join(last, F.expr("chr = _c")).drop("_c")
    return d.where("rank < _last").select("chr", "pos", "snp", "rank", (F.col("_n") == 0).cast("int").alias("valid"), F.col("_n").alias("crossing"))


def kinship(variants: DataFrame, samples_max: int = 20_000) -> tuple[np.ndarray, list]:
    """VanRaden relationship of samples, for whitening: each task sums ZZ' of its variants; the sums (n x n) are added up."""
    ids = sorted({s for r in variants.select(F.explode("sample_ids").alias("s")).distinct().collect() for s in r})
    if len(ids) > samples_max:
        raise ValueError(f"{len(ids)} samples; kinship is kept on one machine up to {samples_max}")
    order = {s: k for k, s in enumerate(ids)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, scale = np.zeros((len(ids), len(ids))), 0.0
        for pdf in batches:
            if len(pdf):
                x, _ = matrix(pdf["sample_ids"].tolist(), pdf["dosages"].tolist(), order)
                p = np.nanmean(x, 0) / 2
                z = np.where(np.isfinite(x), x - 2 * p, 0)
                g += z @ z.T
                scale += float(2 * (p * (1 - p)).sum())
        yield pd.DataFrame({"g": [g.tobytes()], "scale": [scale]})

    total, scale = np.zeros((len(ids), len(ids))), 0.0
    for r in variants.mapInPandas(run, "g binary, scale double").toLocalIterator():
        total += np.frombuffer(r["g"]).reshape(total.shape)
        scale += r["scale"]
    return total / max(scale, 1e-12), ids


def whitener(v: np.ndarray, method: str = "eigen", ridge: float = 0.01) -> np.ndarray:
    """A with A V A' = I: by eigenvalues (those below 1e-6 left out) or by the Cholesky factor's inverse. A V that isn't
    definite has no Cholesky factor: only then it is bent by ``ridge`` towards the identity."""
    if method == "chol":
        try:
            return np.linalg.inv(np.linalg.cholesky(v))
        except np.linalg.LinAlgError:
            return np.linalg.inv(np.linalg.cholesky((1 - ridge) * v + ridge * np.eye(len(v))))
    val, vec = np.linalg.eigh(v)
    keep = val >= 1e-6
    return (vec[:, keep] / np.sqrt(val[keep])) @ vec[:, keep].T


def whitened(variants: DataFrame, method: str = "eigen") -> DataFrame:
    """Variants with mean-imputed, centred dosages multiplied by the inverse root of the kinship: r2 of these is rV2."""
    v, ids = kinship(variants)
    a = variants.sparkSession.sparkContext.broadcast(whitener(v, method))
    order = {s: k for k, s in enumerate(ids)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, _ = matrix(pdf["sample_ids"].tolist(), pdf["dosages"].tolist(), order)
                x = np.where(np.isfinite(x), x - np.nanmean(x, 0), 0)
                out = pdf[["chr", "pos", "snp"]].copy()
                out["sample_ids"] = [ids] * len(pdf)
                out["dosages"] = list((a.value @ x).T)
                yield out

    return variants.mapInPandas(run, variants.schema)
