"""Joins and windows that the genomic operators share: point in interval, nearest interval, interval overlap, band pairs.

Interval joins are equi joins on dyadic bins: an interval is filed at the level of its length, where it touches at most
two bins; a point looks into one bin per level that occurs. No side is broadcast by hand and no interval length makes
many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OFFSET = 1 << 31


def _filed(intervals: DataFrame, start: str, end: str) -> DataFrame:
    s, e = F.col(start).cast("long") + OFFSET, F.col(end).cast("long") + OFFSET
    level = F.ceil(F.log2(F.greatest(e - s + 1, F.lit(1)).cast("double"))).cast("int")
    d = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))).withColumn("_level", level).withColumn("_s", s).withColumn("_e", e)
    return d.withColumn("_bin", F.explode(F.array_distinct(F.expr("array(shiftright(_s, _level), shiftright(_e, _level))")))).drop("_s", "_e")


def _levels(filed: DataFrame) -> list[int]:
    return sorted(r[0] for r in filed.select("_level").distinct().collect())


def range_join(points: DataFrame, intervals: DataFrame, pos: str = "pos", start: str = "start_bp", end: str = "end_bp", how: str = "inner") -> DataFrame:
    """Pairs of a point and an interval of the same ``chr`` with start <= pos <= end (closed). ``how``: inner or left
    (keeps points without an interval). Null chromosomes, positions or bounds match nothing. The intervals' ``chr`` is
    not repeated; other columns of equal name must be renamed before."""
    filed = _filed(intervals, start, end).withColumnRenamed("chr", "_chr")
    levels = _levels(filed)
    if not levels:
        empty = filed.drop("_chr", "_level", "_bin")
        return points.join(empty, F.lit(False), "left") if how == "left" else points.join(empty, F.lit(False))
    p = points.withColumn("_pid", F.monotonically_increasing_id()) if how == "left" else points
    looked = p.where(F.col(pos).isNotNull()).withColumn("_plevel", F.explode(F.array(*[F.lit(x) for x in levels])))
    looked = looked.withColumn("_pbin", F.expr(f"shiftright(cast({pos} as long) + {OFFSET}L, _plevel)"))
    hit = looked.join(filed, (F.col("chr") == F.col("_chr")) & (F.col("_plevel") == F.col("_level")) & (F.col("_pbin") == F.col("_bin")) & F.col(pos).between(F.col(start), F.col(end)))
    hit = hit.drop("_chr", "_level", "_bin", "_plevel", "_pbin")
    if how == "inner":
        return hit
    own = [c for c in hit.columns if c not in p.columns]
    return p.join(hit.select("_pid", *own), "_pid", "left").drop("_pid")


def interval_ranks(points: DataFrame, intervals: DataFrame, pos: str = "pos", start: str = "start_bp", end: str = "end_bp") -> DataFrame:
    """Intervals that hold a point of their ``chr`` (start <= pos <= end, closed), with ``before`` (points below the start),
    ``through`` (points up to the end), ``first_pos`` and ``last_pos``: the points inside are those of ranks before + 1 to
    through of the chromosome, and no pair of a point and an interval is formed.

    A sweep over points and bounds in tiles of 2^20 positions; counts and neighbours of whole tiles come from a small table
    of tiles. Joins are merges by hint: Spark's estimates are too low here for it to choose a broadcast through the driver.
    Null chromosomes, positions or bounds match nothing.
    """
    tile = F.expr("shiftright(cast(_p as long) + 2147483648L, 20)")
    iv = intervals.where(F.col("chr").isNotNull() & (F.col(end) >= F.col(start)))
    bounds = iv.select("chr", F.col(start).alias("_s"), F.col(end).alias("_e")).distinct()
    bounds = bounds.select("chr", "_s", "_e", F.explode(F.array(F.struct(F.col("_s").alias("_p"), F.lit(0).alias("_o")), F.struct(F.col("_e").alias("_p"), F.lit(2).alias("_o")))).alias("_b")).select("chr", F.col("_b._p").alias("_p"), F.col("_b._o").alias("_o"), "_s", "_e")
    own = points.where(F.col("chr").isNotNull() & F.col(pos).isNotNull()).select("chr", F.col(pos).alias("_p"), F.lit(1).alias("_o"))
    allr = own.unionByName(bounds, allowMissingColumns=True).withColumn("_tile", tile)
    at = F.when(F.col("_o") == 1, F.col("_p"))
    up, down = (W.partitionBy("_c").orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc("_t"), F.desc("_t")))
    edge = allr.groupBy(F.col("chr").alias("_c"), F.col("_tile").alias("_t")).agg(F.count(at).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    edge = edge.select("_c", "_t", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_off"), F.max("_hi").over(up).alias("_below"), F.min("_lo").over(down).alias("_above"))
    up, down = (W.partitionBy("chr", "_tile").orderBy(*o).rowsBetween(W.unboundedPreceding, 0) for o in ((F.asc("_p"), F.asc("_o")), (F.desc("_p"), F.desc("_o"))))
    swept = allr.select("chr", "_tile", "_o", "_s", "_e", F.count(at).over(up).alias("_k"), F.max(at).over(up).alias("_left"), F.min(at).over(down).alias("_right")).where("_o <> 1")
    swept = swept.join(edge.hint("merge"), (F.col("chr") == F.col("_c")) & (F.col("_tile") == F.col("_t")))
    opened, k = F.col("_o") == 0, F.col("_off") + F.col("_k")
    g = swept.groupBy(F.col("chr").alias("_chr"), "_s", "_e").agg(
        F.max(F.when(opened, k)).alias("before"), F.max(F.when(~opened, k)).alias("through"),
        F.max(F.when(opened, F.coalesce("_right", "_above"))).alias("first_pos"), F.max(F.when(~opened, F.coalesce("_left", "_below"))).alias("last_pos"),
    ).where("through > before")
    return iv.join(g.hint("merge"), (F.col("chr") == F.col("_chr")) & (F.col(start) == F.col("_s")) & (F.col(end) == F.col("_e"))).drop("_chr", "_s", "_e")


def overlap_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of intervals (chr, s1, e1, ...) and (chr, s2, e2, ...) of one chromosome that share a position. Each pair is
    found once: through the start of one inside the other."""
    one = range_join(b.withColumnRenamed("s2", "_p"), a, "_p", "s1", "e1").withColumnRenamed("_p", "s2")
    two = range_join(a.withColumnRenamed("s1", "_p"), b, "_p", "s2", "e2").withColumnRenamed("_p", "s1").where("s1 > s2")
    return one.unionByName(two)


def iou_match(a: DataFrame, b: DataFrame, overlap_min: float = 0.5) -> DataFrame:
    """Best match of each block of ``a`` (block_id, chr, start_bp, end_bp) among those of ``b`` by intersection over union.

    Lengths are differences of bounds (no + 1), so touching blocks have 0. Ties go to the first block of ``b`` by start and
    id. Blocks without a match, or one below ``overlap_min``, are ``pop1_only`` with nulls; equal ids are ``exact``.
    """
    x = a.select(F.col("block_id").alias("block_id_pop1"), "chr", F.col("start_bp").alias("s1"), F.col("end_bp").alias("e1"))
    y = b.select(F.col("block_id").alias("block_id_pop2"), "chr", F.col("start_bp").alias("s2"), F.col("end_bp").alias("e2"))
    inter = F.greatest(F.lit(0), F.least("e1", "e2") - F.greatest("s1", "s2"))
    union = F.greatest(F.lit(1), F.greatest("e1", "e2") - F.least("s1", "s2"))
    pairs = overlap_join(x, y).withColumn("iou", inter / union)
    # the best of few candidates without a sort: the smallest (-iou, start, id)
    best = pairs.groupBy("block_id_pop1").agg(F.min(F.struct((-F.col("iou")).alias("m"), "s2", "block_id_pop2", "e2")).alias("b"))
    d = x.join(best, "block_id_pop1", "left")
    ok = F.coalesce(-F.col("b.m") >= overlap_min, F.lit(False))
    kind = F.when(~ok, "pop1_only").when(F.col("block_id_pop1") == F.col("b.block_id_pop2"), "exact").otherwise("position")
    return d.select(
        "block_id_pop1", F.col("chr").alias("chr_pop1"), F.col("s1").alias("start_pop1"), F.col("e1").alias("end_pop1"),
        F.when(ok, F.col("b.block_id_pop2")).alias("block_id_pop2"), F.when(ok, F.col("b.s2")).alias("start_pop2"), F.when(ok, F.col("b.e2")).alias("end_pop2"),
        F.when(ok, -F.col("b.m")).alias("overlap_ratio"), kind.alias("match_type"),
    )


def nearest_interval(points: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Block of each point: the one around it, otherwise the nearest of its chromosome, marked by ``*``.

    Distance is max(start - pos, pos - end); ties go to the first block by start. Points of a chromosome without blocks
    have a null block. Adds block_id, block_label, distance, forced. Nearest blocks are found by a sweep (last block end
    below and next block start above the point) over points and bounds of ranges of a chromosome, not by pairing all.
    """
    inside = range_join(points, blocks.select("chr", "start_bp", "end_bp", "block_id"))
    inside = inside.groupBy(key).agg(F.min(F.struct("start_bp", "block_id")).alias("b")).select(key, F.col("b.block_id").alias("_in"))
    left = points.join(inside, key, "left")
    free = left.where("_in is null").drop("_in")
    b = blocks.select("chr", "start_bp", "end_bp", "block_id")
    marks = b.select("chr", F.col("end_bp").alias("pos"), F.lit(0).alias("o"), F.struct("end_bp", (-F.col("start_bp")).alias("t"), "start_bp", "block_id").alias("below"), F.lit(None).alias("above"), F.lit(None).cast("string").alias(key))
    marks = marks.withColumn("above", F.lit(None).cast("struct<start_bp:int,block_id:string>"))
    ups = b.select("chr", F.col("start_bp").alias("pos"), F.lit(2).alias("o"), F.lit(None).cast(marks.schema["below"].dataType).alias("below"), F.struct("start_bp", "block_id").alias("above"), F.lit(None).cast("string").alias(key))
    own = free.select("chr", "pos", F.lit(1).alias("o"), F.lit(None).cast(marks.schema["below"].dataType).alias("below"), F.lit(None).cast(marks.schema["above"].dataType).alias("above"), F.col(key).cast("string").alias(key))
    # a chromosome is cut into tiles; the last end below and the first start above a tile come from a small table of tiles
    tile = F.expr("shiftright(cast(pos as long) + 2147483648L, 20)").alias("tile")
    cols = ["chr", "pos", "o", "below", "above", key]
    allr = marks.select(*cols).unionByName(ups.select(*cols)).unionByName(own.select(*cols)).select("*", tile)
    edge = allr.groupBy("chr", "tile").agg(F.max("below").alias("mb"), F.min("above").alias("ma"))
    wt = W.partitionBy("chr").orderBy("tile")
    edge = edge.select("chr", "tile", F.max("mb").over(wt.rowsBetween(W.unboundedPreceding, -1)).alias("pb"), F.min("ma").over(wt.rowsBetween(1, W.unboundedFollowing)).alias("na"))
    w = W.partitionBy("chr", "tile").orderBy("pos", "o")
    swept = allr.select("chr", "pos", "o", key, "tile", F.max("below").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("lb"), F.min("above").over(w.rowsBetween(0, W.unboundedFollowing)).alias("la")).where("o = 1")
    swept = swept.join(edge, ["chr", "tile"]).select(key, "pos", F.coalesce("lb", "pb").alias("lo"), F.coalesce("la", "na").alias("hi"))
    cand = F.array(
        F.when(F.col("lo").isNotNull(), F.struct((F.col("pos") - F.col("lo.end_bp")).alias("dist"), F.col("lo.start_bp").alias("start_bp"), F.col("lo.block_id").alias("block_id"))),
        F.when(F.col("hi").isNotNull(), F.struct((F.col("hi.start_bp") - F.col("pos")).alias("dist"), F.col("hi.start_bp").alias("start_bp"), F.col("hi.block_id").alias("block_id"))),
    )
    near = swept.withColumn("n", F.array_min(F.filter(cand, lambda x: x.isNotNull()))).select(F.col(key).alias("_k"), "n")
    d = left.join(near, left[key].cast("string") == near["_k"], "left").drop("_k")
    forced = F.col("_in").isNull() & F.col("n").isNotNull()
    block = F.coalesce("_in", "n.block_id")
    return d.select(*points.columns, block.alias("block_id"), F.when(forced, F.concat(block, F.lit("*"))).otherwise(block).alias("block_label"), F.when(F.col("_in").isNotNull(), 0).otherwise(F.col("n.dist")).cast("int").alias("distance"), forced.alias("forced"))


def band_pairs(snps: DataFrame, max_bp: int) -> DataFrame:
    """Pairs of positions of one chromosome with 0 < pos_j - pos_i <= max_bp: an equi join of each bin with itself and the next."""
    a = snps.select("chr", F.col("snp").alias("snp_i"), F.col("pos").alias("pos_i"), F.floor(F.col("pos") / max_bp).alias("_b"))
    b = snps.select(F.col("chr").alias("_c"), F.col("snp").alias("snp_j"), F.col("pos").alias("pos_j"), F.floor(F.col("pos") / max_bp).alias("_d"))
    b = b.withColumn("_b2", F.explode(F.array(F.col("_d"), F.col("_d") - 1)))
    on = (F.col("chr") == F.col("_c")) & (F.col("_b") == F.col("_b2")) & (F.col("pos_j") > F.col("pos_i")) & (F.col("pos_j") - F.col("pos_i") <= max_bp)
    return a.join(b, on).select("chr", "snp_i", "pos_i", "snp_j", "pos_j", (F.col("pos_j") - F.col("pos_i")).alias("dist_bp"))


def bh_adjust(df: DataFrame, p: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg step-up values within ``by`` (all rows without it). Null p-values stay null and don't count.

    Ranks come from counts per distinct p-value and group, which is far fewer rows than tests; ties share the largest rank.
    """
    by = by or []
    keys = [f"_by{i}" for i in range(len(by))]
    g = df.where(F.col(p).isNotNull()).groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    # p-values are cut into ranges of equal ratio, so that no task ranks all of a group; ranges pass on a sum and a minimum
    g = g.withColumn("_t", F.when(F.col("_p") > 0, F.floor(F.log2("_p") * 64)).otherwise(-(1 << 30)).cast("long"))
    sums = g.groupBy(*keys, "_t").agg(F.sum("_c").alias("_s"))
    wt = W.partitionBy(*keys).orderBy("_t")
    sums = sums.withColumn("_off", F.coalesce(F.sum("_s").over(wt.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_s").over(W.partitionBy(*keys))).drop("_s")
    g = _null_safe_join(g, sums, [*keys, "_t"])
    own = W.partitionBy(*keys, "_t").orderBy("_p")
    g = g.withColumn("_v", F.col("_p") * F.col("_n") / (F.col("_off") + F.sum("_c").over(own.rowsBetween(W.unboundedPreceding, 0))))
    mins = g.groupBy(*keys, "_t").agg(F.min("_v").alias("_m"))
    mins = mins.withColumn("_after", F.min("_m").over(wt.rowsBetween(1, W.unboundedFollowing))).drop("_m")
    g = _null_safe_join(g, mins, [*keys, "_t"])
    g = g.withColumn("_q", F.least(F.lit(1.0), F.min("_v").over(own.rowsBetween(0, W.unboundedFollowing)), F.col("_after")))
    g = g.select(*keys, F.col("_p").alias("_pp"), F.col("_q").alias(out))
    on = F.col(p) == F.col("_pp")
    for c, k in zip(by, keys):
        on = on & F.col(c).eqNullSafe(F.col(k))
    return df.join(g, on, "left").drop("_pp", *keys)


def _null_safe_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    b = b.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[c for c in b.columns if c not in keys])
    return a.join(b, F.expr(" and ".join(f"{k} <=> _r{k}" for k in keys))).drop(*[f"_r{k}" for k in keys])


def running_sum(df: DataFrame, by: str, pos: str, order: list[str], value: Column, out: str, bits: int = 20) -> DataFrame:
    """``out``: sum of ``value`` over the rows of the group up to and with this one, in the given order (``pos`` first).

    Groups are cut into tiles of ``2^bits`` positions: only the tiles' sums are cumulated per group, rows only within their
    tile, so no task gets a whole chromosome."""
    d = df.withColumn("_tile", F.expr(f"shiftright(cast({pos} as long) + {OFFSET}L, {bits})")).withColumn("_val", value)
    sums = d.groupBy(by, "_tile").agg(F.sum("_val").alias("_s"))
    sums = sums.withColumn("_off", F.coalesce(F.sum("_s").over(W.partitionBy(by).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    d = _null_safe_join(d, sums, [by, "_tile"])
    w = W.partitionBy(by, "_tile").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn(out, (F.col("_off") + F.coalesce(F.sum("_val").over(w), F.lit(0))).cast("int")).drop("_tile", "_val", "_off")


def ranked(snps: DataFrame, out: str = "rank") -> DataFrame:
    """chr, pos, snp of distinct variants with their place (from 1) on the chromosome, by position, then id."""
    return running_sum(snps.select("chr", "pos", "snp").distinct(), "chr", "pos", ["pos", "snp"], F.lit(1), out)


def islands(df: DataFrame, by: list[str], pos: str, max_gap: int, out: str = "island") -> DataFrame:
    """Numbers runs of rows whose neighbours are at most ``max_gap`` apart, from 1 in each group."""
    w = W.partitionBy(*by).orderBy(pos)
    fresh = F.when(F.col(pos) - F.lag(pos).over(w) <= max_gap, 0).otherwise(1)
    return df.withColumn("_f", fresh).withColumn(out, F.sum("_f").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_f")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group; a window group limit keeps it from sorting whole groups across the shuffle."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
