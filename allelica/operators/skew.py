"""Results per key where a few keys hold most rows.

``per_key_profile`` compresses by value frequency: it groups by (key, value) first, so that a hot key is spread over its
values and repeated values travel once with their weight, and derives exact counts, distinct counts, modes and
percentiles from the weighted values. ``salted_sides`` prepares both sides of a join whose left side may be skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from allelica.functions.keys import require_columns

#: A key is hot if it holds more than one row in so many; there are at most as many hot keys.
HOT_ONE_IN = 50
SALTS = 16
#: A key whose values are cut into ranges for percentiles has more than one weighted value in so many; into so many ranges.
WIDE_ONE_IN, RANGES = 1000, 200


def hot_keys(df: DataFrame, key: str, one_in: int = HOT_ONE_IN) -> DataFrame:
    """The keys (column ``_hot``) that hold more than one row in ``one_in``: fewer than ``one_in`` of them, by arithmetic."""
    n = df.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return n.join(F.broadcast(total), F.col("_n") * one_in > F.col("_total")).select("_hot")


def salted_sides(left: DataFrame, right: DataFrame, key: str, spread: str, right_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: rows of hot left keys are spread over ``SALTS``, only their partners are repeated."""
    hot = F.broadcast(hot_keys(left, key))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    a = left.join(hot, left[key] == hot["_hot"], "left").withColumn("_salt", salt).drop("_hot")
    b = right.join(hot, right[right_key or key] == hot["_hot"], "left")
    b = b.withColumn("_salt", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return a, b


def per_key_profile(df: DataFrame, key: str, value: str, percentiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per key: n_rows, n_values (non-null), n_distinct, mode_value, mode_count and exact percentiles ``p<100q>``.

    A percentile is the smallest value whose cumulated weight reaches ``q`` of the key's non-null values. Ties for the
    mode go to the smallest value. Null keys form a key of their own; a key without values has null statistics. An
    empty table gives no rows. Other columns are not read.

    No task gets all of a hot key: counts and the mode are aggregated from the weighted values before any shuffle by key.
    For percentiles, keys with more than one weighted value in ``WIDE_ONE_IN`` (fewer keys than that, so their borders are
    broadcast) are cut into ranges by a mergeable quantile sketch; weights are summed within ranges, cumulated over those at
    most ``RANGES`` sums, and only the ranges that hold a wanted rank are opened. All other keys are ranked as they are.
    """
    require_columns(df, key, value)
    pairs = df.groupBy(F.col(key).alias("_key"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
    seen = F.col("_v").isNotNull()
    out = pairs.groupBy("_key").agg(
        F.sum("_w").alias("n_rows"), F.coalesce(F.sum(F.when(seen, F.col("_w"))), F.lit(0)).alias("n_values"), F.count("_v").alias("n_distinct"),
        F.min(F.when(seen, F.struct((-F.col("_w")).alias("m"), F.col("_v").alias("v")))).alias("_mode"),
    )
    out = out.select("_key", "n_rows", "n_values", "n_distinct", F.col("_mode.v").alias("mode_value"), (-F.col("_mode.m")).alias("mode_count"))
    names = [f"p{round(100 * q)}" for q in percentiles]
    if percentiles:
        out = out.alias("a").join(_percentiles(pairs.where(seen), percentiles, names).alias("p"), F.expr("a._key <=> p._key"), "left")
    return out.select(F.col("a._key" if percentiles else "_key").alias(key), "n_rows", "n_values", "n_distinct", "mode_value", "mode_count", *names)


def _percentiles(have: DataFrame, percentiles: tuple[float, ...], names: list[str]) -> DataFrame:
    """_key and one column per percentile of the weighted values (_key, _v, _w)."""
    n = have.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    total = have.agg(F.count(F.lit(1)).alias("_total"))
    wide = n.join(F.broadcast(total), F.col("_n") * WIDE_ONE_IN > F.col("_total")).select(F.col("_key").alias("_wide"), F.lit(True).alias("_is"))
    marked = have.join(F.broadcast(wide), F.expr("_key <=> _wide"), "left").drop("_wide")
    cuts = marked.where("_is").groupBy(F.col("_key").alias("_ckey")).agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], F.lit(10 * RANGES)).alias("_cuts"))
    cut = have.join(F.broadcast(cuts), F.expr("_key <=> _ckey")).select("_key", "_v", "_w", F.expr("size(filter(_cuts, c -> c < _v))").alias("_range"))
    sums = cut.groupBy("_key", "_range").agg(F.sum("_w").alias("_s"))
    before = F.sum("_s").over(W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_n", F.sum("_s").over(W.partitionBy("_key")))
    ranks = [F.greatest(F.ceil(F.col("_n") * F.lit(q)), F.lit(1)) for q in percentiles]
    wanted = sums.where(F.greatest(*[(r > F.col("_before")) & (r <= F.col("_before") + F.col("_s")) for r in ranks])).drop("_s")
    # at most one range a percentile and key
    opened = cut.alias("c").join(F.broadcast(wanted).alias("s"), F.expr("c._key <=> s._key and c._range = s._range")).select("c._key", "c._range", "c._v", "c._w", "_before", "_n")
    opened = opened.withColumn("_cum", F.col("_before") + F.sum("_w").over(W.partitionBy("_key", "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    narrow = marked.where("_is is null").drop("_is")
    w = W.partitionBy("_key").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    narrow = narrow.withColumn("_cum", F.sum("_w").over(w)).withColumn("_n", F.sum("_w").over(W.partitionBy("_key")))
    cols = ["_key", "_v", "_w", "_cum", "_n"]
    both = opened.select(*cols).unionByName(narrow.select(*cols))
    # the value whose weights reach over the wanted rank
    return both.groupBy("_key").agg(*[F.min(F.when((F.col("_cum") >= r) & (F.col("_cum") - F.col("_w") < r), F.col("_v"))).alias(c) for r, c in zip(ranks, names)])
