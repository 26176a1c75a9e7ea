"""References to records that do not exist, by a broadcast Bloom filter and an exact check of what passes it.

The filter is register-blocked: a key sets ``BITS`` bits of one 64-bit word. Words are packed into rows of ``PACK``, so that
the filter is a table (row, words) that one hash join probes inside generated code and that takes little more memory than
its bits. Its size is bounded by ``max_bytes`` (16 bits a key up to 32 million keys); beyond that it lets more references
through to the exact join. A reference that misses a bit is an orphan for certain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelica.operators.skew import salted_sides

BITS, PACK = 4, 128


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def bloom_words(parents: DataFrame, key: str, max_bytes: int = 1 << 26) -> tuple[DataFrame, int]:
    """(row, words) table of the parents' keys and its number of words: a power of two of about 16 bits a key, of at most
    ``max_bytes`` together."""
    n = parents.select(F.approx_count_distinct(key)).first()[0] or 0
    words = min(max(PACK, max_bytes // 8), PACK << max(0, math.ceil(math.log2(max(1, n) / 4 / PACK))))
    bits = parents.where(F.col(key).isNotNull()).select(_word(F.col(key), words).alias("_word"), _mask(F.col(key)).alias("_m"))
    bits = bits.groupBy("_word").agg(F.bit_or("_m").alias("_bits"))
    rows = bits.groupBy(F.shiftright("_word", int(math.log2(PACK))).alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_word").bitwiseAND(F.lit(PACK - 1)).cast("int"), "_bits"))).alias("_b"))
    return rows.select("_row", F.transform(F.sequence(F.lit(0), F.lit(PACK - 1)), lambda i: F.coalesce(F.try_element_at("_b", i), F.lit(0).cast("long"))).alias("_words")), words


def orphan_references(children: DataFrame, parents: DataFrame, key: str, at: str, rec: str, valid_from: str, valid_to: str) -> DataFrame:
    """Children whose non-null ``key`` no parent row holds at time ``at``.

    A parent holds from ``valid_from`` up to, not including, ``valid_to`` (null: still holding). A child with a null key
    is no reference; one with a null ``at`` holds for no parent and is an orphan; a parent with a null key or
    ``valid_from`` proves nothing. Each child row comes out at most once; repeated rows are separate cases, told apart by
    ``rec``. Empty parents make every reference an orphan. Returns the children's columns.
    """
    kids = children.where(F.col(key).isNotNull()).withColumnRenamed(key, "_key")
    folk = parents.where(F.col(key).isNotNull() & F.col(valid_from).isNotNull()).select(F.col(key).alias("_key"), F.col(valid_from).alias("_from"), F.col(valid_to).alias("_to")).distinct()
    table, words = bloom_words(folk, "_key")
    probed = kids.withColumn("_word", _word(F.col("_key"), words)).withColumn("_row", F.shiftright("_word", int(math.log2(PACK)))).join(F.broadcast(table), "_row", "left")
    bits = F.get("_words", F.col("_word").bitwiseAND(F.lit(PACK - 1)).cast("int"))
    hit = F.coalesce(bits.bitwiseAND(_mask(F.col("_key"))) == _mask(F.col("_key")), F.lit(False))
    probed = probed.withColumn("_hit", hit).drop("_word", "_row", "_words")
    surely = probed.where(~F.col("_hit")).drop("_hit")
    left, right = salted_sides(probed.where("_hit").drop("_hit"), folk, "_key", rec)
    held = (left["_key"] == right["_key"]) & (left["_salt"] == right["_salt"]) & (right["_from"] <= left[at]) & (right["_to"].isNull() | (right["_to"] > left[at]))
    verified = left.join(right, held, "left_anti").drop("_salt")
    return surely.unionByName(verified).withColumnRenamed("_key", key).select(*children.columns)
