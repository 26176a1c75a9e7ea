"""Running call counts over genotype calls that keep arriving, for quality control of plates while they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.operators.imputation import call_dosage


def plate_rates(calls: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """plate, window, n_calls, n_missing over a stream or a table of calls (called_at, plate, gt); rows later than ``late``
    behind the newest are dropped from a stream, as the watermark says."""
    d = calls.withWatermark("called_at", late) if calls.isStreaming else calls
    g = d.groupBy(F.window("called_at", window), "plate").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(call_dosage(F.col("gt")).isNull()).alias("n_missing"))
    return g.select("plate", F.col("window.start").alias("since"), "n_calls", "n_missing")
