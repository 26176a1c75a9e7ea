"""Column expressions for the keys every table shares, and small session helpers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plain_chr(col: Column | str) -> Column:
    """Chromosome label without outer blanks and without a leading ``chr`` in any case; NULL stays NULL."""
    col = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.trim(col), "(?i)^chr", ""))


def loose_key(col: Column | str, drop_chr: bool = False) -> Column:
    """Reference compared without outer blanks and regardless of case; optionally without ``chr`` in front."""
    col = F.col(col) if isinstance(col, str) else col
    key = F.lower(F.trim(col))
    return F.regexp_replace(key, "^chr", "") if drop_chr else key


def variant_id(snp: Column | str, chrom: Column, pos: Column) -> Column:
    """Identifier of a variant: its own id, or ``<plain chr>_<pos>`` where that is null, empty or ``.``."""
    snp = F.col(snp) if isinstance(snp, str) else snp
    own = F.when(F.trim(snp).isin("", "."), F.lit(None)).otherwise(snp)
    return F.coalesce(own, F.concat_ws("_", chrom, pos.cast("string")))


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise ValueError naming the columns that ``df`` lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}; present: {', '.join(df.columns)}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``. Where none is set a session with its executors in one
    process (tests) gets a local one; on a cluster that is an error, for each executor would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return "file:///tmp/allelica-shared"
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation of everything before, and lets a table be read
    more than once without computing it twice.
    """
    path = f"{shared_dir(df.sparkSession)}/allelica/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def drop_materialized(spark: SparkSession) -> int:
    """Delete the tables this session has written with ``materialize``; results still to be read from them are lost."""
    n = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
