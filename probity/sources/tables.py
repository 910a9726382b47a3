"""Parquet tables of a data folder."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def numbered(df: DataFrame, name: str, first: int = 1) -> DataFrame:
    """``df`` with its rows numbered without gaps, in the order of its partitions: for a file the numbers of its records.

    Rows are counted by partition first; the driver gets one number for each partition. ``df`` must give the same partitions each
    time, as a file that is read does.
    """
    counts = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    starts = list(accumulate((counts.get(p, 0) for p in range(max(counts, default=-1) + 1)), initial=first))
    at = F.monotonically_increasing_id()  # the partition in the high bits, the place in it in the low 33
    start = F.element_at(F.array(*(F.lit(s).cast("long") for s in starts)), (F.shiftright(at, 33) + 1).cast("int"))
    return df.withColumn(name, start + at.bitwiseAND(F.lit((1 << 33) - 1)))
