"""Diagnostics over documents and input lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size_bin(n: Column) -> Column:
    """10, 20, ... 100; sizes up to 10 count as 10 and all above 90 as 100."""
    return F.least(F.lit(100), F.greatest(F.lit(10), F.ceil(n / 10) * 10)).cast("int")


def document_sizes(records: DataFrame) -> DataFrame:
    """How many documents have how many records, by bins."""
    sizes = records.groupBy("docid").agg(F.count("*").alias("n"))
    return sizes.groupBy(size_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("documents"))


def parse_success(parsed: DataFrame, field: str = "docid") -> DataFrame:
    """Parsed and failed lines, from a reader that keeps failures as null rows."""
    return parsed.agg(F.count_if(F.col(field).isNotNull()).alias("parsed"), F.count_if(F.col(field).isNull()).alias("failed"))
