"""Documents in identifier order over range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_id_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` range-partitioned and sorted by identifier (nulls first); rows that repeat an
    identifier follow the hash of their text, so many of them need not share a partition. Partition numbers
    follow the order. Other columns are dropped before the shuffle."""
    light = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    return light.repartitionByRange(*keys).sortWithinPartitions(*keys)
