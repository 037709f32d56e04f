"""The transaction view and derived tables used by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spec import TableSpec

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
SPEC = TableSpec(features=FEATURES, key=KEY, ties=("l_extendedprice", "l_shipdate"))
CLIENTS = ("A", "B", "C", "D")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a transaction table: four features, a rare label, four clients."""
    slot = F.pmod(F.col("l_suppkey"), F.lit(4))
    client = F.when(slot == 0, "A").when(slot == 1, "B").when(slot == 2, "C").otherwise("D")
    label = ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        *KEY, "l_shipdate", client.alias("client"), *FEATURES, label.alias("label"))


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn(spark, sf_dir).filter("label = 1")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rows derived from the positives, one batch per verdict of the gate."""
    p = positives(spark, sf_dir).withColumn("label", F.lit(1))
    passing = p.filter("client = 'A'").withColumns({
        "mode": F.lit("augment_ctgan"), "l_extendedprice": F.round(F.col("l_extendedprice") * 1.03, 4),
        "l_discount": F.round(F.col("l_discount") + 0.004, 4)})
    collapsed = p.filter("client = 'A'").withColumns({
        "mode": F.lit("schema_llm"),
        "l_extendedprice": F.ceil(F.col("l_extendedprice") / 20000.0) * 20000.0,
        "l_discount": F.round(F.col("l_discount") + 0.004, 4)})
    broken = p.filter("client = 'B'").withColumns({
        "mode": F.lit("augment_ctgan"),
        "l_quantity": F.when(F.col("l_tax") == 0.0, F.lit(None)).otherwise(F.col("l_quantity")),
        "l_extendedprice": F.when(F.col("l_tax") == 0.01, F.lit(float("inf")))
        .when(F.col("l_tax") == 0.03, F.lit(float("nan")))
        .when(F.col("l_tax") >= 0.04, F.col("l_extendedprice") * -100.0)
        .otherwise(F.col("l_extendedprice")),
        "label": F.when(F.col("l_tax") == 0.02, 0).otherwise(1)})
    flat = p.filter("client = 'C'").withColumns({
        "mode": F.lit("schema_llm"), "l_quantity": F.lit(100.0), "l_discount": F.lit(0.3),
        "l_tax": F.lit(0.25), "l_extendedprice": F.round(F.col("l_extendedprice") * 3 + 105000, 4)})
    copies = p.filter("client = 'D'").withColumn("mode", F.lit("schema_llm"))
    cols = [*KEY, "client", "mode", *FEATURES, "label"]
    out = passing.select(*cols)
    for part in (collapsed, broken, flat, copies):
        out = out.unionByName(part.select(*cols))
    return out
