"""Per-client profiling: summaries, quantiles, correlations, bounds, weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.comoments import co_moments, pair_correlations
from ..functions.common import null_safe_join, r, safe_div, unpivot
from ..functions.prefix import quantiles
from ..spec import TableSpec


def shard_summary(df: DataFrame, spec: TableSpec, amount: str, group: str | None = None) -> DataFrame:
    """Rows, positives, negatives, positive rate and amount moments per client."""
    group = group or spec.client
    n, pos = F.count("*"), F.coalesce(F.sum(spec.label), F.lit(0)).cast("bigint")
    return df.groupBy(F.col(group).alias("client")).agg(
        n.alias("n_rows"), pos.alias("n_fraud"), (n - pos).alias("n_legit"),
        F.coalesce(r(safe_div(100 * pos, n), 4), F.lit(0.0)).alias("fraud_rate_pct"),
        r(F.avg(amount), 2).alias("amount_mean"), r(F.stddev_samp(amount), 2).alias("amount_std"))


def column_profile(df: DataFrame, spec: TableSpec, groups: Sequence[str] = ("client",),
                   digits: int = 4) -> DataFrame:
    """mean, sample std (0 for one row), min, quartiles and max per group and column."""
    long = unpivot(df, groups, spec.features)
    keys = [*groups, "column"]
    moments = long.groupBy(*keys).agg(
        r(F.avg("value"), digits).alias("mean"),
        F.when(F.count("value") > 1, r(F.stddev_samp("value"), digits)).otherwise(0.0).alias("std"),
        r(F.min("value"), digits).alias("min"), r(F.max("value"), digits).alias("max"))
    q = quantiles(long, keys, "value", (0.25, 0.5, 0.75), ("q25", "q50", "q75"))
    q = q.select(*keys, *[r(c, digits).alias(c) for c in ("q25", "q50", "q75")])
    return (null_safe_join(moments, q, keys)
            .select(*keys, "mean", "std", "min", "q25", "q50", "q75", "max"))


def correlations(df: DataFrame, spec: TableSpec, groups: Sequence[str] = ("client",)) -> DataFrame:
    """Pearson r of every column pair per group, long form; NULL where a column is constant.

    The co-moments of a group are one matrix per task, merged in a tree, however many columns there are.
    """
    return pair_correlations(co_moments(df, spec.features, groups), spec.features, groups)


def top_correlations(df: DataFrame, spec: TableSpec, k: int = 5,
                     groups: Sequence[str] = ("client",)) -> DataFrame:
    """The k strongest pairs per group; r is rounded to 4 digits before ranking, ties in column order."""
    c = correlations(df, spec, groups).filter(F.col("r").isNotNull()).withColumn("r", r("r", 4))
    w = Window.partitionBy(*groups).orderBy(F.desc(F.abs("r")), "pair")
    return (c.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
            .select(*groups, "rank", "col_a", "col_b", "r"))


PROTOTYPES = {"typical": "q50", "low_tail": "q25", "high_tail": "q75"}


def prototype_rows(profile: DataFrame, spec: TableSpec, groups: Sequence[str] = ("client",)) -> DataFrame:
    """Three example rows per group made of quartiles, never of real rows."""
    kinds = F.explode(F.map_from_arrays(
        F.array(*[F.lit(k) for k in PROTOTYPES]), F.array(*[F.col(q) for q in PROTOTYPES.values()])))
    long = profile.select(*groups, "column", kinds.alias("prototype", "v"))
    return (long.groupBy(*groups, "prototype").pivot("column", list(spec.features))
            .agg(F.max("v")))


def range_bounds(df: DataFrame, spec: TableSpec, slack: float = 3.0) -> DataFrame:
    """Allowed range per client and column: the real range widened by ``slack`` spans."""
    stats = df.groupBy(spec.client).agg(
        *[F.min(c).alias(f"lo_{c}") for c in spec.features],
        *[F.max(c).alias(f"hi_{c}") for c in spec.features])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").cast("double").alias("lo"),
                               F.col(f"hi_{c}").cast("double").alias("hi")) for c in spec.features])
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return (stats.select(F.col(spec.client).alias("client"), F.inline(cells))
            .select("client", "column", (F.col("lo") - slack * span).alias("lower"),
                    (F.col("hi") + slack * span).alias("upper")))


def class_weight(df: DataFrame, spec: TableSpec, pooled: bool = False) -> DataFrame:
    """pos_weight = n_neg / max(1, n_pos) per client."""
    key = F.lit("*") if pooled else F.col(spec.client)
    pos = F.coalesce(F.sum(spec.label), F.lit(0)).cast("bigint")
    n_pos = F.greatest(pos, F.lit(1).cast("bigint"))
    return df.groupBy(key.alias("client")).agg(
        F.count("*").alias("n"), pos.alias("n_pos"),
        ((F.count("*") - n_pos) / n_pos).alias("pos_weight"))


def reconcile(raw: DataFrame, split: DataFrame, shards: DataFrame) -> DataFrame:
    """One row: rows in = train + holdout, and train = sum over the shards."""
    tags = (raw.select(F.lit("raw").alias("tag"))
            .unionByName(split.select(F.col("split").alias("tag")))
            .unionByName(shards.select(F.lit("shards").alias("tag"))))
    return tags.agg(*[F.count_if(F.col("tag") == t).alias(f"n_{t}")
                      for t in ("raw", "train", "holdout", "shards")]).withColumn(
        "balanced", (F.col("n_raw") == F.col("n_train") + F.col("n_holdout"))
        & (F.col("n_train") == F.col("n_shards")))
