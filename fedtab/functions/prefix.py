"""Exact running totals and quantiles over a value order, without sorting a group in one task.

Values are first collapsed to distinct ones (map-side combined). Each value then falls into a
coarse and a fine bucket which are pure, monotone functions of the value: the bits of its
logarithm. Totals per bucket are tiny and give every fine bucket its offset, so the only window
over values runs inside a fine bucket (relative width about 1e-6).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import null_safe_join, pin_small

_PER_OCTAVE = 8
_FINE = 65536
_SHIFT = 20000


def bucket_columns(value: Column) -> tuple[Column, Column]:
    """(coarse, fine) bucket; ordering by both agrees with ordering by value, NaN last."""
    m = F.log2(F.abs(value)) * F.lit(float(_PER_OCTAVE))
    m = F.greatest(F.least(m, F.lit(9000.0)), F.lit(-9000.0))
    whole = F.floor(m)
    part = F.floor((m - whole) * F.lit(float(_FINE)))
    sign = F.when(value < 0, F.lit(-1)).otherwise(F.lit(1))
    plain = (value != 0) & ~F.isnan(value)
    coarse = (F.when(F.isnan(value), F.lit(2 * _SHIFT))
              .when(plain, sign * (whole + F.lit(_SHIFT))).otherwise(F.lit(0)))
    fine = F.when(plain, sign * part).otherwise(F.lit(0))
    return coarse.cast("int"), fine.cast("int")


def histogram_bucket(value: Column, per_coarse: int = 16) -> Column:
    """Order-preserving bucket of a value: ``per_coarse`` equal parts of each coarse bucket."""
    coarse, fine = bucket_columns(value)
    step = _FINE // per_coarse
    return coarse.cast("bigint") * 2 * _FINE + F.floor(fine / step) * step


def running_totals(df: DataFrame, groups: Sequence[str], value: str,
                   measures: Sequence[str]) -> DataFrame:
    """One row per (groups, distinct value) with each measure and its inclusive running total
    ``cum_<measure>`` in value order."""
    groups = list(groups)
    coarse, fine = bucket_columns(F.col(value))
    rows = (df.groupBy(*groups, value).agg(*[F.sum(m).alias(m) for m in measures])
            .withColumns({"__coarse": coarse, "__fine": fine}))

    def before(m, part, order):
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(m).over(w), F.lit(0))

    fine_sums = rows.groupBy(*groups, "__coarse", "__fine").agg(
        *[F.sum(m).alias(m) for m in measures])
    coarse_sums = fine_sums.groupBy(*groups, "__coarse").agg(*[F.sum(m).alias(m) for m in measures])
    coarse_off = coarse_sums.select(
        *groups, "__coarse", *[before(m, groups, "__coarse").alias(f"__c_{m}") for m in measures])
    fine_off = fine_sums.select(
        *groups, "__coarse", "__fine",
        *[before(m, [*groups, "__coarse"], "__fine").alias(f"__f_{m}") for m in measures])
    offsets = null_safe_join(fine_off, coarse_off, [*groups, "__coarse"])
    w = (Window.partitionBy(*groups, "__coarse", "__fine").orderBy(value)
         .rowsBetween(Window.unboundedPreceding, 0))
    joined = null_safe_join(rows, offsets, [*groups, "__coarse", "__fine"])
    return joined.select(
        *groups, value, *measures,
        *[(F.sum(m).over(w) + F.col(f"__f_{m}") + F.col(f"__c_{m}")).alias(f"cum_{m}")
          for m in measures])


def quantiles(df: DataFrame, groups: Sequence[str], value: str,
              probs: Sequence[float], out: Sequence[str] | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one row per group.

    A histogram over log buckets, combined map-side, locates the few buckets that hold a wanted
    rank; only the values in those are put in order, the other rows never shuffle. With ``out`` the quantiles become columns, else one array column ``grid``. NULLs are ignored.
    """
    groups = list(groups)
    base = df.filter(F.col(value).isNotNull()).select(*groups, value)
    base = base.withColumn("__b", histogram_bucket(F.col(value)))

    everything = Window.partitionBy(*groups)
    upto = everything.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    hist = (base.groupBy(*groups, "__b").agg(F.count("*").alias("n"))
            .withColumns({"__before": F.coalesce(F.sum("n").over(upto), F.lit(0)),
                          "__total": F.sum("n").over(everything)}))
    # (index, wanted rank, end): every quantile lies between the values at two ranks
    points = F.expr("array(" + ", ".join(
        f"named_struct('i', {i}, 'p', CAST({float(p)!r} AS DOUBLE))" for i, p in enumerate(probs)) + ")")

    def ranks(p, total):
        x = (total - 1) * p
        return F.floor(x), F.ceil(x), x - F.floor(x)

    def holds(p):
        low, high, _ = ranks(p["p"], F.col("__total"))
        a, z = F.col("__before"), F.col("__before") + F.col("n")
        return ((low >= a) & (low < z)) | ((high >= a) & (high < z))
    wanted = pin_small(hist.withColumn("__points", F.filter(points, holds)).filter(F.size("__points") > 0)
                       .select(*groups, "__b", "__before", "__total", "__points"))
    chosen = null_safe_join(base, wanted.select(*groups, "__b"), [*groups, "__b"], "left_semi")
    cum = running_totals(chosen.withColumn("n", F.lit(1).cast("bigint")), [*groups, "__b"], value, ["n"])
    cum = null_safe_join(cum, wanted, [*groups, "__b"]).withColumn("__before", F.col("__before") + F.col("cum_n") - F.col("n"))
    hits = cum.withColumn("__points", F.filter("__points", holds)).select(
        *groups, value, "n", "__before", "__total", F.inline("__points"))
    low, high, part = ranks(F.col("p"), F.col("__total"))

    def at(rank):
        return F.max(F.when((rank >= F.col("__before")) & (rank < F.col("__before") + F.col("n")), F.col(value)))
    each = hits.groupBy(*groups, "i").agg(at(low).alias("__a"), at(high).alias("__z"), F.max(part).alias("__w")).select(
        *groups, "i", (F.col("__a") + (F.col("__z") - F.col("__a")) * F.col("__w")).alias("__q"))
    if out is None:
        grid = F.transform(F.array_sort(F.collect_list(F.struct("i", "__q"))), lambda x: x["__q"])
        return each.groupBy(*groups).agg(grid.alias("grid"))
    return each.groupBy(*groups).agg(*[F.max(F.when(F.col("i") == i, F.col("__q"))).alias(o) for i, o in enumerate(out)])
