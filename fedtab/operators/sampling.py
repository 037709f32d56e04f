"""Reproducible exact sampling: seeded ranks, stratified holdout, skewed client allocation.

Row order is the order of ``md5(seed | key)``. Splits never rank the table: a histogram over hash
prefixes locates the few prefixes that contain a cut, only the rows in those are ordered, and the
rows found there become thresholds that every row is compared with. The wide table is scanned and
never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import fetch_small, literal_table, null_safe_join, pin_small
from ..spec import PartitionPlan, TableSpec

PREFIX_ROWS = 1_000_000  # a hash prefix with more rows is narrowed before it is ordered


def hash_key(seed: int, key: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def seeded_rank(df: DataFrame, strata: Sequence[str], key: Sequence[str], seed: int,
                ties: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """1-based position of every row in its stratum's seeded permutation.

    Ranks are local to a hash prefix plus the prefix's offset, so one huge stratum is spread over
    all tasks. Two prefix levels keep each window small at any size.
    """
    strata = list(strata)
    df = df.withColumn("__h", hash_key(seed, key)).withColumns({
        "__p": F.substring("__h", 1, 3), "__q": F.substring("__h", 4, 2)})
    fine = df.groupBy(*strata, "__p", "__q").agg(F.count("*").alias("n"))
    coarse = fine.groupBy(*strata, "__p").agg(F.sum("n").alias("n"))

    def before(part, order):
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))
    coarse = coarse.select(*strata, "__p", before(strata, "__p").alias("__cp"))
    fine = fine.select(*strata, "__p", "__q", before([*strata, "__p"], "__q").alias("__cq"))
    offsets = null_safe_join(fine, coarse, [*strata, "__p"])
    w = Window.partitionBy(*strata, "__p", "__q").orderBy("__h", *key, *ties)
    return (null_safe_join(df, offsets, [*strata, "__p", "__q"])
            .withColumn(out, (F.row_number().over(w) + F.col("__cp") + F.col("__cq")).cast("bigint"))
            .drop("__h", "__p", "__q", "__cp", "__cq"))


def holdout_quotas(counts: DataFrame, strata: Sequence[str], test_size: float) -> DataFrame:
    """Rows of each stratum that go to the holdout: ceil(test_size * n) in total, shared out by
    largest remainder (ties: stratum order). ``counts`` has one row per stratum, column ``n``."""
    strata = list(strata)
    every = Window.partitionBy(F.lit(0))  # one row per stratum
    total = F.sum("n").over(every)
    n_test = F.ceil(total * F.lit(float(test_size)))
    exact = F.col("n") * n_test / total
    base = F.floor(exact)
    frac_rank = F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.desc("__frac"), *strata))
    return (counts
            .withColumns({"__base": base, "__frac": F.round(exact - base, 9), "__test": n_test})
            .withColumn("__left", F.col("__test") - F.sum("__base").over(every))
            .withColumn("quota", (F.col("__base")
                                  + F.when(frac_rank <= F.col("__left"), 1).otherwise(0)).cast("bigint"))
            .select(*strata, "n", "quota"))


def _before(by: str, part: Sequence[str]) -> Column:
    w = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(w), F.lit(0))


def assign_by_rank(df: DataFrame, strata: Sequence[str], key: Sequence[str], seed: int,
                   ranges_of: Callable[[DataFrame], DataFrame], out: str,
                   ties: Sequence[str] = ()) -> DataFrame:
    """Label every row by the range its seeded rank falls into.

    ``ranges_of(counts)`` turns counts(strata, n) into ranges(strata, ``out``, lo, hi): ranks
    lo < rank <= hi get the label. Equals ranking the table and range-joining, but reads the key
    columns twice instead of shuffling the rows: once for a histogram over 16^3 hash prefixes per
    stratum, once for the rows of the few prefixes that hold a cut. A prefix too large to order in
    one task is narrowed by a second histogram first.
    """
    strata, key, ties = list(strata), list(key), list(ties)
    order = ["__h", *key, *ties]
    hashed = df.withColumn("__h", hash_key(seed, key))
    slim = hashed.select(*strata, *order).withColumn("__p", F.substring("__h", 1, 3))
    hist = pin_small(slim.groupBy(*strata, "__p").agg(F.count("*").alias("n")))
    counts = pin_small(hist.groupBy(*strata).agg(F.sum("n").alias("n")))
    ranges = pin_small(ranges_of(counts).filter("hi > lo"))

    cut_at = ranges.select(*strata, F.col("hi").alias("cut")).distinct()
    inside = (F.col("cut") > F.col("__before")) & (F.col("cut") <= F.col("__before") + F.col("n"))
    # the cut's position inside its prefix is what later steps look for
    cuts = pin_small(
        null_safe_join(hist.withColumn("__before", _before("__p", strata)), cut_at, strata).filter(inside)
        .select(*strata, "__p", "cut", "n", (F.col("cut") - F.col("__before")).alias("__nth")))
    at_cut = null_safe_join(slim, cuts.select(*strata, "__p").distinct(), [*strata, "__p"], "left_semi")
    if (cuts.agg(F.max("n")).first()[0] or 0) > PREFIX_ROWS:
        at_cut = at_cut.withColumn("__q", F.substring("__h", 4, 3))
        sub = at_cut.groupBy(*strata, "__p", "__q").agg(F.count("*").alias("n"))
        sub = sub.withColumn("__before", _before("__q", [*strata, "__p"]))
        found = null_safe_join(sub, cuts.drop("n"), [*strata, "__p"]).filter(
            (F.col("__nth") > F.col("__before")) & (F.col("__nth") <= F.col("__before") + F.col("n")))
        cuts = pin_small(found.select(*strata, F.concat("__p", "__q").alias("__p"), "cut",
                                      (F.col("__nth") - F.col("__before")).alias("__nth")))
        at_cut = null_safe_join(at_cut.withColumn("__p", F.concat("__p", "__q")).drop("__q"),
                                cuts.select(*strata, "__p").distinct(), [*strata, "__p"], "left_semi")
    ranked = at_cut.withColumn(
        "__nth", F.row_number().over(Window.partitionBy(*strata, "__p").orderBy(*order)).cast("bigint"))
    bounds = pin_small(
        null_safe_join(ranked, cuts, [*strata, "__p", "__nth"])
        .select(*strata, "cut", F.struct(*order).alias("__bound")))

    upper = bounds.withColumnRenamed("cut", "hi").withColumnRenamed("__bound", "__hi")
    lower = bounds.withColumnRenamed("cut", "lo").withColumnRenamed("__bound", "__lo")
    keyed = null_safe_join(ranges, upper, [*strata, "hi"], "left")
    keyed = pin_small(null_safe_join(keyed, lower, [*strata, "lo"], "left").drop("lo", "hi"))
    me = F.struct(*order)
    right = keyed.select(*[F.col(s).alias(f"__r_{s}") for s in strata],
                         *[c for c in keyed.columns if c not in strata])
    cond = ((F.col("__lo").isNull() | (me > F.col("__lo")))
            & (F.col("__hi").isNull() | (me <= F.col("__hi"))))
    for s in strata:
        cond = cond & hashed[s].eqNullSafe(right[f"__r_{s}"])
    return (hashed.join(right, cond)
            .drop("__h", "__lo", "__hi", *[f"__r_{s}" for s in strata]))


def stratified_holdout(df: DataFrame, spec: TableSpec, test_size: float, seed: int,
                       strata: Sequence[str] | None = None, out: str = "split") -> DataFrame:
    """Exact-size stratified split: adds ``split`` in {train, holdout}."""
    strata = list(strata) if strata is not None else [spec.label]

    def ranges_of(counts):
        parts = F.array(
            F.struct(F.lit("holdout").alias(out), F.lit(0).cast("bigint").alias("lo"), F.col("quota").alias("hi")),
            F.struct(F.lit("train").alias(out), F.col("quota").alias("lo"), F.col("n").alias("hi")))
        return holdout_quotas(counts, strata, test_size).select(*strata, F.inline(parts))
    return assign_by_rank(df, strata, spec.key, seed, ranges_of, out, spec.ties)


def dirichlet_shares(plan: PartitionPlan) -> dict[str, float]:
    """One share per client, drawn with the plan's seed."""
    p = np.random.default_rng(plan.seed).dirichlet([plan.alpha] * len(plan.clients))
    return {c: float(x) for c, x in zip(plan.clients, p)}


def share_table(spark, shares: dict[str, float], plan: PartitionPlan) -> DataFrame:
    rows = [(i, c, float(shares[c]), c in plan.rich) for i, c in enumerate(plan.clients)]
    return literal_table(spark, rows, "pos int, client string, share double, rich boolean")


def weighted_counts(shares: DataFrame, total: int) -> DataFrame:
    """Half-even rounded share of ``total`` per client; the last client takes the drift."""
    all_ = Window.partitionBy(F.lit(0))
    cnt = F.bround(F.col("share") * F.lit(total)).cast("bigint")
    return (shares.withColumn("cnt", cnt)
            .withColumn("cnt", F.col("cnt") + F.when(
                F.col("pos") == F.max("pos").over(all_),
                F.lit(total) - F.sum("cnt").over(all_)).otherwise(0)))


def argmax_counts(shares: DataFrame, total: int) -> DataFrame:
    """Half-even rounded share per client; the client with the largest share takes the drift."""
    all_ = Window.partitionBy(F.lit(0))
    top = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("share"), "pos"))
    return (shares.withColumn("cnt", F.bround(F.col("share") * F.lit(total)).cast("bigint"))
            .withColumn("cnt", F.col("cnt") + F.when(
                top == 1, F.lit(total) - F.sum("cnt").over(all_)).otherwise(0)))


def capped_counts(counts: DataFrame, cap: int) -> DataFrame:
    """Cap the poor clients and hand their excess to the rich ones in proportion to their shares;
    what rounding leaves over goes to the first rich client."""
    all_ = Window.partitionBy(F.lit(0))
    poor_over = ~F.col("rich") & (F.col("cnt") > cap)
    rich_sum = F.sum(F.when(F.col("rich"), F.col("share")).otherwise(0.0)).over(all_)
    first_rich = F.min(F.when(F.col("rich"), F.col("pos"))).over(all_)
    d = (counts
         .withColumns({"__excess": F.sum(F.when(poor_over, F.col("cnt") - cap).otherwise(0)).over(all_),
                       "__total": F.sum("cnt").over(all_), "__first": first_rich,
                       "__p": F.when(F.col("rich"), F.try_divide(F.col("share"), rich_sum))})
         .withColumn("capped", F.when(poor_over, F.lit(cap).cast("bigint"))
                     .when(F.col("rich"), F.col("cnt") + F.bround(F.col("__p") * F.col("__excess")).cast("bigint"))
                     .otherwise(F.col("cnt")))
         .withColumn("capped", F.col("capped") + F.when(
             (F.col("pos") == F.col("__first")) & (F.col("__excess") > 0),
             F.col("__total") - F.sum("capped").over(all_)).otherwise(0)))
    return d.drop("cnt", "__excess", "__total", "__first", "__p").withColumnRenamed("capped", "cnt")


def count_ranges(counts: DataFrame) -> DataFrame:
    """Counts per client, in client order, as rank ranges (client, lo, hi)."""
    w = Window.partitionBy(F.lit(0)).orderBy("pos")
    hi = F.sum("cnt").over(w)
    return counts.select("client", (hi - F.col("cnt")).cast("bigint").alias("lo"),
                         hi.cast("bigint").alias("hi"))


def partition_ranges(counts: DataFrame, spec: TableSpec, plan: PartitionPlan,
                     positive_shares: dict[str, float] | None = None) -> DataFrame:
    """counts(label, n) to (label, client, lo, hi): quantity skew on the negatives, capped label skew
    on the positives."""
    spark = counts.sparkSession
    totals = {x[spec.label]: int(x["n"]) for x in fetch_small(counts, 100)}
    if set(totals) - {0, 1}:
        raise ValueError(f"labels other than 0 and 1: {sorted(set(totals) - {0, 1}, key=str)}")
    shares = positive_shares or dirichlet_shares(plan)
    neg = weighted_counts(share_table(spark, plan.weights, plan), totals.get(0, 0))
    pos = capped_counts(argmax_counts(share_table(spark, shares, plan), totals.get(1, 0)), plan.poor_cap)
    kind = counts.schema[spec.label].dataType
    both = (count_ranges(neg).withColumn(spec.label, F.lit(0).cast(kind))
            .unionByName(count_ranges(pos).withColumn(spec.label, F.lit(1).cast(kind))))
    return both.withColumnRenamed("client", spec.client)


def quantity_skew(df: DataFrame, spec: TableSpec, plan: PartitionPlan) -> DataFrame:
    """Spread all rows of ``df`` over the clients by the plan's weights; adds the client column."""
    def ranges_of(counts):
        n = fetch_small(counts, 1)
        shares = share_table(df.sparkSession, plan.weights, plan)
        return (count_ranges(weighted_counts(shares, n[0]["n"] if n else 0))
                .withColumnRenamed("client", spec.client).withColumn("__all", F.lit(0)))
    one = df.drop(spec.client).withColumn("__all", F.lit(0))
    return assign_by_rank(one, ["__all"], spec.key, plan.seed, ranges_of, spec.client, spec.ties).drop("__all")


def non_iid_partition(df: DataFrame, spec: TableSpec, plan: PartitionPlan,
                      positive_shares: dict[str, float] | None = None) -> DataFrame:
    """Deliberately skewed shards: every row of ``df`` gets exactly one client."""
    return assign_by_rank(df.drop(spec.client), [spec.label], spec.key, plan.seed,
                          lambda c: partition_ranges(c, spec, plan, positive_shares), spec.client, spec.ties)


def holdout_and_shards(df: DataFrame, spec: TableSpec, plan: PartitionPlan, test_size: float = 0.2,
                       positive_shares: dict[str, float] | None = None) -> DataFrame:
    """Holdout split and non-IID partition in one assignment: adds ``split``, and the client of the
    training rows (NULL in the holdout).

    Both order rows by the same seeded hash, so the pool's ranks are the table's ranks minus the
    quota, and the clients' ranges simply follow the holdout's.
    """
    def ranges_of(counts):
        quotas = pin_small(holdout_quotas(counts, [spec.label], test_size))
        pool = pin_small(quotas.select(spec.label, (F.col("n") - F.col("quota")).alias("n")))
        shards = null_safe_join(partition_ranges(pool, spec, plan, positive_shares),
                                quotas.select(spec.label, "quota"), [spec.label])
        held = quotas.select(spec.label, F.lit("holdout").alias("split"), F.lit(None).cast("string").alias(spec.client),
                             F.lit(0).cast("bigint").alias("lo"), F.col("quota").alias("hi"))
        return held.unionByName(shards.select(
            spec.label, F.lit("train").alias("split"), spec.client,
            (F.col("lo") + F.col("quota")).alias("lo"), (F.col("hi") + F.col("quota")).alias("hi")))
    return assign_by_rank(df.drop(spec.client), [spec.label], spec.key, plan.seed, ranges_of, "split", spec.ties)


def shuffle_rows(df: DataFrame, spec: TableSpec, seed: int, rows_per_file: int = 1_000_000) -> DataFrame:
    """Spread each client over as many partitions as its size asks for, in seeded order inside."""
    n = pin_small(df.groupBy(spec.client).agg(F.count("*").alias("__n")))
    salts = F.greatest(F.ceil(F.col("__n") / F.lit(rows_per_file)), F.lit(1))
    return (null_safe_join(df, n, [spec.client])
            .withColumn("__s", F.pmod(F.xxhash64(*spec.key), salts))
            .repartition(F.col(spec.client), F.col("__s"))
            .withColumn("__h", hash_key(seed, spec.key))
            .sortWithinPartitions(spec.client, "__h").drop("__n", "__s", "__h"))


def random_row(df: DataFrame, spec: TableSpec, seed: int) -> DataFrame:
    """One seeded pick with the label withheld as text (a top-1, never a sort of the table)."""
    truth = F.when(F.col(spec.label) == 1, "fraud").otherwise("legitimate").alias("actual_class")
    return (df.orderBy(hash_key(seed, spec.key), *spec.key, *spec.ties).limit(1)
            .select(*spec.features, truth))


def synthetic_targets(positives: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Synthetic rows wanted per client: max(1, half-even round of n_pos * ratio)."""
    return positives.select(
        "client", "n_pos",
        F.greatest(F.lit(1).cast("bigint"), F.bround(F.col("n_pos") * F.lit(float(ratio))).cast("bigint"))
        .alias("n_target"))
