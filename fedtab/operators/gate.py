"""The validation gate: per-row schema checks, batch scores, verdict and report.

Every step covers all batches of all clients in one plan. A batch is (client, mode).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import null_safe_join, pin_small, safe_div, stage, unpivot
from ..functions.prefix import histogram_bucket, running_totals
from ..functions.text import embed_rows
from ..spec import TableSpec, Thresholds
from .nearest import batch_similarity
from .novelty import novelty
from .profile import correlations, range_bounds

BATCH = ("client", "mode")


def bounds_by_client(bounds: DataFrame) -> DataFrame:
    """Bounds as one row per client: column -> (lower, upper)."""
    return bounds.groupBy("client").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("column"), F.struct("lower", "upper")))).alias("bounds"))


def check_rows(candidates: DataFrame, bounds: DataFrame, spec: TableSpec) -> DataFrame:
    """Adds ``reasons`` (every violated rule in column order) and ``passed``. Row-local, so it works
    on streams as well; extra columns pass through. A client without bounds fails on every column."""
    b = pin_small(bounds_by_client(bounds))
    rules = []
    for c in spec.features:
        v = F.col(c).try_cast("double")
        lim = F.col("bounds")[c]
        bad = (F.when(F.col(c).isNull(), F.lit(f"{c}:null")).when(v.isNull(), F.lit(f"{c}:dtype"))
               .when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(f"{c}:not_finite"))
               .when(lim.isNull(), F.lit(f"{c}:no_bounds"))
               .when(v < lim["lower"], F.lit(f"{c}:below_range"))
               .when(v > lim["upper"], F.lit(f"{c}:above_range")))
        rules.append(bad)
    y = F.col(spec.label)
    rules.append(F.when(y.isNull(), F.lit(f"{spec.label}:null")).when(y != 1, F.lit(f"{spec.label}:not_one")))
    j = candidates.join(b.withColumnRenamed("client", "__bc"),
                        candidates[spec.client].eqNullSafe(F.col("__bc")), "left")
    return (j.withColumn("reasons", F.array_compact(F.array(*rules)))
            .withColumn("passed", F.size("reasons") == 0).drop("bounds", "__bc"))


def first_reason(checked: DataFrame) -> DataFrame:
    """Rejected rows with the first rule they broke."""
    return checked.filter(~F.col("passed")).withColumn("reason", F.element_at("reasons", 1))


def rejection_stats(checked: DataFrame, batch: Sequence[str] = BATCH) -> DataFrame:
    return first_reason(checked).groupBy(*batch, "reason").agg(F.count("*").alias("n"))


def pass_counts(checked: DataFrame, batch: Sequence[str] = BATCH) -> DataFrame:
    return checked.groupBy(*batch).agg(
        F.count("*").alias("n_candidates"), F.count_if("passed").alias("n_schema_pass"),
        F.count_if(~F.col("passed")).alias("n_schema_errors"))


def column_shape(real: DataFrame, synthetic: DataFrame, spec: TableSpec, batch: Sequence[str] = BATCH) -> DataFrame:
    """Per batch and column 1 - KS statistic between the real and the synthetic distribution.

    The real rows are summed up once per client, as a histogram over buckets of the value; every batch of the client is
    compared with that. Only in buckets that could hold the largest gap are values looked at, on either side, and
    the real ones of a bucket are collapsed once however many batches ask for it.
    """
    batch, client = list(batch), spec.client
    keys, cell = [*batch, "column"], [client, "column", "__b"]
    bucket = histogram_bucket(F.col("value")).alias("__b")
    real_long = unpivot(real, [client], spec.features).select(client, "column", "value", bucket)
    made_long = unpivot(synthetic, batch, spec.features).select(*keys, "value", bucket)
    batches = pin_small(synthetic.select(*batch).distinct())
    summary = stage(real_long.groupBy(*cell).agg(F.count(F.lit(1)).alias("a")))
    hist = (null_safe_join(batches, summary, [client]).select(*keys, "__b", "a", F.lit(0).cast("bigint").alias("b"))
            .unionByName(made_long.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("b")).withColumn("a", F.lit(0).cast("bigint")))
            .groupBy(*keys, "__b").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    every = Window.partitionBy(*keys)
    upto = every.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumns({"a1": F.sum("a").over(upto), "b1": F.sum("b").over(upto),
                             "na": F.sum("a").over(every), "nb": F.sum("b").over(every)})

    def cdf(x, n):
        return safe_div(x, F.col(n))
    a0, b0 = cdf(F.col("a1") - F.col("a"), "na"), cdf(F.col("b1") - F.col("b"), "nb")
    a1, b1 = cdf(F.col("a1"), "na"), cdf(F.col("b1"), "nb")
    # inside a bucket the gap stays between its corners; only buckets that could beat the best
    # gap seen at a bucket's end need their values in order
    hist = (hist.withColumns({"gap": F.abs(a1 - b1), "most": F.greatest(F.abs(a1 - b0), F.abs(a0 - b1))})
            .withColumn("best", F.max("gap").over(every)))
    hot = pin_small(hist.filter((F.col("most") > F.col("best")) & (F.col("a") + F.col("b") > 1))
                    .select(*keys, "__b", "na", "nb", (F.col("a1") - F.col("a")).alias("a0"),
                            (F.col("b1") - F.col("b")).alias("b0")))
    asked = hot.select(*keys, "__b")
    real_values = (null_safe_join(real_long, pin_small(asked.select(*cell).distinct()), cell, "left_semi")
                   .groupBy(*cell, "value").agg(F.count(F.lit(1)).alias("a")))
    made_values = null_safe_join(made_long, asked, [*keys, "__b"], "left_semi").select(
        *keys, "__b", "value", F.lit(0).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"))
    values = (null_safe_join(asked, real_values, cell).select(*keys, "__b", "value", "a", F.lit(0).cast("bigint").alias("b"))
              .unionByName(made_values))
    near = null_safe_join(running_totals(values, [*keys, "__b"], "value", ["a", "b"]), hot, [*keys, "__b"]).select(
        *keys, F.abs(cdf(F.col("a0") + F.col("cum_a"), "na") - cdf(F.col("b0") + F.col("cum_b"), "nb")).alias("gap"))
    return hist.select(*keys, "gap").unionByName(near).groupBy(*keys).agg((1 - F.max("gap")).alias("score"))


def pair_trends(real: DataFrame, synthetic: DataFrame, spec: TableSpec, batch: Sequence[str] = BATCH) -> DataFrame:
    """Per batch and column pair 1 - |r_real - r_synthetic| / 2; NULL where r is undefined. The real side is computed once
    per client."""
    batch = list(batch)
    made = correlations(synthetic, spec, batch)
    own = correlations(real, spec, [spec.client]).select(spec.client, "pair", F.col("r").alias("__real"))
    return null_safe_join(made, pin_small(own), [spec.client, "pair"], "left").select(
        *batch, "pair", "col_a", "col_b", (1 - F.abs(F.col("__real") - F.col("r")) / 2).alias("score"))


def fidelity(real: DataFrame, synthetic: DataFrame, spec: TableSpec,
             batch: Sequence[str] = BATCH) -> DataFrame:
    """Mean column shape, mean pair trend (undefined pairs left out) and their mean; a property
    with no defined score does not count."""
    s = column_shape(real, synthetic, spec, batch).groupBy(*batch).agg(F.avg("score").alias("column_shapes"))
    p = pair_trends(real, synthetic, spec, batch).groupBy(*batch).agg(F.avg("score").alias("pair_trends"))
    a, b = F.col("column_shapes"), F.col("pair_trends")
    return null_safe_join(s, p, batch, "left").withColumn(
        "fidelity_score", F.when(a.isNull(), b).when(b.isNull(), a).otherwise((a + b) / 2))


def verdict(t: Thresholds = Thresholds()) -> Column:
    """First failed check wins."""
    return (F.when(F.col("n_schema_pass") < t.min_valid_rows, "REJECT_TOO_FEW_ROWS")
            .when(F.col("fidelity_score") < t.fidelity_floor, "REJECT_FIDELITY")
            .when(F.col("novelty_score") < t.novelty_floor, "REJECT_NOVELTY")
            .when(F.col("mode_collapse_max") > t.mode_collapse_ceiling, "REJECT_MODE_COLLAPSE")
            .otherwise("PASS"))


def report(checked: DataFrame, real: DataFrame, spec: TableSpec, batch: Sequence[str] = BATCH,
           thresholds: Thresholds = Thresholds(), vectors: DataFrame | None = None) -> DataFrame:
    """The eleven-field validation report, one row per batch.

    ``real`` holds the clients' positives, ``vectors`` an optional embedding (batch, vec) of the
    passing rows; the default embeds the row text. Batches with too few valid rows are not scored.
    """
    batch = list(batch)
    real = stage(real.select(spec.client, *spec.features))  # read by three scores
    counts = pin_small(pass_counts(checked, batch))
    enough = counts.filter(F.col("n_schema_pass") >= thresholds.min_valid_rows).select(*batch)
    scored = null_safe_join(checked.filter("passed"), enough, batch, "left_semi")
    vec = vectors if vectors is not None else embed_rows(scored, spec.features, batch)
    parts = [fidelity(real, scored, spec, batch).select(*batch, "fidelity_score"),
             novelty(real, scored, spec.features, [spec.client], batch).select(*batch, "novelty_score"),
             batch_similarity(vec, batch)]
    out = counts
    for p in parts:
        out = null_safe_join(out, p, batch, "left")
    out = out.withColumn("batch_verdict", verdict(thresholds))
    return out.select(*batch, "n_candidates", "n_schema_pass", "n_schema_errors", "batch_verdict",
                      "fidelity_score", "novelty_score", "mode_collapse_mean", "mode_collapse_max",
                      F.when(F.col("batch_verdict") == "PASS", F.col("n_schema_pass")).otherwise(0)
                      .cast("bigint").alias("n_validated_rows"))


def accept(checked: DataFrame, reports: DataFrame, batch: Sequence[str] = BATCH) -> DataFrame:
    """All schema-passing rows of the batches that passed, none of the others."""
    ok = pin_small(reports.filter("batch_verdict = 'PASS'").select(*batch))
    return null_safe_join(checked.filter("passed"), ok, batch, "left_semi").drop("reasons", "passed")


def run_gate(candidates: DataFrame, shards: DataFrame, spec: TableSpec,
             thresholds: Thresholds = Thresholds(), batch: Sequence[str] = BATCH):
    """(accepted rows, report): bounds come from the client's whole shard, scores from its positives."""
    checked = stage(check_rows(candidates, range_bounds(shards, spec), spec))
    rep = pin_small(report(checked, shards.filter(F.col(spec.label) == 1), spec, batch, thresholds))
    return accept(checked, rep, batch), rep
