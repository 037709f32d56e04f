"""Projection, filtering, casts, de-duplication, standardization and training-set assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import fetch_small, null_safe_join, pin_small
from ..spec import MODE_LABEL, POOLED, TableSpec


def drop_duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One of each set of identical rows. The full-row form combines before it shuffles."""
    return df.distinct() if columns is None else df.dropDuplicates(list(columns))


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows before, after and removed by the de-duplication."""
    cols = list(columns or df.columns)
    per = df.groupBy(*cols).agg(F.count("*").alias("c"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")) \
        .withColumn("n_removed", F.col("n_rows") - F.col("n_distinct"))


def project_features(df: DataFrame, spec: TableSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Features in the order of the spec, after the columns to keep."""
    return df.select(*keep, *spec.features)


def feature_vector(spec: TableSpec) -> Column:
    return F.array(*[F.col(c).cast("double") for c in spec.features])


def with_class(df: DataFrame, spec: TableSpec, label: int) -> DataFrame:
    return df.filter(F.col(spec.label) == label)


def append_label(df: DataFrame, spec: TableSpec, label: int = 1) -> DataFrame:
    return df.withColumn(spec.label, F.lit(label))


def coerce(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Text columns to double features and an int label. A value that does not convert becomes
    NULL, and ``dtype_errors`` names its column."""
    out, bad = list(keep), []
    for c, kind in [*[(f, "double") for f in features], (label, "int")]:
        v = F.col(c).try_cast(kind)
        out.append(v.alias(c))
        bad.append(F.when(v.isNull() & F.col(c).isNotNull(), F.lit(c)))
    return df.select(*out, F.concat_ws(",", *bad).alias("dtype_errors"))


def narrow(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scaled values as float32, the type the model reads."""
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def fit_scaler(df: DataFrame, spec: TableSpec, pooled: bool = False) -> DataFrame:
    """(client, n, mean[], std[]) with the population std; a constant column gets scale 1.

    One map-side combined aggregate, so a dominant client costs no more than a small one.
    """
    client = F.lit(POOLED) if pooled else F.col(spec.client)
    std = [F.stddev_pop(c) for c in spec.features]
    return (df.groupBy(client.alias("client"))
            .agg(F.count("*").alias("n"),
                 F.array(*[F.avg(c) for c in spec.features]).alias("mean"),
                 F.array(*[F.when(s == 0.0, 1.0).otherwise(s) for s in std]).alias("std")))


def scale(df: DataFrame, scalers: DataFrame, spec: TableSpec, client: str | None = None) -> DataFrame:
    """Every row by the scaler of its client (or of the pooled table); keeps all columns. A row whose
    client has no scaler is an error."""
    client = client or spec.client
    sc = pin_small(scalers.select(F.col("client").alias("__k"), "mean", "std"))
    key = F.col(client) if client in df.columns else F.lit(POOLED)
    lost = F.raise_error(F.concat(F.lit("no scaler for client "), F.coalesce(key, F.lit("NULL")))).cast("double")
    return (df.join(sc, key == F.col("__k"), "left")
            .withColumns({c: F.when(F.col("mean").isNull(), lost).otherwise((F.col(c) - F.col("mean")[i]) / F.col("std")[i])
                          for i, c in enumerate(spec.features)})
            .drop("__k", "mean", "std"))


def scale_for_every_client(holdout: DataFrame, scalers: DataFrame, spec: TableSpec) -> DataFrame:
    """The holdout once per client, in that client's scale: rows x clients, as evaluation needs.

    Each row is exploded over the client names and then finds its scaler by an equi-join.
    """
    scalers = pin_small(scalers)
    names = sorted(x[0] for x in fetch_small(scalers.select("client")))
    every = holdout.withColumn("client", F.explode(F.array(*[F.lit(n) for n in names])))
    return scale(every, scalers, spec, "client")


def training_set(real: DataFrame, validated: DataFrame | None, spec: TableSpec) -> DataFrame:
    """Real rows, plus the validated synthetic ones when there are any; ``source`` tells which.

    ``row_key`` identifies a row by its key columns (for generated rows their id), so equal feature
    values never make two rows one.
    """
    def side(df, source):
        ids = [c for c in (*spec.key, "mode", "id") if c in df.columns]
        if not ids:
            raise ValueError(f"{source} rows need key columns {list(spec.key)} or an id")
        key = F.md5(F.concat_ws("|", F.lit(source), *[F.col(c).cast("string") for c in ids]))
        return df.select(spec.client, *spec.features, spec.label, F.lit(source).alias("source"), key.alias("row_key"))
    out = side(real, "real")
    return out if validated is None else out.unionByName(side(validated, "synthetic"))


def pooled(df: DataFrame, spec: TableSpec) -> DataFrame:
    """All clients as one training set."""
    return df.withColumn(spec.client, F.lit(POOLED))


def effective_mode(clients: DataFrame, verdicts: DataFrame, augmented: bool) -> DataFrame:
    """What each client really trains on: clients(client, mode) with verdicts(client, verdict)."""
    label = F.create_map(*[x for k, v in MODE_LABEL.items() for x in (F.lit(k), F.lit(v))])[F.col("mode")]
    j = null_safe_join(clients, verdicts.select("client", "verdict"), ["client"], "left")
    rejected = F.col("verdict").isNotNull() & (F.col("verdict") != "PASS")
    shown = (F.when(F.lit(not augmented), F.lit("Real-only"))
             .when(rejected, F.concat(label, F.lit(" (rejected -> real-only)"))).otherwise(label))
    return j.select("client", "mode", "verdict", shown.alias("effective_mode"),
                    (F.lit(augmented) & ~rejected).alias("uses_synthetic"))
