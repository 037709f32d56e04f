"""Profiling queries."""

from pyspark.sql import functions as F

from fedtab import fixtures as fx
from fedtab.functions.common import r
from fedtab.operators import profile as pf

from . import base as b
from .sampling import partitioned


def shard_summary(spark, d):
    """Holdout, non-IID shards, and the summary of both: the partition job end to end."""
    rows = partitioned(spark, d).withColumn("client", F.coalesce("client", "split"))
    return pf.shard_summary(rows, fx.SPEC, "l_extendedprice")


def column_profile(spark, d):
    return pf.column_profile(fx.positives(spark, d), fx.SPEC)


def column_profile_all_rows(spark, d):
    return pf.column_profile(fx.txn(spark, d), fx.SPEC)


def top_correlations(spark, d):
    return pf.top_correlations(fx.positives(spark, d), fx.SPEC, 5)


def prototype_rows(spark, d):
    return pf.prototype_rows(pf.column_profile(fx.positives(spark, d), fx.SPEC), fx.SPEC)


def range_bounds(spark, d):
    return pf.range_bounds(fx.txn(spark, d), fx.SPEC).select(
        "client", "column", r("lower").alias("lower"), r("upper").alias("upper"))


def class_weight(spark, d):
    return pf.class_weight(fx.txn(spark, d), fx.SPEC).withColumn("pos_weight", r("pos_weight"))


def partition_reconciliation(spark, d):
    rows = partitioned(spark, d)
    return pf.reconcile(fx.txn(spark, d), rows, rows.filter("client IS NOT NULL"))


QUERIES = {f.__name__: f for f in (
    shard_summary, column_profile, column_profile_all_rows, top_correlations, prototype_rows,
    range_bounds, class_weight, partition_reconciliation)}


def _profile_sql(src):
    return f"""SELECT client, "column", round(avg(value), 4) + 0.0 AS mean,
        CASE WHEN count(*) > 1 THEN round(stddev_samp(value), 4) ELSE 0.0::DOUBLE END AS std,
        round(min(value), 4) + 0.0 AS min, round(quantile_cont(value, 0.25), 4) + 0.0 AS q25,
        round(quantile_cont(value, 0.5), 4) + 0.0 AS q50, round(quantile_cont(value, 0.75), 4) + 0.0 AS q75,
        round(max(value), 4) + 0.0 AS max FROM {src} GROUP BY client, "column" """


_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
CORR = " UNION ALL ".join(
    f"SELECT client, {p} AS pair, '{fx.FEATURES[i]}' AS col_a, '{fx.FEATURES[j]}' AS col_b, "
    f"corr({fx.FEATURES[i]}, {fx.FEATURES[j]}) AS r FROM %s GROUP BY client"
    for p, (i, j) in enumerate(_PAIRS))


def corr_sql(src):
    return CORR.replace("%s", src)


SQL = {
    "shard_summary": f"""WITH {b.partitioned()}, u AS (
        SELECT client, label, l_extendedprice FROM shard UNION ALL
        SELECT 'holdout', label, l_extendedprice FROM split WHERE split = 'holdout')
      SELECT client, count(*) AS n_rows, sum(label)::BIGINT AS n_fraud, (count(*) - sum(label))::BIGINT AS n_legit,
        round(100.0::DOUBLE * sum(label) / count(*), 4) AS fraud_rate_pct, round(avg(l_extendedprice), 2) AS amount_mean,
        round(stddev_samp(l_extendedprice), 2) AS amount_std FROM u GROUP BY client""",
    "column_profile": f"WITH {b.LONG_POS} {_profile_sql('long')}",
    "column_profile_all_rows": f"""WITH {b.TXN}, long AS (SELECT client, "column", value FROM
        (UNPIVOT (SELECT client, l_quantity, l_extendedprice, l_discount, l_tax FROM txn)
         ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME "column" VALUE value)) {_profile_sql('long')}""",
    "top_correlations": f"""WITH {b.POS}, c AS ({corr_sql('pos')}),
      k AS (SELECT client, pair, col_a, col_b, round(r, 4) + 0.0 AS r FROM c WHERE NOT isnan(r))
      SELECT client, row_number() OVER (PARTITION BY client ORDER BY abs(r) DESC, pair) AS rank, col_a, col_b, r
      FROM k QUALIFY rank <= 5""",
    "prototype_rows": f"""WITH {b.POS}, q(prototype, p) AS (VALUES ('typical', 0.5), ('low_tail', 0.25), ('high_tail', 0.75))
      SELECT client, prototype, {', '.join(f"CASE prototype WHEN 'typical' THEN round(quantile_cont({c}, 0.5), 4) WHEN 'low_tail' THEN round(quantile_cont({c}, 0.25), 4) ELSE round(quantile_cont({c}, 0.75), 4) END + 0.0 AS {c}" for c in fx.FEATURES)}
      FROM pos, q GROUP BY client, prototype""",
    "range_bounds": f"""WITH {b.TXN} {' UNION ALL '.join(f'''SELECT client, '{c}' AS "column",
      round(min({c}) - 3 * CASE WHEN max({c}) > min({c}) THEN max({c}) - min({c}) ELSE 1 END, 6) + 0.0 AS lower,
      round(max({c}) + 3 * CASE WHEN max({c}) > min({c}) THEN max({c}) - min({c}) ELSE 1 END, 6) + 0.0 AS upper
      FROM txn GROUP BY client''' for c in fx.FEATURES)}""",
    "class_weight": f"""WITH {b.TXN} SELECT client, count(*) AS n, sum(label)::BIGINT AS n_pos,
      round((count(*) - greatest(sum(label), 1))::DOUBLE / greatest(sum(label), 1), 6) AS pos_weight FROM txn GROUP BY client""",
    "partition_reconciliation": f"""WITH {b.partitioned()}, n AS (SELECT (SELECT count(*) FROM txn) AS n_raw,
      (SELECT count(*) FROM split WHERE split = 'train') AS n_train,
      (SELECT count(*) FROM split WHERE split = 'holdout') AS n_holdout,
      (SELECT count(*) FROM shard) AS n_shards)
      SELECT *, n_raw = n_train + n_holdout AND n_train = n_shards AS balanced FROM n""",
}
