"""Projection, cleaning, scaling and training-set queries."""

from pyspark.sql import functions as F

from fedtab import fixtures as fx
from fedtab.functions.common import literal_table, r
from fedtab.operators import prep

from . import base as b
from .sampling import train_pool


def dedupe_rows(spark, d):
    docs = fx.table(spark, d, "documents").select("text", "lang")
    return prep.duplicate_count(docs)


def dedupe_kept(spark, d):
    docs = fx.table(spark, d, "documents").select("text", "lang")
    return prep.drop_duplicate_rows(docs).groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def feature_projection(spark, d):
    return prep.project_features(fx.txn(spark, d), fx.SPEC, keep=fx.KEY)


def class_filter(spark, d):
    return prep.with_class(fx.txn(spark, d), fx.SPEC, 1).select(*fx.KEY, "client", "label")


def constant_label(spark, d):
    return prep.append_label(fx.txn(spark, d), fx.SPEC).select(*fx.KEY, "label")


def coercing_cast(spark, d):
    """Typed columns arrive as text; some texts are no numbers."""
    ev = fx.table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.concat(F.lit("v"), F.col("value").cast("string")))
        .otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_type") == "view", F.lit("yes"))
        .otherwise(F.regexp_extract("props", r"(\d+)", 1)).alias("k"))
    return prep.coerce(ev, ["value"], "k", keep=["event_id"])


def client_scaler(spark, d):
    return _scaler_rows(prep.fit_scaler(fx.txn(spark, d), fx.SPEC))


def pooled_scaler(spark, d):
    return _scaler_rows(prep.fit_scaler(fx.txn(spark, d), fx.SPEC, pooled=True))


def _scaler_rows(s):
    names = F.array(*[F.lit(c) for c in fx.FEATURES])
    return (s.select("client", "n", F.inline(F.arrays_zip(names.alias("column"), "mean", "std")))
            .select("client", "n", "column", r("mean").alias("mean"), r("std").alias("std")))


def scaled_rows(spark, d):
    t = fx.txn(spark, d)
    out = prep.scale(t, prep.fit_scaler(t, fx.SPEC), fx.SPEC)
    return out.select(*fx.KEY, "client", *[r(c, 5).alias(c) for c in fx.FEATURES])


def float32_narrowing(spark, d):
    t = fx.txn(spark, d)
    return prep.narrow(t, ["l_extendedprice", "l_discount"]).select(
        *fx.KEY, F.col("l_extendedprice").cast("double").alias("price32"),
        F.col("l_discount").cast("double").alias("discount32"))


def holdout_by_client_scaler(spark, d):
    """The holdout in every client's scale, summarized per client and label."""
    split = train_pool(spark, d)
    sc = prep.fit_scaler(split.filter("split = 'train'"), fx.SPEC)
    out = prep.scale_for_every_client(split.filter("split = 'holdout'"), sc, fx.SPEC)
    return out.groupBy("client", "label").agg(
        F.count("*").alias("n"), *[r(F.avg(c), 5).alias(c) for c in fx.FEATURES])


def training_set_real_plus_synthetic(spark, d):
    out = prep.training_set(fx.txn(spark, d), fx.candidates(spark, d).filter("mode = 'schema_llm'"), fx.SPEC)
    return out.groupBy("client", "source").agg(
        F.count("*").alias("n"), F.sum("label").cast("bigint").alias("n_pos"))


def pooled_training_set(spark, d):
    return prep.pooled(fx.txn(spark, d), fx.SPEC).groupBy("client").agg(
        F.count("*").alias("n"), F.sum("label").cast("bigint").alias("n_pos"))


def effective_mode(spark, d):
    modes = literal_table(spark, [("A", "augment_ctgan"), ("B", "augment_ctgan"), ("C", "schema_llm"),
                                  ("D", "schema_llm")], "client string, mode string")
    n = F.count("*")
    verdicts = fx.positives(spark, d).filter("client <> 'D'").groupBy("client").agg(
        F.when(F.avg("l_discount") > 0.05, "PASS").when(n < 5, "REJECT_TOO_FEW_ROWS")
        .otherwise("REJECT_NOVELTY").alias("verdict"))
    return prep.effective_mode(modes, verdicts, augmented=True)


QUERIES = {f.__name__: f for f in (
    dedupe_rows, dedupe_kept, feature_projection, class_filter, constant_label, coercing_cast,
    client_scaler, pooled_scaler, scaled_rows, float32_narrowing, holdout_by_client_scaler,
    training_set_real_plus_synthetic, pooled_training_set, effective_mode)}


def _scaler_sql(src, client):
    return " UNION ALL ".join(
        f"""SELECT {client} AS client, count(*) AS n, '{c}' AS "column", round(avg({c}), 6) + 0.0 AS mean,
            round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) + 0.0 AS std
            FROM {src} GROUP BY 1""" for c in fx.FEATURES)


_STAT = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(fx.FEATURES))

SQL = {
    "dedupe_rows": """SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS n_distinct,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS n_removed FROM documents""",
    "dedupe_kept": """SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars
        FROM (SELECT DISTINCT text, lang FROM documents) GROUP BY lang""",
    "feature_projection": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
        l_discount, l_tax FROM lineitem""",
    "class_filter": f"""WITH {b.POS} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, client, label FROM pos""",
    "constant_label": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 1 AS label FROM lineitem",
    "coercing_cast": """WITH t AS (SELECT event_id,
          CASE WHEN event_type = 'error' THEN 'v' || value ELSE value::VARCHAR END AS v,
          CASE WHEN event_type = 'view' THEN 'yes' ELSE regexp_extract(props, '(\\d+)', 1) END AS k FROM events)
        SELECT event_id, TRY_CAST(v AS DOUBLE) AS value, TRY_CAST(k AS INTEGER) AS k,
          concat_ws(',', CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN 'value' END,
                         CASE WHEN TRY_CAST(k AS INTEGER) IS NULL THEN 'k' END) AS dtype_errors FROM t""",
    "client_scaler": f"WITH {b.TXN} {_scaler_sql('txn', 'client')}",
    "pooled_scaler": f"""WITH {b.TXN} {_scaler_sql('txn', "'*'")}""",
    "scaled_rows": f"""WITH {b.TXN}, s AS (SELECT client, {_STAT} FROM txn GROUP BY client)
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, client,
          {', '.join(f'round(({c} - m{i}) / s{i}, 5) + 0.0 AS {c}' for i, c in enumerate(fx.FEATURES))}
        FROM txn JOIN s USING (client)""",
    "float32_narrowing": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
        l_extendedprice::FLOAT::DOUBLE AS price32, l_discount::FLOAT::DOUBLE AS discount32 FROM lineitem""",
    "holdout_by_client_scaler": f"""WITH {b.holdout()}, s AS (SELECT client, {_STAT} FROM split
          WHERE split = 'train' GROUP BY client)
        SELECT s.client, label, count(*) AS n,
          {', '.join(f'round(avg(({c} - m{i}) / s{i}), 5) + 0.0 AS {c}' for i, c in enumerate(fx.FEATURES))}
        FROM (SELECT * EXCLUDE (client) FROM split WHERE split = 'holdout') h CROSS JOIN s GROUP BY ALL""",
    "training_set_real_plus_synthetic": f"""WITH {b.CAND}, u AS (
          SELECT client, 'real' AS source, label FROM txn UNION ALL
          SELECT client, 'synthetic', label FROM cand WHERE mode = 'schema_llm')
        SELECT client, source, count(*) AS n, sum(label)::BIGINT AS n_pos FROM u GROUP BY ALL""",
    "pooled_training_set": f"WITH {b.TXN} SELECT '*' AS client, count(*) AS n, sum(label)::BIGINT AS n_pos FROM txn",
    "effective_mode": f"""WITH {b.POS}, v AS (SELECT client, CASE WHEN avg(l_discount) > 0.05 THEN 'PASS'
            WHEN count(*) < 5 THEN 'REJECT_TOO_FEW_ROWS' ELSE 'REJECT_NOVELTY' END AS verdict
          FROM pos WHERE client <> 'D' GROUP BY client),
          m(client, mode) AS (VALUES ('A','augment_ctgan'),('B','augment_ctgan'),('C','schema_llm'),('D','schema_llm')),
          l AS (SELECT m.client, mode, verdict, CASE mode WHEN 'augment_ctgan' THEN 'Augment (CTGAN)' ELSE 'Schema (LLM)' END AS lab,
                coalesce(verdict <> 'PASS', false) AS rej FROM m LEFT JOIN v USING (client))
        SELECT client, mode, verdict, lab || CASE WHEN rej THEN ' (rejected -> real-only)' ELSE '' END AS effective_mode,
               NOT rej AS uses_synthetic FROM l""",
}
