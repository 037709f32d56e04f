"""Run-warehouse queries; run documents come from orders, metric documents from lineitem."""

from pyspark.sql import functions as F

from fedtab import fixtures as fx
from fedtab.functions.common import literal_table, r
from fedtab.operators import runs as rn
from fedtab.spec import METRICS

from . import base as b

# ---- fixed values: how the orders table stands in for run documents -----------------------
ARM_OF_PRIORITY = {"1-URGENT": "isolated_real", "2-HIGH": "isolated_augmented", "3-MEDIUM": "federated_real",
                   "4-NOT SPECIFIED": "federated_augmented", "5-LOW": "centralized_real"}
STATUS = {"F": "complete", "O": "running", "P": "failed"}
POINTS = [("survey", "federated_real", "accuracy", 0.91), ("survey", "centralized_real", "accuracy", 0.95),
          ("paper", "federated_augmented", "f1", 0.90), ("paper", "federated_augmented", "auc", 0.96)]


def _case(values, col):
    out = None
    for k, v in values.items():
        out = F.when(F.col(col) == k, v) if out is None else out.when(F.col(col) == k, v)
    return out


def runs(spark, d):
    o = fx.table(spark, d, "orders")
    frac = F.pmod(F.col("o_custkey"), F.lit(1000)) / 1000.0
    return o.select(
        F.format_string("run_%010d", "o_orderkey").alias("run_id"),
        _case(ARM_OF_PRIORITY, "o_orderpriority").alias("arm"), _case(STATUS, "o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("date").cast("string").alias("created_at"),
        F.when(F.col("o_custkey") % 5 == 0, 20).otherwise(3).alias("epochs"),
        F.when(F.col("o_custkey") % 4 == 0, 10).otherwise(2).alias("num_rounds"),
        frac.alias("f1"), (F.col("o_totalprice") / 1000000.0).alias("precision"), (1 - frac).alias("recall"),
        (frac / 2 + 0.5).alias("auc"), (frac / 10 + 0.9).alias("accuracy"))


def _case_sql(values, col):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


RUNS = f"""runs AS (SELECT 'run_' || lpad(o_orderkey::VARCHAR, 10, '0') AS run_id,
    {_case_sql(ARM_OF_PRIORITY, 'o_orderpriority')} AS arm, {_case_sql(STATUS, 'o_orderstatus')} AS status,
    o_orderdate::DATE::VARCHAR AS created_at,
    CASE WHEN o_custkey % 5 = 0 THEN 20 ELSE 3 END AS epochs, CASE WHEN o_custkey % 4 = 0 THEN 10 ELSE 2 END AS num_rounds,
    (o_custkey % 1000) / 1000.0::DOUBLE AS f1, o_totalprice / 1000000.0::DOUBLE AS precision,
    1 - (o_custkey % 1000) / 1000.0::DOUBLE AS recall, (o_custkey % 1000) / 1000.0::DOUBLE / 2 + 0.5::DOUBLE AS auc,
    (o_custkey % 1000) / 1000.0::DOUBLE / 10 + 0.9::DOUBLE AS accuracy FROM orders)"""


def client_docs(spark, d):
    t = fx.table(spark, d, "lineitem")
    slot = F.pmod(F.col("l_suppkey"), F.lit(4))
    return t.select(
        F.format_string("run_%010d", "l_orderkey").alias("run_id"),
        F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).alias("round"),
        F.when(slot == 0, "A").when(slot == 1, "B").when(slot == 2, "C").otherwise("D").alias("client"),
        (F.col("l_discount") * 5).alias("f1"), (F.col("l_tax") * 10).alias("precision"),
        (F.col("l_quantity") / 50).alias("recall"),
        "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))


DOCS = """docs AS (SELECT 'run_' || lpad(l_orderkey::VARCHAR, 10, '0') AS run_id,
    CASE WHEN l_linenumber < 7 THEN l_linenumber END AS round,
    CASE l_suppkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS client,
    l_discount * 5 AS f1, l_tax * 10 AS precision, l_quantity / 50 AS recall,
    l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem)"""
VERSION = ["l_partkey", "l_suppkey", "cents"]


def latest_full_run(spark, d):
    return rn.latest_full_runs(runs(spark, d)).select("arm", "run_id", "created_at", "status")


def latest_completed_grid(spark, d):
    return rn.latest_completed_grid(runs(spark, d)).select(
        "arm", "run_id", *[r(m).alias(m) for m in ("f1", "precision", "recall")], "has_data")


def missing_arms(spark, d):
    return rn.missing_arms(runs(spark, d))


def run_history(spark, d):
    return rn.history(runs(spark, d), completed_only=True).select("run_id", "arm", "status", "created_at")


def run_detail(spark, d):
    docs = client_docs(spark, d)
    out = rn.run_detail(runs(spark, d), docs.filter("client = 'A'"), docs.filter("client <> 'A'"))
    return out.groupBy("run_id", "arm", "status").agg(
        F.count_if(F.col("kind") == "round").alias("n_rounds"),
        F.count_if(F.col("kind") == "client").alias("n_clients"), r(F.sum("f1")).alias("f1_sum"))


def convergence_series(spark, d):
    docs = rn.upsert(client_docs(spark, d).filter(F.lit(False)), client_docs(spark, d), ["run_id", "round"], VERSION)
    return rn.convergence(docs).select("run_id", "round", *[r(m).alias(m) for m in ("f1", "precision", "recall")])


def latest_client_metric(spark, d):
    return rn.latest_per_client(client_docs(spark, d), VERSION).select("run_id", "client", "round", r("f1").alias("f1"))


def arm_results(spark, d):
    return rn.results_table(runs(spark, d)).select("arm", "run_id", *[r(m).alias(m) for m in METRICS])


def reference_gaps(spark, d):
    return rn.reference_gaps(rn.results_table(runs(spark, d)), POINTS).select(
        "source", "arm", "metric", *[r(c).alias(c) for c in ("ours", "reference", "gap")])


def quality_panel(spark, d):
    modes = literal_table(spark, [("A", "augment_ctgan"), ("B", "augment_ctgan"), ("C", "schema_llm"),
                                  ("D", "schema_llm")], "client string, mode string")
    rows = fx.txn(spark, d)
    reports = (rows.filter("client <> 'D'").groupBy("client").agg(
        F.avg("l_discount").alias("fidelity_score"), F.avg("l_tax").alias("novelty_score"),
        F.max("l_quantity").alias("mode_collapse_max"),
        F.when(F.sum("label") > 185, "PASS").otherwise("REJECT_NOVELTY").alias("batch_verdict"))
        .withColumn("mode", F.when(F.col("client") < "C", "augment_ctgan").otherwise("schema_llm")))
    out = rn.quality_panel(modes, rows.filter("label = 1"), rows.filter("label = 1 AND client = 'A'"), reports)
    return out.select("client", "mode", "n_candidates", "n_validated",
                      *[r(c, 4).alias(c) for c in ("fidelity_score", "novelty_score", "mode_collapse_max")],
                      "batch_verdict", "mode_label", "verdict_label")


def keyed_upsert(spark, d):
    """The metric documents applied twice to a table that already holds some of them."""
    docs = client_docs(spark, d)
    once = rn.upsert(docs.filter("cents % 2 = 0"), docs, ["run_id", "round", "client"], VERSION)
    twice = rn.upsert(once, docs, ["run_id", "round", "client"], VERSION)
    return twice.select("run_id", "round", "client", r("f1").alias("f1"), "cents")


def run_finalize(spark, d):
    """Orders finalize runs; half of the updates name runs that do not exist."""
    base = runs(spark, d).filter("status <> 'failed'").withColumn("updated_at", F.col("created_at"))
    updates = runs(spark, d).filter("status <> 'complete'").select(
        "run_id", F.lit("complete").alias("status"), (F.col("f1") + 1).alias("f1"), F.lit("2030-01-01").alias("updated_at"))
    return rn.finalize(base, updates).select("run_id", "arm", "status", r("f1").alias("f1"), "updated_at")


def run_registration(spark, d):
    c = fx.table(spark, d, "customer")
    req = c.select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.lit("federated_real"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit("no_such_arm"))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("isolated_augmented")).alias("arm"),
        F.when(F.col("c_nationkey") > 10, F.col("c_nationkey")).alias("seed"),
        F.when(F.col("c_nationkey") < 5, F.col("c_nationkey")).alias("epochs"),
        F.lit(None).cast("int").alias("num_rounds"),
        F.when(F.col("c_nationkey") == 7, F.lit(3)).alias("local_epochs"))
    return rn.register(req)


def arm_deltas(spark, d):
    return rn.arm_deltas(rn.results_table(runs(spark, d))).select(
        "comparison", "within", "metric", r("delta").alias("delta"))


QUERIES = {f.__name__: f for f in (
    latest_full_run, latest_completed_grid, missing_arms, run_history, run_detail, convergence_series,
    latest_client_metric, arm_results, reference_gaps, quality_panel, keyed_upsert, run_finalize,
    run_registration, arm_deltas)}

ARMS_SQL = """arms(arm) AS (VALUES ('isolated_real'),('isolated_augmented'),('federated_real'),
    ('federated_augmented'),('centralized_real'),('centralized_augmented'))"""
FULL = """full_runs AS (SELECT * FROM runs WHERE CASE WHEN arm LIKE 'federated%' THEN num_rounds = 10 ELSE epochs = 20 END
    QUALIFY row_number() OVER (PARTITION BY arm ORDER BY created_at DESC, run_id DESC) = 1)"""
LONG = " UNION ALL ".join(f"SELECT arm, '{m}' AS metric, {m} AS v FROM full_runs" for m in METRICS)

SQL = {
    "latest_full_run": f"WITH {RUNS}, {FULL} SELECT arm, run_id, created_at, status FROM full_runs",
    "latest_completed_grid": f"""WITH {RUNS}, {ARMS_SQL}, l AS (SELECT * FROM runs WHERE status = 'complete'
        QUALIFY row_number() OVER (PARTITION BY arm ORDER BY created_at DESC, run_id DESC) = 1)
      SELECT arm, run_id, round(coalesce(f1, 0), 6) AS f1, round(coalesce(precision, 0), 6) AS precision,
        round(coalesce(recall, 0), 6) AS recall, run_id IS NOT NULL AS has_data FROM arms LEFT JOIN l USING (arm)""",
    "missing_arms": f"WITH {RUNS}, {ARMS_SQL} SELECT arm FROM arms WHERE arm NOT IN (SELECT arm FROM runs WHERE status = 'complete')",
    "run_history": f"""WITH {RUNS} SELECT run_id, arm, status, created_at FROM runs WHERE status = 'complete'
        ORDER BY created_at DESC, run_id DESC""",
    "run_detail": f"""WITH {RUNS}, {DOCS} SELECT run_id, arm, status, count(*) FILTER (client = 'A') AS n_rounds,
        count(*) FILTER (client <> 'A') AS n_clients, round(sum(d.f1), 6) + 0.0 AS f1_sum
      FROM runs LEFT JOIN docs d USING (run_id) GROUP BY run_id, arm, status""",
    "convergence_series": f"""WITH {DOCS} SELECT run_id, round, round(f1, 6) AS f1, round(precision, 6) AS precision,
        round(recall, 6) AS recall FROM (SELECT * FROM docs WHERE round IS NOT NULL QUALIFY row_number() OVER
          (PARTITION BY run_id, round ORDER BY l_partkey DESC, l_suppkey DESC, cents DESC) = 1)""",
    "latest_client_metric": f"""WITH {DOCS} SELECT run_id, client, round, round(f1, 6) AS f1 FROM docs
      QUALIFY row_number() OVER (PARTITION BY run_id, client ORDER BY coalesce(round, 0) DESC,
        l_partkey, l_suppkey, cents) = 1""",
    "arm_results": f"WITH {RUNS}, {FULL} SELECT arm, run_id, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)} FROM full_runs",
    "reference_gaps": f"""WITH {RUNS}, {FULL}, m AS ({LONG}), p(source, arm, metric, reference) AS
        (VALUES {', '.join(f"('{s}', '{a}', '{m}', {v}::DOUBLE)" for s, a, m, v in POINTS)})
      SELECT source, arm, metric, round(v, 6) AS ours, round(reference, 6) AS reference,
        round(v - reference, 6) + 0.0 AS gap FROM m JOIN p USING (arm, metric)""",
    "quality_panel": f"""WITH {b.TXN}, m(client, mode) AS (VALUES ('A','augment_ctgan'),('B','augment_ctgan'),('C','schema_llm'),('D','schema_llm')),
      rep AS (SELECT client, avg(l_discount) AS f, avg(l_tax) AS n, max(l_quantity) AS x,
        CASE WHEN sum(label) > 185 THEN 'PASS' ELSE 'REJECT_NOVELTY' END AS batch_verdict FROM txn WHERE client <> 'D' GROUP BY client)
      SELECT m.client, mode, (SELECT count(*) FROM txn t WHERE label = 1 AND t.client = m.client) AS n_candidates,
        (SELECT count(*) FROM txn t WHERE label = 1 AND t.client = 'A' AND t.client = m.client) AS n_validated,
        round(f, 4) AS fidelity_score, round(n, 4) AS novelty_score, round(x, 4) AS mode_collapse_max, batch_verdict,
        CASE mode WHEN 'augment_ctgan' THEN 'Augment (CTGAN)' ELSE 'Schema (LLM)' END AS mode_label,
        CASE batch_verdict WHEN 'PASS' THEN 'Passed' WHEN 'REJECT_NOVELTY' THEN 'Rejected (novelty below floor)' ELSE '-' END AS verdict_label
      FROM m LEFT JOIN rep USING (client)""",
    "keyed_upsert": f"""WITH {DOCS} SELECT run_id, round, client, round(f1, 6) AS f1, cents FROM docs
      QUALIFY row_number() OVER (PARTITION BY run_id, round, client ORDER BY l_partkey DESC, l_suppkey DESC, cents DESC) = 1""",
    "run_finalize": f"""WITH {RUNS} SELECT run_id, arm, 'complete' AS status,
        round(CASE status WHEN 'running' THEN f1 + 1 ELSE f1 END, 6) AS f1,
        CASE status WHEN 'running' THEN '2030-01-01' ELSE created_at END AS updated_at
      FROM runs WHERE status <> 'failed'""",
    "run_registration": f"""WITH q AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'federated_real'
          WHEN 'MACHINERY' THEN 'no_such_arm' WHEN 'HOUSEHOLD' THEN 'isolated_augmented' END AS arm,
          CASE WHEN c_nationkey > 10 THEN c_nationkey ELSE 42 END AS seed,
          CASE WHEN c_nationkey < 5 THEN c_nationkey ELSE 20 END AS epochs, 10 AS num_rounds,
          CASE WHEN c_nationkey = 7 THEN 3 ELSE 2 END AS local_epochs FROM customer)
      SELECT *, CASE WHEN arm IN ('federated_real', 'isolated_augmented') THEN 'running' END AS status,
        CASE WHEN arm IS NULL THEN 'arm is required' WHEN arm = 'no_such_arm' THEN 'unknown arm' END AS error FROM q""",
    "arm_deltas": f"""WITH {RUNS}, {FULL}, m AS (SELECT split_part(arm, '_', 1) AS topology, split_part(arm, '_', 2) AS data, metric, v FROM ({LONG}))
      SELECT 'augmented - real' AS comparison, topology AS within, metric,
        round(max(v) FILTER (data = 'augmented') - max(v) FILTER (data = 'real'), 6) + 0.0 AS delta FROM m GROUP BY topology, metric
      UNION ALL SELECT 'federated - isolated', data, metric,
        round(max(v) FILTER (topology = 'federated') - max(v) FILTER (topology = 'isolated'), 6) + 0.0 FROM m GROUP BY data, metric""",
}
