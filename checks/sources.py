"""Source, sink and stored-run queries."""

from pyspark.sql import functions as F

from fedtab import fixtures as fx
from fedtab.functions import mlp
from fedtab.functions.common import new_path, pin_small, r
from fedtab.operators import prep
from fedtab.operators import profile as pf
from fedtab.operators import runs as rn
from fedtab.operators import scoring as sc
from fedtab.operators import train as tr
from fedtab.sources import files as fl
from fedtab.sources import store

from . import base as b
from . import gate as gate_checks
from .sampling import partitioned

S = fx.SPEC
TXN_COLS = [*fx.KEY, "client", *fx.FEATURES, "label"]


def ingest_checked_csv(spark, d):
    """Customers written as CSV with every row twice, then read by the checked scan."""
    path = new_path(spark, "raw")
    c = fx.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.col("c_nationkey").alias("label"))
    c.unionByName(c).write.option("header", True).csv(path)
    return fl.load_checked(spark, path, ["c_acctbal"], "label", "c_custkey bigint, c_name string").select(
        "c_custkey", "c_name", "c_acctbal", "label")


def ingest_audit(spark, d):
    docs = fx.table(spark, d, "documents").select(
        "text", F.when(F.col("lang") != "de", F.col("lang")).alias("lang"))
    return fl.ingest_audit(docs, F.coalesce(F.col("lang") == "en", F.lit(False)))


def client_partitioned_write(spark, d):
    path = new_path(spark, "by-client")
    rows = partitioned(spark, d).withColumn("client", F.coalesce("client", "split")).select(*TXN_COLS)
    fl.write_by_client(rows, path, S, seed=42)
    return fl.read_by_client(spark, path, rows.schema).groupBy("client").agg(
        F.count("*").alias("n"), F.sum("label").cast("bigint").alias("n_pos"), F.sum("l_orderkey").alias("key_sum"))


def client_positive_scan(spark, d):
    path = new_path(spark, "by-client")
    t = fx.txn(spark, d).select(*TXN_COLS)
    fl.write_by_client(t, path, S)
    return fl.read_by_client(spark, path, t.schema, client="B", where="label = 1").select(*TXN_COLS)


def validated_sink(spark, d):
    """Accepted rows of the gate through the sink: rejected clients have no rows and no partition."""
    path = new_path(spark, "validated")
    rows = gate_checks.accepted_rows(spark, d)
    fl.write_validated(rows, path)
    return fl.read_by_client(spark, path, rows.schema).select(*rows.columns)


def _summary(spark, d):
    return pf.shard_summary(fx.txn(spark, d), S, "l_extendedprice")


def json_report(spark, d):
    path = new_path(spark, "report")
    rep = _summary(spark, d)
    fl.write_json(rep, path)
    return fl.read_json(spark, path, rep.schema)


def markdown_report(spark, d):
    cols = [("Client", fl.text("client")), ("Rows", fl.text("n_rows")), ("Fraud rows", fl.text("n_fraud")),
            ("Legit rows", fl.text("n_legit")), ("Fraud rate", F.concat(fl.fmt4("fraud_rate_pct"), F.lit("%")))]
    return fl.markdown_table(_summary(spark, d), "Shard statistics", cols, ["client"])


def metric_log_append(spark, d):
    """Two appends of metric documents, read back."""
    path = new_path(spark, "log")
    ev = fx.table(spark, d, "events").select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), F.lit("federated_real").alias("arm"),
        F.when(F.col("event_type") != "signup", (F.col("event_id") % 10).cast("int")).alias("round"), F.lit("A").alias("client"),
        F.struct((F.col("value") / 100).alias("f1"), F.col("event_id").alias("n_samples")).alias("metrics"))
    fl.append_metrics(ev.filter("round IS NULL"), path)
    fl.append_metrics(ev.filter("round IS NOT NULL"), path)
    return fl.read_metrics(spark, path).groupBy("run_id").agg(
        F.count("*").alias("n_docs"), F.count("round").alias("n_numbered"), r(F.sum("metrics.f1")).alias("f1_sum"),
        F.sum("metrics.n_samples").alias("n_samples"))


def dataset_export(spark, d):
    cand = fx.candidates(spark, d)
    return fl.export_dataset({"candidates": cand}, "candidates", "A", fx.CLIENTS, new_path(spark, "export")).select(
        *fx.KEY, "client", "mode", *fx.FEATURES, "label")


def dataset_row_counts(spark, d):
    clients = spark.createDataFrame([(c,) for c in (*fx.CLIENTS, "E")], "client string")
    return rn.row_counts(clients, fx.candidates(spark, d), "n_candidates")


def stored_run(spark, d):
    """A federated run, an isolated and a centralized one in the artifact store, trained for the default number of epochs."""
    base = new_path(spark, "artifacts")
    t = fx.txn(spark, d)
    scalers = pin_small(prep.fit_scaler(t, S))
    shards = tr.pack_shards(prep.scale(t, scalers, S), S)
    trained = pin_small(tr.train_clients(shards, mlp.initial_weights(4, 42), 4, 20).select("client", "n", "w"))
    shared = pin_small(tr.weighted_average(trained.withColumn("client", F.lit("*")), ["client"]).select("client", "w"))
    names = sorted(fx.CLIENTS)
    for run_id, arm, w, s, cl in (("iso", "isolated_real", trained.select("client", "w"), scalers, names),
                                  ("fed", "federated_real", shared, scalers, names),
                                  ("cen", "centralized_real", shared, pin_small(prep.fit_scaler(t, S, pooled=True)), None)):
        store.save_artifact(w, base, "weights", run_id)
        store.save_artifact(s, base, "scalers", run_id)
        store.save_artifact(spark.createDataFrame([(arm, cl)], "arm string, clients array<string>"), base, "manifests", run_id)
    return {k: store.load_artifact(spark, base, k) for k in store.SCHEMAS}


def artifact_store(spark, d):
    """Scalers and weights after a round trip through the store."""
    run = stored_run(spark, d)
    n = run["weights"].groupBy("run_id").agg(F.count("*").alias("n_models"), F.max(F.size("w")).cast("bigint").alias("n_weights"))
    s = run["scalers"].groupBy("run_id").agg(F.count("*").alias("n_scalers"), F.sum("n").alias("n_rows"),
                                             r(F.sum(F.col("mean")[1]), 4).alias("price_means"))
    return n.join(s, "run_id").join(run["manifests"].select("run_id", "arm"), "run_id")


def scoring_manifest(spark, d):
    """Orders as stored runs: which need a client."""
    from .runs import runs
    m = runs(spark, d).select("run_id", "arm", F.when(~F.col("arm").startswith("centralized"),
                                                      F.array(F.lit("A"), F.lit("B"))).alias("clients"))
    return sc.scoring_manifest(m).select("run_id", "arm", "needs_client", F.array_join("clients", ",").alias("clients"))


def score_requests_table(spark, d):
    """One scoring request per transaction; some lack a run, a client or a feature."""
    t = fx.txn(spark, d)
    slot = F.pmod(F.col("l_orderkey"), F.lit(5))
    feats = F.map_from_arrays(F.array(*[F.lit(c) for c in fx.FEATURES]), F.array(*fx.FEATURES))
    return t.select(
        F.concat_ws("-", *fx.KEY, F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("request_id"),
        F.when(slot == 0, "iso").when(slot == 1, "fed").when(slot == 2, "cen").when(slot == 3, "fed").otherwise("gone").alias("run_id"),
        F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_linenumber") == 2, F.lit("Z"))
        .otherwise(F.col("client")).alias("client"),
        F.when(F.col("l_linenumber") == 3, F.map_filter(feats, lambda k, v: k != "l_tax")).otherwise(feats).alias("features"))


_MANIFEST = [("iso", "isolated_real", list(fx.CLIENTS)), ("fed", "federated_real", list(fx.CLIENTS)), ("cen", "centralized_real", None)]


def request_validation(spark, d):
    m = spark.createDataFrame(_MANIFEST, "run_id string, arm string, clients array<string>")
    return sc.check_requests(score_requests_table(spark, d), m, fx.FEATURES).select(
        "request_id", "run_id", "client", "arm", "error", "http_status")


def stored_run_scoring(spark, d):
    run = stored_run(spark, d)
    checked = sc.check_requests(score_requests_table(spark, d), run["manifests"], fx.FEATURES)
    return sc.score_requests(checked, run["weights"], run["scalers"], S).select(
        "request_id", "run_id", "client", "probability", "prediction")


def forward_logits(spark, d):
    """Raw logits of all transactions under their client's initial model."""
    t = fx.txn(spark, d)
    scaled = prep.scale(t, prep.fit_scaler(t, S), S)
    models = spark.createDataFrame([(c, [float(v) for v in mlp.initial_weights(4, i)]) for i, c in enumerate(fx.CLIENTS)],
                                   "client string, w array<double>")
    return tr.score(scaled, models, fx.FEATURES).select(*fx.KEY, "client", "logit")


QUERIES = {f.__name__: f for f in (
    ingest_checked_csv, ingest_audit, client_partitioned_write, client_positive_scan, validated_sink, json_report,
    markdown_report, metric_log_append, dataset_export, dataset_row_counts, artifact_store, scoring_manifest,
    request_validation, stored_run_scoring, forward_logits)}

from .runs import RUNS  # noqa: E402

_SUM = """SELECT client, count(*) AS n_rows, sum(label)::BIGINT AS n_fraud, (count(*) - sum(label))::BIGINT AS n_legit,
    round(100.0::DOUBLE * sum(label) / count(*), 4) AS fraud_rate_pct, round(avg(l_extendedprice), 2) AS amount_mean,
    round(stddev_samp(l_extendedprice), 2) AS amount_std FROM txn GROUP BY client"""
SQL = {
    "ingest_checked_csv": "SELECT c_custkey, c_name, c_acctbal, c_nationkey AS label FROM customer",
    "ingest_audit": """WITH t AS (SELECT text, CASE WHEN lang <> 'de' THEN lang END AS lang FROM documents)
        SELECT count(*) AS n_rows, count(*) FILTER (lang = 'en') AS n_pos,
          round(100.0::DOUBLE * count(*) FILTER (lang = 'en') / count(*), 4) AS pos_pct,
          count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS n_duplicates,
          count(*) FILTER (text IS NULL) AS null_text, count(*) FILTER (lang IS NULL) AS null_lang FROM t""",
    "client_partitioned_write": f"""WITH {b.partitioned()}, u AS (SELECT client, label, l_orderkey FROM shard UNION ALL
          SELECT 'holdout', label, l_orderkey FROM split WHERE split = 'holdout')
        SELECT client, count(*) AS n, sum(label)::BIGINT AS n_pos, sum(l_orderkey)::BIGINT AS key_sum FROM u GROUP BY client""",
    "client_positive_scan": f"WITH {b.POS} SELECT {', '.join(TXN_COLS)} FROM pos WHERE client = 'B'",
    "validated_sink": gate_checks.SQL["accepted_rows"],
    "json_report": f"WITH {b.TXN} {_SUM}",
    "markdown_report": f"""WITH {b.TXN}, s AS ({_SUM}) SELECT 0 AS line, '# Shard statistics' AS text UNION ALL SELECT 1, ''
        UNION ALL SELECT 2, '| Client | Rows | Fraud rows | Legit rows | Fraud rate |' UNION ALL SELECT 3, '|---|---|---|---|---|'
        UNION ALL SELECT (3 + row_number() OVER (ORDER BY client))::INTEGER, '| ' || concat_ws(' | ', client, n_rows, n_fraud, n_legit,
          printf('%.4f', fraud_rate_pct) || '%') || ' |' FROM s""",
    "metric_log_append": """SELECT 'run_' || user_id AS run_id, count(*) AS n_docs, count(*) FILTER (event_type <> 'signup') AS n_numbered,
        round(sum(value / 100), 6) AS f1_sum, sum(event_id)::BIGINT AS n_samples FROM events GROUP BY user_id""",
    "dataset_export": f"""WITH {b.CAND} SELECT {', '.join(fx.KEY)}, client, mode, {', '.join(fx.FEATURES)}, label FROM cand WHERE client = 'A'""",
    "dataset_row_counts": f"""WITH {b.CAND}, d(client) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E'))
        SELECT d.client, count(cand.client) AS n_candidates FROM d LEFT JOIN cand USING (client) GROUP BY d.client""",
    "artifact_store": f"""WITH {b.TXN}, c AS (SELECT client, count(*) AS n, avg(l_extendedprice) AS m FROM txn GROUP BY client),
          a(run_id, arm, n_models) AS (VALUES ('iso', 'isolated_real', 4::BIGINT), ('fed', 'federated_real', 1::BIGINT), ('cen', 'centralized_real', 1::BIGINT))
        SELECT run_id, arm, n_models, 2433::BIGINT AS n_weights, CASE run_id WHEN 'cen' THEN 1 ELSE (SELECT count(*) FROM c) END::BIGINT AS n_scalers,
          (SELECT count(*) FROM txn) AS n_rows,
          round(CASE run_id WHEN 'cen' THEN (SELECT avg(l_extendedprice) FROM txn) ELSE (SELECT sum(m) FROM c) END, 4) AS price_means FROM a""",
    "scoring_manifest": f"""WITH {RUNS} SELECT run_id, arm, arm LIKE 'isolated%' OR arm LIKE 'federated%' AS needs_client,
        CASE WHEN arm NOT LIKE 'centralized%' THEN 'A,B' END AS clients FROM runs""",
    "request_validation": f"""WITH {b.TXN}, q AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * 100)::BIGINT) AS request_id,
          CASE l_orderkey % 5 WHEN 0 THEN 'iso' WHEN 1 THEN 'fed' WHEN 2 THEN 'cen' WHEN 3 THEN 'fed' ELSE 'gone' END AS run_id,
          CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 'Z' ELSE client END AS client, l_linenumber AS ln FROM txn),
          e AS (SELECT *, CASE run_id WHEN 'iso' THEN 'isolated_real' WHEN 'fed' THEN 'federated_real' WHEN 'cen' THEN 'centralized_real' END AS arm FROM q),
          f AS (SELECT *, CASE WHEN arm IS NULL THEN 'no stored run' WHEN run_id <> 'cen' AND client IS NULL THEN 'client required'
            WHEN run_id <> 'cen' AND client = 'Z' THEN 'unknown client' WHEN ln = 3 THEN 'missing features: l_tax' END AS error FROM e)
        SELECT request_id, run_id, client, arm, error, CASE WHEN arm IS NULL THEN 404 WHEN error IS NOT NULL THEN 422 ELSE 200 END AS http_status FROM f""",
}
