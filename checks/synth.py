"""Synthetic-generation queries."""

from pyspark.sql import functions as F

from fedtab import fixtures as fx
from fedtab.functions.common import literal_table, pin_small, r
from fedtab.operators import profile as pf
from fedtab.operators import sampling as sm
from fedtab.operators import synth as sy
from fedtab.spec import TableSpec

from . import base as b

S = fx.SPEC
RESPONSE_SPEC = TableSpec(features=("amount", "k"), key=("id",))
MODES = [("A", "augment_ctgan"), ("B", "augment_ctgan"), ("C", "schema_llm"), ("D", "schema_llm")]


def targets(spark, d, ratio=1.0):
    return sm.synthetic_targets(fx.positives(spark, d).groupBy("client").agg(F.count("*").alias("n_pos")), ratio)


def copula_generation(spark, d):
    """Generated rows summarized: exact counts, and every value inside the client's real range."""
    pos = fx.positives(spark, d)
    gen = sy.sample_copula(sy.fit_copula(pos, S), targets(spark, d, 2.0), S, seed=42)
    lim = pf.range_bounds(pos, S, slack=0.0)
    checked = gen.unpivot(["client", "id"], list(S.features), "column", "v").join(pin_small(lim), ["client", "column"])
    return checked.groupBy("client", "column").agg(
        F.count("*").alias("n"), F.count_if((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))).alias("outside"))


def copula_rows(spark, d):
    pos = fx.positives(spark, d)
    return sy.sample_copula(sy.fit_copula(pos, S), targets(spark, d), S, seed=42)


def mode_routing(spark, d):
    n = fx.txn(spark, d).groupBy("client").agg(F.sum("label").cast("bigint").alias("n_pos"))
    known = literal_table(spark, MODES[:3], "client string, mode string")
    by_dim = sy.route_modes(n, modes=known).withColumn("how", F.lit("dimension"))
    by_size = sy.route_modes(n, min_positives=190).withColumn("how", F.lit("size"))
    return by_dim.unionByName(by_size)


def request_plan(spark, d):
    return sy.request_plan(targets(spark, d, 1.5))


def prompt_dataset(spark, d):
    p = _prompts(spark, d)
    stats = F.from_json("stats", "map<string,struct<mean:double,q50:double,max:double>>")
    proto = F.from_json("prototypes", "map<string,map<string,double>>")
    return p.select("client", "request", "batch_n", "max_tokens",
                    stats["l_tax"]["mean"].alias("tax_mean"), stats["l_quantity"]["q50"].alias("quantity_q50"),
                    proto["high_tail"]["l_extendedprice"].alias("price_high"),
                    F.get_json_object("correlations", "$[0].r").cast("double").alias("top_r"),
                    F.col("system").contains(F.concat(F.lit("exactly "), F.col("batch_n"))).alias("asks_batch"))


def _prompts(spark, d):
    pos = fx.positives(spark, d)
    prof = pf.column_profile(pos, S)
    return sy.prompt_dataset(sy.request_plan(targets(spark, d)), prof, pf.top_correlations(pos, S, 5),
                             pf.prototype_rows(prof, S), S)


def prompt_privacy_check(spark, d):
    """Every transaction as a group of its own order line: single-row groups leak their row."""
    t = fx.txn(spark, d).filter("label = 1").withColumn(
        "client", F.concat_ws("/", "client", F.col("l_quantity").cast("int"), F.col("l_discount").cast("string")))
    prof = pf.column_profile(t, S)
    leak = sy.leaking_prototypes(pf.prototype_rows(prof, S), t, S)
    return leak.groupBy("client").agg(F.count("*").alias("n_leaking"))


def responses(spark, d):
    """Service responses built from events: one body per user, hour of stream and quality."""
    ev = fx.table(spark, d, "events")
    row = (F.when(F.col("event_type") == "error", F.concat(F.lit('{"amount": "'), F.col("value").cast("string"), F.lit('", "k": '),
                                                         F.regexp_extract("props", r"(\d+)", 1), F.lit("}")))
           .when(F.col("event_type") == "signup", F.lit('"not an object"'))
           .when(F.col("event_type") == "view", F.concat(F.lit('{"amount": '), F.col("value").cast("string"), F.lit("}")))
           .otherwise(F.concat(F.lit('{"amount": '), F.col("value").cast("string"), F.lit(', "k": '),
                               F.regexp_extract("props", r"(\d+)", 1), F.lit("}"))))
    group = F.floor(F.col("event_id") / 20)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", row.alias("row")))), lambda x: x["row"]), ",")
    kind = F.col("request") % 5
    return (ev.groupBy(group.alias("request")).agg(body.alias("rows"))
            .select(F.when(F.col("request") % 2 == 0, "C").otherwise("D").alias("client"), "request",
                    F.lit(12).cast("bigint").alias("batch_n"),
                    F.when(kind == 3, F.lit("Sorry, no rows today."))
                    .when(kind == 4, F.concat(F.lit("```json\n{\"rows\": ["), F.col("rows"), F.lit("]}\n```")))
                    .when(kind == 2, F.concat(F.lit('{"data": ['), F.col("rows"), F.lit("]}")))
                    .otherwise(F.concat(F.lit('{"rows": ['), F.col("rows"), F.lit("]}"))).alias("body")))


def parsed_responses(spark, d):
    return sy.parse_responses(responses(spark, d), RESPONSE_SPEC).select(
        "client", "request", "batch_n", "seq", "amount", "k")


def batch_truncation(spark, d):
    p = sy.parse_responses(responses(spark, d), RESPONSE_SPEC)
    return sy.take_batch(p).groupBy("client").agg(
        F.count("*").alias("n_rows"), r(F.sum("amount"), 4).alias("amount_sum"), r(F.sum("k"), 4).alias("k_sum"))


def malformed_counts(spark, d):
    resp = responses(spark, d)
    return sy.malformed_counts(resp.select("client", "request", "batch_n"), sy.parse_responses(resp, RESPONSE_SPEC))


def generation_log(spark, d):
    t = targets(spark, d).join(literal_table(spark, MODES, "client string, mode string"), "client")
    resp = responses(spark, d)
    parsed = sy.parse_responses(resp, RESPONSE_SPEC)
    counts = sy.malformed_counts(resp.select("client", "request", "batch_n"), parsed)
    made = (sy.take_batch(parsed).select("client")
            .unionByName(fx.candidates(spark, d).filter("client = 'A'").select("client")))
    return sy.generation_log(t, made, counts, "tabular-v1")


QUERIES = {f.__name__: f for f in (
    copula_generation, copula_rows, mode_routing, request_plan, prompt_dataset, prompt_privacy_check,
    parsed_responses, batch_truncation, malformed_counts, generation_log)}

PARSED = """ev AS (SELECT event_id // 20 AS request, event_id, event_type, value,
    regexp_extract(props, '(\\d+)', 1)::DOUBLE AS k FROM events),
  resp AS (SELECT DISTINCT CASE WHEN request % 2 = 0 THEN 'C' ELSE 'D' END AS client, request, 12::BIGINT AS batch_n FROM ev),
  parsed AS (SELECT client, request, batch_n, row_number() OVER (PARTITION BY request ORDER BY event_id) AS seq,
      value AS amount, k FROM ev JOIN resp USING (request)
    WHERE request % 5 IN (0, 1, 4) AND event_type NOT IN ('signup', 'view')),
  bad AS (SELECT client, count(*) AS n_requests, sum(batch_n)::BIGINT AS n_asked, sum(least(batch_n, n))::BIGINT AS n_kept,
      sum(greatest(0, batch_n - n))::BIGINT AS n_malformed_rows_dropped
    FROM (SELECT r.client, r.request, r.batch_n, count(p.seq) AS n FROM resp r LEFT JOIN parsed p USING (request) GROUP BY ALL)
    GROUP BY client)"""
TGT = b.POS + """, tgt AS (SELECT client, count(*) AS n_pos, greatest(1, round_even(count(*) * 1.0::DOUBLE, 0))::BIGINT AS n_target
    FROM pos GROUP BY client)"""
from .profile import corr_sql  # noqa: E402

SQL = {
    "copula_generation": f"""WITH {TGT}, c("column") AS (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax'))
      SELECT client, "column", greatest(1, round_even(n_pos * 2.0::DOUBLE, 0))::BIGINT AS n, 0::BIGINT AS outside FROM tgt, c""",
    "mode_routing": f"""WITH {b.TXN}, n AS (SELECT client, sum(label)::BIGINT AS n_pos FROM txn GROUP BY client)
      SELECT client, n_pos, CASE WHEN client IN ('A', 'B') THEN 'augment_ctgan' WHEN client = 'C' THEN 'schema_llm' END AS mode,
        CASE WHEN client = 'D' THEN 'unknown client D' END AS error, 'dimension' AS how FROM n UNION ALL
      SELECT client, n_pos, CASE WHEN n_pos >= 190 THEN 'augment_ctgan' ELSE 'schema_llm' END, NULL, 'size' FROM n""",
    "request_plan": f"""WITH {b.POS}, t AS (SELECT client, greatest(1, round_even(count(*) * 1.5::DOUBLE, 0))::BIGINT AS n FROM pos GROUP BY client),
      x AS (SELECT client, n, unnest(range(0, (ceil(n / 50.0))::BIGINT)) AS request FROM t)
      SELECT client, request, least(50, n - 50 * request)::BIGINT AS batch_n, (least(50, n - 50 * request) * 150)::BIGINT AS max_tokens FROM x""",
    "prompt_dataset": f"""WITH {TGT}, x AS (SELECT client, n_target AS n, unnest(range(0, (ceil(n_target / 50.0))::BIGINT)) AS request FROM tgt),
      c AS ({corr_sql('pos')}), top AS (SELECT client, round(r, 4) + 0.0 AS r FROM c WHERE NOT isnan(r)
        QUALIFY row_number() OVER (PARTITION BY client ORDER BY abs(round(r, 4)) DESC, pair) = 1),
      a AS (SELECT client, round(avg(l_tax), 4) AS tax_mean, round(quantile_cont(l_quantity, 0.5), 4) AS quantity_q50,
              round(quantile_cont(l_extendedprice, 0.75), 4) AS price_high FROM pos GROUP BY client)
      SELECT client, request, least(50, n - 50 * request)::BIGINT AS batch_n, (least(50, n - 50 * request) * 150)::BIGINT AS max_tokens,
        tax_mean, quantity_q50, price_high, r AS top_r, true AS asks_batch
      FROM x JOIN a USING (client) JOIN top USING (client)""",
    "parsed_responses": f"WITH {PARSED} SELECT client, request, batch_n, seq, amount, k FROM parsed",
    "batch_truncation": f"""WITH {PARSED} SELECT client, count(*) AS n_rows, round(sum(amount), 4) AS amount_sum,
        round(sum(k), 4) AS k_sum FROM parsed WHERE seq <= batch_n GROUP BY client""",
    "malformed_counts": f"WITH {PARSED} SELECT * FROM bad",
    "generation_log": f"""WITH {TGT}, {PARSED}, made AS (SELECT client FROM parsed WHERE seq <= batch_n UNION ALL
          SELECT client FROM pos WHERE client = 'A' UNION ALL SELECT client FROM pos WHERE client = 'A'),
        m(client, mode) AS (VALUES ('A','augment_ctgan'),('B','augment_ctgan'),('C','schema_llm'),('D','schema_llm'))
      SELECT t.client, mode, n_pos AS n_real_fraud_used, n_target AS n_requested,
        (SELECT count(*) FROM made WHERE made.client = t.client) AS n_generated, n_requests, n_malformed_rows_dropped,
        CASE mode WHEN 'schema_llm' THEN 'tabular-v1' END AS model
      FROM tgt t JOIN m ON t.client = m.client LEFT JOIN bad ON bad.client = t.client""",
    "prompt_privacy_check": f"""WITH {b.POS}, t AS (SELECT * REPLACE (client || '/' || l_quantity::INTEGER || '/' || l_discount::VARCHAR AS client) FROM pos),
      p AS (SELECT client, {', '.join(f'round(quantile_cont({c}, {q}), 4) AS {c}_{i}' for c in fx.FEATURES for i, q in enumerate((0.5, 0.25, 0.75)))} FROM t GROUP BY client),
      l AS ({' UNION ALL '.join(f"SELECT client, {i} AS kind, {', '.join(f'{c}_{i} AS {c}' for c in fx.FEATURES)} FROM p" for i in range(3))})
      SELECT client, count(*) AS n_leaking FROM l WHERE EXISTS (SELECT 1 FROM t WHERE t.client = l.client
        AND {' AND '.join(f'round(t.{c}, 4) = l.{c}' for c in fx.FEATURES)}) GROUP BY client""",
}
