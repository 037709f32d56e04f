"""Validation-gate queries on candidates that reach every verdict."""

from pyspark.sql import functions as F

from fedtab import fixtures as fx
from fedtab.functions import text as tx
from fedtab.functions.common import r
from fedtab.operators import gate as g
from fedtab.operators import nearest, profile
from fedtab.operators.novelty import novelty as novelty_score

from . import base as b

S = fx.SPEC


def checked(spark, d):
    return g.check_rows(fx.candidates(spark, d), profile.range_bounds(fx.txn(spark, d), S), S)


def passing(spark, d):
    return checked(spark, d).filter("passed")


def schema_gate(spark, d):
    return checked(spark, d).select(*fx.KEY, "client", "mode", "passed",
                                    F.concat_ws(";", "reasons").alias("reasons"))


def first_failure_reason(spark, d):
    return g.first_reason(checked(spark, d)).select(*fx.KEY, "client", "mode", "reason")


def rejection_stats(spark, d):
    return g.rejection_stats(checked(spark, d))


def column_shape_fidelity(spark, d):
    return g.column_shape(fx.positives(spark, d), passing(spark, d), S).withColumn("score", r("score"))


def pair_fidelity(spark, d):
    return g.pair_trends(fx.positives(spark, d), passing(spark, d), S).select(
        "client", "mode", "col_a", "col_b", r("score").alias("score"))


def overall_fidelity(spark, d):
    f = g.fidelity(fx.positives(spark, d), passing(spark, d), S)
    return f.select("client", "mode", *[r(c).alias(c) for c in ("column_shapes", "pair_trends", "fidelity_score")])


def novelty(spark, d):
    n = novelty_score(fx.positives(spark, d), passing(spark, d), S.features, ["client"], ["client", "mode"])
    return n.withColumn("novelty_score", r("novelty_score"))


def novelty_all_rows(spark, d):
    """Negatives against positives of the same client: a large synthetic side."""
    t = fx.txn(spark, d)
    n = novelty_score(t.filter("label = 1"), t.filter("label = 0"), S.features, ["client"], ["client"])
    return n.withColumn("novelty_score", r("novelty_score"))


def row_text(spark, d):
    return passing(spark, d).select(*fx.KEY, "client", "mode", tx.row_text(S.features).alias("text"))


def row_embedding(spark, d):
    v = tx.embed_rows(passing(spark, d), S.features, [*fx.KEY, "mode"])
    return v.select(*fx.KEY, "mode", F.posexplode("vec").alias("pos", "v")).filter("v > 0").select(
        *fx.KEY, "mode", "pos", r("v").alias("v"))


def nearest_similarity(spark, d):
    """Nearest-neighbour cosine inside each label of the embeddings table."""
    e = fx.table(spark, d, "embeddings").select("label", F.col("embedding").alias("vec"))
    out = nearest.batch_similarity(e, ["label"])
    return out.select("label", r("mode_collapse_mean", 5).alias("mean_sim"), r("mode_collapse_max", 5).alias("max_sim"))


def batch_similarity(spark, d):
    v = tx.embed_rows(passing(spark, d), S.features, ["client", "mode"])
    out = nearest.batch_similarity(v, ["client", "mode"])
    return out.select("client", "mode", r("mode_collapse_mean").alias("mode_collapse_mean"),
                      r("mode_collapse_max").alias("mode_collapse_max"))


def _report(spark, d):
    return g.run_gate(fx.candidates(spark, d), fx.txn(spark, d), S)


def gate_verdict(spark, d):
    return _report(spark, d)[1].select("client", "mode", "batch_verdict")


def validation_report(spark, d):
    rep = _report(spark, d)[1]
    return rep.select("client", "mode", "n_candidates", "n_schema_pass", "n_schema_errors", "batch_verdict",
                      *[r(c).alias(c) for c in ("fidelity_score", "novelty_score", "mode_collapse_mean",
                                                "mode_collapse_max")], "n_validated_rows")


def accepted_rows(spark, d):
    return _report(spark, d)[0].select(*fx.KEY, "client", "mode", *fx.FEATURES, "label")


QUERIES = {f.__name__: f for f in (
    schema_gate, first_failure_reason, rejection_stats, column_shape_fidelity, pair_fidelity, overall_fidelity,
    novelty, novelty_all_rows, row_text, row_embedding, nearest_similarity, batch_similarity, gate_verdict,
    validation_report, accepted_rows)}

_BOUND = ", ".join(
    f"min({c}) - 3 * CASE WHEN max({c}) > min({c}) THEN max({c}) - min({c}) ELSE 1 END AS lo_{c}, "
    f"max({c}) + 3 * CASE WHEN max({c}) > min({c}) THEN max({c}) - min({c}) ELSE 1 END AS hi_{c}" for c in fx.FEATURES)
_RULES = ", ".join(
    f"CASE WHEN {c} IS NULL THEN '{c}:null' WHEN isnan({c}) OR isinf({c}) THEN '{c}:not_finite' "
    f"WHEN {c} < lo_{c} THEN '{c}:below_range' WHEN {c} > hi_{c} THEN '{c}:above_range' END" for c in fx.FEATURES)
CHECKED = b.CAND + f""", bound AS (SELECT client, {_BOUND} FROM txn GROUP BY client),
  chk0 AS (SELECT cand.*, concat_ws(';', {_RULES}, CASE WHEN label <> 1 THEN 'label:not_one' END) AS reasons
           FROM cand JOIN bound USING (client)),
  chk AS (SELECT *, reasons = '' AS passed FROM chk0), ok AS (SELECT * FROM chk WHERE passed)"""
KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_SIDE = """bt AS (SELECT DISTINCT client, mode FROM ok),
  sides AS (SELECT client, mode, 0 AS side, l_quantity, l_extendedprice, l_discount, l_tax FROM pos JOIN bt USING (client)
            UNION ALL SELECT client, mode, 1, l_quantity, l_extendedprice, l_discount, l_tax FROM ok)"""
_SHAPE = " UNION ALL ".join(f"""SELECT client, mode, '{c}' AS "column", 1 - max(abs(fa - fb)) AS score FROM (
    SELECT client, mode, {c} AS v, sum(count(*) FILTER (side = 0)) OVER (PARTITION BY client, mode ORDER BY {c})
             / sum(count(*) FILTER (side = 0)) OVER (PARTITION BY client, mode)::DOUBLE AS fa,
           sum(count(*) FILTER (side = 1)) OVER (PARTITION BY client, mode ORDER BY {c})
             / sum(count(*) FILTER (side = 1)) OVER (PARTITION BY client, mode)::DOUBLE AS fb
    FROM sides GROUP BY client, mode, {c}) GROUP BY client, mode""" for c in fx.FEATURES)
_PAIR = " UNION ALL ".join(f"""SELECT client, mode, '{x}' AS col_a, '{y}' AS col_b, 1 - abs(a - b) / 2 AS score FROM (
    SELECT client, mode, max(rr) FILTER (side = 0) AS a, max(rr) FILTER (side = 1) AS b FROM (
      SELECT client, mode, side, CASE WHEN coalesce(stddev_samp({x}), 0) = 0 OR coalesce(stddev_samp({y}), 0) = 0 THEN NULL ELSE corr({x}, {y}) END AS rr
      FROM sides GROUP BY client, mode, side) GROUP BY client, mode)"""
    for i, x in enumerate(fx.FEATURES) for y in fx.FEATURES[i + 1:])
FIDELITY = f"""{_SIDE}, shape AS ({_SHAPE}), pair AS ({_PAIR}),
  fid AS (SELECT client, mode, s AS column_shapes, p AS pair_trends,
            CASE WHEN p IS NULL THEN s ELSE (s + p) / 2 END AS fidelity_score
          FROM (SELECT client, mode, avg(score) AS s FROM shape GROUP BY ALL)
          LEFT JOIN (SELECT client, mode, avg(score) AS p FROM pair GROUP BY ALL) USING (client, mode))"""


def _match(a, z):
    return " AND ".join(f"abs({z}.{c} - {a}.{c}) <= 0.01 * abs({a}.{c})" for c in fx.FEATURES)


NOVELTY = f"""nov AS (SELECT client, mode, count(*) AS n_rows, count(*) FILTER (hit) AS n_matched FROM (
    SELECT o.client, o.mode, EXISTS (SELECT 1 FROM pos p WHERE p.client = o.client AND {_match('o', 'p')}) AS hit
    FROM ok o) GROUP BY ALL)"""
TEXT = "concat_ws(', ', " + ", ".join(f"printf('{c}=%.4f', {c})" for c in fx.FEATURES) + ")"
EMBED = f"""txt AS (SELECT {KEYS}, client, mode, {TEXT} AS t FROM ok),
  gram AS (SELECT *, unnest(range(1, length(t) - 1)) AS i FROM txt),
  code AS (SELECT {KEYS}, client, mode, (ascii(t[i]) * 961 + ascii(t[i + 1]) * 31 + ascii(t[i + 2])) % 256 AS pos FROM gram),
  cnt AS (SELECT {KEYS}, client, mode, pos::INTEGER AS pos, count(*) AS c FROM code GROUP BY ALL),
  emb AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY {KEYS}, client, mode)) AS v FROM cnt)"""
SIM = f"""{EMBED}, rid AS (SELECT *, dense_rank() OVER (ORDER BY client, mode, {KEYS}) AS rid FROM emb),
  dot AS (SELECT x.client, x.mode, x.rid AS i, y.rid AS j, sum(x.v * y.v) AS s FROM rid x JOIN rid y
          ON x.client = y.client AND x.mode = y.mode AND x.pos = y.pos AND x.rid <> y.rid GROUP BY ALL),
  nn AS (SELECT client, mode, i, max(s) AS best FROM dot GROUP BY ALL),
  sim AS (SELECT client, mode, avg(best) AS mode_collapse_mean, max(best) AS mode_collapse_max FROM nn GROUP BY ALL)"""
REPORT = f"""{CHECKED}, {FIDELITY}, {NOVELTY}, {SIM},
  n AS (SELECT client, mode, count(*) AS n_candidates, count(*) FILTER (passed) AS n_schema_pass,
        count(*) FILTER (NOT passed) AS n_schema_errors FROM chk GROUP BY ALL),
  rep AS (SELECT client, mode, n_candidates, n_schema_pass, n_schema_errors,
      CASE WHEN n_schema_pass < 5 THEN 'REJECT_TOO_FEW_ROWS' WHEN fidelity_score < 0.5 THEN 'REJECT_FIDELITY'
           WHEN 1 - n_matched / n_rows < 0.95 THEN 'REJECT_NOVELTY' WHEN mode_collapse_max > 0.998 THEN 'REJECT_MODE_COLLAPSE'
           ELSE 'PASS' END AS batch_verdict,
      CASE WHEN n_schema_pass >= 5 THEN round(fidelity_score, 6) END AS fidelity_score,
      CASE WHEN n_schema_pass >= 5 THEN round(1 - n_matched / n_rows, 6) END AS novelty_score,
      round(mode_collapse_mean, 6) AS mode_collapse_mean, round(mode_collapse_max, 6) AS mode_collapse_max
    FROM n LEFT JOIN fid USING (client, mode) LEFT JOIN nov USING (client, mode) LEFT JOIN sim USING (client, mode))"""

SQL = {
    "schema_gate": f"WITH {CHECKED} SELECT {KEYS}, client, mode, passed, reasons FROM chk",
    "first_failure_reason": f"WITH {CHECKED} SELECT {KEYS}, client, mode, split_part(reasons, ';', 1) AS reason FROM chk WHERE NOT passed",
    "rejection_stats": f"""WITH {CHECKED} SELECT client, mode, split_part(reasons, ';', 1) AS reason, count(*) AS n
        FROM chk WHERE NOT passed GROUP BY ALL""",
    "column_shape_fidelity": f"""WITH {CHECKED}, {FIDELITY} SELECT client, mode, "column", round(score, 6) + 0.0 AS score FROM shape""",
    "pair_fidelity": f"WITH {CHECKED}, {FIDELITY} SELECT client, mode, col_a, col_b, round(score, 6) + 0.0 AS score FROM pair",
    "overall_fidelity": f"""WITH {CHECKED}, {FIDELITY} SELECT client, mode, round(column_shapes, 6) + 0.0 AS column_shapes,
        round(pair_trends, 6) + 0.0 AS pair_trends, round(fidelity_score, 6) + 0.0 AS fidelity_score FROM fid""",
    "novelty": f"""WITH {CHECKED}, {NOVELTY} SELECT client, mode, n_rows, n_matched,
        round(1 - n_matched / n_rows, 6) + 0.0 AS novelty_score FROM nov""",
    "novelty_all_rows": f"""WITH {b.POS}, h AS (SELECT o.client, EXISTS (SELECT 1 FROM pos p WHERE p.client = o.client
          AND {_match('o', 'p')}) AS hit FROM txn o WHERE label = 0)
        SELECT client, count(*) AS n_rows, count(*) FILTER (hit) AS n_matched,
          round(1 - count(*) FILTER (hit) / count(*), 6) + 0.0 AS novelty_score FROM h GROUP BY client""",
    "row_text": f"WITH {CHECKED} SELECT {KEYS}, client, mode, {TEXT} AS text FROM ok",
    "row_embedding": f"WITH {CHECKED}, {EMBED} SELECT {KEYS}, mode, pos, round(v, 6) AS v FROM emb",
    "nearest_similarity": """WITH p AS (SELECT a.label, a.vec_id, max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
            / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS best
          FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL)
        SELECT label, round(avg(best), 5) AS mean_sim, round(max(best), 5) AS max_sim FROM p GROUP BY label""",
    "batch_similarity": f"""WITH {CHECKED}, {SIM} SELECT client, mode, round(coalesce(mode_collapse_mean, 0), 6) AS mode_collapse_mean,
        round(coalesce(mode_collapse_max, 0), 6) AS mode_collapse_max
      FROM (SELECT DISTINCT client, mode FROM ok) LEFT JOIN sim USING (client, mode)""",
    "gate_verdict": f"WITH {REPORT} SELECT client, mode, batch_verdict FROM rep",
    "validation_report": f"""WITH {REPORT} SELECT *, CASE batch_verdict WHEN 'PASS' THEN n_schema_pass ELSE 0 END AS n_validated_rows FROM rep""",
    "accepted_rows": f"""WITH {REPORT} SELECT {KEYS}, client, mode, l_quantity, l_extendedprice, l_discount, l_tax, label
        FROM ok JOIN rep USING (client, mode) WHERE batch_verdict = 'PASS'""",
}
