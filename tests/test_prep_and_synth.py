import json
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedtab.operators import prep, profile, synth
from fedtab.spec import TableSpec

SPEC = TableSpec(features=("x", "y"), key=("id",))
rng = np.random.default_rng(1)


@pytest.fixture(scope="module")
def shard(spark):
    rows = [(i, "AB"[i % 2], float(rng.normal(50, 9)), 4.0, int(i % 11 == 0)) for i in range(220)]
    return spark.createDataFrame(rows, "id bigint, client string, x double, y double, label int")


def test_scaled_rows_have_zero_mean_and_unit_population_std(shard):
    out = prep.scale(shard, prep.fit_scaler(shard, SPEC), SPEC).toPandas()
    for _, g in out.groupby("client"):
        assert abs(g.x.mean()) < 1e-9 and abs(g.x.std(ddof=0) - 1) < 1e-9
        assert (g.y == 0).all()  # a constant column has scale 1


def test_scalers_see_training_rows_only(shard):
    a = prep.fit_scaler(shard.filter("id < 100"), SPEC).filter("client = 'A'").first()
    x = [r.x for r in shard.filter("id < 100 AND client = 'A'").collect()]
    assert abs(a["mean"][0] - np.mean(x)) < 1e-9 and abs(a["std"][0] - np.std(x)) < 1e-9


def test_pooled_scaler_is_one_row(shard):
    assert [r.client for r in prep.fit_scaler(shard, SPEC, pooled=True).collect()] == ["*"]


def test_holdout_is_repeated_per_client(shard):
    sc = prep.fit_scaler(shard, SPEC)
    out = prep.scale_for_every_client(shard, sc, SPEC)
    assert out.count() == 440 and {r["count"] for r in out.groupBy("client").count().collect()} == {220}


@pytest.mark.parametrize("n", [None, 0, 5])
def test_training_set_with_and_without_validated_rows(shard, n):
    extra = None if n is None else shard.limit(n).drop("id").withColumns({"id": F.monotonically_increasing_id(), "mode": F.lit("m")})
    out = prep.training_set(shard, extra, SPEC)
    assert out.count() == 220 + (n or 0) and out.select("row_key").distinct().count() == out.count()


def test_profile_of_one_row_has_zero_std_and_leaks_as_prototype(spark):
    one = spark.createDataFrame([(1, "A", 3.5, 2.0)], "id int, client string, x double, y double")
    prof = profile.column_profile(one, SPEC)
    assert {r["std"] for r in prof.collect()} == {0.0}
    assert synth.leaking_prototypes(profile.prototype_rows(prof, SPEC), one, SPEC).count() == 3


def test_constant_columns_have_no_correlation(shard):
    assert profile.top_correlations(shard, SPEC).count() == 0
    assert profile.correlations(shard, SPEC).filter("r IS NULL").count() == 2


# ---- responses ----------------------------------------------------------------------------
BODIES = {
    "plain": ('{"rows": [{"x": 1, "y": 2.5}, {"x": "3", "y": "4e1"}]}', [(1.0, 2.5), (3.0, 40.0)]),
    "fenced": ('```json\n{"rows": [{"x": 1, "y": 2}]}\n```', [(1.0, 2.0)]),
    "prose": ("no rows for you", []), "empty": ("", []), "wrong shape": ('{"rows": {"x": 1}}', []),
    "no rows": ('{"data": []}', []), "list": ('[{"x": 1, "y": 2}]', []),
    "mixed": ('{"rows": [1, "a", null, {"x": 1}, {"x": null, "y": 1}, {"x": [1], "y": 1}, {"x": "z", "y": 1}, {"x": 7, "y": 8, "q": 9}]}', [(7.0, 8.0)]),
    "bool": ('{"rows": [{"x": true, "y": 0}]}', [(1.0, 0.0)]),
    "not finite": ('{"rows": [{"x": "inf", "y": "1"}]}', [(float("inf"), 1.0)]),
    "cut off": ('{"rows": [{"x": 1, "y": 2}, {"x": ', []),
}


def test_tolerant_parsing(spark):
    df = spark.createDataFrame([(k, 0, 50, b) for k, (b, _) in BODIES.items()], "client string, request int, batch_n int, body string")
    got = {}
    for r in synth.parse_responses(df, SPEC).orderBy("client", "seq").collect():
        got.setdefault(r["client"], []).append((r["x"], r["y"]))
    for k, (_, want) in BODIES.items():
        assert got.get(k, []) == want, k


def test_bare_literals_parse_as_a_tolerant_reader_does(spark):
    """Random bodies with non-finite literals as values, in strings, escaped and where no value may stand."""
    rng = random.Random(8)
    atoms = ["NaN", "Infinity", "-Infinity", "1", "2.5", '"3"', '"NaN"', '"inf"', "null", '"a, NaN]"', '"\\\\"', '"\\", NaN"', "-NaN", "NaNx", "[NaN, Infinity]", '{"q":-Infinity}']
    bodies = ['{"rows": [NaN, {"x": NaN, "y": Infinity}]}', '{"rows": [], "NaN": NaN}', '{NaN: 1, "rows": [{"x": 1, "y": 2}]}', '{"rows": [{"x": 1, "y": NaN}]} "',
              '{"rows": [{"x": NaN\n , "y":\t-Infinity }]}', 'NaN', '[NaN]', '{"rows": NaN}', '{"rows": [{"x": 1, "y": 2}], "z": "NaN}']
    for _ in range(300):
        rows = ", ".join(rng.choice(['{"x": %s, "y": %s}' % (rng.choice(atoms), rng.choice(atoms)), rng.choice(atoms)]) for _ in range(rng.randrange(4)))
        bodies.append('{"rows": [%s]%s}' % (rows, rng.choice(["", ', "z": %s' % rng.choice(atoms)])))

    def plain(body):
        try:
            rows = json.loads(body)
        except ValueError:
            return []
        rows = rows.get("rows") if isinstance(rows, dict) else None
        out = []
        for row in rows if isinstance(rows, list) else []:
            try:
                out.append((float(row["x"]), float(row["y"])))
            except (TypeError, ValueError, KeyError):
                pass
        return out
    df = spark.createDataFrame([(str(i), 0, 50, b) for i, b in enumerate(bodies)], "client string, request int, batch_n int, body string")
    got = {}
    for r in synth.parse_responses(df, SPEC).orderBy("client", "seq").collect():
        got.setdefault(int(r["client"]), []).append((r["x"], r["y"]))
    for i, b in enumerate(bodies):
        assert str(got.get(i, [])) == str(plain(b)), b
    assert sum(map(len, got.values())) > 30


def test_requests_are_bounded_and_counted(spark):
    t = spark.createDataFrame([("C", 120), ("D", 50), ("E", 0)], "client string, n_target bigint")
    plan = synth.request_plan(t)
    assert sorted((r.client, r.batch_n, r.max_tokens) for r in plan.collect()) == [("C", 20, 3000), ("C", 50, 7500), ("C", 50, 7500), ("D", 50, 7500)]
    parsed = spark.createDataFrame([("C", 0, i) for i in range(60)], "client string, request bigint, seq int")
    m = {r["client"]: r for r in synth.malformed_counts(plan, parsed).collect()}
    assert m["C"]["n_malformed_rows_dropped"] == 70 and m["C"]["n_kept"] == 50 and m["D"]["n_kept"] == 0


def test_a_client_without_a_name_is_a_client(spark):
    """NULL clients meet their own rows in routing, counts and logs."""
    from fedtab.operators import runs
    clients = spark.createDataFrame([("A", 5), (None, 7)], "client string, n_pos int")
    modes = spark.createDataFrame([(None, "m"), ("B", "q")], "client string, mode string")
    got = {r.client: (r.mode, r.error) for r in synth.route_modes(clients, modes=modes).collect()}
    assert got == {"A": (None, "unknown client A"), None: ("m", None)}
    assert synth.route_modes(clients.filter("client IS NULL"), modes=modes.limit(0)).first().error == "unknown client NULL"
    rows = spark.createDataFrame([(None,), (None,), ("A",)], "client string")
    assert {r.client: r.n_rows for r in runs.row_counts(clients, rows).collect()} == {"A": 1, None: 2}
    requests = spark.createDataFrame([(None, 0, 3), ("A", 0, 2)], "client string, request int, batch_n int")
    parsed = spark.createDataFrame([(None, 0, 1), (None, 0, 2)], "client string, request int, seq int")
    assert {r.client: r.n_malformed_rows_dropped for r in synth.malformed_counts(requests, parsed).collect()} == {None: 1, "A": 2}
    targets = spark.createDataFrame([(None, "m", 1, 3)], "client string, mode string, n_pos int, n_target int")
    assert synth.generation_log(targets, rows).first().n_generated == 2
    reports = spark.createDataFrame([(None, "m", 0.5, 0.5, 0.5, "PASS")], "client string, mode string, fidelity_score double, novelty_score double, mode_collapse_max double, batch_verdict string")
    panel = runs.quality_panel(targets, rows, rows, reports).first()
    assert (panel.n_candidates, panel.n_validated, panel.fidelity_score) == (2, 2, 0.5)


# ---- generator ----------------------------------------------------------------------------

def test_normal_quantile_is_accurate():
    p = np.array([1e-6, 0.001, 0.02, 0.3, 0.5, 0.9, 0.999, 1 - 1e-6])
    np.testing.assert_allclose(synth.normal_quantile(p), [NormalDist().inv_cdf(x) for x in p], atol=1e-7)


def test_copula_keeps_range_counts_and_correlation(spark):
    z = rng.normal(size=(3000, 2)) @ np.array([[1, 0.8], [0, 0.6]])
    df = spark.createDataFrame([("A", float(np.exp(a)), float(b)) for a, b in z] + [("B", 1.0, 2.0)], "client string, x double, y double")
    model = synth.fit_copula(df, SPEC)
    t = spark.createDataFrame([("A", 25_000), ("B", 3)], "client string, n_target bigint")
    a = synth.sample_copula(model, t, SPEC, seed=9).toPandas()
    b = synth.sample_copula(model, t, SPEC, seed=9).toPandas()
    key = ["client", "id"]
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))
    g = a[a.client == "A"]
    assert len(g) == 25_000 and g.id.nunique() == 25_000 and (a.label == 1).all()
    assert g.x.between(np.exp(z[:, 0]).min(), np.exp(z[:, 0]).max()).all()
    assert abs(np.corrcoef(np.log(g.x), g.y)[0, 1] - np.corrcoef(z.T)[0, 1]) < 0.05
    assert (a[a.client == "B"][["x", "y"]] == [1.0, 2.0]).all().all()


def test_generating_without_a_fitted_client_fails(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0), ("A", 2.0, 1.0)], "client string, x double, y double")
    t = spark.createDataFrame([("Q", 3)], "client string, n_target bigint")
    with pytest.raises(Exception, match="no fitted model"):
        synth.sample_copula(synth.fit_copula(df, SPEC), t, SPEC).collect()


def test_routing(spark):
    n = spark.createDataFrame([("A", 300), ("C", 15), ("Q", 1)], "client string, n_pos int")
    dim = spark.createDataFrame([("A", "augment_ctgan"), ("C", "schema_llm")], "client string, mode string")
    got = {r["client"]: (r["mode"], r["error"]) for r in synth.route_modes(n, modes=dim).collect()}
    assert got == {"A": ("augment_ctgan", None), "C": ("schema_llm", None), "Q": (None, "unknown client Q")}
    assert [r["client"] for r in synth.route_modes(n, min_positives=20, only=["C"]).collect()] == ["C"]
