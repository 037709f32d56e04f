import numpy as np
import pytest
from pyspark.sql import functions as F

from fedtab.functions import comoments as cm
from fedtab.functions.common import new_path
from fedtab.operators import profile
from fedtab.operators import train as tr
from fedtab.plans import experiment as ex
from fedtab.spec import TableSpec


def table(rng, n, d, gaps):
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * rng.uniform(0.1, 50, d) + rng.uniform(-1e6, 1e6, d)
    known = rng.random((n, d)) > 0.1 if gaps else np.ones((n, d), bool)
    return x, known


@pytest.mark.parametrize("gaps", [False, True])
def test_merged_states_equal_whole_ones(gaps):
    rng = np.random.default_rng(4)
    x, known = table(rng, 500, 6, gaps)
    whole = cm.of_batch(x, known)
    total = cm.of_batch(x[:0], known[:0])
    for a in (0, 1, 2, 40, 41, 300):
        b = {0: 1, 1: 2, 2: 40, 40: 41, 41: 300, 300: 500}[a]
        total = cm.merge(total, cm.of_batch(x[a:b], known[a:b]))
    assert (whole[0] == total[0]).all() and np.allclose(whole[1], total[1], rtol=1e-12) and np.allclose(whole[2], total[2], rtol=1e-9, atol=1e-6)
    both = known[:, 0] & known[:, 3]
    cov = np.cov(x[both, 0], x[both, 3])
    assert np.isclose(whole[2][0, 3] / (whole[0][0, 3] - 1), cov[0, 1], rtol=1e-9)


def test_thirty_features_equal_the_pairwise_aggregates(spark):
    rng = np.random.default_rng(7)
    x, known = table(rng, 900, 30, True)
    cols = [f"v{i}" for i in range(30)]
    rows = [("AB"[i % 2] if i % 9 else None, *[float(v) if k else None for v, k in zip(r, m)]) for i, (r, m) in enumerate(zip(x, known))]
    rows += [("one", *[1.0] * 30), ("flat", *[2.0] * 30), ("flat", *[2.0] * 30)]
    df = spark.createDataFrame(rows, "client string, " + ", ".join(f"{c} double" for c in cols)).repartition(6)
    got = {(r.client, r.col_a, r.col_b): r.r for r in profile.correlations(df, TableSpec(features=tuple(cols), key=("client",))).collect()}
    assert len(got) == 5 * 435
    some = [(a, b) for a, b in zip(cols[::3], cols[1::3])]
    want = df.groupBy("client").agg(*[(F.covar_samp(a, b) / (F.stddev_samp(a) * F.stddev_samp(b))).alias(f"{a}_{b}") for a, b in some])
    for w in want.filter("coalesce(client, '') NOT IN ('one', 'flat')").collect():
        for a, b in some:
            assert abs(got[w.client, a, b] - w[f"{a}_{b}"]) < 1e-9
    assert all(v is None for (c, *_), v in got.items() if c in ("one", "flat"))
    plan = profile.correlations(df, TableSpec(features=tuple(cols), key=("client",)))._jdf.queryExecution().executedPlan().toString()
    assert "covar" not in plan


def test_no_rows_no_correlations(spark):
    df = spark.createDataFrame([], "client string, a double, b double")
    assert profile.correlations(df, TableSpec(features=("a", "b"), key=("client",))).count() == 0


# ---- rounds that go on --------------------------------------------------------------------

SPEC = TableSpec(features=("x", "y"), key=("id",))


def test_a_run_goes_on_after_its_last_round(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 2))
    rows = spark.createDataFrame([(i, "ABCD"[i % 4], float(a), float(b), int(a > 0.8)) for i, (a, b) in enumerate(x)],
                                 "id bigint, client string, x double, y double, label int")
    held, train = rows.filter("id < 200"), rows.filter("id >= 200")

    def run(log, rounds=3):
        res = ex.run_arms("federated_real", train, None, held, SPEC, log=log, rounds=rounds, local_epochs=1)["federated_real"]
        return res.weights.first()["w"], sorted(map(tuple, res.client_metrics.collect()), key=str)
    whole = run(new_path(spark, "log"))
    calls, log, real = [], new_path(spark, "log"), tr.train_clients

    def dies_in_the_third(*a, **k):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return real(*a, **k)
    monkeypatch.setattr(ex.tr, "train_clients", dies_in_the_third)
    with pytest.raises(KeyboardInterrupt):
        run(log)
    assert run(log) == whole and len(calls) == 4  # one round was left
    assert run(log) == whole and len(calls) == 4
    assert {r[0] for r in run(log, 2)[1]} and len(run(log, 2)[1]) == 8
    with pytest.raises(ValueError, match="another run"):
        ex.run_arms("federated_real", train, None, held, SPEC, log=log, rounds=3, local_epochs=2)
