"""Quantiles, running totals, AUC and KS against brute force, on awkward values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedtab.functions.prefix import quantiles, running_totals
from fedtab.operators import gate, metrics
from fedtab.spec import TableSpec

rng = np.random.default_rng(5)
VALUES = {
    "mixed": np.concatenate([rng.normal(size=400), np.zeros(50), -rng.exponential(1e6, 100), rng.exponential(1e-6, 100)]),
    "hot": np.concatenate([np.full(3000, 7.25), rng.normal(7.25, 1e-9, 500)]),   # one value and its near copies
    "single": np.array([-3.5]),
    "ties": rng.integers(-3, 4, 500).astype(float),
}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(g, float(v), i) for g, vs in VALUES.items() for i, v in enumerate(vs)],
                                 "g string, v double, i int")


def test_quantiles_equal_numpy(frame):
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {x["g"]: x["grid"] for x in quantiles(frame, ["g"], "v", probs).collect()}
    for g, vs in VALUES.items():
        np.testing.assert_allclose(got[g], np.quantile(vs, probs), rtol=1e-12, atol=0)


def test_running_totals_equal_sorting(frame):
    got = running_totals(frame.withColumn("n", F.lit(1)), ["g"], "v", ["n"]).toPandas()
    for g, vs in VALUES.items():
        u, c = np.unique(vs, return_counts=True)
        part = got[got.g == g].sort_values("v")
        assert part.v.tolist() == u.tolist() and part.cum_n.tolist() == np.cumsum(c).tolist()


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {x["g"]: x["m"] for x in quantiles(df, ["g"], "v", [0.5], ["m"]).collect()}
    assert got == {None: 2.0, "a": 5.0}


def brute_auc(y, s):
    p, q = s[y == 1], s[y == 0]
    return ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))


def test_auc_equals_all_pairs(spark):
    y = rng.integers(0, 2, 600)
    cases = {"smooth": rng.normal(size=600) + y, "ties": rng.integers(0, 5, 600).astype(float),
             "hot": np.where(rng.random(600) < .7, 0.25, 0.25 + rng.normal(size=600) * 1e-10)}
    df = spark.createDataFrame([(k, int(a), float(b)) for k, s in cases.items() for a, b in zip(y, s)], "g string, label int, s double")
    got = {x["g"]: x["auc"] for x in metrics.roc_auc(df, ["g"], "s").collect()}
    for k, s in cases.items():
        assert abs(got[k] - brute_auc(y, s)) < 1e-12


def test_metrics_edge_cases(spark):
    rows = ([("perfect", t, z) for t, z in ((1, 9.0), (0, -9.0), (1, 5.0), (0, -5.0))]
            + [("wrong", t, z) for t, z in ((1, -9.0), (0, 9.0))]
            + [("no_pred", t, z) for t, z in ((1, -1.0), (0, -2.0))]
            + [("one_class", 0, 1000.0), ("one_class", 0, -1000.0)])
    df = spark.createDataFrame(rows, "g string, label int, logit double")
    m = {x["g"]: x for x in metrics.evaluate(df, ["g"]).collect()}
    assert m["perfect"]["f1"] == m["perfect"]["auc"] == m["perfect"]["accuracy"] == 1.0
    assert m["wrong"]["f1"] == m["wrong"]["auc"] == 0.0
    assert m["no_pred"]["precision"] == m["no_pred"]["recall"] == 0.0
    assert np.isnan(m["one_class"]["auc"]) and m["one_class"]["n_fraud"] == 0
    macro = metrics.macro_average(metrics.evaluate(df, ["g"]).withColumn("r", F.lit(None).cast("int")), ["r"]).first()
    assert abs(macro["auc"] - np.mean([m[g]["auc"] for g in ("perfect", "wrong", "no_pred")])) < 1e-12
    assert macro["n_samples"] == 10 and macro["r"] is None


def test_ks_equals_brute_force(spark):
    spec = TableSpec(features=("x", "y"), key=())
    real = {"x": np.concatenate([np.zeros(200), rng.normal(size=300)]), "y": np.full(500, 3.0)}
    syn = {"x": np.concatenate([np.zeros(40), rng.normal(0.3, 1, 160)]), "y": np.concatenate([np.full(150, 3.0), 3 + rng.normal(size=50) * 1e-9])}
    r = spark.createDataFrame([("A", float(a), float(b)) for a, b in zip(real["x"], real["y"])], "client string, x double, y double")
    s = spark.createDataFrame([("A", "m", float(a), float(b)) for a, b in zip(syn["x"], syn["y"])], "client string, mode string, x double, y double")
    got = {x["column"]: x["score"] for x in gate.column_shape(r, s, spec).collect()}
    for c in ("x", "y"):
        grid = np.unique(np.concatenate([real[c], syn[c]]))
        ks = np.max(np.abs(np.searchsorted(np.sort(real[c]), grid, "right") / 500 - np.searchsorted(np.sort(syn[c]), grid, "right") / 200))
        assert abs(got[c] - (1 - ks)) < 1e-12


def test_ks_of_many_batches_shares_the_real_side(spark):
    """Many batches of a client against SciPy-free KS; the real rows are summed up before they meet a batch."""
    import numpy as np

    from fedtab.operators import gate
    from fedtab.spec import TableSpec
    rng = np.random.default_rng(6)
    spec = TableSpec(features=("v",), key=("id",))
    real = {c: np.round(rng.normal(100, 3, 400), 2) for c in ("A", None)}
    made = {(c, f"m{k}"): np.round(rng.normal(100 + k / 4, 3, 60), 2) for c in real for k in range(6)} | {("E", "m0"): np.ones(5)}
    r = spark.createDataFrame([(c, float(v)) for c, x in real.items() for v in x], "client string, v double")
    s = spark.createDataFrame([(c, m, float(v)) for (c, m), x in made.items() for v in x], "client string, mode string, v double")
    df = gate.column_shape(r, s, spec)
    got = {(x.client, x.mode): x.score for x in df.collect()}
    for (c, m), y in made.items():
        if c == "E":
            assert got[c, m] is None  # no real row to compare with
            continue
        at = np.union1d(real[c], y)
        gap = np.abs(np.searchsorted(np.sort(real[c]), at, "right") / len(real[c]) - np.searchsorted(np.sort(y), at, "right") / len(y)).max()
        assert abs(got[c, m] - (1 - gap)) < 1e-12
