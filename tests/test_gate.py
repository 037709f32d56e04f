import numpy as np
import pytest

from fedtab.functions import text as tx
from fedtab.operators import gate as g
from fedtab.operators import nearest, novelty, profile
from fedtab.spec import TableSpec, Thresholds

SPEC = TableSpec(features=("time", "amount"), key=())
rng = np.random.default_rng(0)


@pytest.fixture(scope="module")
def shard(spark):
    t, a = rng.uniform(1000, 170000, 50), rng.exponential(50, 50)
    return spark.createDataFrame([("A", float(x), float(y), 1) for x, y in zip(t, a)], "client string, time double, amount double, label int")


def check(spark, shard, rows):
    df = spark.createDataFrame([("A", "m", i, *x) for i, x in enumerate(rows)],
                               "client string, mode string, id int, time double, amount double, label int")
    out = g.check_rows(df, profile.range_bounds(shard, SPEC), SPEC)
    return [x["reasons"] for x in out.orderBy("id").collect()]


def test_bad_rows_do_not_sink_the_batch(spark, shard):
    got = check(spark, shard, [(2000.0, 10.0, 1), (170000.0 * 100, 10.0, 1), (2000.0, -999999.0, 1), (None, float("inf"), 0),
                               (float("nan"), 5.0, None)])
    assert got == [[], ["time:above_range"], ["amount:below_range"], ["time:null", "amount:not_finite", "label:not_one"],
                   ["time:not_finite", "label:null"]]


def test_empty_batch_keeps_its_schema(spark, shard):
    df = spark.createDataFrame([], "client string, mode string, time double, amount double, label int")
    rows, rep = g.run_gate(df, shard, SPEC)
    assert rows.count() == 0 and rep.count() == 0 and rows.columns == df.columns


def test_unknown_client_fails(spark, shard):
    df = spark.createDataFrame([("Z", "m", 2000.0, 1.0, 1)], "client string, mode string, time double, amount double, label int")
    out = g.check_rows(df, profile.range_bounds(shard, SPEC), SPEC).first()
    assert not out["passed"] and out["reasons"][0] == "time:no_bounds"


def test_constant_column_gets_a_span(spark):
    df = spark.createDataFrame([("A", 5.0, 1.0), ("A", 5.0, 2.0)], "client string, time double, amount double")
    b = {x["column"]: (x["lower"], x["upper"]) for x in profile.range_bounds(df, SPEC).collect()}
    assert b == {"time": (2.0, 8.0), "amount": (-2.0, 5.0)}


def test_thresholds_are_frozen():
    t = Thresholds()
    assert (t.fidelity_floor, t.novelty_floor, t.mode_collapse_ceiling, t.min_valid_rows) == (0.5, 0.95, 0.998, 5)
    with pytest.raises(Exception):
        t.novelty_floor = 0.1


def test_verdict_order(spark):
    rows = [("few", 4, None, None, None), ("fid", 5, 0.49, 0.1, 1.0), ("nov", 5, 0.5, 0.94, 1.0), ("col", 5, 0.5, 0.95, 0.9981),
            ("ok", 5, 0.5, 0.95, 0.998)]
    df = spark.createDataFrame(rows, "k string, n_schema_pass int, fidelity_score double, novelty_score double, mode_collapse_max double")
    got = {x["k"]: x["v"] for x in df.select("k", g.verdict().alias("v")).collect()}
    assert got == {"few": "REJECT_TOO_FEW_ROWS", "fid": "REJECT_FIDELITY", "nov": "REJECT_NOVELTY", "col": "REJECT_MODE_COLLAPSE", "ok": "PASS"}


def test_row_text_has_four_decimals(spark):
    df = spark.createDataFrame([(1.0, -0.12345)], "time double, amount double")
    assert df.select(tx.row_text(SPEC.features).alias("t")).first()[0] in ("time=1.0000, amount=-0.1235", "time=1.0000, amount=-0.1234")


# ---- nearest neighbours -------------------------------------------------------------------

def brute_nn(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return s.max(axis=1)


@pytest.mark.parametrize("block_rows", [8, 40, 5000])
def test_nearest_equals_brute_force(spark, block_rows):
    """Random directions, a dense cluster holding most rows, and exact copies."""
    far = rng.normal(size=(150, 6))
    dense = rng.normal(size=6) + rng.normal(size=(200, 6)) * 1e-3
    x = np.vstack([far, dense, dense[:5], far[:3]])
    other = rng.normal(size=(30, 6))
    rows = [("a", v.tolist()) for v in x] + [("b", v.tolist()) for v in other] + [("lone", [1.0] * 6)]
    df = spark.createDataFrame(rows, "batch string, vec array<double>")
    got = {r["batch"]: (r["mode_collapse_mean"], r["mode_collapse_max"]) for r in nearest.batch_similarity(df, ["batch"], "vec", block_rows).collect()}
    for k, v in (("a", x), ("b", other)):
        nn = brute_nn(v)
        np.testing.assert_allclose(got[k], (nn.mean(), nn.max()), atol=1e-9)
    assert got["lone"] == (0.0, 0.0)


# ---- novelty ------------------------------------------------------------------------------

def brute_matches(real, syn, tol=0.01):
    return (np.abs(real[None] - syn[:, None]) <= tol * np.abs(syn[:, None])).all(axis=2).any(axis=1)


@pytest.mark.parametrize("salt_rows,key_columns", [(5000, 3), (3, 1), (3, 2)])
def test_novelty_equals_brute_force(spark, monkeypatch, salt_rows, key_columns):
    """Zeros, negatives, a hot cell, and values just inside and outside the tolerance."""
    monkeypatch.setattr(novelty, "SALT_ROWS", salt_rows)
    real = np.column_stack([rng.choice([0.0, 5.0, -5.0, 1e-4], 300), rng.normal(100, 30, 300), rng.choice([0.0, 2.0], 300)])
    syn = np.vstack([real[:60] * 1.0099, real[60:120] * 0.9902, real[120:150] * 1.02, real[150:200] + [0, 0, 1e-9],
                     rng.normal(100, 30, (100, 3))])
    cols = "x double, y double, z double"
    r = spark.createDataFrame([("A", *map(float, v)) for v in real], f"client string, {cols}")
    s = spark.createDataFrame([("A", "m", *map(float, v)) for v in syn], f"client string, mode string, {cols}")
    got = novelty.novelty(r, s, ["x", "y", "z"], ["client"], ["client", "mode"], key_columns=key_columns).first()
    hit = brute_matches(real, syn)
    assert got["n_rows"] == len(syn) and got["n_matched"] == hit.sum()
    assert 0 < hit.sum() < len(syn)


def test_novelty_falls_with_injected_copies(spark):
    real = spark.createDataFrame([("A", float(v)) for v in rng.normal(size=100)], "client string, x double")
    syn = real.limit(25).unionByName(spark.createDataFrame([("A", 100.0 + i * 50) for i in range(75)], "client string, x double"))
    assert novelty.novelty(real, syn, ["x"], ["client"], ["client"]).first()["novelty_score"] == 0.75


def test_undefined_pairs_do_not_count(spark):
    real = spark.createDataFrame([("A", 1.0, 2.0), ("A", 2.0, 1.0), ("A", 3.0, 3.0)], "client string, time double, amount double")
    syn = spark.createDataFrame([("A", "m", 1.0, 5.0), ("A", "m", 2.0, 5.0)], "client string, mode string, time double, amount double")
    f = g.fidelity(real, syn, SPEC).first()
    assert f["pair_trends"] is None and f["fidelity_score"] == f["column_shapes"]


def test_vectors_that_do_not_cluster_are_not_copied_per_visit(spark, monkeypatch):
    """Where no block can be ruled out, a table still has at most a row a vector, not one for every block it looks at."""
    x = np.random.default_rng(5).normal(size=(600, 12))
    df = spark.createDataFrame([("a", v.tolist()) for v in x], "batch string, vec array<double>")
    counts, real = [], nearest.stage
    monkeypatch.setattr(nearest, "stage", lambda t: (kept := real(t), counts.append(kept.count()))[0])
    monkeypatch.setattr(nearest, "GROUP_ROWS", 100, raising=False)
    monkeypatch.setattr(nearest, "PART_BLOCKS", 7, raising=False)
    got = {r["vid"]: r["best"] for r in nearest.nearest_cosine(df, ["batch"], "vec", 30).collect()}
    np.testing.assert_allclose(sorted(got.values()), sorted(brute_nn(x)), atol=1e-12)
    assert len(got) == 600 and max(counts) <= 600
