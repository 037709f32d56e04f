import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fedtab.functions.common import fetch_small
from fedtab.operators import sampling as sm
from fedtab.spec import PartitionPlan, TableSpec

SPEC = TableSpec(features=("v",), key=("id",))
PLAN = PartitionPlan()


@pytest.fixture(scope="module")
def pool(spark):
    """2,000 negatives and 200 positives."""
    return spark.range(2200).select("id", (F.col("id") * 0.5).alias("v"), (F.col("id") < 200).cast("int").alias("label"))


def shards(pool, seed=42, cap=15):
    plan = PartitionPlan(seed=seed, poor_cap=cap)
    return {x["id"]: x["client"] for x in sm.non_iid_partition(pool, SPEC, plan).collect()}


def test_every_row_gets_one_client(pool):
    rows = sm.non_iid_partition(pool, SPEC, PLAN).collect()
    assert len(rows) == 2200 and len({x["id"] for x in rows}) == 2200
    assert {x["client"] for x in rows} <= set("ABCD")


def test_poor_clients_stay_under_the_cap(pool):
    got = shards(pool)
    for c in "CD":
        assert sum(1 for i, x in got.items() if i < 200 and x == c) <= 15


def test_same_seed_same_shards_other_seed_other_shards(pool):
    assert shards(pool) == shards(pool)
    assert shards(pool) != shards(pool, seed=7)


def test_negatives_follow_the_weights(pool):
    got = shards(pool)
    n = [sum(1 for i, x in got.items() if i >= 200 and x == c) for c in "ABCD"]
    assert n == [700, 700, 300, 300]


def test_published_quota_and_weight_arithmetic(spark):
    counts = spark.createDataFrame([(0, 283726 - 473), (1, 473)], "label int, n bigint")
    q = {x["label"]: x["quota"] for x in sm.holdout_quotas(counts, ["label"], 0.2).collect()}
    assert q[1] == 95 and q[0] + q[1] == 56746
    w = sm.weighted_counts(sm.share_table(spark, PLAN.weights, PLAN), 226602)
    assert [x["cnt"] for x in w.orderBy("pos").collect()] == [79311, 79311, 33990, 33990]


def test_caps_conserve_the_total(spark):
    for shares in ([0.1, 0.1, 0.5, 0.3], [0.0, 0.02, 0.97, 0.01], [0.25] * 4):
        t = sm.share_table(spark, dict(zip("ABCD", shares)), PLAN)
        out = {x["client"]: x["cnt"] for x in sm.capped_counts(sm.argmax_counts(t, 378), 15).collect()}
        assert sum(out.values()) == 378 and out["C"] <= 15 and out["D"] <= 15


def test_dirichlet_shares_are_seeded():
    a = sm.dirichlet_shares(PLAN)
    assert a == sm.dirichlet_shares(PLAN) and abs(sum(a.values()) - 1) < 1e-12
    assert a != sm.dirichlet_shares(PartitionPlan(seed=1))


def test_rank_equals_the_plain_window(pool):
    got = sm.seeded_rank(pool, ["label"], ["id"], 42)
    w = Window.partitionBy("label").orderBy(sm.hash_key(42, ["id"]), "id")
    assert got.withColumn("want", F.row_number().over(w)).filter("rank <> want").count() == 0


def test_holdout_is_stratified_and_exact(pool):
    out = sm.stratified_holdout(pool, SPEC, 0.2, 3).filter("split = 'holdout'")
    assert {x["label"]: x["count"] for x in out.groupBy("label").count().collect()} == {0: 400, 1: 40}


def test_one_assignment_equals_two_steps(pool):
    both = {x["id"]: x["client"] for x in sm.holdout_and_shards(pool, SPEC, PLAN).filter("split = 'train'").collect()}
    split = sm.stratified_holdout(pool, SPEC, 0.2, PLAN.seed).filter("split = 'train'").drop("split")
    assert both == {x["id"]: x["client"] for x in sm.non_iid_partition(split, SPEC, PLAN).collect()}


def test_large_prefixes_are_narrowed(pool, monkeypatch):
    want = shards(pool)
    monkeypatch.setattr(sm, "PREFIX_ROWS", 0)
    assert shards(pool) == want


def test_empty_strata_and_empty_ranges(spark):
    only_neg = spark.range(50).select("id", F.lit(1.0).alias("v"), F.lit(0).alias("label"))
    assert len(sm.non_iid_partition(only_neg, SPEC, PLAN).collect()) == 50


def test_shuffled_clients_keep_their_rows(pool):
    df = pool.withColumn("client", F.when(F.col("id") % 3 == 0, "A").otherwise("B"))
    out = sm.shuffle_rows(df, SPEC, 42, rows_per_file=100)
    assert out.count() == 2200 and set(out.columns) == set(df.columns)


def test_targets_round_half_even(spark):
    t = spark.createDataFrame([("A", 5), ("B", 7), ("C", 0)], "client string, n_pos bigint")
    assert {x["client"]: x["n_target"] for x in sm.synthetic_targets(t, 0.5).collect()} == {"A": 2, "B": 4, "C": 1}


def test_fetch_small_refuses_more_rows(spark):
    with pytest.raises(ValueError):
        fetch_small(spark.range(11), 10)
    assert np.all([x[0] < 10 for x in fetch_small(spark.range(10), 10)])
