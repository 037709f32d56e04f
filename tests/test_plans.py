"""Plan shapes that must hold at scale."""

import pytest

import __spark_entry__ as entry
from checks import sampling as cs
from fedtab import fixtures as fx
from fedtab.operators import gate, prep, profile
from fedtab.operators import sampling as sm

QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["holdout_and_shards", "scaled_rows", "holdout_by_client_scaler", "schema_gate", "novelty", "column_profile",
                                  "top_correlations", "range_bounds", "keyed_upsert", "latest_client_metric", "roc_auc", "column_shape_fidelity",
                                  "run_detail", "request_validation"])
def test_no_product_joins(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["holdout_and_shards", "scaled_rows", "holdout_by_client_scaler", "schema_gate", "keyed_upsert", "column_profile"])
def test_row_scale_data_never_meets_in_one_partition(spark, sf, name):
    assert "SinglePartition" not in plan(QUERIES[name](spark, sf))


def test_assignment_and_scaling_do_not_shuffle_rows(spark, sf):
    t = fx.txn(spark, sf)
    for df in (sm.holdout_and_shards(t, fx.SPEC, cs.PLAN), prep.scale(t, prep.fit_scaler(t, fx.SPEC), fx.SPEC),
               gate.check_rows(fx.candidates(spark, sf), profile.range_bounds(t, fx.SPEC), fx.SPEC)):
        assert "hashpartitioning" not in plan(df) and "rangepartitioning" not in plan(df)


def test_scans_read_only_what_they_need(spark, sf):
    text = plan(profile.class_weight(fx.txn(spark, sf), fx.SPEC))
    assert "l_extendedprice" not in text.split("ReadSchema")[1]
    text = plan(fx.positives(spark, sf).select("l_orderkey"))
    assert "PushedFilters" in text and "EqualTo(l_returnflag,R)" in text


def test_aggregates_combine_before_the_shuffle(spark, sf):
    assert "partial_" in plan(prep.fit_scaler(fx.txn(spark, sf), fx.SPEC))
    # co-moments: states are made on the scan's side of the first exchange
    shown = plan(profile.correlations(fx.txn(spark, sf), fx.SPEC))
    assert shown.rindex("MapInPandas") > shown.rindex("Exchange")


def test_partition_pruning(spark, sf, tmp_path):
    from fedtab.sources import files as fl
    t = fx.txn(spark, sf).select("client", *fx.FEATURES, "label")
    path = str(tmp_path / "by-client")
    fl.write_by_client(t, path, fx.SPEC)
    text = plan(fl.read_by_client(spark, path, t.schema, client="B", where="label = 1"))
    assert "PartitionFilters: [isnotnull(client" in text and "EqualTo(label,1)" in text
