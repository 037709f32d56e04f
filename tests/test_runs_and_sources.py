import pytest
from pyspark.sql import functions as F

from fedtab.functions.common import new_path
from fedtab.operators import runs as rn
from fedtab.sources import files as fl
from fedtab.sources import store
from fedtab.spec import ARMS
from fedtab.streaming import metrics as st

DOC = "run_id string, round int, client string, f1 double, seq bigint"
RUN = "run_id string, arm string, status string, created_at string, epochs int, num_rounds int, f1 double, precision double, recall double, auc double, accuracy double"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def test_upsert_is_idempotent_and_null_rounds_are_keys(spark):
    new = docs(spark, [("r", None, "A", 0.1, 1), ("r", None, "A", 0.2, 2), ("r", 1, "A", 0.3, 3)])
    once = rn.upsert(new.filter("false"), new, ["run_id", "round", "client"], ["seq"])
    twice = rn.upsert(once, new, ["run_id", "round", "client"], ["seq"])
    want = {("r", None, 0.2), ("r", 1, 0.3)}
    assert {(r["run_id"], r["round"], r["f1"]) for r in once.collect()} == want
    assert {(r["run_id"], r["round"], r["f1"]) for r in twice.collect()} == want and twice.count() == 2


def test_table_upsert_replays_and_touches_only_its_keys(spark):
    path = new_path(spark, "t")
    a = docs(spark, [("r1", 1, "A", 0.1, 1), ("r2", None, "B", 0.2, 1)])
    b = docs(spark, [("r1", 1, "A", 0.9, 2), ("r3", 3, "C", 0.5, 2)])
    for batch in (a, b, b, a):  # a late replay of an old batch must not undo the newer one
        store.upsert_table(batch, path, ["run_id", "round", "client"], ["seq"], parts=4)
    got = {(r["run_id"], r["round"], r["f1"]) for r in store.read_table(spark, path, a.schema).collect()}
    assert got == {("r1", 1, 0.9), ("r2", None, 0.2), ("r3", 3, 0.5)}


def test_finalize_updates_only_known_runs(spark):
    runs = spark.createDataFrame([("r1", "running", None, "t0")], "run_id string, status string, f1 double, updated_at string")
    upd = spark.createDataFrame([("r1", "complete", 0.5, "t1"), ("ghost", "failed", 0.1, "t1")], runs.schema)
    assert [tuple(r) for r in rn.finalize(runs, upd).collect()] == [("r1", "complete", 0.5, "t1")]


def test_latest_full_run_rules(spark):
    m = (0.1,) * 5
    df = spark.createDataFrame([("a1", "isolated_real", "complete", "2024-01-01", 20, 2, *m), ("a2", "isolated_real", "complete", "2024-01-01", 20, 2, *m),
                                ("a3", "isolated_real", "complete", "2025-01-01", 3, 10, *m), ("f1", "federated_real", "running", "2024-01-01", 3, 10, *m)], RUN)
    assert {r["arm"]: r["run_id"] for r in rn.latest_full_runs(df).collect()} == {"isolated_real": "a2", "federated_real": "f1"}
    with pytest.raises(Exception, match="no full-configuration run"):
        rn.latest_full_runs(df, require=True).collect()
    assert {r["arm"] for r in rn.missing_arms(df).collect()} == set(ARMS) - {"isolated_real"}
    grid = rn.latest_completed_grid(df).collect()
    assert len(grid) == 6 and sum(r["has_data"] for r in grid) == 1
    with pytest.raises(LookupError):
        rn.require_run(df, "nope")


def test_latest_per_client_null_round_and_first_seen(spark):
    d = docs(spark, [("r", None, "A", 0.1, 1), ("r", 2, "A", 0.2, 2), ("r", 2, "A", 0.3, 3), ("r", None, "B", 0.4, 4), ("r", None, "B", 0.5, 5)])
    got = {r["client"]: r["f1"] for r in rn.latest_per_client(d, ["seq"]).collect()}
    assert got == {"A": 0.2, "B": 0.4}


def test_registration_defaults_and_refusals(spark):
    req = spark.createDataFrame([("federated_real", None, None, None, None), (None, 1, None, None, None), ("x", 1, 2, 3, 4)],
                                "arm string, seed int, epochs int, num_rounds int, local_epochs int")
    got = [tuple(r) for r in rn.register(req).collect()]
    assert got == [("federated_real", 42, 20, 10, 2, "running", None), (None, 1, 20, 10, 2, None, "arm is required"), ("x", 1, 2, 3, 4, None, "unknown arm")]


# ---- files --------------------------------------------------------------------------------

def _csv(spark, rows, cols):
    path = new_path(spark, "csv")
    spark.createDataFrame(rows, cols).write.option("header", True).csv(path)
    return path


def test_checked_scan_errors(spark):
    with pytest.raises(FileNotFoundError):
        fl.load_checked(spark, "/tmp/no/such/file.csv", ["a"], "label")
    path = _csv(spark, [(1.0, 1)], "a double, label int")
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        fl.load_checked(spark, path, ["c", "a", "b"], "label")
    path = _csv(spark, [(1.0, 1), (None, 0)], "a double, label int")
    with pytest.raises(ValueError, match=r"nulls in columns \['a'\]"):
        fl.load_checked(spark, path, ["a"], "label")


def test_checked_scan_drops_duplicates_and_casts_the_label(spark):
    df = fl.load_checked(spark, _csv(spark, [(1.5, 1.0), (1.5, 1.0), (2.5, 0.0)], "a double, label double"), ["a"], "label")
    assert sorted(map(tuple, df.collect())) == [(1.5, 1), (2.5, 0)] and df.schema["label"].dataType.simpleString() == "int"


def test_missing_partitions_read_as_empty(spark):
    path = new_path(spark, "v")
    rows = spark.createDataFrame([("A", 1.0)], "client string, x double")
    fl.write_validated(rows, path)
    assert fl.read_by_client(spark, path, rows.schema, client="B").count() == 0
    fl.write_validated(rows.filter("false"), path)
    assert fl.read_by_client(spark, path, rows.schema).count() == 0


def test_export_errors_and_kind(spark):
    cand = spark.createDataFrame([("A", 1.0)], "client string, x double")
    with pytest.raises(LookupError):
        fl.export_dataset({"candidates": cand}, "candidates", "Q", "ABCD", new_path(spark, "e"))
    with pytest.raises(LookupError):
        fl.export_dataset({"candidates": cand}, "validated", "A", "ABCD", new_path(spark, "e"))
    path = new_path(spark, "e")
    fl.export_dataset({"candidates": cand}, "anything", "A", "ABCD", path)
    assert spark.read.option("header", True).csv(path).count() == 1


def test_markdown_shows_none_and_four_decimals(spark):
    rep = spark.createDataFrame([("B", None, "REJECT_TOO_FEW_ROWS"), ("A", 0.67254, "PASS")], "client string, fidelity double, verdict string")
    cols = [("Client", fl.text("client")), ("Fidelity", fl.fmt4("fidelity")), ("Verdict", fl.text("verdict"))]
    lines = fl.markdown_table(rep, "Report", cols, ["client"])
    path = new_path(spark, "md")
    fl.write_markdown(lines, path)
    assert [r[0] for r in spark.read.text(path).collect() if r[0]] == [
        "# Report", "| Client | Fidelity | Verdict |", "|---|---|---|", "| A | 0.6725 | PASS |", "| B | None | REJECT_TOO_FEW_ROWS |"]


# ---- streams ------------------------------------------------------------------------------

def test_stream_reads_each_document_once_and_replays_are_harmless(spark):
    src, table, ck = new_path(spark, "src"), new_path(spark, "table"), new_path(spark, "ck")
    docs(spark, [("r", 1, "A", 0.1, 1), ("r", None, "A", 0.2, 2), ("r", None, "A", 0.2, 2)]).coalesce(1).write.mode("append").json(src)
    schema = docs(spark, []).schema
    seen = []
    sink = st.upsert_sink(table, ["run_id", "round", "client"], ["seq"], parts=2)

    def counted(batch, i):
        seen.append(batch.count())
        sink(batch, i)
        sink(batch, i)
    st.run_available(st.metric_source(spark, src, schema), counted, ck)
    docs(spark, [("r", 1, "A", 0.7, 9)]).coalesce(1).write.mode("append").json(src)
    st.run_available(st.metric_source(spark, src, schema), counted, ck)
    assert seen == [3, 1]
    assert {(r["round"], r["f1"]) for r in store.read_table(spark, table, schema).collect()} == {(1, 0.7), (None, 0.2)}


def test_stream_dedupe_collapses_null_rounds(spark):
    src, out = new_path(spark, "src"), new_path(spark, "out")
    d = docs(spark, [("r", None, "A", 0.1, 1), ("r", None, "A", 0.1, 1), ("r", 2, "A", 0.1, 1)])
    d.coalesce(1).write.json(src)
    st.run_available(st.dedupe(st.metric_source(spark, src, d.schema), ["run_id", "round", "client"]), st.append_sink(out))
    assert spark.read.schema(d.schema).parquet(out).count() == 2


def test_append_sink_replay_overwrites_its_batch(spark):
    out = new_path(spark, "out")
    sink = st.append_sink(out)
    d = docs(spark, [("r", 1, "A", 0.1, 1)])
    sink(d, 0), sink(d, 0), sink(d, 1)
    assert spark.read.parquet(out).select(F.count("*")).first()[0] == 2
