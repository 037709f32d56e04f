import json
import os
import random

import pytest
from pyspark.sql import functions as F

from fedtab.functions.common import new_path
from fedtab.sources import growing
from fedtab.sources.keyed import KeyedTable
from fedtab.sources.store import upsert_table
from fedtab.streaming import lifecycle as lc
from fedtab.streaming import metrics as st


def stamp(s):
    return f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


def put(spark, src, rows):
    """One file, hence one micro-batch, of documents (run, kind, round, client, f1, status, seq, second)."""
    docs = spark.createDataFrame([r[:7] + (stamp(r[7]),) for r in rows], lc.DOCUMENT.replace("at timestamp", "at string"))
    docs.coalesce(1).write.mode("append").json(src)


@pytest.fixture
def stream(spark):
    src, ck, out = new_path(spark, "src"), new_path(spark, "ck"), new_path(spark, "events")

    def run():
        docs = st.metric_source(spark, src, spark.createDataFrame([], lc.DOCUMENT).schema, 1)
        st.run_available(lc.run_events(docs, idle=100, grace=50, late="1 second"), st.append_sink(out), ck, "update")
        return sorted((r.run_id, r.type, r.round, r.client, r.status) for r in
                      spark.read.schema(lc.EVENT).parquet(out).select("run_id", "type", F.coalesce("round", F.lit(-1)).alias("round"),
                                                                      F.coalesce("client", F.lit("")).alias("client"),
                                                                      F.coalesce("status", F.lit("")).alias("status")).collect())
    with lc.state_settings(spark):
        yield src, ck, run


def test_events_done_and_state(spark, stream):
    src, ck, run = stream
    put(spark, src, [("a", "round", 1, None, 0.1, None, 1, 0), ("a", "round", 1, None, 0.1, None, 1, 0), ("a", "round", None, None, 0.2, None, 2, 1),
                     ("a", "client", 1, "A", 0.3, None, 3, 1), ("b", "client", None, "A", 0.3, None, 4, 1),
                     ("b", "status", None, None, None, "running", 5, 1)])
    assert run() == [("a", "client_metric", 1, "A", ""), ("a", "round_metric", -1, "", ""), ("a", "round_metric", 1, "", ""),
                     ("b", "client_metric", -1, "A", "")]
    # a restart: what was seen is not reported again, metrics come before the end they arrive with
    put(spark, src, [("a", "status", None, None, 0.9, "complete", 8, 3), ("a", "round", 1, None, 0.1, None, 1, 3), ("a", "round", 2, None, 0.4, None, 7, 3)])
    got = run()
    assert got.count(("a", "round_metric", 1, "", "")) == 1 and ("a", "done", -1, "", "complete") in got
    assert lc.state_rows(spark, ck) == {"seen": 1, "life": 2}  # b's document; the marker of a and b's life
    put(spark, src, [("a", "round", 3, None, 0.4, None, 9, 4)])  # a straggler after the end
    assert run() == got
    # time goes on: a's marker goes, b has been silent for too long, c keeps the clock running
    put(spark, src, [("c", "status", None, None, None, "failed", 1, 500)])
    put(spark, src, [("c", "status", None, None, None, "failed", 2, 501)])
    put(spark, src, [("c", "status", None, None, None, "failed", 3, 502)])
    got = run()
    assert [e for e in got if e[1] == "timeout"] == [("b", "timeout", -1, "", "")] and got.count(("c", "done", -1, "", "failed")) == 1
    assert lc.state_rows(spark, ck) == {"seen": 0, "life": 1}


def test_finals_are_persisted(spark, stream):
    src, _, _ = stream
    rounds, clients, runs = (new_path(spark, n) for n in ("rounds", "clients", "runs"))
    upsert_table(spark.createDataFrame([("a", "running", None, -1, False), ("z", "running", None, -1, False)],
                                       "run_id string, status string, f1 double, seq bigint, done boolean"), runs, ["run_id"], ["seq"])
    put(spark, src, [("a", "round", 1, None, 0.1, None, 1, 0), ("a", "client", 1, "A", 0.3, None, 3, 1), ("ghost", "status", None, None, 0.5, "failed", 1, 1),
                     ("a", "status", None, None, 0.9, "complete", 8, 3)])
    docs = st.metric_source(spark, src, spark.createDataFrame([], lc.DOCUMENT).schema, 1)
    st.run_available(lc.run_events(docs), lc.persist_sink(rounds, clients, runs), None, "update")
    assert [tuple(r) for r in KeyedTable(spark, rounds).read().select("run_id", "round", "f1").collect()] == [("a", 1, 0.1)]
    assert [tuple(r) for r in KeyedTable(spark, clients).read().select("run_id", "client", "f1").collect()] == [("a", "A", 0.3)]
    got = {r.run_id: (r.status, r.f1, r.done) for r in KeyedTable(spark, runs).read().collect()}
    assert got == {"a": ("complete", 0.9, True), "z": ("running", None, False)}


# ---- growing files ------------------------------------------------------------------------

SCHEMA = "run_id string, round int, f1 double"


def lines(folder, name, docs, end="\n"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "a") as f:
        f.write("".join(json.dumps(d) + "\n" for d in docs[:-1]) + json.dumps(docs[-1]) + end)


def test_appended_lines_are_read_once_across_restarts(spark):
    src, ck, out = (new_path(spark, n) for n in ("growing", "ck", "out"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        st.run_available(growing.growing_metrics(spark, src, schema), st.append_sink(out), ck)
        return sorted((r.run_id, r.round) for r in spark.read.schema(schema).parquet(out).collect())
    lines(src, "a.jsonl", [{"run_id": "a", "round": i} for i in range(3)])
    lines(src, "b.txt", [{"run_id": "no", "round": 0}])
    assert run() == [("a", 0), ("a", 1), ("a", 2)]
    lines(src, "a.jsonl", [{"run_id": "a", "round": 3}, {"run_id": "a", "round": 4}], end="")  # the last line is not whole yet
    lines(src, "c.jsonl", [{"run_id": "c", "round": 0}])
    assert run() == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("c", 0)]
    with open(f"{src}/a.jsonl", "a") as f:
        f.write("\n\n")
    assert run() == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("c", 0)]
    assert run() == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("c", 0)]


@pytest.mark.parametrize("piece", [1, 7, 64, 1000])
def test_pieces_split_lines_whole(tmp_path, piece, monkeypatch):
    monkeypatch.setattr(growing, "LOOK_BACK", 5)
    rng = random.Random(piece)
    want, reader = [], growing.GrowingReader({"path": str(tmp_path), "piecebytes": str(piece)})
    start, got = reader.initialOffset(), []
    for step in range(4):
        for name in ("x.jsonl", "y.jsonl"):
            with open(tmp_path / name, "a") as f:
                for i in range(rng.randrange(6)):
                    text = "é" * rng.randrange(1, 20) + str(step * 100 + i)
                    want.append((name, text))
                    f.write(text + "\n")
        end = reader.latestOffset()
        got += [(n, line) for p in reader.partitions(start, end) for n, _, line in reader.read(p)]
        start = end
    assert sorted(got) == sorted(want)


def test_small_files_share_a_task(tmp_path):
    """A folder of many short logs is some pieces by its bytes, not one for every file."""
    for i in range(500):
        (tmp_path / f"{i:03d}.jsonl").write_text(f"first {i}\nsecond {i}\n")
    reader = growing.GrowingReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    pieces = reader.partitions({}, end)
    assert len(pieces) == 1 and len(end) == 500
    got = [(n, line) for p in pieces for n, _, line in reader.read(p)]
    assert sorted(got) == sorted((f"{i:03d}.jsonl", f"{w} {i}") for i in range(500) for w in ("first", "second"))
    assert len(growing.GrowingReader({"path": str(tmp_path), "piecebytes": "100000"}).partitions({}, end)) in range(10, 30)


def test_a_file_that_became_shorter_is_an_error(tmp_path):
    reader = growing.GrowingReader({"path": str(tmp_path)})
    (tmp_path / "x.jsonl").write_text("one\ntwo\n")
    seen = reader.latestOffset()
    (tmp_path / "x.jsonl").write_text("one\n")
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions(seen, growing.GrowingReader({"path": str(tmp_path)}).latestOffset())


# ---- requests that wait for their run -----------------------------------------------------

def test_requests_wait_for_their_run(spark):
    from fedtab.sources.store import save_artifact
    from fedtab.streaming import waiting
    base, path, out, ck = (new_path(spark, n) for n in ("store", "requests", "out", "ck"))

    def store(run_id):
        save_artifact(spark.createDataFrame([("centralized_real", None)], "arm string, clients array<string>"), base, "manifests", run_id)

    def ask(rows):
        spark.createDataFrame(rows, "request_id int, run_id string, features map<string,double>").write.mode("append").parquet(path)

    def go(wait):
        asked = spark.readStream.schema("request_id int, run_id string, features map<string,double>").parquet(path)
        with lc.state_settings(spark, bounded=True):
            st.run_available(waiting.await_runs(asked, waiting.manifest_stream(spark, base), wait), st.append_sink(out), ck, "update")
        got = spark.read.schema("request_id int, run_id string, features map<string,double>, known boolean").parquet(out)
        return sorted((r.request_id, r.known, r.features) for r in got.collect())
    store("old")
    ask([(1, "old", {"x": 1.0}), (2, "late", {"x": 2.5, "y": None}), (3, "never", None), (4, None, {})])
    assert go(3600) == [(1, True, {"x": 1.0})]
    store("late")  # stored after the stream began
    first = [(1, True, {"x": 1.0}), (2, True, {"x": 2.5, "y": None})]
    assert go(3600) == first
    ask([(5, "late", {}), (6, "never", {})])
    assert go(0) == first + [(5, True, {}), (6, False, {})]  # the earlier request of that run has an hour to wait
    assert go(0) == first + [(5, True, {}), (6, False, {})]
