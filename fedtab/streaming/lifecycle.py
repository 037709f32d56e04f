"""Life of a run in one stateful processor.

Documents of all kinds arrive on one stream, keyed by run. The first document of every round, and of every client in a
round, becomes an event (a NULL round is a key like any other); a terminal status becomes ``done`` with the final
metric. With ``done`` everything kept about the run is cleared but a marker that ignores stragglers and goes by itself
after ``grace``. A run from which nothing was heard for ``idle`` is reported once as ``timeout`` and forgotten.
Time is event time, so a replay gives the same events.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import upsert_table
from .metrics import _query_of, finalize_sink

#: Columns of a document; ``kind`` is round, client or status, ``at`` the event time.
DOCUMENT = "run_id string, kind string, round int, client string, f1 double, status string, seq bigint, at timestamp"
EVENT = "run_id string, type string, round int, client string, f1 double, status string, seq bigint"
TERMINAL = ("complete", "failed")
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _event(run_id, type, seq, round=None, client=None, f1=None, status=None) -> Row:
    return Row(run_id=run_id, type=type, round=round, client=client, f1=f1, status=status, seq=seq)


class RunLife(StatefulProcessor):
    """Events of a run; state: what was seen, and until when the run may stay silent."""

    def __init__(self, idle_ms: int, grace_ms: int):
        self.idle_ms, self.grace_ms = idle_ms, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "kind string, round int, client string", "seq bigint")
        self.life = handle.getValueState("life", "ended boolean, deadline bigint")

    def _wait_until(self, deadline: int, ended: bool) -> None:
        """One timer a run: the earlier one goes when the deadline moves."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.life.update((ended, deadline))
        self.handle.registerTimer(deadline)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        run = key[0]
        life = self.life.get()
        if life is not None and life[0]:
            return
        docs = sorted(rows, key=lambda d: (d.kind == "status", d.seq if d.seq is not None else -1))
        latest = max((int(d.at.timestamp() * 1000) for d in docs if d.at is not None), default=0)
        last = None
        for d in docs:
            if d.kind in ("round", "client"):
                place = (d.kind, d.round, d.client if d.kind == "client" else None)
                if not self.seen.containsKey(place):
                    self.seen.updateValue(place, (d.seq,))
                    yield _event(run, f"{d.kind}_metric", d.seq, d.round, place[2], d.f1)
            elif d.kind == "status" and d.status in TERMINAL:
                last = d
        start = max(latest, timerValues.getCurrentWatermarkInMs(), life[1] - self.idle_ms if life else 0)
        if last is not None:
            yield _event(run, "done", last.seq, f1=last.f1, status=last.status)
            self.seen.clear()
            self._wait_until(start + self.grace_ms, True)
        else:
            self._wait_until(start + self.idle_ms, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        life = self.life.get()
        self.seen.clear()
        self.life.clear()
        if life is not None and not life[0]:
            yield _event(key[0], "timeout", None)

    def close(self) -> None:
        pass


def run_events(documents: DataFrame, idle: int = 3600, grace: int = 600, late: str = "10 minutes") -> DataFrame:
    """Events of all runs on a stream of DOCUMENT rows; ``idle`` and ``grace`` in seconds. Documents without a run or a time
    are left out."""
    timed = documents.filter("run_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return timed.groupBy("run_id").transformWithState(
        statefulProcessor=RunLife(idle * 1000, grace * 1000), outputStructType=EVENT, outputMode="Update", timeMode="EventTime")


@contextmanager
def state_settings(spark, bounded: bool = False):
    """The state store that the processors need, while a query starts and runs. ``bounded``: no micro-batches without data;
    with timers in processing time a run over what is there would not end otherwise."""
    wanted = STATE_CONF | ({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if bounded else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def state_rows(spark, checkpoint: str) -> dict[str, int]:
    """Entries of every state variable at the last committed batch of a stream."""
    def of(name: str) -> int:
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load().count()
    return {name: of(name) for name in ("seen", "life")}


def persist_sink(rounds: str, clients: str, runs: str, events: str | None = None):
    """foreachBatch sink of events: metrics are upserted, a ``done`` finalizes its run in the table of runs; with ``events``
    every event is kept as well, one folder a batch."""
    finalize = finalize_sink(runs)

    def write(batch: DataFrame, batch_id: int) -> None:
        app = _query_of(batch)
        number = batch_id if app else None
        batch = batch.persist()
        try:
            if events:
                batch.write.mode("overwrite").parquet(f"{events}/batch={batch_id}")
            metric = batch.select("run_id", "round", "client", "f1", "seq", "type")
            upsert_table(metric.filter("type = 'round_metric'").drop("type", "client"), rounds, ["run_id", "round"], ["seq"], app=app, batch=number)
            upsert_table(metric.filter("type = 'client_metric'").drop("type"), clients, ["run_id", "round", "client"], ["seq"], app=app,
                         batch=number)
            finalize(batch.filter(F.col("type") == "done").select("run_id", "status", "f1", "seq"), batch_id)
        finally:
            batch.unpersist()
    return write
