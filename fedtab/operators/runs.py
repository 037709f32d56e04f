"""Run-metrics warehouse: latest runs, comparisons, upserts and registration as batch views.

"Latest of a group" is always an aggregate (max_by over a struct), which combines map-side, so a
run or arm that owns a third of all rows never meets in one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import literal_table, null_safe_join
from ..spec import ARMS, METRICS, MODE_LABEL, RUN_DEFAULTS, VERDICT_LABEL


def _arms(spark) -> DataFrame:
    return literal_table(spark, [(a, i) for i, a in enumerate(ARMS)], "arm string, arm_pos int")


def _latest(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    best = F.max_by(F.struct(*columns), order)
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, "__b.*")


def full_configuration(epochs: int = 20, num_rounds: int = 10) -> Column:
    """Federated arms count by rounds, the others by epochs; smoke runs are left out."""
    fed = F.col("arm").startswith("federated")
    return F.when(fed, F.col("num_rounds") == num_rounds).otherwise(F.col("epochs") == epochs)


def latest_full_runs(runs: DataFrame, epochs: int = 20, num_rounds: int = 10,
                     require: bool = False) -> DataFrame:
    """Newest full-configuration run of every arm (ties: greatest run_id). With ``require`` an arm
    that has none fails the query."""
    cols = [c for c in runs.columns if c != "arm"]
    best = _latest(runs.filter(full_configuration(epochs, num_rounds)), ["arm"],
                   F.struct("created_at", "run_id"), cols)
    if not require:
        return best
    missing = F.raise_error(F.concat(F.lit("no full-configuration run for arm "), F.col("arm")))
    return (_arms(runs.sparkSession).select("arm").join(best, "arm", "left")
            .withColumn("run_id", F.when(F.col("run_id").isNull(), missing.cast("string"))
                        .otherwise(F.col("run_id"))))


def latest_completed_grid(runs: DataFrame) -> DataFrame:
    """Every arm with the metrics of its newest completed run; zeros and has_data=false without."""
    best = _latest(runs.filter("status = 'complete'"), ["arm"], F.struct("created_at", "run_id"),
                   ["run_id", "f1", "precision", "recall"])
    j = _arms(runs.sparkSession).join(best, "arm", "left")
    return j.select("arm", "run_id", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in ("f1", "precision", "recall")],
                    F.col("run_id").isNotNull().alias("has_data"))


def missing_arms(runs: DataFrame) -> DataFrame:
    done = runs.filter("status = 'complete'").select("arm").distinct()
    return _arms(runs.sparkSession).select("arm").join(done, "arm", "left_anti")


def history(runs: DataFrame, completed_only: bool = False) -> DataFrame:
    """Newest first."""
    df = runs.filter("status = 'complete'") if completed_only else runs
    return df.orderBy(F.desc("created_at"), F.desc("run_id"))


def run_detail(runs: DataFrame, rounds: DataFrame, clients: DataFrame) -> DataFrame:
    """Each run followed by its round and client metrics as rows (``kind``). The documents stay
    rows on purpose: one run's metrics may be too many for one array."""
    run = runs.select("run_id", "arm", "status")
    docs = (rounds.select("run_id", F.lit("round").alias("kind"), "round",
                          F.lit(None).cast("string").alias("client"), "f1", "precision", "recall")
            .unionByName(clients.select("run_id", F.lit("client").alias("kind"), "round", "client",
                                        "f1", "precision", "recall")))
    return run.join(docs, "run_id", "left")


def require_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The run's row; an unknown id is an error."""
    hit = runs.filter(F.col("run_id") == run_id)
    if not hit.take(1):
        raise LookupError(f"unknown run_id '{run_id}'")
    return hit


def convergence(rounds: DataFrame) -> DataFrame:
    """Numbered rounds in order, the three headline metrics."""
    return (rounds.filter(F.col("round").isNotNull())
            .select("run_id", "round", "f1", "precision", "recall").orderBy("run_id", "round"))


def latest_per_client(clients: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Latest metric of every client in a run: greatest round; the first seen wins a tie and a
    NULL round loses to any number. ``seq`` orders arrival."""
    order = F.struct(F.coalesce(F.col("round"), F.lit(0)), *[(-F.col(c)) for c in seq])
    return _latest(clients, ["run_id", "client"], order, ["round", "f1"])


def results_table(runs: DataFrame) -> DataFrame:
    """Run id and the five metrics per arm."""
    return latest_full_runs(runs).select("arm", "run_id", *METRICS)


def reference_gaps(results: DataFrame, points: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """Ours against given literature numbers: points(source, arm, metric, value)."""
    ref = literal_table(results.sparkSession, list(points),
                        "source string, arm string, metric string, reference double")
    long = results.select("arm", *METRICS).unpivot(["arm"], list(METRICS), "metric", "ours")
    return (long.join(ref, ["arm", "metric"])
            .select("source", "arm", "metric", "ours", "reference",
                    (F.col("ours") - F.col("reference")).alias("gap")))


def _map(values: dict[str, str], col: str) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(col)]


def row_counts(clients: DataFrame, rows: DataFrame, out: str = "n_rows") -> DataFrame:
    """Rows stored per client, 0 where a client has none."""
    n = rows.groupBy("client").agg(F.count("*").alias(out))
    return null_safe_join(clients, n, ["client"], "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("bigint"))


def quality_panel(clients: DataFrame, candidates: DataFrame, validated: DataFrame,
                  reports: DataFrame) -> DataFrame:
    """One row per client: stored row counts and the validation report with readable labels."""
    p = row_counts(clients, candidates, "n_candidates")
    p = row_counts(p, validated, "n_validated")
    rep = reports.select("client", "mode", "fidelity_score", "novelty_score", "mode_collapse_max", "batch_verdict")
    return (null_safe_join(p, rep, ["client", "mode"], "left")
            .withColumns({"mode_label": _map(MODE_LABEL, "mode"),
                          "verdict_label": F.coalesce(_map(VERDICT_LABEL, "batch_verdict"), F.lit("-"))}))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Last write per key wins; NULL is a key value like any other; applying twice changes nothing."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return _latest(both, keys, F.struct(*version), rest).select(*both.columns)


def finalize(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Update-only: set whatever columns the update carries (status, final metrics, arm, updated_at) of
    known runs; unknown run ids do nothing."""
    names = [c for c in updates.columns if c != "run_id" and c in runs.columns]
    u = updates.select("run_id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in names])
    j = runs.join(u, "run_id", "left")
    return j.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in names}).select(*runs.columns)


def register(requests: DataFrame) -> DataFrame:
    """Run requests with defaults filled in; ``error`` says why a request is refused."""
    known = F.col("arm").isin(*ARMS)
    return requests.withColumns({
        **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in RUN_DEFAULTS.items()},
        "status": F.when(known, "running"),
        "error": F.when(F.col("arm").isNull(), "arm is required").when(~known, "unknown arm")})


def arm_deltas(results: DataFrame) -> DataFrame:
    """Metric differences augmented - real per topology, and federated - isolated per data kind."""
    d = results.select("arm", *METRICS).withColumns({
        "topology": F.element_at(F.split("arm", "_"), 1), "data": F.element_at(F.split("arm", "_"), 2)})
    long = d.unpivot(["topology", "data"], list(METRICS), "metric", "v")

    def diff(by, col, plus, minus):
        a = F.max(F.when(F.col(col) == plus, F.col("v")))
        b = F.max(F.when(F.col(col) == minus, F.col("v")))
        return long.groupBy(by, "metric").agg((a - b).alias("delta")).select(
            F.lit(f"{plus} - {minus}").alias("comparison"), F.col(by).alias("within"), "metric", "delta")
    return diff("topology", "data", "augmented", "real").unionByName(
        diff("data", "topology", "federated", "isolated"))
