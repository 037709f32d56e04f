"""Synthetic minority rows: mode routing, Gaussian-copula generation, and the request / response
tables of the aggregate-driven mode. Everything runs for all clients in one plan."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import fetch_small, null_safe_join, pin_small, unpivot
from ..functions.prefix import quantiles
from ..spec import MODE_AGGREGATE, MODE_STATISTICAL, TableSpec

GRID = 101           # quantile grid points of the copula's margins
CHUNK_ROWS = 10_000  # rows one generator task call draws
ROWS_PER_REQUEST = 50
TOKENS_PER_ROW = 150


# ---- mode routing -------------------------------------------------------------------------

def route_modes(clients: DataFrame, min_positives: int | None = None,
                modes: DataFrame | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """Which generator serves each client of ``clients(client, n_pos)``: by a given dimension
    modes(client, mode), else rich clients (``n_pos >= min_positives``) statistically and poor ones
    from aggregates. A client without a mode has mode NULL and ``error`` set."""
    if only is not None:
        clients = clients.filter(F.col("client").isin(*only))
    if modes is not None:
        out = null_safe_join(clients, modes, ["client"], "left")
    else:
        out = clients.withColumn("mode", F.when(F.col("n_pos") >= min_positives, MODE_STATISTICAL)
                                 .otherwise(MODE_AGGREGATE))
    return out.withColumn("error", F.when(F.col("mode").isNull(), F.concat(F.lit("unknown client "), F.coalesce("client", F.lit("NULL")))))


# ---- statistical generator ----------------------------------------------------------------

# ---- fixed values: rational approximation of the normal quantile (Acklam) ------------------
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
# -------------------------------------------------------------------------------------------


def normal_quantile(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    q = p - 0.5
    r2 = q * q
    mid = np.polyval(_A, r2) * q / np.polyval((*_B, 1.0), r2)
    t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    tail = np.polyval(_C, t) / np.polyval((*_D, 1.0), t)
    return np.where(np.abs(q) <= 0.47575, mid, np.where(q < 0, tail, -tail))


_CDF_X = np.linspace(-8.0, 8.0, 16001)
_CDF_Y = np.array([NormalDist().cdf(x) for x in _CDF_X[::10]])


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return np.interp(z, _CDF_X[::10], _CDF_Y)


def fit_copula(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One model row per client: exact quantile grid per column and the normal-score correlation.

    The grids come from the distributed quantile operator. Scores are summed per Arrow batch to
    (n, sum z, sum z z') partials, so a client of any size adds up in a small aggregate.
    """
    feats = list(spec.features)
    long = unpivot(df, [spec.client], feats).withColumnRenamed(spec.client, "client")
    grid = quantiles(long, ["client", "column"], "value", np.linspace(0, 1, GRID).tolist())
    grids = pin_small(grid.groupBy("client").agg(
        F.map_from_entries(F.collect_list(F.struct("column", "grid"))).alias("g"))
        .select("client", F.array(*[F.col("g")[c] for c in feats]).alias("grids")))
    table = {x["client"]: np.array(x["grids"], dtype=np.float64) for x in fetch_small(grids)}
    d = len(feats)

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probs = np.linspace(0, 1, GRID)
        for pdf in batches:
            for client, g in pdf.groupby("client", sort=False):
                x = g[feats].to_numpy(dtype=np.float64)
                u = np.empty_like(x)
                for j in range(d):
                    gv = table[client][j]
                    # middle of the flat stretch a repeated value covers
                    lo = np.searchsorted(gv, x[:, j], "left")
                    hi = np.searchsorted(gv, x[:, j], "right")
                    u[:, j] = np.where(hi > lo, (lo + hi - 1) / 2.0 / (GRID - 1), np.interp(x[:, j], gv, probs))
                z = normal_quantile(np.clip(u, 0.5 / GRID, 1 - 0.5 / GRID))
                yield pd.DataFrame({"client": [client], "n": [len(x)], "s": [z.sum(0)], "ss": [(z.T @ z).ravel()]})
    src = df.select(F.col(spec.client).alias("client"), *[F.col(c).cast("double") for c in feats])
    sums = (src.mapInPandas(partials, "client string, n bigint, s array<double>, ss array<double>")
            .groupBy("client").agg(
                F.sum("n").alias("n"),
                F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("s"),
                F.array(*[F.sum(F.col("ss")[i]) for i in range(d * d)]).alias("ss")))
    return null_safe_join(sums, grids, ["client"])


def sample_copula(models: DataFrame, targets: DataFrame, spec: TableSpec, seed: int = 42,
                  mode: str = MODE_STATISTICAL) -> DataFrame:
    """``n_target`` rows per client of ``targets(client, n_target)``, label 1, ids unique.

    The plan is a list of chunks joined with their client's model, so a large target is many
    independent tasks. Draws depend only on (seed, client, chunk). Values stay in [min, max].
    A target whose client has no model fails the query.
    """
    feats, d = list(spec.features), len(spec.features)
    chunks = targets.filter("n_target > 0").select(
        "client", "n_target",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n_target") / CHUNK_ROWS) - 1)).alias("chunk"))
    # chunks are few bytes each: spread them before each one grows to CHUNK_ROWS rows
    work = null_safe_join(chunks.repartition("client", "chunk"), pin_small(models), ["client"], "left")
    work = work.withColumn("n", F.when(F.col("n").isNull(), F.raise_error(
        F.concat(F.lit("no fitted model for client "), F.col("client"))).cast("bigint")).otherwise(F.col("n")))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probs = np.linspace(0, 1, GRID)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                s, ss = np.asarray(row.s, dtype=float), np.asarray(row.ss, dtype=float).reshape(d, d)
                cov = ss / row.n - np.outer(s, s) / row.n ** 2
                sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
                live = sd > 1e-12
                corr = np.eye(d)
                corr[np.ix_(live, live)] = cov[np.ix_(live, live)] / np.outer(sd[live], sd[live])
                w, v = np.linalg.eigh((corr + corr.T) / 2)
                root = v * np.sqrt(np.clip(w, 0.0, None))
                m = int(min(CHUNK_ROWS, row.n_target - row.chunk * CHUNK_ROWS))
                rng = np.random.default_rng([seed, int(row.chunk), *row.client.encode()])
                u = normal_cdf(rng.standard_normal((m, d)) @ root.T)
                cols = {c: np.interp(u[:, j], probs, np.asarray(row.grids[j], dtype=float))
                        for j, c in enumerate(feats)}
                yield pd.DataFrame({"client": row.client, "mode": mode,
                                    "id": np.arange(m) + row.chunk * CHUNK_ROWS, **cols, spec.label: 1})
    schema = T.StructType([
        T.StructField("client", T.StringType()), T.StructField("mode", T.StringType()),
        T.StructField("id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in feats],
        T.StructField(spec.label, T.IntegerType())])
    return work.mapInPandas(draw, schema)


# ---- aggregate-driven mode ----------------------------------------------------------------

def request_plan(targets: DataFrame, rows_per_request: int = ROWS_PER_REQUEST,
                 tokens_per_row: int = TOKENS_PER_ROW) -> DataFrame:
    """(client, request, batch_n, max_tokens): the target split into bounded requests."""
    last = F.ceil(F.col("n_target") / F.lit(rows_per_request)) - 1
    batch = F.least(F.lit(rows_per_request).cast("bigint"), F.col("n_target") - rows_per_request * F.col("request"))
    return (targets.filter("n_target > 0")
            .select("client", "n_target", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("request"))
            .select("client", "request", batch.alias("batch_n"), (batch * tokens_per_row).alias("max_tokens")))


def prompt_dataset(requests: DataFrame, profile: DataFrame, correlations: DataFrame,
                   prototypes: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per request: the client's aggregates as JSON and the text asking for rows. Profiles,
    correlations and prototypes have a fixed number of rows per client, so the lists are bounded."""
    pos = F.array_position(F.array(*[F.lit(c) for c in spec.features]), F.col("column"))
    stat_names = ("mean", "std", "min", "q25", "q50", "q75", "max")
    stats = profile.groupBy("client").agg(F.to_json(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct(pos.alias("p"), F.col("column").alias("k"),
                                             F.struct(*stat_names).alias("v")))),
        lambda x: F.struct(x["k"], x["v"])))).alias("stats"))
    corr = correlations.groupBy("client").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "col_a", "col_b", "r"))),
        lambda x: F.struct(x["col_a"].alias("col_a"), x["col_b"].alias("col_b"), x["r"].alias("r")))).alias("correlations"))
    proto = prototypes.groupBy("client").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("prototype", F.struct(*spec.features)))))).alias("prototypes"))
    per = pin_small(null_safe_join(null_safe_join(stats, corr, ["client"], "left"), proto, ["client"], "left"))
    j = null_safe_join(requests, per, ["client"])
    keys = json.dumps(list(spec.features))
    system = F.concat(F.lit("Produce synthetic numeric rows. Answer with a JSON object {\"rows\": [...]} of exactly "),
                      F.col("batch_n").cast("string"), F.lit(f" objects with the keys {keys} and nothing else."))
    user = F.concat(F.lit("Client "), F.col("client"), F.lit(". Statistics per column: "), F.col("stats"),
                    F.lit(" Strongest correlations: "), F.coalesce("correlations", F.lit("[]")),
                    F.lit(" Prototype rows: "), F.col("prototypes"))
    return j.select("client", "request", "batch_n", "max_tokens", "stats", "correlations", "prototypes",
                    system.alias("system"), user.alias("user"))


def leaking_prototypes(prototypes: DataFrame, real: DataFrame, spec: TableSpec, digits: int = 4) -> DataFrame:
    """Prototypes that equal a real row of their client (a client with a single row leaks it)."""
    rows = real.select(F.col(spec.client).alias("client"),
                       *[F.round(F.col(c).cast("double"), digits).alias(c) for c in spec.features]).distinct()
    return null_safe_join(prototypes, rows, ["client", *spec.features], "left_semi").select("client", "prototype")


def clean_body(body: Column) -> Column:
    """The response text without code fences."""
    t = F.regexp_replace(body, r"^\s+|\s+$", "")
    inner = F.regexp_replace(t, "^`+|`+$", "")
    return F.when(t.startswith("```"), F.substring(inner, F.greatest(F.instr(inner, "{"), F.lit(1)), F.length(inner))) \
        .otherwise(t)


_SEGMENT = r'"(?:[^"\\]|\\.)*+"|[^"]++|"'
_LITERAL = r"([:\[,]\s*)(-?Infinity|NaN)(?=\s*[,\]}])"


def _segments(body: Column) -> Column:
    """A JSON text as its strings and what lies between them."""
    return F.regexp_extract_all(body, F.lit(_SEGMENT), F.lit(0))


def quote_literals(body: Column) -> Column:
    """JSON text in which the bare numbers NaN, Infinity and -Infinity, where a value may stand, are quoted; strings are left
    as they are."""
    quoted = F.transform(_segments(body), lambda x: F.when(F.startswith(x, F.lit('"')), x).otherwise(
        F.regexp_replace(x, _LITERAL, '$1"$2"')))
    return F.when(body.rlike("NaN|Infinity"), F.array_join(quoted, "")).otherwise(body)


def one_value(body: Column) -> Column:
    """The text, or NULL if something follows the object it opens with (the parser would not look at it)."""
    bare = F.array_join(F.transform(_segments(body), lambda x: F.when(F.startswith(x, F.lit('"')), "x").otherwise(x)), "")
    tokens = F.regexp_extract_all(bare, F.lit(r"[{\[]+|[}\]]+|[^\s{}\[\]]+"), F.lit(0))

    def step(a, x):
        up = F.when(F.substring(x, 1, 1).isin("{", "["), F.length(x)).when(F.substring(x, 1, 1).isin("}", "]"), -F.length(x)).otherwise(0)
        return F.struct((a["depth"] + up).alias("depth"), (a["after"] | a["closed"]).alias("after"), (a["depth"] + up <= 0).alias("closed"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("after"), F.lit(False).alias("closed"))
    return F.when(~F.aggregate(tokens, start, step)["after"], body)


def parse_responses(responses: DataFrame, spec: TableSpec, keep: Sequence[str] = ("client", "request", "batch_n")) -> DataFrame:
    """Well-formed rows of responses(..., body): objects holding every feature as a number (also a bare NaN or Infinity) or a
    numeric text. Anything else is dropped; a body that is no JSON or has no row list gives none.
    ``seq`` numbers the surviving rows of a response."""
    v = F.try_parse_json(one_value(quote_literals(clean_body(F.col("body")))))
    rows = F.try_variant_get(v, "$.rows", "array<variant>")
    def field(c):
        # numbers, booleans and numeric texts convert; a missing key gives NULL
        text = F.try_variant_get(F.col("__v"), f"$['{c}']", "string")
        number = F.try_variant_get(F.col("__v"), f"$['{c}']", "double")
        return F.coalesce(number, F.regexp_replace(text, r"^\s+|\s+$", "").try_cast("double"))
    exploded = responses.select(*keep, F.posexplode(rows).alias("__pos", "__v"))
    parsed = exploded.select(*keep, "__pos", *[field(c).alias(c) for c in spec.features])
    ok = parsed.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in spec.features))
    # a response lists at most a few hundred rows, so numbering inside one is a bounded window
    w = F.row_number().over(_window(keep, "__pos"))
    return ok.withColumn("seq", w.cast("bigint")).drop("__pos")


def _window(keys, order):
    from pyspark.sql import Window
    return Window.partitionBy(*keys).orderBy(order)


def take_batch(parsed: DataFrame) -> DataFrame:
    """The first ``batch_n`` rows of every response."""
    return parsed.filter(F.col("seq") <= F.col("batch_n"))


def malformed_counts(requests: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per client: requests, rows asked, rows kept, and sum(max(0, batch_n - parsed)); no re-request."""
    got = parsed.groupBy("client", "request").agg(F.count("*").alias("n_parsed"))
    n = F.coalesce("n_parsed", F.lit(0))
    return (null_safe_join(requests, got, ["client", "request"], "left").groupBy("client")
            .agg(F.count("*").alias("n_requests"), F.sum("batch_n").cast("bigint").alias("n_asked"),
                 F.sum(F.least(F.col("batch_n"), n)).cast("bigint").alias("n_kept"),
                 F.sum(F.greatest(F.lit(0), F.col("batch_n") - n)).cast("bigint").alias("n_malformed_rows_dropped")))


def generation_log(targets: DataFrame, candidates: DataFrame, requests: DataFrame | None = None,
                   model: str | None = None) -> DataFrame:
    """One row per client of ``targets(client, mode, n_pos, n_target)``; 0 where nothing was made."""
    made = candidates.groupBy("client").agg(F.count("*").alias("n_generated"))
    out = null_safe_join(targets, made, ["client"], "left").select(
        "client", "mode", F.col("n_pos").alias("n_real_fraud_used"), F.col("n_target").alias("n_requested"),
        F.coalesce("n_generated", F.lit(0)).cast("bigint").alias("n_generated"))
    if requests is not None:
        out = null_safe_join(out, requests.select("client", "n_requests", "n_malformed_rows_dropped"), ["client"], "left")
        out = out.withColumn("model", F.when(F.col("mode") == MODE_AGGREGATE, F.lit(model)))
    return out
