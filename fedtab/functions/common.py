"""Small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SMALL_ROWS = 100_000
SMALL_BYTES = 64 << 20


def work_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint dir, else (local mode) a temp dir."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="fedtab-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write a row-scale intermediate to the shared folder and read it back: the lineage ends
    there, and a lost executor costs a re-read instead of a recompute."""
    path = new_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin_small(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """Evaluate a per-client sized table once and hand it back ready to broadcast.

    The size is proven by fetching at most ``max_rows + 1`` rows. A larger table is staged and
    returned without a hint, so Spark shuffles it like any other join side.
    """
    spark = df.sparkSession
    got = df.limit(max_rows + 1).toArrow()
    if got.num_rows > max_rows or got.nbytes > max_bytes:
        return stage(df)
    schema = _nullable(df.schema)
    local = pa.Table.from_pylist(got.to_pylist(), schema=to_arrow_schema(schema))
    return F.broadcast(spark.createDataFrame(local, schema=schema))


def _nullable(kind):
    """The same type with every field, element and map value nullable."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType), True)
    return kind


def fetch_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> list:
    """Rows of a table that is small by meaning (one row per client, column, ...); checked."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"expected at most {max_rows} rows")
    return rows


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match; the keys of the left side are kept."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small dimension written down in code; broadcast because its size is the literal's."""
    return F.broadcast(spark.createDataFrame(rows, T.StructType.fromDDL(schema)))


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str],
            name: str = "column", value: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(ids), list(columns), name, value)


def column_order(columns: Sequence[str], col: str | Column) -> Column:
    """Position of a column name in the feature list (1-based)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_position(F.array(*[F.lit(x) for x in columns]), c)
