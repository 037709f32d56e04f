"""Exact deduplication as a stateful stream: keyed state on disk that never expires.

Arrivals carry the SHA-256 of the whole text, the row's identifier and a content locator (file and row). The
state holds, per digest, the identifier and locator of the row that stays and the number of rows seen. Rows
whose digest was seen more than once ("hits") are then compared byte by byte with the rest of their digest, so
equal digests of different texts would be told apart. DataFrame functions only.

Defined results: null text counts as the empty text; an empty table gives an empty result; a null identifier
is smaller than any other; of rows that repeat identifier and text, the one with the larger locator stays, so
one row of a group is kept however often it repeats. Other columns of the input are not looked at.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedtab.functions.common import new_path, stage

#: Hit digests are broadcast up to this many (32 bytes each), else joined by shuffle.
BROADCAST_KEYS = 1_000_000
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no space reserved ahead per small store
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__file`` and ``__row``, the place of each row; a table that is not read from Parquet is
    written to the shared folder first."""
    if {"__file", "__row"} <= set(docs.columns):
        return docs
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    try:
        return docs.select("*", *place)
    except AnalysisException:
        return stage(docs).select("*", *place)


def arrivals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One light row per document: identifier, digest, locator."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), "__file", "__row")


def stream_state(stream: DataFrame, checkpoint: str, updates: str) -> None:
    """Feeds a stream of arrivals to the keyed state until what is there now is consumed.

    Each micro-batch writes the digests it changed to ``updates``; a batch that is replayed overwrites its own
    folder. A later call with the same ``checkpoint`` goes on from the kept state.
    """
    seen = stream.groupBy("digest").agg(F.max(F.struct("id", "__file", "__row")).alias("keep"),
                                        F.count(F.lit(1)).alias("group_size"))

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={n}")

    with _settings(stream.sparkSession, _STATE_CONF):
        (seen.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())


def current_state(spark: SparkSession, updates: str) -> DataFrame:
    """The last state of every digest; sizes and kept rows only grow, so the last one is the largest."""
    schema = "digest binary, keep struct<id: bigint, __file: string, __row: bigint>, group_size bigint, batch int"
    return (spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(updates)
            .groupBy("digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size")))


def colliding(docs: DataFrame, state: DataFrame, text_col: str = "text") -> DataFrame:
    """Digests whose rows do not all have the same bytes, found by comparing the full texts of all hits.

    The extremes of a digest's texts are combined before the shuffle, so thousands of copies of one text
    travel as one row a task.
    """
    hits = state.filter("group_size > 1").select("digest")
    if hits.count() <= BROADCAST_KEYS:
        hits = F.broadcast(hits)
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return (full.join(hits, "digest", "left_semi").groupBy("digest")
            .agg(F.min("text").alias("lo"), F.max("text").alias("hi")).filter("lo <> hi").select("digest"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, __file, __row."""
    spark = docs.sparkSession
    docs = located(docs)
    light = new_path(spark, "arrivals")
    rows = arrivals(docs, id_col, text_col).withColumn("id", F.col("id").cast("bigint"))
    rows.write.parquet(light)
    rows = spark.read.schema(rows.schema).parquet(light)
    updates = new_path(spark, "dedup-updates")
    if rows.isEmpty():
        state = spark.createDataFrame([], "digest binary, keep struct<id: bigint, __file: string, __row: bigint>, "
                                          "group_size bigint")
    else:
        stream_state(spark.readStream.schema(rows.schema).parquet(light), new_path(spark, "dedup-state"), updates)
        state = stage(current_state(spark, updates))
    clash = colliding(docs, state, text_col)
    out = rows.join(state, "digest")
    if not clash.isEmpty():
        clash = stage(clash)
        text = F.coalesce(F.col(text_col), F.lit(""))
        apart = (docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"),
                             "__file", "__row", text.alias("text")).join(clash, "digest", "left_semi"))
        groups = apart.groupBy("digest", "text").agg(F.max(F.struct("id", "__file", "__row")).alias("keep"),
                                                     F.count(F.lit(1)).alias("group_size"))
        out = (out.join(clash, "digest", "left_anti")
               .unionByName(apart.join(groups, ["digest", "text"]).drop("text")))
    same = (F.col("keep.__file") == F.col("__file")) & (F.col("keep.__row") == F.col("__row"))
    return out.select("id", F.col("keep.id").alias("keep_id"), "group_size", same.alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"), "__file", "__row")


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    columns = docs.columns
    docs = located(docs)
    # those that go are the fewer; written, their size is known and Spark picks the join by it
    gone = stage(decide(docs, id_col, text_col).filter("NOT kept").select("__file", "__row"))
    return docs.join(gone, ["__file", "__row"], "left_anti").select(*columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decide(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
