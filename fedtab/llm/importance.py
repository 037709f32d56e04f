"""Importance resampling towards a target distribution.

Texts are bags of hashed word runs. The gain of a bucket is the scaled logarithm of how much likelier the target
draws it than the corpus; a document's weight is the mean gain of its features, looked up in a dense array. Seeded
Gumbel noise on top turns "the highest scores" into a draw without replacement by weight.

The cutoff is found without sorting the corpus: a mergeable quantile sketch gives a bracket of scores, exact counts
outside it confirm that the cutoff lies inside (or widen it), and only the rows of the bracket are sorted. What is
drawn is then ranked over range partitions, each counting from the number of rows before it.

Defined results: null text is empty and has no features, weight 0; a null identifier reads as the empty string in
the noise and is the smallest in ties; rows that repeat an identifier are rows of their own, whose ties are settled by
their place in the staged table; empty tables give no rows (documents) or gains against nothing (target). Only the
identifier and text columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedtab.functions.common import fetch_small, literal_table, stage
from fedtab.llm.wordlists import runs, spread, words

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
SCALE = 1000
#: Accuracy of the sketch: ranks are off by at most rows / ACCURACY.
ACCURACY = 2_000


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("__file").asc(), F.col("__row").asc()]


def buckets(w: Column, size: int = BUCKETS) -> Column:
    """Buckets of all runs of one and two words; repeats count."""
    one = F.transform(w, lambda x: F.pmod(F.crc32(x), F.lit(size)).cast("int"))
    two = runs(F.size(w) - 1, lambda i: F.pmod(F.crc32(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))), F.lit(size)).cast("int"), "int")
    return F.concat(one, two)


def bucket_counts(texts: DataFrame, text_col: str = "text", size: int = BUCKETS) -> list[int]:
    """Occurrences of features in each bucket over whole texts; counted map-side, ``size`` rows at most come back."""
    split = texts.select(words(F.col(text_col)).alias("words"))
    each = spread(split, [], buckets(F.col("words"), size), "bucket")
    out = [0] * size
    for b, n in fetch_small(each.groupBy("bucket").agg(F.count(F.lit(1))), size):
        out[b] = n
    return out


def gains(corpus: list[int], target: list[int], scale: int = SCALE) -> list[int]:
    """Gain of every bucket, smoothed by one count."""
    s_all, t_all, n = sum(corpus), sum(target), len(corpus)
    return [math.floor(scale * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus, target)]


def _floor_div(a: Column, b: Column) -> Column:
    """Whole-number quotient, rounded down."""
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def noise(id_col: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Scaled standard Gumbel noise of an identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def score(docs: DataFrame, gain: list[int], seed: int = SEED, least_words: int = LEAST_WORDS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, eligible of every row; the gains are an array literal of one number a bucket."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    split = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), words(F.col(text_col)).alias("words"))
    marked = split.select("doc_id", F.size("words").alias("n"), buckets(F.col("words"), len(gain)).alias("b"))
    total = F.aggregate("b", F.lit(0).cast("bigint"), lambda a, x: a + F.get(table, x))
    light = marked.select("doc_id", F.size("b").cast("bigint").alias("n_features"), (F.col("n") >= least_words).alias("eligible"),
                          total.alias("total"))
    n = F.col("n_features")
    mean = F.when(n == 0, F.lit(0).cast("bigint")).otherwise(_floor_div(F.col("total"), n))
    return (light.withColumn("weight", mean)
            .select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), "eligible"))


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``rows`` with their place (1, 2, ...) in an order of distinct keys. Range partitions are sorted by themselves; the
    driver sees one count a partition."""
    here = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = sorted(here.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())
    before, table = 0, []
    for p, n in counts:
        table.append((p, before))
        before += n
    offsets = literal_table(rows.sparkSession, table, "__part bigint, __before bigint")
    place = F.col("__before") + F.col("__at") - (F.col("__part") * F.lit(1 << 33)) + 1
    return (here.withColumn("__part", part).join(offsets, "__part").withColumn(name, place)
            .drop("__at", "__part", "__before"))


def bracket(eligible: DataFrame, want: int, total: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """lo, hi, above: scores between which the ``want``-th highest of ``total`` lies, and the exact number above hi."""
    slack = 2.0 / accuracy
    while True:
        share = 1.0 - want / total
        low, high = max(0.0, share - slack), min(1.0, share + slack)
        lo, hi, least, most = _ends(eligible, low, high, accuracy)
        lo, hi = (least if low == 0.0 else lo), (most if high == 1.0 else hi)
        above, inside = eligible.agg(F.count_if(F.col("score") > hi), F.count_if(F.col("score").between(lo, hi))).first()
        if above < want <= above + inside:
            return lo, hi, above
        slack *= 4


def _ends(eligible: DataFrame, low: float, high: float, accuracy: int) -> tuple[int, int, int, int]:
    got = eligible.agg(F.percentile_approx("score", [low, high], accuracy).alias("q"), F.min("score").alias("least"),
                       F.max("score").alias("most")).first()
    return got.q[0], got.q[1], got.least, got.most


def draw(scored: DataFrame, percent: int = PERCENT, accuracy: int = ACCURACY) -> DataFrame:
    """All rows of ``scored`` with ``rank``: floor(percent * n / 100) of the n eligible ones, by score, ties to the smaller
    identifier; null where not drawn."""
    rows = stage(scored).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    eligible = rows.filter("eligible")
    total = eligible.count()
    want = percent * total // 100
    none = rows.withColumn("rank", F.lit(None).cast("bigint"))
    if want == 0:
        return none.drop("__file", "__row", "eligible")
    order = _order()
    lo, hi, above = bracket(eligible, want, total, accuracy)
    inside = ranked(eligible.filter(F.col("score").between(lo, hi)), order)
    cut = inside.filter(F.col("rank") == want - above).first()
    same = F.col("score") == cut.score
    less = F.lit(False) if cut.doc_id is None else F.col("doc_id").isNull() | (F.col("doc_id") < cut.doc_id)
    tie = same & F.col("doc_id").eqNullSafe(F.lit(cut.doc_id).cast("bigint"))
    place = (F.col("__file") < cut["__file"]) | ((F.col("__file") == cut["__file"]) & (F.col("__row") <= cut["__row"]))
    drawn = F.col("eligible") & ((F.col("score") > cut.score) | (same & less) | (tie & place))
    picked = ranked(rows.filter(drawn), order)
    return picked.unionByName(none.filter(~drawn)).drop("__file", "__row", "eligible")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, buckets_n: int = BUCKETS,
             least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text") -> DataFrame:
    """Every row of ``docs``: doc_id, n_features, weight, score, rank."""
    gain = gains(bucket_counts(docs, text_col, buckets_n), bucket_counts(target, target_text_col, buckets_n))
    return draw(score(docs, gain, seed, least_words, id_col, text_col), percent)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
