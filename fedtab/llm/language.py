"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams, most frequent first. A document is given the
language whose profile is nearest by out-of-place distance: the sum, over the document's own profile, of how
far an n-gram's rank is from its rank in the language's profile, or the largest distance when it is not there.

N-grams are runs of one to three letters (by Unicode, lower-cased) of a word with one blank at either side.
Profiles are learned from a sample of labelled documents of about ``SAMPLE_PER_LANGUAGE`` a language, drawn by a
hash of the identifier; the counts are summed by Spark. ``score`` is one minus the distance over the largest
possible one.

Defined results: a null text or one without a letter is ``und`` with score 0; equal distances go to the language
that is first by name; equal counts rank by the n-gram; rows without an identifier are not learned from; with
nothing to learn from every document is ``und``; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedtab.functions.common import pin_small

UNKNOWN = "und"
DOC_GRAMS = 300
PROFILE_GRAMS = 400
SAMPLE_PER_LANGUAGE = 2000
#: The filter of the pipeline: 51,282 documents of 7 to 100,000 letters score 0.398 and more, random letters of 16 and more
#: at most 0.27, base64 at most 0.25.
LEAST_SCORE = 0.30
_BLANK = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter(((c < 0xD800 or c > 0xDFFF) and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, packed 21 bits a character, in rising order, and how often each occurs."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first character after a word becomes its blank
    codes = np.where(letter, codes, _BLANK)[kept]
    codes = np.concatenate(([_BLANK] if codes[0] != _BLANK else [], codes, [_BLANK] if codes[-1] != _BLANK else [])).astype(np.int64)
    word = codes != _BLANK
    two = (codes[:-1] << 21) | codes[1:]
    three = ((two[:-1] << 21) | codes[2:])[word[1:-1]]
    return np.unique(np.concatenate((codes[word], two, three)), return_counts=True)


def own_profile(text: str | None, size: int = DOC_GRAMS) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first."""
    grams, counts = gram_counts(text)
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")][:size]


def fold(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string")) % folds


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE_PER_LANGUAGE, size: int = PROFILE_GRAMS) -> list[tuple[str, list[int]]]:
    """Language profiles (name, packed n-grams in order of rank) of labelled documents.

    What reaches the driver is ``size`` n-grams a language.
    """
    light = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    # one row a language: broadcast, so the draw is a filter on the scan and no text is shuffled
    rates = pin_small(light.groupBy(F.col(lang_col).alias("__lang")).agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("__rate")))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) / 1e6
    drawn = light.join(rates, F.col(lang_col) == F.col("__lang")).filter(draw < F.col("__rate"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, tuple[list, list]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams, counts = gram_counts(text.as_py())
                held = total.setdefault(lang, ([], []))
                held[0].append(grams)
                held[1].append(counts)
            for lang, (grams, counts) in total.items():
                distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
                sums = np.bincount(inverse, np.concatenate(counts)).astype(np.int64) if len(distinct) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct)), pa.array(distinct), pa.array(sums)],
                                                 names=["lang", "gram", "n"])

    totals = (drawn.select(F.col("__lang").alias("lang"), F.col(text_col).alias("text"))
              .mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = totals.withColumn("rank", rank).filter(F.col("rank") <= size).groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("grams")).orderBy("lang").collect()
    return [(r.lang, [g.gram for g in r.grams]) for r in rows]


class Judge:
    def __init__(self, profiles: list[tuple[str, list[int]]], size: int = PROFILE_GRAMS):
        self.names = [n for n, _ in profiles]
        self.grams = np.unique(np.concatenate([np.asarray(g, np.int64) for _, g in profiles])) if profiles else np.empty(0, np.int64)
        self.far = size
        self.ranks = np.full((len(self.grams) + 1, len(profiles)), -1, np.int64)  # last row: unknown to all
        for k, (_, grams) in enumerate(profiles):
            self.ranks[np.searchsorted(self.grams, grams), k] = np.arange(len(grams))

    def __call__(self, text: str | None) -> tuple[str, float]:
        own = own_profile(text)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == own, at, len(self.grams))
        ranks = self.ranks[at]
        out = np.where(ranks < 0, self.far, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), self.far)).sum(axis=0)
        best = int(out.argmin())
        return self.names[best], 1.0 - float(out[best]) / (self.far * len(own))


def identify(docs: DataFrame, profiles: list[tuple[str, list[int]]], text_col: str = "text",
             lang_name: str = "lang_pred", score_name: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = Judge(profiles)
        for batch in batches:
            found = [decide(x.as_py()) for x in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()),
                                              pa.array([x for _, x in found], pa.float64())],
                                             names=[*batch.schema.names, lang_name, score_name])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    return docs.mapInArrow(judge, schema)


def keep_known(docs: DataFrame, profiles: list[tuple[str, list[int]]], least: float = LEAST_SCORE) -> DataFrame:
    """Rows whose language is known; ``und`` and texts unlike every learned language go."""
    judged = identify(docs, profiles, lang_name="__lang_pred", score_name="__lang_score")
    return judged.filter((F.col("__lang_pred") != UNKNOWN) & (F.col("__lang_score") >= least)).select(*docs.columns)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(fold("doc_id", 3) != 1)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(training_rows(docs))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return (identify(docs.select("doc_id", "text"), profiles, score_name="score")
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))
