"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's logit is the bias plus the weights of the hashed features of its
distinct words (the word and its character five-grams, so that compounds of a stem are seen); a document is toxic when at
least one sentence is: ``p = 1 - (1 - leak) * prod(1 - p_sentence)`` (noisy-or). The leak is the logistic function
of the bias, once a document; a sentence adds what it has beyond it, ``1 - p_sentence = (1 + e^bias) / (1 +
e^logit)``, so that a long text without evidence scores like a short one. Only document labels are needed to train: the
gradient of the document's likelihood is shared out over its sentences by their own scores. The same sentence
scores then locate the offending sentences.

The model is fitted on a bounded sample: up to ``TOXIC_ROWS`` labelled documents of label 1 and ``CLEAN_ROWS`` of
label 0, drawn by a hash of the identifier until ``TOXIC_CHARS`` and ``CLEAN_CHARS`` characters are full, each whole. The sample is fitted
in one task; scoring runs over all rows and whole texts.

Defined results: null and empty texts have no sentence and the score of the leak alone; a label other than 0 and 1
is not learned from; a document labelled more than once counts as its largest label; rows without an identifier
are scored but not learned from; without both labels every score is the leak of the first bias, below one half.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedtab.functions.common import fetch_small
from fedtab.llm.encode import PieceCache
from fedtab.llm.language import fold

BUCKETS = 1 << 20
GRAM = 5
TOXIC_ROWS = 4_000
CLEAN_ROWS = 6_000
#: Characters of the sample by label; a document is taken whole or not at all.
TOXIC_CHARS, CLEAN_CHARS = 16_000_000, 24_000_000
#: Documents of each label that are taken whatever their length.
LEAST_EACH = 5
ROUNDS = 60
RATE = 0.2
SPARSITY = 2e-4
LEAST_DOCUMENTS = 5
FIRST_BIAS = -6.0
THRESHOLD = 0.5
#: Items that a sum of the fit holds at once.
RUN = 1 << 18
_SENTENCE = re.compile(r"[.!?\n]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s.strip()]


def word_features(piece: str) -> list[int]:
    """Buckets of a piece's words: each word whole, and its five-grams with its ends marked."""
    out = []
    for word in _LETTERS.findall(piece.lower()):
        fenced = f"^{word}$"
        grams = {fenced[i:i + GRAM] for i in range(max(1, len(fenced) - GRAM + 1))} | {f"={word}"}
        out += [zlib.crc32(g.encode()) % BUCKETS for g in grams]
    return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


class Lists:
    """Lists of small integers, one behind the other, 32 bits each. Sums go over runs of whole lists of about ``RUN`` items,
    so that nothing of the full length is made beside them; each sum adds in the order of the items."""

    def __init__(self, items: array | np.ndarray, lengths: np.ndarray):
        self.items, self.lengths = np.frombuffer(items, np.int32), lengths
        self.ends = np.cumsum(lengths)

    def _runs(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Numbers of the lists of a run, and its items."""
        first = at = 0
        while first < len(self.ends):
            last = max(first + 1, int(np.searchsorted(self.ends, at + RUN, "right")))
            yield slice(first, last), self.items[at:self.ends[last - 1]].astype(np.intp)
            first, at = last, int(self.ends[last - 1])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each list the sum of its items' values."""
        out = np.zeros(len(self.lengths))
        for run, items in self._runs():
            n = run.stop - run.start
            out[run] = np.bincount(np.repeat(np.arange(n), self.lengths[run]), values[items], n)
        return out

    def spread(self, values: np.ndarray, size: int) -> np.ndarray:
        """Of each item the sum of the values of the lists it is in."""
        out = np.zeros(size)
        for run, items in self._runs():
            np.add.at(out, items, np.repeat(values[run], self.lengths[run]))
        return out

    def only(self, kept: np.ndarray) -> Lists:
        """The lists without the items that are not kept; those are numbered anew."""
        number = (np.cumsum(kept) - 1).astype(np.int32)
        parts = [number[items[kept[items]]] for _, items in self._runs()]
        return Lists(np.concatenate(parts), self.sums(kept).astype(np.int64))


def _read(rows: Iterable[tuple[str, int]]) -> tuple[Lists, Lists, np.ndarray, np.ndarray]:
    """Words of each sentence, features of each word, the documents' numbers of sentences, and their labels."""
    vocabulary: dict[str, int] = {}
    words, features = array("i"), array("i")
    sentence_lengths, word_lengths, document_lengths, labels = array("q"), array("q"), array("q"), array("d")
    for text, label in rows:
        found = sentences(text)
        for s in found:
            distinct = dict.fromkeys(s.split())
            for w in distinct:
                if (k := vocabulary.setdefault(w, len(vocabulary))) == len(word_lengths):
                    listed = word_features(w)
                    features.extend(listed)
                    word_lengths.append(len(listed))
                words.append(k)
            sentence_lengths.append(len(distinct))
        document_lengths.append(len(found))
        labels.append(label)
    of_sentence, of_word = Lists(words, np.frombuffer(sentence_lengths, np.int64)), Lists(features, np.frombuffer(word_lengths, np.int64))
    return of_sentence, of_word, np.frombuffer(document_lengths, np.int64), np.frombuffer(labels)


def fit(rows: Iterable[tuple[str, int]], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias, by Adam on the noisy-or likelihood of whole documents (text, label), which are read
    once, one by one.

    Weights are evidence for toxicity only (not below zero), so harmless words around it cannot hide it; small
    ones are drawn to zero, and buckets seen in fewer than ``LEAST_DOCUMENTS`` documents stay there.
    """
    words, features, document_lengths, y = _read(rows)
    weights = np.zeros(BUCKETS)
    if not len(features.lengths):
        return weights, FIRST_BIAS
    document_of = np.repeat(np.arange(len(y)), document_lengths)
    seen, at = np.zeros(len(features.lengths)), 0  # documents by word
    for end in np.concatenate(([0], words.ends))[np.cumsum(document_lengths)]:
        seen[np.unique(words.items[at:end])] += 1
        at = end
    common = features.spread(seen, BUCKETS) >= LEAST_DOCUMENTS
    # other buckets keep the weight 0; a word of none but them adds nothing to a sentence
    features = features.only(common)
    told = features.lengths > 0
    words, features = words.only(told), Lists(features.items, features.lengths[told])
    share = np.where(y > 0, 0.5 / max(1.0, (y > 0).sum()), 0.5 / max(1.0, (y == 0).sum())) * len(y)  # both labels weigh alike
    size, bias = int(common.sum()), FIRST_BIAS
    w, m, v, mb, vb = np.zeros(size), np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = bias + words.sums(features.sums(w))
        # minus the log of the chance that nothing is toxic
        none = _softplus(bias) + np.bincount(document_of, _softplus(z) - _softplus(bias), len(y))
        pull = np.where(y > 0, -1.0 / np.expm1(np.clip(none, 1e-9, 50.0)), 1.0) * share
        g = pull[document_of] / (1.0 + np.exp(-z))
        grad = features.spread(words.spread(g, len(features.lengths)), size) / len(y) + SPARSITY
        grad_bias = float(g.sum() + ((1 - np.bincount(document_of, minlength=len(y))) * pull).sum() / (1.0 + np.exp(-bias))) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_bias, 0.99 * vb + 0.01 * grad_bias ** 2
        step = RATE / (1 - 0.9 ** t)
        w = np.maximum(w - step * m / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6), 0.0)
        bias -= step * mb / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-6)
    weights[common] = w
    return weights, bias


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic") -> DataFrame:
    """text and label of the bounded sample: at most ``TOXIC_ROWS + CLEAN_ROWS`` labelled documents, drawn by the hash of
    their identifiers until ``TOXIC_CHARS`` and ``CLEAN_CHARS`` characters are full. Texts are whole; one that is longer
    than what is left is passed over, but for the first ``LEAST_EACH`` of a label."""
    known = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label")))
    order = [F.xxhash64(F.col("__id").cast("string")), "__id"]
    drawn = (known.filter("__label = 1").orderBy(*order).limit(TOXIC_ROWS)
             .unionByName(known.filter("__label = 0").orderBy(*order).limit(CLEAN_ROWS)))
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    sizes = texts.join(F.broadcast(drawn), "__id").groupBy("__id", "__label").agg(F.sum(F.length("text")).alias("chars"))
    left, taken, chosen = {0: CLEAN_CHARS, 1: TOXIC_CHARS}, {0: 0, 1: 0}, []
    for i, y, chars in fetch_small(sizes.orderBy(*order).select("__id", "__label", "chars"), TOXIC_ROWS + CLEAN_ROWS):
        if chars <= left[y] or taken[y] < LEAST_EACH:
            chosen.append((i, y))
            left[y] -= chars
            taken[y] += 1
    schema = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("label", T.IntegerType())])
    picked = docs.sparkSession.createDataFrame(chosen, schema)
    return texts.join(F.broadcast(picked), "__id").select("__id", "text", "label").dropDuplicates(["__id", "text"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Fits in one executor task, which reads the sample in Spark's order; the weights (32 bits each) are what comes back."""
    sample = training_sample(docs, labels, id_col, text_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = fit((t.as_py(), y.as_py()) for b in batches for t, y in zip(*b.columns))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([bias])], names=["weights", "bias"])

    ordered = sample.repartition(1).sortWithinPartitions(F.col("__id").cast("string"), "text").select("text", "label")
    row = ordered.mapInArrow(run, "weights binary, bias double").first()
    return (np.frombuffer(row.weights, np.float32), row.bias) if row else (np.zeros(BUCKETS, np.float32), FIRST_BIAS)


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.cache = weights, bias, PieceCache(200_000)

    def _make(self, pieces: list[str]) -> list[float]:
        # a piece that the cache marks with a space or a start: only its letters matter
        return [float(self.weights[f].sum()) if (f := word_features(p)) else 0.0 for p in pieces]

    def logits(self, texts: list[str | None]) -> list[np.ndarray]:
        """The logit of every sentence of each text."""
        split = [[list(dict.fromkeys(s.split())) for s in sentences(t)] for t in texts]  # each piece counts once a sentence
        young, large = self.cache.fill({w for x in split for s in x for w in s}, self._make)
        get = (lambda w: young[w] if w in young else large[w]) if large else young.__getitem__
        return [np.asarray([self.bias + sum(map(get, s)) for s in x]) for x in split]

    def score(self, logits: np.ndarray) -> float:
        """Noisy-or of the leak and the sentences."""
        return float(-np.expm1(-_softplus(self.bias) - self.hazards(logits).sum()))

    def hazards(self, logits: np.ndarray) -> np.ndarray:
        """Minus the log of the chance that a sentence is not toxic."""
        return np.maximum(_softplus(logits) - _softplus(self.bias), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", name: str = "score",
          where_name: str | None = None) -> DataFrame:
    """``docs`` with the score of each text and, if ``where_name`` is given, the offending sentences (their
    numbers, from 0, and scores, those of at least one half, worst first)."""
    weights, bias = model[0], float(model[1])
    spans = "array<struct<sentence:int,score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, bias)
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                logits = scorer.logits([x.as_py() for x in batch.column(text_col)])
                extra = [pa.array([scorer.score(z) for z in logits], pa.float64())]
                if where_name:
                    found = [sorted(((i, float(p)) for i, p in enumerate(-np.expm1(-scorer.hazards(z))) if p >= THRESHOLD), key=lambda x: (-x[1], x[0]))
                             for z in logits]
                    extra.append(pa.array([[{"sentence": i, "score": p} for i, p in f] for f in found],
                                          pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64())]))))
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, name, *([where_name] if where_name else [])])

    fields = [*docs.schema.fields, T.StructField(name, T.DoubleType())]
    if where_name:
        fields.append(T.StructField(where_name, T.DataType.fromDDL(spans)))
    return docs.mapInArrow(run, T.StructType(fields))


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Rows that are not judged toxic."""
    return score(docs, model, name="__toxic_score").filter(F.col("__toxic_score") < THRESHOLD).select(*docs.columns)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(fold("doc_id", 5) != 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return (score(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
