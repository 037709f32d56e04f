"""Spelling variants: words one edit apart, found by search schemes on bidirectional FM-indexes.

Two words that differ by one inserted, deleted or replaced code point agree in the first half or in the second half
of either of them. Index entries go to the shard of every half that a word one edit away could have, queries to the
shards of their own two halves. A shard builds a bidirectional FM-index over its delimited words, matches the half
exactly and extends across the other one allowing one error. Shards are bounded in characters: a half that many
words share is dealt over several shards, words and queries alike, so no group grows with the vocabulary.

Defined results: null and empty texts have no words; a null identifier reads as the empty string; repeated rows count
again; an empty table gives no rows; ties of the largest count go to the smallest word in code-point order. Only the
identifier and text columns are read. Words of any length are taken whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedtab.functions.common import pin_small, stage
from fedtab.llm.fm_index import WordIndex
from fedtab.llm.wordlists import lower_ascii, spread

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a code point before it is counted; 0: none.
DROP_ONE_IN = 199
SHARD_CHARS = 200_000
#: Queries that move through an index at once.
BATCH = 2_000


def vocabulary(docs: DataFrame, drop_one_in: int = DROP_ONE_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of all words that are long and frequent enough; counts combine map-side."""
    run_list = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(RUN), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run_list.alias("runs"))
    each = spread(rows, ["id"], F.col("runs"), "run").filter(F.length("run") >= LEAST_LETTERS)
    word = F.col("run")
    if drop_one_in:
        h, n = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run"))), F.length("run")
        at = F.pmod(h, n).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, n))
        word = F.when(F.pmod(h, F.lit(drop_one_in)) == 0, cut).otherwise(word)
    return (each.select(word.alias("word")).filter(F.length("word") >= LEAST_LETTERS).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT))


def _entries(vocab: DataFrame) -> DataFrame:
    """side, half, word, n: every half by which a word one edit away could look for the word."""
    n = F.length("word")
    lengths = F.filter(F.array(n - 1, n, n + 1), lambda x: x >= LEAST_LETTERS)
    heads = F.array_distinct(F.transform(lengths, lambda x: F.substring("word", F.lit(1), F.floor(x / 2).cast("int"))))
    tails = F.array_distinct(F.transform(lengths, lambda x: F.substring(
        "word", n - F.ceil(x / 2).cast("int") + 1, F.ceil(x / 2).cast("int"))))
    sides = [vocab.select(F.lit(k).alias("side"), F.explode(a).alias("half"), "word", "n") for k, a in enumerate((heads, tails))]
    return sides[0].unionByName(sides[1])


def _queries(vocab: DataFrame) -> DataFrame:
    h = F.floor(F.length("word") / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), h).alias("half")),
                     F.struct(F.lit(1).alias("side"), F.substring("word", h + 1, F.length("word")).alias("half")))
    return vocab.select(F.explode(halves).alias("x"), "word", "n").select("x.side", "x.half", "word", "n")


def _search(shard: pd.DataFrame) -> pd.DataFrame:
    """Per query of the shard: number of near words found here, and the best of them."""
    out: dict[str, list] = {}
    words = shard.loc[~shard["query"], ["word", "n"]].drop_duplicates("word").sort_values("word")
    asked = shard.loc[shard["query"], ["side", "word"]]
    if len(words) and len(asked):
        index, counts = WordIndex(list(words["word"])), list(words["n"])
        for side in (0, 1):
            queries = list(asked.loc[asked["side"] == side, "word"])
            find = index.near_by_second_half if side else index.near_by_first_half
            for at in range(0, len(queries), BATCH):
                batch = queries[at:at + BATCH]
                for q, w in zip(*(x.tolist() for x in find(batch))):
                    query, word, n = batch[q], index.words[w], counts[w]
                    if side and word.startswith(query[:len(query) // 2]):
                        continue  # found by its first half as well
                    best = out.setdefault(query, [0, n, word])
                    best[0] += 1
                    if (-n, word) < (-best[1], best[2]):
                        best[1:] = n, word
    return pd.DataFrame([(q, *b) for q, b in out.items()], columns=["word", "found", "best_n", "best"])


def near_words(vocab: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """word, n_near, best, best_n of the words of ``vocab`` (word, n; words distinct) that have a near word."""
    entries, queries = _entries(vocab), _queries(vocab)
    load = entries.groupBy("side", "half").agg(F.sum(F.length("word") + 1).alias("load"))
    total = load.agg(F.sum("load")).first()[0] or 0
    shards = max(1, -(-total // shard_chars))
    # at most total / shard_chars halves are as large as a shard
    hot = pin_small(load.filter(F.col("load") > shard_chars)
                    .select("side", "half", F.ceil(F.col("load") / shard_chars).cast("int").alias("parts")))

    def dealt(rows: DataFrame, is_query: bool) -> DataFrame:
        own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
        parts = F.sequence(F.lit(0), F.col("parts") - 1)
        pair: Column = F.transform(parts, lambda i: F.struct(i.alias("w"), own.alias("q")) if is_query
                                   else F.struct(own.alias("w"), i.alias("q")))
        place = F.when(F.col("parts").isNull(), F.concat_ws(":", "side", F.pmod(F.xxhash64("half"), F.lit(shards)))).otherwise(
            F.concat_ws(":", "side", "at.w", "at.q", "half"))
        return (rows.join(hot, ["side", "half"], "left")
                .withColumn("at", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(None).cast("struct<w:int,q:int>"))).otherwise(pair)))
                .select(place.alias("shard"), F.lit(is_query).alias("query"), "side", "word", "n"))

    found = (dealt(entries, False).unionByName(dealt(queries, True)).groupBy("shard")
             .applyInPandas(_search, "word string, found bigint, best_n bigint, best string"))
    return (found.groupBy("word").agg(F.sum("found").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
            .select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n")))


def roots(links: DataFrame) -> DataFrame:
    """word and root for links (word, form): forms followed to the last one, by doubling; no cycles."""
    now = stage(links.select("word", F.col("form").alias("root")))
    while True:
        step = now.alias("a").join(now.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        now = stage(step.select(F.col("a.word").alias("word"), F.coalesce("b.root", "a.root").alias("root"),
                                F.col("b.root").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, drop_one_in: int = DROP_ONE_IN, id_col: str = "doc_id", text_col: str = "text",
             shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Every word of the vocabulary: word, n, n_near, form, form_n, root."""
    vocab = stage(vocabulary(docs, drop_one_in, id_col, text_col))
    near = near_words(vocab, shard_chars)
    is_form = F.col("best_n") >= F.col("n") * RATIO
    out = stage(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    return (out.join(roots(out.filter("form IS NOT NULL").select("word", "form")), "word", "left")
            .withColumn("root", F.coalesce("root", "word")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("word", "form", "root", "n", "n_near", "form_n")
