"""Benchmark decontamination by winnowing; DataFrame functions only.

A text is fingerprinted by the k-grams of its words whose hash is the least in some window of ``w`` neighbouring
k-grams. Both texts of a shared span of ``k + w - 1`` words choose the same k-grams there, so every shared span of
that length has a shared fingerprint. Fingerprints of documents meet those of the benchmark; around each hit the
windows that hold it are then compared word by word with the windows of the items. Hits are looked up, never
paired: a fingerprint or window that very many documents and items share is one row on the benchmark's side.

An item of at least ``window`` words has all its runs of ``window`` words as windows, a shorter one is a single
window. Windows of 5 words and more share one pass (k = 5, w by the shortest of them); shorter items, where there
are any, are one pass for each length, over all k-grams of that length.

Defined results: null and empty texts have no words and no hits; rows with equal texts get equal results, rows that
repeat an identifier are judged one by one; a null item identifier reads as the empty string and item rows with
one identifier are one item; empty tables give no rows (documents) or no hits (benchmark). Only the identifier and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedtab.functions.common import SMALL_BYTES, SMALL_ROWS, fetch_small, stage
from fedtab.llm.wordlists import count_words, runs, spread, words

WINDOW = 10
GRAM = 5
#: Splits of a key on the larger side where the smaller one is not known to fit a broadcast.
SALTS = 16
#: Most bits of the map that is looked at before a hit is joined.
MAX_BITS = 1 << 24


@dataclass(frozen=True)
class Pass:
    """One fingerprint pass: grams of ``gram`` words, least of ``span`` neighbours, windows of the lengths ``sizes``."""
    gram: int
    span: int
    sizes: tuple[int, ...]


def passes(lengths: list[int], gram: int = GRAM) -> list[Pass]:
    """The passes that find windows of these lengths; each guarantees a fingerprint in its shortest window."""
    long = tuple(sorted(n for n in set(lengths) if n >= gram))
    out = [Pass(gram, long[0] - gram + 1, long)] if long else []
    return out + [Pass(n, 1, (n,)) for n in sorted(set(lengths)) if n < gram]


def _grams(w: Column, k: int) -> Column:
    return runs(F.size(w) - (k - 1), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]), "bigint")


def winnow(texts: DataFrame, step: Pass, words_col: str = "words") -> DataFrame:
    """``texts`` with ``__marks``, an array of (h, p): hash and first word of every chosen gram. Of equal least hashes all
    are chosen, so that the choice depends on the words of a window alone."""
    out = texts.withColumn("__grams", _grams(F.col(words_col), step.gram))
    g = F.col("__grams")
    every = F.transform(g, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    if step.span == 1:
        return out.withColumn("__marks", every).drop("__grams")
    out = out.withColumn("__least", runs(F.size(g) - (step.span - 1),
                                         lambda i: F.least(*[F.get(g, i + j) for j in range(step.span)]), "bigint"))
    m = F.col("__least")
    # a gram is chosen where the largest of the minima of the windows around it is its own hash
    chosen = F.filter(every, lambda x: F.greatest(*[F.get(m, x["p"] - j) for j in range(step.span)]) == x["h"])
    return out.withColumn("__marks", chosen).drop("__grams", "__least")


def _limited(table: DataFrame, bytes_of: Column) -> bool:
    """Whether a table of the benchmark's side may be broadcast."""
    n, size = table.limit(SMALL_ROWS + 1).agg(F.count(F.lit(1)), F.sum(bytes_of)).first()
    return n <= SMALL_ROWS and (size or 0) <= SMALL_BYTES


def _meet(left: DataFrame, right: DataFrame, on: str, how: str, bytes_of: Column) -> DataFrame:
    """Join with the benchmark's side: broadcast after a check of its size, else by shuffle with the left keys split."""
    if _limited(right, bytes_of):
        return left.join(F.broadcast(right), on, how)
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (left.withColumn("__salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
            .join(spread, [on, "__salt"], how).drop("__salt"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def item_words(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                            words(F.col(text_col)).alias("words"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item and window, once each: all runs of ``window`` words, or the whole of a shorter item."""
    n, w = F.size("words"), F.col("words")
    all_of = F.when(n <= window, F.array(F.array_join(w, " "))).otherwise(
        runs(n - (window - 1), lambda i: F.array_join(F.slice(w, i + 1, window), " "), "string"))
    return spread(items, ["item"], all_of, "window").distinct()


def _bitmap(marks: DataFrame) -> Callable[[Column], Column]:
    """Test that every mark passes and few other hashes do: a bitmap of some 32 bits a mark, at most MAX_BITS, which
    travels in the plan. It only spares work; what passes is joined with the marks."""
    n = marks.count()
    bits = min(MAX_BITS, max(1 << 12, 1 << (32 * n).bit_length()))
    slot = F.pmod(F.col("h"), F.lit(bits))
    words_set = dict(marks.groupBy(F.shiftright(slot, 6).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int")))).collect())
    table = F.split(F.lit(",".join(str(words_set.get(i, 0)) for i in range(bits >> 6))), ",").cast("array<bigint>")

    def test(h: Column) -> Column:
        at = F.pmod(h, F.lit(bits))
        return F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1
    return test


def hits(docs: DataFrame, items: DataFrame, step: Pass, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """digest, p, first, context: chosen grams of documents that are fingerprints of items of the pass, with the words
    of all windows around them; ``first`` is the place of the first of these words."""
    of_pass = winnow(items.filter(F.least(F.size("words"), F.lit(window)).isin(*step.sizes)), step)
    marks = stage(spread(of_pass, [], F.col("__marks.h"), "h").distinct())
    likely = _bitmap(marks)
    own = docs.select(_digest(F.col(text_col)).alias("digest"), words(F.col(text_col)).alias("words"))
    reach, w = step.sizes[-1] - step.gram, F.col("words")

    def with_context(x: Column) -> Column:
        first = F.greatest(x["p"] - reach, F.lit(0))
        return F.struct(x["h"].alias("h"), x["p"].alias("p"), first.alias("first"),
                        F.slice(w, first + 1, x["p"] - first + step.sizes[-1]).alias("context"))

    seen = winnow(own, step).withColumn("__marks", F.filter("__marks", lambda x: likely(x["h"])))
    found = spread(seen, ["digest"], F.transform("__marks", with_context)).select("digest", "at.*")
    return _meet(found, marks, "h", "left_semi", F.lit(8)).drop("h")


def extend(found: DataFrame, step: Pass, windows: DataFrame) -> DataFrame:
    """digest, s, m, window_id: the windows around hits that are windows of items by all their words, once per text."""
    def around(size: int) -> Column:
        starts = F.sequence(F.greatest(F.col("p") - (size - step.gram), F.col("first")), F.col("p"))
        inside = F.filter(starts, lambda s: s + size <= F.col("first") + F.size("context"))
        return F.transform(inside, lambda s: F.struct(
            s.alias("s"), F.lit(size).alias("m"),
            F.array_join(F.slice("context", s - F.col("first") + 1, size), " ").alias("window")))

    each = spread(found, ["digest"], F.concat(*[around(n) for n in step.sizes])).select("digest", "at.*")
    met = _meet(each, windows, "window", "inner", F.octet_length("window") + 8)
    return met.select("digest", "s", "m", "window_id").distinct()


def _covered(spans: Column) -> Column:
    """Number of places in the union of the spans (s, m)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    grown = F.aggregate(F.array_sort(spans), start, lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["s"] + x["m"] - F.greatest(x["s"], a["end"]))).alias("n"),
        F.greatest(a["end"], x["s"] + x["m"]).alias("end")))
    return grown["n"].cast("bigint")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted identifiers of the items whose windows occur),
    contaminated."""
    light = docs.select(F.col(id_col).alias("doc_id"), _digest(F.col(text_col)).alias("digest"),
                        count_words(F.col(text_col)).alias("n_words"))
    items = stage(item_words(benchmark, item_col, item_text_col)).filter(F.size("words") > 0)
    lengths = [r[0] for r in fetch_small(items.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct())]
    none = F.array().cast("array<string>")
    if not lengths:
        return light.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_hit"), none.alias("items"),
                            F.lit(False).alias("contaminated"))
    plan = passes(lengths, gram)
    of_items = stage(item_windows(items, window))
    windows = stage(of_items.select("window").distinct().withColumn("window_id", F.monotonically_increasing_id()))
    spans = reduce(DataFrame.unionByName, [extend(hits(docs, items, step, window, text_col), step, windows) for step in plan])
    per_text = stage(spans.groupBy("digest").agg(
        _covered(F.collect_set(F.struct("s", "m"))).alias("n_hit"), F.array_sort(F.collect_set("window_id")).alias("ids"))
        .withColumn("set_id", F.sha2(F.array_join("ids", ","), 256)))
    # texts that hit the same windows share one list of items
    sets = per_text.groupBy("set_id").agg(F.first("ids").alias("ids")).select("set_id", F.explode("ids").alias("window_id"))
    owners = windows.join(of_items, "window").select("window_id", "item")
    lists = sets.join(owners, "window_id").groupBy("set_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    verdicts = per_text.select("digest", "n_hit", "set_id").join(lists, "set_id").drop("set_id")
    return (light.join(verdicts, "digest", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                    F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated")))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
  iw AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win
    FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
  dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
    FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
  hit AS (SELECT dw.* FROM dw SEMI JOIN iw USING (m, win)),
  n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
  o AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
    FROM (SELECT DISTINCT doc_id, item FROM hit JOIN iw USING (m, win)) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)"""
