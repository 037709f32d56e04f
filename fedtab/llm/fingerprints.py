"""Document fingerprints by randomised edit embedding.

All texts are walked with the same random bits: at step j the walk puts out the character it stands on and moves on
if the bit of (j, character) is set. Walks over texts that differ by few edits fall into step again after each
edit, so the edit distance of the texts shows as the Hamming distance of what is put out. A fingerprint samples
the output: step j is sampled at level l when a hash of j ends in l zero bits, and a text's level follows its
length so that 128 to 256 steps are expected (fewer for short texts). Samples of a level are among those of
every lower one, so texts of different length compare at the higher level. A sample is four bits of its character.

``likeness`` is the share of samples that agree, corrected for chance agreement (1/16), from 0 to 1.
Near-duplicates are found by banding: a band is the samples at a few positions; documents that share a band are
verified by likeness.

Defined results: a null text is the empty text, whose fingerprint has no samples (likeness 1 to another empty
text, 0 to any other); equal texts have equal fingerprints; rows that repeat an identifier follow each other in the
order of their texts' hash; null identifiers come last in descending order; a lone document is its own next
one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedtab.functions.common import stage
from fedtab.llm.components import components
from fedtab.llm.shingles import mix

SAMPLES = 128
PERIOD, KINDS = 4096, 1024
SLICE_ROWS, SLICE_CHARS = 1000, 4 << 20
FEW = 12
BANDS, BAND_WIDTH = 24, 8
BLOCK = 1024
BITS = np.random.default_rng(20240608).integers(0, 2, (PERIOD, KINDS), dtype=np.uint8)
_FOUR_BITS = (mix(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(33)).astype(np.uint8) & np.uint8(15)
_ZEROS: dict[str, np.ndarray] = {}


def _zeros(n: int) -> np.ndarray:
    """For steps below n: how many zero bits the hash of the step ends in."""
    if len(_ZEROS.get("z", ())) < n:
        h = mix(np.arange(max(n, 1 << 16), dtype=np.uint64) + np.uint64(77))
        _ZEROS["z"] = np.bitwise_count(~h & (h - np.uint64(1))).astype(np.uint8)
    return _ZEROS["z"]


def level_of(n_chars: int) -> int:
    """A walk takes about two steps a character."""
    return max(0, (n_chars // SAMPLES).bit_length())


@lru_cache(maxsize=64)
def _positions(level: int) -> np.ndarray:
    """The first sampled steps of a level, more than any text of the level uses."""
    return np.flatnonzero(_zeros(12 * SAMPLES << level) >= level)


def _walk_one(codes: np.ndarray, i: int, j: int, level: int, zeros: np.ndarray, rows: list[int]) -> None:
    """The rest of one walk, sample by sample of its level; puts the sampled characters into ``rows``."""
    n = len(codes)
    kinds = (codes % KINDS).tolist()
    bits = _bit_rows()
    while i < n:
        if zeros[j] >= level:
            rows.append(int(codes[i]))
        i += bits[j % PERIOD][kinds[i]]
        j += 1


@lru_cache(maxsize=1)
def _bit_rows() -> list[bytes]:
    return [r.tobytes() for r in BITS]


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of each text; texts are walked together, the longest few to their end one by one."""
    lengths = np.asarray([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    all_codes = np.frombuffer("".join(texts[k] for k in order).encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64) if len(texts) else np.empty(0, np.int64)
    kinds = (all_codes % KINDS).astype(np.int64)
    levels = np.asarray([level_of(int(n)) for n in size], np.int64)
    stop = first + size
    at = first.copy()
    zeros = _zeros(int(6 * size[0]) + 4096 if len(size) else 1)
    live = np.flatnonzero(at < stop)
    sampled_rows, sampled_codes = [], []
    j = 0
    place, end, level = at[live], stop[live], levels[live]
    starts_at = np.searchsorted(-level, -np.arange(64)).tolist()  # levels fall with the length
    while len(place) > FEW:
        a = starts_at[zeros[j]]
        if a < len(place):
            sampled_rows.append(live[a:])
            sampled_codes.append(all_codes[place[a:]])
        place = place + BITS[j % PERIOD].take(kinds.take(place))
        j += 1
        if (place >= end).any():
            going = place < end
            live, place, end, level = live[going], place[going], end[going], level[going]
            starts_at = np.searchsorted(-level, -np.arange(64)).tolist()
    got: list[list] = [[] for _ in texts]
    if sampled_rows:
        rows, codes = np.concatenate(sampled_rows), np.concatenate(sampled_codes)
        by = np.argsort(rows, kind="stable")
        cuts = np.searchsorted(rows[by], np.arange(len(texts) + 1))
        codes = codes[by]
        for k in range(len(texts)):
            got[k] = codes[cuts[k]:cuts[k + 1]].tolist()
    for k, p, lv in zip(live.tolist(), place.tolist(), level.tolist()):
        _walk_one(all_codes[first[k]:stop[k]], p - int(first[k]), j, lv, zeros, got[k])
    out = [""] * len(texts)
    for k, original in enumerate(order.tolist()):
        four = _FOUR_BITS[np.asarray(got[k], np.int64) & 0xFFFF]
        out[original] = f"{levels[k]:02x}." + "".join(map("0123456789abcdef".__getitem__, four.tolist()))
    return out


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    level_a, level_b = int(a[:2], 16), int(b[:2], 16)
    top = max(level_a, level_b)
    x, y = (_at_level(f[3:], lv, top) for f, lv in ((a, level_a), (b, level_b)))
    longest = max(len(x), len(y))
    if not longest:
        return 0.0
    n = min(len(x), len(y))
    agree = int((x[:n] == y[:n]).sum()) / longest
    return max(0.0, (agree - 1 / 16) / (15 / 16))


def _at_level(samples: str, level: int, top: int) -> np.ndarray:
    s = np.frombuffer(samples.encode(), np.uint8)
    if level == top:
        return s
    return s[_zeros(1)[_positions(level)[:len(s)]] >= top]


def fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(a, SLICE_ROWS)
                found = fingerprints([x or "" for x in batch.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def in_chains(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, block, ahead: the documents by descending identifier in blocks of one sorted stretch each,
    every block followed by the first document of the next one (``ahead``), the last by the first of all.

    Block limits are identifiers found in the data, so the first document of a block is known beforehand; their
    number goes with the number of shuffle partitions. Texts are shuffled once.
    """
    spark = docs.sparkSession
    light = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    top, limits = light.agg(F.max("doc_id"), F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts)).first()
    limits = sorted({x for x in limits or [] if x != top})
    bounds = F.array(*map(F.lit, limits)).cast("array<bigint>")
    here = F.size(F.filter(bounds, lambda b: F.coalesce(F.col("doc_id") <= b, F.lit(True))))  # 0 for the largest identifiers
    before = F.when(F.col("doc_id").isin(limits), here - 1).when(F.lit(bool(limits)) & (F.col("doc_id") == F.lit(top)), F.lit(len(limits)))
    places = F.filter(F.array(F.struct(here.alias("block"), F.lit(False).alias("ahead")), F.struct(before.alias("block"), F.lit(True).alias("ahead"))),
                      lambda p: p["block"].isNotNull())
    keys = ["block", "ahead", F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    return (light.withColumn("place", F.explode(places)).select("doc_id", "text", "place.block", "place.ahead")
            .repartition("block").sortWithinPartitions(*keys))


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: fingerprints of its text and of the text with its last third replaced by the beginning
    of the next document, and how alike they and the next document's fingerprint are."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def results(rows: list[tuple], final: tuple | None) -> pa.RecordBatch | None:
        """Rows of all but the last of ``rows``, or of all when ``final`` follows the last."""
        chain = rows + [final] if final else rows
        texts = [t for _, t in chain]
        if len(chain) < 2:
            return None
        new = [edited(t, u) for t, u in zip(texts, texts[1:])]
        marks = fingerprints(texts + new)
        own, other = marks[:len(texts)], marks[len(texts):]
        out = [(chain[k][0], len(texts[k]), hashlib.sha256(new[k].encode("utf-8", "surrogatepass")).hexdigest(), own[k], other[k],
                likeness(own[k], other[k]), likeness(own[k], own[k + 1])) for k in range(len(new))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, chars, first, ahead = None, [], 0, None, None

        def close() -> pa.RecordBatch | None:
            return results(held, ahead or first) if held else None

        for batch in batches:
            for doc_id, text, b, is_ahead in zip(*[c.to_pylist() for c in batch.columns]):
                if b != block:
                    if (done := close()) is not None:
                        yield done
                    block, held, chars, first, ahead = b, [], 0, None, None
                row = doc_id, text or ""
                if is_ahead:
                    ahead = ahead or row
                    continue
                first = first or row
                held.append(row)
                chars += len(row[1])
                if len(held) > SLICE_ROWS or (chars > SLICE_CHARS and len(held) > 1):
                    if (done := results(held, None)) is not None:
                        yield done
                    held, chars = held[-1:], len(row[1])
        if (done := close()) is not None:
            yield done

    return in_chains(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _widths(share: float) -> list[int]:
    """Rising numbers of first samples that bands look at. Of two numbers of samples, one at least ``share`` of the
    other, the largest widths within them are the same or neighbours."""
    out = [1]
    while out[-1] < 24 * SAMPLES:
        out.append(max(out[-1] + 1, math.ceil(out[-1] / share)))
    return out


@lru_cache(maxsize=4096)
def _spots(width: int) -> np.ndarray:
    """The positions of each band among the first ``width`` samples, the same for every text."""
    return np.sort(np.random.default_rng([20240609, width]).integers(0, width, (BANDS, BAND_WIDTH)), axis=1)


def _matrix(marks: list[str], top: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples at level ``top``, a row each and 0 beyond the end, and their numbers; none of fingerprints of higher levels."""
    found = [_at_level(f[3:], level, top) if (level := int(f[:2], 16)) <= top else np.empty(0, np.uint8) for f in marks]
    sizes = np.asarray([len(x) for x in found], np.int64)
    out = np.zeros((len(found), int(sizes.max(initial=0))), np.uint8)
    for row, x in zip(out, found):
        row[:len(x)] = x
    return out, sizes


def links_of(marks: list[str], labels: list[str], sides: list[int], least: float) -> list[tuple[int, int]]:
    """Links by likeness of at least ``least`` that join all the labels which such pairs of ``marks`` join: of any two
    of side 0, or of sides 0 and 1 if there are both. Pairs of labels already joined are not looked at."""
    names: dict[str, int] = {}
    label = np.asarray([names.setdefault(x, len(names)) for x in labels], np.int64)
    side, level = np.asarray(sides), np.asarray([int(f[:2], 16) for f in marks])
    matrices = {int(t): _matrix(marks, int(t)) for t in np.unique(level)}
    crossed, out = bool(side.any()), []
    for a in np.flatnonzero(side == 0) if crossed else range(len(marks)):
        others = np.flatnonzero(side == 1) if crossed else np.arange(a + 1, len(marks))
        others = others[label[others] != label[a]]
        tops = np.maximum(level[others], level[a])
        for t in np.unique(tops):
            (samples, sizes), c = matrices[int(t)], others[tops == t]
            longest = np.maximum(sizes[c], sizes[a])
            agree = (samples[c] == samples[a]).sum(axis=1) - (samples.shape[1] - longest)
            alike = np.maximum(0.0, (agree / np.maximum(longest, 1) - 1 / 16) / (15 / 16))
            for b in c[np.where(longest > 0, alike, 0.0) >= least]:
                if label[b] != label[a]:
                    label[label == label[b]] = label[a]
                    out.append((int(a), int(b)))
    return out


def _close_links(banded: DataFrame, least: float) -> DataFrame:
    """a and b of links of each fingerprint with its band's first and the one before it: few pairs that join most."""
    firsts = banded.groupBy("band").agg(F.min("fingerprint").alias("other"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    starred = banded.join(firsts.select("band", "other"), "band")
    before = F.lag("fingerprint").over(Window.partitionBy("band", F.pmod(F.xxhash64(F.substring("fingerprint", 1, 8)), F.lit(64))).orderBy("fingerprint"))
    pairs = (starred.withColumn("before", before).select("fingerprint", F.explode(F.array("other", "before")).alias("other"))
             .filter("other <> fingerprint").distinct())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (c.to_pylist() for c in batch.columns)
            ok = [k for k in range(len(a)) if likeness(a[k], b[k]) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in ok], pa.string()), pa.array([b[k] for k in ok], pa.string())], names=["a", "b"])

    return pairs.mapInArrow(verify, "a string, b string")


def joined(banded: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """node and component of the fingerprints that links within bands (rows of band and fingerprint) join.

    Every pair of a band counts. A first round verifies a few pairs of each fingerprint. Bands whose members are
    then in different components, one of those with the same members, are split into blocks of about ``block``, a
    task a pair of blocks, where all pairs of different components are verified: what a large band of unlike
    fingerprints takes is quadratic in its blocks, in tasks of bounded size.
    """
    banded = stage(banded)
    close = stage(_close_links(banded, least))
    names = stage(components(close)).select(F.col("node").alias("fingerprint"), F.col("component").alias("label"))
    members = banded.join(names, "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    sums = [F.sum(F.xxhash64(F.lit(k), "fingerprint").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    apart = (members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), *sums)
             .filter("lo <> hi").groupBy("n", "s1", "s2").agg(F.min("band").alias("band"))
             .select("band", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    keys = ["band", "i", "j"]
    dealt = (members.join(apart, "band").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
             .withColumn("side", ((F.col("i") != F.col("j")) & (F.col("mine") == F.col("j"))).cast("int"))
             .select(*keys, "side", "fingerprint", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def close() -> pa.RecordBatch:
            sides, marks, labels = zip(*group)
            found = links_of(marks, labels, sides, least) if key[1] == key[2] or len(set(sides)) == 2 else []
            return pa.RecordBatch.from_arrays([pa.array([marks[p[k]] for p in found], pa.string()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for *k, side, mark, label in zip(*[c.to_pylist() for c in batch.columns]):
                if k != key:
                    if group:
                        yield close()
                    key, group = k, []
                group.append((side, mark, label))
        if group:
            yield close()

    links = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a string, b string")
    return components(close.unionByName(links))


def near_groups(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and group_id (a fingerprint's group) of near-duplicates by likeness of at least ``least``.

    Equal fingerprints are one row first. Candidates are all pairs that share a band (``joined``): two
    documents that agree in a share p of samples share a band with chance ``1 - (1 - p**BAND_WIDTH)**BANDS``. The
    samples a band looks at depend on level and width alone; a text has bands at its own level and those above
    it, at its own width and the one below, so texts on either side of a limit meet.
    """
    marks = stage(fingerprint(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))).select("id", "fingerprint"))

    share = least * 15 / 16 + 1 / 16  # of samples that agree, at least; so the shorter has that share of the longer's
    above = max(1, math.ceil(math.log2(1 / share) + 0.5))

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths = _widths(share)
        for batch in batches:
            keys, out = [], []
            for f in batch.column(0).to_pylist():
                level = int(f[:2], 16)
                for top in range(level, level + above + 1):  # texts of different levels meet at the higher one
                    s = _at_level(f[3:], level, top)
                    k = bisect_right(widths, len(s)) - 1
                    for w in widths[max(k - 1, 0):k + 1]:  # and those of different length at the smaller width
                        for b, at in enumerate(_spots(w)):
                            keys.append(f"{b}:{top}:{w}:{s[at].tobytes().decode()}")
                            out.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string())], names=["band", "fingerprint"])

    distinct = marks.select("fingerprint").distinct()
    banded = distinct.mapInArrow(bands, "band string, fingerprint string")
    groups = joined(banded, least)
    return (marks.join(groups, marks.fingerprint == groups.node, "left")
            .select("id", F.coalesce("component", "fingerprint").alias("group_id")))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
