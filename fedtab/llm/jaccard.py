"""Jaccard self-join on word shingles with signature trees, and the groups its links form.

Two documents link when ``den * |A & B| >= num * |A | B|`` over their sets of ``width``-word shingles. All links
count; what is returned is the group (connected component) of every document, so copies and links within a group
are never spelled out pair by pair. Nothing is capped or sampled; the result is exact up to equality of 64-bit
hashes.

1. One pass over the texts makes each shingle set, a 128-bit digest of it, its signature bitmap and its elements
   of least hash. Documents of equal sets become one node.
2. Linking sets share an element among the first few of any common order. The order used: elements whose hash is
   in the lowest ``1 / LOW_PART`` of all values first, among those the ones that few nodes have before frequent
   ones, then the rest; each part by hash. So a passage that very many documents share does not bring them
   together. Elements in one node only are dropped by a filter before anything is shuffled; element groups
   with the same members are processed once, and cut where the sizes of their members rule out a link.
3. Within a group a dual descent of signature trees finds the pairs that may link. Large groups are split into
   classes of like size and these into blocks, one task a pair of blocks whose sizes allow a link. A round proposes, in each group, the pairs that would join its parts, those
   with the largest possible overlap first, and in further rounds some more for each member (``MORE`` in the
   third, that many times more in each one after it); the proposed pairs are verified on their full sets;
   verified links join components, refuted pairs are not proposed again. What is looked at again, by finer
   signatures, are the parts of a group that held pairs back and whose members still are in different
   components. Rounds go on until no pair is left.

Defined results: null text and text without words have the empty set and link with nothing; repeated rows are
rows of one node; a null identifier takes part but is no component's name unless no row of it has one; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fedtab.functions.common import stage
from fedtab.llm.components import components
from fedtab.llm.exact import BROADCAST_KEYS, located
from fedtab.llm.shingles import mix, shingle_sets
from fedtab.llm.staging import Stages
from fedtab.llm.signatures import FINE_BITS, Rule, bitmap, candidates

LOW_PART = 4
FREQUENT = 64
FREQUENT_KEPT = 1_000_000
FILTER_BITS = 1 << 27
BLOCK = 2048
#: Size classes that a link may span; bits of a block's number within its class.
REACH, BLOCK_BITS = 2, 20
#: Pairs that are sifted at once; candidates of a group that are held before only the best are kept.
SIFT, HELD = 4096, 1 << 17
MORE = 4
GROUP = ["token", "i", "j", "part"]
_SIGN = np.uint64(1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ _SIGN).view(np.int64)  # keeps the order


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) ^ _SIGN


def make_sets(docs: DataFrame, width: int, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """id, place, n, digest, signature, least (elements of least hash) of every row."""
    low = np.uint64((1 << 64) // LOW_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                n, digests, signatures, least = [], [], [], []
                for s in shingle_sets(batch.column("text"), width):
                    n.append(len(s))
                    with np.errstate(over="ignore"):
                        two = np.asarray([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
                    digests.append(len(s).to_bytes(4, "little") + two.tobytes())
                    signatures.append(bitmap(s).tobytes())
                    least.append(_signed(s[:max(rule.prefix(len(s)), int(np.searchsorted(s, low)))]))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in least]))).astype(np.int32)
                flat = np.concatenate(least) if least else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("__file"), batch.column("__row"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(signatures, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["id", "__file", "__row", "n", "node", "signature", "least"])

    light = docs.select(F.col(id_col).cast("bigint").alias("id"), "__file", "__row", F.col(text_col).cast("string").alias("text"))
    return light.mapInArrow(run, "id bigint, __file string, __row bigint, n bigint, node binary, signature binary, least array<bigint>")


def _sized(keys: DataFrame) -> DataFrame:
    """A staged table of keys, to be broadcast if its rows are few enough; beyond that Spark shuffles."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS // 4 else keys


def _distinct_sets(rows: DataFrame) -> DataFrame:
    """One row for every distinct set. Which rows repeat a set is settled on their places alone, so the
    signatures and elements are not shuffled."""
    places = rows.filter("n > 0").select("node", "__file", "__row")
    first = places.groupBy("node").agg(F.min(F.struct("__file", "__row")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    spare = (places.join(first, "node").filter(F.struct("__file", "__row") != F.col("first")).select("__file", "__row"))
    return rows.filter("n > 0").join(_sized(stage(spare)), ["__file", "__row"], "left_anti")


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent elements and the binary order of their counts, at most ``FREQUENT_KEPT`` of them: the bar is
    raised until they fit. The choice moves work, never the result: any common order is right."""
    order = F.floor(F.log2("c")).cast("int")
    classes = counts.filter(F.col("c") > FREQUENT).groupBy(order.alias("o")).agg(F.count(F.lit(1)).alias("k")).collect()
    kept, bar = 0, 64
    for o, k in sorted(((r.o, r.k) for r in classes), reverse=True):
        if kept + k > FREQUENT_KEPT:
            break
        kept, bar = kept + k, o
    got = counts.filter((F.col("c") > FREQUENT) & (order >= bar)).select("token", order.alias("o")).toArrow().sort_by("token")
    return got.column("token").to_numpy().astype(np.int64), got.column("o").to_numpy().astype(np.int64)


def _shared_filter(shared: DataFrame) -> np.ndarray:
    """A bit for each hash of an element that two or more nodes have, at most ``FILTER_BITS`` bits. A bit set by
    chance lets an element pass that the grouping then drops."""
    n, bits = shared.count(), 1 << 10
    while bits < 16 * n and bits < FILTER_BITS:
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            slot = _slot(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(out, slot >> 3, (128 >> (slot & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["bits"])

    parts = shared.select("token").coalesce(4).mapInArrow(run, "bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for p in parts:
        out |= np.frombuffer(p.bits, np.uint8)
    return out


def _slot(tokens: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(_unsigned(tokens)) & np.uint64(bits - 1)).astype(np.int64)


def _memberships(nodes: DataFrame, rule: Rule) -> DataFrame:
    """token and node: for every node the first elements of its set in the common order, less those that no
    other node has."""
    low = _signed(np.asarray([(1 << 64) // LOW_PART], np.uint64))[0]
    counts = nodes.select(F.explode("least").alias("token")).filter(F.col("token") < F.lit(int(low))).groupBy("token").agg(
        F.count(F.lit(1)).alias("c")).filter("c > 1")
    counts = stage(counts)
    frequent, classes = _frequent(counts)
    passing = _shared_filter(counts)
    sent = nodes.sparkSession.sparkContext.broadcast((frequent, classes, passing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, order, flags = sent.value
        bits = len(flags) * 8
        for batch in batches:
            tokens, nodes_out, sizes = [], [], []
            for node, n, least in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                x = least.values.to_numpy()
                kind = np.zeros(len(x), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, x), len(often) - 1)
                    kind = np.where(often[at] == x, order[at], 0)
                high = x >= low
                kind[high] = 1 << 20
                first = x[np.lexsort((x, kind))[:rule.prefix(n)]]
                slot = _slot(first, bits)
                first = first[((flags[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool) | (first >= low)]
                tokens.append(first)
                nodes_out += [node.as_py()] * len(first)
                sizes += [n] * len(first)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens) if tokens else [], pa.int64()), pa.array(nodes_out, pa.binary()),
                                              pa.array(sizes, pa.int64())], names=["token", "node", "n"])

    return nodes.select("node", "n", "least").mapInArrow(run, "token bigint, node binary, n bigint")


def _once(members: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and c (number of members) of one group for every distinct set of two or more members."""
    sums = [F.bit_xor(F.xxhash64(F.lit(s), "node")).alias(f"s{s}") for s in (1, 2)]  # a node is in a group once
    by_key = members.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), *sums).filter("c > 1")
    chosen = by_key.groupBy("c", "s1", "s2").agg(F.min(F.struct(*key)).alias("k"))
    return stage(chosen.select(*[F.col(f"k.{k}").alias(k) for k in key], "c"))


def _groups(members: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Groups of at most ``BLOCK`` members as blocks (GROUP, node), and the memberships of the larger ones.

    Sorted by size, a block is cut wherever two neighbours' sizes rule out a link: then no set before the cut links
    with one behind it. Members that are left alone go, and blocks that now have the same members are one."""
    chosen = _once(members, ["token"])
    groups = members.join(_sized(chosen.filter(F.col("c") <= BLOCK)), "token")
    by_size = Window.partitionBy("token").orderBy("n")
    apart = F.coalesce(F.lag("n").over(by_size) * rule.den < F.col("n") * rule.num, F.lit(False)).cast("int")
    cut = groups.withColumn("apart", apart).withColumn("i", F.sum("apart").over(by_size).cast("int"))
    alone = F.count(F.lit(1)).over(Window.partitionBy("token", "i"))
    runs = stage(cut.withColumn("met", alone).filter("met > 1").select("token", "i", "node"))
    small = runs.join(_sized(_once(runs, ["token", "i"])), ["token", "i"])
    small = small.select("token", "i", F.col("i").alias("j"), F.lit(b"").alias("part"), F.lit(0).alias("side"), "node")
    return small, members.join(_sized(chosen.filter(F.col("c") > BLOCK)), "token")


def _dealt(members: DataFrame, rule: Rule) -> DataFrame:
    """A row for every pair of blocks a member has a part in: pair (i, j), its side.

    A run of sizes in a group of at most ``BLOCK`` members is one block. In a larger group the upper levels of the tree are rows: its
    members fall into classes by size, so narrow that linking sets are at most ``REACH`` classes apart, each class into
    blocks; a pair of blocks whose sizes rule out a link is dropped before any member is dealt to it."""
    step = max(math.log(rule.den / rule.num) / REACH * (1 + 1e-9), 0.01)
    small, large = _groups(members, rule)
    large = large.withColumn("k", F.floor(F.log("n") / step).cast("int"))
    classes = large.groupBy("token", "k").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    classes = stage(classes.groupBy("token").agg(F.collect_list(F.struct("k", "blocks")).alias("classes")))
    met = large.join(_sized(classes), "token")
    own = F.get(F.filter("classes", lambda x: x["k"] == F.col("k")), F.lit(0))["blocks"]

    def cell(k, b):
        return k * F.lit(1 << BLOCK_BITS) + b
    near = F.filter("classes", lambda x: F.abs(x["k"] - F.col("k")) <= REACH)
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda b: cell(x["k"], b))))
    pairs = (met.withColumn("block", cell(F.col("k"), F.pmod(F.xxhash64("node"), own).cast("int"))).withColumn("others", others)
             .select("token", "node", "block", F.explode_outer("others").alias("other"))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("part", F.lit(b""))
             .withColumn("side", F.when(F.col("i") == F.col("j"), 0).otherwise((F.col("block") == F.col("j")).cast("int"))))
    return small.unionByName(pairs.select(*GROUP, "side", "node"))


def _batches(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same pairs, about ``HELD`` at once."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= HELD:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _best(pairs: np.ndarray, bound: np.ndarray, labels: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs and their bounds: the ones that join parts of the group, those of largest bound first, and up to
    ``share`` more for each member; then the part of each member. A pair that joins no parts among some pairs joins none among more, so what is left
    out of a batch is not missed in the next one."""
    order = np.argsort(-bound, kind="stable")
    pairs, bound = pairs[:, order], bound[order]
    part = labels.copy()  # the part of the group each member is in by now
    had = np.zeros(len(labels), np.int64)
    kept: list[int] = []
    for at in range(0, len(bound), SIFT):
        x, y = pairs[:, at:at + SIFT]
        open_ = np.flatnonzero((part[x] != part[y]) | ((had[x] < share) & (had[y] < share)))  # shut ones stay shut
        for k, i, j in zip(open_.tolist(), x[open_].tolist(), y[open_].tolist()):
            if part[i] != part[j] or (had[i] < share and had[j] < share):
                if part[i] != part[j]:
                    part[part == part[i]] = part[j]
                had[i] += 1
                had[j] += 1
                kept.append(at + k)
    return pairs[:, kept], bound[kept], part


def _propose(rule: Rule, group: list[dict], share: int) -> tuple[list[tuple[bytes, bytes]], list[list[int]]]:
    """Pairs of one group to verify, and the members of every part of it that holds others back: no pair of unlike
    parts may link."""
    names: dict[bytes, int] = {}
    labels = np.asarray([names.setdefault(m["label"], len(names)) for m in group], np.int64)
    if len(names) < 2:
        return [], []
    sizes = np.asarray([m["n"] for m in group], np.int64)
    bitmaps = [np.frombuffer(m["signature"], "<u8") for m in group]
    sides = np.asarray([m["side"] for m in group])
    side = sides if group[0]["i"] != group[0]["j"] else None
    place = {m["node"]: k for k, m in enumerate(group)}
    never = {x * len(group) + place[n] for x, m in enumerate(group) for n in m["refuted"] or () if n in place}
    known = np.fromiter(never, np.int64, len(never))
    best, bound, part = np.empty((2, 0), np.int32), np.empty(0, np.float32), labels
    ends = np.zeros(len(group), np.int64)  # candidates by their first member, then less the kept ones
    for a, b, over in _batches(candidates(rule, sizes, bitmaps, np.asarray([m["first"] for m in group], np.int64), labels, side)):
        if len(known):
            new = ~(np.isin(a * len(group) + b, known) | np.isin(b * len(group) + a, known))
            a, b, over = a[new], b[new], over[new]
        ends += np.bincount(a, minlength=len(group))
        best = np.concatenate((best, np.stack((a, b)).astype(np.int32)), axis=1)
        best, bound, part = _best(best, np.concatenate((bound, (over / (sizes[a] + sizes[b])).astype(np.float32))), labels, share)
    ends -= np.bincount(best[0], minlength=len(group))
    return [tuple(sorted((group[i]["node"], group[j]["node"]))) for i, j in best.T.tolist()], [np.flatnonzero(part == p).tolist() for p in np.unique(part[ends > 0])]


def _proposals(members: DataFrame, rule: Rule, share: int) -> DataFrame:
    """a and b of proposed pairs, and a row without them for every part of a group that holds pairs back, with its members."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("token", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("part", pa.binary()),
                        ("nodes", pa.list_(pa.binary())), ("sides", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []

        def close() -> None:
            if len(group) > 1:
                pairs, parts = _propose(rule, group, share)
                out.extend((a, b, *[None] * 6) for a, b in pairs)
                for part in parts:  # named by its least member
                    own = [group[m]["node"] for m in part]
                    out.append((None, None, *key[:3], min(own), own, [group[m]["side"] for m in part]))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for m in batch.to_pylist():
                k = tuple(m[x] for x in GROUP)
                if k != key:
                    close()
                    key, group = k, []
                group.append(m)
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return members.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, "a binary, b binary, token bigint, i int, j int, part binary, nodes array<binary>, sides array<int>")


def _fine(nodes: DataFrame, docs: DataFrame, width: int, text_col: str, kept: Stages) -> DataFrame:
    """node, n, signature and first of ``nodes`` (node, __file, __row), with finer bitmaps; only their texts are fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n, signatures, first = [], [], []
                for s in shingle_sets(batch.column("text"), width):
                    n.append(len(s))
                    signatures.append(bitmap(s, FINE_BITS).tobytes())
                    first.append(_signed(s[:1])[0])
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n, pa.int64()), pa.array(signatures, pa.binary()),
                                                  pa.array(first, pa.int64())], names=["node", "n", "signature", "first"])

    texts = docs.select("__file", "__row", F.col(text_col).cast("string").alias("text")).join(_sized(nodes), ["__file", "__row"])
    return kept.put("fine", texts.select("node", "text").mapInArrow(run, "node binary, n bigint, signature binary, first bigint"))


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, rule: Rule, text_col: str,
            kept: Stages) -> DataFrame:
    """pairs with ``linked``, decided on the full sets. Only the texts of the nodes in question are fetched."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    places = kept.put("places", named.join(nodes.select("node", "__file", "__row"), "node"))
    texts = docs.select("__file", "__row", F.col(text_col).cast("string").alias("text"))
    texts = kept.put("texts", texts.join(_sized(places), ["__file", "__row"]).select("node", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                linked = []
                for x, y in zip(shingle_sets(batch.column("text_a"), width), shingle_sets(batch.column("text_b"), width)):
                    linked.append(bool(rule.links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, linked boolean")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after new links between nodes: the old components are the nodes of a smaller graph."""
    def name(end: str) -> DataFrame:
        return labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_label"))
    edges = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(
        F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    new = stage(components(edges)).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    old = labels.join(new, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return old.unionByName(new.join(labels.select("node"), new["component"] == labels["node"], "left_anti")
                           .select(F.col("component").alias("node"), F.col("whole").alias("component")))


def link_groups(docs: DataFrame, width: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest identifier of its group), kept (true
    for one row of each group: the smallest identifier, then the first place), __file, __row."""
    rule = Rule(num, den)
    docs = located(docs)
    rows = stage(make_sets(docs, width, rule, id_col, text_col))
    nodes = _distinct_sets(rows)
    kept = Stages(docs.sparkSession)
    groups = kept.put("groups", _dealt(kept.put("members", _memberships(nodes, rule)), rule))
    kept.drop("members")
    entries = stage(nodes.join(_sized(stage(groups.select("node").distinct())), "node", "left_semi")
                    .select("node", "n", "signature", F.coalesce(F.get("least", F.lit(0)), F.lit(0)).alias("first")))
    spark = docs.sparkSession
    labels = spark.createDataFrame([], "node binary, component binary")
    refuted, rounds = None, 0
    while True:
        members = groups.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        if rounds:
            apart = members.groupBy(*GROUP).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
            members = members.join(apart.select(*GROUP), GROUP, "left_semi")
            members = members.join(refuted.groupBy("a").agg(F.collect_set("b").alias("refuted")).withColumnRenamed("a", "node"), "node", "left")
            # few groups are still open: only their members' signatures are fetched
            members = kept.put("open", members)
            asked = kept.put("asked", members.select("node").distinct())
            if rounds == 1:
                places = kept.put("places", nodes.select("node", "__file", "__row").join(_sized(asked), "node", "left_semi"))
                entries = _fine(places, docs, width, text_col, kept)
            known = entries.join(_sized(asked), "node", "left_semi")
        else:
            members = members.withColumn("refuted", F.lit(None).cast("array<binary>"))
            known = entries
        found = kept.put("found", _proposals(members.join(known, "node"), rule, MORE ** (rounds - 1) if rounds > 1 else 0))
        pairs = kept.put("pairs", found.filter("a IS NOT NULL").select("a", "b").distinct())
        if pairs.isEmpty():
            break
        judged = stage(_verify(pairs, nodes, docs, width, rule, text_col, kept))
        kept.drop("places", "texts")
        bad = judged.filter("not linked").select("a", "b")
        refuted = bad if refuted is None else refuted.unionByName(bad)
        labels = kept.put("labels", _joined(labels, judged.filter("linked").select("a", "b")))
        groups = kept.put("groups", found.filter("a IS NULL").select(*GROUP, F.explode(F.arrays_zip("nodes", "sides")).alias("m"))
                          .select(*GROUP, F.col("m.sides").alias("side"), F.col("m.nodes").alias("node")))
        rounds += 1
    member = F.coalesce("component", "node")
    whole = rows.join(labels, "node", "left").withColumn("__group", F.when(F.col("n") > 0, member))
    me = F.struct(F.col("id").isNull().alias("unknown"), "id", "__file", "__row")
    first = whole.filter("n > 0").groupBy("__group").agg(F.min(me).alias("first"))
    out = whole.join(first, "__group", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id")).alias("component_id"),
                      F.when(F.col("n") > 0, me == F.col("first")).otherwise(True).alias("kept"), "__file", "__row")


def keep_one(docs: DataFrame, width: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each group keeps one, with their own columns."""
    columns = docs.columns
    docs = located(docs)
    gone = stage(link_groups(docs, width, num, den, id_col, text_col).filter("NOT kept").select("__file", "__row"))
    return docs.join(gone, ["__file", "__row"], "left_anti").select(*columns)


def op6_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return link_groups(docs, 4, 85, 100).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
