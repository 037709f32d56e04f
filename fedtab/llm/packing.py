"""Order-preserving packing: window cuts chosen by dynamic programming.

Documents lie in identifier order as one stream of ids (each document's ids, then a separator). A window is a
run of at most ``window`` ids; its padding is what it lacks of ``window``, and none at a power of two. Cuts
may fall at document ends (free), sentence ends (``SENTENCE_CUT``) or, inside a stretch without either that is
longer than ``FORCED_STEP`` (a quarter of a small window), at forced places (``FORCED_CUT``). The cost of a window is its padding, the
penalty of the cut that ends it, and ``WINDOW_COST``. With ``f`` the least cost up to a place, the best
predecessor by padding is the least ``f(i) + place(i)`` within reach, which a monotone queue hands out in
constant time; windows of a power of two are found by searching the places. The program runs over buffers of
``BUFFER_IDS`` ids, or ``BUFFER_WINDOWS`` large windows; the last ``CARRIED`` windows of a buffer are decided again together with the next one.

Each range partition of the identifiers is packed by itself, so its last window alone may be padded for want
of documents. Defined results: null text is the empty text (the separator alone); a null identifier sorts
first; repeated rows are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fedtab.llm.encode import Encoder, load
from fedtab.llm.order import in_id_order

WINDOW = 1024
SEPARATOR = 0
SENTENCE_CUT = 3
FORCED_CUT = 8
WINDOW_COST = 2
FORCED_STEP = 16
BUFFER_IDS = 1 << 19
CARRIED = 16
BUFFER_WINDOWS = 64
PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType(), False),
    T.StructField("length", T.LongType(), False), T.StructField("ids_crc32", T.LongType(), False),
    T.StructField("doc_tokens", T.LongType(), False), T.StructField("sequence_id", T.LongType(), False),
    T.StructField("offset", T.LongType(), False), T.StructField("ids", T.BinaryType(), False)])


def padding(length: int, window: int = WINDOW) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def choose_cuts(places: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indexes of the places that end a window, the last one included.

    ``places`` rise from the first id after 0 to the end of the stream, never more than ``window`` apart;
    ``penalty`` is the price of a cut at each.
    """
    pen = [0, *(penalty + WINDOW_COST).tolist()]
    at = np.concatenate(([0], places)).astype(np.int64)
    n = len(at)
    index = np.full(int(at[-1]) + 1, -1, np.int32)  # of the place at each id
    index[at] = np.arange(n, dtype=np.int32)
    ends, begins = [], []  # windows of a power of two
    k = 1
    while k <= window:
        first = int(np.searchsorted(at, k))
        begin = index[at[first:] - k]
        hit = np.flatnonzero(begin >= 0)
        ends.append(hit + first)
        begins.append(begin[hit])
        k *= 2
    ends, begins = np.concatenate(ends), np.concatenate(begins)
    order = np.argsort(ends, kind="stable")
    upto = np.searchsorted(ends[order], np.arange(n), side="right").tolist()
    begins, reach = begins[order].tolist(), np.searchsorted(at, at - window).tolist()
    lack, at = (window - at).tolist(), at.tolist()
    cost, back = [0] * n, [0] * n
    keys, held, head, h = [0], [0], 0, 0  # queue from head on: f(i) + place(i), i; rising in both
    for j in range(1, n):
        while held[head] < reach[j]:
            head += 1
        best, i = keys[head] + lack[j], held[head]
        while h < upto[j]:
            e = begins[h]
            h += 1
            if cost[e] < best:
                best, i = cost[e], e
        best += pen[j]
        cost[j], back[j] = best, i
        key = best + at[j]
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            held.pop()
        keys.append(key)
        held.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j - 1)
        j = back[j]
    return cuts[::-1]


@lru_cache(maxsize=2)
def _sentence_tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """By id: ends like a sentence; begins with white space."""
    tokenizer = load(path)
    size = tokenizer.get_vocab_size()
    ends, begins = np.zeros(size, bool), np.zeros(size, bool)
    for word, i in tokenizer.get_vocab().items():
        ends[i] = word.rstrip("\"')").endswith((".", "!", "?", "Ċ"))
        begins[i] = word.startswith(("Ġ", "Ċ"))
    return ends, begins


class Packer:
    """Packs one stream; ``add`` documents in order, ``rows`` of finished windows come back as pieces."""

    def __init__(self, tables: tuple[np.ndarray, np.ndarray], first_sequence: int, window: int = WINDOW, with_ids: bool = True):
        self.ends, self.begins = tables
        self.window, self.sequence, self.with_ids = window, first_sequence, with_ids
        self.step = max(1, min(FORCED_STEP, window // 4))
        self.buffer = max(BUFFER_IDS, BUFFER_WINDOWS * window)
        self.docs: deque = deque()  # [doc_id, ids, ids already packed]
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, 0])
        self.held += len(ids)
        if self.held >= self.buffer:
            yield from self._pack(CARRIED)

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self._pack(0)

    def _places(self) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([x[1][x[2]:] for x in self.docs])
        doc_ends = np.cumsum([len(x[1]) - x[2] for x in self.docs])
        sentence = np.flatnonzero(self.ends[ids[:-1]] & self.begins[ids[1:]]) + 1
        places = np.unique(np.concatenate((doc_ends, sentence)))
        gaps = np.diff(np.concatenate(([0], places)))
        wide = np.flatnonzero(gaps > self.step)
        if len(wide):
            each = (gaps[wide] - 1) // self.step  # forced places in each wide stretch
            step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + 1
            forced = np.repeat(places[wide] - gaps[wide], each) + step * self.step
            places = np.sort(np.concatenate((places, forced)))
        penalty = np.full(len(places), FORCED_CUT)
        penalty[np.searchsorted(places, sentence)] = SENTENCE_CUT
        penalty[np.searchsorted(places, doc_ends)] = 0
        return places, penalty

    def _pack(self, carried: int) -> Iterator[tuple]:
        places, penalty = self._places()
        cuts = choose_cuts(places, penalty, self.window)
        if carried:
            cuts = cuts[:-carried]
        begin = 0
        for c in cuts:
            end = int(places[c])
            yield from self._window(end - begin)
            begin = end

    def _window(self, length: int) -> Iterator[tuple]:
        offset = 0
        while offset < length:
            doc = self.docs[0]
            doc_id, ids, start = doc
            n = min(len(ids) - start, length - offset)
            raw = memoryview(ids[start:start + n])
            piece = doc_id, start, n, zlib.crc32(raw), len(ids), self.sequence, offset
            yield (*piece, raw.tobytes()) if self.with_ids else piece
            offset += n
            if start + n == len(ids):
                self.docs.popleft()
            else:
                doc[2] = start + n
        self.held -= length
        self.sequence += 1


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         separator: int = SEPARATOR, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document in a sequence, with its ids as bytes (unsigned 32 bits, little-endian)
    unless only the places are asked for. Sequence numbers are unique and rise with the order of the documents."""
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
    schema = T.StructType(PIECES.fields[:len(kinds)])
    names = schema.names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        packer = Packer(_sentence_tables(tokenizer), TaskContext.get().partitionId() << 40, window, with_ids)
        end = np.asarray([separator], "<u4").tobytes()
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return batch

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, encoded in zip(ids, encoder.encode(x.as_py() for x in batch.column("text"))):
                out.extend(packer.add(doc_id, np.frombuffer(encoded + end, "<u4")))
                if len(out) > 2000:
                    yield flush()
        out.extend(packer.finish())
        if out:
            yield flush()

    return in_id_order(docs, id_col, text_col).mapInArrow(rows, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
