"""BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

The merge list says everything needed. A sequence of tokens is the BPE encoding of its symbols exactly when each
token is the encoding of its own symbols and no merge reaches over the border of two neighbours. So the last
token of every prefix can be found from left to right: it is the token that ends there and borders cleanly on
the last token of the prefix before it. A token is at most ``lookahead`` symbols long, the longest merge
result, so whatever follows, the encoding passes through one of the last ``lookahead`` places: tokens that the
encodings of all those places share are stable and are emitted; older places are forgotten. Memory does not
grow with the word or the text.

Two neighbours a|b border cleanly when no pair of a's right spine and b's left spine merges while both are
there: a spine token is there until the merge that takes it into the next one, and of equal merges the leftmost
is first.

Normalization and pre-tokenization follow the tokenizer file; words and space-separated pieces that repeat are
kept in bounded caches. Defined results: null is the empty text (no ids, empty decoded text); ids that the file
does not know decode to nothing; all other columns are ignored; rows are encoded one by one, so repeated rows
repeat and an empty table stays empty.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedtab.llm.encode import CACHE_CHUNKS, PieceCache, keys_of, load, shown_bytes, slices

NEVER = 1 << 60
KEPT_PAIRS = 500_000
KEPT_WORDS = 250_000
_LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]{1,40}"
_PLAIN = re.compile(rf" ?({_LATIN})?([.,;:!?#$%&*]*)(?:\n({_LATIN})?([.,;:!?#$%&*]*))?")


class Merges:
    """What the transducer needs to know of a merge list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.text = {i: t for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        self.symbols: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[left, right] = r
            self.parts[whole] = left, right
            self.made_at[whole] = r
            self.symbols[whole] = self.symbols.get(left, 1) + self.symbols.get(right, 1)
        #: Symbols that must have been read before a token that starts now can be ruled out.
        self.lookahead = max(self.symbols.values(), default=1)
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.known_borders: dict[int, bool] = {}
        self._own: dict[int, bool] = {}
        #: Tokens that are the encoding of their own symbols, by text.
        self.usable = {t: i for t, i in self.ids.items() if self.is_own(i)}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens on the left (0) or right (1) edge of a token, outermost last merge first, each with the rank
        of the merge that ends it."""
        got = self._spines.get((token, side))
        if got is None:
            got, until, t = [], NEVER, token
            while True:
                got.append((t, until))
                if t not in self.parts:
                    break
                until = self.made_at[t]
                t = self.parts[t][side]
            self._spines[token, side] = got
        return got

    def clean(self, a: int, b: int) -> bool:
        """Whether no merge reaches over the border of a|b."""
        got = True
        for s, s_until in self.spine(a, 1):
            for u, u_until in self.spine(b, 0):
                r = self.rank.get((s, u))
                if r is not None and r < s_until and r <= u_until:
                    got = False
                    break
            if not got:
                break
        if len(self.known_borders) >= KEPT_PAIRS:
            self.known_borders.clear()
        self.known_borders[a << 32 | b] = got
        return got

    def is_own(self, token: int) -> bool:
        """Whether a token is the encoding of its own symbols: its halves are, and of all merges over their
        border its own comes first."""
        got = self._own.get(token)
        if got is None:
            if token not in self.parts:
                got = True
            else:
                left, right = self.parts[token]
                got = self.is_own(left) and self.is_own(right)
                if got:
                    at = self.made_at[token]
                    got = not any((r := self.rank.get((s, u))) is not None and r < at and r < s_until and r <= u_until
                                  for s, s_until in self.spine(left, 1) for u, u_until in self.spine(right, 0))
            self._own[token] = got
        return got


class Transducer:
    """Encodes one pre-token, symbol by symbol."""

    def __init__(self, merges: Merges):
        self.m = merges

    def encode(self, word: str) -> Iterator[int]:
        """Ids of a spelled word; at any time only about ``2 * lookahead`` places are held."""
        usable, suffix, reach = self.m.usable, self.m.suffix, self.m.lookahead
        known, clean = self.m.known_borders, self.m.clean
        n = len(word)
        last: dict[int, tuple[int, int]] = {}  # place: the token that ends there, the place it starts at
        emitted = 0
        for i in range(1, n + 1):
            for start in range(max(emitted, i - reach), i):
                token = usable.get(word[start:i] + suffix if i == n else word[start:i])
                if token is None:
                    continue
                if start:
                    if start not in last:
                        continue
                    before = last[start][0]
                    fits = known.get(before << 32 | token)
                    if not (clean(before, token) if fits is None else fits):
                        continue
                last[i] = token, start
                break
            if i - emitted >= 2 * reach and i < n:
                stable = self._shared(last, i, max(emitted, i - reach + 1))
                yield from self._path(last, stable, emitted)
                for p in [p for p in last if p < stable]:
                    del last[p]
                emitted = stable
        yield from self._path(last, n, emitted)

    @staticmethod
    def _shared(last: dict[int, tuple[int, int]], i: int, first: int) -> int:
        """The latest place that the encodings of all places from ``first`` to ``i`` pass through."""
        live = {p for p in range(first, i + 1) if p in last}
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(last[top][1])
        return live.pop() if live else 0

    @staticmethod
    def _path(last: dict[int, tuple[int, int]], end: int, begin: int) -> list[int]:
        out = []
        while end > begin and end in last:
            token, end = last[end]
            out.append(token)
        return out[::-1]


class Decoder:
    """Ids to text, piece by piece. A byte-level file decodes through bytes, keeping the bytes of an unfinished
    character until the next ids come; a file without a decoder spells its tokens, parted by spaces."""

    def __init__(self, path: str):
        self.table, self.spelled = _decode_table(path)
        self.begun = False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        get = self.table.get
        if self.spelled:
            words = [w for w in map(get, ids) if w is not None]
            if not words:
                return ""
            text = (" " if self.begun else "") + " ".join(words)
            self.begun = True
            return text
        return self.state.decode(b"".join(get(i, b"") for i in ids))

    def finish(self) -> str:
        return "" if self.spelled else self.state.decode(b"", final=True)


@lru_cache(maxsize=4)
def _decode_table(path: str) -> tuple[dict[int, str] | dict[int, bytes], bool]:
    tokenizer = load(path)
    words = {i: t for t, i in tokenizer.get_vocab(True).items()}
    if tokenizer.decoder is None:
        return words, True
    raw = {ord(c): b for b, c in shown_bytes().items()}
    special = set(tokenizer.get_added_tokens_decoder())
    return {i: t.encode() if i in special else t.translate(raw).encode("latin-1") for i, t in words.items()}, False


@lru_cache(maxsize=4)
def _kept(path: str) -> tuple[Merges, list[dict[str, bytes]], PieceCache]:
    """Outlives a task: Python workers are reused."""
    return Merges(path), [{}, {}], PieceCache(CACHE_CHUNKS // 2)


class StreamEncoder:
    """Encodes texts to the bytes of their ids (unsigned 32 bits, little-endian)."""

    def __init__(self, path: str):
        self.merges, self.words, self.cache = _kept(path)
        self.tokenizer = load(path)
        self.machine = Transducer(self.merges)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.parted = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.spelling = shown_bytes()
        #: The quick way for plain pieces holds for files that lower-case and drop white space.
        self.quick = self.tokenizer.encode("A \n", add_special_tokens=False).ids == self.tokenizer.encode("a", add_special_tokens=False).ids

    def word(self, spelled: str) -> bytes:
        young, old = self.words
        ids = young.get(spelled)
        if ids is None:
            ids = old.get(spelled)
            if ids is None:
                ids = array("I", self.machine.encode(spelled)).tobytes()
            if len(spelled) <= 64:
                if len(young) >= KEPT_WORDS:
                    self.words[:] = {spelled: ids}, young
                else:
                    young[spelled] = ids
        return ids

    def piece(self, text: str) -> bytes:
        """Any piece: special tokens first, then the file's normalizer and pre-tokenizer, then the words."""
        out = []
        for part in self.parted.split(text) if self.parted else [text]:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                if self.tokenizer.normalizer is not None:
                    part = self.tokenizer.normalizer.normalize_str(part)
                out += [self.word(w) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return b"".join(out)

    def _make(self, pieces: list[str]) -> list[bytes]:
        out = []
        spelling, word, match = self.spelling, self.word, _PLAIN.fullmatch
        for text in pieces:
            if self.quick and (m := match(text)):
                parts = [p.lower().encode().decode("latin-1").translate(spelling) for p in m.groups() if p]
                out.append(b"".join(map(word, parts)))
            else:
                out.append(self.piece(text))
        return out

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for part in slices(texts):
            keys = [keys_of(x) for x in part]
            young, large = self.cache.fill(set(chain.from_iterable(keys)), self._make)
            for k in keys:
                yield b"".join([young[x] if x in young else large[x] for x in k]) if large else b"".join(map(young.__getitem__, k))


DECODED_AT_ONCE = 1 << 16


def decode_bytes(path: str, ids: bytes) -> Iterator[str]:
    """The decoded text in pieces of bounded size."""
    decoder = Decoder(path)
    numbers = memoryview(ids).cast("I")
    for a in range(0, len(numbers), DECODED_AT_ONCE):
        yield decoder.feed(numbers[a:a + DECODED_AT_ONCE])
    yield decoder.finish()


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of each text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = StreamEncoder(tokenizer)
        for batch in batches:
            ids = pa.array(encoder.encode(x.as_py() for x in batch.column(1)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    light = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return light.mapInArrow(run, "doc_id bigint, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of ids, SHA-256 of the ids and of the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = StreamEncoder(tokenizer)
        for batch in batches:
            counts, id_sums, text_sums = [], [], []
            for ids in encoder.encode(x.as_py() for x in batch.column(1)):
                counts.append(len(ids) // 4)
                id_sums.append(hashlib.sha256(ids).hexdigest())
                decoded = hashlib.sha256()
                for text in decode_bytes(tokenizer, ids):
                    decoded.update(text.encode())
                text_sums.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    light = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return light.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
