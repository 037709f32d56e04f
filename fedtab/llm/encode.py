"""Whole-text encoding with a tokenizer file of the tokenizers library, chunk by chunk.

A text of plain words, digits, punctuation, single spaces and line feeds is cut into its pre-tokens by a pattern;
each distinct one goes through the library's model once per worker and is kept in a cache of bounded size.

Any other text: byte-level pre-tokenization never lets a token reach over a space that has non-space on either
side, so it may be encoded as the sequence of its space-separated chunks, which are kept likewise. Texts with
white-space runs where that does not hold are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core
CACHE_CHUNKS = 300_000
LONGEST_KEPT = 64
SLICE_CHARS = 2 << 20
_RUN = re.compile(r"\s \s")
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{1,40}"
_STOPS = r"[!-&(-/:-@\[-`{-~]"  # ASCII punctuation but for the apostrophe, which contractions use
_PLAIN = re.compile(rf"( ?(?:{_LETTERS}|[0-9]{{1,20}}|{_STOPS}{{1,20}}))({_STOPS}*)(?:(\n)({_LETTERS})({_STOPS}*))?")
#: Pre-tokens as the byte-level pattern cuts them, in characters known to be letters or to be neither letter, number nor space.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481\u048a-\u052f"
_SIGN = r"!-/:-@\[-`{-~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u2010-\u2027\u2030-\u205e"
_PRETOKENS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[{_SIGN}]+|\n(?!\n)")
_START = "\0"  # marks a chunk that opens a text: it has no space in front


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    """The tokenizer without truncation and padding, once per worker process."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def keys_of(text: str) -> list[str]:
    """Cache keys of the pieces of a text that are encoded independently of each other: a piece that follows a
    space goes without it, the others are marked."""
    if _START in text or _RUN.search(text):
        return [_START + text]
    keys = text.split(" ")
    keys[0] = _START + keys[0]
    return keys


def piece(key: str) -> str:
    return key[1:] if key.startswith(_START) else " " + key


class PieceCache:
    """Bounded map from piece to value. When the young half is full it becomes the old one; what is found in
    the old half moves back."""

    def __init__(self, limit: int = CACHE_CHUNKS):
        self.limit, self.young, self.old = limit, {}, {}

    def one(self, key: str, make: Callable[[str], bytes]) -> bytes:
        """Value of a key that the young half lacks."""
        if (value := self.old.get(key)) is None:
            value = make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[key] = value
        return value

    def fill(self, keys: Iterable[str], make: Callable[[list[str]], list]) -> tuple[dict, dict]:
        """Two maps that together hold every key: the kept one and one for pieces too long to keep."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old, missing, large = self.young, self.old, [], {}
        for key in keys:
            if key not in young:
                if (value := old.get(key)) is not None:
                    young[key] = value
                else:
                    missing.append(key)
        for key, value in zip(missing, make([piece(x) for x in missing])):
            (young if len(key) <= LONGEST_KEPT else large)[key] = value
        return young, large


def slices(texts: Iterable[str | None], size: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Texts in lists of about ``size`` characters; a longer text is a list of its own. Null is the empty text."""
    now: list[str] = []
    total = 0
    for text in texts:
        text = text or ""
        if now and total + len(text) > size:
            yield now
            now, total = [], 0
        now.append(text)
        total += len(text)
    if now:
        yield now


def shown_bytes() -> dict[int, str]:
    """Byte-level vocabularies spell each byte as one visible character: itself where it is visible, else the
    next one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Encodes texts to the bytes of their ids (unsigned 32 bits, little-endian)."""

    def __init__(self, path: str):
        self.tokenizer, self.cache, self.words = load(path), _cache(path), _words(path)
        self.spelled, self.tokenize = shown_bytes(), self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _spell(self, word: str) -> bytes:
        """Ids of one pre-token, from the model."""
        if word.isascii() and word.isprintable():
            spelled = word.replace(" ", self.spelled[32])
        else:
            spelled = word.encode().decode("latin-1").translate(self.spelled)
        return array("I", [t.id for t in self.tokenize(spelled)]).tobytes()

    def _word(self, word: str) -> bytes:
        if (ids := self.words.young.get(word)) is None:
            ids = self.words.one(word, self._spell)
        return ids

    def _plain(self, text: str) -> bytes | None:
        """Ids of a text that consists of plain pre-tokens, else nothing."""
        words = _PRETOKENS.findall(text)
        if len("".join(words)) != len(text) or any(x in text for x in self.added):
            return None
        out = list(map(self.words.young.get, words))
        i, missing = 0, out.count(None)
        for _ in range(missing):
            i = out.index(None, i)
            out[i] = self._word(words[i])
        return b"".join(out)

    def _make(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        rest = []
        word, match = self._word, _PLAIN.fullmatch
        for x in pieces:
            if m := match(x):
                a, stop, line, b, end = m.groups()
                ids = word(a)
                if stop:
                    ids += word(stop)
                if line:
                    ids += word(line) + word(b)
                    if end:
                        ids += word(end)
                out.append(ids)
            else:
                rest.append(len(out))
                out.append(None)
        for a in range(0, len(rest), 8192):
            at = rest[a:a + 8192]
            for i, e in zip(at, self.tokenizer.encode_batch_fast([pieces[i] for i in at], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
        return out

    def _chunks(self, text: str) -> bytes:
        """Ids of any text, chunk by chunk."""
        keys = keys_of(text)
        young, large = self.cache.fill(set(keys), self._make)
        return b"".join([young[x] if x in young else large[x] for x in keys])

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for text in texts:
            text = text or ""
            ids = self._plain(text)
            yield self._chunks(text) if ids is None else ids


@lru_cache(maxsize=4)
def _words(path: str) -> PieceCache:
    """Outlives a task: Python workers are reused."""
    return PieceCache()


@lru_cache(maxsize=4)
def _cache(path: str) -> PieceCache:
    return PieceCache()
