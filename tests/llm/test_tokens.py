"""Encoding, records, packing and the transducer against the tokenizers library."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from fedtab.llm import packing, records, transducer
from fedtab.llm.encode import Encoder
from tests.llm.helpers import EDGES, documents, sentence

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "B", " ", " ", "\n", "\t", ".", "1", "é", "É", "\x1c", "<|endoftext|>", "<|startoftext|>", "'s", "'S", "  ", "中", "́",
         "\xa0", "😀", "aaaa", "Σ", "İ", "\0", "ing", "th", "ﬁ", "####", "x" * 70]


def texts(n=4000):
    rng = random.Random(5)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    out += ["a" * 500, "ab" * 400, "the" * 300, "".join(rng.choice("abcdeilnorst") for _ in range(3000))]
    return out + ["".join(rng.choice("abcdeilnorst") for _ in range(60)) for _ in range(300)]


library = lru_cache(Tokenizer.from_file)


def ids(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoders_equal_the_library(path):
    t = texts()
    want = [np.asarray(e.ids, "<u4").tobytes() for e in library(path).encode_batch(t, add_special_tokens=False)]
    assert list(transducer.StreamEncoder(path).encode(t)) == want
    if path == BYTE:
        assert list(Encoder(path).encode(t)) == want


def test_pre_tokens_equal_the_library():
    rng = random.Random(5)
    signs = [*"aZ\u00e9\u0436\u03b1079.,'\"-\u2014\u201c\u20ac\u00ab \n", "'s", "'ll", " the", "<|endoftext|>", "\u00aa", "\u00b2", "\t"]
    t = ["".join(rng.choices(signs, [6] * (len(signs) - 4) + [1] * 4, k=rng.randint(0, 12))) for _ in range(20_000)]
    t += ["don't stop.\nThe 'end' isn't", "a\n\nb", "a \nb", "x\n", "\n", " ", "a  b", "<|endoftext|>", "word " * 3000, "q" * 100_000]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in library(BYTE).encode_batch(t, add_special_tokens=False)]
    encoder = Encoder(BYTE)
    assert list(encoder.encode(t)) == want
    assert sum(encoder._plain(x) is not None for x in t) > 2000


def test_kept_words_are_bounded():
    encoder = Encoder(BYTE)
    encoder.words = type(encoder.words)(100)
    t = [f"word{i} stays{i % 7}" for i in range(1000)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in library(BYTE).encode_batch(t, add_special_tokens=False)]
    assert list(encoder.encode(t)) == want
    assert len(encoder.words.young) <= 100 and len(encoder.words.old) <= 100


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_decoding_in_pieces_equals_the_library(path):
    for t in texts(300):
        got = ids(path, t)
        decoder = transducer.Decoder(path)
        text = "".join(decoder.feed(got[a:a + 3]) for a in range(0, len(got), 3)) + decoder.finish()
        assert text == library(path).decode(got, skip_special_tokens=False)


def test_transducer_holds_a_bounded_number_of_places():
    m = transducer.Merges(WORD)
    word = "".join(random.Random(2).choice("aeinorst") for _ in range(20_000))
    seen = 0
    for _ in transducer.Transducer(m).encode(word):
        seen += 1
    assert seen == len(ids(WORD, word)) and m.lookahead == 32


def test_round_trip_rows(spark):
    docs = documents(spark, EDGES)
    got = sorted(map(tuple, transducer.round_trip(docs, WORD).collect()), key=str)
    want = []
    for i, t, *_ in EDGES:
        x = ids(WORD, t)
        want.append((i, len(x), hashlib.sha256(np.asarray(x, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library(WORD).decode(x, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert transducer.round_trip(docs.limit(0), WORD).count() == 0


def test_records_come_back_in_order(spark, tmp_path):
    docs = documents(spark, EDGES)
    manifest = records.write_records(docs, str(tmp_path / "r"), BYTE, max_file_bytes=200)
    back = sorted(records.read_records(manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in back] == list(np.cumsum([0] + [len(r.ids) // 4 for r in back[:-1]]))
    assert [r.doc_id for r in back] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    want = {i: np.asarray(ids(BYTE, t) + [2], "<u4").tobytes() for i, t, *_ in EDGES}
    assert all(bytes(r.ids) == want[r.doc_id] for r in back)
    assert manifest.count() > 3
    shuffled = records.read_shuffled(manifest, 1).collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in shuffled) == sorted((str(r.doc_id), bytes(r.ids)) for r in back)
    assert records.read_records(records.write_records(docs.limit(0), str(tmp_path / "e"), BYTE)).count() == 0


def test_damaged_record_is_noticed(spark, tmp_path):
    row = records.write_records(documents(spark, [(1, "some text")]), str(tmp_path / "r"), BYTE).first()
    raw = bytearray(open(row.data, "rb").read())
    raw[-6] ^= 1
    open(row.data, "wb").write(bytes(raw))
    with pytest.raises(ValueError):
        list(records.scan(row.data, row.width))


def check_pieces(rows, docs):
    """Every id in exactly one piece, sequences gapless and bounded; returns the sequence lengths."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in docs:
        x = np.asarray(ids(BYTE, t) + [0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(x[at:at + r.length].tobytes()))
            at += r.length
        assert at == len(x)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return [sum(r.length for r in p) for p in by_sequence.values()]


def test_packing_is_whole(spark):
    rows = [(k, sentence(k, 10 + 37 * k % 400) + ".") for k in range(60)] + [(100, None), (101, ""), (102, "y" * 30_000)]
    lengths = check_pieces(packing.pack(documents(spark, rows), BYTE).collect(), rows)
    assert sum(map(packing.padding, lengths)) < 0.1 * sum(lengths)
    repeated = packing.pack(documents(spark, EDGES), BYTE).collect()
    assert sum(r.length for r in repeated) == sum(len(ids(BYTE, t)) + 1 for _, t, *_ in EDGES)
    assert packing.pack(documents(spark, EDGES).limit(0), BYTE).count() == 0


def test_packing_query_is_whole(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    lengths = check_pieces(packing.op3_packing(spark, sf).collect(), list(zip(t["doc_id"], t["text"])))
    assert sum(map(packing.padding, lengths)) < 0.01 * sum(lengths)


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(40):
        places = np.cumsum(rng.integers(1, 9, 14))
        penalty = rng.integers(0, 5, 14)
        cuts = packing.choose_cuts(places, penalty, 16)
        at = [0, *places.tolist()]
        cost = [0] + [1 << 30] * 14
        for j in range(1, 15):
            for i in range(j):
                if at[j] - at[i] <= 16:
                    cost[j] = min(cost[j], cost[i] + packing.padding(at[j] - at[i], 16) + int(penalty[j - 1]) + packing.WINDOW_COST)
        total, begin = 0, 0
        for c in cuts:
            total += packing.padding(int(places[c]) - begin, 16) + int(penalty[c]) + packing.WINDOW_COST
            begin = int(places[c])
        assert total == cost[14] and cuts[-1] == 13


def test_token_records_query(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet").sort_by("doc_id").to_pydict()
    at = 0
    for i, text, r in zip(t["doc_id"], t["text"], records.op7_token_records(spark, sf).orderBy("doc_id").collect()):
        x = np.asarray(ids(BYTE, text) + [2], "<u4")
        assert tuple(r) == (i, at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)


@pytest.mark.parametrize("window", [1, 2, 8, 100, 4096, 65536])
def test_packing_follows_the_window(window):
    """Small windows find places to cut, large ones are not solved again for every document."""
    tables = np.zeros(1000, bool), np.zeros(1000, bool)
    rng = np.random.default_rng(window)
    docs = [rng.integers(1, 1000, 1000 if window > 4096 else 37).astype("<u4") for _ in range(700 if window > 4096 else 40)]
    solved, packer = [], packing.Packer(tables, 0, window, False)
    places = packer._places
    packer._places = lambda: solved.append(packer.held) or places()
    pieces = [p for i, d in enumerate(docs) for p in packer.add(i, d)] + list(packer.finish())
    assert sum(solved) <= 3 * sum(map(len, docs))
    filled = {}
    for doc, start, n, crc, total, sequence, offset in pieces:
        assert offset == filled.get(sequence, 0) and zlib.crc32(docs[doc][start:start + n]) == crc
        filled[sequence] = offset + n
    assert sum(filled.values()) == sum(map(len, docs)) and max(filled.values()) <= window
