"""Spelling variants, decontamination and importance resampling against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fedtab.llm import decontaminate as dc
from fedtab.llm import importance as im
from fedtab.llm import spelling as sp
from fedtab.llm.fm_index import WordIndex, suffix_array
from tests.llm.helpers import EDGES, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def table(sf, name, *columns):
    t = pq.read_table(f"{sf}/{name}.parquet")
    return list(zip(*[t.column(c).to_pylist() for c in columns]))


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


# ---- 11: spelling variants ------------------------------------------------------------------

def edits(w, vocab, letters):
    out = set()
    for i in range(len(w) + 1):
        out |= {w[:i] + c + w[i:] for c in letters}
        if i < len(w):
            out |= {w[:i] + c + w[i + 1:] for c in letters} | {w[:i] + w[i + 1:]}
    return (out - {w}) & vocab


def plain_variants(docs, drop=199, least=5):
    n = Counter()
    for d, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(w)
            h = crc32(f"{'' if d is None else d}:{w}".encode())
            if drop and h % drop == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    v = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    letters = {c for w in v for c in w}
    near = {w: edits(w, set(v), letters) for w in v}
    form = {}
    for w, others in near.items():
        if others and v[b := min(others, key=lambda x: (-v[x], x))] >= 5 * v[w]:
            form[w] = b

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted(((w, form.get(w), root(w), v[w], len(near[w]), v[form[w]] if w in form else None) for w in v), key=str)


COLUMNS_11 = ("word", "form", "root", "n", "n_near", "form_n")


def test_suffix_array_of_repeats():
    rng = random.Random(2)
    import numpy as np
    for s in ([5] * 40 + [0], [rng.randrange(1, 4) for _ in range(300)] + [0], [0]):
        a = np.array(s)
        assert list(suffix_array(a)) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("letters", ["ab", "abcé", "aàÿz"])
def test_index_finds_each_near_word_once(letters):
    rng = random.Random(len(letters))
    vocab = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(200)} | {"a" * 6, "a" * 7, "a" * 40, "a" * 41})
    queries = sorted({"".join(rng.choice(letters + "q") for _ in range(rng.randrange(6, 11))) for _ in range(60)} | set(vocab[:80]) | {"a" * 40})
    index = WordIndex(vocab)
    first = list(zip(*(x.tolist() for x in index.near_by_first_half(queries))))
    second = list(zip(*(x.tolist() for x in index.near_by_second_half(queries))))
    assert len(set(first)) == len(first) and len(set(second)) == len(second)
    for i, q in enumerate(queries):
        want, h = edits(q, set(vocab), letters + "q"), len(q) // 2
        assert {vocab[w] for k, w in first if k == i} == {v for v in want if v[:h] == q[:h]}
        assert {vocab[w] for k, w in second if k == i} == {v for v in want if v[len(v) - len(q) + h:] == q[h:]}


def test_variants_equal_plain_python(spark, sf):
    got = rows_of(sp.op11_spelling(spark, sf), *COLUMNS_11)
    assert got == plain_variants(table(sf, "documents", "doc_id", "text")) and any(r[1] for r in got)


def test_chains_hot_halves_and_small_shards(spark):
    counts = {"aaaaaaaa": 3200, "aaaaaaab": 640, "aaaaaacb": 128, "aaaaadcb": 25, "aaaaedcb": 5, "zzaaaaaa": 3200, "baaaaaaa": 640}
    counts |= {"aaaa" + "".join(x): 5 for x in [(p, q, r, "x") for p in "bcd" for q in "bcd" for r in "bcd"]}
    docs = documents(spark, [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())])
    want = plain_variants([(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())], drop=0)
    for chars in (40, 200_000):
        assert rows_of(sp.variants(docs, 0, shard_chars=chars), *COLUMNS_11) == want
    assert {r[0]: r[2] for r in want}["aaaaedcb"] == "aaaaaaaa"


def test_spelling_edges(spark):
    clash = documents(spark, EDGES * 5).withColumn("word", F.lit(1)).withColumn("n", F.lit(2)).withColumn("runs", F.lit("x"))
    assert rows_of(sp.variants(clash), *COLUMNS_11) == plain_variants([(d, t) for d, t in EDGES * 5])
    assert sp.variants(documents(spark, []) if False else spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    long = "Ab" * 30_000
    got = rows_of(sp.variants(documents(spark, [(1, f"{long} " * 5 + f"{long}c " * 25)]), 0), *COLUMNS_11)
    assert [(len(r[0]), r[3], r[4]) for r in got] == [(60_000, 5, 1), (60_001, 25, 1)] or sorted((len(r[0]), r[3], r[4]) for r in got) == [
        (60_000, 5, 1), (60_001, 25, 1)]


# ---- 12: decontamination --------------------------------------------------------------------

def plain_hits(docs, items, window=10):
    windows = {}
    for i, text in items:
        w = WORD.findall(low(text))
        m = min(window, len(w))
        for s in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + m]), set()).add("" if i is None else str(i))
    sizes, out = sorted({len(x) for x in windows}), []
    for d, text in docs:
        w = WORD.findall(low(text))
        hit, found = [False] * len(w), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                owners = windows.get(tuple(w[s:s + m]))
                if owners:
                    found |= owners
                    hit[s:s + m] = [True] * m
        out.append((d, len(w), sum(hit), sorted(found), any(hit)))
    return sorted(out, key=str)


COLUMNS_12 = ("doc_id", "n_words", "n_hit", "items", "contaminated")


def test_decontamination_equals_plain_python(spark, sf):
    docs, items = table(sf, "documents", "doc_id", "text"), table(sf, "benchmark", "item_id", "text")
    want = plain_hits(docs, items)
    got = rows_of(dc.op12_decontamination(spark, sf), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == [(d, n, k, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), c) for d, n, k, i, c in want]


def test_short_items_repeats_and_frequent_passages(spark):
    rng = random.Random(9)
    words = ["a", "b", "É", "d1"]
    items = [(i % 17 or None, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 20] * 2)]
    items += [(40, None), (41, "a " * 15), (42, "a " * 12)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(50)))) for i in range(40)] + [(90, "a " * 300), (91, "A-a.a " * 5)]
    for least in (1, 6, 10):
        some = [x for x in items if len((x[1] or "").split()) >= least] + [(40, None)]
        got = dc.contaminated(documents(spark, docs), spark.createDataFrame(some, "item_id bigint, text string"))
        assert rows_of(got, *COLUMNS_12) == plain_hits(docs, some)


def test_every_long_shared_span_has_a_shared_fingerprint(spark):
    """The guarantee of winnowing, over random spans in random surroundings."""
    rng = random.Random(4)
    pairs = []
    for i in range(200):
        span = [rng.choice("abc") for _ in range(10)]
        pairs.append((i, *[[rng.choice("abc") for _ in range(rng.randrange(8))] + span + [rng.choice("abc") for _ in range(rng.randrange(8))] for _ in "xy"]))
    marks = []
    for k in (1, 2):
        df = spark.createDataFrame([(p[0], p[k]) for p in pairs], "id int, words array<string>")
        marks.append({r.id: set(r.h) for r in dc.winnow(df, dc.Pass(5, 6, (10,))).selectExpr("id", "__marks.h AS h").collect()})
    assert all(marks[0][i] & marks[1][i] for i, *_ in pairs)


def test_join_by_shuffle_gives_the_same(spark, monkeypatch):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(40))) for i in range(20)]
    items = [(i, " ".join(rng.choice("ab") for _ in range(14))) for i in range(60)]
    monkeypatch.setattr(dc, "SMALL_ROWS", 3)
    got = dc.contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert rows_of(got, *COLUMNS_12) == plain_hits(docs, items)


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, "same text here now"), (2, "")], "item_id bigint, text string")
    clash = documents(spark, EDGES).withColumn("digest", F.lit(1)).withColumn("words", F.lit("x"))
    assert rows_of(dc.contaminated(clash, items), *COLUMNS_12) == plain_hits(EDGES, [(1, "same text here now")])
    assert rows_of(dc.contaminated(clash, items.filter("false")), *COLUMNS_12) == plain_hits(EDGES, [])
    assert dc.contaminated(clash.filter("false"), items).count() == 0


# ---- 13: importance resampling --------------------------------------------------------------

def features(text):
    w = WORD.findall(low(text))
    return len(w), [crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain_draw(docs, target, percent=25, seed=7):
    split = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in split for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for d, n, f in split:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= 20])
    order = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    for i, r in enumerate(order[:percent * len(order) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


COLUMNS_13 = ("doc_id", "n_features", "weight", "score", "rank")


def test_resampling_equals_plain_python(spark, sf):
    docs = table(sf, "documents", "doc_id", "text")
    assert rows_of(im.op13_importance(spark, sf), *COLUMNS_13) == plain_draw(docs, [x for x, in table(sf, "benchmark", "text")])


@pytest.mark.parametrize("accuracy", [1, 2, 3, 10, 2000])
def test_any_bracket_finds_the_cutoff(spark, accuracy):
    """A coarse sketch gives a wrong bracket first; the exact counts outside it widen it."""
    rng = random.Random(accuracy)
    rows = [(i // 2 if i % 5 else None, 3, 0, rng.choice([0, 1, 1, 1, 2, 50]), i % 7 > 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_features bigint, weight bigint, score bigint, eligible boolean")
    for percent in (1, 25, 99, 100):
        got = [(r["rank"], r.score, r.doc_id) for r in im.draw(df, percent, accuracy).collect()]
        assert len(got) == 300
        want = sorted(((r[3], r[0]) for r in rows if r[4]), key=lambda r: (-r[0], -1 if r[1] is None else r[1]))
        k = percent * len(want) // 100
        assert [x[1:] for x in sorted(x for x in got if x[0] is not None)] == want[:k]


def test_importance_edges(spark):
    rows = EDGES + [(20 + i, "w x y z " * 6) for i in range(9)] + [(None, "w x y z " * 6)]
    target = spark.createDataFrame([("w x",), (None,)], "text string")
    clash = documents(spark, rows).withColumn("score", F.lit(1)).withColumn("rank", F.lit(2)).withColumn("eligible", F.lit("x"))
    assert rows_of(im.resample(clash, target), *COLUMNS_13) == plain_draw([r[:2] for r in rows], ["w x", None])
    assert rows_of(im.resample(clash, target.filter("false")), *COLUMNS_13) == plain_draw([r[:2] for r in rows], [])
    assert im.resample(clash.filter("false"), target).count() == 0
