"""Exact and near duplicates and fingerprints against brute force."""

import hashlib
import re
import random

import numpy as np
import pyarrow.parquet as pq

from fedtab.llm import exact, fingerprints, jaccard, signatures
from fedtab.llm.components import components
from tests.llm.helpers import EDGES, documents, sentence

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def groups(rows, width, num, den):
    """Per row: size of its set and the smallest identifier linked to it, by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((str(i), len(sets[k]), str(least.get(root(k)))) for k, (i, _) in enumerate(rows))


def linked(spark, rows, width, num, den):
    return sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in jaccard.link_groups(documents(spark, rows), width, num, den).collect())


def near_copies():
    rng = random.Random(4)
    rows = []
    for k in range(12):
        base = sentence(k, 40 + 15 * k).split()
        for c in range(4):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"edit{rng.randint(0, 99)}"
            rows.append((10 * k + c, " ".join(words)))
    shared = sentence(999, 60)
    return rows + [(500 + k, sentence(600 + k, 50) + " " + shared) for k in range(30)]


def test_groups_equal_brute_force(spark):
    rows = near_copies()
    for width, num, den in ((4, 85, 100), (5, 80, 100)):
        assert linked(spark, rows, width, num, den) == groups(rows, width, num, den)


def test_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    monkeypatch.setattr(jaccard, "MORE", 1)
    rows = near_copies()
    assert linked(spark, rows, 4, 85, 100) == groups(rows, 4, 85, 100)


def test_groups_of_edge_rows(spark):
    rows = [(i, t) for i, t in EDGES]
    assert linked(spark, rows, 4, 85, 100) == groups(rows, 4, 85, 100)
    assert jaccard.link_groups(documents(spark, rows).limit(0), 4, 85, 100).count() == 0
    kept = jaccard.keep_one(documents(spark, rows), 4, 85, 100)
    assert kept.columns == documents(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, (1, 2, 3, 4, 5, 7, 8, 9)))


def test_groups_query(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.op6_jaccard_groups(spark, sf).collect())
    assert got == groups(list(zip(t["doc_id"], t["text"])), 4, 85, 100)


def test_descent_finds_all_pairs():
    rng = np.random.default_rng(1)
    rule = signatures.Rule(85, 100)
    pool = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    sets = []
    for _ in range(25):
        base = rng.choice(pool, rng.integers(5, 400), replace=False)
        for _ in range(4):
            keep = rng.random(len(base)) < 0.95
            sets.append(np.unique(np.concatenate((base[keep], rng.choice(pool, rng.integers(0, 5))))))
    sizes = np.asarray([len(s) for s in sets])
    order = np.asarray([s[0] if len(s) else 0 for s in sets]).astype(np.int64)
    found = {tuple(sorted(p)) for x, y, _ in signatures.candidates(rule, sizes, [signatures.bitmap(s) for s in sets], order, np.arange(len(sets)))
             for p in zip(x.tolist(), y.tolist())}
    want = {(a, b) for b in range(len(sets)) for a in range(b)
            if rule.links(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))}
    assert want and want <= found


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 6), (6, 5), (20, 21)] + [(100, 100 + k) for k in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 20: 20, 21: 20} | {100 + k: 100 for k in range(50)}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_exact_edges(spark):
    docs = documents(spark, EDGES)
    rows = exact.decide(docs).collect()
    assert len(rows) == len(EDGES)
    same = [r for r in rows if r.group_size == 4]
    assert len(same) == 4 and {r.keep_id for r in same} == {6} and sum(r.kept for r in same) == 1
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {(r.id, r.keep_id, r.kept) for r in empty} == {(1, 2, False), (2, 2, True)}
    kept = exact.keep_distinct(docs)
    assert kept.columns == docs.columns and kept.count() == len({t or "" for _, t in EDGES})
    assert exact.decide(docs.limit(0)).count() == 0


def test_exact_tells_colliding_digests_apart(spark, monkeypatch):
    """With a digest of four bits most texts collide; comparing the bytes of hits must part them."""
    from pyspark.sql import functions as F
    real = F.sha2
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: F.lpad(F.substring(real(c, n), 64, 1), 2, "0"))
    rows = [(k, f"text {k % 20}") for k in range(60)]
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact.decide(documents(spark, rows)).collect()}
    assert got == {k: (40 + k % 20, 3, k >= 40) for k in range(60)}


def test_exact_state_goes_on(spark, tmp_path):
    """A second batch of arrivals meets the state that the first one left."""
    light, updates, state = (str(tmp_path / x) for x in ("light", "updates", "state"))
    for batch in ([(1, "a"), (2, "b")], [(3, "a")]):
        docs = exact.located(documents(spark, batch))
        rows = exact.arrivals(docs)
        rows.write.mode("append").parquet(light)
        exact.stream_state(spark.readStream.schema(rows.schema).parquet(light), state, updates)
    got = {r.keep.id: r.group_size for r in exact.current_state(spark, updates).collect()}
    assert got == {3: 2, 2: 1}


def slow_fingerprint(t):
    level = fingerprints.level_of(len(t))
    zeros, i, j, out = fingerprints._zeros(6 * len(t) + 4096), 0, 0, []
    while i < len(t):
        if zeros[j] >= level:
            out.append(ord(t[i]))
        i += int(fingerprints.BITS[j % fingerprints.PERIOD][ord(t[i]) % fingerprints.KINDS])
        j += 1
    return f"{level:02x}." + "".join(f"{fingerprints._FOUR_BITS[c & 0xFFFF]:x}" for c in out)


def test_fingerprint_walks():
    t = ["", "a", "é😀"] + [sentence(k, 5 + 40 * k) for k in range(30)]
    assert fingerprints.fingerprints(t) == list(map(slow_fingerprint, t))
    a, b = sentence(1, 400), sentence(2, 400)
    x, y, z = fingerprints.fingerprints([a, a[:900] + "!" + a[900:], b])
    assert fingerprints.likeness(x, y) > 0.8 > 0.3 > fingerprints.likeness(x, z)


def test_fingerprints_with_next(spark):
    rows = [(k, sentence(k, 1 + k % 90)) for k in range(40)] + [(50, None), (51, "")]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(documents(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[:len(t) - len(t) // 3] + u[:len(t) // 3]
        own, other, following = map(slow_fingerprint, (t, e, u))
        assert tuple(got[i]) == (i, len(t), hashlib.sha256(e.encode()).hexdigest(), own, other,
                                 fingerprints.likeness(own, other), fingerprints.likeness(own, following))
    edge = fingerprints.compare_with_next(documents(spark, EDGES)).collect()
    assert sorted(str(r.doc_id) for r in edge) == sorted(str(i) for i, *_ in EDGES)
    assert fingerprints.compare_with_next(documents(spark, EDGES).limit(0)).count() == 0


def test_near_groups_by_fingerprint(spark):
    base = [sentence(k, 300) for k in range(10)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t[:500] + "~" + t[500:]) for k, t in enumerate(base)]
    got = {r.id: r.group_id for r in fingerprints.near_groups(documents(spark, rows)).collect()}
    assert sum(got[k] == got[100 + k] for k in range(10)) >= 9
    assert len({got[k] for k in range(10)}) == 10


def test_near_groups_across_level_limits(spark):
    limits = [fingerprints.SAMPLES << k for k in range(1, 6)]
    texts = [(n, c, sentence(100 * n + c, n)) for n in limits for c in range(6)]
    rows, pairs = [], []
    for k, (n, c, t) in enumerate(texts):
        a, at = t[:n - 1], n // 7 * (c + 1)
        rows += [(2 * k, a), (2 * k + 1, a[:at] + "~" + a[at:])]
        x, y = fingerprints.fingerprints([rows[-2][1], rows[-1][1]])
        assert x[:2] != y[:2]
        pairs.append((2 * k, fingerprints.likeness(x, y)))
    shorts = [sentence(9000 + k, 20)[:24 + 2 * k] for k in range(20)]
    for k, t in enumerate(shorts):
        rows += [(1000 + 2 * k, t), (1001 + 2 * k, t + "~")]
        pairs.append((1000 + 2 * k, fingerprints.likeness(*fingerprints.fingerprints([t, t + "~"]))))
    got = {r.id: r.group_id for r in fingerprints.near_groups(documents(spark, rows)).collect()}
    near = [k for k, s in pairs if s >= 0.88]
    assert len(near) >= 40 and all(got[k] == got[k + 1] for k in near)
    assert len({got[k] for k, _ in pairs}) == len(pairs)


def test_bands_of_many_unlike_fingerprints(spark):
    """Every pair of a band is verified, also when hundreds of unlike ones lie between, in one block and in several."""
    texts = [sentence(3000 + k, 100)[:600 + k] for k in range(300)]
    a = fingerprints.fingerprints(texts)
    b = fingerprints.fingerprints([f"{k % 7}~{k}" + t for k, t in enumerate(texts)])
    marks = a + b
    pairs = {(x, y) for i, x in enumerate(marks) for y in marks[:i] if fingerprints.likeness(x, y) >= 0.6}
    assert len(pairs) > 200 and {int(f[:2], 16) for f in marks} == {3}
    mixed = fingerprints.fingerprints([sentence(7, 200)[:n] for n in (500, 511, 512, 530, 1030, 90, 5, 0)])
    for x in range(8):
        for y in range(x):
            assert bool(fingerprints.links_of([mixed[x], mixed[y]], ["x", "y"], [0, 0], 0.7)) == (fingerprints.likeness(mixed[x], mixed[y]) >= 0.7)
    banded = spark.createDataFrame([("hot", f) for f in marks], "band string, fingerprint string")
    close = {tuple(r) for r in fingerprints._close_links(banded, 0.6).collect()}
    assert len({f for p in pairs for f in p} - {f for p in close for f in p}) > 100
    parent = {f: f for f in marks}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for x, y in pairs:
        lo, hi = sorted((root(x), root(y)))
        parent[hi] = lo
    want = {f: root(f) for f in marks if any(f in p for p in pairs)}
    for block in (1024, 64):
        assert {r.node: r.component for r in fingerprints.joined(banded, 0.6, block).collect()} == want
    assert fingerprints.joined(banded.limit(0), 0.6).count() == 0


def test_groups_are_cut_by_size(spark):
    """A passage that sets of unlike sizes share brings only those of like sizes together, once however many elements they share."""
    rule = signatures.Rule(85, 100)
    sizes = {"a": 100, "b": 95, "c": 50, "d": 10, "e": 9}
    members = spark.createDataFrame([(t, k.encode(), n) for t in range(30) for k, n in [*sizes.items(), (f"x{t}", 1000 + 500 * t)]], "token long, node binary, n long")
    small, large = jaccard._groups(members, rule)
    got = sorted((bytes(r.node).decode(), r.token, r.i) for r in small.collect())
    assert [x[0] for x in got] == ["a", "b", "d", "e"] and len({x[1:] for x in got}) == 2
    assert large.count() == 0


def test_open_parts_of_a_group():
    """Only members that may still link are looked at again, and few pairs are held at once."""
    rule = signatures.Rule(85, 100)
    whole = np.random.default_rng(3).integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = {f"n{k}": np.delete(whole, k) for k in range(40)} | {f"z{k}": np.random.default_rng(100 + k).integers(0, 1 << 63, 400, dtype=np.uint64) for k in range(20)}
    group = [{"token": 1, "i": 0, "j": 0, "part": b"", "side": 0, "node": k.encode(), "label": k.encode(), "n": len(s), "refuted": None,
              "signature": signatures.bitmap(s).tobytes(), "first": int(s.min() >> np.uint64(1))} for k, s in sets.items()]
    for held in (1, 1 << 17):
        before, jaccard.HELD = jaccard.HELD, held
        pairs, parts = jaccard._propose(rule, group, 0)
        jaccard.HELD = before
        assert len(pairs) == 39 and parts == [list(range(40))]
