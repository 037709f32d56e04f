"""Language, toxicity, URL rules, archives, and the pipeline."""

import base64
import gzip
import io
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualNullSafe, EqualTo, In, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith

import corpus_pipeline
from fedtab.functions.common import stage
from fedtab.llm import language, toxicity, urls, warc
from tests.llm.helpers import EDGES, documents, sentence
from tests.llm.test_dedup import groups
from tests.llm.test_tokens import check_pieces


def slow_counts(text):
    """N-grams of one to three letters with one blank at a word's ends, counted one by one."""
    out, word = {}, ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            fenced = f" {word} "
            grams = list(word) + [fenced[i:i + 2] for i in range(len(fenced) - 1)] + [fenced[i:i + 3] for i in range(len(fenced) - 2)]
            for g in grams:
                out[g] = out.get(g, 0) + 1
            word = ""
    return out


def packed(g):
    n = 0
    for c in g:
        n = n << 21 | ord(c)
    return n


def test_gram_counts():
    for t in ("", None, "The cat. É\nsat!", "a", "12 3", "x" * 50 + " yé"):
        grams, counts = language.gram_counts(t)
        assert dict(zip(grams.tolist(), counts.tolist())) == {packed(g): n for g, n in slow_counts(t).items()}


def test_distance_by_hand():
    profiles = [("aa", [packed(g) for g in ("a", " a", "b")]), ("bb", [packed(g) for g in ("b", " b", "a")])]
    judge = language.Judge(profiles, size=3)
    own = language.own_profile("a a b").tolist()
    for name, p in profiles:
        far = sum(min(abs(p.index(g) - k), 3) if g in p else 3 for k, g in enumerate(own))
        if judge("a a b")[0] == name:
            assert judge("a a b")[1] == 1 - far / (3 * len(own))
    assert judge("1 2") == ("und", 0.0) and language.Judge([])("abc") == ("und", 0.0)


def test_language_query_on_held_out_rows(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    lang = dict(zip(t["doc_id"], t["lang"]))
    rows = language.op1_language(spark, sf).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_edges(spark):
    learned = language.learn(documents(spark, [(k, sentence(k, 50), "en") for k in range(5)] + [(9, "über schön", None), (None, "x", "fr")]))
    assert [n for n, _ in learned] == ["en"]
    docs = documents(spark, EDGES).withColumn("score", F.lit("clash"))
    kept = language.keep_known(docs, learned, least=0.0)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t, *_ in EDGES if any(c.isalpha() for c in t or ""))
    assert language.keep_known(docs.limit(0), learned).count() == 0
    assert language.learn(docs.limit(0)) == []


def test_language_filter_drops_what_is_no_language(spark):
    """Letter noise and encoded bytes go; every document of the table stays, short ones too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = language.learn(docs)
    rng = random.Random(4)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for n in (12, 40, 200, 3000)]
    noise += [base64.b64encode(rng.randbytes(n)).decode() for n in (60, 900, 9000)]
    made = documents(spark, [(-i, t) for i, t in enumerate(noise, 1)])
    both = docs.select(*made.columns).unionByName(made)
    kept = {r.doc_id for r in language.keep_known(both, learned).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_toxicity_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    label = dict(zip(*[pq.read_table(f"{d}/labels.parquet").column(c).to_pylist() for c in ("doc_id", "toxic")]))
    rows = toxicity.op10_toxicity(spark, d).collect()
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.9 * len(held)


def test_toxicity_locates_sentences(spark):
    bad = "zzrotten zzvile"
    rows = [(k, ". ".join([sentence(k, 12), sentence(k + 500, 9), bad if k >= 30 else "plain words", sentence(k + 900, 10)])) for k in range(60)]
    labels = spark.createDataFrame([(k, int(k >= 30)) for k in range(60)] + [(None, 1), (70, None), (4, 7)], "doc_id bigint, toxic int")
    model = toxicity.train(documents(spark, rows), labels)
    docs = documents(spark, [(1, f"Fine start. You {bad} thing. Fine end."), (2, sentence(77, 4000)), (3, None), (4, "")]).withColumn("weights", F.lit(1))
    got = {r.doc_id: r for r in toxicity.score(docs, model, where_name="where").collect()}
    assert got[1].score >= 0.5 and [w.sentence for w in got[1].where] == [1]
    assert all(got[k].score < 0.5 and not got[k].where for k in (2, 3, 4))
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert sorted(r.doc_id for r in toxicity.keep_clean(docs, model).collect()) == [2, 3, 4]


def test_toxicity_learns_from_long_documents(spark, monkeypatch):
    """Documents of some 27,000 characters count like others; beyond the budget whole documents are passed over."""
    rows = [(k, ". ".join([sentence(k, 3000), "zzrotten zzvile" if k % 2 else "plain words", sentence(k + 900, 200)])) for k in range(60)]
    docs, labels = documents(spark, rows), spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, toxic int")
    weights, _ = toxicity.train(docs, labels)
    assert (weights != 0).any()
    size = max(len(t) for _, t in rows)
    monkeypatch.setattr(toxicity, "TOXIC_CHARS", 12 * size)
    monkeypatch.setattr(toxicity, "CLEAN_CHARS", 1)
    got = toxicity.training_sample(docs, labels).collect()
    assert {r.text for r in got} <= {t for _, t in rows}
    assert sum(r.label for r in got) >= 12 and sum(1 - r.label for r in got) == toxicity.LEAST_EACH


def test_toxicity_score_is_the_noisy_or_of_its_sentences(spark):
    """Scores of a document against the formula over plain Python features."""
    rng = random.Random(3)
    words = ["good", "awful", "Nasty", "tree", "naïve", "x1", "STONE"]
    texts = [" ".join(rng.choice(words) + rng.choice([" ", ". ", "! ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(40)] + [None, "", "..."]
    weights, bias = np.random.default_rng(1).exponential(0.4, toxicity.BUCKETS).astype(np.float32), -3.0
    docs = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: r.score for r in toxicity.score(docs, (weights, bias)).collect()}
    for i, text in enumerate(texts):
        clean = 1 / (1 + math.exp(bias))  # the leak
        for s in re.split(r"[.!?\n]+", text or ""):
            z = bias + sum(float(weights[f]) for piece in set(s.split()) for f in toxicity.word_features(piece))
            clean *= (1 + math.exp(bias)) / (1 + math.exp(z))
        assert abs(got[i] - (1 - clean)) < 1e-6, text


def plain_fit(rows, rounds):
    """The fit as formulas over plain lists: each word of each sentence with each of its buckets."""
    bags = [[[toxicity.word_features(w) for w in dict.fromkeys(s.split())] for s in toxicity.sentences(t)] for t, _ in rows]
    y = np.asarray([label for _, label in rows], float)
    seen = np.zeros(toxicity.BUCKETS)
    for t, _ in rows:
        for w in {w for s in toxicity.sentences(t) for w in s.split()}:
            np.add.at(seen, toxicity.word_features(w), 1)
    common = seen >= toxicity.LEAST_DOCUMENTS
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w, bias = np.zeros(toxicity.BUCKETS), toxicity.FIRST_BIAS
    m, v, mb, vb = 0 * w, 0 * w, 0.0, 0.0
    for t in range(1, rounds + 1):
        grad, grad_bias, leak = toxicity.SPARSITY * common * len(y), 0.0, math.log1p(math.exp(bias))
        for bag, label, weight in zip(bags, y, share):
            z = [bias + sum(w[f].sum() for f in s) for s in bag]
            none = leak + sum(math.log1p(math.exp(x)) - leak for x in z)
            pull = weight * (-1 / math.expm1(min(max(none, 1e-9), 50.0)) if label else 1.0)
            for x, s in zip(z, bag):
                for f in s:
                    np.add.at(grad, f, pull / (1 + math.exp(-x)))
                grad_bias += pull / (1 + math.exp(-x))
            grad_bias += (1 - len(bag)) * pull / (1 + math.exp(-bias))
        grad, grad_bias = np.where(common, grad, 0) / len(y), grad_bias / len(y)
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2, 0.9 * mb + 0.1 * grad_bias, 0.99 * vb + 0.01 * grad_bias ** 2
        step = toxicity.RATE / (1 - 0.9 ** t)
        w = np.maximum(w - step * m / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6), 0.0)
        bias -= step * mb / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-6)
    return w, bias


def test_toxicity_fit_is_the_plain_one(spark, monkeypatch):
    """Weights against plain formulas, by sums over short runs; texts without sentences, words without letters, rare words."""
    monkeypatch.setattr(toxicity, "RUN", 7)
    rows = [(". ".join([sentence(k, 6 + k % 5), "12 34", "zzrotten zzvile, ZZvile" if k % 3 == 0 else "plain words", f"rare{k}"]), int(k % 3 == 0))
            for k in range(24)] + [("", 0), ("...", 1), ("7 8 9", 0)]
    w, bias = plain_fit(rows, 12)
    got = toxicity.fit(iter(rows), 12)
    assert (w > 0).any() and np.allclose(got[0], w, rtol=1e-9, atol=1e-9) and abs(got[1] - bias) < 1e-9
    assert not toxicity.fit([("...", 1), ("", 0)])[0].any() and not toxicity.fit([("1 2", 1), ("3", 0)])[0].any()
    # the task reads the same rows in the order of their identifiers as strings
    docs, labels = documents(spark, [(k, t) for k, (t, _) in enumerate(rows)]), spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")
    trained = toxicity.train(docs, labels)
    w, bias = toxicity.fit([rows[k] for k in sorted(range(len(rows)), key=str)])
    assert np.allclose(trained[0], w, rtol=1e-5, atol=1e-5) and abs(trained[1] - bias) < 1e-6


def test_toxicity_fit_holds_little_beside_the_words(monkeypatch):
    """Per word of the sample the fit holds a few bytes, not lists and index arrays of the full length."""
    monkeypatch.setattr(toxicity, "BUCKETS", 1 << 12)
    monkeypatch.setattr(toxicity, "RUN", 1 << 12, raising=False)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    n = 0

    def rows():
        nonlocal n
        for k in range(3000):
            n += 200
            yield " ".join(words[k % 400:k % 400 + 200]), k % 2

    tracemalloc.start()
    try:
        toxicity.fit(rows(), 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 15 * n, (peak, n)


def test_toxicity_without_anything_to_learn(spark):
    docs = documents(spark, EDGES)
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert all(r.score < 0.5 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


URLS = [(1, None), (2, "no scheme"), (3, "HTTP://A.COM"), (4, "http://WWW.Example.com/en/?x"), (5, "x://É.Net/es/a://b"), (6, "http://a.net?/es/"),
        (7, "http://example.com/en/x#/"), (8, ""), (9, "http://notexample.com/en/"), (10, "http://a.com/x y\nz"), (11, "http://net/fr/"),
        (11, "http://net/fr/"), (12, "://h/p"), (None, "http://q.org/EN/")]


def slow_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        cut = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
        path = rest[:cut]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, verdict
    return host, path, best


def test_url_rules_and_model(spark, sf):
    model = urls.train(urls.training_urls(spark))
    weights, bias = model.coefficients.toArray(), model.intercept
    rows = URLS + list(zip(*[pq.read_table(f"{sf}/pages.parquet").column(c).to_pylist() for c in ("page_id", "url")]))
    table = spark.createDataFrame(rows, "page_id bigint, url string")
    got = urls.judge(table, model).collect()
    vectors = [r["__features"] for r in urls.features(table).collect()]
    assert len(got) == len(rows)
    for (i, u), r, v in zip(rows, got, vectors):
        host, path, best = slow_url(u)
        score = 1 / (1 + np.exp(-(bias + weights[v.indices].sum())))
        assert (r.page_id, r.host, r.path, r.rule) == (i, host, path, best[0] if best else None)
        assert abs(r.score - score) < 1e-9
        assert r.verdict == (best[1] if best else "block" if r.score >= 0.5 else "allow")
    assert urls.judge(table.limit(0), model).count() == 0


def test_url_model_on_new_sites(spark):
    new = [(0, "https://www.castle-museum.org/en/7"), (0, "http://weather.example.net/de/1"), (1, "https://m.cheap-pills.net/en/9/"), (1, "http://spam-farm.example.org/fr/3")]
    table = spark.createDataFrame([(k, u) for k, (_, u) in enumerate(new)], "page_id bigint, url string")
    model = urls.train(urls.training_urls(spark))
    assert [int(r.score >= 0.5) for r in urls.judge(table, model).collect()] == [y for y, _ in new]


def test_archives_come_back(spark, tmp_path):
    warc.register(spark)
    long = "p" * 200
    rows = [(3, "http://a/\r\nX: y", long), (1, "http://b/", long), (2, None, "é" * 49), (5, "u", "é" * 49), (4, "http://c/", None), (6, "v", "WARC/1.1\r\n\r\nx" * 20),
            (1, "http://b/", long), (None, "w", long)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for compression in ("gzip", "none"):
        folder = str(tmp_path / compression)
        warc.archive_rows(pages).write.format("warc").option("compression", compression).mode("append").save(folder)
        everything = spark.read.format("warc").load(folder)
        kinds = [r.warc_type for r in everything.collect()]
        assert kinds.count("response") == 5 and kinds.count("revisit") == 3 and kinds.count("warcinfo") >= 1
        got = everything.filter("warc_type = 'response'").collect()
        assert sorted(bytes(r.payload) for r in got) == sorted(x.encode() for x in (long, "é" * 49, "é" * 49, "", rows[5][2]))
        again = everything.filter("warc_type = 'revisit' and record_id <> '<urn:page:1>'").collect()
        assert {(r.record_id, r.refers_to, r.payload) for r in again} == {("<urn:page:3>", "<urn:page:1>", b""), ("<urn:page:unknown>", "<urn:page:1>", b"")}
        light = spark.read.format("warc").schema("record_id string, target_uri string").load(folder).filter("target_uri like 'http://a%'")
        assert [tuple(r) for r in light.collect()] == [("<urn:page:3>", "http://a/%0D%0AX: y")]
        assert "FilterExec" not in light._jdf.queryExecution().executedPlan().toString()
    folder = str(tmp_path / "empty")
    warc.archive_rows(pages.limit(0)).write.format("warc").mode("append").save(folder)
    assert spark.read.format("warc").load(folder).filter("warc_type in ('response', 'revisit')").count() == 0


def test_pushed_filters_agree_with_spark(spark, tmp_path):
    """Every kind of filter, plain and negated, on records with and without the header."""
    warc.register(spark)
    folder = str(tmp_path / "pushed")
    rows = [(i, f"http://a/{i % 3}" if i % 4 else None, "p" * 200 + str(i % 2)) for i in range(1, 9)]
    warc.archive_rows(spark.createDataFrame(rows, "page_id bigint, url string, html string")).write.format("warc").mode("append").save(folder)
    everything = spark.read.format("warc").load(folder)
    held = spark.createDataFrame(everything.collect(), everything.schema)
    conditions = [f"{c} {test}" for c, v in (("refers_to", "<urn:page:1>"), ("target_uri", "http://a/1"), ("warc_type", "response")) for test in (
        f"= '{v}'", f"<=> '{v}'", "<=> NULL", f"IN ('{v}', 'b')", f"IN ('{v}', 'b', NULL)", "IS NULL", "IS NOT NULL", "= NULL",
        f"LIKE '{v[:6]}%'", f"LIKE '%{v[-3:]}'", f"LIKE '%{v[2:5]}%'")]
    for condition in conditions:
        for full in (condition, f"NOT ({condition})", f"NOT ({condition}) AND record_id <> '<urn:page:3>'"):
            got, want = (sorted(r.record_id for r in t.filter(full).select("record_id").collect()) for t in (everything, held))
            assert got == want, full
    names = ["refers_to"]
    for f, missing in ((EqualNullSafe(names, "a"), False), (EqualNullSafe(names, None), True), (IsNull(names), True), (IsNotNull(names), False)):
        assert warc._predicate(f)[1](None) is missing and warc._predicate(Not(f))[1](None) is not missing
    for f in (EqualTo(names, "a"), In(names, ("a", "b")), StringStartsWith(names, "a"), StringEndsWith(names, "a"), StringContains(names, "a")):
        for value in (None, "a", "x"):
            assert warc._predicate(f)[1](value) is (value == "a") and warc._predicate(Not(f))[1](value) is (value == "x")
    assert warc._predicate(In(names, ("a", None))) is None and warc._predicate(Not(In(names, ("a", None)))) is None


def test_archives_grow_by_appends(spark, tmp_path):
    warc.register(spark)
    folder = str(tmp_path / "grown")

    def write(ids, mode, **options):
        pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>") for i in ids], "page_id bigint, url string, html string")
        warc.archive_rows(pages).write.format("warc").options(**options).mode(mode).save(folder)

    def there():
        return sorted(r.target_uri for r in spark.read.format("warc").load(folder).filter("warc_type = 'response'").collect())

    (tmp_path / "grown").mkdir()
    (tmp_path / "grown" / "other.warc").write_bytes(warc.record("response", {"WARC-Target-URI": "http://other/"}, b"x"))
    write([1, 2], "append")
    write([3], "append", compression="none")
    write([], "append")
    write([2], "append")
    assert there() == ["http://a/1", "http://a/2", "http://a/2", "http://a/3", "http://other/"]
    write([7], "overwrite")
    assert there() == ["http://a/7"]
    write([8], "append")
    assert there() == ["http://a/7", "http://a/8"]
    (tmp_path / "grown" / "part-00000000000000000000000000000000.warc").write_bytes(b"left by a failed task")
    assert there() == ["http://a/7", "http://a/8"]
    write([], "overwrite")
    assert there() == []


def test_unwanted_blocks_are_not_read():
    blocks = [b"A" * 10, b"B" * 10]
    raw = b"".join(warc.record(k, {"Content-Type": "text/plain"}, b) for k, b in zip(("response", "metadata"), blocks))

    class Watched(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            self.taken += n
            return super().read(n)

    stream = Watched(raw)
    got = list(warc.parse(stream, lambda h: h["warc-type"] == "metadata", True))
    assert [b for _, b in got] == [blocks[1]] and stream.taken == 10
    assert [b for _, b in warc.parse(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(raw))), lambda h: True, True)] == blocks


def test_pipeline_stages(spark, sf):
    """Each stage on its own input, against a plain count of what it should keep."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = [docs]
    for _, function in corpus_pipeline.STAGES:
        kept.append(stage(function(spark, kept[-1], sf)))
    assert all(k.columns == names for k in kept[:5])
    known, clean, single, apart = ([(r.doc_id, r.text) for r in k.select("doc_id", "text").collect()] for k in kept[1:5])
    assert len(known) >= 0.99 * docs.filter("text rlike '[a-z]'").count()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {i for i, _ in known} - {i for i, _ in clean}
    assert all(label.get(i, 1) == 1 for i in gone)
    last = {}
    for i, t in clean:
        last[t] = max(i, last.get(t, i))
    assert sorted(i for i, _ in single) == sorted(last.values())
    assert sorted(i for i, _ in apart) == sorted({int(c) if n else int(i) for i, n, c in groups(single, 5, 80, 100)})
    check_pieces(kept[5].collect(), apart)


def test_pipeline_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and 4 <= len(corpus_pipeline.STAGES) <= 5
