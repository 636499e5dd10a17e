"""Language identification against a plain version in dictionaries, and each text by itself."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.llm import language_id as L

MASK = (1 << 64) - 1
FAR = "/root/testdata/sf0.01"


def plain_counts(text):
    """Bucket to count of the character n-grams of a text."""
    low = "".join(c.lower()[0] if c.isalpha() else " " for c in f" {text or ''} ")
    while "  " in low:
        low = low.replace("  ", " ")
    c = [ord(x) for x in low]
    h = [x for x in c if x != 32]
    h += [a * 0x10001 + b + (1 << 58) for a, b in zip(c, c[1:], strict=False) if (a, b) != (32, 32)]
    h += [(a * 0x10001 + b) * 0x9E3779B1 + d + (1 << 60) for a, b, d in zip(c, c[1:], c[2:], strict=False) if b != 32]
    return Counter((x & MASK) * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - 13) for x in h)


def scaled(x):
    size = math.sqrt(sum(v * v for v in x.values())) or 1.0
    return {k: v / size for k, v in x.items()}


def dot(a, b):
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def total(rows):
    out = defaultdict(float)
    for r in rows:
        for k, v in r.items():
            out[k] += v
    return out


def plain_cluster(x, k):
    mean = total(x)
    start = [max(range(len(x)), key=lambda i: (dot(x[i], mean), -i))]
    near = [dot(r, x[start[0]]) for r in x]
    while len(start) < min(k, len(x)):
        far = min(range(len(x)), key=lambda i: (near[i], i))
        if near[far] > 1 - 1e-6:
            break
        start.append(far)
        near = [max(a, dot(r, x[far])) for a, r in zip(near, x, strict=True)]
    c = [x[i] for i in start]
    for _ in range(L.ITERATIONS):
        owner = [max(range(len(c)), key=lambda j, r=r: (dot(r, c[j]), -j)) for r in x]
        new = [scaled(total([r for r, o in zip(x, owner, strict=True) if o == j])) if j in owner else c[j] for j in range(len(c))]
        same = all(abs(a.get(k, 0) - b.get(k, 0)) <= 1e-6 + 1e-5 * abs(b.get(k, 0)) for a, b in zip(new, c, strict=True) for k in {*a, *b})
        if same:
            break
        c = new
    return c


def plain_fit(rows):
    """rows: (lang, text) of each language in order of the sample."""
    counts = [(lang, plain_counts(t)) for lang, t in rows]
    counts = [(lang, c) for lang, c in counts if c]
    df = Counter(k for _, c in counts for k in c)
    idf = lambda k: math.log((1 + len(counts)) / (1 + df[k])) + 1
    vector = lambda c: scaled({k: (1 + math.log(n)) * idf(k) for k, n in c.items()})
    out = []
    for lang in sorted({x for x, _ in counts}):
        own = [vector(c) for x, c in counts if x == lang]
        measured = [v for i, v in enumerate(own) if i % L.MEASURED == L.MEASURED - 1]
        centroids = plain_cluster([v for i, v in enumerate(own) if i % L.MEASURED != L.MEASURED - 1], L.CENTROIDS)
        cosines = sorted(max(dot(v, c) for c in centroids) for v in (measured or own))
        place = (len(cosines) - 1) * L.REJECT_PERCENTILE / 100
        low = cosines[int(place)] + (place - int(place)) * (cosines[min(int(place) + 1, len(cosines) - 1)] - cosines[int(place)])
        out += [(lang, c, L.REJECT_SHARE * low) for c in centroids]

    def predict(text):
        c = plain_counts(text)
        if not c:
            return "und", 0.0, True
        v = vector(c)
        score, _, lang, limit = max((dot(v, x), -i, lang, limit) for i, (lang, x, limit) in enumerate(out))
        return lang, min(1.0, score), score < limit * (L.SHORT_SHARE if sum(c.values()) < L.SHORT else 1)

    return predict


def sampled(spark, docs, per_language):
    """The rows that fit() learns from, in its order."""
    rows = L.learned_rows(docs, F.col("doc_id")).where("lang is not null and text is not null").withColumn("h", F.xxhash64("doc_id")).orderBy("lang", "h", "doc_id", "text").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.lang].append((r.lang, r.text))
    return [x for lang in sorted(by) for x in by[lang][:per_language]]


def test_counts_equal_a_plain_version():
    texts = ["", None, "a", "The  River, and\nthe HOUSE!", "123 !!! 456", "İstanbul ǅ ß 日本語", " x ", "é" * 50, "one two " * 300]
    text, bucket, n = L.count_grams(texts)
    for k, t in enumerate(texts):
        assert dict(zip(bucket[text == k].tolist(), n[text == k].tolist(), strict=True)) == plain_counts(t)


def test_long_texts_are_counted_whole(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 64)
    t = "the river and the house of stone " * 40
    _, bucket, n = L.count_grams([t])
    assert dict(zip(bucket.tolist(), n.tolist(), strict=True)) == plain_counts(t)


def test_fit_and_predict_equal_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.fit(L.learned_rows(docs, F.col("doc_id")), per_language=24)
    plain = plain_fit(sampled(spark, docs, 24))
    texts = [r.text for r in docs.select("text").collect()] + [None, "", "123", "qzxj vwkq zzqx " * 30]
    lang, score, rejected = model.predict(texts)
    for k, t in enumerate(texts):
        want = plain(t)
        assert lang[k] == want[0] and score[k] == pytest.approx(want[1], abs=1e-5) and rejected[k] == want[2], t


def test_each_text_is_predicted_by_itself(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.fit(L.learned_rows(docs, F.col("doc_id")))
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    odd = ["123 !!! 456", "the river and the house", "", None, " ", "...", "a", "und", "!!!", "der Fluss und das Haus"]
    texts = [x for pair in zip(texts[: 8 * len(odd)], odd * 8, strict=True) for x in pair]
    alone = [tuple(y[0] for y in model.predict([t])) for t in texts]
    for size in (2, 7, 64, len(texts)):
        got = []
        for at in range(0, len(texts), size):
            got += zip(*model.predict(texts[at : at + size]), strict=True)
        assert got == alone
    order = random.Random(1).sample(range(len(texts)), len(texts))
    assert list(zip(*model.predict([texts[i] for i in order]), strict=True)) == [alone[i] for i in order]
    for t, (lang, score, rejected) in zip(texts, alone, strict=True):
        if not any(c.isalpha() for c in t or ""):
            assert (lang, score, rejected) == ("und", 0, True)


def test_predictions_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(["123 !!! 456", None, "?"])], "doc_id long, text string"), allowMissingColumns=True)
    model = L.fit(L.learned_rows(docs, F.col("doc_id")))
    want = None
    for made in (docs.coalesce(1), docs.repartition(7), docs.repartition(3, "source").sortWithinPartitions("text")):
        got = sorted(tuple(r) for r in L.identify(made, model, keep=["doc_id"]).collect())
        assert want is None or got == want
        want = got
    assert [r[1:] for r in want if r[0] >= 10**6] == [("und", 0.0, True)] * 3


def test_limit_rejects_what_is_far_and_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{FAR}/documents.parquet")
    model = L.fit(L.learned_rows(docs, F.col("doc_id")))
    r = np.random.default_rng(3)
    odd = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz     "), n)) for n in (300, 1000, 5000)]
    odd.append("Suomi on tasavalta Pohjois-Euroopassa ja sen naapurimaita ovat Ruotsi, Norja ja Venäjä. Maan pääkaupunki on Helsinki, ja siellä asuu yli kuusisataatuhatta ihmistä. Kesällä päivät ovat pitkiä ja valoisia.")
    odd.append("Polska jest państwem w Europie Środkowej, położonym między Morzem Bałtyckim a Sudetami i Karpatami. Stolicą kraju jest Warszawa, w której mieszka prawie dwa miliony ludzi.")
    odd += ["日本語のテキストです。これは未知の文字です。" * 3, "Это текст на другом языке, написанный другими буквами. " * 3, "for (int i = 0; i < n; i++) printf(\"%d\", x[i]); return 0; } " * 5]
    assert model.predict(odd)[2].all()
    labels = spark.read.parquet(f"{FAR}/labels.parquet").where("quality = 1")
    clean = [x.text for x in docs.join(labels, "doc_id").collect()]
    assert len(clean) > 300 and not model.predict(clean)[2].any()
