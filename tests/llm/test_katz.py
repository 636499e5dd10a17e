"""The Katz model against dictionaries, at several orders, from its stored tables, and after a reload."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.llm import katz

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORDS.findall((text or "").translate(LOWER)) + ["\n"]


class PlainKatz:
    """A Katz model in dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            t = [" "] * (order - 1) + tokens(text)
            for i in range(order - 1, len(t)):
                for k in range(1, order + 1):
                    self.counts[k][tuple(t[i - k + 1 : i + 1])] += 1
        self.d = [None, *(self.factors(c) for c in self.counts[1:])]
        uni = self.counts[1]
        self.total = sum(uni.values())
        freed = sum((1 - self.d[1].get(c, 1)) * c for c in uni.values())
        self.top, self.spare = (self.total, freed) if freed > 1e-9 else (self.total + 1, 1)
        self.seen, mass, lower = Counter(), Counter(), defaultdict(float)
        self.weight = {}
        for k in range(2, order + 1):
            for g, c in self.counts[k].items():
                self.seen[g[:-1]] += c
                mass[g[:-1]] += self.d[k].get(c, 1) * c
                lower[g[:-1]] += self.p(g[1:])
            for v in {g[:-1] for g in self.counts[k]}:
                n = self.seen[v]
                self.seen[v] = n if n - mass[v] > 1e-9 * n else n + 1
                self.weight[v] = (self.seen[v] - mass[v]) / self.seen[v] / (1 - lower[v])

    @staticmethod
    def factors(counts):
        n = Counter(counts.values())
        d = {r: 1.0 for r in range(1, 6)}
        rest = 6 * n[6] / n[1] if n[1] else 1
        if rest < 1:
            for r in d:
                if n[r]:
                    x = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
                    d[r] = x if 0 < x <= 1 else 1.0
        return d

    def p(self, gram):
        """Probability of the last word after those before it."""
        k, c = len(gram), self.counts[len(gram)][gram]
        if k == 1:
            return self.d[1].get(c, 1) * c / self.top if c else self.spare / self.top
        if c:
            return self.d[k].get(c, 1) * c / self.seen[gram[:-1]]
        return self.weight.get(gram[:-1], 1.0) * self.p(gram[1:])

    def score(self, text):
        """n_tokens, n_known, train_tokens, base_score, score."""
        t, uni = tokens(text), self.counts[1]
        padded = [" "] * (self.order - 1) + t
        base = sum(math.log10((uni[(w,)] + 1) / (self.total + len(uni) + 1)) for w in t)
        return len(t), sum(uni[(w,)] > 0 for w in t), self.total, base, sum(math.log10(self.p(tuple(padded[i : i + self.order]))) for i in range(len(t)))


@pytest.fixture(scope="module")
def docs(spark, sf):
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "never seen wordsxyz here"), (None, "a b a b a b a b")], "doc_id long, text string")
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd)
    return table.select(F.col("doc_id").alias("key"), "text", F.coalesce(F.pmod("doc_id", F.lit(7)) != 2, F.lit(True)).alias("train")).repartition(3)


def scores(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near(got, want):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_dictionaries_and_come_from_the_tables(spark, docs, tmp_path, monkeypatch, order):
    monkeypatch.setattr(katz, "PART", 4000)
    monkeypatch.setattr(katz, "BUCKET", 1 << 18)
    model, found = katz.learn_and_score(docs, order, tokens=6000)
    assert min(model.bits.values()) > 0 and set(model.tables) == {"word", *(f"{n}{k}" for n in ("gram", "context") for k in range(2, order + 1))}
    held = docs.collect()
    plain = PlainKatz([r.text for r in held if r.train], order)
    want = sorted(((r.key, r.train, *plain.score(r.text)) for r in held), key=str)
    near(scores(found), want)
    # Of words that follow a context, and any other, the probabilities add up to one.
    words = list(plain.counts[1])
    for context in [(" ",) * (order - 1), *list(dict.fromkeys(g[:-1] for g in plain.counts[order]))[:: max(1, len(plain.counts[order]) // 5)][:5]]:
        assert sum(plain.p((*context, *w)) for w in words) + plain.p((*context, "\t")) == pytest.approx(1)
    # The stored tables answer for the same documents, alone and in other blocks, after a reload.
    model.save(f"file://{tmp_path}/m")
    loaded = katz.Model.load(spark, f"file://{tmp_path}/m")
    near(scores(katz.score_with(loaded, docs.repartition(2), tokens=2000)), want)


def test_tables_score_documents_that_were_not_there(spark, docs):
    learned = docs.where("train")
    model, _ = katz.learn_and_score(learned, 3)
    plain = PlainKatz([r.text for r in learned.collect()], 3)
    others = docs.where("not train or key < 0")
    near(scores(katz.score_with(model, others)), sorted(((r.key, r.train, *plain.score(r.text)) for r in others.collect()), key=str))


def test_tables_hold_the_counts(spark, docs):
    model, _ = katz.learn_and_score(docs, 2)
    plain = PlainKatz([r.text for r in docs.where("train").collect()], 2)
    words = {int(h): int(c) for r in model.tables["word"].collect() for h, c in zip(katz.unpack(r.a, np.uint64), katz.unpack(r.b, np.int64), strict=True)}
    want = dict(zip(katz.word_hash([w.encode() for (w,) in plain.counts[1]]).tolist(), plain.counts[1].values(), strict=True))
    assert {h: c for h, c in words.items() if c} == want
    grams = [int(c) for r in model.tables["gram2"].collect() for c in katz.unpack(r.c, np.int64) if c]
    assert Counter(grams) == Counter(plain.counts[2].values())


def test_nothing_to_learn_from(spark, docs):
    _, found = katz.learn_and_score(docs.withColumn("train", F.lit(False)))
    for r in found.collect():
        assert r.n_known == 0 == r.train_tokens and r.score == 0 == r.base_score
    model, found = katz.learn_and_score(docs.limit(0))
    assert found.count() == 0
    assert katz.score_with(model, docs).count() == docs.count()


def test_pairs_survive_packing():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        for most in (3, 1 << 40):
            pairs = np.unique(r.integers(0, most, (n, 2)).astype(np.uint64), axis=0)
            a, b = katz.unpack_pairs(*katz.pack_pairs(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])))
            assert (a == pairs[:, 0]).all() and (b == pairs[:, 1]).all()
