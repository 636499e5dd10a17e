"""The divergence audit against plain counting, on whole and odd tables and with many blocks."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veldspar.llm import divergence
from veldspar.llm import queries as Q

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10):
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    out = set()
    for lang in {g for _, g, _ in rows}:
        own = [(TERM.findall(t.translate(LOWER)), s) for t, g, s in rows if g == lang]
        in_docs = Counter(x for words, _ in own for x in set(words))
        kept = [x for x, n in in_docs.items() if n >= least]
        counts = {s: Counter() for _, s in own}
        for words, s in own:
            counts[s].update(words)
        whole = sum(counts.values(), Counter())

        def share(c):
            n = sum(c[x] for x in kept) + 2 * len(kept)
            return {x: 1 + 10**9 * (c[x] + 2) // n for x in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(o, sum(f(p[s][x], p[o][x]) for x in kept)) for o in counts if o != s]
            terms = [(x, f(p[s][x], q[x])) for x in kept if counts[s][x] and p[s][x] > q[x]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                for i, (x, v) in enumerate(sorted(found, key=lambda y: (-y[1], y[0].encode()))[:most], 1):
                    out.add((lang, s, part, x, v, i))
    return out


def same(df, rows, least=10):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, least)


@pytest.mark.parametrize(("entries", "batch"), [(1 << 15, 8 << 20), (20, 500)])
def test_against_plain(spark, entries, batch):
    r = random.Random(2)
    words = ["Haus", "straße", "x", "ÄB", "don't", "a1b", "東京", "l'été", "foo_bar", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8))]
    rows = [(" ".join(r.choice(words) for _ in range(r.randrange(60))), r.choice(["de", "en", None, ""]), r.choice(["s1", "s2", "S2", None, "ü", "zz"])) for _ in range(300)]
    rows += [(None, "en", "s1"), ("", None, None), ("123 --", "fi", "only"), ("rare words", "fi", "other"), (None, "xx", None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    same(divergence.audit(docs, entries=entries), rows) if batch == 8 << 20 else None
    counted = divergence.term_counts(docs, batch=batch).where("term is not null").collect()
    want = Counter(((g or "", s or "", x)) for t, g, s in rows for x in TERM.findall((t or "").translate(LOWER)))
    assert {(c.lang, c.source, c.term): c.n for c in counted} == want
    same(divergence.audit(docs, entries=20), rows)


def test_query(spark, sf):
    docs = Q.read(spark, sf, "documents").toPandas()
    same(Q.op11_divergence(spark, sf), list(docs[["text", "lang", "source"]].itertuples(index=False, name=None)))


def test_edges(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
    rows = [("word " * 200_000, "en", "a"), ("word other", "en", "b")] + [("word", "en", "c")] * 9
    docs = spark.createDataFrame([(*x, "kept", 1) for x in rows], "text string, lang string, source string, part string, rank int")
    same(divergence.audit(docs), rows)
    one = [("some words", "en", "a")] * 12
    same(divergence.audit(spark.createDataFrame(one, "text string, lang string, source string")), one)


def test_collisions_join_nothing():
    data = np.frombuffer(b"ab cd ab ef abc", np.uint8)
    begins, ends = divergence.slices(data, np.array([0, 15]))
    numbers, firsts = divergence.grouped(data, begins, ends, np.zeros(5, np.uint64))
    assert len(firsts) == 4 and numbers[0] == numbers[2] and len(set(numbers.tolist())) == 4


def test_terms_end_with_texts():
    texts = pa.array(["ab", None, "cd ", "", "éf"])
    data, at = divergence.buffers(texts.slice(0))
    begins, ends = divergence.slices(data, at)
    assert [data[b:e].tobytes().decode() for b, e in zip(begins, ends, strict=True)] == ["ab", "cd", "éf"]
    assert divergence.buffers(texts.slice(2, 2))[1].tolist() == [0, 3, 3]


def test_exact_shares():
    r = random.Random(3)
    for _ in range(200):
        whole = r.randrange(1, 9 * 10**15)
        part = r.randrange(whole + 1)
        assert divergence.scaled(np.array([part]), whole)[0] == 1 + 10**9 * part // whole
    with pytest.raises(ValueError):
        divergence.scaled(np.array([1]), 1 << 60)
