"""The near-duplicate stage against all pairs, links that hang on nothing but their two texts, and its bit planes."""

import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_pipeline import plain_near, shingles
from veldspar.llm import near_copies, simhash

DOCS = "doc_id long, text string"


def found(spark, texts, **how):
    df = spark.createDataFrame(list(texts.items()), DOCS).repartition(4)
    return {r.doc_id: r.component_id for r in near_copies.components(df, **how).collect()}


def test_distances_on_planes():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, (9, 16), dtype=np.uint64)
    rows = [base, *(base ^ (r.random((9, 16, 64)) < p) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)) for p in (0.05, 0.1, 0.15, 0.18, 0.2, 0.3)), r.integers(0, 1 << 63, (150, 16), dtype=np.uint64)]
    prints = np.concatenate(rows)
    far = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2)
    for limit in (0, 7, 100, 163, 194, 255, 600):
        got = np.unpackbits(simhash.within(prints, prints, limit).view(np.uint8), axis=1, bitorder="little")[:, : len(prints)]
        assert (got.astype(bool) == (far <= limit)).all()


def test_bit_counts():
    r = np.random.default_rng(4)
    for n in (0, 1, 7, 254, 255, 256, 700):
        x = r.integers(0, 1 << 64, (3, n), dtype=np.uint64)
        want = [[int(((row >> np.uint64(k)) & np.uint64(1)).sum()) for k in range(64)] for row in x]
        assert near_copies.bit_counts(x).tolist() == want


def test_pairs_by_similarity(spark):
    """Pairs of random texts of which 0.6 to 1 of the shingles are shared: those from 0.8 on are linked, no other is."""
    r = random.Random(11)
    words = [f"word{i}" for i in range(4000)]
    texts = {}
    for i in range(400):
        text = [r.choice(words) for _ in range(r.randint(60, 400))]
        changed = text[:]
        for at in r.sample(range(len(text)), max(1, len(text) // r.choice([20, 30, 40, 60, 100]))):
            changed[at] = r.choice(words)
        texts |= {2 * i: " ".join(text), 2 * i + 1: " ".join(changed)}
    got, caught = found(spark, texts), Counter()
    for i in range(400):
        a, b = shingles(texts[2 * i]), shingles(texts[2 * i + 1])
        like = len(a & b) / len(a | b)
        caught[min(int(like * 20), 19), got[2 * i] == got[2 * i + 1]] += 1
        assert got[2 * i] == 2 * i and got[2 * i + 1] in (2 * i, 2 * i + 1) and (like >= 0.8 or got[2 * i + 1] == 2 * i + 1)
    assert caught[16, True] >= 0.99 * (caught[16, True] + caught[16, False]) > 20 and not caught[17, False] and not caught[18, False] and caught[15, False] > 20


@pytest.mark.parametrize(("block", "families"), [(8, 2), (4096, 6)])
def test_hot_families_and_third_texts(spark, block, families):
    """Families of texts around 0.8, in which most candidates fail and few hold: the components of all pairs, whatever the blocks."""
    r = random.Random(2)
    texts, words = {}, [f"w{i}" for i in range(900)]
    for family in range(families):
        base = [r.choice(words) for _ in range(120)]
        for i in range(25):
            own = base[:]
            for at in r.sample(range(120), r.choice([0, 1, 2, 3, 4])):
                own[at] = r.choice(words)
            texts[1000 - family * 100 - i] = " ".join(own)
    want = plain_near(texts)
    sets = {k: shingles(t) for k, t in texts.items()}
    like = [len(a & b) / len(a | b) for i, a in sets.items() for j, b in sets.items() if i < j and (i - 1000) // 100 == (j - 1000) // 100]
    assert sum(0.6 < x < 0.8 for x in like) > 50 * families and len(set(want.values())) > 2 * families
    if block == 4096:
        assert found(spark, texts, block=block) == want
    # Without the least of each component the others' links stay as they are.
    rest = {k: t for k, t in texts.items() if want[k] != k}
    assert found(spark, rest, block=block) == plain_near(rest)


def test_texts_that_repeat_one_shingle(spark):
    """One shingle that is most of a text sets most bits of a print; the sets decide all the same."""
    texts = {i: "spam " * 200 + " ".join(f"{w}{i}" for w in "abcdefghij") for i in range(6)} | {10: None, 11: "", 12: "one two", 13: "ONE  two", 14: "one two three"}
    assert found(spark, texts) == plain_near(texts) == {**{i: i for i in range(6)}, 10: 10, 11: 10, 12: 12, 13: 12, 14: 14}
    assert near_copies.first_rows(spark.createDataFrame([], DOCS)).collect() == []


def test_what_fails_is_not_asked_again(spark, monkeypatch):
    """A family of which most pairs are candidates that fail: no table of the stage has more rows than its texts have keys."""
    r, texts, rows = random.Random(7), {}, {}
    words = [f"w{i}" for i in range(900)]
    base = [r.choice(words) for _ in range(150)]
    for i in range(90):
        own = base[:]
        for at in r.sample(range(150), 3):
            own[at] = r.choice(words)
        texts[i] = " ".join(own)
    held = near_copies.materialise

    def counted(df, name, *how):
        made = held(df, name, *how)
        rows[name] = max(rows.get(name, 0), made.count())
        return made

    monkeypatch.setattr(near_copies, "materialise", counted)
    want = plain_near(texts)
    assert found(spark, texts) == want and 1 < len(set(want.values())) < 90
    assert max(rows.values()) <= near_copies.BANDS * len(texts), rows


def test_large_parts_of_small_keys(spark):
    """A chain of texts, each near the next alone: its parts are dealt out by keys, a family's as pairs of pieces."""
    words = [f"w{i}" for i in range(2600)]
    chain = {i: " ".join(words[12 * i : 12 * i + 200]) for i in range(200)}
    family = {1000 + i: " ".join(words[:150] + [f"end{i}"]) for i in range(40)}
    assert found(spark, chain | family, block=8) == {k: min(k // 1000 * 1000, k) for k in chain | family}
    docs = spark.createDataFrame([(k, 0, k, [k], 10) for k in range(40)] + [(k, 1, k, [0], 10) for k in range(40, 60)], "node long, label long, at long, keys array<long>, size long")
    nodes = docs.selectExpr("node", "keys", "size", "struct(struct(at as a, at as b) as row) as least")
    asked, large = near_copies.units(nodes, docs.select("node", "label"), 8)
    assert {(x.label, x.by_key) for x in asked.collect()} == {(0, True), (1, False)} and asked.count() == 60
    assert [tuple(x) for x in large.collect()] == [(1, 3)]
