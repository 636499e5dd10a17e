"""Every registered query against a plain Python version of its contract, on whole small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.test_katz import PlainKatz
from veldspar.llm import katz
from veldspar.llm import queries as Q
from veldspar.llm._shared import read

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read(spark, sf, "documents").toPandas()


def rows(df, key):
    return {r[key]: r for r in df.collect()}


def test_language_id(spark, sf, docs):
    got = rows(Q.op1_language_id(spark, sf), "doc_id")
    right = total = 0
    for d in docs.itertuples():
        r = got[d.doc_id]
        assert r.held_out == (crc(d.doc_id, 3) == 1) and 0 <= r.score <= 1
        if r.held_out:
            total += 1
            right += r.lang_pred == d.lang
    assert len(got) == len(docs) and right >= 0.95 * total


def test_mixing(spark, sf, docs):
    got = rows(Q.op2_mix_sources(spark, sf), "doc_id")
    again = rows(Q.op2_mix_sources(spark, sf), "doc_id")
    size = {d.doc_id: len(SPACES.findall(d.text or "")) for d in docs.itertuples()}
    by = Counter()
    for d in docs.itertuples():
        by[d.source] += size[d.doc_id]
    names = sorted(by)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(by.values()))
    while free:
        total = sum(weight[s] for s in free)
        capped = {s for s in free if left * weight[s] / total > 3 * by[s]}
        if not capped:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 3.0 * by[s] for s in capped}
        left -= sum(3 * by[s] for s in capped)
        free -= capped
    taken, longest = Counter(), defaultdict(int)
    for d in docs.itertuples():
        r = got[d.doc_id]
        assert (r["size"], r.source_size) == (size[d.doc_id], by[d.source])
        assert r.target == pytest.approx(target[d.source])
        assert r.taken <= 3 * r["size"] and r.taken == again[d.doc_id].taken
        taken[d.source] += r.taken
        longest[d.source] = max(longest[d.source], r["size"])
    for s in names:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1


def test_warc(spark, sf):
    pages = read(spark, sf, "pages").toPandas()
    got = rows(Q.op3_warc(spark, sf), "page_id")
    body = {p.page_id: (p.html or "").encode() for p in pages.itertuples()}
    last = {b: max(k for k, x in body.items() if x == b) for b in body.values()}
    assert len(got) == len(pages)
    for k, b in body.items():
        first = last[b] if len(b) >= 1000 else k
        assert tuple(got[k]) == (k, len(b), hashlib.sha1(b).hexdigest(), "response" if first == k else "revisit", None if first == k else first)


def test_license_scan(spark, sf, docs):
    got = rows(Q.op4_license_scan(spark, sf), "doc_id")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for d in docs.itertuples():
        w = word.findall((d.text or "").translate(LOWER))
        places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[d.doc_id]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        base = {x for _, x in places}
        assert r.base_labels == ",".join(sorted(base)) and base <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1
    assert any(r.labels for r in got.values())


def plain_fingerprint(text, shingle=4):
    w = SPACES.findall((text or "").translate(LOWER))
    if not w:
        return 0
    sh = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hs) > len(hs) / 2)


def plain_components(fps, radius=4):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_simhash(spark, sf, docs):
    got = rows(Q.op5_simhash(spark, sf), "doc_id")
    fps = {d.doc_id: plain_fingerprint(d.text) for d in docs.itertuples()}
    parts = plain_components(fps)
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{f:016x}", parts[k]) for k, f in fps.items()}
    assert any(k != p for k, p in parts.items())


def test_pieces(spark, sf, docs):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=Q.piece_model())
    got = rows(Q.op6_pieces(spark, sf), "doc_id")
    for d in docs.itertuples():
        ids = p.encode(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(p.decode(ids).encode()).hexdigest()
        assert r.covered_bytes == len((d.text or "").encode())


def test_token_counts(spark, sf, docs):
    from veldspar.llm.token_counts import BEGIN, vocabulary

    vocab = set(vocabulary(Q.piece_model()))
    longest = max(map(len, vocab))

    def greedy(word):
        n = at = 0
        while at < len(word):
            for end in range(min(len(word), at + longest), at, -1):
                if word[at:end] in vocab:
                    n, at = n + 1, end
                    break
            else:
                n, at = n + len(word[at].encode()), at + 1
        return n

    got = rows(Q.op7_token_counts(spark, sf), "doc_id")
    for d in docs.itertuples():
        w = SPACES.findall(d.text or "")
        assert (got[d.doc_id].n_words, got[d.doc_id].n_tokens) == (len(w), sum(greedy(BEGIN + x) for x in w))


def test_katz(spark, sf, docs):
    got = rows(Q.op8_katz(spark, sf), "doc_id")
    plain = PlainKatz({d.doc_id: d.text for d in docs.itertuples() if crc(d.doc_id, 7) != 2}.values(), katz.ORDER)
    for d in docs.itertuples():
        r = got[d.doc_id]
        assert r.held_out == (crc(d.doc_id, 7) == 2)
        assert tuple(r)[2:] == pytest.approx(plain.score(d.text), rel=1e-9)


def test_quality(spark, sf, docs):
    got = rows(Q.op9_quality(spark, sf), "doc_id")
    for d in docs.itertuples():
        text = d.text or ""
        w = SPACES.findall(text)
        windows = defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].append(i)
        again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
        lines = [x for x in text.split("\n") if SPACES.search(x)]
        r = got[d.doc_id]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert tuple(r)[1:6] == want
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert sum(r.kept for r in got.values()) > 0.5 * len(got)


def test_topk(spark, sf):
    table = read(spark, sf, "embeddings").toPandas()
    v = np.floor(256 * np.stack(table.embedding.to_numpy()).astype(float)).astype(np.int64)
    ids = table.vec_id.to_numpy()
    got = defaultdict(list)
    for r in Q.op10_topk(spark, sf).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for n, q in enumerate(ids):
        if q % 50 == 0:
            best = sorted((-int(v[n] @ v[m]), int(ids[m])) for m in range(len(ids)) if ids[m] != q)[:5]
            assert sorted(got[q]) == [(i, k, -s) for i, (s, k) in enumerate(best, 1)]
    assert len(got) == sum(ids % 50 == 0)
