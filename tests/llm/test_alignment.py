"""Token alignment against a plain version, and its encoder against the public library."""

import hashlib
import random
from collections import Counter

import pytest

from veldspar.llm import alignment
from veldspar.llm import queries as Q

TEXTS = [
    "The quick brown fox jumps over the lazy dog, 1234567 times; it's fine.", "  two  spaces\tand\n\nlines ", "naïve café – “quotes” … Straße Łódź 東京都 emoji 😀👩‍👩‍👧 done",
    "<|endoftext|> </s> <s> [INST]", "a", " ", "\n", "x" * 300, "word▁mark", "🤖" * 20, None, "", "don't DON'T can't 42nd 3.14", "The quick brown fox jumps over the lazy dog", "The quick brown fox",
]


def plain(texts):
    """The contract, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(Q.byte_model()), sentencepiece.SentencePieceProcessor(model_file=Q.piece_model())
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    a_bytes = lambda i: bytes(alphabet[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for text in texts:
        whole = b" " + (text or "").encode()
        ids = (a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or ""))
        if not text or any(b"".join(map(of, x)) != whole for of, x in zip((a_bytes, b_bytes), ids, strict=True)):
            found.append(None)
            continue
        spans = []
        for of, x in zip((a_bytes, b_bytes), ids, strict=True):
            at, own = 0, []
            for i in x:
                own.append((at, at + len(of(i)), i))
                at = own[-1][1]
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        begin, groups = 0, []
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in own if begin <= s and e <= cut) for own in spans))
            begin = cut
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if max(s, t) < min(e, f)]
        counts.update(links)
        found.append((*map(len, ids), groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()) for x in found]


@pytest.mark.parametrize("batch", [1, 200, 1 << 22])
def test_against_plain(spark, batch):
    r = random.Random(5)
    texts = TEXTS + [" ".join(r.choice(["alpha", "béta", "gamma-ray", "ünder", "12", "the", "of", "a.b"]) for _ in range(r.randrange(40))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in Q.alignment.align(docs, Q.byte_model(), Q.piece_model(), batch=batch).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)
    assert sum(x[0] == 0 for x in got.values()) >= 3


def test_query(spark, sf):
    docs = Q.read(spark, sf, "documents").toPandas()
    got = {r.doc_id: tuple(r)[1:] for r in Q.op12_alignment(spark, sf).collect()}
    small = docs[docs.text.str.len() < 100_000]
    assert len(small) == len(docs) == len(got)
    assert [got[i] for i in docs.doc_id] == plain(list(docs.text))


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(Q.byte_model())
    a.encode_special_tokens = True
    own = alignment.ByteBpe(Q.byte_model())
    points = [c for c in [*range(1, 0x3400), *range(0xA000, 0xAC00), *range(0xE000, 0x11000)]]
    texts = [f" a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}.{chr(c)}  {chr(c)}\n{chr(c)}" for c in points]
    assert all(own.encode(t).tolist() == e.ids for t, e in zip(texts, a.encode_batch(texts, add_special_tokens=False), strict=True))


def test_components():
    import numpy as np

    r = random.Random(1)
    for _ in range(30):
        n = r.randrange(1, 40)
        links = [(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(40))]
        want = list(range(n))
        for _ in range(n):
            for x, y in links:
                want[x] = want[y] = min(want[x], want[y])
        one, other = (np.array([p[k] for p in links], np.int64) for k in (0, 1))
        assert alignment.components(n, one, other).tolist() == want


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, Q.byte_model(), Q.piece_model()).collect() == []
    odd = spark.createDataFrame([(None, None, 1, "x"), (1, "same", 2, "y"), (1, "same", 2, "y"), (2, "word " * 60_000, 3, None)], "doc_id long, text string, N_A int, block string")
    got = alignment.align(odd, Q.byte_model(), Q.piece_model()).orderBy("n_links").collect()
    assert [c for c in got[0].asDict()] == ["doc_id", "text", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert got[0].n_a == 0 and got[1] == got[2] and got[1].count_sum == 2 and got[3].n_links >= 60_000
    with pytest.raises(ValueError):
        alignment.ByteBpe(Q.byte_model().replace("byte_bpe_50k", "word_bpe_49k"))
