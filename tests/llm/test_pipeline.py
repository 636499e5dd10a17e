"""The pipeline's rows against a plain version of all five stages."""

import re
import zlib
from collections import Counter, defaultdict

import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_contracts import LOWER, SPACES
from veldspar.llm import language_id, mixing, quality
from veldspar.llm import pipeline as corpus_pipeline
from veldspar.llm import queries as Q


def plain_quality(text):
    w = SPACES.findall(text)
    lines = [x for x in text.split("\n") if SPACES.search(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    n, m = max(1, len(w)), max(1, len(lines))
    ratio = {
        "n_words": len(w), "repeat_percent": 100 * len(again) / n, "mean_word_length": sum(map(len, w)) / n, "symbol_ratio": len(re.findall(r"[#*$%&|<>]", text)) / n,
        "dup_line_ratio": (len(lines) - len(set(lines))) / m, "ellipsis_line_ratio": sum(bool(re.search(r"(\.\.\.|…)\s*$", x)) for x in lines) / m,
        "bullet_line_ratio": sum(bool(re.search(r"^\s*[-*•]\s", x)) for x in lines) / m, "stop_word_ratio": sum(x.lower() in quality.STOP_WORDS for x in w) / n,
    }
    return all(r.low <= ratio[r.ratio] <= r.high for r in quality.BASE_RULES + quality.RULES)


def shingles(text, n=5):
    w = SPACES.findall((text or "").translate(LOWER))
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_near(texts):
    """Component of each text: links between all pairs of texts whose five-word shingles have a similarity of 0.8 or more."""
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {k: root(k) for k in ids}


def plain_uniform(row):
    h = xxhash.xxh64_intdigest(mixing.SEED.to_bytes(4, "little"), 42)
    for v in row:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode(), h)
    return ((h & ((1 << 52) - 1)) + 0.5) / (1 << 52)


def plain_mix(docs):
    """Copies of each document: targets by repeated capping, certain copies, then Pareto's order to the cut. The
    draws are of whole rows, as their columns stand in the table."""
    size = {d.doc_id: len(SPACES.findall(d.text)) for d in docs}
    total = Counter()
    for d in docs:
        total[d.source] += size[d.doc_id]
    names = sorted(total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free, left, target = set(names), float(sum(total.values())), {}
    while free:
        level = left / sum(weight[s] for s in free)
        capped = {s for s in free if weight[s] * level > 3 * total[s]}
        if not capped:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * total[s] for s in capped}
        left -= sum(3.0 * total[s] for s in capped)
        free -= capped
    out = {}
    for s in names:
        own = [d for d in docs if d.source == s]
        whole = int(target[s] // total[s])
        missing = target[s] - whole * total[s]
        ranked = sorted((d for d in own if size[d.doc_id]), key=lambda d: -size[d.doc_id])
        words = 0
        # The largest are taken for certain until the rest's inclusion probabilities are below one.
        while missing > 0 and ranked and (missing - words) / sum(size[d.doc_id] ** 2 for d in ranked) * size[ranked[0].doc_id] >= 1:
            most = size[ranked[0].doc_id]
            words += sum(size[d.doc_id] for d in ranked if size[d.doc_id] == most)
            ranked = [d for d in ranked if size[d.doc_id] < most]
        level = (missing - words) / max(1, sum(size[d.doc_id] ** 2 for d in ranked))
        for d in own:
            out[d.doc_id] = whole + (missing > 0 and size[d.doc_id] > 0 and d not in ranked)
        order = []
        for d in ranked if missing > 0 else ():
            p, u = level * size[d.doc_id], plain_uniform(d)
            order.append((u / (1 - u) * (1 - p) / p, d.doc_id))
        for _, k in sorted(order):
            if words + size[k] / 2 > missing:
                break
            out[k] += 1
            words += size[k]
    return out


def test_run_equals_a_plain_version(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = table.collect()
    model = language_id.fit(table.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0)) != 1))
    assert sum(zlib.crc32(str(d.doc_id).encode()) % 3 != 1 for d in docs) > 50
    rejected = [bool(model.predict([d.text])[2][0]) for d in docs]
    docs = [d for d, no in zip(docs, rejected, strict=True) if not no]
    docs = [d for d in docs if plain_quality(d.text)]
    parts = plain_near({d.doc_id: d.text for d in docs})
    docs = [d for d in docs if parts[d.doc_id] == d.doc_id]
    copies = plain_mix(docs)
    p = sentencepiece.SentencePieceProcessor(model_file=Q.piece_model())
    want = sorted((d.doc_id, d.source, d.text, p.encode(d.text)) for d in docs for _ in range(copies[d.doc_id]))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.source, r.decoded, list(r.ids)) for r in got) == want
    assert all(r.begins[0] == 0 and r.ends[-1] == len(r.text.encode()) for r in got)


def test_texts_go_to_python_once(spark):
    from veldspar.llm import pieces

    docs = spark.createDataFrame([(1, "ein Text"), (2, None)], "doc_id long, text string")
    found = pieces.encode(corpus_pipeline._beside_text(docs), Q.piece_model(), keep=["__docs", "text"])
    assert "__text" not in found._jdf.queryExecution().executedPlan().toString()
    other = pieces.encode(docs, Q.piece_model(), keep=["doc_id"])
    assert [(r.text, r.ids, r.decoded) for r in found.collect()] == [(t, r.ids, r.decoded) for t, r in zip(("ein Text", None), other.collect(), strict=True)]
