"""Nulls, empty and very long texts, ties and repeated rows, empty tables, and clashing extra columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.test_contracts import plain_components
from tests.llm.test_pipeline import plain_near
from veldspar.llm import _shared, language_id, license_scan, mixing, near_copies, pieces, quality, simhash, token_counts, topk, warc
from veldspar.llm import pipeline as corpus_pipeline
from veldspar.llm import queries as Q
from veldspar.llm._shared import materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
VECTORS = "vec_id long, embedding array<float>, label int"


def texts():
    r = random.Random(3)
    words = "the and of house river stone light bread water green yellow morning evening walk".split()
    german = "der die das und nicht haus fluss stein licht brot wasser morgen abend gehen".split()
    make = lambda w, n: " ".join(r.choice(w) for _ in range(n))
    return make, words, german


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    make, words, german = texts()
    rows = []
    for i in range(40):
        t = make(words if i % 2 else german, 60)
        rows.append((i, t, "en" if i % 2 else "de", f"s{i % 4}", len(t)))
    rows += [
        (None, None, None, None, None), (None, "", "en", "s1", 0), (50, None, "en", None, 3), (51, "", None, "s1", 0), (52, " \t\n ", "de", "s1", 4), (53, "123 !!! 456", "en", "", 11),
        (54, make(words, 60_000), "en", "s2", 0), (55, "x" * 300_000, "en", "s2", 0), (56, "日本語のテキスト 😀 Iıİ", "ja", "s3", 0), (None, make(words, 60), "en", "s0", 1), (None, make(german, 60), "de", "s0", 1),
    ]
    rows += [rows[3], rows[3], (60, rows[3][1], "en", "s0", 1), (61, rows[3][1] + " once", "en", "s0", 1)]
    where = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{where}/documents.parquet")
    html = "<p>" + "long enough " * 200 + "</p>"
    pages = [(1, "http://a/ü b", html), (2, None, html), (3, "http://c", html), (None, "http://d", html), (4, "http://e", None), (5, "http://f", ""), (6, "bad\r\nurl", "short"), (7, "x", "short"), (3, "http://c", html), (8, "y", "<b>é" * 50_000)]
    spark.createDataFrame(pages, PAGES).write.parquet(f"{where}/pages.parquet")
    nan = float("nan")
    vectors = [(0, [1.0, 2.0], 0), (50, [1.0, 2.0], 0), (100, None, 0), (150, [nan, 1.0], 0), (200, [float("inf"), 1.0], 0), (250, [None, 1.0], 0), (None, [1.0, 1.0], 0), (3, [1.0, 2.0], 0), (3, [1.0, 2.0], 0), (4, [], 0), (300, [-1.0], None), (5, [0.5, 0.5, 9.0], 0)]
    spark.createDataFrame(vectors, VECTORS).write.parquet(f"{where}/embeddings.parquet")
    return where


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", DOCS), ("pages", PAGES), ("embeddings", VECTORS)):
        spark.createDataFrame([], schema).write.parquet(f"{where}/{name}.parquet")
    return where


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty_tables(spark, empty, name):
    assert Q.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in sorted(Q.queries()) if n not in ("op3_warc", "op10_topk", "pipeline")])
def test_odd_documents_give_a_row_each(spark, odd, name):
    assert Q.queries()[name](spark, odd).count() == spark.read.parquet(f"{odd}/documents.parquet").count()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_odd_documents(spark, odd):
    lang = by_id(Q.op1_language_id(spark, odd))
    assert [lang[k].lang_pred for k in (50, 51, 52, 53)] == ["und"] * 4 and lang[54].lang_pred == "en" and lang[50].score == 0 and lang[50].rejected
    mix = by_id(Q.op2_mix_sources(spark, odd))
    assert mix[50]["size"] == 0 and mix[50].taken == 0 and mix[54]["size"] == 60_000
    scan = by_id(Q.op4_license_scan(spark, odd))
    assert (scan[50].n_words, scan[50].first_word, scan[50].labels, scan[50].score) == (0, None, "", 0.0)
    near = by_id(Q.op5_simhash(spark, odd))
    assert near[50].fingerprint == "0" * 16 and near[52].component_id == near[50].component_id
    assert near[60].component_id == 3 == near[3].component_id
    kept = by_id(Q.op9_quality(spark, odd))
    assert kept[50].n_words == 0 and kept[50].base_failed and not kept[50].kept
    assert by_id(Q.op6_pieces(spark, odd))[55].covered_bytes == 300_000
    assert by_id(Q.op8_katz(spark, odd))[50].n_tokens == 1


def test_odd_pages(spark, odd):
    got = sorted((tuple(r) for r in Q.op3_warc(spark, odd).collect()), key=str)
    assert len(got) == 10
    held = {r[0]: (r[3], r[4]) for r in got}
    assert held[1] == held[2] == held[None] == ("revisit", 3) and held[3] == ("response", None)
    assert all(held[k] == ("response", None) for k in (4, 5, 6, 7, 8)) and sum(r[0] == 3 for r in got) == 2


def test_odd_vectors(spark, odd):
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in Q.op10_topk(spark, odd).orderBy("query_id", "rank").collect()]
    best = [(3, 327680), (3, 327680)]
    assert got[:5] == [(0, i + 1, k, s) for i, (k, s) in enumerate([*best, (50, 327680), (5, 98304), (4, 0)])]
    assert [g[0] for g in got] == [0] * 5 + [50] * 5 + [300] * 5


def test_scores_that_do_not_fit(spark):
    top = lambda rows: [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()]
    for rows in ([(0, [4e9, 0.0]), (1, [4e9, 0.0])], [(0, [1.0, 1.0]), (1, [1e300, 1.0])], [(0, [1e8, 1e8]), (1, [-1e8, -1e8])]):
        with pytest.raises(Exception, match="not fit in 64 bits"):
            top(rows)
    # Parts that are too large each, but not together, and the largest scores that fit.
    assert top([(0, [2e7, 2e7, 1.0]), (1, [2e7, -2e7, 1.0]), (2, [0.0, 0.0, 3.0])]) == [(0, 1, 2, 3 * 65536), (0, 2, 1, 65536)]
    assert top([(0, [float(1 << 20)]), (1, [float((1 << 26) - 1)])]) == [(0, 1, 1, (1 << 28) * ((1 << 34) - 256))]


def test_extra_columns_with_clashing_names(spark, odd):
    base = spark.read.parquet(f"{odd}/documents.parquet").withColumns({"extra": F.lit(7), "SCORE": F.lit("s"), "N_Words": F.lit("w"), "target": F.lit(1), "fp": F.lit("f"), "Kept": F.lit("k"), "ids": F.lit("i")})
    model = language_id.fit(base)
    for made in (
        language_id.identify(base, model), mixing.mix(base), license_scan.scan(base), simhash.components(base), pieces.encode(base, Q.piece_model()), token_counts.count_tokens(base), quality.judge(base),
    ):
        names = [c.lower() for c in made.columns]
        assert len(names) == len(set(names)) and "extra" in names
        assert made.where("extra = 7").count() == base.count()
    extra = spark.read.parquet(f"{odd}/embeddings.parquet").withColumns({"id": F.lit("x"), "score": F.lit("y"), "v": F.lit(1)})
    assert topk.top_k(extra, F.col("vec_id") == 0).count() == 5
    paged = spark.read.parquet(f"{odd}/pages.parquet").withColumns({"id": F.lit("x"), "payload": F.lit("y"), "digest": F.lit("z"), "first": F.lit(1)})
    assert warc.plan_records(paged).count() == 10


CLASHING = {"copy": "a", "copies": "b", "n_words": "c", "kept": "d", "size": "e", "target": "f", "taken": "g", "lang_pred": "h", "lang_rejected": "i", "component": "j", "fp": "k", "__text": "l", "a": "m", "row": "n", "first": "o"}


def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").withColumns({n: F.lit(v) for n, v in CLASHING.items()})
    columns, before = docs.columns, {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        made = materialise(stage(spark, docs, odd), f"stage-{name}")
        if name != "piece_encoding":
            assert made.columns == columns and {tuple(r) for r in made.collect()} <= before
        if name == "simhash_dedup":
            parts = plain_near({i: r.text for i, r in enumerate(docs.select("text").collect())})
            assert made.count() == len(set(parts.values()))
        docs = made
    assert docs.count() > 0


def test_stages_of_empty_tables(spark, empty):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, empty).count() == 0


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_dedup_keeps_the_least_row_of_each_group(spark, sf, monkeypatch, broadcast):
    monkeypatch.setattr(near_copies, "BROADCAST", broadcast)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    groups = near_copies.components
    want = sorted(r[0] for r in groups(docs).select("component_id").distinct().collect())
    made = corpus_pipeline.keep_one_of_each_group(spark, docs, sf)
    assert sorted(r.doc_id for r in made.collect()) == want and made.columns == docs.columns
    # Rows of one id with different texts, rows repeated whole, and null ids.
    tail = F.concat("text", F.lit(" and a tail of other words that belongs to no other text at all" * 9))
    odd = docs.unionByName(docs.where("doc_id < 9").withColumn("text", tail)).unionByName(docs.where("doc_id < 30"))
    odd = odd.unionByName(docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.where("doc_id = 5").withColumns({"doc_id": F.lit(None).cast("long"), "text": F.reverse("text")}))
    made = corpus_pipeline.keep_one_of_each_group(spark, odd, sf)
    assert made.count() == groups(odd).select("component").distinct().count() > len(want)
    assert made.where("doc_id is null").count() == 1
    assert {r.doc_id for r in made.collect()} >= set(want)


@pytest.mark.parametrize("hot", [3, 10**9])
def test_hot_fingerprints_components_and_labels(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    monkeypatch.setattr(_shared, "HOT_ROWS", hot)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, base) for i in range(20)] + [(100 + i, base + f" x{i}") for i in range(60)] + [(200 + i, f"a{i} b{i} c{i} d{i}") for i in range(20)] + [(None, base), (None, None), (300, "")]
    got = simhash.components(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).collect()
    assert Counter(r.component_id for r in got) == Counter({0: 81, 300: 2} | {200 + i: 1 for i in range(20)})


@pytest.mark.parametrize("agree", [2, 3, 4])
def test_links_are_the_same_for_any_choice_of_bands(spark, agree):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(200)]
    fps += [f ^ sum(1 << b for b in r.sample(range(64), k)) for f in fps for k in (1, 4, 7, 8)]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in dict.fromkeys(fps)]
    for radius in (4, 7):
        labels = {x.node: x.label for x in simhash.connected(simhash.links(spark.createDataFrame(signed, "fp long"), radius, agree=agree)).collect()}
        plain = plain_components({f: f % (1 << 64) for (f,) in signed}, radius)
        assert {f: labels.get(f, f) for (f,) in signed} == plain


def test_compare_blocks_against_plain_distances():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base] + [base ^ np.uint64(int(sum(1 << int(b) for b in r.choice(64, k, replace=False)))) for k in (1, 2, 4, 5, 6)] + [r.integers(0, 1 << 63, 500, dtype=np.uint64)])
    for radius in (0, 3, 4, 7):
        masks = simhash.close_masks(fps, radius)
        got = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, : len(fps)].astype(bool)
        want = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        assert (got == want).all()


@pytest.mark.parametrize("block", [8, 1024])
def test_components_of_chains_and_hot_groups(spark, block):
    r = random.Random(7)
    chain, x = [], r.getrandbits(64)
    for _ in range(60):
        chain.append(x)
        for b in r.sample(range(64), 4):
            x ^= 1 << b
    hot = [chain[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    fps = list(dict.fromkeys([*chain, *hot, *(r.getrandbits(64) for _ in range(300))]))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    labels = {row.node % (1 << 64): row.label for row in simhash.connected(simhash.links(spark.createDataFrame(signed, "fp long"), block=block)).collect()}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    want: dict[int, set] = {}
    for i, f in enumerate(fps):
        want.setdefault(root(i), set()).add(f)
    got: dict[int, set] = {}
    for f in fps:
        got.setdefault(labels.get(f, f), set()).add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_warc_ranges_own_each_record_once(spark, odd, tmp_path):
    where = f"file://{tmp_path}/w"
    pages = spark.read.parquet(f"{odd}/pages.parquet").repartition(2)
    warc.write_archives(warc.plan_records(pages), where)
    whole = sorted(map(str, warc.read_archives(spark, where, 1 << 30).collect()))
    for size in (17, 100, 1000):
        assert sorted(map(str, warc.read_archives(spark, where, size).collect())) == whole
    texts = {r.id: bytes(r.payload) for r in warc.read_archives(spark, where).where("id = 8").collect()}
    assert texts[8] == ("<b>é" * 50_000).encode()


def test_warc_long_headers_and_archives_within_payloads(spark, tmp_path):
    inside = np.random.default_rng(1).bytes(2000)
    inner = warc._record(70, None, inside, hashlib.sha1(inside).hexdigest(), len(inside), None)
    r = np.random.default_rng(2)
    # Bytes that deflate stores as they are, so that the inner records stand in the archive as such.
    nested = r.bytes(100_000) + inner + r.bytes(100_000) + inner[: len(inner) // 3] + r.bytes(50_000)
    rows = [(1, "http://a", b"one"), (2, "http://b/" + "x" * 2_000_000, b"two"), (3, "http://c", nested), (4, "http://d", b"four" * 400), (5, "http://e", nested[::-1])]
    where = f"file://{tmp_path}/w"
    warc.write_archives(warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html binary").coalesce(1)), where)
    stored = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    assert stored.count(inner) == 1
    want = sorted((k, u, h) for k, u, h in rows)
    for size in (4001, 1 << 20):
        got = warc.read_archives(spark, where, size)
        assert sorted((x.id, x.url, bytes(x.payload)) for x in got.collect()) == want
    assert warc.read_archives(spark, where, 4001, payloads=False).count() == 5


def test_warc_long_members_in_linear_time(tmp_path):
    import time

    def seconds(n):
        body = np.random.default_rng(n).integers(0, 64, n, dtype=np.uint8).tobytes()
        path = tmp_path / str(n)
        path.write_bytes(warc._record(1, "http://a", body, hashlib.sha1(body).hexdigest(), n, None))
        began = time.process_time()
        [(_, end, head, block)] = warc.read_range(str(path), 0, 1, keep=False)
        assert end == path.stat().st_size and block.size == n and block.sha.digest() == hashlib.sha1(body).digest()
        return time.process_time() - began

    short = seconds(16 << 20)  # a quadratic reader takes 16 times as long
    assert seconds(64 << 20) < 10 * max(short, 0.05)


def test_warc_damage_fails_the_read(spark, tmp_path):
    body = b"some text " * 50
    members = [warc._record(k, None, body, hashlib.sha1(body).hexdigest(), len(body), None) for k in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(members[0] + members[1][:-20])
    with pytest.raises(ValueError, match="cut-off|damaged"):
        warc.read_archives(spark, f"file://{tmp_path}").count()


def test_warc_hot_digests_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 5)
    rows = [(k, f"http://{k}", "long text " * 200 if k % 3 else f"other {k // 6} " * 200) for k in range(60)] + [(None, None, None), (None, "x", "")]
    got = {r.id: r.refers_to for r in warc.plan_records(spark.createDataFrame(rows, PAGES)).collect()}
    for k in range(60):
        last = 59 if k % 3 else k // 6 * 6 + 3
        assert got[k] == (None if k == last else last)


def test_postings_of_sparse_and_full_vectors(monkeypatch):
    r = np.random.default_rng(4)
    m = r.integers(-9, 9, (300, 12)) * (r.random((300, 12)) < np.linspace(0.01, 1, 12))
    queries = r.integers(-9, 9, (40, 14)) * (r.random((40, 14)) < 0.5)
    monkeypatch.setattr(topk, "SLICE", 128)
    for scale in (1, 1 << 20):
        lists = topk.postings(m * scale)
        assert [sum(len(part[d][0]) for part in lists) for d in range(12)] == np.count_nonzero(m, axis=0).tolist()
        for at in range(0, 40, 16):
            assert (topk.accumulate(300, lists, queries[at : at + 16] * scale) == (queries[at : at + 16, :12] * scale) @ (m * scale).T).all()


def test_long_vectors_of_few_weights(spark):
    rows = [(k, [0.0] * (997 * (k % 5)) + [float(k % 7), 1.0]) for k in range(60)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 3).collect()
    width = max(len(v) for _, v in rows)
    m = np.zeros((60, width), np.int64)
    for k, v in rows:
        m[k, : len(v)] = np.floor(256 * np.array(v))
    for q in (0, 20, 40):
        best = sorted((-int(m[q] @ m[k]), k) for k in range(60) if k != q)[:3]
        assert [(-s, k) for s, k in best] == [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]


def test_license_regions():
    s = license_scan.Scanner((license_scan.Template("x", "grant <<opt>> of <<opt>> full <</opt>> use <</opt>> by <<var 2>> here"),))
    for text, ok in [("grant by here", 1), ("Grant, of use by me here", 1), ("grant of full use by a b here", 1), ("grant of full by here", 0), ("grant by a b c here", 0), ("grants by here", 0)]:
        assert bool(s.scan(text)["labels"]) == bool(ok), text
    with pytest.raises(ValueError):
        license_scan.Automaton(license_scan.Template("x", "<<var 2>> open"))


def test_whole_licenses_need_all_their_wording():
    scanner = license_scan.Scanner()
    for label in ("mit", "bsd", "isc", "apache", "gpl"):
        markup = max((t.markup for t in license_scan.TEMPLATES if t.label == label), key=len)
        named = re.sub(r"<<var \d+>>", "Holder,", markup)
        text = re.sub(r"<</?opt>>", " ", named)
        words = text.split()
        assert label in scanner.scan("Copyright 2020\n" + text.upper().replace("AS IS", '"AS IS"') + ". More")["labels"]
        assert label == "bsd" or label in scanner.scan(re.sub(r"<<opt>>.*?<</opt>>", " ", named))["labels"]
        changed = " ".join([*words[:-9], "changed", *words[-9:]])
        # A statement of the license is enough for the last two.
        assert (label in scanner.scan(changed)["labels"]) == (label in ("apache", "gpl")) and label + "-opening" in scanner.scan(changed)["labels"]


def test_longest_match_with_byte_fallback():
    a = token_counts.LongestMatch(["ab", "abc", "abcd", "cde", "d", "xyz", "e"])
    assert [a.count(w) for w in ("abcde", "abcdf", "xyq", "", "é", "cd", "abab")] == [2, 2, 3, 0, 2, 2, 2]


def test_normaliser_keeps_alignment():
    plain = pieces.Normaliser(bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))
    text, starts = plain("a é".encode())
    assert text.decode() == "▁a▁é" and starts.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 3, 4]
    squeezed = pieces.Normaliser(b"")
    text, starts = squeezed(b"  a   b ")
    assert text.decode() == "▁a▁b" and starts.tolist()[-1] == 7 and starts.tolist()[3] == 2


def character_map(rules):
    """A compiled map of prefixes and replacements, its double array placed unit by unit."""
    texts, tree = b"", {}
    for key, new in sorted(rules.items()):
        node = tree
        for b in key:
            node = node.setdefault(b, {})
        node[None] = len(texts)
        texts += new + b"\0"
    units, taken, offsets, todo = {}, {0}, set(), [(0, tree, 0)]
    while todo:
        at, node, label = todo.pop(0)
        base = 1
        # No two nodes have one offset, or a label would not tell whose child a unit is.
        while (at ^ base) in offsets or any((at ^ base ^ (0 if b is None else b)) in taken for b in node):
            base += 1
        offsets.add(at ^ base)
        units[at] = base << 10 | (256 if None in node else 0) | label
        for b, child in node.items():
            place = at ^ base ^ (0 if b is None else b)
            taken.add(place)
            if b is None:
                units[place] = 0x80000000 | child
            else:
                todo.append((place, child, b))
    blob = b"".join(units.get(i, 0).to_bytes(4, "little") for i in range(max(units) + 1))
    return len(blob).to_bytes(4, "little") + blob + texts


def plain_normalised(rules, data, prefix, squeeze, escape):
    """Character by character: the longest rule, or the character itself."""
    mark = "▁".encode() if escape else b" "
    out, starts, at, blank = b"", [], 0, True
    while at < len(data):
        keys = [k for k in rules if data.startswith(k, at)]
        n = len(max(keys, key=len)) if keys else 1 if data[at] < 128 else 2 if data[at] >> 5 == 6 else 3 if data[at] >> 4 == 14 else 4
        new = rules[max(keys, key=len)] if keys else data[at : at + n]
        places = [at] * len(new) if keys else list(range(at, at + n))
        if squeeze and blank:
            cut = len(new) - len(new.lstrip(b" "))
            new, places = new[cut:], places[cut:]
        if new:
            blank = new.endswith(b" ")
            out, starts = out + new, starts + places
        at += n
    end = len(data)
    while squeeze and out.endswith(b" "):
        out, end = out[:-1], starts.pop()
    if prefix and out:
        out, starts = b" " + out, [starts[0], *starts]
    places = [p for b, p in zip(out, starts, strict=True) for _ in range(len(mark) if b == 32 else 1)]
    return out.replace(b" ", mark), [*places, end]


@pytest.mark.parametrize("switches", [(1, 1, 1), (1, 0, 1), (0, 1, 1), (0, 0, 0), (1, 1, 0), (1, 0, 0)])
def test_normaliser_takes_the_longest_prefix(switches):
    r = random.Random(6)
    rules = {"ﬁ".encode(): b"fi", "①".encode(): b"1", b"ab": b"X", b"abc": "ÿy".encode(), b"\t": b" ", "\u3000".encode(): b" ", "½".encode(): b" 1/2 ", b"q": b"", b"zz": b"  z", "é".encode(): "e\u0301".encode()}
    for known in (rules, {}):
        compiled = character_map(known) if known else b""
        spec = (bytes([2 << 3 | 2]) + _varint(len(compiled)) + compiled if known else b"") + bytes([3 << 3, switches[0], 4 << 3, switches[1], 5 << 3, switches[2]])
        normalise = pieces.Normaliser(spec)
        for _ in range(300):
            data = "".join(r.choice(["a", "b", "c", "ab", "abc", "z", "zz", " ", "  ", "\t", "q", "ﬁ", "①", "½", "é", "日", "😀", "\u3000"]) for _ in range(r.randint(0, 12))).encode()
            text, starts = normalise(data)
            want, places = plain_normalised(known, data, *switches)
            assert (text, starts.tolist()) == (want, places), data


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_quality_stage_drops_texts_full_of_symbols(spark):
    clean = "we went to the market in the town and bought bread for all of the people who were at home with us"
    words = clean.split()
    rows = [(1, clean), (2, " | ".join(words)), (3, " ".join(w + " |" if i % 3 == 0 else w for i, w in enumerate(words))), (4, clean + " for 5 % less")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_good_quality(spark, docs, "").collect()) == [1, 4]


def test_quality_rules_compile(spark):
    rules = (quality.Rule("n_words", low=3), quality.Rule("mean_word_length", 2, 5))
    got = quality.judge(spark.createDataFrame([(1, "aa bb " * 12), (2, "a"), (3, "abcdefg " * 30)], "doc_id int, text string"), rules=rules)
    assert T.StructField("kept", T.BooleanType(), True).name in got.columns
    assert {r.doc_id: r.kept for r in got.collect()}[2] is False
