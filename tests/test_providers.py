"""Providers that fail and are slow, the listing of files as a source, tokens by rank merging, and table functions."""

import random
import threading
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from veldspar.functions import tokens
from veldspar.operators import chunking, providers, scratch
from veldspar.operators.retrieval import LexicalIndex
from veldspar.sources.listing import listed, register


def test_waits_grow_up_to_a_limit():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 7:
            raise OSError("busy")
        return ["fine"]

    assert providers.patiently(call, 9, waits.append) == (["fine"], None)
    assert waits == [2.0, 3.0, 4.5, 6.75, 10.0, 10.0]
    assert providers.patiently(lambda: 1 / 0, 2, waits.append) == (None, "ZeroDivisionError: division by zero")


def test_calls_run_side_by_side_and_stay_in_order():
    running, most, lock = [0], [0], threading.Lock()

    def call(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(random.uniform(0.001, 0.02))
        with lock:
            running[0] -= 1
        return i

    assert list(providers.in_order((partial(call, i) for i in range(40)), 4)) == list(range(40))
    assert 1 < most[0] <= 4


def flaky(prompts):
    if any("bad" in p for p in prompts):
        raise RuntimeError("no answer")
    time.sleep(random.uniform(0, 0.01))
    return [p.upper() for p in prompts]


def test_errors_stay_with_their_rows(spark):
    df = spark.createDataFrame([(i, "bad" if i == 13 else f"p{i}") for i in range(40)] + [(40, None)], "i int, p string").repartition(2)
    got = {r.i: (r.answer, r.error) for r in providers.generate(df, F.col("p"), flaky, batch=1, attempts=2, errors="error", wait=lambda _: None).collect()}
    assert got[13] == (None, "RuntimeError: no answer") and all(got[i] == (f"P{i}", None) for i in range(40) if i != 13) and got[40] == ("", None)
    with pytest.raises(Exception, match="no answer"):
        providers.generate(df, F.col("p"), flaky, batch=4, attempts=1).collect()
    few = providers.generate(df.where("i < 3"), F.col("p"), lambda p: p[1:], attempts=1, errors="error").collect()
    assert all(r.answer is None and "answers to" in r.error for r in few)


def test_listing_in_batch_and_stream(spark, tmp_path):
    for name in ("a.csv", "x/b.PDF", "x/deep/c.csv", "y/d.txt", "y/_hidden", ".e.csv", "y/.f"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name * 3)
    rows = lambda df: sorted((r.folder, r.name, r.extension, r.category, r.size) for r in df.collect())
    whole = rows(listed(spark, str(tmp_path)))
    assert whole == [("", "a.csv", "csv", "excel", 15), ("x", "b.PDF", "pdf", "pdf", 21), ("x", "c.csv", "csv", "excel", 36), ("y", "d.txt", "txt", "unknown", 21)]
    assert rows(listed(spark, f"file:{tmp_path}").where("extension = 'csv' and size > 20")) == [whole[2]]
    assert rows(listed(spark, str(tmp_path)).where("folder in ('x', 'none') and category = 'pdf'")) == [whole[1]]
    plan = listed(spark, str(tmp_path)).where("folder = 'x'")
    assert plan.rdd.getNumPartitions() == 1 and listed(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    register(spark)
    out, marks = str(tmp_path / "_out"), str(tmp_path / "_marks")

    def run():
        stream = spark.readStream.format("veldspar_files").option("path", str(tmp_path)).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(once=True).start().awaitTermination()
        return rows(spark.read.parquet(out))

    assert run() == whole
    time.sleep(0.05)
    (tmp_path / "y" / "g.doc").write_text("new")
    assert run() == sorted([*whole, ("y", "g.doc", "doc", "word", 3)])
    assert listed(spark, str(tmp_path / "nowhere")).collect() == []


def test_rank_merging_equals_a_public_tokenizer(spark, sf):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.ranks_of(path), special_tokens={})
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    odd = spark.createDataFrame([("naïve 東京 😀  \n\t x",), ("",), (None,), ("<|endoftext|>",), ("a" * 500,)], "text string")
    both = docs.unionByName(odd)
    for r in both.select("text", tokens.token_count(F.col("text"), path).alias("n"), tokens.cut_to_tokens(F.col("text"), 40, path).alias("cut")).collect():
        assert r.n == (len(public.encode_ordinary(r.text)) if r.text else 0)
        assert (r.cut is None) == (r.text is None)
        if r.text:
            assert r.text.startswith(r.cut) and len(public.encode_ordinary(r.cut)) <= 40 and (r.cut == r.text or r.n > 40)


def test_table_functions(spark):
    chunking.register_functions(spark)
    texts = ["One. Two.\n\n" + "word " * 400, "# A\nx\n## B\ny", None, "", "  "]
    spark.createDataFrame(list(enumerate(texts)), "i int, t string").createOrReplaceTempView("function_texts")
    for strategy, pack in chunking.PACKERS.items():
        got = spark.sql(f"SELECT i, pos, chunk FROM function_texts, LATERAL text_chunks(t, '{strategy}', 100, 20)").orderBy("i", "pos").collect()
        assert [(r.i, r.pos, r.chunk) for r in got] == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(pack(t or "", 100, 20))]
    got = spark.sql("SELECT i, pos, path, chunk FROM function_texts, LATERAL markdown_sections(t) WHERE i = 1").orderBy("pos").collect()
    assert [(list(r.path), r.chunk) for r in got] == [(["A"], "# A\nx"), (["A", "B"], "## B\ny")]


def test_an_index_is_built_once_for_the_same_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "red apple"), (2, "green pear"), (6, "fig leaf")], "doc_id long, text string").write.parquet(path)
    q = spark.createDataFrame([(1, "apple")], "query_id int, text string")
    one = LexicalIndex.held(spark.read.parquet(path))
    assert LexicalIndex.held(spark.read.parquet(path)).path == one.path and [r.id for r in one.search(q).collect()] == [1]
    spark.createDataFrame([(3, "apple pie"), (4, "plum"), (5, "fig")], "doc_id long, text string").write.mode("overwrite").parquet(path)
    other = LexicalIndex.held(spark.read.parquet(path))
    assert other.path != one.path and [r.id for r in other.search(q).collect()] == [3]
    memory = spark.createDataFrame([(1, "apple"), (2, "x y"), (3, "z")], "doc_id long, text string")
    assert LexicalIndex.held(memory).path != LexicalIndex.held(memory).path


def test_a_local_warehouse_is_no_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda k, *d: None if k == "spark.checkpoint.dir" else "file:/tmp/warehouse")})()

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.scratch_root(Session())
    assert scratch.scratch_root(spark)
