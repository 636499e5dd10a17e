"""Stored structures against plain versions: overlap joins, a vector index, sketches, versions, variants, folders."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.operators import ann, relational, sketches, variants
from veldspar.operators.scratch import scratch_path
from veldspar.sources.changes import ChangeTable
from veldspar.sources.layout import read_by, write_by

# Overlap joins


@pytest.mark.parametrize("rows", [4, 20_000])
@pytest.mark.parametrize("keyed", [False, True])
def test_overlap_join(spark, rows, keyed):
    r = random.Random(3)
    span = lambda: (a := r.choice([r.uniform(-50, 50), 1.0, 10.0]), a + r.choice([0.0, -1.0, 0.5, 10.0, 60.0]))
    left = [(i, r.choice("ab"), *span()) for i in range(80)] + [(80, "a", None, 3.0), (81, None, 0.0, 9.0)]
    right = [(i, r.choice("ab"), *span()) for i in range(70)] + [(70, "b", 1.0, None)]
    a, b = spark.createDataFrame(left, "i int, k string, low double, high double"), spark.createDataFrame(right, "j int, m string, from_ double, upto double")
    got = relational.overlap_join(a, b, "low", "high", "from_", "upto", 10.0, [("k", "m")] if keyed else None, rows)
    assert got.columns == ["i", "k", "low", "high", "j", "m", "from_", "upto"]
    whole = lambda x: None not in x[2:] and x[2] < x[3]
    want = sorted((x[0], y[0]) for x in left for y in right if whole(x) and whole(y) and x[2] < y[3] and y[2] < x[3] and (not keyed or (x[1] == y[1] and x[1])))
    assert sorted((g.i, g.j) for g in got.collect()) == want and len(want) > 300


# Vector index


def clustered(n, seed=1):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(40, 24))
    return centers[r.integers(0, 40, n)] + 0.5 * r.normal(size=(n, 24))


def plain_search(vectors, queries, k):
    unit = lambda v: (m := np.array(v, float)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    score = np.round(unit(queries) @ unit(vectors).T, 6)
    return [sorted(range(len(vectors)), key=lambda i, s=s: (-s[i], i))[:k] for s in score]


def test_vector_index_recall_and_exhaustive_search(spark, monkeypatch):
    data = clustered(3000)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "id long, embedding array<double>")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = ann.VectorIndex.build(v)
    assert index.lists.select("id").distinct().count() == index.lists.count() == 3000 and 1 < len(index.centroids) <= ann.CELLS
    want = dict(zip(range(0, 3000, 50), plain_search(data, data[::50], 10), strict=True))
    got = index.search(q, 10).groupBy("query_id").agg(F.collect_set("id").alias("ids")).collect()
    assert np.mean([len(set(g.ids) & set(want[g.query_id])) / 10 for g in got]) >= 0.9 and len(got) == 60
    monkeypatch.setattr(ann, "VECTORS", 50)
    monkeypatch.setattr(ann, "ASKS", 7)
    full = index.search(q, 10, probes=10**6).orderBy("query_id", "rank").collect()
    assert [g.id for g in full] == [i for k in sorted(want) for i in want[k]]
    assert index.search(q, 10, probes=len(index.centroids) // 4).count() == 600
    judged = ann.recall(index.search(q, 10, probes=1), index.search(q, 10, probes=10**6))
    assert 0 < judged.agg(F.avg("recall")).first()[0] < 1


def test_recall_of_the_given_vectors(spark, sf):
    from veldspar.plans import catalogue

    got = catalogue.queries()["vector_ann"](spark, sf.replace("sf0.001", "sf0.01")).select("query_id", "recall").distinct().collect()
    assert len(got) == 10 and sum(r.recall for r in got) >= 0.9 * len(got)


def test_vector_index_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 0.0]), (9, [2.0, 0.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [3.0, 0.0]), (2, None)], "query_id long, query_vector array<double>")
    found = ann.VectorIndex.build(v, cells=2).search(q, 5, probes=2).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.score) for r in found] == [(1, 1, 1.0), (1, 9, 1.0), (1, 2, 0.0), (1, 8, 0.0)]
    empty = ann.VectorIndex.build(v.where("id > 99"))
    assert empty.search(q, 5).collect() == [] and empty.add(v).search(q, 5).collect() == []
    more = ann.VectorIndex.build(v.where("id < 3")).add(v.where("id > 7"))
    assert more.lists.count() == 4


# Sketches


def test_merged_sketches_equal_whole_ones(spark):
    rows = spark.range(20_000).selectExpr("id % 3 as g", "id % 10 as d", "if(id % 7 = 0, null, id % 6000) as k", "cast(id % 1000 as double) as v")
    daily = sketches.answered(sketches.merged(sketches.sketched(rows, ["g"], F.col("d"), "k", "v"), ["g"]), ["g"]).orderBy("g").collect()
    whole = sketches.answered(sketches.sketched(rows, ["g"], F.lit(0), "k", "v"), ["g"]).orderBy("g").collect()
    exact = {r.g: r for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("k")).collect()}
    for a, b in zip(daily, whole, strict=True):
        assert a.n == b.n == exact[a.g].n and a.distinct_theta == b.distinct_theta == exact[a.g].k
        assert math.isclose(a.distinct_hll, b.distinct_hll, rel_tol=sketches.COUNT_ERROR) and abs(a.distinct_hll - exact[a.g].k) <= sketches.COUNT_ERROR * exact[a.g].k
        assert all(abs(x - 1000 * s) <= 1000 * sketches.RANK_ERROR + 1 for x, s in zip(a.quantiles, (0.1, 0.5, 0.9), strict=True))
    large = spark.range(300_000).selectExpr("0 as g", "id % 5 as d", "id as k", "0.0 as v")
    told = sketches.answered(sketches.merged(sketches.sketched(large, ["g"], F.col("d"), "k", "v"), ["g"]), ["g"]).first()
    assert abs(told.distinct_theta - 300_000) <= 0.03 * 300_000 and abs(told.distinct_hll - 300_000) <= sketches.COUNT_ERROR * 300_000


# Versions


def test_versions_against_a_dict(spark):
    r = random.Random(8)
    schema = spark.createDataFrame([], "id int, name string, n double").schema
    held, state, states = ChangeTable(spark, scratch_path(spark, "t"), "id", schema), {}, {}
    assert held.versions() == [] and held.snapshot().collect() == []
    for _ in range(6):
        if r.random() < 0.7:
            new = {r.choice([None, *range(12)]): (f"x{r.random():.3f}", r.random()) for _ in range(5)}
            version = held.upsert(spark.createDataFrame([(k, *v) for k, v in new.items()], schema))
            state = state | new
        else:
            gone = r.sample(range(14), 4)
            version = held.delete(spark.createDataFrame([(k,) for k in gone], "id int"))
            state = {k: v for k, v in state.items() if k not in gone}
        states[version] = dict(state)
    rows = lambda df: {x.id: (x.name, x.n) for x in df.collect()}
    for version, want in states.items():
        assert rows(held.snapshot(version)) == want
    last = max(states)
    spark.createDataFrame([(99, "torn", 0.0, "upsert")], "id int, name string, n double, __op string").write.parquet(f"{held.path}/version={last + 1}")
    (spark._jvm.java.io.File(f"{held.path.removeprefix('file:')}/version={last + 1}/_SUCCESS")).delete()
    assert held.versions() == sorted(states) and rows(held.snapshot()) == states[last]
    changed = {x.key: (x.before, x.after) for x in held.changes(1).collect()}
    assert set(changed) == {k for k in states[1].keys() | states[last].keys() if states[1].get(k) != states[last].get(k)}
    assert held.compact() == last and rows(held.snapshot()) == states[last] and rows(held.snapshot(2)) == states[2]
    held.vacuum()
    assert rows(held.snapshot()) == states[last] and held.versions() == []
    with pytest.raises(Exception, match="no longer"):
        held.snapshot(last - 1)


def test_one_change_with_rows_of_one_key(spark):
    schema = spark.createDataFrame([], "id int, name string").schema
    held = ChangeTable(spark, scratch_path(spark, "t"), "id", schema)
    held.upsert(spark.createDataFrame([(1, "a"), (1, "b"), (1, None)], schema))
    assert [tuple(x) for x in held.snapshot().collect()] == [(1, "b")]
    held.delete(spark.createDataFrame([(7,), (7,)], "id int"))
    assert held.snapshot().count() == 1 and held.versions() == [1, 2]


# Variants


def test_variants_keep_kinds(spark):
    texts = ['{"k": 1, "s": "x", "n": null}', '{"k": "1"}', '{"k": 2.5, "in": {"a": [1, 2]}}', "not json", None, "[1]", '{"k": 99999999999}']
    x = variants.parsed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t")
    got = {r.i: (r.k, r.a, r.s) for r in variants.typed(x, "variant", {"k": ("$.k", "int"), "a": ("$.in.a[1]", "bigint"), "s": ("$.s", "string")}).collect()}
    assert got[0] == (1, None, "x") and got[2][1] == 2 and got[3] == got[4] == got[5] == (None, None, None) and got[6][0] is None
    shape = variants.shapes(x.where("i in (0, 6)"), "variant", []).first()
    assert (shape.n, shape.bad) == (2, 0) and shape["shape"].startswith("OBJECT<k: BIGINT")
    assert variants.shapes(x, "variant", []).first().bad == 2
    fields = sorted((r.i, r.name, r.kind, r.value) for r in variants.entries(x.where("i in (0, 1)"), "variant", ["i"]).collect())
    assert fields == [(0, "k", "BIGINT", "1"), (0, "n", "VOID", "null"), (0, "s", "STRING", '"x"'), (1, "k", "STRING", '"1"')]


# Folders


def test_only_chosen_folders_are_read(spark):
    path = scratch_path(spark, "by")
    rows = spark.range(5000).selectExpr("id", "if(id < 3000, 0, id % 20) as d", "cast(id as string) as t")
    write_by(rows, path, "day", F.col("d"), ["id"], per_file=500)
    files = spark.read.parquet(path).select("day", F.input_file_name().alias("f")).distinct().groupBy("day").count().collect()
    counts = {r.day: r["count"] for r in files}
    assert len(counts) == 20 and counts[0] >= 5 and all(n == 1 for d, n in counts.items() if d)
    chosen = spark.createDataFrame([(3,), (7,), (777,)], "day int").where("day > 0")
    found = read_by(spark, path, chosen, "day")
    assert found.count() == rows.where("d in (3, 7)").count()
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    found.collect()
    assert _metric(found._jdf.queryExecution().executedPlan(), "numPartitions") == 2


def _metric(plan, name):
    """The largest value of a scan's metric in a plan that ran."""
    found = 0
    todo = [plan]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        metric = p.metrics().get(name)
        if kind == "FileSourceScanExec" and metric.isDefined():
            found = max(found, metric.get().value())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_sketches_of_cells_are_exact_beyond_a_sketch(spark):
    rows = spark.range(120_000).selectExpr("if(id < 60000, 'x', 'y') as g", "id % 4 as d", "if(id % 11 = 0, null, id % 80000) as k").unionAll(spark.sql("select 'z', 0L, 7L"))
    n = sketches.cells_of(rows, "k")
    assert n > 1
    held = sketches.merged_cells(sketches.celled(rows, ["g"], F.col("d"), "k", n), ["g"])
    want = {r.g: (r.n, r.k) for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("k")).collect()}
    assert {r.g: (r.n, r.distinct_theta) for r in sketches.distinct_in_cells(held, ["g"]).collect()} == want
    keys = {g: {r.k for r in rows.where(F.col("g") == g).collect()} - {None} for g in "xyz"}
    pairs = [("x", "y"), ("y", "x"), ("z", "y"), ("x", "z")]
    got = sketches.overlaps_in_cells(held, spark.createDataFrame(pairs, "a string, b string"), "g").collect()
    assert {(r.a, r.b): (r.both, r.either, r.only_a) for r in got} == {(a, b): (len(keys[a] & keys[b]), len(keys[a] | keys[b]), len(keys[a] - keys[b])) for a, b in pairs}


def test_long_intervals_of_keys_with_few_rows_are_not_copied(spark):
    """Each would touch a trillion bins."""
    a = spark.createDataFrame([(1, 7, 0.0, 1e12), (2, 7, 5.0, 6.0), (3, 8, 0.0, 1e12)], "i int, k int, low double, high double")
    b = spark.createDataFrame([(1, 7, 1e11, 1e12), (2, 7, 5.5, 5.6), (3, 9, 0.0, 1e12)], "j int, m int, from_ double, upto double")
    got = relational.overlap_join(a, b, "low", "high", "from_", "upto", 1.0, [("k", "m")])
    assert sorted((r.i, r.j) for r in got.collect()) == [(1, 1), (1, 2), (2, 2)]
