"""Keys cut into stretches give what whole keys give; components in few rounds."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.operators import graph, joins, scans, sequences
from tracewell.session import shared_dir


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out, t = [], 0
    for i in range(3000):
        t += rng.choice([0, 0, 1, 2, 5, 40 if rng.random() < 0.02 else 1])
        out.append((i, "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), t if rng.random() < 0.99 else None, rng.choice("uvwxyz"), rng.choice([None, None, i])))
    return spark.createDataFrame(out, "id long, k string, ts long, what string, v long").repartition(4)


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))


def test_stretches_are_many_and_keep_ties_together(rows):
    known = rows.where("ts is not null")
    found = scans.cuts(known, ["k"], "ts", 500, 16)
    assert [r.k for r in found.collect()] == ["hot"]
    cut = scans.with_stretch(known, ["k"], "ts", found)
    sizes = {r["_stretch"]: r["count"] for r in cut.where("k = 'hot'").groupBy("_stretch").count().collect()}
    assert len(sizes) >= 12 and max(sizes.values()) < 500
    assert cut.groupBy("k", "ts").agg(F.count_distinct("_stretch").alias("n")).where("n > 1").count() == 0
    assert cut.where("k is null or k <> 'hot'").where("_stretch > 0").count() == 0
    assert scans.cuts(known, ["k"], "ts", 10_000) is None


@pytest.mark.parametrize("most", [50, 800])
def test_sequences_in_stretches(rows, most):
    same(sequences.gap_sessions(rows, ["k"], "ts", 5), sequences.gap_sessions(rows, ["k"], "ts", 5, most=most))
    for what in (None, "what"):
        known = rows.where("ts is not null")
        same(sequences.trailing_sizes(known, ["k"], "ts", F.lit(30), what), sequences.trailing_sizes(known, ["k"], "ts", F.lit(30), what, most))
    same(sequences.record_holes(rows, ["k"], "ts"), sequences.record_holes(rows, ["k"], "ts", most))
    once = rows.withColumn("n", F.col("id")).withColumn("t", F.col("ts") * F.when(F.col("id") % 7 == 0, -1).otherwise(1))
    same(sequences.backward_steps(once, ["k"], "n", "t", 10), sequences.backward_steps(once, ["k"], "n", "t", 10, most))
    same(sequences.filled_forward(rows, ["k"], ["ts", "id"], "v", "f"), sequences.filled_forward(rows, ["k"], ["ts", "id"], "v", "f", most))


@pytest.mark.parametrize(("window", "n"), [(4, 6), (30, 25), (10_000, 1500)])
def test_bursts_in_stretches(rows, window, n):
    for distinct in (None, F.col("what")):
        least = n if distinct is None else 4
        whole = sequences.bursts(rows, ["k"], "ts", window, ">=", least, distinct, ["what"], refs=20)
        cut = sequences.bursts(rows, ["k"], "ts", window, ">=", least, distinct, ["what"], refs=20, most=100)
        assert whole.count() > 0
        same(whole, cut)


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_in_stretches(rows, direction):
    right = rows.where("id % 50 = 0").select("k", F.col("ts").alias("at"), F.col("id").alias("rid"))
    for within in (None, 20):
        same(joins.asof(rows, right, ["k"], "ts", "at", ["rid"], direction, within), joins.asof(rows, right, ["k"], "ts", "at", ["rid"], direction, within, most=100))
    few = right.limit(1)
    same(joins.asof(rows, few, ["k"], "ts", "at", ["rid"], direction), joins.asof(rows, few, ["k"], "ts", "at", ["rid"], direction, most=100))


def union_find(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def shapes(rng):
    path = list(range(400))
    shuffled = rng.sample(path, 400)
    yield [(i, i + 1) for i in path]
    yield [(shuffled[i], shuffled[i + 1]) for i in range(399)] + [(5, 5), (None, 3), (7, None)]
    yield [(0, i) for i in range(1, 300)]
    yield [(999, i) for i in range(300)] + [(i, i + 1000) for i in range(300)]
    yield [(i, (i + 1) % 301) for i in range(301)]
    yield [(rng.randrange(500), rng.randrange(500)) for _ in range(350)] * 2
    yield [(i, (i - 1) // 2) for i in range(1, 500)]
    yield []


def test_components_of_all_shapes(spark):
    for pairs in shapes(random.Random(8)):
        got = {r.id: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == union_find(pairs)
    names = [("x", "y"), ("y", "z"), ("ü", "ß")]
    assert {r.id: r.root for r in graph.components(spark.createDataFrame(names, "a string, b string")).collect()} == {"x": "x", "y": "x", "z": "x", "ß": "ß", "ü": "ß"}


def test_components_of_a_long_path_take_few_rounds_and_leave_one_table(spark, monkeypatch):
    rounds = defaultdict(int)
    write = graph.written

    def counted(df, name, *by):
        rounds[name] += 1
        return write(df, name, *by)

    monkeypatch.setattr(graph, "written", counted)
    n = 100_000
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    before = len(files.listStatus(folder))
    found = graph.components(edges)
    assert rounds["picks"] <= 14
    assert len(files.listStatus(folder)) - before == 1
    assert found.where("root <> 0").count() == 0 and found.count() == n


def test_trees_of_all_shapes(spark, monkeypatch):
    rng = random.Random(6)
    deep = [(i, i - 1 if i else None) for i in range(3000)]
    forest = [(i, rng.randrange(i) if i and rng.random() < 0.9 else None) for i in range(500)]
    odd = [(1, 99), (2, 1), (3, 3), (4, 5), (5, 6), (6, 4), (7, 4), (None, 1), (8, 2)]
    for rows in (deep, forest, odd, [(1, None)], []):
        up, want = {i: p for i, p in rows if i is not None}, {}
        for i in up:
            seen, at = [i], i
            while up[at] in up and up[at] != at and len(seen) <= len(up):
                at = up[at]
                seen.append(at)
            want[i] = (None, None) if len(seen) > len(up) else (at, len(seen) - 1)
        got = {r.k: (r.root, r.depth) for r in graph.trees(spark.createDataFrame(rows, "k long, p long"), "k", "p").collect()}
        assert got == want


def test_nearest_distances(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(10_000) if i % 9 else None) for i in range(400)]
    for times in ([rng.randrange(3000, 5000) for _ in range(20)] + [9000], [7], []):
        df = joins.nearest_distance(spark.createDataFrame(rows, "id long, ts long"), spark.createDataFrame([(t,) for t in times], "at long"), "ts", "away", 300)
        assert {r.id: r.away for r in df.collect()} == {i: None if t is None or not times else min(abs(t - a) for a in times) for i, t in rows}
