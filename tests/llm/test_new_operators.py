"""Centroids, substrings and periodic runs against brute force, on small rows with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import centroids, periodic_runs, recompression

from .test_operators import SCHEMA, messy, prose

VECTORS = "vec_id long, embedding array<float>, x int, cluster string, block long, state string"


def vectors(rng, n, size):
    rows = [(i * 7, [rng.choice([rng.uniform(-1, 1), rng.choice([0.0, 0.5])]) for _ in range(size)]) for i in range(n)]
    rows += [(7, rows[3][1]), (1, rows[3][1]), (2, None), (3, []), (4, [0.1] * (size - 1)), (5, [float("nan")] * size), (6, [None] + [0.1] * (size - 1)), (8, [float("inf")] * size), (9, [1e30] * size), (None, rows[0][1])]
    return [(i, v, 1, "c", None, "s") for i, v in rows]


def plain_clusters(rows, k, rounds, seed, size, scale):
    kept = []
    for i, v in ((r[0], r[1]) for r in rows):
        v = None if v is None or any(x is None for x in v) else [float(np.float32(x)) for x in v]
        if v is not None and len(v) == size and all(np.isfinite(v)) and all(abs(x) * scale < 2**26 for x in v):
            kept.append((i, [int(np.floor(x * scale)) for x in v]))
    start = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)[:k]
    at = [x for _, x in start]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        at = [[sum(col) // len(col) for col in zip(*[x for (_, x), o in zip(kept, own, strict=True) if o == j], strict=True)] if j in own else c for j, c in enumerate(at)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    total = Counter()
    for _, j, d in found:
        total[j] += d
    return sorted((str(i), j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, j, d in found)


@pytest.mark.parametrize(("k", "rounds", "size", "scale"), [(5, 4, 6, 1024), (12, 6, 3, 4), (1, 2, 4, 16), (400, 1, 4, 64), (3, 0, 5, 8)])
def test_clusters(spark, k, rounds, size, scale):
    rows = vectors(random.Random(k), 150, size)
    got = centroids.clusters(spark.createDataFrame(rows, VECTORS).repartition(3), k, rounds, 3, size, scale)
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()) == plain_clusters(rows, k, rounds, 3, size, scale)


def test_exponion_skips_distances_and_keeps_ties():
    rng = np.random.default_rng(5)
    x = (rng.integers(0, 8, (3000, 1)) * 400 + rng.integers(-30, 30, (3000, 6))).astype("<i4")
    c, before, state, scanned = x[:8].astype(np.int64), None, None, 0
    for turn in range(8):
        search = centroids.Exponion(c, before)
        a, u, low, n = search.settle(x, state)
        d = ((x[:, None].astype(np.int64) - c[None]) ** 2).sum(2)
        assert (a == d.argmin(1)).all()  # the first of equals
        scanned, state, before = scanned + n * (turn > 0), (a, u, low), c
        c = np.array([np.floor_divide(x[a == j].astype(np.int64).sum(0), max(1, (a == j).sum())) if (a == j).any() else c[j] for j in range(8)])
    assert scanned < 7 * 3000 * 8 / 4
    tied = centroids.Exponion(np.array([[0, 0], [10, 0], [-10, 0], [10, 0]]), np.array([[0, 0], [10, 0], [-10, 0], [10, 0]]))
    a, *_ = tied.settle(np.array([[5, 0], [-5, 0], [10, 0]], "<i4"), (np.array([1, 2, 3]), np.array([99.0] * 3), np.array([0.0] * 3)))
    assert a.tolist() == [0, 0, 1]


def test_empty_tables(spark):
    assert centroids.clusters(spark.createDataFrame([], VECTORS)).count() == 0
    docs = spark.createDataFrame([], SCHEMA)
    assert recompression.substring_dedup(docs).count() == 0
    assert periodic_runs.periodic_runs(docs).count() == 0


def plain_substrings(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, ws in words:
        if i is not None:
            for a in range(len(ws) - window + 1):
                key = tuple(ws[a : a + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in words:
        gone = set()
        for a in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[a : a + window])] < i:
                gone.update(range(a, a + window))
        out.append((str(i), len(ws), len(gone), b" ".join(w for a, w in enumerate(ws) if a not in gone).decode()))
    return sorted(out)


def repeating(rng):
    """Texts that share stretches of all lengths, few words, long runs, and copies."""
    few = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    long = [prose(rng, 400) for _ in range(3)]
    rows = [(i, t) for i, t in enumerate([*long, *(few(60) for _ in range(6)), "a " * 300, "a " * 140 + "b", "b " + "a " * 15, "a b " * 100, "a b " * 90 + "c", None, "", " \t"])]
    for i in range(40):
        base = rng.choice(long).split(" ")
        a = rng.randrange(380)
        rows.append((rng.randrange(3000) - 1000, " ".join([*prose(rng, rng.randint(0, 30)).split(" "), *base[a : a + rng.randint(5, 200)], *few(rng.randint(0, 40)).split(" ")])))
    rows += [(5000, long[0]), (4000, long[0] + " more"), (-2000, long[1]), (5000, long[1] + " x"), (None, long[2]), (None, long[2]), (17, long[2]), (17, long[2])]
    return rows


@pytest.mark.parametrize(("window", "part_words", "partitions"), [(13, 200, 4), (13, 10**6, 1), (3, 500, 3), (70, 900, 2)])
def test_substrings(spark, window, part_words, partitions):
    rows = repeating(random.Random(window))
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("part"), F.lit("k").alias("kind"), F.lit(2).alias("n_words")).repartition(partitions)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in recompression.substring_dedup(df, window, part_words).collect())
    assert got == plain_substrings(rows, window)


def test_substrings_of_messy_rows(spark):
    docs = spark.createDataFrame(messy(), SCHEMA).repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in recompression.substring_dedup(docs, part_words=2000).collect())
    assert got == plain_substrings([(r[0], r[1]) for r in messy()], 13)


def test_high_symbols_agree_inside_equal_stretches():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 2**63, (600, 2), dtype=np.uint64)
    texts = [np.concatenate([rng.integers(0, 2**63, (n, 2), dtype=np.uint64), shared, rng.integers(0, 2**63, (m, 2), dtype=np.uint64)]) for n, m in ((0, 9), (37, 0), (501, 77))]
    seen = []
    for t in texts:
        s = recompression.recompressed([t[:, 0].copy(), t[:, 1].copy()], np.zeros(len(t), np.int32))
        seen.append({(int(a), int(b)): int(n) for a, b, n in zip(*s.lanes, s.length, strict=True)})
    common = set(seen[0]) & set(seen[1]) & set(seen[2])
    assert sum(seen[0][k] for k in common) > 300  # of the 600 words, all but some at the ends


def plain_runs(words, least=6, periods=4):
    out, n = set(), len(words)
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            e = i
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e + p - i >= max(least, periods * p) and not any(all(words[x] == words[x + q] for x in range(i, e + p - q)) for q in range(1, p)):
                out.add((i, e + p - i, p))
            i = max(e, i + 1)
    return out


def test_runs_of_small_alphabets():
    rng = random.Random(4)
    for _ in range(3000):
        t = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.5:
            t += ([rng.randrange(2) for _ in range(rng.randint(1, 5))] * 9)[: rng.randint(0, 30)]
        for least, periods in ((6, 4), (2, 2), (1, 3)):
            assert periodic_runs.runs(t, least, periods) == plain_runs(t, least, periods)
        assert set(periodic_runs.runs_of_words(t)) == plain_runs(t)


def test_runs_take_few_comparisons():
    fib, last = [0, 1], [0]
    while len(fib) < 20_000:
        fib, last = fib + last, fib
    doubled = [0]
    for c in range(1, 14):
        doubled = [*doubled, c, *doubled]
    for t in (fib, doubled, [0] * 20_000, [0, 1] * 10_000, [0] * 9_000 + [1], [bin(i).count("1") % 2 for i in range(16_384)]):
        for order in (t, [-x for x in t]):
            assert periodic_runs.next_smaller(order)[2] < len(t) * np.log2(len(t)) * 0.6


def test_periodic_runs(spark):
    rng = random.Random(9)
    texts = [(f"{prose(rng, rng.randint(0, 40))} " + f"{prose(rng, rng.randint(1, 5))} " * rng.randint(1, 8) + prose(rng, rng.randint(0, 20))) for _ in range(60)]
    extra = [(1000 + i, t, None, None, None, *[None] * 11) for i, t in enumerate([*texts, "a " * 5000, "a b " * 3, "a a a a a", "x a b a b a b a b y y y y y y"])]
    rows = messy() + extra
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(map(str, r)) for r in periodic_runs.periodic_runs(docs, periodic_runs.planted).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect())
    want = []
    for i, t, *_ in rows:
        ws, n = (t or "").encode().split(), 0
        n = len(ws)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[x] if x < a else ws[a + (x - a) % p] for x in range(n)]
        runs = sorted((s, m, p) for s, m, p in (plain_runs(ws) if n < 3000 else {(0, n, 1)} if len(set(ws)) == 1 else set(periodic_runs.runs(list(map(hash, ws))))))
        runs.sort(key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        gone = {x for s, m, p in runs for x in range(s + p, s + m)}
        digest = lambda x: hashlib.sha256(x).hexdigest()
        want.append(tuple(map(str, (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), digest(b" ".join(w for x, w in enumerate(ws) if x not in gone))))))
    assert got == sorted(want)
