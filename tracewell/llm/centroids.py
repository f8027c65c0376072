"""Lloyd's centroids, with exponion search for the nearest.

Components are integers, so distances, sums and ties are exact. Vectors lie in blocks of
a few thousand in one table, in buckets of their block; beside it each round writes a
small table of what is known of them: the centroid, an upper bound of the distance to
it and a lower bound of that to any other. Both tables have the same buckets, so a
round moves no vector. Bounds go with what the centroids moved. A vector whose bounds
don't settle its centroid a looks among the centroids in the ball around a of radius
2u + d(a, its nearest other), the first ones of a's list of centroids by distance;
what lies on the ball's surface counts, so that no tie is lost. The nearest two are
always in it. Lists double in length, as the annuli of the method do.

Only the centroids (k times d numbers) and each task's sums of them pass the driver.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, small_batches, unbucketed, written

BLOCK = 4096
#: Components of vectors are less than this, so that no distance leaves 64 bits.
MOST = 2**26
#: Bounds are widened by this share, more than what square roots lose.
SLACK = 1e-9


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def usable(vector: Column, size: int, scale: int) -> Column:
    """Whether a vector has ``size`` components, none null, not finite or beyond ``MOST``."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) * scale >= MOST)
    return F.coalesce((F.size(vector) == size) & ~F.exists(vector, bad), F.lit(False))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all ``x`` to all ``c``."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * top * top < 2**53 else np.int64  # whole numbers are exact up to there
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]).astype(np.int64)


def nearest_two(distances: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the nearest centroid (ties: the smaller number), its distance and the second distance."""
    least = distances.min(1)
    first = np.where(distances == least[:, None], names[None], np.iinfo(np.int64).max).min(1)
    rest = np.where(names[None] == first[:, None], np.iinfo(np.int64).max, distances)
    second = rest.min(1) if distances.shape[1] > 1 else np.full(len(least), np.iinfo(np.int64).max)
    return first, least, second


class Exponion:
    """What a round knows of the centroids, and the search for the nearest."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None) -> None:
        self.c = centroids.astype(np.int64)
        self.k = len(self.c)
        between = np.sqrt(squared(self.c, self.c).astype(np.float64))
        self.lists = np.argsort(between, axis=1, kind="stable")
        for a, row in enumerate(self.lists):  # a itself is first, whatever else lies where it does
            self.lists[a] = [a, *row[row != a]]
        self.far = np.take_along_axis(between, self.lists, 1)
        self.next = self.far[:, 1] if self.k > 1 else np.full(self.k, np.inf)
        if before is None:
            self.moved = None
            return
        d = (self.c - before.astype(np.int64)).astype(np.float64)
        self.moved = np.sqrt((d * d).sum(1)) * (1 + SLACK)
        order = np.argsort(self.moved)
        self.others = np.full(self.k, self.moved[order[-1]])
        self.others[order[-1]] = self.moved[order[-2]] if self.k > 1 else 0.0

    def settle(self, x: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The centroid of each vector, its bounds, and how many distances were computed."""
        if state is None or self.moved is None:
            a, least, second = nearest_two(squared(x, self.c), np.arange(self.k))
            return a, np.sqrt(least) * (1 + SLACK), np.sqrt(second) * (1 - SLACK), x.shape[0] * self.k
        a, u, low = (v.copy() for v in state)
        u = (u + self.moved[a]) * (1 + SLACK)
        low = (low - self.others[a]) * (1 - SLACK)
        safe = np.maximum(low, self.next[a] / 2 * (1 - SLACK))
        open_ = np.flatnonzero(u >= safe)
        d = x[open_].astype(np.int64) - self.c[a[open_]]
        u[open_] = np.sqrt((d * d).sum(1)) * (1 + SLACK)
        scanned = len(open_)
        open_ = open_[u[open_] >= safe[open_]]
        at = a[open_]
        reach = (2 * u[open_] + self.next[at]) * (1 + SLACK)
        for c in np.unique(at):
            mine = open_[at == c]
            upto = np.searchsorted(self.far[c], reach[at == c], side="right")  # on the surface is inside
            upto = np.minimum(1 << np.ceil(np.log2(np.maximum(upto, 1))).astype(np.int64), self.k)
            for n in np.unique(upto):
                some, names = mine[upto == n], self.lists[c, :n]
                first, least, second = nearest_two(squared(x[some], self.c[names]), names)
                a[some], u[some], low[some] = first, np.sqrt(least) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
                scanned += len(some) * int(n)
        return a, u, low, scanned


def _vectors(size: int, ids: pa.DataType):
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(ids)), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(-1, size)
            for i in range(0, len(x), BLOCK):
                own = batch.column(0).slice(i, BLOCK)
                part = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                yield pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), part.cast(schema.field("ids").type), pa.array([x[i : i + BLOCK].tobytes()], pa.binary())], schema=schema)

    return run


def _unpack(state: bytes | None, n: int) -> tuple | None:
    return None if state is None else (np.frombuffer(state, "<i8", n), np.frombuffer(state, "<f8", n, 8 * n), np.frombuffer(state, "<f8", n, 16 * n))


_STATE = "block long, state binary, sums array<long>, counts array<long>, scanned long"


def _round(search: Exponion, size: int):
    """Reads (block, x, state); gives each block's new state, and at a task's end its sums, as rows without a block."""
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
    names = ["block", "state", "sums", "counts", "scanned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, total = np.zeros((search.k, size), np.int64), np.zeros(search.k, np.int64), 0
        for batch in batches:
            for block, body, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(body, "<i4").reshape(-1, size)
                a, u, low, scanned = search.settle(x, _unpack(state, len(x)))
                order = np.argsort(a, kind="stable")
                here, first = np.unique(a[order], return_index=True)
                sums[here] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
                counts += np.bincount(a, minlength=search.k)
                total += scanned
                packed = a.astype("<i8").tobytes() + u.astype("<f8").tobytes() + low.astype("<f8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([block, packed, None, None, None], kinds, strict=True)], names=names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([None, None, sums.ravel().tolist(), counts.tolist(), total], kinds, strict=True)], names=names)

    return run


def _last(search: Exponion, size: int, ids: pa.DataType):
    schema = pa.schema([("vec_id", ids), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (body, state) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                x = np.frombuffer(body, "<i4").reshape(-1, size)
                a = search.settle(x, _unpack(state, len(x)))[0]
                d = x.astype(np.int64) - search.c[a]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), pa.array(a.astype(np.int32)), pa.array((d * d).sum(1))], schema=schema)

    return run


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Components are floor(scale * x). Vectors of another size, null ones and such with a null or infinite
    component, NaN or one of 2^26 and more after scaling are left out. Centroids start as the k vectors with the
    least SHA-256 of ``seed:id`` (ties: the vectors themselves); if there are fewer vectors, there are as many
    centroids. Each of ``rounds`` takes every vector to its nearest centroid (ties: the smaller number) and every
    centroid to the floor of its vectors' mean; one without vectors stays. Repeated ids are vectors of their own,
    an empty table gives no rows, other columns are not read. k times size numbers pass the driver each round.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col), size, scale)).select(F.col(id_col).alias("vec_id"), quantised(F.col(vector_col), scale).alias("x"))
    kind = rows.schema["vec_id"].dataType
    start = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)).orderBy("h", "x").limit(k).collect()
    result = T.StructType([T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not start:
        none = spark.createDataFrame([], result)
        return none.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    centroids, before = np.array([r.x for r in start], np.int64), None
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("x", T.BinaryType())])
    with small_batches(spark, BLOCK):
        blocks = bucketed(rows.mapInArrow(_vectors(size, to_arrow_type(kind)), stored), "vectors", "block", buckets)
    known = None
    at = lambda *c: (spark.table(blocks).select("block", *c).join(spark.table(known).where("block is not null").select("block", "state"), "block") if known else spark.table(blocks).select("block", *c, F.lit(None).cast("binary").alias("state")))
    with small_batches(spark, 16):  # a block is a row
        for _ in range(rounds):
            search = Exponion(centroids, before)
            last, known = known, bucketed(at("x").mapInArrow(_round(search, size), _STATE), "bounds", "block", buckets)
            if last:
                unbucketed(spark, last)
            added = lambda c: spark.table(known).where("block is null").select(F.posexplode(c).alias("place", "v")).groupBy("place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
            counts, sums, before, centroids = {r.place: int(r.v) for r in added("counts")}, added("sums"), centroids, centroids.copy()
            for r in sums:
                if counts[r.place // size]:
                    centroids[r.place // size, r.place % size] = int(r.v) // counts[r.place // size]
        search = Exponion(centroids, before)
        found = written(at("ids", "x").select("ids", "x", "state").mapInArrow(_last(search, size, to_arrow_type(kind)), result), "clusters")
    unbucketed(spark, blocks)
    if known:
        unbucketed(spark, known)
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = spark.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), s) for i, s in enumerate(shas)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024) -> str:
    """The same in DuckDB SQL, round by round, for tables of k vectors or more whose ids don't repeat."""
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, [floor({scale} * e::DOUBLE)::BIGINT FOR e IN embedding] AS x FROM embeddings
           WHERE len(embedding) = {size} AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e::DOUBLE) AND abs(e::DOUBLE) * {scale} < {MOST}]) = {size})""",
        f"v AS MATERIALIZED (SELECT vec_id, unnest(range({size})) AS i, unnest(x) AS x FROM kept)",
        f"s AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, x FROM kept QUALIFY c < {k})",
        f"c0 AS MATERIALIZED (SELECT c, unnest(range({size})) AS i, unnest(x) AS m FROM s)"]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT vec_id, c, sum((x - m) * (x - m))::BIGINT AS d FROM v JOIN c{r} USING (i) GROUP BY vec_id, c)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, min(d * {k} + c) % {k} AS c, min(d) AS d FROM d{r} GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"n{r} AS (SELECT c, i, sum(x)::BIGINT AS t, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY c, i)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN m ELSE (t - ((t % n) + n) % n) // n END AS m FROM c{r} LEFT JOIN n{r} USING (c, i))")
    last = rounds
    steps.append(f"h AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY c)")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM a{last} JOIN h USING (c)"""
