"""Exact dedup by exchange of Golomb-coded fingerprints.

1. Each task fingerprints its rows (48 bits of the SHA-256 of the text with A-Z
   lower-cased), sorts the distinct fingerprints of each owner (the owner is the
   top of the fingerprint's range), and codes the gaps with a Golomb-Rice code.
   Rows and codes go to one table in the shared folder.
2. Only the codes are shuffled. An owner decodes what all parts sent and answers
   each part with a bitmap: which of its fingerprints another part has too. A
   fingerprint comes once from each part, however often it occurs there, so a
   hot text costs its owner one entry a part.
3. Rows whose bit is set, or whose part holds the fingerprint twice, are the
   suspects. A bitmap of bounded size finds them where they lie and only their texts
   are shuffled, grouped by the bytes themselves with map-side combining; a class
   counts if the bytes agree with the fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filtered, give_back, small_batches, whole, written

FP_BITS = 48
PART_ROWS = 100_000
ROWS_AN_OWNER = 250_000


def rice_encode(values: np.ndarray, start: int, width: int) -> bytes:
    """Sorted distinct values in [start, start + width) as count, Rice parameter, unary quotients and remainders."""
    n = len(values)
    if n == 0:
        return b""
    k = max(0, int(width / n).bit_length() - 1)
    gaps = np.diff(values, prepend=np.int64(start))
    quotients, rests = gaps >> k, gaps & ((1 << k) - 1)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    bits = ((rests[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8) if k else np.zeros(0, np.uint8)
    head = np.array([n, k, start, len(unary)], "<i8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(bits).tobytes()


def rice_decode(code: bytes) -> np.ndarray:
    if not code:
        return np.zeros(0, np.int64)
    n, k, start, length = (int(x) for x in np.frombuffer(code, "<i8", 4))
    cut = 32 + (length + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, cut - 32, 32))[:length])
    quotients = np.diff(ends, prepend=-1) - 1
    rests = np.zeros(n, np.int64)
    if k:
        bits = np.unpackbits(np.frombuffer(code, np.uint8, offset=cut))[: n * k].reshape(n, k)
        rests = bits.astype(np.int64) @ (np.int64(1) << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum((quotients.astype(np.int64) << k) + rests) + start


def owner_starts(owners: int) -> np.ndarray:
    return np.array([(i << FP_BITS) // owners for i in range(owners + 1)], np.int64)


def _fingerprint(owners: int, id_type: pa.DataType):
    starts = owner_starts(owners)

    def part(ids: list, hashes: list, shas: list, fps: list, name: int) -> Iterator[pa.RecordBatch]:
        fp = np.array(fps, np.int64)
        distinct, place, times = np.unique(fp, return_inverse=True, return_counts=True)
        owner = np.searchsorted(starts, distinct, side="right") - 1
        first = np.searchsorted(owner, np.arange(owners + 1))
        none = lambda kind, n: pa.nulls(n, kind)
        n = len(fps)
        yield _batch(
            [pa.array([0] * n, pa.int32()), pa.array([name] * n, pa.int64()), pa.array(owner[place], pa.int32()), pa.array(range(n), pa.int32()), pa.chunked_array(ids, id_type).combine_chunks(), pa.array(shas, pa.string()), pa.array((np.arange(len(distinct)) - first[owner])[place], pa.int32()), pa.array(times[place] > 1), none(pa.binary(), n), pa.chunked_array(hashes, pa.int64()).combine_chunks()]
        )
        codes = [(o, rice_encode(distinct[a:b], int(starts[o]), int(starts[o + 1] - starts[o]))) for o, (a, b) in enumerate(zip(first, first[1:], strict=False)) if b > a]
        n = len(codes)
        yield _batch([pa.array([1] * n, pa.int32()), pa.array([name] * n, pa.int64()), pa.array([o for o, _ in codes], pa.int32()), none(pa.int32(), n), none(id_type, n), none(pa.string(), n), none(pa.int32(), n), none(pa.bool_(), n), pa.array([c for _, c in codes], pa.binary()), none(pa.int64(), n)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, hashes, shas, fps = TaskContext.get().partitionId() << 24, [], [], [], []
        for batch in batches:
            every = np.arange(batch.num_rows)  # copies, as columns hold their batch's texts too
            ids.append(batch.column(0).take(every))
            hashes.append(batch.column(2).take(every))
            for text in batch.column(1):
                digest = hashlib.sha256(text.as_py().encode().lower())  # bytes.lower() knows A-Z only
                shas.append(digest.hexdigest())
                fps.append(int.from_bytes(digest.digest()[: FP_BITS // 8]))
            if len(fps) >= PART_ROWS:
                yield from part(ids, hashes, shas, fps, number)
                number, ids, hashes, shas, fps = number + 1, [], [], [], []
        if fps:
            yield from part(ids, hashes, shas, fps, number)
        give_back()

    return run


_NAMES = ["kind", "part", "owner", "pos", "doc_id", "sha", "rank", "twice", "code", "text_hash"]


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _answer(codes: pd.DataFrame) -> pd.DataFrame:
    """For one owner: a bitmap for each part that sent a fingerprint which another part sent too."""
    sent = [rice_decode(c) for c in codes["code"]]
    values, times = np.unique(np.concatenate(sent), return_counts=True)
    again = values[times > 1]
    rows = [(p, o, np.packbits(m).tobytes()) for p, o, v in zip(codes["part"], codes["owner"], sent, strict=True) if (m := np.isin(v, again, assume_unique=True)).any()]
    return pd.DataFrame(rows, columns=["part", "owner", "bitmap"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_hash (of the text as it is).

    Null texts are empty texts. Of rows with equal texts the one with the largest
    id stays (null ids are smallest); if that id is repeated, one of its rows
    stays. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"), F.xxhash64(whole(text_col)).alias("text_hash"))
    id_field = T.StructField("doc_id", rows.schema["doc_id"].dataType)
    owners = max(16, -(-docs.count() // ROWS_AN_OWNER))
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("part", T.LongType()), T.StructField("owner", T.IntegerType()), T.StructField("pos", T.IntegerType()), id_field, T.StructField("sha", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("twice", T.BooleanType()), T.StructField("code", T.BinaryType()), T.StructField("text_hash", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_type

    with small_batches(spark):
        table = written(rows.mapInArrow(_fingerprint(owners, to_arrow_type(id_field.dataType)), schema), "fingerprints", "kind")
    codes = table.where("kind = 1").select("part", "owner", "code")
    bitmaps = codes.groupBy("owner").applyInPandas(_answer, "part long, owner int, bitmap binary")
    marked = table.where("kind = 0").select("part", "owner", "pos", "doc_id", "sha", "rank", "twice", "text_hash")
    bit = "shiftright(cast(conv(hex(substring(bitmap, rank div 8 + 1, 1)), 16, 10) as int), 7 - rank % 8) & 1"
    suspects = written(
        marked.join(bitmaps, ["part", "owner"], "left").where(F.col("twice") | F.coalesce(F.expr(bit) == 1, F.lit(False))).select("part", "pos", "doc_id", "sha", "text_hash"),
        "suspects",
    )
    # Byte for byte: the suspects' texts are grouped by their own bytes. A bitmap of their hashes tells them where they
    # lie; what it lets through by chance is in no class and goes with the join below.
    texts = filtered(rows, suspects.select(F.col("text_hash").alias("hash")), F.col("text_hash"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    same = texts.select(F.translate("text", upper, lower).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("same_bytes")).select(F.sha2("text", 256).alias("sha"), "same_bytes")
    classes = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "part", "pos")).alias("keep"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1").join(same, "sha")
    classes = classes.select(
        "sha", "keep", F.when(F.col("same_bytes") == F.col("group_size"), F.col("group_size")).otherwise(F.raise_error(F.lit("texts with one SHA-256 differ in their bytes")).cast("long")).alias("group_size")
    )
    # A table of its own, so that the join may split the rows of a large class among tasks.
    classes = written(classes, "classes")
    alone = F.col("keep").isNull()
    return marked.join(classes, "sha", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | ((F.col("keep.part") == F.col("part")) & (F.col("keep.pos") == F.col("pos")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "text_hash",
    )
