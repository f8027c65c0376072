"""Mixing sources to target weights by hash-threshold histograms.

A document's hash lies in [0, 2^60) and doesn't depend on the run. A source that is to
give r of its words takes every document floor(r) times and, once more, those whose
hash lies below a threshold. The threshold is found without sorting: words are
summed by source and the top 12 bits of the hash, the bucket in which the running
sum passes the budget is found, and only the documents of that bucket are summed
again by their next 12 bits. A smaller budget's documents are within a larger one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

HASH_BITS, STEP_BITS = 60, 12


def mix_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size, one row each) with ``target``.

    Weights go round the sources in code-point order, null last. A target stops at
    ``most`` times its source's size, and what is over is shared again by weight:
    with the sources in the order in which they reach their stop, the level at which
    the rest share is a running sum. One row a source is all that meets in a task.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    one = sources.withColumn("weight", weight).withColumn("stop", F.lit(float(most)) * F.col("source_size"))
    by_stop = W.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    one = (
        one.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("stopped", F.coalesce(F.sum("stop").over(by_stop.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("sharing", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_stop.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("sharing"))
    )
    # The first source, in order of its stop, that the level doesn't reach.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct((F.col("stop") / F.col("weight")).alias("at"), F.col("level")))).over(every)
    return one.withColumn("shared", level["level"] * F.col("weight")).select("source", "source_size", F.when(F.col("shared").isNull() | (F.col("shared") > F.col("stop")), F.col("stop")).otherwise(F.col("shared")).alias("target"))


def mix_hash(doc_id: Column, text: Column, seed: int = 17) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 64 - HASH_BITS)


def drawn(whole: Column, rest: Column, cut: Column, mix_hash: Column) -> Column:
    """How often a row is taken, from its source's row of ``mix_table`` and its hash."""
    return whole + F.when((rest > 0) & (mix_hash < cut), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, copies, taken, mix_hash.

    Size is the number of words (null text: 0). ``copies`` says how often the mix
    takes the row. Rows equal in id and text share their hash and stand or fall
    together. Null sources are one source, the last. The threshold is that whose sum
    comes nearest to the budget, so a source misses its target by at most half of
    one document (or of one run of rows with equal hashes). An empty table gives no
    rows; other columns are not read.
    """
    rows, table = mix_table(docs, weights, share, most, seed, id_col, text_col, source_col)
    taken = rows.withColumn("of", F.struct("source")).join(table, "of")
    return taken.withColumn("copies", drawn(F.col("whole"), F.col("rest"), F.col("cut"), F.col("mix_hash"))).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "mix_hash"
    )


def mix_table(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The sized rows, and for each source (of) its size, target, how often all of it is taken (whole) and up to which hash (cut) once more."""
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            mix_hash(F.col(id_col), F.col(text_col), seed).alias("mix_hash"),
        ),
        "sized",
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = mix_targets(sources, weights, share, most).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)))
    targets = written(
        targets.select(F.struct("source").alias("of"), "source_size", "target", F.col("whole").cast("long").alias("whole"), F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")),
        "targets",
    )
    # low: the hashes below it are taken; left: what of the budget is still to be found within [low, low + width).
    bounds = targets.select("of", F.lit(0).cast("long").alias("low"), F.col("rest").alias("left"))
    sized = rows.withColumn("of", F.struct("source")).select("of", "size", "mix_hash")
    shift = HASH_BITS
    while shift > 0:
        width, shift = shift, shift - STEP_BITS
        within = sized.join(bounds, "of").where(F.shiftright("mix_hash", width) == F.shiftright("low", width)) if width < HASH_BITS else sized.join(bounds, "of")
        bucket = F.shiftright("mix_hash", shift).alias("bucket")
        sums = within.groupBy("of", bucket, "left").agg(F.sum("size").alias("n"))
        running = sums.withColumn("upto", F.sum("n").over(W.partitionBy("of").orderBy("bucket")))
        crossed = running.where(F.col("upto") >= F.col("left")).groupBy("of").agg(F.min(F.struct("bucket", "upto", "n")).alias("at"))
        step = bounds.join(crossed, "of", "left").select(
            "of",
            # No bucket crosses: the budget holds all of the stretch.
            F.when(F.col("at").isNull(), F.col("low") + F.lit((1 << width) - 1)).otherwise(F.shiftleft(F.col("at.bucket"), shift)).alias("low"),
            F.when(F.col("at").isNull(), F.lit(0.0)).otherwise(F.col("left") - (F.col("at.upto") - F.col("at.n"))).alias("left"),
            (F.col("at.n") if shift == 0 else F.lit(None).cast("long")).alias("next"),
        )
        bounds = written(step, "bounds")
    # At a width of one hash: its rows are taken too if that comes nearer.
    cut = bounds.select("of", (F.col("low") + F.when(F.col("left") > F.col("next") / 2, 1).otherwise(0)).alias("cut"))
    return rows, written(targets.join(cut, "of"), "mix")
