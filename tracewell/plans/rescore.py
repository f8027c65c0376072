"""Scores that are kept: what hasn't changed isn't scored again, and a run adds to the store instead of rewriting it.

The store is a folder of generations. A row of it has a key, a fingerprint of all that
its score was made from, the score's columns and whether the row is gone. A run
fingerprints the rows as they are now, scores those whose key and fingerprint the store's
latest rows don't have, and appends them as the next generation. A run that fails leaves a generation
without its success mark, which the next one writes over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from .baseline import FAMILIES


def fingerprint(inputs: list[str], version: str) -> Column:
    """128 bits of the values that a score is made from, and of how it is made; nulls differ from all values."""
    return F.md5(F.concat_ws("\x1e", F.lit(version), *[F.coalesce(F.to_json(F.array(c)), F.lit("")) for c in inputs]))


def current(spark: SparkSession, store: str) -> DataFrame | None:
    """The latest row of each key, gone ones included; None where there is no store yet."""
    try:
        rows = spark.read.parquet(store)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    last = rows.groupBy("key").agg(F.max_by(F.struct(*rows.columns), "generation").alias("r"))
    return last.select("r.*")


def update(rows: DataFrame, key: str, inputs: list[str], score: Callable[[DataFrame], DataFrame], store: str, version: str) -> int:
    """Scores what is new or has changed and appends it; the number of rows scored.

    ``rows`` have one row a key. ``score`` takes some of them and gives their key and the score's columns. Rows of the store whose key is no longer
    there are marked as gone. Another ``version`` scores everything again.
    """
    spark = rows.sparkSession
    known = current(spark, store)
    now = rows.withColumn("_inputs", fingerprint(inputs, version))
    if known is None:
        number, open_, gone = 1, now, None
    else:
        number = known.agg(F.max("generation").alias("n")).first()["n"] + 1
        held = known.where("not gone").select(F.col("key").alias("_key"), F.col("inputs").alias("_was"))
        open_ = now.join(held, (F.col(key) == F.col("_key")) & (F.col("_inputs") == F.col("_was")), "left_anti")
        gone = held.join(now, F.col("_key") == F.col(key), "left_anti").select(F.col("_key").alias("key"), F.col("_was").alias("inputs"), F.lit(True).alias("gone"))
    made = score(open_.drop("_inputs"))
    out = open_.select(F.col(key).alias("_k"), F.col("_inputs").alias("inputs")).join(made, F.col("_k") == F.col(key)).select(F.col("_k").alias("key"), "inputs", F.lit(False).alias("gone"), *[c for c in made.columns if c != key])
    if gone is not None:
        out = out.unionByName(gone, allowMissingColumns=True)
    out.write.mode("overwrite").parquet(f"{store}/generation={number}")
    return spark.read.parquet(f"{store}/generation={number}").where("not gone").count()


def mail_scores(mails: DataFrame, weights: dict[str, int], strong: list[str]) -> DataFrame:
    """(id, risk, groups): the weightiest flag of each family, the next ones by a quarter; without a strong flag 45 at most, and less for trusted senders.

    ``mails`` have id, flags, attachmentRisk and, as booleans, authenticated, internal, bulk and trusted. An attachment's risk counts for nine tenths, whatever else is said.
    """
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    family = lambda f: F.coalesce(*[F.when(V.any_of([f.startswith(p) for p in ps]), name) for name, ps in FAMILIES.items()], F.lit("context"))
    flags = F.filter(F.array_distinct(F.coalesce("flags", F.array().cast("array<string>"))), lambda f: ~f.startswith("att_") & known[f].isNotNull())
    points = F.transform(F.array(*[F.lit(n) for n in [*FAMILIES, "context"]]), lambda n: F.struct(n.alias("family"), F.array_max(F.transform(F.filter("_flags", lambda f: family(f) == n), lambda f: known[f])).alias("points")))
    rows = mails.withColumn("_flags", flags).withColumn("groups", F.filter(points, lambda g: g["points"].isNotNull()))
    raw = V.risk_score(F.transform("groups", lambda g: g["points"])).cast("int")
    sure = F.array(*[F.lit(s) for s in strong]).cast("array<string>")
    # Newsletters lead their links through counters: a text unlike its link says nothing there.
    mine = F.when(V.truth(F.col("bulk")), F.array_except(sure, F.array(F.lit("url_text_href_mismatch"), F.lit("hidden_text")))).otherwise(sure)
    trusted = V.truth(F.col("authenticated"))
    most = F.when(V.truth(F.col("trusted")), 10).when(trusted & V.truth(F.col("internal")), 12).when(trusted & V.truth(F.col("bulk")), 20).when(trusted, 35).otherwise(45)
    risk = F.when(F.arrays_overlap(F.coalesce("flags", F.array().cast("array<string>")), mine), raw).otherwise(F.least(raw, most))
    return rows.select("id", F.least(F.lit(100), F.greatest(risk, F.floor(F.coalesce("attachmentRisk", F.lit(0)) * 0.9).cast("int"))).alias("risk"), F.transform("groups", lambda g: g["family"]).alias("groups"))
