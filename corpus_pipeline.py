"""A corpus made ready for training: five stages over ``documents``, each written as Parquet and read again.

1. quality: documents whose perplexity is above their language's threshold go.
2. exact dedup: of equal texts one document stays.
3. near dedup: of each class of near copies one document stays.
4. mixing: every document comes as often as the mix takes it.
5. packing: what is left is dealt into bins of 2,048 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import chosen_path, exact_dedup, kneser_ney, mixing, packing
from tracewell.llm.common import discard, read, with_mark, written


def _held(docs: DataFrame) -> DataFrame:
    """Rows as a struct, so that columns of any name clash with none of a stage's."""
    return docs.select(F.struct(*docs.columns).alias("_row"))


def _same() -> Column:
    """Whether a held row has the id and the text of (_id, _of)."""
    return F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col("_row.text"), F.lit(""))) == F.col("_of"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = kneser_ney.classify(_held(docs).select("_row.doc_id", "_row.text", "_row.lang", "_row"), read(spark, sf_dir, "labels"), columns=("_row",), text_in=("_row", "text"))
    return kept.where("_keep").select("_row.*")


def _parted(docs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Held rows that surely have no pair (_id, _of), which stay where they lie, and those that may."""
    of = F.xxhash64(F.col("_row.doc_id"), F.xxhash64(F.coalesce(F.col("_row.text"), F.lit(""))))
    marked = with_mark(_held(docs), pairs.select(F.xxhash64("_id", "_of").alias("hash")), of)
    return marked.where("not _may").drop("_may"), marked.where("_may").drop("_may")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are matched to the operator's by id and text; of rows equal in both one stays."""
    found = exact_dedup.exact_dedup(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_of"), "kept")
    pairs = written(found.groupBy("_id", "_of").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1"), "pairs")
    left, maybe = _parted(docs, pairs)
    left = left.unionByName(maybe.join(pairs.hint("merge"), _same(), "left_anti"))
    repeated = pairs.where("stays")
    if not repeated.isEmpty():
        once = maybe.join(repeated, _same(), "left_semi").withColumns({"_id": F.col("_row.doc_id"), "_text": F.col("_row.text")}).dropDuplicates(["_id", "_text"]).select("_row")
        left = left.unionByName(once)
    return left.select("_row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows equal in id and text, which only a table that skips the stage before has, stay or go together."""
    found = chosen_path.near_duplicates(docs)
    gone = written(found.where("not first").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_of")).distinct(), "gone")
    left, maybe = _parted(docs, gone)
    return left.unionByName(maybe.join(gone.hint("merge"), _same(), "left_anti")).select("_row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes; rows equal in id, text and source have the same number.

    What decides is the row's hash and a row of its source, so rows are told where they lie as long as
    the sources' table is small enough for Spark to broadcast.
    """
    rows, table = mixing.mix_table(docs)
    discard(rows)
    held = _held(docs).withColumn("_hash", mixing.mix_hash(F.col("_row.doc_id"), F.col("_row.text")))
    of = F.struct(F.col("_row.source").cast("string").alias("source"))
    taken = held.join(table.select(F.struct("of", "whole", "rest", "cut").alias("_mix")), of == F.col("_mix.of"))
    copies = mixing.drawn(F.col("_mix.whole"), F.col("_mix.rest"), F.col("_mix.cut"), F.col("_hash"))
    return taken.select("_row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_copy")).select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixed), ("best-fit packing", packed)]

#: Language model scores and near copies have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
