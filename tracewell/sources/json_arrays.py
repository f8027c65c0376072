"""JSON arrays of any size, read in parallel.

A file that is one array can't be cut at lines. It is read as text that ends at each
closing brace, which Spark's reader splits at any byte: such fragments are short. Whether a
fragment begins inside a string, and how deep, depends on all that comes before it in
its file, so each tells what it would change either way (quotes, braces and brackets), the
changes of each block of a file are summed up, and a running sum over blocks and
then within each block settles it. A record ends with the fragment after which the depth is that
of the array's elements again. Only the pieces of records that lie in two blocks or more meet by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _outside(parts: Column, first: int) -> Column:
    """Of a text cut at its quotes, every second part."""
    return F.array_join(F.filter(parts, lambda x, i: i % 2 == first), " ")


def _change(text: Column) -> Column:
    """How much deeper a text without strings leads."""
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return (count("{[") - count("}]")).cast("long")


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, text, quotes, plain, quoted): pieces that end at a closing brace, and what they change if they begin outside a string or inside one."""
    rows = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("text"))
    # Escaped characters are no quotes. The brace at the end, which the reader took off, is outside if the last part is.
    parts = F.split(F.regexp_replace("text", r"\\.", ""), '"')
    rows = rows.withColumn("_parts", parts).withColumn("quotes", (F.size("_parts") - 1).cast("long"))
    closes = lambda inside: F.when((F.col("quotes") + inside) % 2 == 0, 1).otherwise(0)
    return rows.select("file", "block", "n", "text", "quotes", (_change(_outside(F.col("_parts"), 0)) - closes(0)).alias("plain"), (_change(_outside(F.col("_parts"), 1)) - closes(1)).alias("quoted"))


def _with_start(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all that comes before in the file: over the blocks before, and within the block."""
    rows = rows.withColumn("_v", value)
    blocks = rows.groupBy("file", "block").agg(F.sum("_v").alias("_all"))  # a row a block
    before = blocks.select("file", "block", F.coalesce(F.sum("_all").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum("_v").over(W.partitionBy("file", "block").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(before, ["file", "block"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_v", "_own", "_before")


def array_records(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """(file, place, data): the objects that lie ``depth`` deep, in order: 1 those of an array, 2 those of an array in an object ({"value": [...]}).

    Files may hold several arrays one after the other. Elements that are no objects are passed over, as is what a cut-off file ends with; an element
    that is an array with objects in it is not read, and spoils the record after it, as does, two deep, another field with objects in objects. A file may
    have any size, a record that of a task's memory. Records are not checked: one that is no JSON is left to what reads it.
    """
    if depth not in _BEFORE:
        raise ValueError("records lie in an array (1) or in an array of an object (2)")
    rows = fragments(spark, path)
    rows = _with_start(rows, F.col("quotes"), "_quotes")
    rows = rows.withColumn("_change", F.when(F.col("_quotes") % 2 == 0, F.col("plain")).otherwise(F.col("quoted"))).withColumn("_open", (F.col("_quotes") + F.col("quotes")) % 2)
    rows = _with_start(rows, F.col("_change"), "_depth")
    ends = (F.col("_open") == 0) & (F.col("_depth") + F.col("_change") == depth)
    rows = rows.withColumn("_ends", ends.cast("long"))
    rows = _with_start(rows, F.col("_ends"), "place")
    piece = F.struct("block", "n", "text", F.col("_ends").alias("ends"))
    within = rows.groupBy("file", "block", "place").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    # What begins or ends a block may go on in another one; all else is whole.
    spans = within.groupBy("file", "block").agg(F.min("place").alias("_first"), F.max("place").alias("_last"))
    marked = within.join(spans, ["file", "block"])
    edge = (F.col("place") == F.col("_first")) | (F.col("place") == F.col("_last"))
    joined = marked.where(edge).groupBy("file", "place").agg(F.array_sort(F.flatten(F.collect_list("pieces"))).alias("pieces"))
    every = marked.where(~edge).select("file", "place", "pieces").unionByName(joined)
    # A file's last fragment is what follows its last brace.
    whole = every.where(F.element_at("pieces", -1)["ends"] == 1)
    text = F.concat(F.array_join(F.transform("pieces", lambda x: x["text"]), "}"), F.lit("}"))
    return whole.select("file", "place", _from_brace(text, depth).alias("data")).where("data is not null")


# A stretch of text without braces and brackets but in its strings.
_FLAT = r'[^"{}\[\]]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^"{}\[\]]*+)*+'
_BEFORE = {
    1: rf"{_FLAT}(?:[\[\]]{_FLAT})*+",
    # At the beginning of an object its fields before the array, one object deep, with the end of the object before; else a comma.
    2: rf"(?:\s*+(?:\]{_FLAT}\}}\s*+)?\{{{_FLAT}(?:(?:\{{{_FLAT}\}}|\[{_FLAT}\]){_FLAT})*+\[{_FLAT}|{_FLAT})",
}


def _from_brace(text: Column, depth: int) -> Column:
    """The record within the text since the last one, without the commas, scalars and beginnings of what it is in that lie before it."""
    return F.nullif(F.regexp_extract(text, rf"(?s)^\x{{FEFF}}?{_BEFORE[depth]}(\{{.*)$", 1), F.lit(""))
