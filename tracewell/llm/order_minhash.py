"""Document fingerprints by Order MinHash.

A text is cut into tokens of at most twelve characters without white space, and k
consecutive tokens are a k-mer. Within a run without white space a token ends where
its own characters say so, not at a place counted from the run's start, and letters of
scripts without spaces are tokens of their own: an inserted character changes the
tokens around it only. Equal k-mers of a text are numbered in their order. A
hash of k-mer and number deals them into bins and ranks them within; the two smallest
of a bin, put back into text order, are hashed together as one component. Two
components agree only where both hold the same k-mers in the same order, so moved and
exchanged passages lower the likeness, as edits do. All of it is array functions.

One long holds a k-mer's hash (33 bits) and its place (31 bits, as many as an array has),
so that both sorts are sorts of plain longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole

#: A letter of a script without spaces; from the fourth character on up to a vowel or an even digit; or what is left, at most twelve.
TOKEN = r"\p{Lo}|[^\s\p{Lo}]{3,11}?[aeiou02468аеиоуыяαεηιουω]|[^\s\p{Lo}]{1,12}"
PLACE_BITS = 31
BIN_BITS = 6
ROWS_A_BUCKET, MOST_BUCKETS = 2048, 20_000


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _rank(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE_BITS)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def with_components(df: DataFrame, text: str, to: str, k: int = 3) -> DataFrame:
    """``df`` with the fingerprint of a text column as array<long>: for each bin that isn't empty its number, then 32 bits for the two k-mers it holds.

    Each step is a column of its own: an array is made once and its elements are then
    looked up, and the sorts of longs stay in generated code.
    """
    s, st, c = F.col("_sorted"), F.col("_starts"), F.col("_chosen")
    at = lambda a, i: F.get(a, i)
    empty = F.array().cast("array<int>")
    df = df.withColumn("_tokens", F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    ts = F.col("_tokens")
    df = df.withColumn("_n", F.size(ts)).withColumn("_sorted", F.sort_array(F.transform(ts, lambda t, i: F.shiftleft(F.xxhash64(t, *[at(ts, i + j) for j in range(1, k)]), PLACE_BITS).bitwiseOR(_place(i.cast("long"))))))
    # Where a run of equal k-mers starts, and so which one of its equals each k-mer is.
    kmer = lambda x: F.shiftright(x, PLACE_BITS)
    every = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(empty)
    df = df.withColumn("_starts", F.filter(every, lambda i: (i == 0) | (kmer(at(s, i)) != kmer(at(s, i - 1)))))
    df = df.withColumn("_number", F.when(F.size(st) < F.col("_n"), F.flatten(F.transform(st, lambda a, j: F.sequence(F.lit(0), F.coalesce(at(st, j + 1), F.col("_n")) - a - 1)))))
    ranked = lambda x, of: F.shiftleft(F.shiftrightunsigned(F.xxhash64(kmer(x), of), PLACE_BITS), PLACE_BITS).bitwiseOR(_place(x))
    number = F.col("_number")
    df = df.withColumn("_ranked", F.sort_array(F.when(number.isNull(), F.transform(s, lambda x: ranked(x, F.lit(0)))).otherwise(F.transform(s, lambda x, i: ranked(x, at(number, i))))))
    r = F.col("_ranked")
    # The two smallest of each bin, then one component for each bin.
    df = df.withColumn("_chosen", F.filter(r, lambda x, i: (i < 2) | (_bin(x) != _bin(at(r, i - 2)))))

    def component(x: Column, i: Column) -> Column:
        y = at(c, i + 1)
        pair = _bin(y) == _bin(x)
        turned = pair & (_place(y) < _place(x))
        both = F.when(turned, F.xxhash64(_rank(y), _rank(x))).when(pair, F.xxhash64(_rank(x), _rank(y))).otherwise(F.xxhash64(_rank(x)))
        head = (i == 0) | (_bin(x) != _bin(at(c, i - 1)))
        return F.when(head, F.shiftleft(_bin(x), 32).bitwiseOR(both.bitwiseAND(F.lit(0xFFFFFFFF))))

    df = df.withColumn(to, F.array_compact(F.transform(c, component)))
    return df.drop("_tokens", "_n", "_sorted", "_starts", "_number", "_ranked", "_chosen")


def likeness(a: Column, b: Column) -> Column:
    """Components that agree, by bins that either has; 1 for two texts without tokens."""
    bins = lambda x: F.transform(x, lambda y: F.shiftright(y, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, F.hex), ",")


def _order_key(doc_id: Column, kind: T.DataType) -> Column:
    """A double that never falls where ids rise; of ids that aren't numbers their first six bytes."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return doc_id.cast("double")
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.unix_micros(doc_id.cast("timestamp")).cast("double")
    return F.conv(F.rpad(F.hex(F.substring(doc_id.cast("string").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")


def _bucket(key: Column, of: Column, bounds: list[float]) -> Column:
    """Buckets in descending order of ids; ids that are null come last, dealt by their text's hash."""
    step = 128
    coarse, fine = F.lit(bounds[::step]).cast("array<double>"), F.lit(bounds).cast("array<double>")
    jump = F.greatest(F.size(F.filter(coarse, lambda b: b <= key)) - 1, F.lit(0)) * step
    below = jump + F.size(F.filter(F.slice(fine, jump + 1, step), lambda b: b <= key))
    return F.when(key.isNull(), F.lit(len(bounds) + 256) - F.conv(F.substring(of, 1, 2), 16, 10).cast("int")).otherwise(F.lit(len(bounds)) - below)


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the beginning of the next
    document's, in descending order of ids of any type (equal ids: of the texts' MD5; null ids
    last); after the last comes the first, and a lone document follows itself. Null
    texts are empty texts; texts without tokens have the empty fingerprint. The
    texts are shuffled once, in buckets of neighbouring ids, each with a copy of the
    row that follows its last. An empty table gives no rows; other columns are not
    read.
    """
    text = whole(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.md5(text).alias("of"))
    n, kind = docs.count(), docs.schema[id_col].dataType
    buckets = min(MOST_BUCKETS, -(-n // ROWS_A_BUCKET))
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(docs.select(_order_key(F.col(id_col), kind).alias("id")).approxQuantile("id", cuts, 0.1 / buckets))) if cuts else []
    placed = base.withColumn("bucket", _bucket(_order_key(F.col("doc_id"), kind), F.col("of"), bounds or [0.0]))
    # At most MOST_BUCKETS + 256 rows: the first of each bucket, and for each bucket the first of the next one.
    heads = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", "of")).alias("head"))
    along = W.orderBy("bucket")
    follow = heads.select("bucket", F.coalesce(F.lead("head").over(along), F.first("head").over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("head"))
    guests = base.join(F.broadcast(follow.select("bucket", F.col("head.doc_id").alias("head_id"), F.col("head.of").alias("head_of"))), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("of") == F.col("head_of")))
    guests = guests.dropDuplicates(["bucket"]).select("doc_id", "text", "of", "bucket", F.lit(1).alias("guest"))
    rows = with_components(placed.withColumn("guest", F.lit(0)).unionByName(guests), "text", "parts", k)
    by = W.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("of").desc())
    paired = rows.withColumn("next_text", F.lead("text").over(by)).withColumn("next_parts", F.lead("parts").over(by)).where("guest = 0")
    n_chars = F.length("text").cast("long")
    half = F.expr("length(text) div 2").cast("int")
    edited = paired.select("doc_id", n_chars.alias("n_chars"), "parts", "next_parts", F.concat(F.substring("text", F.lit(1), (F.length("text") - half).cast("int")), F.substring("next_text", F.lit(1), half)).alias("edited"))
    both = with_components(edited, "edited", "edited_parts", k).withColumn("edited_sha256", F.sha2("edited", 256))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("parts")).alias("fingerprint"), as_text(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"), likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )
