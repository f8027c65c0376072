"""Line dedup over content-defined chunks of lines.

A line ends a chunk where a rolling hash over its own and the previous line's hash is
0 modulo the mean chunk length, so boundaries move with the text and an inserted line
changes the chunks around it only. Chunks of at least two lines that occur again
anywhere in the corpus are compared byte for byte; all but the first occurrence (by
id, text hash and place) go. All of it is array functions, joins and aggregations.

A repeated passage of a few lines seldom holds two boundaries of its own, so chunks
miss most of them. ``passage_dedup`` starts a match at every line instead, which finds
every repeated passage whole; its neighbours don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole, with_mark, written

PRIME = 2**31 - 1


def line_hash(line: Column) -> Column:
    """28 bits of the MD5, which other engines can compute too."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunks_of(text: Column, mean_lines: int) -> Column:
    """The text as array<struct<first, n_lines, body>>; the bodies joined by line feeds give the text again."""
    lines = F.split(text, "\n")
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  binds a value once
    rolled = lambda hs: F.transform(hs, lambda h, i: (h + F.coalesce(F.get(hs, i - 1), F.lit(0)) * 31) % PRIME)
    ends = lambda hs: F.filter(F.sequence(F.lit(0), F.size(hs) - 1), lambda i: (F.get(hs, i) % mean_lines == 0) | (i == F.size(hs) - 1))
    cut = lambda ls, es: F.transform(es, lambda e, j: once(F.when(j == 0, F.lit(0)).otherwise(F.get(es, j - 1) + 1), lambda s: F.struct(s.alias("first"), (e - s + 1).alias("n_lines"), F.array_join(F.slice(ls, s + 1, e - s + 1), "\n").alias("body"))))
    return once(lines, lambda ls: once(F.transform(ls, line_hash), lambda hs: once(rolled(hs), lambda rs: once(ends(rs), lambda es: cut(ls, es)))))


def _with_going(base: DataFrame, going: DataFrame) -> DataFrame:
    """``base`` with what goes of each document, by id and text hash; only rows of which something may go are shuffled."""
    going = written(going.withColumnsRenamed({"doc_id": "going_id", "of": "going_of"}), "going")
    marked = with_mark(base, going.select(F.xxhash64("going_id", "going_of").alias("hash")), F.xxhash64("doc_id", "of"))
    joined = marked.where("_may").join(going.hint("merge"), F.col("doc_id").eqNullSafe(F.col("going_id")) & (F.col("of") == F.col("going_of")), "left")
    return joined.unionByName(marked.where("not _may"), allowMissingColumns=True)


def line_dedup(docs: DataFrame, mean_lines: int = 4, least_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, text without repeated chunks, n_lines, removed_lines, removed_chunks.

    Null texts are empty texts: one empty line, nothing removed. Rows equal in id
    and text are one document to this operator and get the same result. A document
    all of whose chunks are repeats becomes the empty text. An empty table gives no
    rows; other columns are not read.
    """
    text = whole(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.md5(text).alias("of"))
    every = base.select("doc_id", "of", F.posexplode(chunks_of(F.col("text"), mean_lines)).alias("place", "chunk"))
    several = every.where(F.col("chunk.n_lines") >= least_lines).select("doc_id", "of", "place", F.col("chunk.body").alias("body"), F.xxhash64("chunk.body").alias("print"))
    again = several.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")
    # Tables of their own, so that the joins may split the occurrences of a frequent chunk among tasks.
    again = written(again, "again")
    occurrences = written(several.join(again, "print", "left_semi"), "chunks")
    first = occurrences.groupBy("print", "body").agg(F.min(F.struct("doc_id", "of", "place")).alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = written(first, "first")
    going = occurrences.join(first, ["print", "body"]).where(F.struct("doc_id", "of", "place") != F.col("stays")).groupBy("doc_id", "of").agg(F.collect_set("place").alias("gone"))
    marked = _with_going(base, going)
    out = marked.withColumn("chunks", F.when(F.col("gone").isNotNull(), chunks_of(F.col("text"), mean_lines)))
    stay = F.filter("chunks", lambda c, i: ~F.array_contains("gone", i))
    lost = F.filter("chunks", lambda c, i: F.array_contains("gone", i))
    return out.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda c: c["body"]), "\n")).alias("text"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate(lost, F.lit(0).cast("long"), lambda a, c: a + c["n_lines"]), F.lit(0)).alias("removed_lines"),
        F.coalesce(F.size("gone").cast("long"), F.lit(0)).alias("removed_chunks"),
    )


def passage_dedup(docs: DataFrame, least_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, text without repeated passages, n_lines, removed_lines, removed_passages.

    A passage is a run of at least ``least_lines`` lines; it goes where the same lines
    occur before (by id, text hash and place) and not in part on the same lines. Runs of
    ``least_lines`` from every line are compared by their SHA-256, and what is found grows
    to the longest run, as a longer one is the union of those in it. Every line that goes
    is still somewhere: the first of its kind is in no run that occurs before. Null texts,
    repeated rows and empty results are as in ``line_dedup``.
    """
    text = whole(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("of"))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  binds a value once
    places = lambda ls: F.when(F.size(ls) >= least_lines, F.sequence(F.lit(0), F.size(ls) - least_lines))
    runs = once(F.split("text", "\n"), lambda ls: F.transform(places(ls), lambda i: F.unhex(F.sha2(F.array_join(F.slice(ls, i + 1, least_lines), "\n"), 256))))
    # A table of its own, so that the join may split the occurrences of a frequent run among tasks.
    every = written(base.select("doc_id", "of", F.posexplode(runs).alias("place", "print")), "runs")
    first = every.groupBy("print").agg(F.min(F.struct("doc_id", "of", "place")).alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = written(first, "first")
    elsewhere = F.struct("doc_id", "of") != F.struct("stays.doc_id", "stays.of")
    going = every.join(first, "print").where(elsewhere | (F.col("place") >= F.col("stays.place") + least_lines)).groupBy("doc_id", "of").agg(F.collect_set("place").alias("starts"))
    marked = _with_going(base, going)
    lost = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + least_lines - 1))))
    kept = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("lost")), lambda i: F.get(ls, i))
    return marked.withColumn("lost", lost).select(
        "doc_id",
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(once(F.split("text", "\n"), lambda ls: F.array_join(kept(ls), "\n"))).alias("text"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost").cast("long"), F.lit(0)).alias("removed_lines"),
        F.coalesce(F.size(F.array_except("lost", F.transform("lost", lambda i: i + 1))).cast("long"), F.lit(0)).alias("removed_passages"),
    )


def passage_oracle() -> str:
    """``passage_dedup`` of two lines in DuckDB SQL, for tables whose ids don't repeat."""
    return """
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, i, ls[i + 1] AS line, len(ls) AS n FROM d, LATERAL (SELECT unnest(range(len(ls))) AS i)),
    p AS (SELECT doc_id, i, n, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS body FROM l),
    f AS (SELECT doc_id, i, first_value(doc_id) OVER w AS first_id, first_value(i) OVER w AS first_i FROM p WHERE i < n - 1 WINDOW w AS (PARTITION BY body ORDER BY doc_id, i)),
    s AS (SELECT doc_id, i FROM f WHERE doc_id <> first_id OR i >= first_i + 2),
    g AS (SELECT doc_id, i FROM s UNION SELECT doc_id, i + 1 FROM s),
    m AS (SELECT l.doc_id, l.i, line, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i),
    r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM m)
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*)::BIGINT AS n_lines,
           count(*) FILTER (gone)::BIGINT AS removed_lines, count(*) FILTER (starts)::BIGINT AS removed_passages
    FROM r GROUP BY doc_id"""


def oracle(mean_lines: int = 4, least_lines: int = 2) -> str:
    """The same in DuckDB SQL, for tables whose ids don't repeat."""
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, i, ls[i + 1] AS line, len(ls) AS n, ('0x' || substr(md5(ls[i + 1]), 1, 7))::BIGINT AS h
          FROM d, LATERAL (SELECT unnest(range(len(ls))) AS i)),
    e AS (SELECT *, CASE WHEN (h + coalesce(lag(h) OVER o, 0) * 31) % {PRIME} % {mean_lines} = 0 OR i = n - 1 THEN 1 ELSE 0 END AS closes FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    g AS (SELECT *, coalesce(sum(closes) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM e),
    c AS (SELECT doc_id, place, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS body FROM g GROUP BY doc_id, place),
    r AS (SELECT *, n_lines >= {least_lines} AND row_number() OVER (PARTITION BY body ORDER BY doc_id, place) > 1 AS gone FROM c)
    SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text,
           sum(n_lines)::BIGINT AS n_lines, coalesce(sum(n_lines) FILTER (gone), 0)::BIGINT AS removed_lines,
           count(*) FILTER (gone)::BIGINT AS removed_chunks
    FROM r GROUP BY doc_id"""
