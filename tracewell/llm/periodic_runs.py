"""Periodic runs of words by Lyndon arrays, after Ellert and Fischer.

A run is a maximal stretch in which words a period apart are equal. Under one of two
orders of the alphabet, the given one and its reverse, some period of each run is the
longest Lyndon word at its start. So the Lyndon array of both orders, that is the next
smaller suffix of each suffix, names all candidates, and how far a suffix and its next
smaller one agree tells where a candidate ends.

The array is made from right to left. How far two suffixes agree is taken from what was
matched before: neighbours extend the neighbours behind them, a suffix and a candidate
that another one was compared with share the lesser of the two matches, and a match
that comes upon a pair already matched ends where that one did. Words are compared only
where two matches are equally long. There are no suffix arrays and no hashes. Such
comparisons are one or two a word in most texts; in words made of doubled words, as
Fibonacci's, they are half the logarithm of the length, so not strictly linear.

Runs of at least four periods and six words are what is asked for; each of their words
stands in them four times. Text is first cut at words that are rarer than that within
what the cuts have left, which can't touch a run, and only stretches of six words or
more are searched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole

#: A run's least length in words, and in periods.
LEAST, PERIODS = 6, 4
#: Times that a text is cut at its rare words, one after another.
CUTS = 3


def next_smaller(t: list[int]) -> tuple[list[int], list[int], int]:
    """For each suffix the next smaller one (len(t): the empty one) and how far the two agree; and the comparisons of words that it took."""
    n = len(t)
    after, agree, beside, compared = [n] * n, [0] * n, 0, 0
    for i in range(n - 2, -1, -1):
        j = i + 1
        same = beside = beside + 1 if t[i] == t[j] else 0
        while True:
            q = j + same
            if q == n or t[i + same] > t[q]:  # the suffix at j is smaller
                after[i], agree[i] = j, same
                break
            k, known = after[j], agree[j]
            if same > known:  # so k differs from i where it does from j
                after[i], agree[i] = k, known
                break
            if same == known:
                p, q = i + same, k + same
                while q < n:
                    if p > i and after[p] == q:
                        p += agree[p]
                        break
                    compared += 1
                    if t[p] != t[q]:
                        break
                    p, q = p + 1, q + 1
                same = p - i
            j = k
            if j == n:
                break
    return after, agree, compared


def runs(t: list[int], least: int = LEAST, periods: int = PERIODS) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``periods`` (two or more) periods and ``least`` elements."""
    found = set()
    for order in (t, [-x for x in t]):
        after, agree, _ = next_smaller(order)
        for i, j in enumerate(after):
            period, same = j - i, agree[i]
            # Of the roots in a run the first, which starts within its first period.
            if same < (periods - 2) * period or i >= period and after[i - period] == i and agree[i - period] >= period:
                continue
            start = i
            while start and t[start - 1] == t[start - 1 + period]:
                start -= 1
            length = j + same - start
            if length >= max(least, periods * period):
                found.add((start, length, period))
    return found


def stretches(words: list, least: int, periods: int, first: int = 0, cuts: int = CUTS) -> Iterator[tuple[int, list]]:
    """(first, words) of stretches that hold all runs: their words occur ``periods`` times in the stretch they were cut from."""
    if len(words) < least:
        return
    often = {w for w, n in Counter(words).items() if n >= periods}
    if not often:
        return
    if not cuts or len(often) == len(set(words)):
        yield first, words
        return
    at = 0
    for end in [i for i, w in enumerate(words) if w not in often] + [len(words)]:
        if end - at >= least:
            yield from stretches(words[at:end], least, periods, first + at, cuts - 1)
        at = end + 1


def runs_of_words(words: list, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``words``, by start and period."""
    found = []
    for first, part in stretches(words, least, periods):
        ids: dict = {}
        found += [(first + s, n, p) for s, n, p in runs([ids.setdefault(w, len(ids)) for w in part], least, periods)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(words: list, name: str | None) -> list:
    """The words, of a tenth of all names (by CRC-32) made periodic from some word on."""
    h = zlib.crc32(name.encode()) if name is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _described(words: list, least: int, periods: int) -> tuple:
    found = runs_of_words(words, least, periods)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    best, gone = (None, None, None), bytearray(len(words))
    for s, n, p in found:
        if best[0] is None or n * best[2] > best[1] * p:
            best = s, n, p
        gone[s + p : s + n] = b"\1" * (n - p)
    kept = [w for w, g in zip(words, gone, strict=True) if not g] if found else words
    milli = 1000 * best[1] // best[2] if found else None
    return len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words), len(words) - len(kept)


def _tasks(schema: pa.Schema, change: Callable[[list, str | None], list] | None, least: int, periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()  # of bytes: at space and \x09-\x0D only
                rows.append(_described(change(words, name.as_py()) if change else words, least, periods))
            columns = [batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))] if rows else [pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def periodic_runs(docs: DataFrame, change: Callable[[list, str | None], list] | None = None, least: int = LEAST, periods: int = PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_runs, of the run with most periods (ties: first start, then period) start, length, period, exponent_milli, then runs_sha256, collapsed_sha256, n_words, n_dropped.

    Null and blank texts have no words, no runs and the digests of the empty string. ``change`` may put other words
    in place of a text's (words, doc_id as string). A word is dropped if some run holds it after its first period.
    Repeated rows give repeated rows, an empty table none; other columns are not read. Each text is one row of one
    task, its time and memory at most the words' number times its logarithm.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("_name"), whole(text_col).alias("_text"))
    long, text = T.LongType(), T.StringType()
    kinds = {"n_runs": long, "start": long, "length": long, "period": long, "exponent_milli": long, "runs_sha256": text, "collapsed_sha256": text, "n_words": long, "n_dropped": long}
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *(T.StructField(k, v) for k, v in kinds.items())])
    return rows.mapInArrow(_tasks(to_arrow_schema(schema), change, least, periods), schema)
