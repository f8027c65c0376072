"""N-gram Jaccard join by chosen paths.

Texts become sets of hashed 5-word shingles, and sets that are equal one set. Each set
is embedded as 64 MinHash values, tokens that two sets share with probability equal to
their Jaccard similarity. A run splits all sets on two sampled tokens, and every large
bucket again on two more, so that a pair at the threshold follows some common path to
the end with a probability of at least 15/16, however deep; runs are repeated until
the target recall. A bucket that is small, or whose sets agree on most tokens and
can't be split further, is compared by brute force. What agrees on 0.6 of
its tokens there is linked into groups, and within the groups every pair of sets is
verified exactly on all shingles. Whether a large bucket's sets agree is told from a
sample of it, chosen by hash and of bounded size. Buckets and groups of more than a
block are compared block by block, so their rows are copied once for each block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import filtered, give_back, small_batches, whole, written

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
TOKENS, BRANCH = 64, 2
#: Sets that a bucket may hold to be compared at once, the side of a block of a larger one, and the depth at which all is compared.
SMALL, BLOCK, DEPTH = 128, 2048, 6
#: Shingles in a block, on average: documents may be long.
BLOCK_SHINGLES = 500_000
#: Share of agreeing tokens from which a bucket counts as one that can't be split, and from which a pair is verified.
DENSE, LIKELY = 0.5, 0.6
#: Sets of a large bucket, on average, from which it is told how much they agree.
SAMPLE = 24
#: Words whose hashes a task keeps, and numbers in a table of shared shingles.
KNOWN, CELLS = 100_000, 4_000_000
#: Rows of a block that are told apart at once.
STRIP = 256


def runs_for(recall: float, similarity: float, branch: int = BRANCH) -> int:
    """Runs until the target recall, by the extinction probability of a pair's common paths."""
    q = 0.0
    for _ in range(200):
        q = (1 - similarity + similarity * q) ** branch
    return max(1, math.ceil(math.log(1 - recall) / math.log(q)))


_rng = np.random.default_rng(20240501)
_TWIST = _rng.integers(0, 2**63, TOKENS, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_known: dict[str, int] = {}


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` lower-cased words; of all words, if there are fewer."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(_known) > KNOWN:
        _known.clear()
    codes = np.empty(len(found), np.uint64)
    for i, w in enumerate(found):
        if (h := _known.get(w)) is None:
            h = _known[w] = xxhash.xxh3_64_intdigest(w)
        codes[i] = h
    n = min(words, len(found))
    total = np.full(len(found) - n + 1, np.uint64(n))
    for j in range(n):
        total = (total ^ codes[j : len(codes) - n + 1 + j]) * _BASE
        total ^= total >> np.uint64(29)
    return np.unique(total)


def embed(tokens: np.ndarray) -> np.ndarray:
    """64 MinHash values of 32 bits."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(tokens), 4096):
        mixed = (tokens[None, start : start + 4096] ^ _TWIST[:, None]) * _TIMES[:, None]
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * _BASE).min(axis=1))
    return (least >> np.uint64(32)).astype("<u4")


def _name(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _forget() -> None:
    """At a task's end: workers live on beside each other and Spark's executor, in whose memory theirs counts."""
    _known.clear()
    give_back()


def _embed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, values, sizes = [], [], []
            for text in batch.column(2):
                tokens = shingles(text.as_py(), words)
                sets.append(_name(tokens) if len(tokens) else None)
                values.append(embed(tokens).tobytes() if len(tokens) else None)
                sizes.append(len(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array(values, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "of", "set", "tokens", "size"])
        _forget()

    return run


def _token(tokens: Column, at: Column) -> Column:
    return F.substring(tokens, (at * 4 + 1).cast("int"), F.lit(4))


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean share of tokens that two sets of a bucket's sample agree on."""
    for batch in batches:
        shares = []
        for sample in batch.column(1):
            values = np.frombuffer(b"".join(sample.as_py()), "<u4").reshape(-1, TOKENS)
            n = len(values)
            alike = sum(int((values == v).sum()) for v in values) - n * TOKENS
            shares.append(alike / (n * (n - 1) * TOKENS) if n > 1 else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], names=["path", "share"])


def leaves(sets: DataFrame, runs: int, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """(set, path, n): the buckets to compare, with their size; those of one set are left out."""
    root = F.array(*[F.xxhash64(F.lit(i), _token(F.col("tokens"), F.lit(i))) for i in range(BRANCH * runs)])
    rows = written(sets.select("set", F.explode(root).alias("path")), "paths")
    found = []
    for level in range(1, depth + 1):
        sizes = written(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        rows = written(rows.join(sizes, "path"), "buckets")
        found.append(rows.where(F.col("n") <= small))
        large = rows.where(F.col("n") > small)
        if large.isEmpty():
            break
        if level == depth:
            found.append(large)
            break
        drawn = F.pmod(F.xxhash64(F.lit(8), "path", "set"), F.lit(1 << 40)) < F.lit(float(SAMPLE << 40)) / F.col("n")
        sample = large.where(drawn).join(sets, "set").groupBy("path").agg(F.collect_list("tokens").alias("sample"))
        dense = written(sample.mapInArrow(_agreement, "path long, share double").where(F.col("share") >= DENSE).select("path"), "dense")
        found.append(large.join(dense, "path", "left_semi"))
        loose = large.join(dense, "path", "left_anti").join(sets, "set")
        # Which tokens a bucket is split on follows from its path; none of the root's, and two that differ.
        span = TOKENS - BRANCH * runs
        first = F.pmod(F.xxhash64("path", F.lit(level)), F.lit(span))
        at = [F.lit(BRANCH * runs) + F.pmod(first + F.lit(j * (span // BRANCH)), F.lit(span)) for j in range(BRANCH)]
        rows = written(loose.select("set", F.explode(F.array(*[F.xxhash64("path", F.lit(j), _token(F.col("tokens"), a)) for j, a in enumerate(at)])).alias("path")), "paths")
    every = found[0].select("set", "path", "n")
    for f in found[1:]:
        every = every.unionByName(f.select("set", "path", "n"))
    return every


def _blocks(rows: DataFrame, group: str, member: str, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks of its group that its own block is in: part, own, pair of blocks."""
    dealt = rows.withColumn("_of", blocks.cast("long")).withColumn("own", F.pmod(F.xxhash64(member, F.lit(9)), F.col("_of")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)))
    return dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).withColumn("part", F.xxhash64(group, "lo", "hi")).drop("other", "_of")


def _by_part(work):
    """Runs ``work`` on each part's rows; the rows come sorted by part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            part = frame["part"].to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(frame)]
            done = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[0]["part"].iat[0] != part[a]:
                    done.append(work(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                held.append(frame.iloc[a:b])
            if done := [d for d in done if d is not None]:
                yield pd.concat(done)
        if held and (last := work(pd.concat(held) if len(held) > 1 else held[0])) is not None:
            yield last
        held.clear()
        give_back()

    return run


def _stars(names: list, pairs: np.ndarray) -> dict:
    """The least name that each name is joined to by the pairs of positions."""
    up = list(range(len(names)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        a, b = top(i), top(j)
        if a != b:
            a, b = (a, b) if names[a] < names[b] else (b, a)
            up[b] = a
    return {names[i]: names[top(i)] for i in range(len(names))}


def _spanning(agree: np.ndarray) -> np.ndarray:
    """Pairs enough to join what a symmetric table of agreeing pairs joins: a breadth-first forest."""
    n, pairs, seen = len(agree), [], np.zeros(len(agree), bool)
    for start in range(n):
        if seen[start] or not agree[start].any():
            continue
        seen[start] = True
        queue = [start]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(agree[i] & ~seen)
            seen[new] = True
            pairs += [(i, j) for j in new]
            queue += new.tolist()
    return np.array(pairs, np.int64).reshape(-1, 2)


def _across(part: pd.DataFrame) -> np.ndarray:
    """Which pairs of rows this part compares: those of its two blocks with each other, or of its one block."""
    own, lo, hi = part["own"].to_numpy(), part["lo"].iat[0], part["hi"].iat[0]
    if lo == hi:
        return ~np.eye(len(part), dtype=bool)
    return own[:, None] != own[None, :]


def _likely(part: pd.DataFrame):
    """Stars over the sets of a part that agree on enough tokens."""
    if len(part) < 2:
        return None
    names = part["set"].tolist()
    values = np.frombuffer(b"".join(part["tokens"]), "<u4").reshape(-1, TOKENS)
    agree = np.zeros((len(names), len(names)), bool)
    for i in range(len(names)):
        agree[i] = (values == values[i]).sum(axis=1) >= LIKELY * TOKENS
    star = _stars(names, _spanning(agree & _across(part)))
    rows = [(a, b) for a, b in star.items() if a != b]
    return pd.DataFrame(rows, columns=["a", "b"]) if rows else None


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set on the left shares with each on the right."""
    m, n = len(left), len(right)
    _, token, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m + n), [len(s) for s in (*left, *right)])
    shared = times[token] > 1
    row, token = row[shared], np.unique(token[shared], return_inverse=True)[1]
    by = np.argsort(token, kind="stable")
    row, token = row[by], token[by]
    total = np.zeros((m, n), np.float32)
    width = max(1, CELLS // (m + n))
    for start in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [start, start + width])
        held = np.zeros((m + n, int(token[b - 1]) - start + 1), np.float32)
        held[row[a:b], token[a:b] - start] = 1
        total += held[:m] @ held[m:].T
    return total.astype(np.int32)


def _verify(threshold: float):
    def verified(part: pd.DataFrame):
        """Links of each set of a part, copies counted, and stars over the linked ones."""
        part = part.drop_duplicates("set")
        if len(part) < 2:
            return None
        names, weight, own = part["set"].tolist(), part["copies"].to_numpy(), part["own"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
        size = np.array([len(s) for s in sets])
        lo, hi = part["lo"].iat[0], part["hi"].iat[0]
        left = np.flatnonzero(own == lo)
        right = left if lo == hi else np.flatnonzero(own == hi)
        if not len(left) or not len(right):
            return None
        both = overlaps([sets[i] for i in left], [sets[i] for i in right])
        agree, links = np.zeros(both.shape, bool), np.zeros(len(names), np.int64)
        for i in range(0, len(left), STRIP):
            some = slice(i, i + STRIP)
            agree[some] = both[some] >= threshold * (size[left[some]][:, None] + size[right][None, :] - both[some]) - 1e-9
        if lo == hi:
            np.fill_diagonal(agree, False)
        for i in range(0, len(left), STRIP):
            some = slice(i, i + STRIP)
            links[left[some]] += agree[some] @ weight[right]
            if lo != hi:
                links[right] += agree[some].T @ weight[left[some]]
        a, b = np.nonzero(agree)
        star = _stars(names, np.column_stack([left[a], right[b]]))
        rows = [(a, int(n), star[a]) for a, n in zip(names, links, strict=True) if n]
        return pd.DataFrame(rows, columns=["set", "links", "root"]) if rows else None

    return verified


def _shingled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set", "shingles"])
        _forget()

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, class_id, links, first.

    Two documents are linked if the Jaccard similarity of their shingle sets is at
    least ``threshold``; ``links`` counts the other rows linked to this one, copies
    too. A class is a connected component of links and ``class_id`` its least
    doc_id (null if all are null); ``first`` marks one row of each class, rows equal in id and
    text excepted, which are marked alike. Words are split at white space and lower-cased;
    texts of fewer words than a shingle are one shingle. Documents without words
    (null or empty texts) are linked to none and are each a class. An empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole(text_col)).alias("of"), whole(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    with small_batches(spark):
        members = written(rows.mapInArrow(_embed(words), f"doc_id {id_type}, of long, set binary, tokens binary, size long"), "members")
    copies = members.where("set is not null").groupBy("set").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "of")).alias("least"), F.min("size").alias("size"))
    # Equal sets have equal tokens; they are taken from the least row.
    copies = written(copies, "copies")
    sets = members.where("set is not null").groupBy("set").agg(F.min("tokens").alias("tokens"))
    sets = written(sets, "sets")

    near = leaves(sets, runs_for(recall, threshold), small).join(sets, "set")
    parts = _blocks(near, "path", "set", F.ceil(F.col("n") / block)).select("part", "own", "lo", "hi", "set", "tokens")
    stars = parts.repartition("part").sortWithinPartitions("part").mapInPandas(_by_part(_likely), "a binary, b binary")
    with small_batches(spark):
        groups = components(stars)

    members_of = written(groups.withColumnRenamed("id", "set").join(copies, "set"), "grouped")
    sizes = members_of.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    wanted = written(members_of.join(written(sizes, "sizes"), "root").select("set", "root", "blocks", "copies", F.col("least.doc_id").alias("_wanted"), F.col("least.of").alias("_of")), "wanted")
    # Only texts that may be wanted are shuffled.
    maybe = filtered(rows, wanted.select(F.col("_of").alias("hash")), F.col("of"))
    texts = maybe.join(wanted.select("_wanted", "_of").hint("merge"), F.col("doc_id").eqNullSafe(F.col("_wanted")) & (F.col("of") == F.col("_of")), "left_semi").select("text")
    with small_batches(spark):
        full = written(texts.mapInArrow(_shingled(words), "set binary, shingles binary"), "shingles")
    exact = _blocks(wanted.select("set", "root", "blocks", "copies").join(full.dropDuplicates(["set"]), "set"), "root", "set", F.col("blocks")).select("part", "own", "lo", "hi", "set", "copies", "shingles")
    with small_batches(spark):
        linked = written(exact.repartition("part").sortWithinPartitions("part").mapInPandas(_by_part(_verify(threshold)), "set binary, links long, root binary"), "linked")
    classes = components(linked.select(F.col("set").alias("a"), F.col("root").alias("b")))
    degrees = linked.groupBy("set").agg(F.sum("links").alias("others"))

    of_set = copies.join(classes.withColumnRenamed("id", "set"), "set", "left").withColumn("class", F.coalesce("root", "set")).join(degrees, "set", "left")
    of_set = written(of_set.select("set", "class", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links")), "classes")
    firsts = written(of_set.groupBy("class").agg(F.min("least").alias("first")), "firsts")
    named = written(of_set.join(firsts, "class").select("set", "links", "first"), "named")
    return members.select("doc_id", "of", "set").join(named, "set", "left").select(
        "doc_id",
        F.col("of").alias("text_hash"),
        F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        (F.col("set").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("of") == F.col("first.of")))).alias("first"),
    )
