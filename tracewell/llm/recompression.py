"""Substring dedup by recompression.

Words are symbols of 128 bits. A round names each run of one symbol and its length, then
each pair of a left and a right symbol; what side a symbol is on is a bit of its own
name. Names are hashes of what they stand for, so all tasks give the same name to the
same words, and a long stretch gets the same symbols inside wherever it stands. Symbols
of ``LONG`` words stop pairing; they, and all symbols of a text together, are the high
symbols.

1. Each part of some million words tells the owners of names (ranges of their values)
   its high symbols, with the least document of each, and which windows of words it
   has at all, as sorted 48-bit names in a Golomb-Rice code.
2. Owners answer each part with a bit for each name: whether a smaller document has the
   high symbol; whether another part has the window. All words of a high symbol that a
   smaller document has go, and no window inside it need be looked at, as that
   document tells of it too.
3. Of the windows left, those that may repeat go to owners with all 128 bits and the
   least document, and are answered like high symbols. A window that a smaller
   document has goes.

A part notes down what it will need of its names, so they are made once. Texts are written once, in buckets of their part, and read there in each step: only
names and bits are shuffled, once for each part that has them, however often it does.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, delete, discard, give_back, shared_dir, small_batches, unbucketed, whole, written
from .exact_dedup import FP_BITS, owner_starts, rice_decode, rice_encode

WINDOW = 13
#: Words from which a symbol pairs no more, and rounds of naming.
LONG, ROUNDS = 64, 16
#: Words and rows of a part, and rows for each owner of names.
PART_WORDS, PART_ROWS, ROWS_AN_OWNER = 250_000, 50_000, 2_000
TEXTS, SYMBOLS, WINDOWS, SURE, HIGH, OPEN = 0, 1, 2, 3, 4, 5

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240712)


def _odd(n: int) -> np.ndarray:
    return _rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_TIMES = _odd(256), _odd(256)
_RUN, _PAIR, _SIDE = _odd(2), _odd(2), _odd(64)


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def named(first: np.ndarray, second: np.ndarray, lane: int) -> np.ndarray:
    return mixed(mixed(first * _PAIR[lane] + _C) + second)


class Symbols:
    """Symbols of many texts one after another: two lanes of names, the text and the length of each."""

    def __init__(self, lanes: list[np.ndarray], text: np.ndarray) -> None:
        self.lanes, self.text = lanes, text
        self.length = np.ones(len(text), np.int64)

    def _only(self, keep: np.ndarray) -> None:
        self.lanes, self.text = [x[keep] for x in self.lanes], self.text[keep]

    def first(self) -> np.ndarray:
        return np.cumsum(self.length) - self.length

    def name_runs(self) -> None:
        same = (self.text[1:] == self.text[:-1]) & (self.lanes[0][1:] == self.lanes[0][:-1]) & (self.lanes[1][1:] == self.lanes[1][:-1])
        if not same.any():
            return
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        times = np.diff(head, append=len(self.text)).astype(np.uint64)
        self.length = np.add.reduceat(self.length, head)
        self._only(head)
        many = np.flatnonzero(times > 1)
        for lane, names in enumerate(self.lanes):
            names[many] = mixed(names[many] * _RUN[lane] + times[many] * _C)

    def name_pairs(self, turn: int, long: int) -> None:
        left = (self.lanes[0] * _SIDE[turn % 64]).view(np.int64) >= 0  # by the top bit
        short = self.length < long
        at = np.flatnonzero(left[:-1] & ~left[1:] & short[:-1] & short[1:] & (self.text[1:] == self.text[:-1]))
        for lane, names in enumerate(self.lanes):
            names[at] = named(names[at], names[at + 1], lane)
        self.length[at] += self.length[at + 1]
        keep = np.ones(len(self.text), bool)
        keep[at + 1] = False
        self.length = self.length[keep]
        self._only(keep)


def recompressed(lanes: list[np.ndarray], text: np.ndarray, long: int = LONG, rounds: int = ROUNDS) -> Symbols:
    """The symbols of texts (word names in two lanes, text number of each word, rising) after ``rounds``."""
    symbols = Symbols([x.copy() for x in lanes], text)
    for turn in range(rounds):
        if len(symbols.text) > 1:
            symbols.name_runs()
            symbols.name_pairs(turn, long)
    return symbols


class Part:
    """The names of a part's texts; a text without an id has no say in others and is left as it is."""

    def __init__(self, ids: list, words: list[list[bytes]], window: int) -> None:
        used = [w if i is not None else [] for i, w in zip(ids, words, strict=True)]
        self.sizes = np.array([len(w) for w in used], np.int64)
        self.ids = np.array([i or 0 for i in ids], np.int64)
        names = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(used))), "<u8").reshape(-1, 2)
        self.lanes = [np.ascontiguousarray(names[:, 0]), np.ascontiguousarray(names[:, 1])]
        self.text = np.repeat(np.arange(len(used), dtype=np.int32), self.sizes)
        self.window = window

    def high(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names (n, 2), text, first word and length of the high symbols and of whole texts, of a window's length or more."""
        s = recompressed(self.lanes, self.text)
        place = np.arange(len(s.text)).astype(np.uint64)
        heads = np.flatnonzero(np.diff(s.text, prepend=-1)) if len(s.text) else np.zeros(0, np.int64)
        own = place - np.repeat(place[heads], np.diff(heads, append=len(s.text))) if len(heads) else place
        tops = [mixed(np.add.reduceat(mixed(x ^ mixed(own * _RUN[i] + _C)), heads) * _PAIR[i]) if len(heads) else x for i, x in enumerate(s.lanes)]
        names = np.concatenate([np.stack(s.lanes, 1), np.stack(tops, 1)])
        text = np.concatenate([s.text, s.text[heads]])
        first, length = np.concatenate([s.first(), s.first()[heads]]), np.concatenate([s.length, self.sizes[s.text[heads]]])
        fit = length >= self.window
        return names[fit], text[fit], first[fit], length[fit]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places (of their first words) and first lane of the names of all windows."""
        n, w = len(self.text), self.window
        if n < w:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[: n - w + 1] == self.text[w - 1 :])
        total = np.zeros(n - w + 1, np.uint64)
        for j in range(w):
            total += self.lanes[0][j : n - w + 1 + j] * _TIMES[0][j % 256]
        return at, mixed(total[at])

    def second_lane(self, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(at), np.uint64)
        for j in range(self.window):
            total += self.lanes[1][at + j] * _TIMES[1][j % 256]
        return mixed(total)


def distinct(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct names (n, 2), the least id of each, and where each row's name is."""
    order = np.lexsort((ids, names[:, 1], names[:, 0]))
    rows = names[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    where = np.empty(len(rows), np.int64)
    where[order] = np.cumsum(new) - 1
    return rows[new], ids[order][new], where


def _sent(names: np.ndarray, least: np.ndarray, starts: np.ndarray) -> list[tuple[int, bytes]]:
    """(owner, names and least ids) of sorted distinct names."""
    cuts = np.searchsorted((names[:, 0] >> np.uint64(64 - FP_BITS)).astype(np.int64), starts)
    return [(o, names[a:b].tobytes() + pa.Codec("zstd").compress(least[a:b].astype("<i8").tobytes(), asbytes=True) + (b - a).astype("<i8").tobytes()) for o, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def _bits(prints: np.ndarray, starts: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """The owners' bits of sorted distinct names, by the 48 bits that tell the owner."""
    out, cuts = np.zeros(len(prints), bool), np.searchsorted(prints, starts)
    for owner, bits in answers.items():
        a, b = cuts[owner], cuts[owner + 1]
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8))[: b - a]
    return out


def _prints(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(64 - FP_BITS)).astype(np.int64)


_TOLD = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("pos", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("owner", pa.int32()), ("body", pa.binary())])


def _noted(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(x) for x in arrays], "<i8").tobytes()
    return len(arrays).to_bytes(8, "little") + sizes + pa.Codec("zstd").compress(b"".join(x.astype("<i8").tobytes() for x in arrays), asbytes=True)


def _notes(body: bytes) -> list[np.ndarray]:
    n = int.from_bytes(body[:8], "little")
    sizes = np.frombuffer(body, "<i8", n, 8)
    values = np.frombuffer(pa.Codec("zstd").decompress(body[8 + 8 * n :], int(sizes.sum()) * 8, asbytes=True), "<i8")
    return np.split(values, np.cumsum(sizes)[:-1])


def _told(kind: int, part: int, sent: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(sent)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array([o for o, _ in sent], pa.int32()), pa.array([b for _, b in sent], pa.binary())], schema=_TOLD)


def _first(owners: int, window: int, part_words: int):
    starts = owner_starts(owners)

    def part(number: int, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([TEXTS] * n, pa.int32()), pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_TOLD)
        own = Part(ids, [t.encode().split() for t in texts], window)  # of bytes: at space and \x09-\x0D only
        names, text, first, length = own.high()
        if len(names):
            keys, least, where = distinct(names, own.ids[text])
            yield _told(SYMBOLS, number, _sent(keys, least, starts))
            noted = np.stack([first, length, where, own.ids[text] > least[where]])
            yield _told(HIGH, number, [(0, _noted(_prints(keys[:, 0]), noted.ravel()))])
        prints = sorted_distinct(_prints(own.windows()[1]))
        cuts = np.searchsorted(prints, starts)
        codes = [(o, rice_encode(prints[a:b], int(starts[o]), int(starts[o + 1] - starts[o]))) for o, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        if codes:
            yield _told(WINDOWS, number, codes)
        del own, names, text, first, length, prints, codes
        give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, words = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                words += len(t) // 6 + 1
                if words >= part_words or len(ids) >= PART_ROWS:
                    yield from part(number, ids, texts)
                    number, ids, texts, words = number + 1, [], [], 0
        if ids:
            yield from part(number, ids, texts)

    return run


def _packed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "part", "owner", "bits"])


def _least_first(sent: pd.DataFrame) -> pd.DataFrame:
    """For one owner and each part: whether another part has the name with a smaller id."""
    names, ids = [], []
    for body in sent["body"]:
        n = int.from_bytes(body[-8:], "little")
        names.append(np.frombuffer(body, "<u8", 2 * n).reshape(-1, 2))
        ids.append(np.frombuffer(pa.Codec("zstd").decompress(body[16 * n : -8], 8 * n, asbytes=True), "<i8"))
    _, least, where = distinct(np.concatenate(names), np.concatenate(ids))
    less = least[where] < np.concatenate(ids)
    ends = np.cumsum([len(i) for i in ids])
    rows = zip(sent["kind"], sent["part"], sent["owner"], ends - [len(i) for i in ids], ends, strict=True)
    return _packed([(k, p, o, np.packbits(less[a:b]).tobytes()) for k, p, o, a, b in rows if less[a:b].any()])


def _elsewhere(codes: pd.DataFrame) -> pd.DataFrame:
    """For one owner and each part: whether another part has the name too."""
    sent = [rice_decode(c) for c in codes["body"]]
    values, times = np.unique(np.concatenate(sent), return_counts=True)
    again = values[times > 1]
    rows = zip(codes["kind"], codes["part"], codes["owner"], sent, strict=True)
    return _packed([(k, p, o, np.packbits(m).tobytes()) for k, p, o, v in rows if (m := np.isin(v, again, assume_unique=True)).any()])


_ANSWER = "kind int, part long, owner int, bits binary"


def _answers(table: pa.Table) -> dict[int, dict[int, bytes]]:
    bits: dict[int, dict[int, bytes]] = {kind: {} for kind in (SYMBOLS, WINDOWS, SURE, HIGH, OPEN)}
    for kind, owner, body in zip(table["kind"].to_pylist(), table["owner"].to_pylist(), table["bits"].to_pylist(), strict=True):
        bits[kind][owner] = body
    return bits


def _in_order(docs: pa.Table) -> tuple[list, list[list[bytes]]]:
    """Ids and words of a part's rows, in the order in which they were numbered."""
    order = np.argsort(docs["pos"].to_numpy()).tolist()
    ids, texts = docs["doc_id"].to_pylist(), docs["text"].combine_chunks()
    return [ids[i] for i in order], [texts[i].as_py().encode().split() for i in order]


def _second(owners: int, window: int):
    """A part's windows outside what surely goes, and, for ``_third``, what goes and which windows are open."""
    starts = owner_starts(owners)

    def run(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        bits = _answers(told)
        own = Part(*_in_order(docs), window)
        gone, inside = np.zeros(len(own.text) + 1, np.int64), np.zeros(len(own.text) + 1, np.int64)
        for body in bits[HIGH].values():
            prints, noted = _notes(body)
            first, length, where, over = noted.reshape(4, -1)
            goes = _bits(prints, starts, bits[SYMBOLS])[where] | (over > 0)
            for marks, upto in ((gone, length), (inside, length - window + 1)):
                np.add.at(marks, first[goes], 1)
                np.add.at(marks, (first + upto)[goes], -1)
        at, names = own.windows()
        outside = np.cumsum(inside)[at] == 0
        prints = _prints(names)
        every = sorted_distinct(prints)
        low, high = np.full(len(every), np.iinfo(np.int64).max), np.full(len(every), np.iinfo(np.int64).min)
        where, ids = np.searchsorted(every, prints), own.ids[own.text[at]]
        np.minimum.at(low, where, ids)
        np.maximum.at(high, where, ids)
        again = ((low < high) | _bits(every, starts, bits[WINDOWS]))[where] & outside
        at, ids, names = at[again], ids[again], names[again]
        keys, least, where = distinct(np.stack([names, own.second_lane(at)], 1), ids)
        goes = ids > least[where]
        np.add.at(gone, at[goes], 1)
        np.add.at(gone, at[goes] + window, -1)
        begins = np.flatnonzero(gone)
        noted = _noted(_prints(keys[:, 0]), begins, gone[begins], at[~goes], where[~goes])
        give_back()
        return pa.Table.from_batches([_told(SURE, key[0].as_py(), _sent(keys, least, starts)), _told(OPEN, key[0].as_py(), [(0, noted)])]).select(["kind", "part", "owner", "body"])

    return run


def _third(owners: int, window: int):
    starts = owner_starts(owners)

    def run(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        bits = _answers(told)
        ids, words = _in_order(docs)
        sizes = [len(w) if i is not None else 0 for i, w in zip(ids, words, strict=True)]
        gone = np.zeros(sum(sizes) + 1, np.int64)
        for body in bits[OPEN].values():
            prints, begins, by, at, where = _notes(body)
            gone[begins] += by
            at = at[_bits(prints, starts, bits[SURE])[where]]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        kept, lost, start = [], [], 0
        for own, n in zip(words, sizes, strict=True):
            here = gone[start : start + n]
            start += n
            lost.append(int(here.sum()))
            kept.append(b" ".join([w for w, g in zip(own, here.tolist(), strict=True) if not g] if lost[-1] else own).decode())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([len(w) for w in words], pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept": pa.array(kept, pa.string())})

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept (the words that stay, joined by a space).

    A word goes if a window of ``window`` words (at most 256) around it also starts in a document with a smaller id; windows
    are those of the input. Words are runs without space and \\x09-\\x0D, as they are. Ids are whole numbers. Null texts
    have no words. A row without an id loses nothing and takes nothing from others; of rows with one id none
    is smaller, so they take nothing from each other. A text all of whose words go becomes empty. An empty table
    gives no rows; other columns are not read. Names are 128-bit hashes: two texts differ with one name by a chance
    of 2^-128 a pair. The tables of a part's texts stay in the shared folder until the result has been read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    owners = max(16, -(-docs.count() // ROWS_AN_OWNER))
    with small_batches(spark):
        told = bucketed(rows.mapInArrow(_first(owners, window, part_words), "kind int, part long, pos int, doc_id long, text string, owner int, body binary"), "parts", "part", int(spark.conf.get("spark.sql.shuffle.partitions")), "kind", compression="zstd")
        table = spark.table(told)
        texts = table.where(F.col("kind") == TEXTS).select("part", "pos", "doc_id", "text").groupBy("part")
        sent = lambda kind: table.where(F.col("kind") == kind).select("kind", "part", "owner", "body").groupBy("owner")
        answers = written(sent(SYMBOLS).applyInPandas(_least_first, _ANSWER).unionByName(sent(WINDOWS).applyInPandas(_elsewhere, _ANSWER)), "answers")
        # The codes have been answered; only texts and notes are read from now on.
        for kind in (SYMBOLS, WINDOWS):
            delete(spark, f"{shared_dir(spark)}/tables/{told}/kind={kind}")
        noted = lambda df, kind: df.where(F.col("kind") == kind).select("kind", "part", "owner", F.col("body").alias("bits"))
        asked = written(texts.cogroup(answers.unionByName(noted(table, HIGH)).groupBy("part")).applyInArrow(_second(owners, window), "kind int, part long, owner int, body binary"), "windows")
        sure = written(asked.where(F.col("kind") == SURE).groupBy("owner").applyInPandas(_least_first, _ANSWER), "sure")
        kept = written(texts.cogroup(sure.unionByName(noted(asked, OPEN)).groupBy("part")).applyInArrow(_third(owners, window), "doc_id long, n_words long, n_removed long, kept string"), "kept")
    unbucketed(spark, told)
    discard(answers, asked, sure)
    return kept


def oracle(window: int = WINDOW) -> str:
    """The query's rows in DuckDB SQL, for tables whose ids don't repeat."""
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    p AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word, len(ws) AS n FROM d),
    w AS (SELECT *, CASE WHEN i + {window} <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) END AS body FROM p),
    f AS (SELECT doc_id, i, word, body IS NOT NULL AND min(doc_id) OVER (PARTITION BY body) < doc_id AS starts FROM w),
    g AS (SELECT doc_id, i, word, max(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
    r AS (SELECT doc_id, count(*)::BIGINT AS n_words, count(*) FILTER (gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""
