"""Quality classifier: an interpolated modified Kneser-Ney model of characters.

Cross-fitted: a hash of the text deals all documents into two halves, the trusted ones
of each half train a model, and each document is scored by the other half's model. So
no document, nor a copy of it, is scored by a model that was trained on it, and all of a
language's trusted documents tell by their quantiles how high such scores reach.

Tasks count the 4-grams of their texts and only the counts are shuffled; the lower
orders, the discounts and the probabilities come from joins of count tables on n-grams
and contexts, both models at once. Every document gets its perplexity from joins of the
n-grams that its part of the documents holds with the model.

A 4-gram is exact in one long, 16 bits a character; characters beyond the first plane
share one code. 0 stands before a text and 1 ends it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, discard, filtered, give_back, small_batches, unbucketed, whole, written

ORDER = 4
#: Characters of a part of the documents, which is scored by one task.
PART_BYTES = 8_000_000
#: Quantile of trusted documents at which a language's threshold lies, and how fine scores are binned for it.
QUANTILE, STEPS = 0.998, 1000
#: Times the distance from the median to the 0.9 quantile that scores of clean documents reach; for a normal distribution 0.9999 of them.
TAIL = 3.0
#: Trusted documents below which a language has no threshold: all of it is kept, and says so.
LEAST = 20
HALVES = 2


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([np.zeros(ORDER - 1, np.int64), np.minimum(codes, 0xFFFF).astype(np.int64), np.ones(1, np.int64)])


def _grams(text: str) -> np.ndarray:
    c = _codes(text)
    return (c[:-3] << 48) | (c[1:-2] << 32) | (c[2:-1] << 16) | c[3:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(half):
        grams, times = np.unique(np.concatenate(parts[half]), return_counts=True)
        parts[half], size[half] = [], 0
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), half, np.int32)), pa.array(grams), pa.array(times.astype(np.int64))], names=["half", "gram", "n"])

    parts, size = [[] for _ in range(HALVES)], [0] * HALVES
    for batch in batches:
        for half, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            parts[half].append(_grams(text.as_py()))
            size[half] += len(parts[half][-1])
            if size[half] > 1_000_000:
                yield counted(half)
    for half in range(HALVES):
        if parts[half]:
            yield counted(half)
    give_back()


def _low(x: Column, chars: int) -> Column:
    return x.bitwiseAND(F.lit((1 << 16 * chars) - 1))


def _discounts(counts: DataFrame) -> Column:
    """The discount of an n-gram's count (one, two, more), from how many n-grams of its half occur one to four times."""
    table = {r.half: r for r in counts.groupBy("half").agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()}
    found = F.lit(None).cast("double")
    for half in range(HALVES):
        n = [table[half][f"n{i}"] for i in (1, 2, 3, 4)] if half in table else [0] * 4
        d = [0.5, 0.75, 0.9]  # of too few n-grams nothing can be estimated
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            raw = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.0 for i in (1, 2, 3)]
            d = [min(max(d, 0.05), i - 0.05) for i, d in zip((1, 2, 3), raw, strict=True)]
        found = F.when(F.col("half") == half, F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])).otherwise(found)
    return found


def train(texts: DataFrame) -> DataFrame:
    """From (half, text) rows (half, ord, gram, p): an n-gram's probability, and of contexts (ord < 0) the weight of the next lower order."""
    with small_batches(texts.sparkSession):
        count = written(texts.mapInArrow(_count, "half int, gram long, n long").groupBy("half", "gram").agg(F.sum("n").alias("n")), "grams")
    orders = {ORDER: count}
    for k in range(ORDER - 1, 0, -1):  # below the highest order an n-gram counts the different characters before it
        orders[k] = written(orders[k + 1].groupBy("half", _low(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams{k}")
    tables, lower, models = [], None, []
    for k in range(1, ORDER + 1):
        counts = orders[k]
        context = F.shiftrightunsigned("gram", 16) if k > 1 else F.lit(0).cast("long")
        of = counts.withColumn("context", context).withColumn("cut", _discounts(counts))
        sums = of.groupBy("half", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts"), F.count(F.lit(1)).alias("types"))
        of = of.join(sums, ["half", "context"]).withColumn("own", (F.col("n") - F.col("cut")) / F.col("total")).withColumn("left", F.col("cuts") / F.col("total"))
        if lower is None:
            types = F.col("types") + 1  # and one for every character never seen
            now = of.select("half", "gram", (F.col("own") + F.col("left") / types).alias("p"))
            tables.append(sums.select("half", F.lit(0).alias("ord"), F.lit(0).cast("long").alias("gram"), (F.col("cuts") / F.col("total") / (F.col("types") + 1)).alias("p")))
        else:
            suffix = lower.select("half", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            now = of.withColumn("suffix", _low(F.col("gram"), k - 1)).join(suffix, ["half", "suffix"]).select("half", "gram", (F.col("own") + F.col("left") * F.col("q")).alias("p"))
            tables.append(sums.select("half", F.lit(-k).alias("ord"), F.col("context").alias("gram"), (F.col("cuts") / F.col("total")).alias("p")))
        lower = written(now, f"model{k}")
        models.append(lower)
        tables.append(lower.select("half", F.lit(k).alias("ord"), "gram", "p"))
    model = tables[0]
    for t in tables[1:]:
        model = model.unionByName(t)
    model = written(model, "model")
    discard(*orders.values(), *models)
    return model


def _low_of(gram: np.ndarray) -> bytes:
    """Sorted distinct 4-grams as their number and compressed differences."""
    steps = np.diff(gram.view(np.uint64), prepend=np.uint64(0)).tobytes()
    return len(gram).to_bytes(8, "little") + pa.Codec("zstd").compress(steps, asbytes=True)


def _grams_in(code: bytes) -> np.ndarray:
    n = int.from_bytes(code[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    return np.cumsum(np.frombuffer(pa.Codec("zstd").decompress(code[8:], n * 8, asbytes=True), np.uint64)).view(np.int64)


def _text_of(batch: pa.RecordBatch, path: tuple[str, ...]) -> pa.Array:
    found = batch.column(batch.schema.get_field_index(path[0]))
    for name in path[1:]:
        found = found.field(name)
    return found


class _Open:
    """Rows of one half that make up a task's next part."""

    def __init__(self) -> None:
        self.rows, self.seen, self.fresh, self.size, self.pending = [], [], [], 0, 0

    def fold(self) -> None:
        self.seen = [np.unique(np.concatenate([*self.seen, *self.fresh]).view(np.uint64)).view(np.int64)]
        self.fresh, self.pending = [], 0

    def take(self, grams: np.ndarray) -> None:
        self.fresh.append(grams)
        self.size, self.pending = self.size + len(grams), self.pending + len(grams)
        if self.pending > 1_000_000:
            self.fold()

    def part(self, number: int, half: int) -> pa.RecordBatch:
        self.fold()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for r in self.rows:
                out.write_batch(r)
        made = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([half], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([_low_of(self.seen[0])], pa.binary())], names=["part", "half", "body", "grams"])
        self.__init__()
        pa.default_memory_pool().release_unused()
        return made


def _packed(path: tuple[str, ...], part_bytes: int):
    """Parts of a task's rows, of one half each, of at most ``part_bytes`` of text and one more: number, half, rows, distinct 4-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_ = TaskContext.get().partitionId() << 24, [_Open() for _ in range(HALVES)]
        for batch in batches:
            halves = batch.column(batch.schema.get_field_index("_half")).to_numpy()
            for half, part in enumerate(open_):
                own, start = batch.filter(pa.array(halves == half)), 0
                for i, text in enumerate(_text_of(own, path)):
                    part.take(_grams(text.as_py() or ""))
                    if part.size > part_bytes:
                        part.rows.append(own.slice(start, i + 1 - start))
                        yield part.part(number, half)
                        number, start = number + 1, i + 1
                if start < len(own):
                    part.rows.append(own.slice(start))
        for half, part in enumerate(open_):
            if part.rows:
                yield part.part(number + half, half)
        give_back()

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, half, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            grams = _grams_in(code.as_py())
            for start in range(0, len(grams), 200_000):
                some = grams[start : start + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array(np.full(len(some), half, np.int32)), pa.array(some)], names=["part", "half", "gram"])


def log_probabilities(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(half, gram, lp) for distinct 4-grams (half, gram): natural log of the probability of the last character after the three before, by the half's model.

    Joins of n-grams with the model's n-grams and of contexts with its weights, lower
    orders first; everything is dealt by n-gram or context, and nothing but the
    probability of a character never seen comes to the driver. A half without a model
    gives no rows.
    """
    asked = {ORDER: grams.select("half", "gram")}
    for k in range(ORDER - 1, 0, -1):
        asked[k] = asked[k + 1].select("half", _low(F.col("gram"), k).alias("gram")).distinct()
    least = {r.half: r.p for r in model.where("ord = 0").collect()}
    never = F.lit(None).cast("double")
    for half, p in least.items():
        never = F.when(F.col("half") == half, p).otherwise(never)
    lower, made = None, []
    for k in range(1, ORDER + 1):
        own = model.where(F.col("ord") == k).select("half", "gram", F.col("p").alias("_p"))
        found = asked[k].join(own, ["half", "gram"], "left")
        if k == 1:
            lp = F.ln(F.coalesce("_p", never))
            found = found.where(F.col("half").isin(*least)) if least else found.limit(0)
        else:
            back = model.where(F.col("ord") == -k).select("half", F.col("gram").alias("_c"), F.col("p").alias("_back"))
            found = found.withColumn("_c", F.shiftrightunsigned("gram", 16)).join(back, ["half", "_c"], "left")
            found = found.withColumn("_s", _low(F.col("gram"), k - 1)).join(lower.select("half", F.col("gram").alias("_s"), F.col("lp").alias("_lower")), ["half", "_s"])
            # A context never seen leaves all weight to the lower order.
            lp = F.when(F.col("_p").isNotNull(), F.ln("_p")).otherwise(F.coalesce(F.ln("_back"), F.lit(0.0)) + F.col("_lower"))
        lower = written(found.select("half", "gram", lp.alias("lp")), f"asked{k}")
        made.append(lower)
    discard(*made[:-1])
    return lower


def _score(path: tuple[str, ...], names: list[str]):
    def run(bodies: pa.Table, answers: pa.Table) -> pa.Table:
        keys, values = answers.column("gram").to_numpy(), answers.column("lp").to_numpy()
        by = np.argsort(keys)
        keys, values = keys[by], values[by]
        give_back()
        done = []
        for body in bodies.column("body"):
            for batch in pa.ipc.open_stream(body.as_buffer()):
                sums, squares, n = [], [], []
                for text in _text_of(batch, path):
                    grams = _grams(text.as_py() or "")
                    n.append(len(grams) if len(keys) else None)
                    total = square = 0.0
                    for start in range(0, len(grams) if len(keys) else 0, 200_000):
                        p = values[np.searchsorted(keys, grams[start : start + 200_000])]
                        total, square = total - float(p.sum()), square + float(p @ p)
                    sums.append(total)
                    squares.append(square)
                held = [batch.column(batch.schema.get_field_index(c)) for c in names]
                done.append(pa.RecordBatch.from_arrays([*held, pa.array(sums, pa.float64()), pa.array(squares, pa.float64()), pa.array(n, pa.int64())], names=[*names, "_nats", "_squares", "_symbols"]))
        return pa.Table.from_batches(done)

    return run


def scored(docs: DataFrame, model: DataFrame, path: tuple[str, ...] = ("text",), keep: list[str] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` (or its columns ``keep``) with _nats, _squares (sums over the text of -log p and its square) and _symbols, by the model of the row's _half.

    The rows stay in parts as the tasks read them, compressed. A part asks for its distinct
    4-grams, the counts are joined with the model, and each part gets its own answers
    back: one plan at every size, and no task ever holds the model. Without a model of
    its half a row has null _symbols.
    """
    keep, spark = keep or [c for c in docs.columns if c != "_half"], docs.sparkSession
    # In buckets of the parts' numbers, so that the answers come to where the rows lie.
    with small_batches(spark):
        table = bucketed(docs.mapInArrow(_packed(path, part_bytes), "part long, half int, body binary, grams binary"), "parts", "part", int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = spark.table(table)
    asked = written(parts.select("part", "half", "grams").mapInArrow(_asked, "part long, half int, gram long"), "asked")
    probabilities = log_probabilities(asked.select("half", "gram").distinct(), model)
    answers = asked.join(probabilities, ["half", "gram"]).select("part", "gram", "lp")
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("_nats", T.DoubleType()), T.StructField("_squares", T.DoubleType()), T.StructField("_symbols", T.LongType())])
    with small_batches(spark):
        found = written(parts.select("part", "body").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_score(path, keep), schema), "scored")
    unbucketed(spark, table)
    discard(asked, probabilities)
    return found


def half_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), text), F.lit(HALVES)).cast("int")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids (_trusted) that every label calls good and not toxic."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), F.lit(False))
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_trusted")).agg(F.min(good.cast("int")).alias("good")).where("good = 1").select("_trusted")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", columns: tuple[str, ...] | None = None, text_in: tuple[str, ...] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` (or its ``columns``) with _perplexity, _score, _threshold, _trusted_texts and _keep.

    The perplexity is by the model of the half that the text isn't in. The score is the mean bits a character less
    two standard errors of the text's own bits, so that short texts are not rejected by chance; ``_keep`` says that it
    isn't above the language's threshold (null is a language), which comes from the scores of all of that language's trusted
    documents, ``_trusted_texts`` of them. A language with fewer than ``least`` has no threshold: all of it is kept. Null and empty texts have
    no perplexity and stay, as does everything where a half has no trusted document. Repeated
    rows are scored alike. ``docs`` may have any other columns but those five, which are
    refused. ``text_in`` says where in ``columns`` the text stands, so that it isn't carried twice.
    """
    if clash := {"_perplexity", "_score", "_threshold", "_trusted_texts", "_keep"} & set(columns or docs.columns):
        raise ValueError(f"columns named as results: {sorted(clash)}")
    trusted = trusted_ids(labels, id_col)
    # The row's own columns travel in a struct, where their names clash with none of ours.
    carried = columns or docs.columns
    text_in = text_in or ((text_col,) if text_col in carried else None)
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(F.col(lang_col).cast("string").alias("lang")).alias("_of"), F.struct(*carried).alias("_row"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType
    train_on = filtered(rows.select("_id", whole("_text").alias("_text")), trusted.select(F.xxhash64(F.col("_trusted").try_cast(kind)).alias("hash")), F.xxhash64("_id"))
    train_on = train_on.join(trusted.hint("merge"), F.col("_id") == F.col("_trusted"), "left_semi")
    model = train(train_on.select(half_of(F.col("_text")).alias("half"), "_text"))
    # Rows are scored by the other half's model.
    own = rows.withColumn("_half", HALVES - 1 - half_of(whole("_text")))
    done = scored(own.drop("_text") if text_in else own, model, ("_row", *text_in) if text_in else ("_text",), ["_id", "_of", "_row"], part_bytes)
    discard(model)
    n, bits = F.col("_symbols"), F.col("_nats") / F.col("_symbols") / float(np.log(2))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_squares") / n - (F.col("_nats") / n) ** 2)) / float(np.log(2))
    done = done.withColumn("_perplexity", F.when(n > 1, F.exp(F.col("_nats") / n))).withColumn("_score", F.when(n > 1, bits - 2 * spread / F.sqrt(n)))
    held = done.select("_id", "_of", F.floor(F.col("_score") * STEPS).alias("_bin")).where("_bin is not null")
    held = held.join(trusted, F.col("_id") == F.col("_trusted"), "left_semi")
    bins = held.groupBy("_of", "_bin").agg(F.count(F.lit(1)).alias("n"))
    done = done.join(written(thresholds(bins, quantile, least), "thresholds"), "_of", "left")
    return done.select("_row.*", "_perplexity", "_score", "_threshold", F.coalesce("_trusted_texts", F.lit(0).cast("long")).alias("_trusted_texts"), F.coalesce(F.col("_score") <= F.col("_threshold"), F.lit(True)).alias("_keep"))


def thresholds(bins: DataFrame, quantile: float, least: int = LEAST) -> DataFrame:
    """(_of, _threshold, _trusted_texts) from a histogram (_of, _bin, n) of each language's scores.

    The threshold is the quantile, or, where that is higher, the median and TAIL times the distance
    from there to the 0.9 quantile: with few documents the highest quantile
    is just the largest score, the two others still tell how far scores reach. It is null below ``least`` documents.
    """
    group = W.partitionBy("_of")  # at most a few ten thousand bins
    run = bins.withColumn("upto", F.sum("n").over(group.orderBy("_bin"))).withColumn("all", F.sum("n").over(group))
    at = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("_bin"))) + 1) / STEPS
    found = run.groupBy("_of").agg(at(0.5).alias("mid"), at(0.9).alias("high"), at(quantile).alias("top"), F.max("all").alias("_trusted_texts"))
    limit = F.greatest("top", F.col("mid") + TAIL * (F.col("high") - F.col("mid")))
    return found.select("_of", F.when(F.col("_trusted_texts") >= least, limit).alias("_threshold"), "_trusted_texts")
