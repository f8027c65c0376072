"""The pipeline's stages against brute force, on rows with nulls, repeats and clashing columns."""

import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, brute_targets, messy, prose, shingle_sets, words_in
from tracewell.llm import chosen_path


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), SCHEMA).repartition(3).cache()


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_are_the_ones_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing", "best-fit packing"]


def test_exact_stage(spark, docs):
    out = corpus_pipeline.exact(spark, docs, "")
    assert out.columns == docs.columns
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for r in docs.collect():
        groups[(r.text or "").translate(lower)].append(r.doc_id)
    want = Counter(max((i for i in ids if i is not None), default=None) for ids in groups.values())
    assert Counter(r.doc_id for r in out.collect()) == want


def test_near_stage(spark, docs):
    rng = random.Random(3)
    text = prose(rng, 80)
    more = [(8000 + i, text.replace(text.split()[0], f"q{i}", 1), "en", "a", 1) for i in range(5)] + [(8100, prose(rng, 50), "en", "a", 1)]
    rows = corpus_pipeline.exact(spark, docs.union(spark.createDataFrame([(*r, 1, "o", None, "s", "p", 2, 5, 6, "g", "z", "t") for r in more], SCHEMA)), "")
    given = [(r.doc_id, r.text or "") for r in rows.collect()]
    sets = shingle_sets([t for _, t in given])
    up = list(range(len(given)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(given)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    out = corpus_pipeline.near(spark, rows, "")
    assert out.columns == docs.columns
    left = [(r.doc_id, r.text or "") for r in out.collect()]
    place = {x: i for i, x in enumerate(given)}
    assert Counter(top(place[x]) for x in left) == Counter({top(i): 1 for i in range(len(given))})
    assert sum(8000 <= (i or 0) < 8005 for i, _ in left) == 1


def test_mixing_stage(spark, docs):
    rng = random.Random(4)
    more = [(9000 + i, prose(rng, rng.randint(1, 20)), "en", rng.choice("abc"), 1) for i in range(300)]
    rows = docs.union(spark.createDataFrame([(*r, 1, "o", None, "s", "p", 2, 5, 6, "g", "z", "t") for r in more], SCHEMA))
    out = corpus_pipeline.mixed(spark, rows, "")
    assert out.columns == docs.columns
    given, taken = rows_of(rows), rows_of(out)
    assert set(taken) <= set(given)
    assert all(n <= 2 * given[r] for r, n in taken.items())
    sizes, got, most = Counter(), Counter(), Counter()
    for r, n in given.items():
        sizes[r[3]] += n * words_in(r[1])
        most[r[3]] = max(most[r[3]], n * words_in(r[1]))
    for r, n in taken.items():
        got[r[3]] += n * words_in(r[1])
    targets = brute_targets(sizes)
    assert all(abs(got[s] - targets[s]) <= most[s] + 1 for s in sizes)


def test_packing_stage_keeps_all_words(spark, docs):
    out = corpus_pipeline.packed(spark, docs, "").collect()
    assert sum(r.words for r in out) == sum(words_in(r.text) for r in docs.select("text").collect())


def test_run_is_its_stages(spark, tmp_path):
    rng = random.Random(6)
    good = [(i, prose(rng, 60), "en", "src%d" % (i % 4), 300) for i in range(600)]
    junk = [(10_000 + i, "".join(rng.choice("#$%&*|!QXZ ") for _ in range(300)), "en", "src1", 300) for i in range(20)]
    copies = [(20_000 + i, good[i][1].upper(), "en", "src2", 300) for i in range(30)]
    spark.createDataFrame(good + junk + copies, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).cache()
    assert out.where("doc_id between 10000 and 19999").count() == 0
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    kept = {i for i, *_ in good[:30]} | {i for i, *_ in copies}
    assert len(ids & kept) <= 30  # one of each pair of copies
    assert out.groupBy("grp", "bin").agg(F.sum("words").alias("w")).where("w > 2048").count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.mixed, corpus_pipeline.packed):
        assert stage(spark, empty, "").count() == 0


def test_near_stage_tasks_hold_little(spark, monkeypatch):
    """Texts come in small batches, and a worker keeps no words once its task ends."""
    embed = chosen_path._embed

    def watched(words):
        inner = embed(words)

        def run(batches):
            def seen():
                for b in batches:
                    assert b.num_rows <= 1000
                    yield b

            yield from inner(seen())
            assert not chosen_path._known

        return run

    monkeypatch.setattr(chosen_path, "_embed", watched)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), *[F.col("id") + i for i in range(5)]).alias("text"))
    assert corpus_pipeline.near(spark, docs, "").count() == 3000


@pytest.mark.parametrize("blocks", [1, 2])
def test_a_block_of_near_copies_is_verified_in_strips(blocks):
    """A full block's links are those by brute force, in a fraction of what its table of pairs took as floats and longs."""
    rng, n = np.random.default_rng(5), 2000
    held = (rng.random((n, 24)) < 0.85).astype(np.float32)
    sets = [np.flatnonzero(h).astype(np.uint64) for h in held]
    copies, own = rng.integers(1, 4, n), np.arange(n) % blocks
    part = pd.DataFrame({"part": 1, "own": own, "lo": 0, "hi": blocks - 1, "set": [i.to_bytes(16, "big") for i in range(n)], "copies": copies, "shingles": [s.tobytes() for s in sets]})
    both = held @ held.T
    size = held.sum(axis=1)
    agree = both >= 0.8 * (size[:, None] + size - both) - 1e-6
    agree &= own[:, None] != own if blocks == 2 else ~np.eye(n, dtype=bool)
    want = {i: int(x) for i, x in enumerate(agree @ copies) if x}
    tracemalloc.start()
    found = chosen_path._verify(0.8)(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {int.from_bytes(s, "big"): x for s, x in zip(found["set"], found["links"], strict=True)} == want
    assert peak < 80e6
