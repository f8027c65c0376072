"""Each corpus operator against a brute-force version, on small rows with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewell.llm import chosen_path, exact_dedup, kneser_ney, line_dedup, mixing, order_minhash, packing, pii, sharding, token_counts
from tracewell.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, owner string, bucket long, `set` string, path string, guest int, `_id` long, row long, grp string, size string, target string"
VOCAB = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def messy(rng=None):
    """Rows with nulls in every column, empty and long texts, ties, repeated rows and columns named as operators name theirs."""
    rng = rng or random.Random(7)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    texts = [*base, None, "", " ", "a", "A", "ümlaut Ü", prose(rng, 9000), "\n".join([prose(rng, 6)] * 30), "x" * 5000, "😀 é\u0000\ttab"]
    texts += [t.upper() for t in base[:6]] + base[:10] + [re.sub("w1 ", "w2 ", base[11]), base[12] + " more", "\n\n".join(base[13:18])]
    rows = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", "ö", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[2], None, None, None), (None, None, None, None, None), (9, "another text of the same id", "en", "a", 3)]
    return [(*r, 1, "o", None, "s", "p", 2, 5, 6, "g", "z", "t") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, docs):
    return docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).union(spark.createDataFrame([(None, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int"))


def words_in(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain(df):
    return [(r.doc_id, r.text or "", r.source) for r in df.select("doc_id", "text", "source").collect()]


@pytest.mark.parametrize("run", [
    lambda d, _: token_counts.token_counts(d, tokenizer("piece_bpe_32k.model")), lambda d, _: sharding.shard(d), lambda d, _: packing.pack(d), lambda d, _: pii.personal_data(d), lambda d, _: chosen_path.near_duplicates(d),
    lambda d, _: exact_dedup.exact_dedup(d), lambda d, _: line_dedup.line_dedup(d), lambda d, x: kneser_ney.classify(d, x), lambda d, _: mixing.mix(d), lambda d, _: order_minhash.fingerprints(d),
])
def test_empty_tables(empty, labels, run):
    assert run(empty, labels).count() == 0


def test_token_counts(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    rows = token_counts.token_counts(docs, tokenizer("piece_bpe_32k.model"), limit=50, chunk=200, overlap=16).collect()
    want = sorted((str(i), len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 50) for i, t, _ in plain(docs))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want


@pytest.mark.parametrize(("chunk", "overlap"), [(97, 8), (300, 16), (1000, 64)])
def test_token_splices_are_exact(chunk, overlap):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(chunk)
    texts = ["".join(rng.choice("ab é\n😀中  ▁<0x41>") for _ in range(3000)) for _ in range(8)]
    widened = 0
    for text in [*texts, "a" * 3000, " " * 4000, "😀" * 900, "▁ " * 700, "ab" * 2000 + " x"]:
        n, _, w = token_counts.count_tokens(text, path, chunk, overlap)
        widened += w
        assert n == len(model.encode(text))
    assert widened


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 1023])
def test_feistel_is_a_permutation(n):
    p = sharding.Feistel(n, seed=n)
    moved = [p(i) for i in range(n)]
    assert sorted(moved) == list(range(n))
    assert [p.inverse(x) for x in moved] == list(range(n))


def test_sharding(spark, docs):
    rows = sharding.shard(docs, shards=7, seed=3).collect()
    given = plain(docs)
    n = len(given)
    assert sorted(r.row_number for r in rows) == list(range(n))
    for r in rows:
        assert (r.shard, r.slot) == sharding.locate(r.row_number, n, 7, 3)
    want = Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t, _ in given)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(docs.repartition(3), shards=7, seed=3).collect()
    key = lambda r: (str(r.doc_id), r.text_crc32, r.row_number, r.shard, r.slot)
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(5)
    lengths = sorted((rng.randint(0, 130) for _ in range(300)), reverse=True)
    sources = [rng.choice([None, *range(9)]) for _ in lengths]
    clusters = [rng.choice([None, *range(60)]) for _ in lengths]
    found = packing.best_fit(lengths, sources, clusters, 100)
    bins = []
    for n, s, c, pieces in zip(lengths, sources, clusters, found, strict=True):
        want = []
        for _ in range(n // 100):
            bins.append([0, {s} - {None}, {c} - {None}])
            want.append((len(bins) - 1, 0, 100))
        rest = n % 100
        if rest or not want:
            fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= rest and b[0] > 0 and s not in b[1] and c not in b[2]]
            if fits:
                at = min(fits)[1]
            else:
                bins.append([100, set(), set()])
                at = len(bins) - 1
            want.append((at, 100 - bins[at][0], rest))
            bins[at][0] -= rest
            bins[at][1] |= {s} - {None}
            bins[at][2] |= {c} - {None}
        assert pieces == want


def test_packing_keeps_all_words_and_no_conflicts(docs):
    rows = packing.pack(docs, capacity=64, rows_a_group=20).collect()
    given = plain(docs)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert sum(r.words for r in rows) == sum(words(t) for _, t, _ in given)
    assert sum(r.piece == 0 for r in rows) == len(given)
    sources = {i: s for i, _, s in given}
    bins = defaultdict(list)
    for r in rows:
        bins[r.grp, r.bin].append(r)
    for held in bins.values():
        assert sum(r.words for r in held) <= 64
        assert all(a.offset + a.words <= b.offset for a, b in zip(sorted(held, key=lambda r: (r.offset, r.words)), sorted(held, key=lambda r: (r.offset, r.words))[1:], strict=False))
        own = [sources[r.doc_id] for r in held if r.doc_id is not None and r.doc_id != 9 and sources[r.doc_id] is not None]
        assert len(own) == len(set(own))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    pieces = ["a@b.co", "@", "x.y@z-1.example.com", "+1 (476) 555-6291", "4111 1111 1111 1111", "1.2.3.4", "999.1.1.1", " ", "é", "+", ".", "12", "-", "a@@b.c.d", "4111111111111111"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(12))
        want = [("email", m.start(), m.end()) for m in pii.EMAIL.finditer(text)]
        for kind, p in (("ip", pii.IP), ("card", pii.CARD), ("phone", pii.PHONE)):
            want += [(kind, m.start(), m.end()) for m in p.finditer(text) if pii.valid(kind, m.group())]
        assert pii.base_spans(text) == want


def test_field_finds_what_the_patterns_miss():
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(["the", "with", "onder", "thea", "en", "ble", "rest", "tion"]) for _ in range(n))

    def card():
        d = [rng.randint(0, 9) for _ in range(15)]
        return next(s for x in range(10) if pii.luhn(s := "".join(map(str, [*d, x]))))

    kinds = (card, lambda: f"u{rng.randint(0, 99)}@mail{rng.randint(0, 9)}.example.com", lambda: f"+1 (476) 555-{rng.randint(1000, 9999)}", lambda: "10.2.3.4")
    texts = [f"{words(12)} {kinds[i % 4]()} {words(12)}" for i in range(48)]
    weights = pii.fit(texts)
    a, b = card(), card()
    text = f"{words(5)} {a} {b} {words(5)}"
    assert pii.base_spans(text) == []  # one run of 32 digits
    added = pii.added_spans(text, [], weights)
    assert {text[s:e] for k, s, e in added if k == "card"} == {a, b}
    for spelled in ("jo [dot] w9 [at] mail4 [dot] example [dot] com", "jo.w9 (at) mail4.example.com", "jo at mail4 dot example dot com"):
        text = f"{words(5)} {spelled} {words(5)}"
        assert [(k, text[s:e]) for k, s, e in pii.added_spans(text, pii.base_spans(text), weights)] == [("email", spelled)]
    clean = words(300) + " order 20240101 of 12 items, 3.5 kg, looked at home . Then at example.com and (at) night"
    assert pii.added_spans(clean, pii.base_spans(clean), weights) == []


def every_segmentation(spans, at=0):
    """All sets of disjoint spans, each with its positions in the list."""
    yield ()
    for x, (i, j) in enumerate(spans):
        if i >= at:
            for rest in every_segmentation(spans, j):
                yield (x, *rest)


def brute_lattice(text, a, b):
    """The same candidates without running sums: every run of tokens is tried."""
    tokens = [(a + m.start(), a + m.end()) for m in pii.TOKEN.finditer(text[a:b])]
    marked = {x for mark in (pii.AT, pii.DOT) for m in mark.finditer(text, a, b) for x in range(*m.span())}
    ats = [m.start() for m in pii.AT.finditer(text, a, b)]
    out = []
    for i in range(len(tokens)):
        for j in range(i + 1, min(len(tokens), i + pii.LONGEST) + 1):
            s, e = tokens[i][0], tokens[j - 1][1]
            part = text[s:e]
            ends = text[e - 1].isalnum() or text[e - 1] == "_"
            if e - s > pii.CHARS or not ends or not (part[0].isalnum() or part[0] in "_+("):
                continue
            nd = len(re.sub("[^0-9]", "", part))
            plain = all(t.isspace() or t.isdigit() and t.isascii() or not (t[0].isalnum() or t[0] == "_") for t in (text[x:y] for x, y in tokens[i:j]))
            named = sum(s < x < e for x in ats) == 1 and not any(text[x].isspace() and x not in marked for x in range(s, e))
            if any(pii.possible(part, nd, plain, named)):
                out.append((i, j, pii.segment_features(text, tokens, i, j)))
    return tokens, out


SMALL_TEXTS = ["a 4111111111111111 b@c.de", "x jo at w dot com y", "on 10[.]2[.]3[.]4 or so", "7 4111 1111 1111 1111 9", "call 0049 (30) 1234567 x"]


@pytest.mark.parametrize("text", SMALL_TEXTS)
def test_segmentation_matches_enumeration(text):
    """Decoding and marginals of the semi-Markov field against all segmentations of a short window."""
    import math

    import numpy as np

    tokens, segments = pii.lattice(text, 0, len(text))
    assert segments and (tokens, segments) == brute_lattice(text, 0, len(text))
    rng = np.random.default_rng(1)
    for _ in range(5):
        scores = pii.segment_scores(segments, rng.normal(size=(len(pii.KINDS), pii.WIDTH)))
        spans = [(i, j) for i, j, _ in segments]
        total, mass, best = 0.0, np.zeros(len(spans)), 0.0
        for chosen in every_segmentation(spans):
            weight = math.prod(np.exp(scores[x]).sum() for x in chosen)
            total += weight
            mass[list(chosen)] += weight
            best = max(best, sum(scores[x].max() - pii.MARGIN for x in chosen))
        odds = np.exp(scores).sum(axis=1)
        found = np.array(pii.expectations(len(tokens), spans, odds.tolist())) * odds
        assert np.allclose(found, mass / total)
        decoded = pii.decode(len(tokens), segments, scores)
        assert all(a[1] <= b[0] for a, b in zip(sorted(decoded), sorted(decoded)[1:], strict=False))
        assert math.isclose(sum(scores[spans.index((i, j))][k] - pii.MARGIN for i, j, k in decoded), best, abs_tol=1e-9)


def test_spans_against_brute_force(spark):
    """The query's spans: the patterns' own matches, and the best segmentation of each window among all."""
    texts = [*SMALL_TEXTS, None, "", "mail ab@c.de now", "x@y at 1.2.3.4.5.6.7.8 and 4111111111111111", "no 4111111111111112 here", "see u7 (at) mail3 (dot) example.com today", *["write to k9@mail2.example.com or +1 (476) 555-6291 or 4111 1111 1111 1111 from 10.2.3.4"] * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    fitted = sorted({t for t in texts if t and re.search(r"[@+]|[0-9]{6}", t)}, key=lambda t: spark.range(1).select(F.xxhash64(F.lit(5), F.lit(t))).first()[0])
    weights = pii.fit(fitted)
    added = 0
    for r in pii.personal_data(docs).collect():
        text = texts[r.doc_id] or ""
        base = [("email", *m.span()) for m in pii.EMAIL.finditer(text)] + [(k, *m.span()) for k, p in (("ip", pii.IP), ("card", pii.CARD), ("phone", pii.PHONE)) for m in p.finditer(text) if pii.valid(k, m.group())]
        free = lambda s, e, base=base: not any(s < y and x < e for _, x, y in base)
        more = []
        for a, b in pii.windows(text, lambda s, e, free=free: not free(s, e)):
            tokens, segments = brute_lattice(text, a, b)
            scores = pii.segment_scores(segments, weights)
            spans = [(i, j) for i, j, _ in segments]
            best = max(every_segmentation(spans), key=lambda c: round(sum(scores[x].max() - pii.MARGIN for x in c), 9)) if len(spans) < 40 else [spans.index((i, j)) for i, j, _ in pii.decode(len(tokens), segments, scores)]
            more += [z for x in best if free(*(z := (pii.KINDS[int(scores[x].argmax())], tokens[spans[x][0]][0], tokens[spans[x][1] - 1][1]))[1:])]
        assert r.spans == pii.listed(base + more), text
        assert r.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        added += len(more)
    assert added >= 3


def test_long_texts_take_time_in_proportion():
    """Runs that made the patterns quadratic, at 5 million characters each."""
    import time

    weights = pii.fit(["mail a.b@c.de or 4111 1111 1111 1111 and +1 (476) 555-6291 at 10.2.3.4 x"] * 3)
    began = time.perf_counter()
    for unit in ("1" * 999_999 + ".", "a" * 1_000_000 + "@", "a.b@c.de ", "1.2.3.4.", "+1 (476) 555-6291 ", "the quick brown fox at home. "):
        text = (unit * (5_000_000 // len(unit) + 1))[:5_000_000]
        base = pii.base_spans(text)
        assert len(base) == {"a.b@": 555_555, "1.2.": 625_000, "+1 (": 277_777}.get(unit[:4], 0)
        assert pii.added_spans(text, base, weights) == []
    assert time.perf_counter() - began < 90


def test_personal_data_rows(docs):
    rows = pii.personal_data(docs.union(docs.limit(1).withColumn("text", F.lit("mail a@b.co or 1.2.3.4"))), sample=50).collect()
    assert len(rows) == docs.count() + 1
    assert sum(r.n_email for r in rows) == 1
    hit = next(r for r in rows if r.n_email)
    assert hit.base_sha256 == hashlib.sha256(b"email:5:11,ip:15:22").hexdigest()
    assert hit.spans.startswith("email:5:11,ip:15:22")


def shingle_sets(texts, n=5):
    out = []
    for t in texts:
        w = t.lower().split()
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


@pytest.mark.parametrize("small", [2, 128])
def test_jaccard_join(spark, docs, small):
    rng = random.Random(11)
    crowd = prose(rng, 60)
    near = []
    for i in range(60):
        w = crowd.split()
        w[rng.randrange(60)] = f"z{i}"
        near.append((1000 + i, " ".join(w)))
    shared = prose(rng, 30)
    near += [(2000 + i, shared + " " + prose(rng, 40)) for i in range(40)]
    more = spark.createDataFrame(near, "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(more)
    given = [(r.doc_id, r.text or "") for r in rows.collect()]
    sets = shingle_sets([t for _, t in given])
    links, up = Counter(), list(range(len(given)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(given)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    classes = defaultdict(list)
    for i in range(len(given)):
        classes[top(i)].append(given[i][0])
    least = {c: min((x for x in ids if x is not None), default=None) for c, ids in classes.items()}
    key = lambda x: (str(x[0]), str(x[1]), x[2])
    # Null ids sort first, so a class with one is named null.
    want = sorted(((given[i][0], None if None in classes[top(i)] else least[top(i)], links[i]) for i in range(len(given))), key=key)
    found = chosen_path.near_duplicates(rows, small=small, block=16).collect()
    assert sorted(((r.doc_id, r.class_id, r.links) for r in found), key=key) == want


def test_runs_reach_the_recall():
    assert chosen_path.runs_for(0.999, 0.8) == 3
    assert chosen_path.runs_for(0.9, 0.8) == 1


def test_golomb_round_trip():
    import numpy as np

    rng = np.random.default_rng(0)
    for owners in (1, 3, 16):
        starts = exact_dedup.owner_starts(owners)
        for n in (0, 1, 2, 1000):
            for o in (0, owners - 1):
                a, b = int(starts[o]), int(starts[o + 1])
                values = np.unique(rng.integers(a, b, n))
                code = exact_dedup.rice_encode(values, a, b - a)
                assert (exact_dedup.rice_decode(code) == values).all()
                assert len(code) < 40 + 8 * n


def test_exact_dedup(docs):
    given = plain(docs)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, t, _ in given:
        groups[t.translate(lower)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    rows = exact_dedup.exact_dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept) == {r.text_sha256 for r in rows}
    assert set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def brute_chunks(text, mean):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    chunks, start = [], 0
    for i in range(len(lines)):
        if (h[i] + (h[i - 1] if i else 0) * 31) % line_dedup.PRIME % mean == 0 or i == len(lines) - 1:
            chunks.append(lines[start : i + 1])
            start = i + 1
    return chunks


def test_line_dedup(spark, docs):
    rng = random.Random(4)
    block = [prose(rng, 4) for _ in range(12)]
    texts = [(5000 + i, "\n".join([prose(rng, 3) for _ in range(rng.randint(0, 4))] + block + [prose(rng, 3)])) for i in range(6)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    given = sorted({(r.doc_id, r.text or "") for r in rows.collect()}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    seen, want = set(), {}
    for i, t in given:
        kept, lost, gone = [], 0, 0
        for c in brute_chunks(t, 3):
            body = "\n".join(c)
            if len(c) >= 2 and body in seen:
                lost, gone = lost + len(c), gone + 1
            else:
                kept.append(body)
            if len(c) >= 2:
                seen.add(body)
        want.setdefault((i, len(t.split("\n")), lost, gone, "\n".join(kept)), 0)
    found = line_dedup.line_dedup(rows, mean_lines=3).collect()
    assert len(found) == rows.count()
    assert {(r.doc_id, r.n_lines, r.removed_lines, r.removed_chunks, r.text) for r in found} == set(want)
    assert sum(r.removed_lines for r in found if (r.doc_id or 0) >= 5000) > 20


def test_passages_go_whole(spark, docs):
    rng = random.Random(5)
    passages = [[prose(rng, 12) for _ in range(n)] for n in (2, 3, 4, 5, 6)]
    own = lambda n: [prose(rng, 5) for _ in range(n)]
    texts = [(6000 + i, "\n".join(own(rng.randint(1, 4)) + passages[i % 5] + own(rng.randint(1, 4)))) for i in range(20)]
    texts += [(6100, "\n".join(["x y"] * 3)), (6101, "\n".join(["u v"] * 7)), (6102, "\n".join(passages[0])), (6103, "one\ntwo"), (6104, "two\none\ntwo")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    given = sorted({(r.doc_id, r.text or "") for r in rows.collect()}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    first, want = {}, set()
    for d, (i, t) in enumerate(given):
        lines, lost = t.split("\n"), set()
        for at in range(len(lines) - 1):
            was = first.setdefault(tuple(lines[at : at + 2]), (d, at))
            if was[0] != d or at >= was[1] + 2:
                lost |= {at, at + 1}
        want.add((i, "\n".join(x for at, x in enumerate(lines) if at not in lost), len(lines), len(lost), sum(at - 1 not in lost for at in lost)))
    found = line_dedup.passage_dedup(rows).collect()
    assert len(found) == rows.count()
    assert {(r.doc_id, r.text, r.n_lines, r.removed_lines, r.removed_passages) for r in found} == want
    by = {r.doc_id: r for r in found}
    # Every planted passage goes whole and its neighbours stay; the first of each stays.
    assert all(by[6000 + i].removed_lines == (len(passages[i % 5]) if i >= 5 else 0) for i in range(20))
    assert [by[6100 + i].text for i in range(5)] == ["x y\nx y\nx y", "u v\nu v", "", "one\ntwo", "two"]
    assert line_dedup.passage_dedup(rows.where("false")).count() == 0


def brute_kneser_ney(texts):
    """Probability of a 4-gram's last character, by the textbook."""
    c = {4: Counter()}
    for t in texts:
        x = [0, 0, 0, *[min(ord(ch), 0xFFFF) for ch in t], 1]
        for i in range(3, len(x)):
            c[4][tuple(x[i - 3 : i + 1])] += 1
    for k in (3, 2, 1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    d = {}
    for k in c:
        n = [sum(v == i for v in c[k].values()) for i in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            d[k] = [0.5, 0.75, 0.9]
            continue
        y = n[0] / (n[0] + 2 * n[1])
        d[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.0, 0.05), i - 0.05) for i in (1, 2, 3)]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(c[1]) + 1)
        own = {h: v for h, v in c[k].items() if h[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        cut = lambda v: d[k][min(v, 3) - 1]
        total = sum(own.values())
        v = own.get(g, 0)
        return ((v - cut(v)) / total if v else 0) + sum(map(cut, own.values())) / total * p(g[1:])

    return p


def text_grams(text):
    x = [0, 0, 0, *[min(ord(ch), 0xFFFF) for ch in text], 1]
    return [tuple(x[i - 3 : i + 1]) for i in range(3, len(x))]


def test_kneser_ney(spark):
    import numpy as np

    rng = random.Random(9)
    texts = ["".join(rng.choice("abcd e😀") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    other = ["nothing of these", "zz"]
    model = kneser_ney.train(spark.createDataFrame([(0, t) for t in texts] + [(1, t) for t in other], "half int, text string"))
    models = [brute_kneser_ney(texts), brute_kneser_ney(other)]
    p = models[0]
    asked = ["abba", "zebra x", "", "e😀 cab", None]
    for part_bytes in (3, 1000):
        out = kneser_ney.scored(spark.createDataFrame([(i, h, t) for i, t in enumerate(asked) for h in (0, 1)], "doc_id int, _half int, text string").withColumn("half", F.col("_half")), model, part_bytes=part_bytes).collect()
        assert len(out) == 2 * len(asked)
        for r in out:
            want = np.log([models[r.half](g) for g in text_grams(asked[r.doc_id] or "")])
            assert np.allclose([-r._nats, r._squares, r._symbols], [want.sum(), (want**2).sum(), len(want)]), asked[r.doc_id]
    # The probabilities after any context sum to one over the characters known and one unknown.
    known = {g[-1] for t in texts for g in [(1,), *[(min(ord(ch), 0xFFFF),) for ch in t]]}
    for context in ((0, 0, 0), (97, 98, 98), (32, 101, 0xFFFF), (7, 7, 7)):
        assert abs(sum(p((*context, w)) for w in [*known, 7777]) - 1) < 1e-9


def test_gram_lists_round_trip():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (0, 1, 5000):
        grams = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)).view(np.int64)
        assert (kneser_ney._grams_in(kneser_ney._low_of(grams)) == grams).all()


def test_classifier_against_brute_force(spark):
    """Perplexity, score, threshold and decision of every row, by the textbook."""
    import math

    rng = random.Random(16)
    rows = [(i, prose(rng, rng.randint(1, 12)), "few" if i % 36 == 0 else rng.choice(["en", "de", None])) for i in range(160)]
    rows += [(500, "".join(rng.choice("#$%&*|!QXZ ") for _ in range(300)), "en"), (501, None, "en"), (502, "", None), (503, "no label at all", "fr"), (None, "no id", "en"), (3, "the same id twice", "en")]
    marks = [(i, 1, 0) for i in range(0, 160, 2)] + [(7, 0, 0), (8, 1, 1), (None, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = {r._trusted for r in kneser_ney.trusted_ids(labels).collect()}
    assert trusted == set(range(0, 160, 2)) - {8}
    half = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), kneser_ney.half_of(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    models = [brute_kneser_ney([t or "" for i, t, _ in rows if i in trusted and half[t or ""] == h]) for h in (0, 1)]
    made, held = [], defaultdict(list)
    for i, t, lang in rows:
        ln = [math.log(models[1 - half[t or ""]](g)) for g in text_grams(t or "")]
        n, mean = len(ln), -sum(ln) / len(ln)
        score = (mean - 2 * math.sqrt(max(0.0, sum(x * x for x in ln) / n - mean * mean)) / math.sqrt(n)) / math.log(2) if n > 1 else None
        made.append((i, t, lang, math.exp(mean) if n > 1 else None, score))
        if score is not None and i in trusted:
            held[lang].append(math.floor(score * 1000))
    limit = {}
    for lang, bins in held.items():
        at = lambda q, bins=sorted(bins): (next(b for x, b in enumerate(bins) if x + 1 >= q * len(bins)) + 1) / 1000
        limit[lang] = max(at(0.998), at(0.5) + 3 * (at(0.9) - at(0.5)))
    limit = {lang: x for lang, x in limit.items() if len(held[lang]) >= 10}
    assert set(limit) == {"en", "de", None} and 0 < len(held["few"]) < 10
    key = lambda r: (str(r[0]), str(r[1]))
    out = sorted(((r.doc_id, r.text, r.lang, r._perplexity, r._score, r._threshold, r._keep, r._trusted_texts) for r in kneser_ney.classify(docs, labels, least=10, part_bytes=900).collect()), key=key)
    assert len(out) == len(rows)
    for got, (i, t, lang, perplexity, score) in zip(out, sorted(made, key=key), strict=True):
        assert got[:3] == (i, t, lang)
        assert got[3] == pytest.approx(perplexity) and got[4] == pytest.approx(score) and got[5] == pytest.approx(limit.get(lang))
        assert got[7] == len(held[lang])
        assert got[6] == (score is None or lang not in limit or score <= limit[lang])
    assert not next(r for r in out if r[0] == 500)[6]


def test_classifier_refuses_columns_named_as_its_results(docs, labels):
    with pytest.raises(ValueError, match="_keep"):
        kneser_ney.classify(docs.withColumn("_keep", F.lit(1)), labels)


def test_classifier_rejects_junk_and_keeps_prose(spark, docs):
    rng = random.Random(6)
    good = [(i, prose(rng, 60), "en", 1, 0) for i in range(1500)]
    junk = [(10_000 + i, "".join(rng.choice("#$%&*|!QXZ ") for _ in range(300)), "en", 0, 0) for i in range(40)]
    rows = spark.createDataFrame(good + junk, "doc_id long, text string, lang string, quality int, toxic int")
    labels = rows.where("doc_id % 3 = 0").select("doc_id", "quality", "toxic")
    out = kneser_ney.classify(rows.drop("quality", "toxic"), labels).collect()
    assert len(out) == len(good + junk)
    kept = {r.doc_id for r in out if r._keep}
    assert not [j for j, *_ in junk if j in kept]
    assert sum(i in kept for i, *_ in good) >= 0.99 * len(good)


def test_classifier_of_messy_rows(docs, labels):
    out = kneser_ney.classify(docs, labels)
    assert out.count() == docs.count()
    assert out.where("text is null and not _keep").count() == 0
    none = kneser_ney.classify(docs, labels.where("false"))
    assert none.where("_keep").count() == docs.count()


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(w[s] for s in open_)
        over = [s for s in open_ if per * w[s] > most * sizes[s]]
        if not over:
            return out | {s: per * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mixing(spark, docs):
    rng = random.Random(8)
    more = spark.createDataFrame([(7000 + i, prose(rng, rng.randint(1, 30)), rng.choice("abcc")) for i in range(600)], "doc_id long, text string, source string")
    rows = docs.select("doc_id", "text", "source").union(more)
    out = mixing.mix(rows).collect()
    given = plain(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert Counter((r.doc_id, r.source, r["size"]) for r in out) == Counter((i, s, words(t)) for i, t, s in given)
    sizes = Counter()
    for _, t, s in given:
        sizes[s] += words(t)
    targets = brute_targets(sizes)
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source]
        assert abs(r.target - targets[r.source]) < 1e-6 * max(1, targets[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
    largest = Counter()
    for _, t, s in given:
        largest[s] = max(largest[s], words(t))
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 3 * largest[s] + 1  # rows equal in id and text go together
    again = mixing.mix(rows.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.mix_hash, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, out))


def order_tokens(text):
    """Runs without white space, cut from left to right one character at a time."""
    import unicodedata

    out = []
    for run in re.split(r"[ \t\n\x0B\f\r]+", text):
        at = 0
        while at < len(run):
            if unicodedata.category(run[at]) == "Lo":
                out.append(run[at])
                at += 1
                continue
            end = at
            while end < len(run) and end - at < 12 and unicodedata.category(run[end]) != "Lo" and not (end - at >= 4 and run[end - 1] in "aeiou02468аеиоуыяαεηιουω"):
                end += 1
            out.append(run[at:end])
            at = end
    return out


def brute_fingerprint(text, k=3):
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    tokens = order_tokens(text)
    low = lambda h: h & (2**33 - 1)
    grams = []
    for i in range(len(tokens)):
        h = 42
        for t in tokens[i : i + k]:
            h = xxhash.xxh64_intdigest(t.encode(), h)
        grams.append(low(h))
    seen, bins = Counter(), defaultdict(list)
    long_hash = lambda v, seed: xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
    int_hash = lambda v, seed: xxhash.xxh64_intdigest(v.to_bytes(4, "little"), seed)
    for place, g in enumerate(grams):
        whole = g - (1 << 33) if g >> 32 else g
        rank = int_hash(seen[g], long_hash(whole, 42)) >> 31
        seen[g] += 1
        bins[rank >> 27].append((signed(rank << 31 | place), rank, place))
    out = []
    for b in sorted(bins, key=lambda b: signed(b << 58)):
        two = [(r, p) for _, r, p in sorted(bins[b])[:2]]
        if len(two) == 2 and two[1][1] < two[0][1]:
            two.reverse()
        h = 42
        for r, _ in two:
            h = long_hash(r, h)
        out.append(b << 32 | (h & 0xFFFFFFFF))
    return ",".join(f"{x:X}" for x in out)


def test_order_minhash(docs, spark):
    more = [(-5, "漢字かな混じり文ですabc漢字", None), (-6, "".join(random.Random(3).choice("bcdfghae0123") for _ in range(700)), None), (-7, "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxa", None)]
    docs = docs.select("doc_id", "text", "source").union(spark.createDataFrame(more, "doc_id long, text string, source string"))
    rows = order_minhash.fingerprints(docs).collect()
    given = plain(docs)
    order = sorted(given, key=lambda r: (r[0] is None, -(r[0] or 0), tuple(-ord(x) for x in hashlib.md5(r[1].encode()).hexdigest())))
    want = Counter()
    for at, (i, t, _) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        m = len(t) // 2
        edited = t[: len(t) - m] + following[:m]
        a, b, c = (set(filter(None, brute_fingerprint(x).split(","))) for x in (t, edited, following))
        like = lambda x, y: len(x & y) / len({p[:-8] for p in x} | {p[:-8] for p in y}) if x or y else 1.0
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), brute_fingerprint(t), round(like(a, b), 9), round(like(a, c), 9)] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)
    assert got == want


def test_order_minhash_falls_with_edits(spark):
    rng = random.Random(1)
    text = prose(rng, 600).split()
    moved = text[300:] + text[:300]
    few = [w if i % 100 else "zzz" for i, w in enumerate(text)]
    df = spark.createDataFrame([Row(a=" ".join(text), b=" ".join(x)) for x in (text, few, moved, [prose(rng, 600)])])
    df = order_minhash.with_components(order_minhash.with_components(df, "a", "p"), "b", "q")
    same, slight, turned, other = (r[0] for r in df.select(order_minhash.likeness(F.col("p"), F.col("q"))).collect())
    assert same == 1.0
    assert slight > 0.7 > turned > other


def test_order_minhash_follows_an_insertion_without_spaces(spark):
    """One character put in anywhere leaves nearly all of a fingerprint, whatever the script."""
    rng = random.Random(12)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "".join(map(chr, range(0x4E00, 0x4F00))), "абвгдеёжзийклмнопрстуфхц"):
        text = "".join(rng.choice(letters) for _ in range(3000))
        df = spark.createDataFrame([(text, text[:at] + letters[1] + text[at:]) for at in (1, 100, 1500, 2900)], "a string, b string")
        df = order_minhash.with_components(order_minhash.with_components(df, "a", "p"), "b", "q")
        assert all(r[0] > 0.9 for r in df.select(order_minhash.likeness(F.col("p"), F.col("q"))).collect()), letters[:8]


def test_order_minhash_takes_ids_of_any_type(spark):
    rng = random.Random(13)
    texts = [prose(rng, 20) for _ in range(30)]
    for kind, ids in (("string", [f"doc/{i:03}" for i in range(30)]), ("string", [f"{i % 7}x{i}" for i in range(30)]), ("double", [i / 3 - 4 for i in range(30)])):
        rows = order_minhash.fingerprints(spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string")).collect()
        order = sorted(zip(ids, texts, strict=True), reverse=True)
        want = {i: hashlib.sha256((t[: len(t) - len(t) // 2] + order[(x + 1) % 30][1][: len(t) // 2]).encode()).hexdigest() for x, (i, t) in enumerate(order)}
        assert {r.doc_id: r.edited_sha256 for r in rows} == want


def test_packing_is_the_tightest_compatible_of_every_bin(docs):
    """The whole result against a packing that looks at every open bin."""
    capacity = 64
    rows = packing.pack(docs, capacity=capacity, rows_a_group=20).collect()
    groups = defaultdict(lambda: defaultdict(list))
    for r in rows:
        groups[r.grp][r.row].append(r)
    assert len({r.row for r in rows}) == docs.count() and len(groups) > 2
    for items in groups.values():
        bins = []  # left, sources, clusters
        for pieces in sorted(items.values(), key=lambda ps: (-sum(p.words for p in ps), ps[0].row)):
            length, source, cluster = sum(p.words for p in pieces), pieces[0].source, pieces[0].cluster
            want = []
            for _ in range(length // capacity):
                want.append((len(bins), 0, capacity))
                bins.append([0, {source}, {cluster}])
            rest = length % capacity
            if rest or not want:
                fits = [(b[0], x) for x, b in enumerate(bins) if b[0] >= rest and b[0] > 0 and source not in b[1] - {None} and cluster not in b[2]]
                if not fits:
                    bins.append([capacity, set(), set()])
                    fits = [(capacity, len(bins) - 1)]
                _, x = min(fits)
                want.append((x, capacity - bins[x][0], rest))
                bins[x][0] -= rest
                bins[x][1].add(source)
                bins[x][2].add(cluster)
            assert [(p.bin, p.offset, p.words) for p in sorted(pieces, key=lambda p: p.piece)] == want
