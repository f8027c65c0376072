"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field adds spans that they miss: it scores whole
candidate segments, up to a bounded number of tokens, by features of the segment (its
shape, digits, checksum, length, marks, the words before it), and a dynamic
program over the tokens chooses boundaries and kinds jointly. A candidate need only
have a kind's ingredients (marks for at and dot, four small numbers, enough digits);
which of the many that overlap is taken, and whether any is, the weights decide. They are fitted
by maximum likelihood on the surroundings of the base spans of a bounded sample, as
they are and with the span disguised (at and dot spelled out, other separators).

All scans are linear in the text: patterns are looked for where they can start, and
spans are compared in one sweep.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

# The kinds, in the order in which spans are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Documents whose base spans the field is fitted on, at most.
SAMPLE = 60
#: Tokens in a segment, at most, and tokens of context on each side of a candidate.
LONGEST, AROUND = 32, 4
#: Log odds by which a segment must beat being outside to be added.
MARGIN = 2.0

#: A run of letters or digits, one sign, or one stretch of white space.
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|[^\w\s]|[\w]", re.UNICODE)
#: Marks for at and dot: the sign, the sign or the word in brackets, the word between spaces.
AT = re.compile(r"\s?@\s?|\s?[(\[{<]\s?(?:at|@)\s?[)\]}>]\s?|\sat\s", re.IGNORECASE)
DOT = re.compile(r"\s\.\s|\.(?!\s)|\s?[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s?|\sdot\s", re.IGNORECASE)
#: What a candidate holds at least: a mark for at, four small numbers between marks for dots, or six digits with their separators.
TRIGGER = re.compile(r"@|[(\[{<]\s?at\s?[)\]}>]|\sat\s[\w-]{1,64}\s(?:dot\s|\.)|(?<![0-9])[0-9]{1,3}(?:\s?[(\[{<]?\s?(?:\.|dot)\s?[)\]}>]?\s?[0-9]{1,3}){3}|[0-9](?:[\x20().+/_-]{0,2}[0-9]){5,}", re.IGNORECASE)
#: Characters of a segment, at most: longer addresses don't exist.
CHARS = 254
#: What stands around a segment that ends inside a longer name.
GOES_ON, WENT_ON = re.compile(r"\.\w|-\w|\s?[(\[{<]\s?dot|\sdot\s\w", re.IGNORECASE), re.compile(r"(?:\w[.%+-]|dot\s?[)\]}>]\s?|\w\sdot\s)$", re.IGNORECASE)
CUES = {"email": "mail e-mail email contact write address", "ip": "ip host server address", "card": "card visa payment number account", "phone": "phone tel telephone call mobile fax"}
CUE = {w: k for k, v in CUES.items() for w in v.split()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))
    digits = _digits(s)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


#: The longest run of numbers between dots, and the part of an address after its at sign.
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost, not overlapping within a kind; what fails its check is dropped and not tried again."""
    found = []
    if "@" in text:
        found += [("email", s, e) for s, e in _emails(text)]
    if "." in text:
        found += [("ip", s, e) for s, e in _ips(text) if valid("ip", text[s:e])]
    for kind, pattern, need in (("card", CARD, ""), ("phone", PHONE, "+")):
        if need in text:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return found


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of IP: of a run of numbers between dots the first four, the next four, and so on."""
    for m in _CHAIN.finditer(text):
        if m.group().count(".") > 2:
            at = m.start()
            numbers = m.group().split(".")
            for i in range(0, len(numbers) - 3, 4):
                end = at + sum(map(len, numbers[i : i + 4])) + 3
                yield at, end
                at = end + 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL: for each at sign the run of local characters before it and the domain after it."""
    at, upto = text.find("@"), 0
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        upto = m.end() if m else at + 1
        at = text.find("@", upto)


def listed(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


# --- the field ---------------------------------------------------------------

N_SHAPES = 38


def _small_numbers(s: str) -> bool:
    """Whether a segment is four numbers of at most 255 between marks for dots."""
    parts = DOT.split(s)
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)


def segment_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Which of the shape features hold for the whole segment of tokens i..j-1."""
    s = text[tokens[i][0] : tokens[j - 1][1]]
    digits, n = _digits(s), j - i
    marks = set(s) - set("0123456789")
    cue = next((CUE[w] for a, b in reversed(tokens[max(0, i - 2 * AROUND) : i]) if (w := text[a:b].lower()) in CUE), None)
    nd = len(digits)
    letters = any(c.isalpha() for c in s)
    at = AT.search(s) if letters else None
    local, domain = (s[: at.start()], s[at.end() :]) if at else ("", "")
    dots = [m.group() for m in DOT.finditer(s)] if at or s.count(".") > 2 or letters else []
    word = lambda m: m.strip(" ()[]{}<>").isalpha()
    bracketed = lambda m: m.strip()[:1] in tuple("([{<")
    names = [x for side in (local, domain) for x in DOT.split(side)]
    before, after = text[tokens[i][0] - 1 : tokens[i][0]] if tokens[i][0] else "", text[tokens[j - 1][1] : tokens[j - 1][1] + 1]
    flags = (
        True, bool(EMAIL.fullmatch(s)), bool(at) and bool(domain) and all(re.fullmatch(r"[\w%+-]+", x) for x in names) and len(DOT.split(domain)) > 1,
        _small_numbers(s), bool(CARD.fullmatch(s)), 13 <= nd <= 19 and luhn(digits), 13 <= nd <= 19, bool(PHONE.fullmatch(s)), 9 <= nd <= 15, nd < 9, nd > 19,
        s[:1] in "+(", s[:1].isspace() or s[-1:].isspace(), s[-1:] in ".,;:-", "@" in s, letters, s.count(".") == 3, "(" in s and ")" in s, marks <= set(" -") and bool(marks), bool(marks & set("\n\t")),
        cue == "email", cue == "ip", cue == "card", cue == "phone", bool(GOES_ON.match(text, tokens[j - 1][1])), bool(WENT_ON.search(text[max(0, tokens[i][0] - 8) : tokens[i][0]])),
        bool(at) and word(at.group()), bool(at) and bracketed(at.group()), any(word(d) for d in dots), any(bracketed(d) for d in dots), bool(at) and any(re.search(r"\s", x.strip()) for x in names),
        bool(at) and not all(names), bool(at) and bool(AT.search(domain)), before.isdigit() or after.isdigit(), s[:2] == "00", len({m for m in marks if not m.isalnum() and m != " "}) > 2, bool(at) and any(x != x.strip() for x in names), before.isalnum() or after.isalnum(),
    )
    return [k for k, on in enumerate(flags) if on] + [N_SHAPES + (n - 1).bit_length()]


#: Lengths count by powers of two.
WIDTH = N_SHAPES + LONGEST.bit_length()


def windows(text: str, skip: Callable[[int, int], bool] = lambda s, e: False) -> list[tuple[int, int]]:
    """Stretches around what may be part of a span and isn't skipped, each with some context; they don't overlap."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if skip(*m.span()):
            continue
        a, b = max(0, m.start() - 64), min(len(text), m.end() + 64)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def lattice(text: str, a: int, b: int):
    """The tokens of a window and the segments in it that can be of some kind, with their features."""
    tokens = [(a + m.start(), a + m.end()) for m in TOKEN.finditer(text[a:b])]
    kind = ["s" if text[s].isspace() else "d" if "0" <= text[s] <= "9" else "w" if text[s].isalnum() or text[s] == "_" else "p" for s, _ in tokens]
    digits = [0, *np.cumsum([e - s if k == "d" else 0 for k, (s, e) in zip(kind, tokens, strict=True)]).tolist()]
    letters = [0, *np.cumsum([k == "w" for k in kind]).tolist()]
    ats = [m.start() for m in AT.finditer(text, a, b)]
    # White space that is no part of a mark stands in no address.
    marked = {x for mark in (AT, DOT) for m in mark.finditer(text, a, b) for x in range(m.start(), m.end()) if text[x].isspace()}
    apart = [0, *np.cumsum([k == "s" and not all(x in marked for x in range(s, min(e, s + CHARS))) for k, (s, e) in zip(kind, tokens, strict=True)]).tolist()]
    segments = []
    for i, (s, _) in enumerate(tokens):
        if kind[i] == "s" or (kind[i] == "p" and text[s] not in "+("):
            continue
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            e, nd, plain = tokens[j - 1][1], digits[j] - digits[i], letters[j] == letters[i]
            if e - s > CHARS:
                break
            if kind[j - 1] not in "wd":
                continue
            # Ingredients by running sums first; what is left gets its features.
            named = apart[j] == apart[i] and bisect_left(ats, e) - bisect_right(ats, s) == 1
            if (named or (plain and 9 <= nd <= 19) or 4 <= nd <= 12) and any(possible(text[s:e], nd, plain, named)):
                segments.append((i, j, segment_features(text, tokens, i, j)))
    return tokens, segments


#: What numbers of cards and phones are written with.
_NUMERIC = re.compile(r"[0-9\s().+/_-]+")


def possible(s: str, digits: int, plain: bool, named: bool) -> list[bool]:
    """By kind, whether a segment has the ingredients: a mark for at with something around it and a mark for dot after it, four numbers, digits enough."""
    email = False
    if named and (m := AT.search(s)) and 0 < m.start() and m.end() < len(s):
        d = DOT.search(s, m.end())
        # "at" between words before an ordinary dot is plain prose.
        email = bool(d) and d.start() > m.end() and d.end() < len(s) and not (m.group().strip().isalpha() and d.group().strip() == ".")
    number = plain and digits >= 9 and bool(_NUMERIC.fullmatch(s))
    return [email, 4 <= digits <= 12 and not named and _small_numbers(s), number and 13 <= digits <= 19, number and digits <= 15]


def _can(features: list[int]) -> list[bool]:
    """By kind, from the features: what ``possible`` says of the segment again."""
    on = set(features)
    named = bool(on & {1, 2, 14, 26, 27}) and 15 in on
    return [named, 3 in on, 6 in on and 15 not in on, 8 in on and 15 not in on]


def segment_scores(segments, weights: np.ndarray) -> np.ndarray:
    scores = [np.where(_can(f), weights[:, f].sum(axis=1), -np.inf) for _, _, f in segments]
    return np.array(scores).reshape(-1, len(KINDS))


def decode(n: int, segments, scores: np.ndarray) -> list[tuple[int, int, int]]:
    """The best choice of disjoint segments and their kinds; a token outside scores 0."""
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    by_end: dict[int, list[int]] = {}
    for x, (_, j, _) in enumerate(segments):
        by_end.setdefault(j, []).append(x)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for x in by_end.get(j, ()):
            k = int(scores[x].argmax())
            if (total := best[segments[x][0]] + scores[x][k] - MARGIN) > best[j]:
                best[j], back[j] = total, (x, k)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            x, k = back[j]
            out.append((segments[x][0], j, k))
            j = segments[x][0]
    return out


def expectations(n: int, spans: list[tuple[int, int]], odds: list[float]) -> list[float]:
    """For each segment the factor that turns its own odds, exp(score), into its marginal probability.

    ``odds`` are summed over the kinds; forward and backward sums run over the
    tokens, each either outside (odds 1) or in one segment.
    """
    forward, backward = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    for x, (i, j) in enumerate(spans):
        ends[j].append(x)
        starts[i].append(x)
    for j in range(1, n + 1):
        forward[j] = forward[j - 1] + sum(forward[spans[x][0]] * odds[x] for x in ends[j])
    for i in range(n - 1, -1, -1):
        backward[i] = backward[i + 1] + sum(backward[spans[x][1]] * odds[x] for x in starts[i])
    return [forward[i] * backward[j] / forward[n] for i, j in spans]


#: How a span of a kind may be disguised; the field learns these beside the plain forms.
DISGUISES = {
    "email": (lambda s: s.replace("@", " (at) "), lambda s: s.replace("@", " [at] ").replace(".", " [dot] "), lambda s: s.replace("@", " at ").replace(".", " dot ")),
    "ip": (lambda s: s.replace(".", "[.]"), lambda s: s.replace(".", " dot ")),
    "card": (lambda s: ".".join(re.findall("[0-9]{1,4}", _digits(s))), lambda s: "  ".join(re.findall("[0-9]{1,4}", _digits(s)))),
    "phone": (lambda s: "00" + s[1:],),
}


#: What looks much like a span of a kind and is none; the field learns to leave it.
DECOYS = {
    "email": (lambda s: s.replace("@", " at ").replace(".", " "), lambda s: "@" + s.split("@")[0]),
    "ip": (lambda s: s.replace(".", " "), lambda s: "7" + s.replace(".", ".9")),
    "card": (lambda s: _digits(s)[:-1] + str((int(s[-1]) + 1) % 10), lambda s: " ".join(re.findall("[0-9]{1,6}", _digits(s)[:-1] + str((int(s[-1]) + 3) % 10)))),
    "phone": (lambda s: _digits(s), lambda s: " ".join(re.findall("[0-9]{1,5}", _digits(s) * 4))),
}


def examples_of(text: str) -> Iterator[tuple[str, dict[tuple[int, int], int]]]:
    """The surroundings of each base span as they are, with the span disguised in two of its kind's forms, and with a decoy."""
    for n, (kind, s, e) in enumerate(base_spans(text)):
        before, after = text[max(0, s - 60) : s], text[e : e + 60]
        plain = before + text[s:e] + after
        yield plain, {(a, b): KINDS.index(k) for k, a, b in base_spans(plain)}
        forms = DISGUISES[kind]
        k = KINDS.index(kind)
        for make in dict.fromkeys((forms[n % len(forms)], forms[(n + 1) % len(forms)])):
            form = make(text[s:e])
            gold = {(a, b): KINDS.index(x) for x, a, b in base_spans(before + form + after) if b <= len(before) or a >= len(before) + len(form)}
            yield before + form + after, gold | {(len(before), len(before) + len(form)): k}
        form = DECOYS[kind][n % 2](text[s:e])
        yield before + form + after, {(a, b): KINDS.index(x) for x, a, b in base_spans(before + form + after)}


def fit(texts: list[str], rounds: int = 300, rate: float = 2.0, decay: float = 1e-3) -> np.ndarray:
    """Weights by kind and feature, by gradient ascent on the likelihood of the examples."""
    spans, sizes, features, golds = [], [], [], []
    for text in texts:
        for example, gold in examples_of(text):
            for a, b in windows(example):
                tokens, segments = lattice(example, a, b)
                if segments:
                    sizes.append(len(tokens))
                    spans.append([(i, j) for i, j, _ in segments])
                    features += [f for _, _, f in segments]
                    golds += [gold.get((tokens[i][0], tokens[j - 1][1]), -1) for i, j, _ in segments]
    weights = np.zeros((len(KINDS), WIDTH))
    weights[:, 0] = -2.0
    if not sizes:
        return weights
    on = np.zeros((len(features), WIDTH))
    can = np.zeros((len(features), len(KINDS)))
    for x, f in enumerate(features):
        on[x, f] = 1
        can[x] = _can(f)
    truth = np.zeros((len(features), len(KINDS)))
    hit = np.flatnonzero(np.array(golds) >= 0)
    truth[hit, np.array(golds)[hit]] = 1
    seen = on.T @ truth
    squares = np.full_like(weights, 1e-8)
    for _ in range(rounds):
        odds = np.exp(np.clip(on @ weights.T, -30, 30)) * can
        total, factor, at = odds.sum(axis=1).tolist(), [], 0
        for n, own in zip(sizes, spans, strict=True):
            factor += expectations(n, own, total[at : at + len(own)])
            at += len(own)
        slope = ((seen - on.T @ (odds * np.array(factor)[:, None])) / len(sizes)).T - decay * weights
        squares += slope**2
        weights += rate * slope / np.sqrt(squares) / 4
    return weights


def added_spans(text: str, base: list[tuple[str, int, int]], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """What the field finds that touches no base span."""
    out, starts, ends = [], [], []
    for s, e in sorted((s, e) for _, s, e in base):  # united where they overlap
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    touched = lambda s, e: bisect_right(ends, s) < bisect_left(starts, e)
    for a, b in windows(text, touched):
        tokens, segments = lattice(text, a, b)
        for i, j, k in decode(len(tokens), segments, segment_scores(segments, weights)):
            s, e = tokens[i][0], tokens[j - 1][1]
            if not touched(s, e):
                out.append((KINDS[k], s, e))
    return out


def _run(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                more = added_spans(text, base, weights)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return run


def personal_data(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are of the base spans; ``spans`` has those and the
    field's. Positions are code points, ends exclusive. The field is fitted on at
    most ``sample`` texts of at most 20,000 bytes that hold an at sign, a plus sign
    or six digits in a row, those with the smallest hashes; every row is searched whole. Null and empty texts have no spans;
    repeated rows get the same result each. An empty table gives no rows. Nothing
    but the sample leaves the tasks, and other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    likely = rows.where(F.col("text").rlike(r"[@+]|[0-9]{6}") & (F.octet_length("text") <= 20_000)).select("text", F.xxhash64(F.lit(5), "text").alias("h"))
    # Tasks send hashes only; then one text for each of the smallest comes to the driver.
    smallest = [r.h for r in likely.select("h").distinct().orderBy("h").limit(sample).collect()]
    chosen = [r.text for r in likely.where(F.col("h").isin(smallest)).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()] if smallest else []
    weights = fit(chosen)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_run(weights), f"doc_id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
