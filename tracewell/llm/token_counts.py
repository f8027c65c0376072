"""Token counts with overlap resynchronisation.

Long texts are encoded in chunks that overlap. In the overlap both encodings have
token offsets; they are spliced at the first offset that both have and that is proven
stable: no piece of the vocabulary holds the characters on its two sides in a row, so
no merge ever crosses it and the tokens on either side don't depend on the other.
Where an overlap has no such offset, it is widened, up to the rest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

CHUNK, OVERLAP = 8192, 128


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = set()
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i)
            inner.update(a + b for a, b in zip(piece, piece[1:], strict=False))
    return model, frozenset(inner)


def _offsets(model, text: str) -> list[int]:
    """Where each token of ``text`` ends, in characters; -1 inside a character that falls back to bytes.

    The normaliser of these models maps characters one to one and puts one space in
    front, so pieces are as long as the text they stand for.
    """
    ends, at, held, left = [], -1, 0, 0
    for piece in model.encode(text, out_type=str):
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            byte = int(piece[3:5], 16)
            if left == 0:
                left = 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                held = left
            left -= 1
            if left == 0 and held:
                at += 1
                ends.append(at)
            else:
                ends.append(-1)
            continue
        at += len(piece)
        ends.append(at)
    return ends


def count_tokens(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """Tokens of a whole text, the chunks it took and how often an overlap had to be widened."""
    model, inner = _model(path)
    n = len(text)
    if n <= chunk + overlap:
        return len(model.encode(text)), 1, 0
    total, chunks, widened = 0, 0, 0
    start, skip = 0, 0  # this chunk's text begins at start; its tokens up to skip belong to the chunk before
    while True:
        width = overlap
        stop = min(n, max(start + chunk, skip + 1))
        while True:
            end = min(n, stop + width)
            ends = _offsets(model, text[start:end])
            chunks += 1
            if end == n:
                break
            # The next chunk begins at ``stop``; encode what both see and find where they agree.
            here = {start + e for e in ends if e > 0}
            there = _offsets(model, text[stop:end])
            meet = next((p for e in there if (p := stop + e) in here and stop < p < end and text[p - 1 : p + 1].replace(" ", "▁") not in inner), None)
            if meet is not None:
                break
            width, widened = width * 4, widened + 1
        upto = n if end == n else meet
        # Tokens from skip to upto; those inside a character count with the end of it.
        at = 0
        pending = 0
        for e in ends:
            pending += 1
            if e >= 0:
                at = start + e
                if skip < at <= upto or (start == 0 and at <= upto):
                    total += pending
                pending = 0
        if end == n:
            return total, chunks, widened
        start, skip = stop, meet


def _run(path: str, limit: int, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _model(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found: list = [None] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk + overlap]
            for i, ids in zip(short, model.encode([texts[i] for i in short], num_threads=1), strict=True):
                found[i] = (len(ids), 1, 0)
            found = [f or count_tokens(t, path, chunk, overlap) for f, t in zip(found, texts, strict=True)]
            tokens = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), tokens, pa.array([f[0] > limit for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "chunks", "widened"],
            )

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, chunks, widened.

    Null and empty texts have no bytes and no tokens. Texts of any length are
    counted whole; a task holds one batch of rows and the encoding of one chunk.
    Rows stay in place: nothing is shuffled, and repeated rows or ids are no matter.
    An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_run(model_path, limit, chunk, overlap), f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean, chunks int, widened int")
