"""Packing by power-of-two decomposition.

A document's token ids (and its end id) are split into pieces whose lengths are powers of two, longest first: as many
pieces of ``max_len`` as fit, then the binary digits of the rest. Every piece is a sequence of its own, so no sequence
crosses documents and none needs padding; pieces of one length form a bucket that a trainer reads in batches of equal
length.

Token ids come from the byte-level vocabulary at ``vocabulary`` (ranks; the ids equal those of the JSON file of the
same vocabulary). Text between gaps is encoded once and remembered per worker, which changes no id: in this
tokenizer no token spans a change from other characters to white space.

``sequence_id`` is the input partition's number and the piece's place in it, unique over the result. It is fixed as
long as the input's partitions are (a scan, or a table written by ``common.cut``); no shuffle is needed to pack.

Cases: a null or empty text is the end id alone (one piece of length 1); a text may be of any length, since its pieces
are emitted as they are made; repeated rows are packed each for itself; an empty table gives an empty result; other
columns are ignored unless named in ``carry``."""
from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgauge.llm.common import carried

#: Columns of the result; a carried column called like one of them gets underscores.
RESULT = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

END_ID = 1
#: Remembered pieces of text per worker; when full, the memory starts anew (ids do not depend on it).
MEMO_ENTRIES = 300_000
#: Bytes of ids after which an Arrow batch is handed on.
FLUSH_BYTES = 8 << 20


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as bytes."""

    _UNSAFE = re.compile(r"[\s\x1c-\x1f\x85] ")

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                        special_tokens={}).encode_ordinary
        self.memo: dict[str, bytes] = {}

    def _one(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        # A space after white space is encoded with it; then the text is encoded as a whole.
        if self._UNSAFE.search(text):
            return self._one(text)
        memo, out = self.memo, []
        first, *rest = text.split(" ")
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        for piece in ([first] if first else []) + [" " + r for r in rest]:
            ids = memo.get(piece)
            if ids is None:
                ids = self._one(piece)
                if len(piece) <= 64:
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)


def binary_pieces(n: int, max_len: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens: full lengths first, then the binary digits of the rest."""
    out, at = [], 0
    while n - at >= max_len:
        out.append((at, max_len))
        at += max_len
    size = max_len
    while at < n:
        size //= 2
        if n - at >= size:
            out.append((at, size))
            at += size
    return out


def pack(docs: DataFrame, max_len: int = 2048, vocabulary: str | None = None, id_col: str = "doc_id",
         text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` and the document's ``carry`` columns.

    ``ids`` is binary, 4 little-endian bytes an id; ``length`` is also the bucket."""
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = vocabulary or vocabulary_path()
    carry = carry or []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + (
        ", start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")

    def run(batches):
        encoder, made = None, TaskContext.get().partitionId() << 33
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            encoder = encoder or Encoder(path)
            texts, others = batch.column("text"), batch.select([f.name for f in kept])
            row, start, length, total, held, size = [], [], [], [], [], 0

            def flush():
                n = len(row)
                columns = {f.name: others.column(f.name).take(pa.array(row, pa.int32())) for f in kept}
                return pa.RecordBatch.from_pydict(columns | {
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                    "doc_tokens": pa.array(total, pa.int64()),
                    "sequence_id": pa.array(np.arange(made, made + n, dtype=np.int64)),
                    "offset": pa.array(np.zeros(n, np.int64)), "ids": pa.array(held, pa.binary())})

            for i in range(batch.num_rows):
                ids = encoder(texts[i].as_py() or "") + end
                n = len(ids) // 4
                for s, k in binary_pieces(n, max_len):
                    row.append(i); start.append(s); length.append(k); total.append(n)
                    held.append(ids[4 * s:4 * (s + k)])
                    size += 4 * k
                    if size >= FLUSH_BYTES:
                        yield flush()
                        made += len(row)
                        row, start, length, total, held, size = [], [], [], [], [], 0
            yield flush()
            made += len(row)

    out = rows.mapInArrow(run, schema)
    return out.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids",
                      *[F.col(f"_c{carry.index(c)}").alias(n) for c, n in carried(carry, RESULT).items()])


def write_buckets(packed: DataFrame, path: str) -> None:
    """The pieces as Parquet, one folder per bucket of equal lengths."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
