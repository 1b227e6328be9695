"""Questions from blocks of texts to buckets of a name space, and the answers back, as two shuffles of packed rows.

Distinct texts are dealt into blocks by their SHA-256; a block's texts, sorted by that key, are the same in any run,
so a block can be made anew whenever an answer for it arrives. A block sends each bucket the sorted distinct names it
holds (one row a block and bucket); a bucket sees a name at most once from each block, however often it occurs."""
from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows for blocks. Kind 2 is a text (key: its SHA-256, body: its bytes, n: copies counted); the other kinds are
#: answers (key: the bucket) and what a block has noted for itself.
ROW = "block long, kind int, key binary, body binary, n long"
SENT = "bucket long, block long, body binary"
TEXT = 2
NOTE = -1


def int_key(k: int) -> bytes:
    return int(k).to_bytes(8, "big")


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash, by its upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], list(names))


def _rows(batches, names: tuple[str, ...]):
    for b in batches:
        columns = [b.column(c) for c in names]
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def text_rows(texts: DataFrame, blocks: int) -> DataFrame:
    """``texts(key, body, n)`` as rows for blocks; copies within a task are added up before the shuffle."""
    def once(batches):
        seen: dict[bytes, list] = {}
        for b in batches:
            for key, body, n in _rows([b], ("key", "body", "n")):
                if key in seen:
                    seen[key][1] += n
                else:
                    seen[key] = [body, n]
            if len(seen) >= 20_000 or sum(len(v[0]) for v in seen.values()) > 64 << 20:
                yield batch([(k, *v) for k, v in seen.items()], "key binary, body binary, n long")
                seen = {}
        if seen:
            yield batch([(k, *v) for k, v in seen.items()], "key binary, body binary, n long")
    return texts.mapInArrow(once, "key binary, body binary, n long").select(
        F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.lit(TEXT).alias("kind"), "key", "body", "n")


def dealt(parts: int, *rows: DataFrame) -> DataFrame:
    """Texts and answers, each block's together and in order."""
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every.repartition(parts, "block").sortWithinPartitions("block", "kind", "key")


class Received:
    """One block's rows: ``texts`` by key (in key order), ``copies`` by key, and ``answers[kind]`` by bucket."""

    def __init__(self, rows):
        self.texts: dict[bytes, bytes] = {}
        self.copies: dict[bytes, int] = {}
        self.notes, self.answers = b"", {}
        for _, kind, key, body, n in rows:
            if kind == TEXT:
                self.texts[key] = body
                self.copies[key] = self.copies.get(key, 0) + n
            elif kind == NOTE:
                self.notes = body
            else:
                self.answers.setdefault(kind, {})[int.from_bytes(key, "big")] = body


def by_block(batches):
    for block, rows in groupby(_rows(batches, ("block", "kind", "key", "body", "n")), itemgetter(0)):
        yield block, Received(rows)


def send(batches, work):
    """Runs ``work(received)`` on each block; the ``(bucket, body)`` it yields go out."""
    for block, received in by_block(batches):
        rows, size = [], 0
        for bucket, body in work(received):
            rows.append((bucket, block, body))
            size += len(body)
            if size > 4 << 20:
                yield batch(rows, SENT)
                rows, size = [], 0
        if rows:
            yield batch(rows, SENT)


def answered(sent: DataFrame, parts: int, work) -> DataFrame:
    """``work(bucket, blocks, bodies)`` on what each bucket was sent; it yields ``(block, kind, key, body)``. Notes
    (negative buckets) pass through to their block."""
    def run(batches):
        for bucket, group in groupby(_rows(batches, ("bucket", "block", "body")), itemgetter(0)):
            if bucket < 0:
                out = [(block, NOTE, b"", body, 0) for _, block, body in group]
            else:
                blocks, bodies = zip(*((block, body) for _, block, body in group))
                out = [(*row, 0) for row in work(bucket, blocks, bodies)]
            if out:
                yield batch(out, ROW)
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, ROW)


def order_of(values: np.ndarray) -> np.ndarray:
    """The order of unsigned integers.  Sorting plain integers is much faster than sorting by key, so positions are packed
    into low bits: behind the values where both fit in 64 bits, else in place of their low bits, which is checked."""
    n = len(values)
    bits = np.uint64(max(1, n.bit_length()))
    v, at, mask = values.astype(np.uint64), np.arange(n, dtype=np.uint64), np.uint64((1 << int(bits)) - 1)
    if n and int(v.max()).bit_length() + int(bits) <= 64:
        return (np.sort((v << bits) | at) & mask).astype(np.int64)
    order = (np.sort((v & ~mask) | at) & mask).astype(np.int64)
    w = v[order]
    return order if (w[1:] >= w[:-1]).all() else np.argsort(v, kind="stable")


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and each value's number among them."""
    order = order_of(values)
    v = values[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    number = np.empty(len(v), np.int64)
    number[order] = np.cumsum(new) - 1
    return v[new], number


def in_order(bucket: np.ndarray, name: np.ndarray, buckets: int) -> np.ndarray:
    """The order of (bucket, name)."""
    order = order_of(name)
    small = bucket.astype(np.uint16) if buckets < 1 << 16 else bucket.astype(np.uint32)
    return order[np.argsort(small[order], kind="stable")]


class Names:
    """A block's distinct names in bucket order: what it sends, and which of its positions an answer is for. ``more`` are
    further bits of the names (none by default)."""

    def __init__(self, bucket: np.ndarray, name: np.ndarray, buckets: int, more: np.ndarray | None = None):
        order = in_order(bucket, name, buckets)
        b, v = bucket[order], name[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1])
        if more is not None:
            if ((more[order][1:] != more[order][:-1]) & ~new[1:]).any():
                order = np.lexsort((more, name, bucket))
            m = more[order]
            new[1:] |= m[1:] != m[:-1]
        self.first = np.flatnonzero(new)
        self.values = v[self.first]
        self.more = np.zeros(0, np.uint32) if more is None else m[self.first]
        self.bounds = np.searchsorted(b[self.first], np.arange(buckets + 1, dtype=b.dtype))
        self.number = np.empty(len(order), np.int64)            # distinct name of each position
        self.number[order] = np.cumsum(new) - 1
        self.twice = np.diff(np.r_[self.first, len(order)]) > 1  # held twice in this very block

    def sent(self):
        for k in np.flatnonzero(np.diff(self.bounds)):
            yield int(k), int(self.bounds[k]), int(self.bounds[k + 1])
