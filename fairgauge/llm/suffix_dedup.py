"""Removal of repeated 200-byte strings by hashes of windows on a difference cover, in place of a suffix sort.

Only whether prefixes of ``least`` (200) bytes are equal matters, not their order. So no lexicographic order is made, there
is no recursion on names and no merge by the sample's ranks, and bytes are not compared: what is sorted are 32- and
96-bit hashes of windows of 68 and 200 bytes.

1. Sampled tuples. Positions whose place in the document, modulo a period of 133, lies in a difference cover are named by
   a hash of the 68 (``least`` - period + 1) bytes that start there; names are sorted, and equal neighbours are repeated. For any
   two positions some shift below the period takes both into the sample, so two equal 200-byte strings hold a pair
   of sampled tuples of one name: a position with no repeated name in its next 133 places is unique.
2. Remaining positions. The others are sorted by a hash of their 200-byte prefix, and equal neighbours are repeated.
3. Bytes covered by a repeated prefix are removed.

The sorts are distributed: distinct texts are dealt into blocks by their SHA-256, a block names its tuples and sends
each bucket of the name space the sorted distinct names it holds, a bucket answers with one bit a name (held by
another block or not). A name held a billion times is thus sent once by each block. Names of step 1 are 32 bits
within a bucket (a false match only keeps a position for step 2). Prefixes of step 2 are compared by 96 bits, within a
bucket that further bits choose: two polynomials modulo 2^61 - 1 (``hashes``) at bases drawn anew in each run.
Two different prefixes agree in both whole hashes for at most 200^2 of the 2^122 pairs of bases, whatever their bytes are, and no text can be
made for bases that are not drawn yet. Bytes themselves are not compared.

Equal texts are one text with a count: a text of 200 bytes or more with a copy is removed whole. Only keys, answers
and counts are joined back; texts are read from the input in each of the three passes and never written.

Cases: a null text is empty; a text under 200 bytes is kept; repeated rows are copies; matches never cross documents;
an empty table gives an empty result; other columns are ignored unless named in ``carry``. A task holds one block
(``BLOCK_BYTES``, or one document if that is longer)."""
from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgauge.llm.common import carried, cut
from fairgauge.llm.exchange import (SENT, Names, answered, batch, bucket_of, by_block, dealt, int_key, order_of, send,
                                    text_rows)
from fairgauge.llm.hashes import Polynomial, drawn

#: Columns of the result; a carried column called like one of them gets underscores.
RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

BLOCK_BYTES = 12 << 20
#: Names a bucket is sized for.
BUCKET_NAMES = 2_000_000
#: Starts hashed at once.
STRETCH = 1 << 17
#: The difference cover has ORDER + 1 places modulo ORDER * ORDER + ORDER + 1 (12 of 133).
ORDER = 11


_LOST = "key binary, n_removed long, n_spans long, kept_sha256 string"


def difference_cover(q: int) -> list[int]:
    """q + 1 places modulo q * q + q + 1 (q prime) whose differences are each residue once: the powers of a generator of
    the field of q ** 3 elements that lie in a plane."""
    n = q * q + q + 1
    for a, b, c in product(range(q), repeat=3):                                 # x ** 3 = a x ** 2 + b x + c
        places, (s0, s1, s2) = [], (1, 0, 0)
        for i in range(n):
            if s2 == 0:
                places.append(i)
            s0, s1, s2 = c * s2 % q, (s0 + b * s2) % q, (s1 + a * s2) % q
        if len(places) == q + 1 and len({(x - y) % n for x in places for y in places}) == n:
            return places
    raise ValueError("q must be prime")


class WindowHash:
    """64-bit hashes of all windows of a byte array."""

    def __init__(self, seed: int, length: int):
        self.length = length
        self.hash = Polynomial(np.random.default_rng(seed), STRETCH + length)

    def at(self, data: np.ndarray, first: int, starts: np.ndarray) -> np.ndarray:
        """Hashes of ``data[s:s + length]`` for the ascending ``starts``, all in [first, first + STRETCH)."""
        s = starts - first
        return self.hash.windows(data[first:first + STRETCH + self.length], s, s + self.length)


class Block:
    """Distinct texts of one block, in key order, as one byte array."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def stretches(self):
        """``(first, offset in document, bytes to the document's end)`` of the starts, a stretch at a time."""
        for first in range(0, len(self.data), STRETCH):
            last = min(first + STRETCH, len(self.data))
            a, b = np.searchsorted(self.ends, first, "right"), np.searchsorted(self.begins, last, "left")
            inside = np.minimum(self.ends[a:b], last) - np.maximum(self.begins[a:b], first)
            place = np.arange(first, last)
            yield first, place - np.repeat(self.begins[a:b], inside), np.repeat(self.ends[a:b], inside) - place

    def sampled(self, hasher: WindowHash, in_cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions and their names."""
        at, names = [], []
        for first, offset, left in self.stretches():
            s = first + np.flatnonzero(in_cover[offset % len(in_cover)] & (left >= hasher.length))
            at.append(s)
            names.append(hasher.at(self.data, first, s))
        return np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(names or [np.zeros(0, np.uint64)])

    def candidates(self, repeated: np.ndarray, period: int, least: int) -> np.ndarray:
        """Positions with a repeated sampled position in the next ``period`` places and ``least`` bytes left."""
        n = len(self.data)
        near = np.zeros(n + 1, np.int32)
        np.add.at(near, np.maximum(repeated - period + 1, 0), 1)
        np.add.at(near, repeated + 1, -1)
        live = np.cumsum(near[:n]) > 0
        out = []
        for first, _, left in self.stretches():
            out.append(first + np.flatnonzero(live[first:first + len(left)] & (left >= least)))
        return np.concatenate(out or [np.zeros(0, np.int64)])

    def prefixes(self, hashers: tuple[WindowHash, WindowHash], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = [], []
        cuts = np.searchsorted(starts, np.arange(0, len(self.data) + STRETCH, STRETCH))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for o, hasher in zip(out, hashers):
                if b > a:
                    o.append(hasher.at(self.data, k * STRETCH, starts[a:b]))
        return tuple(np.concatenate(o or [np.zeros(0, np.uint64)]) for o in out)


def _marked(names: Names, answers: dict[int, bytes]) -> np.ndarray:
    """Whether each position's name is held elsewhere too."""
    held = names.twice.copy()
    for k, bits in answers.items():
        a, b = names.bounds[k], names.bounds[k + 1]
        held[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return held[names.number]


def _shared(bucket, blocks, bodies):
    """The answer to a row of names of step 1: a bit a name, set if another block's row holds it too."""
    bodies = [np.frombuffer(body, "<u4") for body in bodies]
    everything = np.sort(np.concatenate(bodies))
    twice = everything[1:][everything[1:] == everything[:-1]]                   # names are distinct within a block
    for block, own in zip(blocks, bodies if len(twice) else ()):
        at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
        if (hit := twice[at] == own).any():
            yield block, 0, int_key(bucket), np.packbits(hit).tobytes()


def _shared_wide(bucket, blocks, bodies):
    """The same for the names of step 2: first all their 64 bits, then all their further 32."""
    sizes = [len(body) // 12 for body in bodies]
    name = np.concatenate([np.frombuffer(body, "<u8", n) for body, n in zip(bodies, sizes)])
    more = np.concatenate([np.frombuffer(body, "<u4", n, 8 * n) for body, n in zip(bodies, sizes)])
    order = order_of(name)
    if (more[order][1:] != more[order][:-1])[name[order][1:] == name[order][:-1]].any():
        order = np.lexsort((more, name))                                        # equal in 64 bits, different in the rest
    again = (name[order][1:] == name[order][:-1]) & (more[order][1:] == more[order][:-1])
    if again.any():
        held = np.zeros(len(name), bool)
        held[order[1:]] = again
        held[order[:-1]] |= again
        for block, hit in zip(blocks, np.split(held, np.cumsum(sizes)[:-1])):
            if hit.any():
                yield block, 1, int_key(bucket), np.packbits(hit).tobytes()


def _notes(starts: np.ndarray) -> bytes:
    """Ascending positions as runs (first, length)."""
    if not len(starts):
        return b""
    new = np.r_[0, np.flatnonzero(np.diff(starts) != 1) + 1]
    return np.stack([starts[new], np.diff(np.r_[new, len(starts)])]).astype("<i8").tobytes()


def _noted(body: bytes) -> np.ndarray:
    first, n = np.frombuffer(body, "<i8").reshape(2, -1)
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def removals(texts: DataFrame, total_bytes: int, least: int = 200, order: int = ORDER, seed: int | None = None,
             block_bytes: int = BLOCK_BYTES, bucket_names: int = BUCKET_NAMES) -> DataFrame:
    """``key, n_removed, n_spans, kept_sha256`` of the distinct ``texts(key, body, n)`` that lose any byte to another
    place of the distinct texts."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seed = drawn() if seed is None else seed
    cover, period = difference_cover(order), order * order + order + 1
    length = least - period + 1
    if length < 16:
        raise ValueError("the period must leave tuples of at least 16 bytes")
    in_cover = np.isin(np.arange(period), cover)
    blocks = max(1, -(-total_bytes // block_bytes))
    name_buckets = max(4 * parts, total_bytes * len(cover) // period // bucket_names)
    prefix_buckets = max(4 * parts, total_bytes // bucket_names)

    rows = text_rows(texts, blocks)

    def block_names(block: Block) -> tuple[np.ndarray, Names]:
        at, h = block.sampled(WindowHash(seed, length), in_cover)
        return at, Names(bucket_of(h, name_buckets), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), name_buckets)

    def block_prefixes(block: Block, starts: np.ndarray) -> Names:
        h1, h2 = block.prefixes((WindowHash(seed + 1, least), WindowHash(seed + 2, least)), starts)
        return Names(bucket_of(h1, prefix_buckets), h2, prefix_buckets, (h1 & np.uint64(0xFFFFFFFF)).astype(np.uint32))

    def packed(names: Names):
        for bucket, a, b in names.sent():
            yield bucket, names.values[a:b].tobytes() + names.more[a:b].tobytes()

    def send_names(batches):
        return send(batches, lambda got: packed(block_names(Block(list(got.texts.values())))[1]))

    def send_prefixes(batches):
        def work(got):
            block = Block(list(got.texts.values()))
            at, names = block_names(block)
            starts = block.candidates(at[_marked(names, got.answers.get(0, {}))], period, least)
            yield from packed(block_prefixes(block, starts))
            yield -1 - int.from_bytes(next(iter(got.texts))[:2], "big"), _notes(starts)
        return send(batches, work)

    def remove(batches):
        for _, got in by_block(batches):
            block, out = Block(list(got.texts.values())), []
            starts = _noted(got.notes)
            if len(starts):
                starts = starts[_marked(block_prefixes(block, starts), got.answers.get(1, {}))]
            edge = np.zeros(len(block.data) + 1, np.int32)
            edge[starts] += 1
            edge[starts + least] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            for key, a, b in zip(got.texts, block.begins, block.ends):
                own = gone[a:b]
                if own.any():
                    spans = int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1]))
                    out.append((key, int(own.sum()), spans, hashlib.sha256(block.data[a:b][~own].tobytes()).hexdigest()))
            if out:
                yield batch(out, _LOST)

    names = cut(answered(dealt(parts, rows).mapInArrow(send_names, SENT), parts, _shared), "names")
    prefixes = cut(answered(dealt(parts, rows, names).mapInArrow(send_prefixes, SENT), parts, _shared_wide), "prefixes")
    return dealt(parts, rows, prefixes).mapInArrow(remove, _LOST)


def dedup(docs: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text",
          carry: list[str] | None = None, **options) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``carry``."""
    carry = carry or []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"),
                        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    keyed = cut(keyed, "keys")
    long_enough = keyed.where(F.col("n_bytes") >= least)
    total = long_enough.agg(F.sum("n_bytes")).first()[0] or 0
    texts = docs.select(text.alias("t")).where(F.octet_length("t") >= least).select(
        F.unhex(F.sha2("t", 256)).alias("key"), F.col("t").cast("binary").alias("body"), F.lit(1).cast("long").alias("n"))
    changed = cut(removals(texts, total, least, **options), "removed")
    changed = changed.select(F.lower(F.hex("key")).alias("_sha"), "n_removed", "n_spans", "kept_sha256")
    copied = cut(long_enough.groupBy("sha").count().where("count > 1").select(F.col("sha").alias("_copied")), "copied")
    found = keyed.join(changed, keyed["sha"] == changed["_sha"], "left")
    found = found.join(copied, found["sha"] == copied["_copied"], "left")
    whole, none = F.col("_copied").isNotNull(), F.col("n_removed").isNull()
    return found.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *[F.col(f"_c{carry.index(c)}").alias(n) for c, n in carried(carry, RESULT).items()])
