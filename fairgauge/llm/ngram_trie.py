"""Language-model scoring with a sharded Elias-Fano n-gram trie.

The model is a bigram model with Dirichlet smoothing: P(w | u) = (c(u, w) + mu * P1(w)) / (c(u) + mu), over the unigram
P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). A text's tokens are its words (ASCII letters lower-cased) and one end token; the
first token's context is the start. The score is the log10 probability of all tokens.

A shard of the trie holds the contexts whose hash falls to it. Its first level is a sequence of pointers (context i's
children are pointers i to i + 1), its second the children's numbers within the shard's vocabulary, each raised by the
largest number of the contexts before so that the level is one monotone sequence; both are stored as Elias-Fano lists
(packed low bits, unary high bits, a count directory). Beside each child is its smoothed probability
c(u, w) / (c(u) + mu), rounded to steps of its logarithm (1/32 of a decade), without a floor. A child is found by successor search: two zero-selects
in the high bits bound the few candidates of one high part, relative to the context's pointers. A shard's bytes are
flat arrays; ``Trie.load`` reads them in place from any buffer, a memory map included.

Training and scoring are two rounds of questions (``exchange``): blocks of distinct texts send their words with their
training counts and learn c(w); then they send their pairs with training counts, shards merge these into the trie,
and answer each pair with its stored step. A context with more than ``SPREAD`` training tokens is spread over several
shards by its followers' hash, so that no word, however frequent, fills a shard. All counts cover all training texts;
nothing is pruned, and what is gathered grows with the corpus. Names are 64-bit hashes within a bucket that an
independent hash chooses; followers within a context are told apart by 48 bits.

Cases: a null or empty text is its end token alone; repeated rows count each; a null id belongs to the training part;
with no training text N and V are 0 and all tokens are equally likely; an empty table gives an empty result; other
columns are ignored."""
from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairgauge.llm.common import cut
from fairgauge.llm.exchange import (SENT, Names, answered, batch, bucket_of, by_block, dealt, distinct, int_key, send,
                                    text_rows)
from fairgauge.llm.hashes import Polynomial, drawn

MU = 500.0
BLOCK_BYTES = 12 << 20
#: Pairs or words a shard is sized for (in bytes of text, roughly).
SHARD_BYTES = 4 << 20
#: Training tokens of a context that one shard takes.
SPREAD = 200_000
#: Stored steps of log10 probability: code k stands for 10 ** (-(k - 1) / STEP); 0 is no child. A shard whose codes all
#: fit (none below 10^-8) keeps one byte each, any other two.
STEP = 254 / 8
_SCORED = "key binary, n_tokens long, n_known long, base_score double, score double"


# -- Elias-Fano lists ---------------------------------------------------------------------------------------------

def _pack_low(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` of each value, end to end in 64-bit words (one spare word behind)."""
    n = len(values)
    out = np.zeros(n * bits // 64 + 2, np.uint64)
    if bits:
        low = values & np.uint64((1 << bits) - 1)
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, low << shift)
        over = shift + np.uint64(bits) > np.uint64(64)
        np.bitwise_or.at(out, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
    return out


class EliasFano:
    """A non-decreasing list of unsigned integers in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self.ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)]      # before each word
        self.zeros = np.arange(len(high) + 1, dtype=np.int64) * 64 - self.ones

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((n + (top >> bits)) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        return cls(n, bits, _pack_low(values, bits), high)

    @staticmethod
    def _in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th (from 0) set bit of each word."""
        place, word, k = np.zeros(len(word), np.int64), word.copy(), k.copy()
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            up = k >= count
            k -= np.where(up, count, 0)
            place += np.where(up, half, 0)
            word = np.where(up, word >> np.uint64(half), word)
        return place

    def select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        return word * 64 + self._in_word(self.high[word], i - self.ones[word])

    def select0(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, i, "right") - 1
        return word * 64 + self._in_word(~self.high[word], i - self.zeros[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        left = (np.uint64(64) - shift) & np.uint64(63)
        over = np.where(shift > 0, self.low[word + 1] << left, np.uint64(0))
        return ((self.low[word] >> shift) | over) & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self.select1(i) - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The index of the first value that is at least x (n if none)."""
        part = (x >> np.uint64(self.bits)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        inside = part <= last
        h = np.minimum(part, last)
        start = np.where(h > 0, self.select0(np.maximum(h - 1, 0)) - np.maximum(h - 1, 0), 0)
        stop = np.minimum(self.select0(h) - h, self.n)
        start = np.minimum(start, stop)
        want = x & np.uint64((1 << self.bits) - 1)
        low, high = start, stop
        live = np.flatnonzero(low < high)
        while len(live):                                                        # among values of one high part
            mid = (low[live] + high[live]) // 2
            less = self._low(mid) < want[live]
            low[live] = np.where(less, mid + 1, low[live])
            high[live] = np.where(less, high[live], mid)
            live = live[low[live] < high[live]]
        return np.where(inside, low, self.n)

    def parts(self) -> list[bytes]:
        return [struct.pack("<qq", self.n, self.bits), self.low.tobytes(), self.high.tobytes()]

    @classmethod
    def load(cls, parts: list) -> "EliasFano":
        n, bits = struct.unpack("<qq", bytes(parts[0]))
        return cls(n, bits, np.frombuffer(parts[1], np.uint64), np.frombuffer(parts[2], np.uint64))


def _join(parts: list[bytes]) -> bytes:
    """Parts behind a table of their sizes, each starting at a multiple of 8 bytes."""
    head = struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts))
    return head + b"".join(p + b"\0" * (-len(p) % 8) for p in parts)


def _parts(body) -> list[memoryview]:
    body = memoryview(body)
    (n,) = struct.unpack_from("<q", body)
    out, at = [], 8 * (n + 1)
    for size in struct.unpack_from(f"<{n}q", body, 8):
        out.append(body[at:at + size])
        at += size + -size % 8
    return out


class Trie:
    """A shard: contexts and vocabulary (sorted hashes), pointers and children as Elias-Fano lists, steps."""

    def __init__(self, contexts, vocabulary, pointers: EliasFano, children: EliasFano, steps):
        self.contexts, self.vocabulary, self.pointers, self.children, self.steps = contexts, vocabulary, pointers, children, steps

    @classmethod
    def of(cls, context: np.ndarray, follower: np.ndarray, count: np.ndarray, probability) -> "Trie":
        """From pairs with training counts (repeats are added up); ``probability(context, count)`` is stored."""
        order = np.lexsort((follower, context))
        c, f = context[order], follower[order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (f[1:] != f[:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(count[order], first) if len(first) else np.zeros(0, np.int64)
        c, f = c[first], f[first]
        contexts, starts = np.unique(c, return_index=True)
        vocabulary, number = np.unique(f, return_inverse=True)
        ends = np.r_[starts[1:], len(c)]
        tops = number[ends - 1] if len(c) else np.zeros(0, np.int64)
        below = np.r_[0, np.cumsum(tops + 1)[:-1]] if len(tops) else np.zeros(0, np.int64)
        raised = number + np.repeat(below, ends - starts)
        p = probability(c, total)
        steps = np.maximum(np.rint(-np.log10(p) * STEP), 0).astype(np.uint16) + np.uint16(1)
        if steps.max(initial=0) < 256:
            steps = steps.astype(np.uint8)
        return cls(contexts, vocabulary, EliasFano.of(np.r_[starts, len(c)]), EliasFano.of(raised), steps)

    def find(self, context: np.ndarray, sizes: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """Steps (0: no child) of the followers; ``context[i]`` has the next ``sizes[i]`` of them."""
        out = np.zeros(len(follower), self.steps.dtype)
        if not len(self.contexts) or not len(follower):
            return out
        i = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        known = self.contexts[i] == context
        first, stop = self.pointers.access(i).astype(np.int64), self.pointers.access(i + 1).astype(np.int64)
        below = np.where(first > 0, self.children.access(np.maximum(first - 1, 0)).astype(np.int64) + 1, 0)
        v = np.minimum(np.searchsorted(self.vocabulary, follower), len(self.vocabulary) - 1)
        ask = np.flatnonzero(np.repeat(known, sizes) & (self.vocabulary[v] == follower))
        owner = np.repeat(np.arange(len(context)), sizes)[ask]
        x = (below[owner] + v[ask]).astype(np.uint64)
        at = self.children.successor(x)
        inside = at < stop[owner]
        hit = np.zeros(len(at), bool)
        hit[inside] = self.children.access(at[inside]) == x[inside]
        out[ask[hit]] = self.steps[at[hit]]
        return out

    def dump(self) -> bytes:
        return _join([self.contexts.tobytes(), self.vocabulary.tobytes(), *self.pointers.parts(), *self.children.parts(),
                      self.steps.tobytes()])

    @classmethod
    def load(cls, body) -> "Trie":
        p = _parts(body)
        children = EliasFano.load(p[5:8])
        return cls(np.frombuffer(p[0], np.uint64), np.frombuffer(p[1], np.uint64), EliasFano.load(p[2:5]), children,
                   np.frombuffer(p[8], np.uint8 if len(p[8]) == children.n else np.uint16))


def step_values() -> np.ndarray:
    """The probability each step stands for."""
    return np.r_[0.0, 10 ** (-np.arange((1 << 16) - 1) / STEP)]


# -- blocks -------------------------------------------------------------------------------------------------------

def _zip(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unzip(body, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(body), kind)


class WordHash:
    """Two independent 64-bit hashes of the words of a byte array (``hashes``); words over ``LONG`` bytes by SHA-256."""

    STRETCH = 1 << 17
    LONG = 1 << 22

    def __init__(self, seed: int):
        self.seed = seed
        self.marks = np.random.default_rng(seed).integers(0, 1 << 63, (2, 2), dtype=np.uint64)   # of the end token and the start

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        out = [np.empty(len(starts), np.uint64) for _ in range(2)]
        for i in np.flatnonzero(ends - starts > self.LONG):
            digest = hashlib.sha256(data[starts[i]:ends[i]].tobytes()).digest()
            for o, h in zip(out, struct.unpack_from("<QQ", digest)):
                o[i] = h
        short = np.flatnonzero(ends - starts <= self.LONG)
        starts, ends = starts[short], ends[short]
        reach = self.STRETCH + int((ends - starts).max(initial=0))
        hashes = [Polynomial(np.random.default_rng(self.seed + 1 + k), reach) for k in range(2)]
        i = 0
        while i < len(starts):
            a = int(starts[i])
            j = max(i + 1, int(np.searchsorted(starts, a + self.STRETCH)))
            part, s, e = data[a:int(ends[j - 1])], starts[i:j] - a, ends[i:j] - a
            for o, h in zip(out, hashes):
                o[short[i:j]] = h.windows(part, s, e)
            i = j
        return out


class Tokens:
    """A block's tokens as numbers of its own vocabulary, words in the order of their hash; START is the last number.

    Words are runs of anything but ASCII white space in the bytes, ASCII letters lower-cased; each text's last token is
    the end."""

    def __init__(self, texts, copies, seed: int):
        texts, hasher = [bytes(t).lower() for t in texts], WordHash(seed)
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        inside = np.zeros(len(data) + 1, bool)
        np.logical_not((data == 32) | ((data >= 9) & (data <= 13)), out=inside[1:])
        change = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = change[0::2], np.r_[change[1::2], len(data)][:len(change[0::2])]
        own, spread = hasher(data, starts, ends)
        bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.sizes = np.bincount(np.searchsorted(bounds, starts, "right"), minlength=len(texts)).astype(np.int64) + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.weight = np.repeat(np.fromiter(copies, np.int64, len(texts)), self.sizes)
        last = np.zeros(int(self.sizes.sum()), bool)
        last[self.starts + self.sizes - 1] = True
        every = [np.empty(len(last), np.uint64) for _ in range(2)]
        for k, h in enumerate((own, spread)):
            every[k][~last] = h
            every[k][last] = hasher.marks[0, k]
        names, self.ids = distinct(every[0])
        other = np.zeros(len(names), np.uint64)
        other[self.ids] = every[1]
        self.own, self.spread = np.r_[names, hasher.marks[1, 0]], np.r_[other, hasher.marks[1, 1]]
        self.start = len(names)
        self.end = int(np.searchsorted(names, hasher.marks[0, 0]))

    def words(self, buckets: int) -> Names:
        return Names(bucket_of(self.spread[:-1], buckets), self.own[:-1], buckets)

    def contexts(self) -> np.ndarray:
        before = np.r_[self.start, self.ids[:-1]]
        before[self.starts] = self.start
        return before


class Pairs:
    """A block's distinct (context, token) pairs in the order of shard, context hash and token hash."""

    def __init__(self, t: Tokens, counts: np.ndarray, shards: int, spread: int):
        width = max(1, len(t.own).bit_length())
        keys, inverse = distinct(((t.contexts() << width) | t.ids).astype(np.uint64))
        u, w = (keys >> np.uint64(width)).astype(np.int64), (keys & np.uint64((1 << width) - 1)).astype(np.int64)
        splits = (1 + counts // spread).astype(np.uint64)[u]
        place = t.spread[u] + (t.spread[w] % splits) * np.uint64(0x9E3779B97F4A7C15)
        place = np.where(splits > 1, (place ^ (place >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9), place)
        shard = bucket_of(place, shards)
        small = shard.astype(np.uint16) if shards < 1 << 16 else shard.astype(np.uint32)
        order = np.argsort(small, kind="stable")
        self.u, self.w = u[order], w[order]
        place_of = np.empty(len(order), np.int64)
        place_of[order] = np.arange(len(order))
        self.inverse = place_of[inverse]
        self.bounds = np.searchsorted(shard[order], np.arange(shards + 1, dtype=shard.dtype))
        self.train = np.bincount(self.inverse, t.weight, len(keys)).astype(np.int64)


def _follower(own: np.ndarray) -> np.ndarray:
    return own >> np.uint64(16)


def _six(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(body) -> np.ndarray:
    raw = np.frombuffer(body, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").reshape(-1)


def _sent_pairs(t: Tokens, counts: np.ndarray, pairs: Pairs):
    for shard in np.flatnonzero(np.diff(pairs.bounds)):
        a, b = pairs.bounds[shard], pairs.bounds[shard + 1]
        u = pairs.u[a:b]
        first = np.r_[0, np.flatnonzero(u[1:] != u[:-1]) + 1]
        held = u[first]
        yield int(shard), _join([t.own[held].tobytes(), _zip(counts[held]), _zip(np.diff(np.r_[first, len(u)])),
                                 _six(_follower(t.own[pairs.w[a:b]])), _zip(pairs.train[a:b])])


def _merged(bodies, mu: float) -> tuple[Trie, list[tuple]]:
    """The trie of all that a shard was sent, and each row's questions (contexts, sizes, followers)."""
    asked, contexts, followers, counts, seen, totals = [], [], [], [], [], []
    for body in bodies:
        p = _parts(body)
        c, total, sizes = np.frombuffer(p[0], np.uint64), _unzip(p[1], np.int64), _unzip(p[2], np.int64)
        f, n = _from_six(p[3]), _unzip(p[4], np.int64)
        asked.append((c, sizes, f))
        seen.append(c)
        totals.append(total)
        live = n > 0
        contexts.append(np.repeat(c, sizes)[live])
        followers.append(f[live])
        counts.append(n[live])
    names, first = np.unique(np.concatenate(seen), return_index=True)
    total = np.concatenate(totals)[first]

    def probability(c, n):
        return n / (total[np.searchsorted(names, c)] + mu)

    return Trie.of(np.concatenate(contexts), np.concatenate(followers), np.concatenate(counts), probability), asked


class _Rounds:
    """The two rounds over ``texts(key, body, n)``; n is the number of training copies of a text."""

    def __init__(self, texts: DataFrame, total_bytes: int, mu: float, block_bytes: int, shard_bytes: int, spread: int, seed: int):
        self.parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.mu, self.spread, self.seed = mu, spread, seed
        self.shards = max(4 * self.parts, total_bytes // shard_bytes)
        self.rows = text_rows(texts, max(1, -(-total_bytes // block_bytes)))
        shards = self.shards

        def send_words(batches):
            def work(got):
                t = Tokens(got.texts.values(), got.copies.values(), seed)
                names = t.words(shards)
                counts = np.bincount(t.ids, t.weight, len(names.number)).astype(np.int64)[_of(names)]
                for bucket, a, b in names.sent():
                    yield bucket, _join([names.values[a:b].tobytes(), _zip(counts[a:b])])
            return send(batches, work)

        def count_words(bucket, blocks, bodies):
            parts = [_parts(b) for b in bodies]
            own = [np.frombuffer(p[0], np.uint64) for p in parts]
            names, inverse = np.unique(np.concatenate(own), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([_unzip(p[1], np.int64) for p in parts]), len(names)).astype(np.int64)
            yield -1, 3, int_key(bucket), b"%d %d" % (counts.sum(), (counts > 0).sum())
            for block, x in zip(blocks, own):
                yield block, 0, int_key(bucket), _zip(counts[np.searchsorted(names, x)])

        words = cut(answered(dealt(self.parts, self.rows).mapInArrow(send_words, SENT), self.parts, count_words), "words")
        sums = F.split(F.col("body").cast("string"), " ")                                  # one row a bucket, added up in Spark
        self.n, self.v = (x or 0 for x in words.where("kind = 3").agg(*(F.sum(sums[i].cast("long")) for i in (0, 1))).first())
        self.words = words.where("kind <> 3")

    def sent_pairs(self) -> DataFrame:
        shards, spread, seed = self.shards, self.spread, self.seed

        def send_all(batches):
            def work(got):
                t = Tokens(got.texts.values(), got.copies.values(), seed)
                counts = _word_counts(t, got, shards)
                yield from _sent_pairs(t, counts, Pairs(t, counts, shards, spread))
            return send(batches, work)
        return dealt(self.parts, self.rows, self.words).mapInArrow(send_all, SENT)

    def scored(self) -> DataFrame:
        mu, shards, spread, seed, n, v = self.mu, self.shards, self.spread, self.seed, self.n, self.v

        def answer(bucket, blocks, bodies):
            trie, asked = _merged(bodies, mu)
            for block, (c, sizes, f) in zip(blocks, asked):
                steps = trie.find(c, sizes, f)
                if steps.any():
                    yield block, 1, int_key(bucket), bytes([steps.itemsize]) + _zip(steps)

        def score(batches):
            values = step_values()
            for _, got in by_block(batches):
                t = Tokens(got.texts.values(), got.copies.values(), seed)
                counts = _word_counts(t, got, shards)
                pairs = Pairs(t, counts, shards, spread)
                steps = np.zeros(len(pairs.u), np.uint16)
                for shard, body in got.answers.get(1, {}).items():
                    steps[pairs.bounds[shard]:pairs.bounds[shard + 1]] = _unzip(body[1:], f"u{body[0]}")
                p1 = (counts + 0.5) / (n + 0.5 * (v + 1))
                p = values[steps] + mu / (counts[pairs.u] + mu) * p1[pairs.w]
                known = np.add.reduceat((counts[t.ids] > 0).astype(np.int64), t.starts)
                base = np.add.reduceat(np.log10(p1)[t.ids], t.starts)
                full = np.add.reduceat(np.log10(p)[pairs.inverse], t.starts)
                yield batch(list(zip(got.texts, t.sizes.tolist(), known.tolist(), base.tolist(), full.tolist())), _SCORED)

        pairs = cut(answered(self.sent_pairs(), self.parts, answer), "pairs")
        return dealt(self.parts, self.rows, self.words, pairs).mapInArrow(score, _SCORED)

    def tries(self) -> DataFrame:
        mu = self.mu

        def build(bucket, blocks, bodies):
            yield bucket, 4, b"", _merged(bodies, mu)[0].dump()
        return answered(self.sent_pairs(), self.parts, build).select(F.col("block").alias("shard"), F.col("body").alias("trie"))


def _of(names: Names) -> np.ndarray:
    """A position of each distinct name (block words are distinct, so the position)."""
    out = np.empty(len(names.values), np.int64)
    out[names.number] = np.arange(len(names.number))
    return out


def _word_counts(t: Tokens, got, buckets: int) -> np.ndarray:
    """Training counts of a block's words, and of the start (as often as the end)."""
    names = t.words(buckets)
    counts = np.zeros(len(names.values), np.int64)
    for bucket, body in got.answers.get(0, {}).items():
        counts[names.bounds[bucket]:names.bounds[bucket + 1]] = _unzip(body, np.int64)
    own = counts[names.number]
    return np.r_[own, own[t.end] if len(own) else 0]


def is_held_out(doc_id: Column, folds: int = 5, held: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == held, F.lit(False))


def _prepared(docs: DataFrame, id_col: str, text_col: str, options: dict) -> tuple[DataFrame, _Rounds]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = is_held_out(F.col(id_col))
    keyed = cut(docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("sha"), held.alias("held_out"),
                            F.octet_length(text).cast("long").alias("size")), "keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    texts = docs.select(F.unhex(F.sha2(text, 256)).alias("key"), text.cast("binary").alias("body"),
                        F.when(held, 0).otherwise(1).cast("long").alias("n"))
    settings = {"mu": MU, "block_bytes": BLOCK_BYTES, "shard_bytes": SHARD_BYTES, "spread": SPREAD, "seed": drawn()} | options
    return keyed, _Rounds(texts, total, **settings)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    keyed, rounds = _prepared(docs, id_col, text_col, options)
    scored = cut(rounds.scored(), "scores").withColumn("_sha", F.lower(F.hex("key")))
    return keyed.join(scored, keyed["sha"] == scored["_sha"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(rounds.n).cast("long").alias("train_tokens"), "base_score", "score")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The model: one row a shard, its trie as bytes for ``Trie.load``."""
    return _prepared(docs, id_col, text_col, options)[1].tries()
