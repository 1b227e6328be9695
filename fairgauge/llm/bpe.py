"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is split by the vocabulary's pattern; every match (a pre-token) is encoded for itself. A pre-token that is in the
vocabulary is that id. Any other starts as a linked list of its bytes, and the adjacent pair of least rank, the leftmost
of equal ones, is merged until no pair is in the vocabulary. The queue of pairs:

* one bucket per merge rank with the linked-list positions at which a pair of that rank starts;
* a hierarchical bitmap over the ranks: a bit per non-empty bucket, a bit per non-zero word of the level below, and so
  on up to one word, so that find-first-set on three words (for 50,000 ranks) gives the next rank;
* entries are never searched for and removed: an entry is stale, and skipped, when the pair at its position has another
  rank by now.

Pre-tokens don't meet, so all that are new in a batch share one list and one queue, and a bucket is merged as a whole with
numpy: of overlapping pairs every other one from the left, as one by one would do. Only where a merge gives a pair of a
rank below its own could the order of the bucket's other merges in that pre-token matter; there the leftmost
alone is merged and the rest goes back to the bucket. A merge makes at most two new pairs, so a pre-token of n bytes
takes O(n) entries, however long it is (text without white space can be one pre-token of millions of bytes). Ids of short
stretches of text are remembered per worker, which changes no id.

Encoding and decoding are narrow Arrow passes: no shuffle, and in memory a batch or one text, if that is longer.

Cases: a null or empty text has no ids, and decodes to no bytes; repeated rows are encoded each for itself; an empty table
gives an empty result; other columns are ignored unless named in ``carry`` (a carried column called like a result
column gets underscores). Decoding a null list gives no bytes; an id outside the vocabulary is an error."""
from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgauge.llm.common import carried

#: Remembered stretches of text per worker; when full, the memory starts anew (ids do not depend on it).
MEMO_ENTRIES = 250_000
MEMO_LENGTH = 64
#: Characters of text that are encoded at once, and of new pre-tokens that are merged at once (longer ones alone).
GROUP_CHARS = 4 << 20
MERGE_CHARS = 1 << 20
#: Bytes of ids that are decoded at once.
FLUSH_BYTES = 4 << 20


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """List positions by rank; ``take`` gives the least rank that has any, with its bucket."""

    def __init__(self, ranks: int):
        self.levels: list[list[int]] = []
        size = max(ranks, 1)
        while not self.levels or size > 1:
            size = (size + 63) >> 6
            self.levels.append([0] * size)
        self.buckets: dict[int, list[int]] = {}

    def _mark(self, rank: int) -> None:
        for level in self.levels:
            word = rank >> 6
            before = level[word]
            level[word] = before | (1 << (rank & 63))
            if before:                                   # the levels above know of this word
                return
            rank = word

    def push(self, ranks: list[int], positions: list[int]) -> None:
        buckets = self.buckets
        for rank, at in zip(ranks, positions):
            bucket = buckets.get(rank)
            if bucket is None:
                buckets[rank] = [at]
                self._mark(rank)
            else:
                bucket.append(at)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """``push`` of many entries at once."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order].tolist()
        first = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else np.zeros(0, int)
        for rank, a, b in zip(ranks[first].tolist(), first.tolist(), [*first[1:].tolist(), len(ranks)]):
            if rank in self.buckets:
                self.buckets[rank] += positions[a:b]
            else:
                self.buckets[rank] = positions[a:b]
                self._mark(rank)

    def take(self) -> tuple[int, list[int]] | None:
        rank = 0
        for level in reversed(self.levels):              # find-first-set, from the one top word down
            bits = level[rank]
            if not bits:
                return None
            rank = (rank << 6) | ((bits & -bits).bit_length() - 1)
        at = rank
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        return rank, self.buckets.pop(rank)


class Merges:
    """The vocabulary as pairs of ids: two adjacent nodes merge if their bytes together are in the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.none = max(ranks.values(), default=0) + 1   # the id of the place beside a list's ends
        keys, made = [], []
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left = ranks.get(word[:cut])
                right = ranks.get(word[cut:])
                if left is not None and right is not None:
                    keys.append(left * (self.none + 1) + right)
                    made.append(rank)
        keys, made = np.array(keys, np.int64), np.array(made, np.int32)
        order = np.argsort(keys)
        self.keys, self.made = np.r_[keys[order], np.int64(1) << 62], np.r_[made[order], np.int32(-1)]
        self.byte = np.full(256, self.none, np.int32)
        for b in range(256):
            if bytes([b]) in ranks:
                self.byte[b] = ranks[bytes([b])]
        #: Whether a merge to this id can give a pair of a lower rank.
        self.lowers = np.zeros(self.none + 1, bool)
        for part in (self.keys[:-1] // (self.none + 1), self.keys[:-1] % (self.none + 1)):
            self.lowers[part[self.made[:-1] < part]] = True

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; -1 if there is none."""
        key = left.astype(np.int64) * (self.none + 1) + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], np.int32(-1))


def merge_all(pieces: list[bytes], merges: Merges) -> list[bytes]:
    """The ids of every (non-empty) piece, little-endian unsigned 32-bit."""
    if not pieces:
        return []
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(data)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    piece_of = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    ids = np.r_[merges.byte[data], np.int32(merges.none)]          # place n lies beside both ends of every list
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[ends - 1], after[n], before[begins] = n, n, n
    rank_at = np.r_[merges.rank(ids[:n], ids[after[:n]]), np.int32(-1)]
    alive = np.ones(n, bool)
    queue = RankQueue(merges.none)
    at = np.flatnonzero(rank_at >= 0)
    queue.push_all(rank_at[at], at)
    while (entry := queue.take()) is not None:
        rank, at = entry[0], np.array(entry[1], np.int32)
        at = np.sort(at[rank_at[at] == rank])                       # the others are stale
        if not len(at):
            continue
        every, overlaps = at, at[1:] == after[at[:-1]]
        if overlaps.any():
            k = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.r_[True, ~overlaps], k, 0))
            at = at[(k - run) % 2 == 0]
        if merges.lowers[rank] and len(at) > 1:
            at = _one_where_lower(at, every, rank, ids, after, before, piece_of, merges, queue)
        gone = after[at]
        end = after[gone]
        ids[at], after[at], before[end] = rank, end, at
        rank_at[gone], alive[gone] = -1, False
        left = before[at]
        own = ids[at]
        both = merges.rank(np.concatenate([own, ids[left]]), np.concatenate([ids[end], own]))
        right_rank, left_rank = both[:len(at)], both[len(at):]
        rank_at[at], rank_at[left] = right_rank, left_rank
        right_new, left_new = right_rank >= 0, left_rank >= 0
        left_new[1:] &= left[1:] != at[:-1]                          # that pair is its left merge's right one
        queue.push(right_rank[right_new].tolist() + left_rank[left_new].tolist(), at[right_new].tolist() + left[left_new].tolist())
    made = ids[:n][alive].astype("<u4").tobytes()
    bounds = [0, *(4 * np.cumsum(np.add.reduceat(alive, begins, dtype=np.int64))).tolist()]
    return [made[a:b] for a, b in zip(bounds, bounds[1:])]


def _one_where_lower(at, every, rank, ids, after, before, piece_of, merges, queue):
    """``at`` with one merge only in a piece where some merge gives a pair of a lower rank; the rest of ``every`` pair
    of the bucket (overlapping ones too) is queued again."""
    end, left = after[after[at]], before[at]
    joined = np.r_[end[:-1] == at[1:], False]                        # the next merge starts where this one ends
    made = np.full(len(at), rank, np.int32)
    low = np.zeros(len(at), bool)
    for pair in (merges.rank(made, ids[end]), merges.rank(made, np.where(joined, made, ids[end])),
                 merges.rank(np.where(np.r_[False, joined[:-1]], made, ids[left]), made)):
        low |= (pair >= 0) & (pair < rank)
    if not low.any():
        return at
    piece = piece_of[at]
    first = np.r_[True, piece[1:] != piece[:-1]]
    lower = np.unique(piece[low])
    kept = at[first | ~np.isin(piece, lower)]
    again = every[np.isin(piece_of[every], lower) & ~np.isin(every, kept)]
    queue.push([rank] * len(again), again.tolist())
    return kept


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as bytes."""

    #: White space before a space: the space may belong to the match before it, so the text is split as a whole.
    _UNSAFE = re.compile(r"[\s\x1c-\x1f\x85] ")

    def __init__(self, ranks: dict[bytes, int], split: str):
        import regex
        self.ranks, self.merges = ranks, Merges(ranks)
        self.letter_runs = split == pattern()             # ASCII letters, perhaps after a space, are then one match
        # White space by its Unicode property, whatever the expression library takes \s to be.
        self.find = regex.compile(split.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.memo: dict[str, bytes] = {}

    def _stretches(self, text: str) -> list[str]:
        """Parts of a text that are split into matches alike alone and in the text: no match of the pattern crosses a space
        that follows anything but white space."""
        if self._UNSAFE.search(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + r for r in rest]

    def _matches(self, stretches: list[str]) -> dict[str, list[str]]:
        """The pattern's matches in every stretch. Stretches that start with a space and end with anything but white space
        are split in one go: between them a match ends in any case."""
        out, safe = {}, []
        for s in stretches:
            if self.letter_runs and s.isascii() and (s[1:] if s[0] == " " else s).isalpha():
                out[s] = [s]
            elif s[0] == " " and not s[-1].isspace():
                safe.append(s)
            else:
                out[s] = self.find(s)
        found = iter(self.find("".join(safe)))
        for s in safe:
            out[s], left = [], len(s)
            while left > 0:
                out[s].append(next(found))
                left -= len(out[s][-1])
            if left:
                raise ValueError("the pattern matches across a space that follows other characters")
        return out

    def _learn(self, stretches: list[str]) -> dict[str, bytes]:
        """The ids of every stretch."""
        ranks, ids, new, size = self.ranks, {}, [], 0
        matches = self._matches(stretches)

        def flush():
            ids.update(zip(new, merge_all([m.encode() for m in new], self.merges)))
            new.clear()

        for found in matches.values():
            for m in found:
                if m not in ids:
                    whole = ranks.get(m.encode())
                    ids[m] = None if whole is None else whole.to_bytes(4, "little")
                    if whole is None:
                        new.append(m)
                        size += len(m)
                        if size >= MERGE_CHARS:
                            flush()
                            size = 0
        flush()
        return {s: ids[found[0]] if len(found) == 1 else b"".join(map(ids.__getitem__, found)) for s, found in matches.items()}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The parts of the texts are held from learning what is new to looking up; a text longer than ``GROUP_CHARS`` is split twice,
        so that no list of its parts is held."""
        known = self.memo
        if len(known) > MEMO_ENTRIES:
            known.clear()
        new, parts = set(), []
        for t in texts:
            found = self._stretches(t)
            new |= set(found).difference(known)
            parts.append(found if len(t) <= GROUP_CHARS else None)
        made = self._learn(list(new))
        known.update((s, ids) for s, ids in made.items() if len(s) <= MEMO_LENGTH)
        long = {s: ids for s, ids in made.items() if len(s) > MEMO_LENGTH}
        if long:
            return [b"".join([known.get(s) or long[s] for s in (self._stretches(t) if p is None else p)]) for t, p in zip(texts, parts)]
        return [b"".join(map(known.__getitem__, self._stretches(t) if p is None else p)) for t, p in zip(texts, parts)]


def _schema(df: DataFrame, keep: list[str], more: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", " + more


class Decoder:
    """The bytes that a list of ids stands for."""

    def __init__(self, ranks: dict[bytes, int]):
        words = [None] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            words[rank] = word
        self.table = pa.array(words, pa.binary())

    def __call__(self, ids: pa.Array) -> bytes:
        if not len(ids):
            return b""
        words = self.table.take(ids)
        if words.null_count:
            raise ValueError("an id is not in the vocabulary")
        _, offsets, data = words.buffers()                 # all words' bytes lie one after the other
        ends = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset)
        return data[int(ends[0]):int(ends[-1])].to_pybytes()


def encode(docs: DataFrame, vocabulary: str | None = None, split: str | None = None, id_col: str = "doc_id",
           text_col: str = "text", carry: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_tokens, ids`` (a list of integers) and the ``carry`` columns; with ``decoded`` also the
    bytes that the ids decode to, made in the same pass."""
    path, split = vocabulary or vocabulary_path(), split or pattern()
    made = ["n_tokens", "ids"] + ["decoded"] * decoded
    back = carried(carry, ["doc_id", *made])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(back)])
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        encoder = decoder = None
        for batch in batches:
            if encoder is None:
                ranks = load_ranks(path)
                encoder, decoder = Encoder(ranks, split), Decoder(ranks)
            texts, others = batch.column("text"), batch.select(kept)
            first, held, size = 0, [], 0
            for i in range(batch.num_rows):
                held.append(texts[i].as_py())
                size += len(held[-1])
                if size >= GROUP_CHARS or i == batch.num_rows - 1:
                    ids = encoder(held)
                    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                    flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat)
                    columns = [*others.slice(first, len(sizes)).columns, pa.array(sizes), lists]
                    if decoded:
                        columns.append(pa.array([decoder(pa.array(np.frombuffer(x, "<i4"))) for x in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, [*kept, *made])
                    first, held, size = i + 1, [], 0

    out = rows.mapInArrow(run, _schema(rows, kept, "n_tokens long, ids array<int>" + ", decoded binary" * decoded))
    return out.select("doc_id", *made, *[F.col(f"_c{i}").alias(c) for i, c in enumerate(back.values())])


def decode(rows: DataFrame, ids_col: str = "ids", out: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``rows`` with the bytes that the ids stand for in a binary column ``out`` (a column of that name is replaced)."""
    path = vocabulary or vocabulary_path()
    others = [c for c in rows.columns if c.lower() != out.lower()]
    named = rows.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(others)], F.col(f"`{ids_col}`").alias("_ids"))
    kept = [c for c in named.columns if c != "_ids"]

    def run(batches):
        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(load_ranks(path))
            lists = batch.column("_ids")
            first = 0
            while first < batch.num_rows:
                last, size = first, 0
                while last < batch.num_rows and (size == 0 or size < FLUSH_BYTES):
                    size += 4 * (len(lists[last]) if lists[last].is_valid else 0) + 1
                    last += 1
                made = [decoder(lists[at].values) if lists[at].is_valid else b"" for at in range(first, last)]
                yield pa.RecordBatch.from_arrays([*batch.select(kept).slice(first, last - first).columns, pa.array(made, pa.binary())],
                                                 [*kept, "_out"])
                first = last

    done = named.mapInArrow(run, _schema(named, kept, "_out binary"))
    return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(others)], F.col("_out").alias(out))

