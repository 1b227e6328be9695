"""Phrase collocation mining by prefix-free parsing.

Phrases of two to ``longest`` words are counted, every contiguous occurrence within a piece, and scored by how much more
often they occur than their parts would by chance.

1. Parse. Texts are split into pieces (at punctuation and line ends) and words. A window of ``longest - 1`` words whose hash
   is 0 modulo ``TRIGGER`` is a trigger; a chunk runs from a piece's start or a trigger window to the end of the next
   trigger window or the piece's end. Where a piece is cut depends on its words alone, so copied passages give equal
   chunks. The distinct chunks of a language are the dictionary, with their frequencies in the parse.
2. Count. Each distinct chunk is read once, its n-grams weighted by its frequency. Neighbouring chunks overlap by
   ``longest - 1`` words, so that every n-gram lies whole in the chunk in which it starts; those that start in the
   overlap belong to the next chunk, so each occurrence is assigned once.
3. Words are counted first, then pairs of frequent words, then longer n-grams of frequent pairs. The frequent ones of a step
   reach the next one's tasks as a bitmap of hashes of at most ``MAX_BITS`` bits: no frequent n-gram is missed, a
   foreign one that the bitmap lets through is counted exactly and then dropped by its count. Beyond the size at which the
   bitmap is sparse, more n-grams are shuffled and the results are the same.
4. Scores, joins by (language, phrase). Numbers are decimals of 38 digits, so scores are exact; a language's phrases
   are ranked with a limit in each partition before they meet.

Partial sums are made in the tasks and again before the shuffle, so a hot chunk, word or language is one row a task.

Cases: a null or empty text has no words; a null language is ``und``; repeated rows count each; a text of any length is one
document in one task; ties in score go to the greater count, then to the phrase in byte order; an empty table gives an empty
result; other columns are ignored."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairgauge.llm.common import cut

#: Bytes that end a piece, and bytes beside those between words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
WORD_GAPS = b" \t"
#: Mean number of words between triggers.
TRIGGER = 16
#: Bytes of text that a task parses or counts at once (a longer text is taken alone).
GROUP_BYTES = 4 << 20
MAX_BITS = 1 << 26
SEED = 42

_K = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _hashes(words) -> np.ndarray:
    import xxhash
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))


class Words:
    """The words of a list of texts in order: ``vocabulary`` (bytes), ``word`` (numbers in it), ``text`` and ``piece``."""

    def __init__(self, texts: list[bytes]):
        lower, gap, end = np.arange(256, dtype=np.uint8), np.zeros(256, bool), np.zeros(256, bool)
        lower[65:91] += 32
        end[list(PIECE_ENDS)] = gap[list(PIECE_ENDS)] = gap[list(WORD_GAPS)] = True
        data = np.frombuffer(b"\n".join(texts), np.uint8)             # a line end parts the texts' pieces
        inside = ~gap[data]
        edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
        starts, stops = edge[::2], edge[1::2]
        offsets = np.r_[0, np.cumsum(stops - starts)]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)),
                                                                               pa.py_buffer(lower[data[inside]])])
        coded = words.dictionary_encode()
        self.vocabulary, self.word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.piece = np.cumsum(end[data], dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int64)
        begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.text = np.searchsorted(begins, starts, "right") - 1

    def __len__(self):
        return len(self.word)

    def phrases(self, first: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The words from each place, so many of them, joined by spaces."""
        offsets = np.r_[0, np.cumsum(sizes)]
        at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], sizes)
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), self.vocabulary.take(pa.array(self.word[at])))
        return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())


def _chunks(w: Words, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and whether it is its piece's last, of every chunk."""
    n = len(w)
    new = np.ones(n, bool)
    new[1:] = w.piece[1:] != w.piece[:-1]
    starts = new.copy()
    if n >= overlap > 0:
        hashes = _hashes(w.vocabulary.to_pylist())[w.word]
        window = np.zeros(n - overlap + 1, np.uint64)
        for k in range(overlap):
            window = window * _K + hashes[k:n - overlap + 1 + k]
        whole = w.piece[overlap - 1:] == w.piece[:n - overlap + 1]
        starts[:n - overlap + 1] |= whole & (_mixed(window) % np.uint64(TRIGGER) == 0)
    elif overlap <= 0:
        starts[:] = True
    first = np.flatnonzero(starts)
    next_ = np.r_[first[1:], n]
    last = np.r_[new, True][next_]
    return first, next_ + np.where(last, 0, overlap) - first, last


def _groups(batches, column: str):
    """The batches as tables of about ``GROUP_BYTES`` of ``column``; a batch with more is cut."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        part = (np.cumsum(lengths) + size) // GROUP_BYTES
        for a, b in zip(cuts := np.r_[0, np.flatnonzero(np.diff(part)) + 1], [*cuts[1:], batch.num_rows]):
            if size >= GROUP_BYTES:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            if b > a:
                held.append(batch.slice(a, b - a))
                size += int(lengths[a:b].sum())
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bytes(column) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def parse(docs: DataFrame, overlap: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The dictionary ``lang, chunk, last, n``: distinct chunks and their frequencies in the parse."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).cast("string").alias("text")).where(F.col("text") != "")

    def run(batches):
        for group in _groups(batches, "text"):
            w = Words(_bytes(group.column("text")))
            if not len(w):
                continue
            first, sizes, last = _chunks(w, overlap)
            found = pa.table({"lang": group.column("lang").take(pa.array(w.text[first])), "chunk": w.phrases(first, sizes),
                              "last": pa.array(last)})
            counted = found.group_by(["lang", "chunk", "last"]).aggregate([([], "count_all")]).rename_columns(["lang", "chunk", "last", "n"])
            yield from counted.to_batches(max_chunksize=50_000)

    parsed = rows.mapInArrow(run, "lang string, chunk string, last boolean, n long")
    return parsed.groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n"))


def _gram_hashes(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    h = lang
    for w in words:
        h = h * _K + w
    return _mixed(h)


class Bitmap:
    """Hashes of the frequent n-grams of one length, as a bitmap of a bounded size."""

    def __init__(self, frequent: DataFrame, length: int):
        spark = frequent.sparkSession
        self.bits = min(MAX_BITS, max(1 << 16, 1 << (16 * frequent.count()).bit_length()))
        bits = self.bits

        def run(batches):
            for b in batches:
                if b.num_rows:
                    words = [p.split(b" ") for p in _bytes(b.column("phrase"))]
                    at = _gram_hashes(_hashes(_bytes(b.column("lang"))), [_hashes([p[k] for p in words]) for k in range(length)])
                    at &= np.uint64(bits - 1)
                    yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)),
                                                      pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["at", "bits"])

        set_ = frequent.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
        rows = set_.toArrow()                                         # at most MAX_BITS / 64 rows
        held = np.zeros(self.bits >> 6, np.uint64)
        held[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        self.held = spark.sparkContext.broadcast(held)

    def __contains__(self, item):
        raise TypeError("ask with holds()")

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.bits - 1)
        return (self.held.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def count(chunks: DataFrame, lengths: range, overlap: int, frequent: Bitmap | None = None, part: int = 1) -> DataFrame:
    """``lang, k, phrase, f`` of the n-grams of ``lengths`` all of whose ``part``-grams the bitmap holds (all, without one)."""
    holds = frequent.holds if frequent is not None else None

    def run(batches):
        for group in _groups(batches, "chunk"):
            w = Words(_bytes(group.column("chunk")))
            n = len(w)
            first = np.flatnonzero(np.diff(w.text, prepend=-1))
            place = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
            left = np.repeat(np.diff(np.r_[first, n]), np.diff(np.r_[first, n])) - place      # words to the chunk's end
            last = group.column("last").to_numpy(zero_copy_only=False)
            weight = group.column("n").to_numpy()
            own = last[w.text] | (left > overlap)
            langs = group.column("lang").combine_chunks().dictionary_encode()
            langs = langs.chunk(0) if isinstance(langs, pa.ChunkedArray) else langs
            lang = langs.indices.to_numpy()[w.text].astype(np.int64)
            live = np.ones(n, bool)
            if holds is not None:
                h = _hashes(w.vocabulary.to_pylist())[w.word]
                lh = _hashes(_bytes(langs.dictionary))[lang]
                live = np.zeros(n, bool)
                m = n - part + 1
                if m > 0:
                    live[:m] = holds(_gram_hashes(lh[:m], [h[k:m + k] for k in range(part)])) & (left[:m] >= part)
            v = max(len(w.vocabulary), 1)
            at, key = np.arange(n), lang * v + w.word
            alive = live.copy()                                       # all part-grams of the n-gram from here are held
            for k in range(1, max(lengths) + 1):
                if k > 1:
                    at = at[left[at] >= k] if k > part else at
                    keep = at + k - 1 < n
                    at = at[keep]
                if k > part:
                    alive[at] &= live[at + k - part]
                if k not in lengths:
                    continue
                here = at[alive[at] & own[at] & (left[at] >= k)]
                if not len(here):
                    continue
                code = lang[here]
                for j in range(k):                                    # numbers of distinct n-grams, a word at a time
                    code = np.unique(code * v + w.word[here + j], return_inverse=True)[1]
                _, one, code = np.unique(code, return_index=True, return_inverse=True)
                total = np.bincount(code, weight[w.text[here]]).astype(np.int64)
                one = here[one]
                for a in range(0, len(one), 50_000):
                    some = one[a:a + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [langs.dictionary.take(pa.array(lang[some])), pa.array(np.full(len(some), k, np.int32)),
                         w.phrases(some, np.full(len(some), k)), pa.array(total[a:a + 50_000])], ["lang", "k", "phrase", "f"])

    grams = chunks.mapInArrow(run, "lang string, k int, phrase string, f long")
    return grams.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, longest: int = 5, least: int = 100, text_col: str = "text",
                  lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``lang, k, phrase, f`` of all phrases of up to ``longest`` words with f >= ``least``, and ``lang, n``, all words."""
    overlap = longest - 1
    chunks = cut(parse(docs, overlap, text_col, lang_col), "chunks")
    words = cut(count(chunks, range(1, 2), overlap), "words")
    steps = [words.where(F.col("f") >= least)]
    for lengths, part in ((range(2, 3), 1), (range(3, longest + 1), 2)):
        if lengths and lengths[0] <= longest:
            grams = count(chunks, lengths, overlap, Bitmap(steps[-1], part), part)
            steps.append(cut(grams.where(F.col("f") >= least), "grams"))
    frequent = steps[0]
    for step in steps[1:]:
        frequent = frequent.unionByName(step)
    return frequent, words.groupBy("lang").agg(F.sum("f").alias("n"))


def score(counts: DataFrame, totals: DataFrame, absorb_percent: int = 100) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the phrases of two words or more that no longer one absorbs.

    The score is floor(1000 a n / (l r)) at the cut that makes it least (the first of equal ones). A phrase is absorbed by a
    longer one that holds it with at least ``absorb_percent`` of its occurrences."""
    words = F.split("phrase", " ")
    many = counts.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), words.alias("w"))
    cuts = many.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("c")).select(
        "lang", "phrase", "a", "c", F.array_join(F.slice("w", F.lit(1), F.col("c")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("c") + 1, F.col("k") - F.col("c")), " ").alias("right"))
    part = counts.select("lang", "phrase", "f")
    cuts = (cuts.join(part.toDF("lang", "left", "l"), ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"])
            .join(totals, "lang"))
    whole = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    cuts = cuts.select("lang", "phrase", "a", "n", "l", "r", "c", (F.lit(1000).cast("decimal(4,0)") * (whole["a"] * whole["n"])).alias("_over"),
                       (whole["l"] * whole["r"]).alias("_under")).withColumn("score", F.expr("_over div _under"))
    least = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"),
                                               F.min(F.struct("score", "c", "l", "r")).alias("m"))
    inner = many.where("k > 2").select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m")).select(
        "lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("i")).select(
        "lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = least.join(inner, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * absorb_percent))
    return kept.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").alias("score"))


def mine(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, absorb_percent: int = 100,
         text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    scored = score(*phrase_counts(docs, longest, least, text_col, lang_col), absorb_percent)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
