"""Embedding near-duplicates by spherical-cap filters.

The filter directions are the words of ``CODES`` structured random product codes: a code turns the space at random and
cuts the dimensions into blocks, each block has ``words`` random unit vectors, and a direction is one word from every
block. In each code a vector passes the ``each`` filters that it leans to most: its own ``alpha`` is the ``each``-th best
inner product, and the filters that reach it are listed exactly by descending block by block, dropping partial words
that the best remaining blocks can't lift to ``alpha``. So every vector has at least ``CODES * each`` filters. Vectors are
joined on shared filters and label, and each pair that meets is checked by its cosine in double precision, so that no
link is false; a link is missed only if its vectors share no filter.

``words`` grows with the number of vectors, so that a filter holds a bounded share of them. ``each`` is the least number
with which drawn pairs at the threshold's cosine, the hardest links, share a filter with probability ``RECALL``; as the
space is turned at random, that holds for any pair of the data, lone or in a cluster (the tests measure it against
brute force). A filter held by more than ``SPLIT_ABOVE`` vectors
is parted into chunks and every two chunks meet in a task of their own: nothing is skipped, no task grows. Equal
vectors of one label are one class with a count, so copies are never expanded into pairs.

Cases: a vector that is null, zero, or holds null or non-finite components, and any vector without a label, links with
nothing and keeps its own id; vectors of different length never link; repeated rows are vectors of their own; an
empty table gives an empty result; a null id is named only if its whole component has null ids; other columns are
ignored."""
from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairgauge.llm.common import connected_components, cut

BLOCKS = 4
#: Independent codes.
CODES = 4
#: Least number of filters that every vector passes, over all codes.
PASSES = 24
#: Share of the pairs at the threshold's cosine that must share a filter, and pairs drawn to measure it.
RECALL = 0.995
DRAWN_PAIRS = 2000
#: Bound of the words of a block: reached only with fewer than four blocks.
MOST_WORDS = 1024
SPLIT_ABOVE = 2000
#: Partial words followed at once while listing filters.
BEAM_ROWS = 4096


def product_code(dim: int, blocks: int, words: int, seed: int) -> list[np.ndarray]:
    """One (block dimensions x words) matrix a block; a whole word has unit length."""
    rng = np.random.default_rng([seed, dim, blocks, words])
    cuts = [dim * b // blocks for b in range(blocks + 1)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        c = rng.standard_normal((b - a, words))
        out.append(c / np.maximum(np.linalg.norm(c, axis=0), 1e-12) / np.sqrt(blocks))
    return out


def list_filters(unit: np.ndarray, code: list[np.ndarray], alpha: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, filter)`` of every code word whose inner product with a row of ``unit`` is at least ``alpha`` (or the row's own)."""
    rows, filters = [], []
    words = code[0].shape[1]
    cuts = np.cumsum([0] + [c.shape[0] for c in code])
    alpha = np.broadcast_to(np.asarray(alpha, np.float64), len(unit))
    for at in range(0, len(unit), BEAM_ROWS):
        part, least = unit[at:at + BEAM_ROWS], alpha[at:at + BEAM_ROWS]
        scores = [part[:, a:b] @ c for a, b, c in zip(cuts, cuts[1:], code)]
        best = np.cumsum([s.max(1) for s in scores][::-1], axis=0)[::-1]        # the most that blocks b.. can add
        row, name, total = np.arange(len(part)), np.zeros(len(part), np.int64), np.zeros(len(part))
        for b, s in enumerate(scores):
            rest = best[b + 1] if b + 1 < len(scores) else np.zeros(len(part))
            reach = total[:, None] + s[row]
            i, w = np.nonzero(reach + rest[row][:, None] >= least[row][:, None])
            row, name, total = row[i], name[i] * words + w, reach[i, w]
        rows.append(row + at)
        filters.append(name)
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(filters or [np.zeros(0, np.int64)])


def own_alpha(unit: np.ndarray, code: list[np.ndarray], each: int) -> np.ndarray:
    """Each row's ``each``-th best inner product with a code word (its least one if there are fewer words)."""
    cuts = np.cumsum([0] + [c.shape[0] for c in code])
    out = [np.zeros(0)]
    for at in range(0, len(unit), BEAM_ROWS):
        part = unit[at:at + BEAM_ROWS]
        top = np.zeros((len(part), 1))
        for a, b, c in zip(cuts, cuts[1:], code):
            s = -np.sort(-(part[:, a:b] @ c), axis=1)[:, :each]
            # the i-th of one list with the j-th of the other has i * j sums at least as good
            i, j = np.nonzero(np.outer(np.arange(1, top.shape[1] + 1), np.arange(1, s.shape[1] + 1)) <= each)
            top = -np.sort(-(top[:, i] + s[:, j]), axis=1)[:, :each]
        out.append(top[:, -1] - 1e-12)                                          # above the rounding of a sum's order
    return np.concatenate(out)


def codes(dim: int, words: int, seed: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """``(turn, code)`` of every code; the turn is a random rotation, so that no direction of the data is special."""
    out = []
    for k in range(CODES):
        q, r = np.linalg.qr(np.random.default_rng([seed, dim, k]).standard_normal((dim, dim)))
        out.append((q * np.sign(np.diag(r)), product_code(dim, blocks_of(dim), words, seed + k)))
    return out


def blocks_of(dim: int) -> int:
    """Blocks of at least two dimensions (a block of one has two directions only)."""
    return max(1, min(BLOCKS, dim // 2))


def own_filters(unit: np.ndarray, made: list[tuple[np.ndarray, list[np.ndarray]]], each: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, filter)`` of the ``each`` best filters of every row in every code."""
    rows, filters = [], []
    for k, (turn, code) in enumerate(made):
        turned = unit @ turn
        row, name = list_filters(turned, code, own_alpha(turned, code, each))
        rows.append(row)
        filters.append(name * len(made) + k)
    return np.concatenate(rows), np.concatenate(filters)


def calibrate(dim: int, words: int, threshold: float, passes: float, seed: int) -> int:
    """The least ``each`` (``passes`` filters in all, or more by steps of a quarter) at which drawn pairs at ``threshold`` share a
    filter in ``RECALL`` of the cases."""
    made, rng = codes(dim, words, seed), np.random.default_rng([seed, dim, words])
    one = _unit(rng.standard_normal((DRAWN_PAIRS, dim)))
    off = rng.standard_normal((DRAWN_PAIRS, dim))
    off -= (off * one).sum(1, keepdims=True) * one
    off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)
    cosine = min(1.0, max(-1.0, threshold))
    two = _unit(cosine * one + np.sqrt(1 - cosine ** 2) * off) if dim > 1 else one
    each = max(1, ceil(passes / CODES))
    while each < words ** blocks_of(dim):
        keys = [np.unique(np.stack(own_filters(x, made, each)), axis=1) for x in (one, two)]
        both, times = np.unique(np.concatenate(keys, axis=1), axis=1, return_counts=True)
        if len(np.unique(both[0, times > 1])) >= RECALL * DRAWN_PAIRS:
            break
        each = ceil(each * 1.25)
    return each


def usable(label: Column, vector: Column) -> Column:
    """Whether a row can link at all."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    big = np.abs(vectors).max(1, keepdims=True)
    v = vectors / big
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _pairs_within(bucket: np.ndarray, unit: np.ndarray, least: float):
    """Row pairs ``(i, j)`` of equal ``bucket`` (sorted) with an inner product of at least ``least``."""
    starts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    sizes = np.diff(starts)
    end = np.repeat(starts[1:], sizes)
    small = np.repeat(sizes <= 64, sizes)
    live = np.flatnonzero(small)
    for step in range(1, 64):
        live = live[live + step < end[live]]
        if not len(live):
            break
        for at in range(0, len(live), 1 << 15):
            i = live[at:at + (1 << 15)]
            hit = i[np.einsum("ij,ij->i", unit[i], unit[i + step]) >= least]
            if len(hit):
                yield hit, hit + step
    for a, b in zip(starts[:-1][sizes > 64], starts[1:][sizes > 64]):
        for at in range(a, b, 1024):
            i, j = np.nonzero(unit[at:min(at + 1024, b)] @ unit[at:b].T >= least)
            keep = i < j
            if keep.any():
                yield i[keep] + at, j[keep] + at


def links(classes: DataFrame, dim: int, threshold: float, words: int, each: int, seed: int = 42) -> DataFrame:
    """Distinct linked pairs ``(a, b)`` of ``classes(node, label, vector)``, all vectors of length ``dim``."""
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pass_filters(batches):
        made = codes(dim, words, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                vectors = np.array(batch.column("vector").to_pylist(), np.float64).reshape(-1, dim)
                row, name = own_filters(_unit(vectors), made, each)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("node").take(take), batch.column("label").take(take), pa.array(name)],
                                                 ["node", "label", "filter"])

    passed = cut(classes.select("node", "label", "vector").mapInArrow(pass_filters, "node long, label string, filter long"), "caps")
    sizes = passed.groupBy("label", "filter").count().where("count > 1")
    chunks = F.ceil(F.col("count") / SPLIT_ABOVE).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    # A chunk meets every chunk of its filter, itself included, each time under the pair's name.
    dealt = (passed.join(sizes, ["label", "filter"]).withColumn("chunks", chunks).withColumn("own", own)
             .select("node", "label", "filter", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
             .select("node", "label", "filter", "own", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2")))
    data = classes.select("node", "vector")
    full = dealt.join(data, "node").repartition(parts, "label", "filter", "c1", "c2")

    def meet(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        t = pa.concat_tables(tables)
        if not t.num_rows:
            return
        keys = t.select(["label", "filter", "c1", "c2"]).combine_chunks()
        label = keys.column("label").combine_chunks().dictionary_encode().indices.to_numpy() if keys.num_rows else np.zeros(0)
        cols = [label] + [keys.column(c).to_numpy() for c in ("filter", "c1", "c2")]
        order = np.lexsort(cols)
        new = np.zeros(len(order), np.int64)
        for c in cols:
            s = c[order]
            new[1:] |= s[1:] != s[:-1]
        flat = t.column("vector").combine_chunks()
        unit = _unit(np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)[order])
        node = t.column("node").to_numpy()[order]
        chunk, c1, c2 = (t.column(c).to_numpy()[order] for c in ("own", "c1", "c2"))
        for i, j in _pairs_within(np.cumsum(new), unit, threshold):
            keep = (c1[i] == c2[i]) | (chunk[i] != chunk[j])                    # pairs within a chunk meet once
            a, b = node[i[keep]], node[j[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return full.mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, passes: float = PASSES, seed: int = 42,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).alias("vector"))
    ok = usable(F.col("label"), F.col("vector"))
    good, bad = rows.where(ok), rows.where(~ok)
    classes = cut(good.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
                  .withColumn("node", F.monotonically_increasing_id()), "classes")
    found = None
    for dim, n in sorted((r[0], r[1]) for r in classes.groupBy(F.size("vector")).count().collect()):   # one row a length
        part = classes.where(F.size("vector") == dim)
        words = min(MOST_WORDS, max(4, ceil(n ** (1 / blocks_of(dim)))))
        more = links(part, dim, threshold, words, calibrate(dim, words, threshold, passes, seed), seed)
        found = more if found is None else found.unionByName(more)
    if found is None:
        found = spark.createDataFrame([], "a long, b long")
    found = cut(found, "links")
    groups = connected_components(found)
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(classes.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    named = classes.select("node", "label", "vector", "least", "n").join(groups, "node", "left") \
        .withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left")
    named = cut(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(named.join(least, "root").select("label", "vector", "component_id",
                                              (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "components")
    linked = good.join(of, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
