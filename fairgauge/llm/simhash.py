"""SimHash near-duplicates by a Gray-order hierarchical index.

A document's fingerprint has a bit set where over half of its shingles' 64-bit hashes have it set; documents whose
fingerprints differ in at most ``max_bits`` bits are linked, and a link's whole component forms one group.

Finding the links. Equal fingerprints are one node, so a group of copies is a single row. The 64 bits are cut into
``max_bits + 2`` segments; two fingerprints within ``max_bits`` agree on at least two of them, so each fingerprint is
dealt out once for every pair of segments, keyed by their bits. Within a key the other segments are put in front in
turn, the codes are sorted by Gray rank, and a hierarchy is laid over the sorted codes: a node stands for a run of
codes that share the bits of its level's mask. Node pairs are followed downwards from the top, adding up the
differing bits of the shared masks; a pair of nodes whose sum passes ``max_bits`` is dropped with everything below.

A key held by more than ``SPLIT_ABOVE`` fingerprints is dealt out again by pairs of sub-segments of its remaining
bits (the same argument), which leaves 16 free bits: no group has more than 65,536 fingerprints, at any input size.
Links found in a task are joined there to their group's smallest member, so that a group of n yields n - 1 rows.

Cases: a null or empty text, or one of no words, has fingerprint zero and is linked like any other; a null id is never a
group's name unless all its ids are null; repeated rows each get a row; an empty table gives an empty result; other
columns are ignored unless named in ``carry``."""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairgauge.llm.common import carried, connected_components, cut

#: Columns of the result; a carried column called like one of them gets underscores.
RESULT = ["doc_id", "fp", "component_id"]

#: Fingerprints under one key beyond which the key is dealt out by sub-segments.
SPLIT_ABOVE = 4096
#: Node pairs followed at once while descending the hierarchy.
BLOCK = 1 << 18


def fingerprint(text: str | None, words_each: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text (unsigned)."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()     # bytes: ASCII letters and white space only
    if not words:
        return 0
    if len(words) <= words_each:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    counts, total, step = np.zeros(64, np.int64), 0, 1 << 16
    # A long text is counted in stretches of whole shingles; each stretch is one joined string with known word ends.
    for at in range(0, len(words) - words_each + 1, step):
        part = words[at:at + step + words_each - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[:len(part) - words_each + 1].tolist()
        stops = (ends[words_each - 1:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, stops)), np.uint64, len(starts))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(starts)
    bits = np.flatnonzero(counts * 2 > total)
    return int(sum(1 << int(b) for b in bits))


def fingerprints(docs: DataFrame, words_each: int = 3, seed: int = 42, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` without ``text_col``, with the fingerprint as a (signed) long in ``out``."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{out}` long"])

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col)
            prints = np.fromiter((fingerprint(texts[i].as_py(), words_each, seed) for i in range(batch.num_rows)),
                                 np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(prints.view(np.int64))], names + [out])

    return docs.mapInArrow(run, schema)


def _bits(fp: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << n) - 1))


def _segments(low: int, n: int, parts: int) -> list[tuple[int, int]]:
    """``(low, bits)`` of ``parts`` nearly equal segments of the ``n`` bits above ``low``."""
    cuts = [low + n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _runs(bits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return sorted(bits, reverse=True)


def _keyed(prints: DataFrame, segments: list[tuple[int, int]], tables: list[tuple[int, ...]], first: int) -> DataFrame:
    """One row a fingerprint and table: the table's number and the bits of its chosen segments as one long."""
    rows = []
    for t, chosen in enumerate(tables):
        key = F.lit(0).cast("long")
        for s in chosen:
            low, n = segments[s]
            key = F.shiftleft(key, n).bitwiseOR(_bits(F.col("fp"), low, n))
        rows.append(F.struct(F.lit(first + t).alias("t"), key.alias("key")))
    return prints.select("fp", *[c for c in prints.columns if c != "fp"], F.explode(F.array(*rows)).alias("r")) \
        .select("fp", *[c for c in prints.columns if c != "fp"], "r.t", "r.key")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    r = codes.astype(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def gray_links(codes: np.ndarray, group: np.ndarray, levels: list[np.uint64], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(i, j)``, i < j, of equal ``group`` whose codes differ in at most ``max_bits`` bits.

    ``codes`` must be sorted by group, then Gray rank. ``levels`` are the hierarchy's masks from the top down: each
    covers the highest bits of the code down to some bit, so that a node's codes lie side by side."""
    n = len(codes)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = [np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, n]]          # node bounds, level by level
    for mask in levels:
        shared = codes & mask
        new = (group[1:] != group[:-1]) | (shared[1:] != shared[:-1])
        edges.append(np.r_[0, np.flatnonzero(new) + 1, n])
    # Children of a node: the next level's nodes whose first row lies in it.
    first_child = [np.searchsorted(b[:-1], a) for a, b in zip(edges, edges[1:])]
    found_i, found_j = [], []
    tops = np.flatnonzero(np.diff(edges[0]) > 1)
    stack = [(0, tops[k:k + BLOCK], tops[k:k + BLOCK]) for k in range(0, len(tops), BLOCK)]
    while stack:
        level, a, b = stack.pop()
        if level == len(levels):
            i, j = edges[-1][a], edges[-1][b]                                   # a leaf is one code
            keep = i < j
            found_i.append(i[keep]); found_j.append(j[keep])
            continue
        kids = first_child[level]
        na, nb = kids[a + 1] - kids[a], kids[b + 1] - kids[b]
        each = na * nb
        ends = np.cumsum(each)
        at = 0
        while at < len(a):                                                      # at most about BLOCK pairs at once
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
            pair = np.repeat(np.arange(at, stop), each[at:stop])
            place = np.arange(len(pair)) - np.repeat(ends[at:stop] - each[at:stop] - base, each[at:stop])
            x = kids[a[pair]] + place // nb[pair]
            y = kids[b[pair]] + place % nb[pair]
            keep = x <= y
            x, y = x[keep], y[keep]
            bounds = edges[level + 1]
            apart = (codes[bounds[x]] ^ codes[bounds[y]]) & levels[level]        # differences gathered so far
            keep = np.bitwise_count(apart) <= max_bits
            x, y = x[keep], y[keep]
            if level + 1 < len(levels):                                         # a lone code needs no pair with itself
                keep = (x != y) | (bounds[x + 1] - bounds[x] > 1)
                x, y = x[keep], y[keep]
            if len(x):
                stack.append((level + 1, x, y))
            at = stop
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, np.int64),) * 2


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the first row of its component under the links ``(i, j)``."""
    root = np.arange(n)
    while True:
        m = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, m)
        np.minimum.at(root, j, m)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            return root


def _group_links(keyed: DataFrame, keys: list[str], free: list[list[tuple[int, int]]], max_bits: int) -> DataFrame:
    """Edges ``(a, b)`` joining, under each key, every linked fingerprint to its component's first one.

    ``free[t]`` are the bit segments that table t's key leaves open, the order in which they lead the Gray code."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        columns = [pa.Table.from_batches([b]) for b in batches]
        if not columns:
            return
        data = pa.concat_tables(columns)
        fp = data.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        t = data.column("t").to_numpy()
        ids = [data.column(k).to_numpy() for k in keys]
        for number in np.unique(t):
            rows = np.flatnonzero(t == number)
            x, own = fp[rows], [k[rows] for k in ids]
            segments = free[number]
            width = sum(n for _, n in segments)
            code = np.zeros(len(x), np.uint64)
            for low, n in segments:                                             # the open bits, in front order
                code = (code << np.uint64(n)) | ((x >> np.uint64(low)) & np.uint64((1 << n) - 1))
            order = np.lexsort([gray_rank(code), *own])
            x, code, own = x[order], code[order], [k[order] for k in own]
            new = np.zeros(len(x), bool)
            for k in own:
                new[1:] |= k[1:] != k[:-1]
            # Masks of 8 more bits a level, the whole code last.
            masks = [np.uint64(((1 << width) - 1) ^ ((1 << max(0, width - d)) - 1)) for d in range(8, width + 8, 8)]
            i, j = gray_links(code, np.cumsum(new), masks, max_bits)
            root = _spanning(i, j, len(x))
            linked = np.flatnonzero(root != np.arange(len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(x[linked].view(np.int64)), pa.array(x[root[linked]].view(np.int64))], ["a", "b"])

    return keyed.repartition(parts, "t", *keys).mapInArrow(run, "a long, b long")


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges ``(a, b)`` over distinct fingerprints (column ``fp``) whose components are those of all links."""
    segments = _segments(0, 64, max_bits + 2)
    tables = list(combinations(range(len(segments)), 2))
    free = [[segments[s] for s in range(len(segments)) if s not in t] for t in tables]
    keyed = _keyed(prints.select("fp"), segments, tables, 0)
    sizes = cut(keyed.groupBy("t", "key").count().where("count > 1"), "keys")
    held = keyed.join(sizes, ["t", "key"])
    small = _group_links(held.where(f"count <= {SPLIT_ABOVE}").select("fp", "t", "key"), ["key"], free, max_bits)
    # Large keys: each table's open bits, cut again; two sub-segments of them join the key.
    large = held.where(f"count > {SPLIT_ABOVE}").select("fp", "t", "key")
    finer, open_bits = None, []
    for t, rest in enumerate(free):
        sub = [half for low, n in rest for half in _segments(low, n, (max_bits + 2) // len(rest) or 1)]
        while len(sub) < max_bits + 2:
            low, n = sub.pop(0)
            sub += _segments(low, n, 2)
        chosen = list(combinations(range(len(sub)), 2))
        part = _keyed(large.where(F.col("t") == t).select("fp", F.col("key").alias("outer")), sub, chosen, len(open_bits))
        open_bits += [[sub[s] for s in range(len(sub)) if s not in c] for c in chosen]
        finer = part if finer is None else finer.unionByName(part)
    return small.unionByName(_group_links(finer, ["outer", "key"], open_bits, max_bits))


def _prints(docs: DataFrame, words_each: int, seed: int, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """``doc_id, fp, row`` and the carried columns as ``_c0, _c1, ...``, written to the shared folder."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    return cut(fingerprints(rows, words_each, seed, out="fp").withColumn("row", F.monotonically_increasing_id()), "prints")


def _components(rows: DataFrame, max_bits: int) -> DataFrame:
    """``fp, component_id, group`` of the distinct fingerprints of ``rows(doc_id, fp)``; group is a fingerprint."""
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    groups = connected_components(cut(links(nodes, max_bits), "links"))
    named = nodes.join(groups, nodes["fp"] == groups["node"], "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = cut(named, "named")
    least = names.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut(names.join(least, "root").select("fp", "component_id", F.col("root").alias("group")), "components")


def near_duplicates(docs: DataFrame, words_each: int = 3, max_bits: int = 2, seed: int = 42, id_col: str = "doc_id",
                    text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: ``doc_id, fp`` (the fingerprint as a long), ``component_id`` (the group's smallest id) and ``carry``."""
    carry = carry or []
    rows = _prints(docs, words_each, seed, id_col, text_col, carry)
    return rows.join(_components(rows, max_bits), "fp").select(
        "doc_id", "fp", "component_id", *[F.col(f"_c{carry.index(c)}").alias(n) for c, n in carried(carry, RESULT).items()])


def representatives(docs: DataFrame, words_each: int = 3, max_bits: int = 2, seed: int = 42, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The documents with one row kept of each group: the row of smallest id (null last), and of equal ids the first in
    the written fingerprint table."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(f"`{id_col}`").alias("id"),
                         F.col(f"`{text_col}`").alias("body"))
    rows = _prints(packed, words_each, seed, "id", "body", ["whole"])
    named = rows.select("doc_id", "fp", "row").join(_components(rows, max_bits), "fp")
    first = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"))
    kept = cut(first.select(F.col("least.row").alias("row")), "kept")
    # a merge join at every size, so that the plan (and what it moves) is the same for small and large inputs
    return rows.join(kept.hint("merge"), "row", "left_semi").select("_c0.*")
