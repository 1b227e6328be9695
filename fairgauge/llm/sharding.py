"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``virtual_nodes`` points on a ring of 64-bit hashes; a key belongs to the next point clockwise of its
own hash. Loads are bounded: a shard holds at most its capacity of rows, and keys that find it full go on clockwise to
the next point of a shard with room. Keys arrive in ring order, so that the outcome follows from the number of keys
in each arc between points: an arc's keys, in ring order, fill its shard's room first, then the next shard's, and so on.
Only these arc counts (shards x virtual nodes numbers, whatever the rows) and the sort's partition counts reach the
driver; the rows are placed by one distributed sort.

``slack`` 0 gives exact capacities (row counts at most one apart, the law ``rows``); a slack of e allows
ceil((1 + e) n / shards) rows a shard and moves fewer keys when shards are added.

Cases: a null id hashes like any other value, so null and repeated ids share one place on the ring and are parted by
the sort's tie-break, never meeting in one task; a null text has size 1 (no bytes, plus 1); an empty table gives an
empty result; other columns are ignored unless named in ``carry``."""
from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairgauge.llm.common import carried, cut, dense_positions

#: Columns of the result; a carried column called like one of them gets underscores.
RESULT = ["doc_id", "size", "text_crc32", "owner", "shard", "slot"]


def ring_points(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """Sorted ``(place, shard)`` of every virtual node; a shard's points do not depend on the number of shards."""
    def place(s: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True)
    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill_arcs(counts: list[int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments ``(arc, first, last, shard, slot)``: the arc's keys first..last-1 (in ring order) go to ``shard``, in
    slots from ``slot`` on. ``counts[i]`` is the number of keys whose next point clockwise is ``points[i]``."""
    room, used, out = list(room), [0] * len(room), []
    for arc, n in enumerate(counts):
        done, at = 0, arc
        while done < n:
            shard = points[at % len(points)][1]
            take = min(n - done, room[shard])
            if take:
                out.append((arc, done, done + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                done += take
            at += 1
    return out


def _arc(place, bounds: list[int]):
    """Index of the first point at or after ``place`` (0 beyond the last): binary search as nested comparisons."""
    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo % len(bounds))
        mid = (lo + hi) // 2
        return F.when(place <= bounds[mid], search(lo, mid)).otherwise(search(mid + 1, hi))
    return search(0, len(bounds))


def shard(docs: DataFrame, shards: int = 8, virtual_nodes: int = 32, slack: float = 0.0, seed: int = 42,
          id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, owner`` (the shard of the plain ring), ``shard, slot`` and ``carry``."""
    spark = docs.sparkSession
    points = ring_points(shards, virtual_nodes)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
                        F.crc32(text).alias("text_crc32"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("place"),
                        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry or [])])
    bounds = [p for p, _ in points]
    keyed = keyed.withColumn("arc", _arc(F.col("place"), bounds))
    # Keys beyond the last point belong to arc 0 and arrive before the keys at the ring's start.
    wrapped = (F.col("place") > bounds[-1]).cast("int")
    ranked = dense_positions(keyed, [F.col("arc"), -wrapped, F.col("place")], "rank")
    found = {r.arc: r["count"] for r in ranked.groupBy("arc").count().collect()}   # one row an arc
    counts = [found.get(a, 0) for a in range(len(points))]
    segments = fill_arcs(counts, points, capacities(sum(counts), shards, slack))
    starts = [sum(counts[:a]) for a in range(len(points))]
    rows = [(a, starts[a] + first, starts[a] + last, s, slot) for a, first, last, s, slot in segments]
    plan = spark.createDataFrame(rows, "_arc int, _from long, _to long, shard int, _slot long")
    # At most one segment an arc plus one a filled shard: (virtual_nodes + 1) x shards rows, whatever the input.
    placed = ranked.join(F.broadcast(plan), (F.col("arc") == F.col("_arc")) & (F.col("rank") >= F.col("_from"))
                         & (F.col("rank") < F.col("_to")))
    owner = F.element_at(F.array(*[F.lit(s) for _, s in points]), F.col("arc") + 1)
    return placed.select("doc_id", "size", "text_crc32", owner.alias("owner"), "shard",
                         (F.col("_slot") + F.col("rank") - F.col("_from")).alias("slot"),
                         *[F.col(f"_c{(carry or []).index(c)}").alias(n) for c, n in carried(carry, RESULT).items()])


def plain_owner(place: int, points: list[tuple[int, int]]) -> int:
    """The shard of one hash on the plain ring (for tests and lookups)."""
    return points[bisect.bisect_left([p for p, _ in points], place) % len(points)][1]
