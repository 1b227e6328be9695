"""Conversation prefix trie: which prefixes conversations share, and what sharing them saves.

A node is a distinct sequence of first turns; its members are the conversations that start with it. The trie is kept as
balanced parentheses in shards:

1. Paths. Turns are numbered by one distributed sort. Every turn gets the hash of its conversation's sequence up to it: a
   polynomial over two prime fields (2^61 - 1), of bases drawn anew for each run, summed by shards of consecutive turns
   with carries between them, so a conversation of any length is spread over tasks. Members of a node are counted by partial aggregation.
2. Order. A node belongs to its smallest member, so a conversation's own nodes are one chain that hangs on a
   smaller conversation's chain at some depth. The chains, sorted by their ways from the root (deeper places first), give
   the depth-first order: a node's place is its chain's start and its depth. Ways are found by pointer doubling.
3. Shards. ``SHARD_NODES`` consecutive nodes are one shard, encoded by their depths as parentheses. Excess minima over blocks and a tree of
   them (range min-max) give findclose, which delimits subtrees; the rank of ``()`` pairs counts leaves; cumulative
   arrays give savings.
4. Shared spines. Nodes that are open at a shard's end close in the first later shard of a lower depth, found in the table of
   shards' least depths (one row a shard). Whole shards between are added from running totals, and what the closing shard
   holds before the close is joined by (shard, depth): one row for each node that a shard closes for an earlier one.

Two different sequences are taken for one with a probability below depth^2 / 2^122 a pair.

Cases: a null role or text is empty; a null turn comes first, and turns of one number are ordered by role and text; repeated
rows are turns of their own; rows without conversation are left out; conversations may be turnless (members of the root);
an empty table gives an empty result; other columns are ignored."""
from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairgauge.llm.common import cut, dense_positions, word_count

PRIME = (1 << 61) - 1
#: Consecutive turns whose hashes are summed together, and nodes of a shard.
SHARD_TURNS = 1 << 17
SHARD_NODES = 1 << 17
#: Parentheses of a block of the range min-max tree.
BLOCK = 64
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

_DEC = "decimal(38,0)"


def order_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """``conv, pos, t1, t2, words``: turns with their place in the order of (conversation, turn), a digest of 120 bits in two
    parts, and the words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
                        text.alias("text")).where(F.col("conv").isNotNull())
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.select("*", digest.alias("digest"), word_count(F.col("text")).alias("words"))
    rows = rows.select("*", *[F.conv(F.substring("digest", k, 15), 16, 10).cast("long").alias(t) for t, k in (("t1", 1), ("t2", 16))])
    return dense_positions(rows, [F.col("conv"), F.col("turn").isNotNull(), F.col("turn"), F.col("role"), F.col("text")], "pos",
                           ["conv", "t1", "t2", "words"])


def share_heads(turns: DataFrame, head: F.Column, base: F.Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` (0 to 3) turns are replaced by those of the conversation ``base`` (columns over
    ``conv``): ``own``, the ordered turns that a conversation keeps, with ``skip`` (own turns replaced) and ``heads``, and
    one row a conversation, ``conv, n, skip, heads``. ``heads`` lists the (t1, t2, words) taken over."""
    convs = turns.groupBy("conv").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))
    bases = convs.where(base == F.col("conv")).select(
        "conv", F.explode(F.sequence(F.col("start"), F.col("start") + F.least(F.col("n"), F.lit(3)) - 1)).alias("pos"))
    first = bases.join(turns.select("pos", "t1", "t2", "words"), "pos")           # at most three rows a base
    first = first.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "t1", "t2", "words"))).alias("_heads"))
    asked = convs.withColumn("_base", base).withColumn("skip", F.when(base == F.col("conv"), 0).otherwise(head).cast("long"))
    taken = asked.join(first.withColumnRenamed("conv", "_base"), "_base", "left")
    none = F.array().cast("array<struct<t1:bigint,t2:bigint,words:bigint>>")
    heads = F.transform(F.slice("_heads", F.lit(1), F.col("skip").cast("int")), lambda x: F.struct(
        x["t1"].alias("t1"), x["t2"].alias("t2"), x["words"].alias("words")))
    convs = cut(taken.select("conv", "start", "n", "skip", F.when(F.col("_heads").isNull(), none).otherwise(heads).alias("heads")), "convs")
    return turns.join(convs, "conv").where(F.col("pos") - F.col("start") >= F.col("skip")), convs


def _mod(c: F.Column) -> F.Column:
    return (c % F.lit(PRIME).cast("decimal(19,0)")).cast("decimal(19,0)")


def _members(own: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv, d, p1, p2, q1, q2, words``: each conversation's nodes below the root, with path and parent's path."""
    spark = convs.sparkSession
    base = [secrets.randbelow(PRIME - 1 << 1) % (PRIME - 1) + 1 for _ in range(2)]
    # Paths of the turns taken over: at most three terms.
    powers = [[pow(b, i, PRIME) for i in range(1, 4)] for b in base]

    def head_path(lane: int, length) -> F.Column:
        out = F.lit(0).cast("decimal(19,0)")
        for i in range(3):
            term = _mod(F.get(F.col("heads"), i)[f"t{lane + 1}"].cast("decimal(19,0)") * F.lit(powers[lane][i]).cast("decimal(19,0)"))
            out = _mod(out + F.when(F.lit(i) < length, term).otherwise(F.lit(0)))
        return out.cast("long")

    n_heads = F.size("heads")
    inner = convs.where(F.size("heads") > 0).select("conv", "heads", F.explode(F.sequence(F.lit(1), n_heads)).alias("d"))
    heads = inner.select("conv", F.col("d").cast("long").alias("d"), head_path(0, F.col("d")).alias("p1"), head_path(1, F.col("d")).alias("p2"),
                         head_path(0, F.col("d") - 1).alias("q1"), head_path(1, F.col("d") - 1).alias("q2"),
                         F.element_at("heads", F.col("d"))["words"].alias("words"))
    rows = own.select("conv", "pos", (F.col("pos") - F.col("start") - F.col("skip") + n_heads + 1).cast("long").alias("d"), "t1", "t2", "words",
                      head_path(0, n_heads).alias("h1"), head_path(1, n_heads).alias("h2"),
                      F.expr(f"pos div {SHARD_TURNS}").alias("shard"))
    rows = cut(rows, "turns")

    def sums(batches):
        """Per shard: the sum of terms of its first and its last conversation (only they meet other shards)."""
        for shard, t in _by_shard(batches):
            for conv in {t["conv"][0], t["conv"][-1]}:
                at = [i for i, c in enumerate(t["conv"]) if c == conv]
                s = [0, 0]
                for i in at:
                    for k in (0, 1):
                        s[k] += t[f"t{k + 1}"][i] * pow(base[k], t["d"][i], PRIME)
                yield pa.RecordBatch.from_pydict({"conv": [conv], "shard": [shard], "s1": [s[0] % PRIME], "s2": [s[1] % PRIME]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(parts, "shard").sortWithinPartitions("shard", "pos")
    ends = placed.select("conv", "shard", "d", "t1", "t2").mapInArrow(sums, "conv long, shard long, s1 long, s2 long")
    before = Window.partitionBy("conv").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)   # two rows a shard
    carry = ends.select("conv", "shard", *[_mod(F.sum(F.col(s).cast(_DEC)).over(before)).cast("long").alias(c) for s, c in (("s1", "c1"), ("s2", "c2"))])
    carry = cut(carry.where(F.col("c1").isNotNull()), "carries")
    ready = rows.join(carry, ["conv", "shard"], "left").repartition(parts, "shard").sortWithinPartitions("shard", "pos")

    def scan(batches):
        for _, t in _by_shard(batches):
            out = {c: [] for c in ("p1", "p2", "q1", "q2")}
            now = None
            for conv, d, t1, t2, h1, h2, c1, c2 in zip(t["conv"], t["d"], t["t1"], t["t2"], t["h1"], t["h2"], t["c1"], t["c2"]):
                if conv != now:
                    now, p1, p2 = conv, (h1 + (c1 or 0)) % PRIME, (h2 + (c2 or 0)) % PRIME
                    b1, b2 = pow(base[0], d, PRIME), pow(base[1], d, PRIME)
                out["q1"].append(p1)
                out["q2"].append(p2)
                p1, p2 = (p1 + t1 * b1) % PRIME, (p2 + t2 * b2) % PRIME
                b1, b2 = b1 * base[0] % PRIME, b2 * base[1] % PRIME
                out["p1"].append(p1)
                out["p2"].append(p2)
            for a in range(0, len(t["conv"]), 50_000):
                yield pa.RecordBatch.from_pydict({c: pa.array(v[a:a + 50_000], pa.int64()) for c, v in
                                                  [("conv", t["conv"]), ("d", t["d"]), *out.items(), ("words", t["words"])]})

    scanned = ready.select("conv", "shard", "d", "t1", "t2", "h1", "h2", "c1", "c2", "words").mapInArrow(
        scan, "conv long, d long, p1 long, p2 long, q1 long, q2 long, words long")
    return scanned.unionByName(heads.select("conv", "d", "p1", "p2", "q1", "q2", "words"))


def _by_shard(batches):
    """The columns (lists) of each shard of the sorted rows."""
    held, now = [], None
    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(bounds, bounds[1:]):
            if b > a:
                if held and shards[a] != now:
                    yield now, pa.Table.from_batches(held).to_pydict()
                    held = []
                now = int(shards[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held).to_pydict()


def _end_digests(ends: DataFrame) -> DataFrame:
    """``d, p1, p2, ends_sha256``: the SHA-256 of the ascending members that end at a node. Rows stream through sorted, so a
    node of very many ends needs no more memory than one of few."""
    def run(batches):
        now, state, rows = None, None, []
        for batch in batches:
            for key in zip(*(batch.column(c).to_pylist() for c in ("d", "p1", "p2", "conv"))):
                if key[:3] != now:
                    if now is not None:
                        rows.append((*now, state.hexdigest()))
                    now, state = key[:3], hashlib.sha256(str(key[3]).encode())
                else:
                    state.update(b",%d" % key[3])
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        if now is not None:
            rows.append((*now, state.hexdigest()))
        if rows:
            yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(("d", "p1", "p2", "ends_sha256"))})

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ends.repartition(parts, "d", "p1", "p2").sortWithinPartitions("d", "p1", "p2", "conv").mapInArrow(
        run, "d long, p1 long, p2 long, ends_sha256 string")


def _chain_starts(nodes: DataFrame, root: int) -> DataFrame:
    """``conv_id, parent, top, bottom, start``: each conversation's chain of nodes (depths ``top`` to ``bottom``), the owner of the node it
    hangs on, and the place of its first node in depth-first order."""
    chains = nodes.groupBy("conv_id").agg(F.min(F.struct("d", "q1", "q2")).alias("m"), F.max("d").alias("bottom")).select(
        "conv_id", "bottom", F.col("m.d").alias("top"), (F.col("m.d") - 1).alias("d"), F.col("m.q1").alias("p1"), F.col("m.q2").alias("p2"))
    owner = nodes.select("d", "p1", "p2", F.col("conv_id").alias("parent"))
    chains = cut(chains.join(owner, ["d", "p1", "p2"], "left").select("conv_id", "parent", "top", "bottom"), "chains")
    way = F.array(F.struct((-F.col("top")).alias("at"), F.col("conv_id").alias("c")))
    ways = chains.select("conv_id", F.when(F.col("parent") != root, F.col("parent")).alias("up"),
                         F.when(F.col("parent").isNull(), F.slice(way, 1, 0)).otherwise(way).alias("way"))
    while True:                                                        # each round doubles the known part of the ways
        ways = cut(ways, "ways")
        if ways.where("up IS NOT NULL").isEmpty():
            break
        above = ways.select(F.col("conv_id").alias("up"), F.col("up").alias("_up"), F.col("way").alias("_way"))
        further = ways.where("up IS NOT NULL").join(above, "up").select("conv_id", F.col("_up").alias("up"), F.concat("_way", "way").alias("way"))
        ways = ways.where("up IS NULL").unionByName(further)
    ranked = cut(dense_positions(ways, [F.col("way")], "rank", ["conv_id"]).join(chains, "conv_id"), "ranked")
    ranked = ranked.withColumn("_block", F.expr("rank div 65536"))
    blocks = ranked.groupBy("_block").agg(F.sum(F.col("bottom") - F.col("top") + 1).alias("_sum"))      # a row for 65,536 chains
    lower = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(lower), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return cut(ranked.join(blocks, "_block").select(
        "conv_id", "parent", "top", "bottom",
        (F.col("_before") + F.coalesce(F.sum(F.col("bottom") - F.col("top") + 1).over(inside), F.lit(0))).alias("start")), "starts")


class Parentheses:
    """Consecutive nodes in depth-first order as balanced parentheses: a ``(`` where a node opens, a ``)`` where it closes.
    Closes of nodes that are open at the end are not there, nor are opens before the first node."""

    def __init__(self, depths: np.ndarray, last_is_leaf: bool):
        closes = np.r_[depths[:-1] - depths[1:] + 1, int(last_is_leaf)]
        self.opens = np.arange(len(depths)) + np.r_[0, np.cumsum(closes)[:-1]]
        self.bits = np.zeros(len(depths) + int(closes.sum()), bool)
        self.bits[self.opens] = True
        self.excess = int(depths[0]) + np.cumsum(np.where(self.bits, 1, -1))
        leaf = self.bits & ~np.r_[self.bits[1:], True]
        self.leaf_rank = np.r_[0, np.cumsum(leaf)]                      # () pairs before a place
        self.open_rank = np.r_[0, np.cumsum(self.bits)]
        padded = np.full(-(-len(self.bits) // BLOCK) * BLOCK, np.iinfo(np.int64).max)
        padded[:len(self.bits)] = self.excess
        self.blocks = padded.reshape(-1, BLOCK)
        self.levels = [self.blocks.min(1)]                              # least excess of blocks, pairs of blocks, ...
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            low = np.r_[low, np.full(len(low) % 2, np.iinfo(np.int64).max)]
            self.levels.append(low.reshape(-1, 2).min(1))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The place of the ``)`` of each ``(``, or the number of places if it isn't there."""
        out = np.full(len(at), len(self.bits))
        for a in range(0, len(at), 1 << 15):
            out[a:a + (1 << 15)] = self._findclose(at[a:a + (1 << 15)])
        return out

    def _in_block(self, block: np.ndarray, level: np.ndarray, after: np.ndarray) -> np.ndarray:
        """First place in the block behind ``after`` with an excess of at most ``level``; -1 if none."""
        hit = (self.blocks[block] <= level[:, None]) & (np.arange(BLOCK) > after[:, None])
        return np.where(hit.any(1), hit.argmax(1) + block * BLOCK, -1)

    def _findclose(self, at: np.ndarray) -> np.ndarray:
        level, block = self.excess[at] - 1, at // BLOCK
        out = self._in_block(block, level, at % BLOCK)
        todo = np.flatnonzero(out < 0)
        node, depth, found = block[todo].copy(), np.zeros(len(todo), int), np.zeros(len(todo), bool)
        for k, low in enumerate(self.levels):                           # up, until a right neighbour holds the level
            here = np.flatnonzero(~found & (depth == k))
            right = node[here] + 1
            ok = (node[here] % 2 == 0) & (right < len(low))
            ok[ok] = low[right[ok]] <= level[todo[here[ok]]]
            found[here[ok]] = True
            node[here[ok]] += 1
            node[here[~ok]] //= 2
            depth[here[~ok]] += 1
        todo, node, depth = todo[found], node[found], depth[found]
        for k in range(len(self.levels) - 1, 0, -1):                    # down, to the left half if that holds it
            here = np.flatnonzero(depth == k)
            left = 2 * node[here]
            node[here] = np.where(self.levels[k - 1][left] <= level[todo[here]], left, left + 1)
            depth[here] -= 1
        out[todo] = self._in_block(node, level[todo], np.full(len(todo), -1))
        return np.where(out < 0, len(self.bits), out)


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """``nodes(place, depth, own, n_children, ...)``, place being the depth-first order, with ``n_leaves`` and ``saved``
    (sum of ``own``) over each node's subtree."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(nodes.withColumn("shard", F.expr(f"place div {SHARD_NODES}")), "nodes")
    table = placed.groupBy("shard").agg(F.min("depth").alias("low"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"),
                                        F.sum("own").alias("own")).orderBy("shard").toArrow()             # one row a shard
    low = table.column("low").to_numpy()
    leaves, saved = (np.r_[0, np.cumsum(table.column(c).to_numpy())] for c in ("leaves", "own"))
    shards = spark.sparkContext.broadcast((low, leaves, saved))
    kept = [c for c in placed.columns if c not in ("shard", "place")]
    schema = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        low, leaves, saved = shards.value
        for shard, t in _by_shard(batches):
            depth, own = np.array(t["depth"]), np.array(t["own"])
            p = Parentheses(depth, t["n_children"][-1] == 0)
            close = p.findclose(p.opens)
            open_ = close == len(p.bits)
            running = np.r_[0, np.cumsum(own)]
            n_leaves = p.leaf_rank[close] - p.leaf_rank[p.opens]
            total = running[p.open_rank[close]] - running[np.arange(len(own))]
            # Open nodes: whole shards up to the one that closes them.
            least = np.minimum.accumulate(low[shard + 1:])
            closing = shard + 1 + np.searchsorted(-least, -depth)       # first later shard with a depth as low
            n_leaves[open_] += (leaves[closing] - leaves[shard + 1])[open_]
            total[open_] += (saved[closing] - saved[shard + 1])[open_]
            # For each depth that this shard closes for earlier shards: what lies before the close.
            new_low = np.flatnonzero(depth < np.r_[np.iinfo(np.int64).max, np.minimum.accumulate(depth)[:-1]])
            spans = depth[new_low[:-1]] - depth[new_low[1:]]
            ended = np.repeat(new_low[1:], spans)
            of = np.concatenate([np.arange(a - 1, b - 1, -1) for a, b in zip(depth[new_low[:-1]], depth[new_low[1:]])] or [np.zeros(0, int)])
            before = p.leaf_rank[p.opens[ended]], running[ended]
            n, m = len(depth), len(of)
            for a in range(0, n, 20_000):
                s = slice(a, a + 20_000)
                yield pa.RecordBatch.from_pydict(
                    {c: pa.array(t[c][s]) if t[c][s].count(None) < len(t[c][s]) else pa.nulls(len(t[c][s]), pa.int64()) for c in kept}
                    | {"n_leaves": n_leaves[s], "saved": total[s], "_shard": np.where(open_, closing, -1)[s], "_depth": depth[s],
                       "_node": np.ones(len(depth[s]), bool)}).cast(whole)
            for a in range(0, m, 50_000):
                s = slice(a, a + 50_000)
                yield pa.RecordBatch.from_pydict(
                    {c: pa.nulls(len(of[s]), whole.field(c).type) for c in kept}
                    | {"n_leaves": before[0][s], "saved": before[1][s], "_shard": np.full(len(of[s]), shard), "_depth": of[s],
                       "_node": np.zeros(len(of[s]), bool)}).cast(whole)

    types = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    whole = pa.schema([(c, types[placed.schema[c].dataType.simpleString()]) for c in kept]
                      + [("n_leaves", pa.int64()), ("saved", pa.int64()), ("_shard", pa.int64()), ("_depth", pa.int64()), ("_node", pa.bool_())])
    rows = placed.repartition(parts, "shard").sortWithinPartitions("shard", "place").mapInArrow(
        run, schema + ", n_leaves long, saved long, _shard long, _depth long, _node boolean")
    rows = cut(rows, "subtrees")
    rest = rows.where("NOT _node").select("_shard", "_depth", F.col("n_leaves").alias("_leaves"), F.col("saved").alias("_saved"))
    done, open_ = rows.where("_node AND _shard < 0"), rows.where("_node AND _shard >= 0")
    merged = open_.join(rest, ["_shard", "_depth"], "left")
    return done.select(*kept, "n_leaves", "saved").unionByName(merged.select(
        *kept, (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved")))


def build(own: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes from ``share_heads``' turns and conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    size = convs.agg(F.min("conv"), F.count(F.lit(1))).first()
    root, n_convs = size[0], size[1]
    members = cut(_members(own, convs), "members")
    nodes = members.groupBy("d", "p1", "p2").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"),
                                                 F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    top = convs.sparkSession.range(0 if root is None else 1).select(
        *[F.lit(0).cast("long").alias(c) for c in ("d", "p1", "p2")], F.lit(root).cast("long").alias("conv_id"),
        F.lit(n_convs).cast("long").alias("n_convs"), *[F.lit(0).cast("long").alias(c) for c in ("words", "q1", "q2")])
    nodes = cut(nodes.unionByName(top), "paths")
    if root is None:
        root = 0
    depth = F.greatest(F.col("n") - F.col("skip"), F.lit(0)) + F.size("heads")
    lengths = convs.select("conv", depth.cast("long").alias("d"))
    ends = lengths.join(members.select("conv", "d", "p1", "p2"), ["conv", "d"], "left")
    ends = ends.select("conv", "d", F.coalesce("p1", F.lit(0)).alias("p1"), F.coalesce("p2", F.lit(0)).alias("p2"))
    chains = _chain_starts(nodes, root)
    hung = chains.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("d")).agg(
        F.count(F.lit(1)).alias("_hung"))
    full = (nodes.join(_end_digests(ends), ["d", "p1", "p2"], "left").join(hung, ["conv_id", "d"], "left").join(chains, "conv_id"))
    full = full.select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", (F.coalesce("_hung", F.lit(0)) + (F.col("d") < F.col("bottom")).cast("long")).cast("long").alias("n_children"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"),
        (F.col("start") + F.col("d") - F.col("top")).alias("place"))
    return subtree_sums(full).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                     F.col("saved").alias("saved_tokens"), "ends_sha256")
