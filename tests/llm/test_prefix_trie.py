import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairgauge.llm import prefix_trie as pt
from fairgauge.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, duck

TURNS = "conv_id long, turn long, role string, text string, d long, pos int, words string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, -1, 3, "x") for r in rows], TURNS)


def trie(spark, rows, heads=True):
    turns = pt.order_turns(frame(spark, rows))
    base = F.col("conv") - F.col("conv") % 20 if heads else F.col("conv")
    return pt.build(*pt.share_heads(turns, F.crc32(F.col("conv").cast("string")) % 4, base))


def brute(rows, heads=True):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if heads else 0
        built[c] = (own.get(c - c % 20, [])[:h] if heads else []) + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    children = collections.Counter(p[:-1] for p in members if p)
    sums = collections.defaultdict(lambda: [0, 0])
    for p, m in members.items():
        saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            sums[p[:d]][0] += children[p] == 0
            sums[p[:d]][1] += saved
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), children[p], *sums[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def rows_of(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture
def small_shards(monkeypatch):
    """Shards of a few nodes and turns, so that spines cross many of them."""
    monkeypatch.setattr(pt, "SHARD_NODES", 7)
    monkeypatch.setattr(pt, "SHARD_TURNS", 5)


def shared(rng, n, choices, longest):
    return [(c, i if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None, "d e f"][:choices]))
            for c in range(n) for i in range(rng.randint(1, longest))]


def test_trie_equals_brute_force_over_many_shards(spark, small_shards):
    rng = random.Random(8)
    rows = shared(rng, 90, 2, 9)
    assert rows_of(trie(spark, rows)) == brute(rows)
    rows = [(c, i, "user", "x y" if rng.random() < 0.9 else "z") for c in range(60) for i in range(rng.randint(1, 14))]
    assert rows_of(trie(spark, rows, heads=False)) == brute(rows, heads=False)


def test_one_long_conversation_and_a_staircase(spark, small_shards):
    """A third of all rows in one conversation; chains that hang on each other, one a step; many copies."""
    rows = [(3, i, "user", f"t{i % 7}") for i in range(150)]
    rows += [(100 + c, i, "bot", "step" if i < c else f"turn {c}") for c in range(16) for i in range(c + 1)]
    rows += [(200 + c, i, "user", f"t{i % 7}") for c in range(30) for i in range(4)]
    assert rows_of(trie(spark, rows, heads=False)) == brute(rows, heads=False)
    assert rows_of(trie(spark, rows)) == brute(rows)


def test_trie_awkward(spark, tmp_path):
    rows = [(0, 1, "user", "same"), (0, 1, "user", "same"), (0, None, None, None), (5, 0, "a", "b"), (5, 0, "a", "a"), (45, 0, None, ""), (45, 1, "x", "y"),
            (None, 0, "user", "lost"), (-3, 0, "user", "minus"), (7, 3, "a b", "c"), (8, 3, "a", "b c"), (20, 0, "user", " ".join(["long"] * 50_000))]
    got = trie(spark, rows)
    got.write.parquet(str(tmp_path / "x"))
    want = brute([r for r in rows if r[0] != -3])
    # Spark's remainder keeps the sign: the base of -3 is conversation 0.
    h = zlib.crc32(b"-3") % 4
    assert {k: v for k, v in rows_of(got).items() if v[1] == 1 and k[0] > 20} == {k: v for k, v in want.items() if v[1] == 1 and k[0] > 20}
    assert rows_of(trie(spark, [r for r in rows if r[0] != -3])) == want and h in range(4)
    assert trie(spark, [(None, 0, "a", "b")]).collect() == [] and trie(spark, []).collect() == []


def test_turnless_conversations_end_at_the_root(spark):
    """Conversations whose few turns are all replaced by those of an absent base."""
    rows = [(c, 0, "user", "hi") for c in range(21, 40)]
    got = brute(rows)
    assert rows_of(trie(spark, rows)) == got and got[21, 0][1] == 19 and got[21, 0][5] != pt.EMPTY_SHA256


def test_findclose_equals_a_stack():
    rng = np.random.default_rng(4)
    for n, start, up in ((1, 0, 0.5), (50, 0, 0.5), (4000, 0, 0.55), (4000, 900, 0.4), (3000, 5, 0.95)):
        depths = [start]
        while len(depths) < n:
            depths.append(depths[-1] + 1 if rng.random() < up else int(rng.integers(max(depths[-1] - 12, 0), depths[-1] + 1)))
        depths = np.array(depths)
        p = pt.Parentheses(depths, False)
        stack, want = [], np.full(len(p.bits), len(p.bits))
        for i, opened in enumerate(p.bits):
            if opened:
                stack.append(i)
            elif stack:
                want[stack.pop()] = i
        assert (p.findclose(p.opens) == want[p.opens]).all()


def test_op13_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    ok, message = compare(QUERIES["op13_prefix_trie"](spark, sf), duck(sf).execute(ORACLE["op13_prefix_trie"]).df())
    assert ok, message
