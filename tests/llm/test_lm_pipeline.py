import collections
import math
import zlib

import numpy as np
import pytest

import corpus_pipeline
from fairgauge.llm import common, ngram_trie
from fairgauge.llm.queries import QUERIES
from tests.llm.test_packing_mixing_sharding import WORD, texts_of


# -- Elias-Fano and trie

@pytest.mark.parametrize("values", [[], [0], [7], [0, 0, 0], [0, 1, 1, 5, 1000, 1 << 40], list(range(500)), [3] * 200,
                                    np.sort(np.random.default_rng(1).integers(0, 1 << 33, 3000)).tolist(),
                                    np.sort(np.random.default_rng(2).integers(0, 900, 3000)).tolist()])
def test_elias_fano(values):
    v = np.array(values, np.uint64)
    ef = ngram_trie.EliasFano.of(v)
    assert (ef.access(np.arange(len(v))) == v).all()
    top = int(v[-1]) if len(v) else 0
    ask = np.unique(np.concatenate([v, v + np.uint64(1), np.array([0, top // 2, top + 1, top * 3 + 9], np.uint64)]))
    found = ef.successor(ask)
    at = np.searchsorted(v, ask)
    assert ((found == at) | ((at == len(v)) & (found >= len(v)))).all()
    if len(v) > 1000:
        assert 8 * len(b"".join(ef.parts())) < len(v) * (3 + max(1, math.log2(max(1, top / len(v))))) + 1000


def test_trie_find_and_dump():
    rng = np.random.default_rng(3)
    context, follower = rng.integers(0, 50, 4000).astype(np.uint64) * np.uint64(1 << 50), rng.integers(0, 300, 4000).astype(np.uint64) * np.uint64(77)
    counts = collections.Counter(zip(context.tolist(), follower.tolist()))
    trie = ngram_trie.Trie.of(context, follower, np.ones(4000, np.int64), lambda c, n: n / 100)
    trie = ngram_trie.Trie.load(trie.dump())
    asked = np.unique(np.r_[context, np.uint64(12345)])
    every = np.unique(np.r_[follower, np.uint64(5), np.uint64(1 << 47)])
    steps = trie.find(asked, np.full(len(asked), len(every)), np.tile(every, len(asked)))
    values = ngram_trie.step_values()
    for (c, f), s in zip(((c, f) for c in asked.tolist() for f in every.tolist()), steps.tolist()):
        want = counts.get((c, f), 0) / 100
        assert (s == 0) == (want == 0) and (not want or abs(math.log10(values[s]) - math.log10(want)) <= 0.5 / ngram_trie.STEP + 1e-9)


def brute_scores(rows, mu=500.0):
    """``rows`` of (id, text): the contract's figures and the unquantised model."""
    split = [WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["\n"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    one, two = collections.Counter(), collections.Counter()
    for w, h in zip(split, held):
        if not h:
            one.update(w)
            two.update(zip(["\t"] + w, w))
    n, v = sum(one.values()), len(one)
    before = dict(one) | {"\t": one["\n"]}
    out = []
    for w, h in zip(split, held):
        p1 = [(one.get(x, 0) + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        full = [(two.get((u, x), 0) + mu * p) / (before.get(u, 0) + mu) for u, x, p in zip(["\t"] + w, w, p1)]
        out.append((h, len(w), sum(one.get(x, 0) > 0 for x in w), n, sum(map(math.log10, p1)), sum(map(math.log10, full))))
    return out


def close(got, want):
    assert got[:4] == want[:4]
    assert abs(got[4] - want[4]) <= 1e-9 * abs(want[4]) + 1e-9
    assert abs(got[5] - want[5]) <= got[1] * 0.5 / ngram_trie.STEP + 1e-6


FIGURES = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def test_op8_equals_brute_force_and_beats_the_base(spark, sf_small):
    texts = sorted(texts_of(sf_small).items())
    got = {r.doc_id: tuple(r[c] for c in FIGURES) for r in QUERIES["op8_lm_trie"](spark, sf_small).collect()}
    for (k, _), want in zip(texts, brute_scores(texts)):
        close(got[k], want)
    held = [x for x in got.values() if x[0]]
    assert sum(x[5] for x in held) > sum(x[4] for x in held)


def test_scores_over_many_blocks_and_spread_contexts(frame):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["the"] * 3 + [f"w{k}" for k in rng.integers(0, 40, 30)] + ["the", "End"]), "s") for i in range(60)]
    rows += [(7, "the the the", "s")] * 5 + [(None, "W1 the", "s"), (70, None, "s"), (71, "", "s"), (72, "ÀÉ é 漢", "s")]
    got = ngram_trie.score(frame(rows), block_bytes=700, shard_bytes=100, spread=10).collect()
    want = sorted(brute_scores([(i, t) for i, t, _ in rows]))
    assert len(got) == len(rows)
    for a, b in zip(sorted(tuple(r[c] for c in FIGURES) for r in got), want):
        close(a, b)


def test_lm_awkward(awkward, none, spark):
    assert ngram_trie.score(awkward).count() == 10 and ngram_trie.score(none).count() == 0
    tries = ngram_trie.train(awkward).collect()
    assert sum(len(ngram_trie.Trie.load(bytes(r.trie)).steps) for r in tries) > 0


# -- pipeline

def test_pipeline_stages(spark, sf_small, tmp_path):
    docs = common.table(spark, sf_small, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "pii", "mix", "pack"]
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_small)
        if i < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS) and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
    rows = {n: [r.asDict() for r in d.collect()] for n, d in seen.items()}
    from fairgauge.llm import pii
    from tests.llm.test_duplicates import brute_components, plain_fingerprint
    good = sorted(rows["quality"], key=lambda r: r["doc_id"])
    roots = brute_components([plain_fingerprint(r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in rows["near_duplicates"]) == [r["doc_id"] for k, r in enumerate(good) if roots[k] == k]
    texts = {r["doc_id"]: r["text"] for r in good}
    assert all(r["text"] == pii.redact_text(texts[r["doc_id"]], pii.find_spans(texts[r["doc_id"]])) for r in rows["pii"])
    assert all(r["n_chars"] == len(r["text"]) for r in rows["pii"])
    assert {r["doc_id"] for r in rows["mix"]} <= {r["doc_id"] for r in rows["pii"]}
    times = collections.Counter(r["doc_id"] for r in rows["mix"])
    assert max(times.values()) <= 3
    packed = collections.Counter(r["doc_id"] for r in rows["pack"] if r["start"] == 0)
    assert packed == times


def test_stages_on_awkward_rows(spark, awkward, none, sf_small):
    columns = list(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.select(*columns), sf_small).count() >= 0, name
        assert stage(spark, none.select(*columns), sf_small).count() == 0, name


def test_run_is_registered(spark, sf_small):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}_" for n in range(1, 11)} <= {k.split("_")[0] + "_" for k in entry.queries()}


# -- exchange helpers and written tables

def test_distinct_and_order():
    from fairgauge.llm.exchange import distinct, order_of
    rng = np.random.default_rng(0)
    cases = [rng.integers(0, hi, n, dtype=np.uint64) for n in (0, 1, 2, 1000, 70_000) for hi in (3, 1 << 20, 1 << 63)]
    close_by = (rng.integers(0, 50, 5000, dtype=np.uint64) << np.uint64(40)) | rng.integers(0, 4, 5000, dtype=np.uint64)
    for v in [*cases, close_by, close_by[:60] + np.uint64(1 << 62)]:
        names, number = np.unique(v, return_inverse=True)
        got = distinct(v)
        assert (got[0] == names).all() and (got[1] == number).all() and (np.diff(v[order_of(v)].astype(float)) >= 0).all()


def test_written_tables_can_be_dropped(spark):
    made = common._TABLES.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    kept = common.cut(spark.range(3), "kept")
    assert kept.count() == 3 and len(made) == before + 1
    path = made[-1]
    common.drop_tables(spark, since=before)
    assert len(made) == before
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
