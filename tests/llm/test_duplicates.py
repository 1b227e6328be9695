import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fairgauge.llm import common, embedding_caps, simhash, suffix_dedup
from fairgauge.llm.queries import QUERIES
from tests.llm.test_packing_mixing_sharding import WORD, texts_of


def components(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# -- connected components

@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)],
                                   [(5, 5), (7, 3), (3, 7)], [(i, (i * 7) % 101) for i in range(101)] + [(200, 201), (202, 201)]])
def test_connected_components(spark, edges):
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    place = {x: i for i, x in enumerate(nodes)}
    roots = components(len(nodes), [(place[a], place[b]) for a, b in edges if a != b])
    assert got == {x: nodes[roots[place[x]]] for x in nodes}


# -- SimHash

def plain_fingerprint(text):
    import xxhash
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "One two", "a b c", "A B C D a b c d", "É é İ ß 漢 字 x", "x " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def brute_components(prints):
    x = np.array(prints, np.uint64)
    links = [(i, i + 1 + int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= 2)]
    return components(len(x), links)


def test_op5_equals_brute_force(spark, sf_small):
    texts = sorted(texts_of(sf_small).items())
    prints = [plain_fingerprint(t) for _, t in texts]
    roots = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash_gray"](spark, sf_small).collect()}
    assert got == {k: (f"{p:016x}", texts[r][0]) for (k, _), p, r in zip(texts, prints, roots)}


def near_prints(rng, centres, each):
    out = set()
    for c in rng.integers(0, 1 << 63, centres, dtype=np.uint64):
        for _ in range(each):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            out.add(int(c) ^ sum(1 << int(b) for b in flips))
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("split_above", [4096, 8])
def test_links_of_near_fingerprints(spark, monkeypatch, split_above):
    monkeypatch.setattr(simhash, "SPLIT_ABOVE", split_above)
    prints = near_prints(np.random.default_rng(7), 12, 60) + [0, 1, 3]
    roots = brute_components(prints)
    links = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"))
    got = {r.node: r.root for r in common.connected_components(links).collect()}
    named = [got.get(signed(p), signed(p)) for p in prints]
    assert len(set(zip(roots, named))) == len(set(roots)) == len(set(named)) > 12


def test_gray_links_equal_all_pairs():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    levels = [np.uint64(0xF00), np.uint64(0xFF0), np.uint64(0xFFF)]
    i, j = simhash.gray_links(codes, np.zeros(len(codes)), levels, 2)
    want = {(a, b) for a, b in itertools.combinations(range(len(codes)), 2) if int(codes[a] ^ codes[b]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(1 << 10, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_simhash_awkward(awkward, none):
    rows = simhash.near_duplicates(awkward, carry=["text", "size"]).collect()
    assert len(rows) == 10
    groups = {}
    for r in rows:
        groups.setdefault(plain_fingerprint(r.text), set()).add(r.component_id)
    assert all(len(g) == 1 for g in groups.values()) and groups[0] == {3}
    kept = simhash.representatives(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 6), (False, 7), (True, 0)]
    assert simhash.near_duplicates(none).count() == 0 and simhash.representatives(none).count() == 0


# -- embeddings

def brute_links(vectors, labels):
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = (x @ x.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(hit, False)
    return hit


def test_op10_recall_and_precision(spark):
    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()
    want = brute_links([r[1] for r in rows], [r[2] for r in rows]).sum(1)
    got = {r.vec_id: r for r in QUERIES["op10_embedding_caps"](spark, sf).collect()}
    found = np.array([got[r[0]].n_links for r in rows])
    assert len(got) == len(rows) and (found <= want).all()
    assert found.sum() >= 0.95 * want.sum()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_clusters(spark, monkeypatch):
    monkeypatch.setattr(embedding_caps, "SPLIT_ABOVE", 16)         # so that filters are parted into chunks
    rng = np.random.default_rng(2)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(32)
        for _ in range(40):
            rows.append((len(rows), (centre + 0.15 * rng.standard_normal(32)).astype(np.float32).tolist(), c % 2))
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)] + [(2000, rows[0][1], 1)]
    hit = brute_links([r[1] for r in rows], [r[2] for r in rows])
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_caps.near_duplicates(docs).collect()}
    found = np.array([got[r[0]].n_links for r in rows])
    assert (found <= hit.sum(1)).all() and found.sum() >= 0.95 * hit.sum()
    assert got[1005].n_links >= 30 and got[2000].component_id == 2000
    assert len({got[i].component_id for i in range(40)}) == 1


def test_list_filters_is_exact():
    rng = np.random.default_rng(4)
    code = embedding_caps.product_code(10, 3, 5, 1)
    x = embedding_caps._unit(rng.standard_normal((50, 10)))
    row, name = embedding_caps.list_filters(x, code, 0.4)
    want = set()
    for words in itertools.product(range(5), repeat=3):
        direction = np.concatenate([c[:, w] for c, w in zip(code, words)])
        for i in np.flatnonzero(x @ direction >= 0.4):
            want.add((int(i), words[0] * 25 + words[1] * 5 + words[2]))
    assert set(zip(row.tolist(), name.tolist())) == want and len(row) == len(want)


def planted(rng, n, cosine, dim=64):
    """``n`` lone pairs of unit vectors at ``cosine``."""
    one = embedding_caps._unit(rng.standard_normal((n, dim)))
    off = rng.standard_normal((n, dim))
    off = embedding_caps._unit(off - (off * one).sum(1, keepdims=True) * one)
    return one, cosine * one + np.sqrt(1 - cosine ** 2) * off


@pytest.mark.parametrize("n, cosine", [(2_000, 0.93), (20_000, 0.93), (1_000_000, 0.93), (1_000_000, 0.96), (100_000_000, 0.93)])
def test_every_vector_has_filters_and_lone_pairs_share_one(n, cosine):
    words = int(np.ceil(n ** 0.25))
    each = embedding_caps.calibrate(64, words, 0.93, embedding_caps.PASSES, 42)
    made = embedding_caps.codes(64, words, 42)
    sides = [embedding_caps.own_filters(x, made, each) for x in planted(np.random.default_rng(5), 1000, cosine)]
    for row, _ in sides:
        assert (np.bincount(row, minlength=1000) == embedding_caps.CODES * each).all()
    held = [set(zip(row.tolist(), name.tolist())) for row, name in sides]
    assert len({row for row, _ in held[0] & held[1]}) >= 985


def test_own_alpha_is_the_kth_best():
    code = embedding_caps.product_code(10, 3, 5, 1)
    x = embedding_caps._unit(np.random.default_rng(4).standard_normal((50, 10)))
    every = np.stack([x @ np.concatenate([c[:, w] for c, w in zip(code, words)]) for words in itertools.product(range(5), repeat=3)], 1)
    for k in (1, 7, 40, 125):
        assert np.allclose(embedding_caps.own_alpha(x, code, k), np.sort(every, 1)[:, -k], atol=1e-9)


@pytest.mark.parametrize("dim", [2, 5, 64])
def test_embedding_recall_of_lone_pairs_and_a_hot_cluster(spark, dim):
    rng = np.random.default_rng(6)
    one, two = planted(rng, 700 if dim == 64 else 60, 0.96, dim)
    axis = np.eye(dim)[rng.integers(0, dim, 60)]                      # zero in all blocks but one
    hot = np.ones(dim) / np.sqrt(dim) + 0.15 / np.sqrt(dim) * rng.standard_normal((300, dim))
    x = np.concatenate([one, two, axis, axis + 0.2 / np.sqrt(dim) * rng.standard_normal((60, dim)), hot])
    labels = np.r_[np.arange(len(one)), np.arange(len(one)), np.arange(120) % 60, np.zeros(300, int)] % 50
    labels[-300:] = 50
    hit = brute_links(x, labels)
    docs = spark.createDataFrame([(i, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), labels))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_caps.near_duplicates(docs).collect()}
    found, want = np.array([got[i] for i in range(len(x))]), hit.sum(1)
    assert (found <= want).all()
    for part in (slice(0, 2 * len(one)), slice(2 * len(one), len(x) - 300), slice(len(x) - 300, len(x))):
        assert found[part].sum() >= 0.98 * want[part].sum() > 0


def test_embedding_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, 0.0], None),
            (7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (8, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [1e-300, 0.0], 1),
            (11, [], 1), (1, None, 1)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, n long")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in embedding_caps.near_duplicates(docs).collect())
    assert got == [(0, 0, None), (1, 0, 1), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 3, 7), (7, 3, 7), (8, 3, 7),
                   (9, 0, 9), (10, 3, 7), (11, 0, 11)]
    assert embedding_caps.near_duplicates(docs.limit(0)).count() == 0


# -- repeated strings

def brute_removal(texts, least):
    places = {}
    for k, b in enumerate(texts):
        for i in range(len(b) - least + 1):
            places[b[i:i + least]] = places.get(b[i:i + least], 0) + 1
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - least + 1):
            if places[b[i:i + least]] > 1:
                gone[i:i + least] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = len(re.findall(b"\x01+", gone.astype(np.uint8).tobytes()))
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_op7_equals_brute_force(spark, sf_small):
    texts = sorted(texts_of(sf_small).items())
    want = brute_removal([t.encode() for _, t in texts], 200)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_suffix_cover"](spark, sf_small).collect()}
    assert got == {k: w for (k, _), w in zip(texts, want)}


def test_op7_edges_of_matches(frame, monkeypatch):
    """Matches at both ends of documents, of exactly 200 and 199 bytes, overlapping themselves, over many blocks and stretches."""
    monkeypatch.setattr(suffix_dedup, "STRETCH", 257)
    rng = np.random.default_rng(11)
    noise = lambda n: "".join(rng.choice(list("abcdefghij klmnop\n"), n))
    a, b, c = noise(200), noise(199), noise(1400)
    texts = [a + noise(300), noise(300) + a, noise(50) + b + noise(50), b + noise(400), noise(90) + c[100:] + noise(3), c, c,
             "z" * 450, "é" * 120, "xy" * 99 + "x", noise(130) + c[700:1000] + noise(120) + c[:333], "", None, a, "q" * 200]
    want = brute_removal([(t or "").encode() for t in texts], 200)
    docs = frame([(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.dedup(docs, block_bytes=1000, bucket_names=50, carry=["size"]).collect()}
    assert got == dict(enumerate(want))


def test_difference_cover():
    cover = suffix_dedup.difference_cover(11)
    assert len(cover) == 12 and {(x - y) % 133 for x in cover for y in cover} == set(range(133))


def test_suffix_awkward(awkward, none):
    assert suffix_dedup.dedup(awkward).count() == 10 and suffix_dedup.dedup(none).count() == 0
