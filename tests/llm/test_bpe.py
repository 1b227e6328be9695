import hashlib
import random

import duckdb
import numpy as np
import pytest
import tiktoken

from fairgauge.llm import bpe
from fairgauge.llm.queries import QUERIES


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids_of(encoder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)]


def by_hand(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The least rank first, the leftmost of equal ones."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if found is None:
            return [ranks[p] for p in parts]
        i = found[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_op12_equals_the_library(spark, sf_small, library):
    rows = {r.doc_id: r for r in QUERIES["op12_byte_bpe"](spark, sf_small).collect()}
    texts = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf_small}/documents.parquet'").fetchall()
    assert len(rows) == len(texts)
    for k, text in texts:
        ids = library(text)
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_splits_as_the_library(ranks, library):
    encoder = bpe.Encoder(ranks, bpe.pattern())
    texts = ["", " ", "  a  b ", "x \n y", "\n\n  z  q", "don't we'll\tgo", "<|endoftext|> a", "\x1c x\x1d \x85   .", "a ", "a  ",
             "1 22 333 !!! ??", "a​ b　 c", "x  y", "é 🙂👩‍👩‍👧"]
    texts += [f"x{chr(c)}y {chr(c)} 1{chr(c)} .{chr(c)}" for c in [*range(0, 0x3100), *range(0xFE00, 0x10000)]]
    assert ids_of(encoder, texts) == [library(t) for t in texts]


@pytest.mark.parametrize("size", [2, 70, 3_000, 300_000])
def test_long_pretokens_equal_the_library(ranks, library, size):
    encoder, rng = bpe.Encoder(ranks, bpe.pattern()), random.Random(size)
    texts = ["".join(rng.choices(letters, k=size)) for letters in ("a", "ab", "etaoinshrdlu", "aAéä漢字")]
    assert ids_of(encoder, texts) == [library(t) for t in texts]


def test_any_vocabulary_keeps_the_order_of_merges():
    """Vocabularies whose later tokens have lower ranks than their parts: the whole bucket can't be merged at once."""
    rng = random.Random(3)
    seen = 0
    for _ in range(300):
        words = {bytes([b]) for b in b"abc"}
        while len(words) < 14:
            words.add(bytes(rng.choices(b"abc", k=rng.randint(2, 5))))
        order = rng.sample(sorted(words), len(words))
        ranks = {w: i for i, w in enumerate(order)}
        merges = bpe.Merges(ranks)
        seen += bool(merges.lowers.any())
        pieces = [bytes(rng.choices(b"abc", k=rng.randint(1, 40))) for _ in range(20)]
        pieces = [p for p in pieces if p not in ranks]
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.merge_all(pieces, merges)] == [by_hand(p, ranks) for p in pieces]
    assert seen > 100


def test_queue_gives_ranks_in_order():
    queue, rng = bpe.RankQueue(300_000), random.Random(1)
    assert len(queue.levels) == 4
    entries = [(rng.randrange(300_000), i) for i in range(5_000)]
    queue.push([r for r, _ in entries], [i for _, i in entries])
    got = []
    while (entry := queue.take()) is not None:
        got += [(entry[0], i) for i in sorted(entry[1])]
    assert got == sorted(entries) and not any(map(any, queue.levels))


def test_bpe_awkward(awkward, none, library, tmp_path):
    carry = ["doc_id", "text", "lang", "key"]
    coded = bpe.decode(bpe.encode(awkward.withColumnRenamed("size", "n_tokens"), carry=carry + ["n_tokens"]))
    coded.write.parquet(str(tmp_path / "x"))
    rows = coded.collect()
    assert coded.columns == ["doc_id", "n_tokens", "ids", "doc_id_", "text", "lang", "key", "n_tokens_", "decoded"]
    assert len(rows) == awkward.count()
    for r in rows:
        text = r.text or ""
        assert r.ids == library(text) and bytes(r.decoded) == text.encode() and r.n_tokens == len(r.ids) and r.n_tokens_ == -7
    assert bpe.decode(bpe.encode(none)).collect() == []


def test_decoding_null_and_foreign_ids(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (2, None), (3, [])], "k int, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(rows).orderBy("k").collect()][1:] == [b"", b""]
    with pytest.raises(Exception, match="vocabulary|OutOf|out of bounds"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "k int, ids array<int>")).collect()


def test_a_text_is_split_once(monkeypatch):
    ranks = bpe.load_ranks(bpe.vocabulary_path())
    split, calls = bpe.Encoder._stretches, []
    monkeypatch.setattr(bpe.Encoder, "_stretches", lambda self, text: calls.append(text) or split(self, text))
    texts = ["two  spaces and\n lines", "", "a b a b", "x" * 200 + "  y"]
    ids = bpe.Encoder(ranks, bpe.pattern())(texts)
    assert sorted(calls) == sorted(texts)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 1)
    assert bpe.Encoder(ranks, bpe.pattern())(texts) == ids
