import numpy as np
import pytest

from fairgauge.llm import ngram_trie, pii, suffix_dedup
from fairgauge.llm.exchange import Names
from fairgauge.llm.hashes import PRIME, Polynomial, powers, reduced, times
from tests.llm.test_duplicates import brute_removal

#: Different 200-byte windows whose polynomials modulo 2^64 agree (patterned differences; a common tail).
PATTERNED = [
    "h2@@2@22@@22@2@@2@22@2@@22@@2@22@4@@4@44@@44@4@@4@44@4@@44@@4@44@k99k9kk99kk9k99k9kk9k99kk99k9kk9GYYGYGGYYGGYGYYGYGGYGYYGGYYGYGGY"
    "a common tail of seventy two bytes that both of these windows really shasreltpuscta pirhgwpr rpmuehueqmxavycfysbjya iptxmwznmxzsoeld",
    "b@22@2@@22@@2@22@2@@2@22@@22@2@@2@44@4@@44@@4@44@4@@4@44@@44@4@@49kk9k99kk99k9kk9k99k9kk99kk9k99kYGGYGYYGGYYGYGGYGYYGYGGYYGGYGYYG"
    "a common tail of seventy two bytes that both of these windows really shaepgivnyujnq mslrsnshkvaitvwfwkrssdwugu sijdcpupclzcneajnyndb"]


def test_arithmetic_equals_integers():
    rng = np.random.default_rng(1)
    x = np.r_[rng.integers(0, PRIME, 3000, dtype=np.uint64), np.array([0, 1, PRIME - 1, PRIME - 2, 1 << 31, (1 << 31) - 1], np.uint64)]
    for y in (x[::-1], np.full(len(x), PRIME - 1, np.uint64)):
        assert times(x, y).tolist() == [a * b % PRIME for a, b in zip(x.tolist(), y.tolist())]
    big = np.array([PRIME, PRIME + 1, (1 << 64) - 1, (1 << 63) + 5, 2 * PRIME], np.uint64)
    assert reduced(big).tolist() == [v % PRIME for v in big.tolist()]
    assert powers(123456789123, 300).tolist() == [pow(123456789123, k, PRIME) for k in range(300)]


@pytest.mark.parametrize("alphabet", [256, 1])
def test_hashes_of_windows_depend_on_their_bytes_alone(alphabet):
    rng = np.random.default_rng(2)
    data = rng.integers(256 - alphabet, 256, 3000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 2900, 400))
    ends = starts + rng.integers(1, 100, 400)
    whole = Polynomial(np.random.default_rng(9), 4000).windows(data, starts, ends).tolist()
    alone = [int(Polynomial(np.random.default_rng(9), 4000).windows(data[s:e], np.array([0]), np.array([e - s]))[0]) for s, e in zip(starts, ends)]
    assert whole == alone
    by_bytes = {data[s:e].tobytes(): h for s, e, h in zip(starts, ends, whole)}
    assert len(set(by_bytes.values())) == len(by_bytes)


def test_patterned_text_without_repeats_is_kept(frame):
    docs = [(i, t + f" end {i}", "s") for i, t in enumerate(PATTERNED)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(frame(docs)).collect()}
    assert got == dict(enumerate(brute_removal([t.encode() for _, t, _ in docs], 200)))
    assert all(g[1] == 0 for g in got.values())


def test_names_that_differ_in_further_bits_alone():
    bucket, name = np.zeros(6, np.uint64), np.array([5, 5, 5, 7, 5, 9], np.uint64)
    more = np.array([2, 1, 2, 0, 3, 4], np.uint32)
    n = Names(bucket, name, 1, more)
    assert list(zip(n.values.tolist(), n.more.tolist())) == [(5, 1), (5, 2), (5, 3), (7, 0), (9, 4)]
    assert n.number.tolist() == [1, 0, 1, 3, 2, 4] and n.twice.tolist() == [False, True, False, False, False]

    def body(pairs):
        return np.array([p[0] for p in pairs], "<u8").tobytes() + np.array([p[1] for p in pairs], "<u4").tobytes()
    sent = [[(5, 1), (5, 2), (7, 0)], [(5, 2), (8, 8)], [(5, 3), (7, 1), (8, 8)], [(6, 6)]]
    got = {block: np.unpackbits(np.frombuffer(bits, np.uint8))[:3].tolist()
           for block, _, _, bits in suffix_dedup._shared_wide(3, [10, 11, 12, 13], [body(s) for s in sent])}
    assert got == {10: [0, 1, 0], 11: [1, 1, 0], 12: [0, 0, 1]}


def test_words_in_stretches_and_long_words(monkeypatch):
    monkeypatch.setattr(ngram_trie.WordHash, "STRETCH", 300)
    monkeypatch.setattr(ngram_trie.WordHash, "LONG", 500)
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 100, n).tolist()) for n in rng.integers(1, 6, 900)]
    words += [b"q" * 501, b"r" * 900, b"q" * 501, b"q" * 500, b"a", b"aa", b"aaa"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    both = list(zip(*(h.tolist() for h in ngram_trie.WordHash(5)(data, starts, ends))))
    assert len(set(zip(words, both))) == len(set(words)) == len({a for a, _ in both}) == len({b for _, b in both})


def test_steps_below_a_hundred_millionth():
    """A context of 10^10 tokens: its rare followers keep their own probabilities; other shards keep one byte a code."""
    context, follower = np.full(5, 3, np.uint64), np.arange(5, dtype=np.uint64)
    count = np.array([1, 2, 10, 1000, 9_999_998_987], np.int64)
    trie = ngram_trie.Trie.load(ngram_trie.Trie.of(context, follower, count, lambda c, n: n / (1e10 + 500)).dump())
    steps = trie.find(np.array([3], np.uint64), np.array([5]), follower)
    off = np.log10(ngram_trie.step_values()[steps]) - np.log10(count / (1e10 + 500))
    assert (np.abs(off) <= 0.5 / ngram_trie.STEP + 1e-9).all() and trie.steps.dtype == np.uint16
    small = ngram_trie.Trie.of(context, follower, count, lambda c, n: np.minimum(1.0, n / 1e5))
    assert ngram_trie.Trie.load(small.dump()).steps.dtype == np.uint8


def test_many_ibans_of_unknown_countries():
    one, other = "DE89370400440532013000", "ZZ13 3456 7890 1234 5678 90"
    text = " ; ".join([one, other] * 3000)
    found = [s for s in pii._ibans(text)]
    assert len(found) == 3000 and all(text[s:e] == one for s, e in found)
