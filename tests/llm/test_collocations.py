import collections
import random
import re

import numpy as np
import pytest

from fairgauge.llm import collocations as co
from fairgauge.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, duck


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def pieces(rows):
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            if words := re.findall(r"[^\x20\x09]+", piece):
                yield lang or "und", words


def brute_counts(rows, longest):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, words in pieces(rows):
        totals[lang] += len(words)
        for k in range(1, longest + 1):
            for i in range(len(words) - k + 1):
                counts[lang, tuple(words[i:i + k])] += 1
    return counts, totals


def brute(rows, longest=5, least=100, top=2000):
    counts, totals = brute_counts(rows, longest)
    found = collections.defaultdict(list)
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < least:
            continue
        s, k = min((1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        if any(b >= a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
               for (m, q), b in counts.items() if m == lang and b >= least):
            continue
        found[lang].append((-s, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, every in found.items()
            for i, (s, a, p, l, r) in enumerate(sorted(every)[:top])}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 7) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int")


@pytest.fixture
def corpus():
    """Pieces of all lengths, copies of long passages, hot words, and words of two texts that meet at no place."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ärger", "漢字", "it's"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    passage = " ".join(rng.choices(vocabulary, weights, k=300))
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 2, 3, 4, 5, 6, 9, 40]))) for _ in range(rng.randint(1, 8))]
        if i % 5 == 0:
            parts.append("New YORK\tcity  hall")
        rows.append((rng.choice([". ", ",", "\n", " ! ", "\r\n"]).join(parts), rng.choice(["en", "de", None])))
        if i % 7 == 0:
            rows.append((passage + " " + parts[0], "en"))
    return rows + [(None, "en"), ("", None), (" \t .", "fr"), ("und nur", "und")]


def test_mine_equals_brute_force(spark, corpus):
    for longest, least, top in ((5, 4, 2000), (3, 6, 25), (2, 5, 3)):
        got = {tuple(r) for r in co.mine(docs_of(spark, corpus), longest, least, top).collect()}
        assert got == brute(corpus, longest, least, top) and got


def test_counts_are_exact(spark, corpus):
    counts, totals = brute_counts(corpus, 4)
    got, n = co.phrase_counts(docs_of(spark, corpus), 4, 2)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in got.collect()} == {k: v for k, v in counts.items() if v >= 2}
    assert {r.lang: r.n for r in n.collect()} == dict(totals)


def test_chunks_cover_each_start_once(corpus):
    texts = [lower(t).encode() for t, _ in corpus if t]
    w = co.Words(texts)
    first, sizes, last = co._chunks(w, 4)
    owned = np.concatenate([np.arange(f, f + s - (0 if z else 4)) for f, s, z in zip(first, sizes, last)])
    assert sorted(owned) == list(range(len(w)))
    assert max(sizes) > 5 and (~last).any()
    ends = {f + s for f, s, z in zip(first, sizes, last) if not z}
    assert all(e - 4 in set(first) for e in ends)                      # chunks overlap by a whole trigger window


def test_copied_passages_share_chunks(spark):
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randrange(500)}" for _ in range(2000))
    rows = [(f"lead{i} " * i + passage, "en") for i in range(10)]
    chunks = co.parse(docs_of(spark, rows), 4).collect()
    assert sum(c.n for c in chunks) > 5 * len(chunks)


def test_a_full_bitmap_changes_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(co, "MAX_BITS", 64)
    assert {tuple(r) for r in co.mine(docs_of(spark, corpus), 5, 4).collect()} == brute(corpus, 5, 4)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10 ** 12
    counts = spark.createDataFrame([("en", 1, "x", 3 * big + 1), ("en", 1, "y", 2 * big + 1), ("en", 2, "x y", big + 7)], "lang string, k int, phrase string, f long")
    totals = spark.createDataFrame([("en", 9 * big + 11)], "lang string, n long")
    assert co.score(counts, totals).first().score == 1000 * (big + 7) * (9 * big + 11) // ((3 * big + 1) * (2 * big + 1))


def test_the_ranking_is_limited_before_languages_meet(spark, corpus):
    plan = co.mine(docs_of(spark, corpus), 3, 4, 10)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_collocations_awkward(awkward, none, tmp_path):
    rows = [(r.text, r.lang) for r in awkward.collect()]
    got = co.mine(awkward, least=2)
    got.write.parquet(str(tmp_path / "x"))
    assert {tuple(r) for r in got.collect()} == brute(rows, least=2)
    assert co.mine(none).collect() == []


def test_op11_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    ok, message = compare(QUERIES["op11_phrase_parsing"](spark, sf), duck(sf).execute(ORACLE["op11_phrase_parsing"]).df())
    assert ok and not message.startswith("0 "), message
