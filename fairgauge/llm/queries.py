"""The subpackage's registered queries: each operator over its whole table, with the contract's columns."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairgauge.llm import (bpe, classifier, collocations, embedding_caps, mixing, ngram_trie, packing, pii, prefix_trie,
                           quality_rules, sharding, simhash, suffix_dedup)
from fairgauge.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op2_mix_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op3_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "owner")


@_query
def op4_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), out="found")
    counts = [pii.span_count(F.col("found"), k).alias(f"n_{k}") for k in pii.ALWAYS]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(F.col("found"), pii.ALWAYS), 256).alias("base_sha256"),
                        pii.span_list(F.col("found")).alias("spans"))


@_query
def op5_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "lost_words")


@_query
def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    graded = labels.select("doc_id", classifier.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    scored = classifier.classify(docs, classifier.train(docs, graded))
    return scored.select("doc_id", "score", "expected_grade", "tail", "kept")


@_query
def op10_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_caps.near_duplicates(table(spark, sf_dir, "embeddings"))


@_query
def op7_suffix_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


@_query
def op8_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score(table(spark, sf_dir, "documents"))


@_query
def op11_phrase_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


@_query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.order_turns(table(spark, sf_dir, "conversations"))
    base, head = F.col("conv") - F.col("conv") % 20, F.crc32(F.col("conv").cast("string")) % 4
    return prefix_trie.build(*prefix_trie.share_heads(turns, head, base))


_WORD = r"[^\x20\x09-\x0D]+"

ORACLE["op6_line_frequency"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents),
wi AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM d),
win AS (SELECT r, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM wi WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM win WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
li AS (SELECT r, source, md5(t) AS m, unnest(l) AS x FROM d),
ln AS (SELECT r, source, m, len(regexp_extract_all(x, '{_WORD}')) AS n,
              translate(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h FROM li),
fr AS (SELECT source, h FROM ln GROUP BY source, h HAVING count(DISTINCT m) > {quality_rules.MAX_DOCS}),
lost AS (SELECT r, sum(n) AS n FROM ln JOIN fr ON ln.source IS NOT DISTINCT FROM fr.source AND ln.h = fr.h GROUP BY r),
f AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS lost_words
      FROM d LEFT JOIN cov USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words <= n_words * {quality_rules.MAX_LOST}) AS kept,
       lost_words
FROM f
"""

ORACLE["op2_mix_capped"] = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
                  ('0x' || substr(md5(concat_ws('|', '42', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
-- Sources by the level at which they reach their ceiling; the first k are clamped, for the least k that leaves none above.
o AS (SELECT *, 3.0 * source_size / weight AS reach, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k,
             (SELECT sum(source_size) FROM s) AS total FROM w),
c AS (SELECT *, coalesce(sum(3.0 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
lv AS (SELECT min_by((total - fixed) / free, k) AS level FROM c WHERE reach > (total - fixed) / free),
g AS (SELECT source, source_size, CASE WHEN reach <= level THEN 3.0 * source_size ELSE weight * level END::DOUBLE AS target FROM o, lv),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(least(3.0, target / source_size)) END AS whole FROM g),
r AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest <= 0 THEN 0 WHEN coalesce(before, 0) + size <= rest THEN 1
                             WHEN coalesce(before, 0) <= rest AND rest - coalesce(before, 0) >= 0.5 * size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

ORACLE["op11_phrase_parsing"] = r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang,
                        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
c AS (SELECT lang, k, phrase, count(*) AS f
      FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM p, (VALUES (1), (2), (3), (4), (5)) AS o(k) WHERE len(w) >= k) GROUP BY ALL),
t AS (SELECT lang, sum(f)::HUGEINT AS n FROM c WHERE k = 1 GROUP BY lang),
f AS (SELECT * FROM c WHERE f >= 100),
cuts AS (SELECT f.lang, f.k, f.phrase, f.f AS a, string_split(f.phrase, ' ') AS w, unnest(range(1, f.k)) AS at FROM f WHERE f.k > 1),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, t.n, x.f AS l, y.f AS r, cuts.at,
             1000::HUGEINT * cuts.a * t.n // (x.f::HUGEINT * y.f) AS score
      FROM cuts JOIN t USING (lang)
      JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1:cuts.at], ' ')
      JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[cuts.at + 1:], ' ')
      QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, cuts.at) = 1),
kept AS (SELECT * FROM s WHERE NOT EXISTS (
           SELECT 1 FROM f WHERE f.lang = s.lang AND f.f = s.a AND len(f.phrase) > len(s.phrase)
                             AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""

ORACLE["op13_prefix_trie"] = r"""
WITH k AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
                    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS ct),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
      FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id AS c, list({'m': md5(strlen(role) || ':' || role || text), 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))} ORDER BY i) AS s
      FROM t GROUP BY conv_id),
h AS (SELECT c, s, CASE WHEN c % 20 = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                      lambda a, b: xor(a >> 8, ct[(xor(a, b) & 255) + 1])), 4294967295) % 4 END AS h FROM o, k),
r AS (SELECT h.c, coalesce(b.s[1:h.h], []) || h.s[h.h + 1:] AS s FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
m AS (SELECT c, d, list_transform(s[1:d], lambda x: x.m) AS p, CASE WHEN d = 0 THEN 0 ELSE s[d].w END AS w, len(s) = d AS ends
      FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY p, d),
ch AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
u AS (SELECT p[1:k] AS p, sum((leaf)::INT) AS n_leaves, sum(own) AS saved
      FROM (SELECT n.p, own, ch.n IS NULL AS leaf, unnest(range(0, n.d + 1)) AS k FROM n LEFT JOIN ch USING (p)) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n, 0) AS n_children, u.n_leaves::BIGINT AS n_leaves,
       u.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN ch USING (p) JOIN u USING (p) LEFT JOIN n up ON n.d > 0 AND up.p = n.p[1:n.d - 1]
"""
