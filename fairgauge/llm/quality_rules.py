"""Quality rules with cross-document line frequency (native: DataFrame functions only).

Base rules look at one text: words, symbols, repeated lines, words inside repeated three-word windows. The method looks
across documents: every line is normalised (ASCII lower case, inner white space to one space, ends trimmed) and hashed
to 64 bits, the distinct documents holding it are counted per host, and lines held by more than ``max_docs`` of a
host's documents are boilerplate and go. A document that loses more than ``max_lost`` of its words this way is
depleted and rejected. Documents count as distinct by text, so copies of one document don't make its lines boilerplate.

The text is read once: its figures and its lines' hashes and word counts are written to the shared folder, and the
counting, joining and summing that follow see only these. A line or host held by a third of all rows is
pre-aggregated before the shuffle; the join of lines with frequent lines is left to AQE's skew handling.

Cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; repeated rows are
judged row by row (and count once as documents); an empty table gives an empty result; other columns pass through
``clean_lines`` and may have any name. Windows and lines are compared by 64-bit hash within a text and a host."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairgauge.llm.common import SPACES, carried, cut

#: Columns of the result; a carried column called like one of them gets underscores.
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "removed", "base_failed", "kept"]

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: A host's line in more distinct documents than this is boilerplate; a document losing more of its words is depleted.
MAX_DOCS, MAX_LOST = 50, 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def normal_hash(line: Column) -> Column:
    """Hash of a normalised line."""
    return F.xxhash64(F.translate(F.trim(F.regexp_replace(line, SPACES, " ")),
                                  "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def text_figures(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep`` and the figures of each text; each step is a projection of its own, so nothing is computed twice."""
    df = docs.select(*keep, F.coalesce(text.cast("string"), F.lit("")).alias("_t"))
    df = df.select(*keep, "_t", words_of(F.col("_t")).alias("_w"),
                   F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    n = F.size("_w")
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        *keep, n.cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.xxhash64("_t").alias("text_hash"),
        F.transform("_l", lambda x: F.struct(normal_hash(x).alias("h"), F.size(words_of(x)).alias("w"))).alias("lines"),
        windows.alias("_h"))
    # Windows in hash order, for texts in which any occurs twice; neighbours of equal hash are the repeated ones.
    some = F.size("_h") > F.size(F.array_distinct("_h"))
    zipped = F.arrays_zip(F.col("_h").alias("h"), F.sequence(F.lit(0), F.size("_h") - 1).alias("i"))
    others = [c for c in df.columns if c != "_h"]
    df = df.select(*others, F.when(some, F.sort_array(zipped)).alias("_s"))
    same = F.filter("_s", lambda x, k: (x["h"] == F.get("_s", k - 1)["h"]) | (x["h"] == F.get("_s", k + 1)["h"]))
    df = df.select(*others, F.sort_array(F.transform(same, lambda x: x["i"])).alias("_p"))
    # Window starts in order: each covers its words up to the next start.
    covered = F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW))))
    return df.select(*others, F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
                     .alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def frequent_lines(figures: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``host, h, n_docs`` of the lines held by more than ``max_docs`` distinct documents of a host."""
    held = figures.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    return held.distinct().groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST, text_col: str = "text",
          host_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Per row: the figures, ``lost_words``, ``removed`` (hashes of removed lines), ``base_failed``, ``kept`` and ``carry``."""
    carry = carry or []
    rows = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("_text"),
                       *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    keep = ["host", *[f"_c{i}" for i in range(len(carry))]]
    figures = cut(text_figures(rows, F.col("_text"), keep).withColumn("row", F.monotonically_increasing_id()), "figures")
    often = cut(frequent_lines(figures, max_docs), "frequent").select(F.col("host").alias("_host"), F.col("h").alias("_h"))
    lines = figures.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.w")
    hit = lines.join(often, lines["host"].eqNullSafe(often["_host"]) & (lines["h"] == often["_h"]))
    lost = hit.groupBy("row").agg(F.sum("w").alias("lost_words"), F.collect_set("h").alias("removed"))
    out = figures.drop("lines").join(lost, "row", "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0)).cast("long"))
    failed = base_failed()
    return out.select(*[F.col(f"_c{carry.index(c)}").alias(n) for c, n in carried(carry, RESULT).items()], "n_words", "word_chars", "n_symbols",
                      "n_dup_lines", "n_repeat_words", "lost_words", "removed", failed.alias("base_failed"),
                      (~failed & (F.col("lost_words") <= F.col("n_words") * max_lost)).alias("kept"))


def clean_lines(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that are kept, with ``docs``' columns, their boilerplate lines taken out of the text."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"),
                         F.col(f"`{options.pop('host_col', 'source')}`").alias("source"))
    judged = judge(packed, carry=["row"], **options).where("kept")
    rest = F.filter(F.split(F.col("row")[text_col], "\n", -1),
                    lambda x: ~F.coalesce(F.array_contains("removed", normal_hash(x)), F.lit(False)))
    return judged.select(*[F.when(F.col("removed").isNull(), F.col("row")[c]).otherwise(F.array_join(rest, "\n")).alias(c)
                           if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
