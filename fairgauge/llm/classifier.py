"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered (here 0 toxic, 1 poor, 2 good). A text has hashed features, shared by all grades: its words (edge
punctuation dropped, lower case), their first letters, the shapes of its tokens (case, trailing marks) and how much
repeats, each valued by the root of its share of the text. One score, the weighted sum, meets ordered thresholds:
P(grade <= k) = logistic(threshold_k - score). The expected grade ranks texts, a tail probability selects them.

The fit is maximum likelihood with an L2 penalty (Adam, fixed steps, no randomness). It uses at most ``max_fit_docs``
pairs of a labelled document that exists and a grade, chosen by a hash of the id; copies of a document count once and an
id with several texts stands for the one of least hash. This bound is the classifier's one sample, features are made
on the executors and only these bounded rows reach the driver. Scoring covers every document.

Cases: a null or empty text has no features but the intercepts' and is scored like any other; labels that are null or
without a document are skipped; different grades of one document count each, repeats once; with no labelled document there is no
model, and every document is kept with null grades; repeated rows are scored each for itself; an empty table gives an
empty result; other columns pass through, and those with a result column's name are replaced."""
from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1 << 18
PREFIXES = (4, 5)
#: Numbers beyond the hashed features: no prefix, repeated neighbours, repeated words.
NONE = DIM
SIZE = DIM + 3
MEMO_ENTRIES = 300_000
#: Bound of the sample of labelled documents that the fit sees.
MAX_FIT_DOCS = 6_000
#: Feature values that one step of the fit holds in memory at once.
FIT_CHUNK = 1 << 19
_EDGES = re.compile(r"^[^\w]+|[^\w]+$")


def _token_features(token: str) -> tuple[int, ...]:
    """A token's feature in each family: word, shape and one for each prefix length (``NONE`` if it is shorter)."""
    import xxhash
    core = _EDGES.sub("", token)
    case = "U" if len(core) > 1 and core.isupper() else "C" if core[:1].isupper() else "l" if core else "0"
    tail = token[len(core):] if token.startswith(core) else token
    low = core.lower()
    names = [f"w:{low}", f"s:{case}{tail[-3:]}"] + [f"p{k}:{low[:k]}" if len(low) >= k else "" for k in PREFIXES]
    return tuple(xxhash.xxh64_intdigest(x) % DIM if x else NONE for x in names)


def features(text: str | None, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text; ``memo`` remembers tokens' features."""
    words = (text or "").encode("utf-8", "surrogatepass").split()              # bytes split at ASCII white space only
    n = max(1, len(words))
    counts = Counter(words)
    if len(memo) > MEMO_ENTRIES:
        memo.clear()
    rows = []
    for token in counts:
        found = memo.get(token)
        if found is None:
            found = memo[token] = _token_features(token.decode("utf-8", "surrogatepass"))
        rows.append(found)
    families = np.array(rows, np.int64).reshape(-1, 2 + len(PREFIXES))
    share = np.fromiter(counts.values(), np.float64, len(counts)) / n
    idx, val = [families[:, 0]], [share]
    for k in range(1, families.shape[1]):
        names, inverse = np.unique(families[:, k], return_inverse=True)
        idx.append(names)
        val.append(np.bincount(inverse, share, len(names)))
    repeats = sum(map(eq, words, words[1:])) / n
    idx.append(np.array([NONE + 1, NONE + 2]))
    val.append(np.array([repeats, 1 - len(counts) / n]))
    return np.concatenate(idx), np.sqrt(np.concatenate(val))


@dataclass
class OrdinalModel:
    weights: np.ndarray        # ``SIZE`` values
    thresholds: np.ndarray     # grades - 1 values, ascending

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each score, k ascending."""
        return 1 / (1 + np.exp(np.clip(np.asarray(score)[..., None] - self.thresholds, -700, 700)))

    def score(self, text: str | None, memo: dict) -> float:
        idx, val = features(text, memo)
        return float((self.weights[idx] * val).sum())


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int = 3, penalty: float = 0.1,
        steps: int = 150, rate: float = 0.3, least_docs: int = 3) -> OrdinalModel:
    """Penalised maximum likelihood over rows of (feature numbers, values); ``penalty`` is the weights' prior, shared by all
    rows; features of fewer than ``least_docs`` rows weigh 0."""
    counts = np.zeros(SIZE, np.int64)
    for i, _ in rows:
        counts += np.bincount(i, minlength=SIZE)
    names = np.flatnonzero(counts >= least_docs)
    place = np.full(SIZE, -1, np.int32)
    place[names] = np.arange(len(names), dtype=np.int32)
    n, m = len(rows), len(names)
    idx, val, sizes = [], [], []
    for i, v in rows:
        own = place[i]
        idx.append(own[own >= 0])
        val.append(v[own >= 0].astype(np.float32))
        sizes.append(len(idx[-1]))
    idx, val = np.concatenate(idx), np.concatenate(val)
    seg = np.repeat(np.arange(n, dtype=np.int32), sizes)
    chunks = [slice(k, k + FIT_CHUNK) for k in range(0, len(idx), FIT_CHUNK)]
    l2 = penalty / n
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n, 0.01, 0.99)
    theta = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    x, mom, sq = np.concatenate([np.zeros(m), theta]), 0.0, 0.0
    lower, upper = grades - 1, grades
    for k in range(1, steps + 1):
        w, theta = x[:m], x[m:]
        s = sum((np.bincount(seg[c], val[c] * w[idx[c]], minlength=n) for c in chunks), np.zeros(n))
        cdf = np.zeros((n, n_grades + 1))
        cdf[:, 1:n_grades] = 1 / (1 + np.exp(np.clip(s[:, None] - theta, -60, 60)))
        cdf[:, n_grades] = 1
        slope = cdf * (1 - cdf)
        at = np.arange(n)
        p = np.maximum(cdf[at, upper + 1] - cdf[at, lower + 1], 1e-9)
        up, low = slope[at, upper + 1] / p, slope[at, lower + 1] / p
        pull = up - low
        g_w = sum((np.bincount(idx[c], val[c] * pull[seg[c]], minlength=m) for c in chunks), np.zeros(m)) / n + l2 * w
        g_t = (np.bincount(lower + 1, low, n_grades + 1)[1:n_grades] - np.bincount(upper + 1, up, n_grades + 1)[1:n_grades]) / n
        g = np.concatenate([g_w, g_t])
        mom, sq = 0.9 * mom + 0.1 * g, 0.999 * sq + 0.001 * g * g
        x = x - rate * (mom / (1 - 0.9 ** k)) / (np.sqrt(sq / (1 - 0.999 ** k)) + 1e-8)
        x[m:] = np.maximum.accumulate(x[m:] + 0.0)
    weights = np.zeros(SIZE)
    weights[names] = x[:m]
    return OrdinalModel(weights, x[m:] + 1e-9 * np.arange(n_grades - 1))


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null if either rating is null."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)


def train(docs: DataFrame, labels: DataFrame, max_fit_docs: int = MAX_FIT_DOCS, seed: int = 42, n_grades: int = 3,
          id_col: str = "doc_id", text_col: str = "text", **options) -> OrdinalModel | None:
    """A model from ``labels(doc_id, grade)`` and the texts of ``docs``; None without labelled documents."""
    graded = labels.select(F.col("doc_id").cast("string").alias("id"), F.col("grade").cast("int").alias("g")).dropna().distinct()
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t")) \
        .withColumn("h", F.xxhash64("t", F.lit(seed)))
    one = texts.where("id IS NOT NULL").groupBy("id").agg(F.min("h").alias("h"))           # one text an id
    chosen = (graded.join(one, "id").withColumn("at", F.xxhash64("id", F.lit(seed)))
              .orderBy("at", "id", "g").limit(max_fit_docs))
    rows = texts.join(F.broadcast(chosen), ["id", "h"]).select("at", "id", "g", "t")       # every copy of a chosen text

    def run(batches):
        memo: dict = {}
        seen: set = set()                                                                  # at most max_fit_docs pairs
        for batch in batches:
            new = []
            for i, key in enumerate(zip(batch.column("id").to_pylist(), batch.column("g").to_pylist())):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            made = [features(x.as_py(), memo) for x in batch.column("t")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("at"), batch.column("id"), batch.column("g"),
                 pa.array([i.astype(np.int32).tobytes() for i, _ in made], pa.binary()),
                 pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary())], ["at", "id", "g", "i", "v"])

    made = rows.mapInArrow(run, "at long, id string, g int, i binary, v binary")
    got = made.groupBy("at", "id", "g").agg(F.first("i").alias("i"), F.first("v").alias("v")).toArrow()   # at most max_fit_docs rows
    got = got.sort_by([("at", "ascending"), ("id", "ascending"), ("g", "ascending")])
    if not got.num_rows:
        return None
    sparse = [(np.frombuffer(i.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32)) for i, v in zip(got.column("i"), got.column("v"))]
    return fit(sparse, got.column("g").to_numpy().astype(np.int64), n_grades, **options)


def classify(docs: DataFrame, model: OrdinalModel | None, least_tail: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``expected_grade``, ``tail`` (probability of the best grade) and ``kept`` (tail at least
    ``least_tail``); columns of ``docs`` with these names are replaced."""
    docs = docs.drop("score", "expected_grade", "tail", "kept")
    if model is None:
        null = F.lit(None).cast("double")
        return docs.select("*", null.alias("score"), null.alias("expected_grade"), null.alias("tail"), F.lit(True).alias("kept"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    names = docs.columns
    weights, thresholds = model.weights.astype(np.float32), model.thresholds

    def run(batches):
        own, memo = OrdinalModel(weights, thresholds), {}
        for batch in batches:
            s = np.array([own.score(x.as_py(), memo) for x in batch.column(text_col)], np.float64)
            below = own.below(s)
            tail = 1 - below[:, -1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))] +
                [pa.array(s), pa.array(len(thresholds) - below.sum(1)), pa.array(tail), pa.array(tail >= least_tail)],
                names + ["score", "expected_grade", "tail", "kept"])

    return docs.mapInArrow(run, kinds + ", score double, expected_grade double, tail double, kept boolean")
