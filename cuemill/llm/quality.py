"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents whose training label is 1; the unlabelled set is drawn from all training documents. A linear model over
text-form features minimises the non-negative unbiased risk  pi R_p(+) + max(0, R_u(-) - pi R_p(-))  with logistic loss. The class prior
pi is estimated from positives and unlabelled rows alone: a model that tells the two apart orders one half of either, and where it is
surest, the share of unlabelled rows over the share of positives comes down to pi. Only the text enters a score; labels of 0 are unused.

Fitting reads a bounded sample: about `sample` positives and `sample` unlabelled rows, those whose hash of the id is below a threshold set
by their number. Scoring is a narrow pass over every row.

Defined results: a null or empty text gets the features of empty text and so a score; repeated rows get equal scores, and in fitting
rows of one id count once; without any positive label every score is 0.5; other columns pass through (an own `score` column is replaced).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.llm.common import BLANK, SLICE_BYTES, bounded_batches, crc_bucket, mix64, read_table, released, slices, text_bytes, word_hashes

#: Rows of either kind that fitting reads, as expected.
SAMPLE = 20_000
THRESHOLD = 0.3

_GROUPS = [
    np.arange(65, 91), np.arange(97, 123), np.arange(48, 58), np.flatnonzero(BLANK), np.array([10]), np.frombuffer(b"|", np.uint8), np.frombuffer(b"!", np.uint8), np.frombuffer(b"%&*#$", np.uint8),
    np.frombuffer(b"~^+=\\_", np.uint8), np.frombuffer(b"<>{}[]", np.uint8), np.frombuffer(b"@/:", np.uint8), np.frombuffer(b".", np.uint8), np.frombuffer(b",;", np.uint8), np.frombuffer(b"'\"()-?", np.uint8), np.arange(128, 256), np.arange(0, 9),
]
_FOLD = np.zeros((256, len(_GROUPS)))
for _k, _g in enumerate(_GROUPS):
    _FOLD[_g, _k] = 1
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _counted(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> np.ndarray:
    """For each row counts of byte values, and of pairs: equal punctuation, punctuation, capitals. Long data is read in pieces."""
    rows = len(offsets) - 1
    out = np.zeros((rows, 259))
    row = 0
    for a in range(0, len(data), limit):
        b = min(a + limit, len(data))
        row = int(np.searchsorted(offsets, a, "right")) - 1
        last = int(np.searchsorted(offsets, b, "left"))
        of = np.repeat(np.arange(last - row), np.diff(np.clip(offsets[row : last + 1], a, b)))
        now, before = data[a:b], np.concatenate((data[a - 1 : a] if a else np.zeros(1, np.uint8), data[a : b - 1]))
        inner = offsets[row:last]
        before[inner[(inner >= a) & (inner < b)] - a] = 0  # a row has nothing before it
        hist = np.bincount(of * 256 + now, minlength=(last - row) * 256).reshape(-1, 256)
        pairs = ((now == before) & _PUNCT[now], _PUNCT[now] & _PUNCT[before], _UPPER[now] & _UPPER[before])
        out[row:last, :256] += hist
        for k, pair in enumerate(pairs):
            out[row:last, 256 + k] += np.bincount(of[pair], minlength=last - row)
    return out


def _owners(of: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The row of each distinct value of each row."""
    _, first = np.unique(mix64(value + mix64(of.astype(np.uint64))), return_index=True)
    return of[first]


def features(column: pa.Array) -> np.ndarray:
    """One row of form features for each text."""
    data, offsets = text_bytes(column)
    n = np.diff(offsets)
    rows = len(n)
    size = np.maximum(n, 1)[:, None]
    counts = _counted(data, offsets)
    share, shape = (counts[:, :256] @ _FOLD) / size, counts[:, 256:] / size
    hashes, _, lengths, at = word_hashes(data, offsets)
    of = np.repeat(np.arange(rows), np.diff(at))
    found = _owners(of, hashes)
    distinct = np.bincount(found, minlength=rows)
    longest = np.zeros(rows)
    np.maximum.at(longest, of, lengths)
    words = np.maximum(np.diff(at), 1).astype(float)
    raw, ends = data.tobytes(), offsets.tolist()
    extra = np.zeros((rows, 5))
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        t = raw[a:b]
        lines = t.split(b"\n")
        extra[k, 0], extra[k, 1], extra[k, 3] = len(zlib.compress(t, 1)) / (b - a + 20), 1 - len(set(lines)) / len(lines), np.log1p(len(lines))
    extra[:, 2] = np.where(np.diff(at) > 0, 1 - distinct / words, 1)
    extra[:, 4] = np.log1p(longest / 50)
    log_n = np.log1p(n)[:, None]
    mean_word = np.log1p(n / words)[:, None]
    soft = np.log1p(200 * np.concatenate([share, shape], 1))
    base = np.concatenate([log_n, mean_word, np.log1p(words)[:, None], extra, soft], 1)
    return np.concatenate([base, base**2], 1)


class QualityModel:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, bias: float, prior: float):
        self.mean, self.scale, self.weight, self.bias, self.prior = mean, scale, weight, bias, prior

    def scores(self, column: pa.Array) -> np.ndarray:
        z = np.clip((features(column) - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, docs: DataFrame, text: str = "text", into: str = "score") -> DataFrame:
        bounded_batches(docs.sparkSession)
        docs = docs.drop(into)
        schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType(), False)])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(self.scores(part.column(text)))], names=[*part.schema.names, into])

        return docs.mapInArrow(released(run), schema)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descended(gradient: Callable[[np.ndarray, float], np.ndarray], width: int, bias: float, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Full-batch Adam; the last component is the bias."""
    w, b = np.zeros(width), bias
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        g = gradient(w, b)
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * min(1.0, 2 * (1 - t / (steps + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.03, decay: float = 1e-4) -> QualityModel:
    """Minimises the non-negative risk; where its negative part falls below zero, that part's gradient is reversed."""
    mean = unlabelled.mean(0)
    scale = unlabelled.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))

    def gradient(w: np.ndarray, b: float) -> np.ndarray:
        sp, su = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
        pos = -prior * np.append(p.T @ (1 - sp), (1 - sp).sum()) / len(p)
        neg_u = np.append(u.T @ su, su.sum()) / len(u)
        neg_p = prior * np.append(p.T @ sp, sp.sum()) / len(p)
        negative = np.logaddexp(0, u @ w + b).mean() - prior * np.logaddexp(0, p @ w + b).mean()
        return pos + neg_u - neg_p if negative >= 0 else neg_p - neg_u

    w, b = _descended(gradient, p.shape[1], np.log(prior / (1 - prior)), steps, rate, decay)
    return QualityModel(mean, scale, w, b, prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled rows, from these two sets alone.

    A logistic model of positive against unlabelled learns on every second row of both; among the others, ordered by its score, the share
    of unlabelled rows above a threshold over the share of positives above it can't fall below the prior. The threshold is the one with
    the least upper bound, sampling error (with probability `doubt`) included.
    """
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    if min(len(p), len(u)) < 4:
        return 0.5
    x, y = np.concatenate((p[::2], u[::2])), np.repeat([1.0, 0.0], (len(p[::2]), len(u[::2])))
    weight = np.repeat([0.5 / len(p[::2]), 0.5 / len(u[::2])], (len(p[::2]), len(u[::2])))

    def gradient(w: np.ndarray, b: float) -> np.ndarray:
        e = weight * (_sigmoid(x @ w + b) - y)
        return np.append(x.T @ e, e.sum())

    w, b = _descended(gradient, x.shape[1], 0.0, 300, 0.03, 1e-3)
    p, u = np.sort(p[1::2] @ w + b), np.sort(u[1::2] @ w + b)
    cut = np.unique(p)
    top_p, top_u = 1 - np.searchsorted(p, cut) / len(p), 1 - np.searchsorted(u, cut) / len(u)
    error = np.sqrt(np.log(4 / doubt) / 2) * (len(u) ** -0.5 + len(p) ** -0.5)
    best = np.argmin((top_u + error) / top_p)
    return float(np.clip(top_u[best] / top_p[best], 0.01, 0.99))


def drawn(ids: DataFrame, n: int, sample: int) -> DataFrame:
    """About `sample` of the n ids, those whose hash is low enough."""
    share = min(1.0, sample / max(1, n))
    return ids.filter(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 53)) < F.lit(int(share * (1 << 53)) + (share == 1)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Learns from documents whose crc32(doc_id) mod 5 is not 0; `sample` bounds the rows of either kind."""
    bounded_batches(docs.sparkSession)
    train = (crc_bucket("doc_id", 5) != 0) & F.col("doc_id").isNotNull()
    positive = labels.filter(train & (F.col("quality") == 1)).select("doc_id").distinct()
    ones, n = positive.count(), docs.filter(train).count()
    width = features(pa.array([""])).shape[1]
    blank = QualityModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5)
    if not ones or not n:
        return blank
    chosen = drawn(positive, ones, sample).withColumn("__p", F.lit(True))
    unlabelled = drawn(docs.filter(train).select("doc_id", "text"), n, sample).withColumn("__p", F.lit(False))
    known = docs.filter(train).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about `sample` ids
    rows = known.unionByName(unlabelled).select(F.col("doc_id").cast("string").alias("doc_id"), "__p", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = features(part.column("text")).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("__p"), lists], names=["doc_id", "p", "x"])

    found = rows.mapInArrow(released(run), "doc_id string, p boolean, x array<float>").groupBy("doc_id", "p").agg(F.min("x").alias("x")).toArrow()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width).astype(float)
    p = found.column("p").to_numpy(zero_copy_only=False).astype(bool)
    if not p.any() or p.all():
        return blank
    order = np.lexsort((*x.T[:4], mix64(x[:, 0].view(np.uint64) ^ x[:, 5].view(np.uint64))))  # one mixed order, whatever the order of the tasks
    x, p = x[order], p[order]
    return fit_nnpu(x[p], x[~p], estimated_prior(x[p], x[~p]))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return model.score(docs).select(
        "doc_id",
        (crc_bucket("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
