"""Quality classifier by Bradley-Terry pairwise ranking (operator 7).

Scores are learned from preference pairs (a text labelled 1 over one labelled 0)
by logistic loss on feature differences. Features are surface counts of the whole
text (symbols, capitals, repetition, lines, word shapes), read in numpy from the
Arrow buffers, with hinges at the sample's quantiles. The cut is a quantile of the
training scores; scores are reported on 0..1 with the cut at ``CUT``.

The fit uses at most ``FIT_ROWS`` labelled documents, chosen by a hash of the id
(a documented bound; scoring covers every document). Texts are the only input.

Defined results: null and empty texts are scored as empty texts; labels that are
null are ignored, several labels of one id count by majority (ties as 1); with no
pair to learn from every score is ``CUT``; extra columns are ignored by ``score``
and kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import quality_rules as qr
from riskloom.llm import textops as tx

FIT_ROWS = 20_000
PAIRS = 60_000
CUT = 0.3
FOLDS, HELD_OUT = 5, 0
FEATURES = ["log_words", "word_len", "symbols", "capitals", "digits", "bangs", "bars", "repeat3", "same_next",
            "repeat1", "lines", "dup_lines", "stops", "title_words", "short_words", "non_ascii", "marked_words"]
KNOTS = (0.05, 0.25, 0.5, 0.75, 0.95)


def _set(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


UPPER, LOWER, DIGIT = _set(bytes(range(65, 91))), _set(bytes(range(97, 123))), _set(b"0123456789")
BANG, BAR, STOP, NON_ASCII = _set(b"!"), _set(b"|"), _set(b".,;:?"), _set(bytes(range(128, 256)))
MARK = qr.IS_SYMBOL | BANG


def measure(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Feature matrix (texts, features) of a chunk."""
    texts = len(offs) - 1
    prefix = tx.prefix_sums(data)
    w = tx.words(data, offs, prefix)
    n = np.diff(w.first)
    some, size = np.maximum(n, 1), np.maximum(np.diff(offs), 1)

    def share(table):
        return tx.per_text(table[data], offs)

    def of_words(flags):
        return np.bincount(w.text[flags], minlength=texts) / some

    length = w.end - w.start
    key = tx.mix64(w.hash + w.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    later = qr.repeated(key)[1]
    twin = np.zeros(len(key), bool)
    twin[1:] = key[1:] == key[:-1]
    upper, lower = share(UPPER), share(LOWER)
    m = qr.measure(data, offs, ())
    cols = [np.log1p(n), np.bincount(w.text, length, texts) / some, share(qr.IS_SYMBOL) / size, upper / np.maximum(upper + lower, 1),
            share(DIGIT) / size, share(BANG) / some, share(BAR) / some, m["n_repeat_words"] / some, of_words(twin),
            of_words(later), tx.per_text(data == 10, offs) / some, m["line_cov"], share(STOP) / some,
            of_words(UPPER[data[w.start]]), of_words(length <= 3), share(NON_ASCII) / size, of_words(MARK[data[w.end - 1]])]
    return np.stack(cols, 1).astype(np.float64)


@dataclass
class QualityModel:
    knots: np.ndarray      # (features, KNOTS)
    scale: np.ndarray      # (features)
    weights: np.ndarray
    cut: float             # training score at the chosen quantile
    slope: float
    quantile: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand(x, self.knots, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def expand(x: np.ndarray, knots: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Each feature and its hinges above the knots, scaled and bounded."""
    z = np.clip((x - knots[:, len(KNOTS) // 2]) / scale, -8, 8)
    hinges = [np.clip((x - knots[:, k]) / scale, 0, 8) for k in range(knots.shape[1])]
    return np.concatenate([z, *hinges], 1)


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> QualityModel:
    """Bradley-Terry weights by Newton steps on sampled (good, bad) pairs, then the quantile cut."""
    dims = len(FEATURES) * (1 + len(KNOTS))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        one = np.ones(len(FEATURES))
        return QualityModel(np.zeros((len(FEATURES), len(KNOTS))), one, np.zeros(dims), 0.0, 1.0, 0.0)
    knots = np.quantile(x, KNOTS, axis=0).T
    scale = np.maximum(np.quantile(x, 0.95, axis=0) - np.quantile(x, 0.05, axis=0), x.std(0)) + 1e-6
    f = expand(x, knots, scale)
    rng = np.random.default_rng(seed)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(dims)
    for _ in range(12):
        grad, hess = 1e-2 * w, 1e-2 * np.eye(dims)
        for k in range(0, pairs, 10_000):
            d = f[a[k:k + 10_000]] - f[b[k:k + 10_000]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))      # chance of the wrong order
            grad = grad - d.T @ p / pairs
            hess = hess + (d * (p * (1 - p))[:, None]).T @ d / pairs
        w = w - np.linalg.solve(hess, grad)
    s = f @ w
    # the quantile whose cut separates the labels best (share kept of the good plus share dropped of the bad)
    levels = np.unique(np.clip(np.mean(y == 0) * np.linspace(0.3, 1.5, 61), 0.001, 0.999))
    cuts = np.quantile(s, levels)
    gain = [(s[good] >= c).mean() + (s[bad] < c).mean() for c in cuts]
    best = int(np.argmax(gain))
    slope = 1.0
    for _ in range(25):                                        # one-parameter logistic calibration
        z = np.clip(slope * (s - cuts[best]), -30, 30)
        p = 1 / (1 + np.exp(-z))
        g, h = ((p - y) * (s - cuts[best])).mean(), (p * (1 - p) * (s - cuts[best]) ** 2).mean() + 1e-9
        slope = float(np.clip(slope - g / h, slope / 3, slope * 3))
    return QualityModel(knots, scale, w, float(cuts[best]), slope, float(levels[best]))


def id_remainder(c: Column, n: int) -> Column:
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", rows: int = FIT_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    voted = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .filter(id_remainder(F.col(id_col), FOLDS) != HELD_OUT)
             .groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
             .orderBy(F.xxhash64("id"), "id").limit(rows))                   # at most ``rows`` small rows

    def run(batches):
        for b in batches:
            data, offs, _ = tx.utf8(b.column(2))
            for i, j in tx.chunks(offs):
                o = offs[i:j + 1]
                x = measure(data[o[0]:o[-1]], o - o[0])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i),
                     pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
                    names=["id", "y", "x"])

    kind = labels.schema[id_col].dataType.simpleString()
    chosen = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
              .join(F.broadcast(voted), "id").select("id", "y", "text")
              .mapInArrow(run, f"id {kind}, y int, x array<double>")
              .groupBy("id").agg(F.min(F.struct("y", "x")).alias("r")).orderBy("id").collect())   # one row per id
    if not chosen:
        return fit_pairs(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit_pairs(np.array([r.r.x for r in chosen]), np.array([r.r.y for r in chosen]))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and score of every document."""
    def run(batches):
        for b in batches:
            data, offs, _ = tx.utf8(b.column(1))
            for i, j in tx.chunks(offs):
                o = offs[i:j + 1]
                s = model.score(measure(data[o[0]:o[-1]], o - o[0]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(s)], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return got.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``CUT``; all columns, by position."""
    place = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches):
        for b in batches:
            data, offs, _ = tx.utf8(b.column(place).cast(pa.string()))
            for i, j in tx.chunks(offs):
                o = offs[i:j + 1]
                good = model.score(measure(data[o[0]:o[-1]], o - o[0])) >= CUT
                yield b.slice(i, j - i).filter(pa.array(good))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op7_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return (score(docs, model)
            .select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                    "score", (F.col("score") >= CUT).cast("int").alias("predicted")))
