"""Language identification (operator 3): sparse multinomial logistic regression on
TF-IDF character n-grams, trained with follow-the-regularised-leader (FTRL-proximal)
under elastic-net penalties, then temperature calibration.

Characters are lower-cased code points; everything but letters is one boundary
symbol. n-grams of 1 to 3 characters are hashed to 2^15 buckets. Document
frequencies are counted on Spark over all learnable documents; the fit takes a
bounded sample of ``FIT_ROWS`` documents (a documented bound), spread evenly over the
languages by a hash of the id; every whole text is predicted. With term frequency as
a share of the text's n-grams, a text's logits are the mean of per-bucket weights.

Defined results: null texts and texts without a letter are ``und`` with score 0;
repeated rows give repeated results; with nothing to learn from every text is
``und``; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.quality_classifier import id_remainder

BITS = 15
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
FIT_ROWS = 6_000
CHUNK_CHARS = 1 << 20
FOLDS, HELD_OUT = 4, 2
SCALE = 30.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.02
EPOCHS = 3
_MULTIPLIER = {1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0xC2B2AE3D27D4EB4F), 3: np.uint64(0xD6E8FEB86659FD93)}
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """Table over all code points, built once a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with non-letters as 0, offsets, texts that have a letter)."""
    low = [t.lower() if t else "" for t in texts]
    offs = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=offs[1:])
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = is_letter()[c]
    count = np.zeros(len(c) + 1, np.int64)
    np.cumsum(letter, out=count[1:])
    return np.where(letter, c, 0), offs, count[offs[1:]] > count[offs[:-1]]


def buckets(c: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram that lies in one text, offsets by text)."""
    m = max(0, len(c) - n + 1)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = (h << np.uint64(21)) | c[j:j + m]
    h = ((h + np.uint64(n)) * _MULTIPLIER[n]) >> np.uint64(64 - BITS)
    length = np.maximum(np.diff(offs) - n + 1, 0)
    out = np.zeros(len(offs), np.int64)
    np.cumsum(length, out=out[1:])
    keep = np.ones(m, bool)
    for j in range(1, n):                       # windows that start within n - 1 of a text's end
        tail = offs[1:] - j
        tail = tail[(tail >= offs[:-1]) & (tail < m)]
        keep[tail] = False
    return h[keep].astype(np.int64), out


def text_chunks(texts: list[str | None], most: int = CHUNK_CHARS):
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j] or "") <= most):
            chars += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray        # (languages, BUCKETS): idf, scale and learned weight in one
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, c: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(texts, languages): the mean weight of each text's n-grams."""
        texts, k = len(offs) - 1, len(self.languages)
        total, grams = np.zeros((texts, k)), np.zeros(texts)
        for n in ORDERS:
            b, o = buckets(c, offs, n)
            some = np.flatnonzero(np.diff(o))
            grams += np.diff(o)
            if len(some):
                for lang in range(k):
                    total[some, lang] += np.add.reduceat(self.weights[lang][b], o[some])
        return total / np.maximum(grams, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        c, offs, spoken = code_points(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits(c, offs) / self.temperature)
        best = p.argmax(1)
        score = np.where(spoken, p[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if s else "und" for b, s in zip(best, spoken, strict=True)], score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sparse_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of one text's n-grams."""
    c, offs, _ = code_points([text])
    every = np.concatenate([buckets(c, offs, n)[0] for n in ORDERS])
    return np.unique(every, return_counts=True)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each bucket, documents), over all rows of (text)."""
    def run(batches):
        df, seen = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            seen += len(texts)
            for i, j in text_chunks(texts):
                c, offs, _ = code_points(texts[i:j])
                parts = [buckets(c, offs, n) for n in ORDERS]
                for k in range(0, j - i, 64):                 # 64 texts x buckets of flags at a time
                    m = min(64, j - i - k)
                    there = np.zeros(m * BUCKETS, bool)
                    for g, o in parts:
                        part = g[o[k]:o[k + m]]
                        there[np.repeat(np.arange(m) * BUCKETS, np.diff(o[k:k + m + 1])) + part] = True
                    df += there.reshape(m, BUCKETS).sum(0)
        if seen:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], seen))],
                                             names=["bucket", "n"])

    got = docs.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # <= BUCKETS + 1
    df, total = np.zeros(BUCKETS, np.int64), 0
    for r in got:
        if r.bucket < 0:
            total = r.n
        else:
            df[r.bucket] = r.n
    return df, total


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, seed: int = 3) -> LanguageModel:
    """FTRL-proximal with L1 and L2 over (language, buckets, counts); a quarter calibrates the temperature."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((0, BUCKETS)), np.zeros(0))
    k = len(languages)
    y = np.array([languages.index(r[0]) for r in rows])
    order = np.random.default_rng(seed).permutation(len(rows))
    held, learn = order[:len(rows) // 4], order[len(rows) // 4:]
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(i):
        zi, ni = z[i], n[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    def vector(r):
        return np.append(r[1], BUCKETS), np.append(SCALE * idf[r[1]] * r[2] / max(1, r[2].sum()), 1.0)

    for _ in range(EPOCHS):
        for d in learn:
            i, x = vector(rows[d])
            w = weights(i)
            p = softmax((x @ w)[None])[0]
            p[y[d]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    full = weights(np.arange(BUCKETS + 1))
    model = LanguageModel(languages, np.ascontiguousarray((SCALE * idf[:, None] * full[:-1]).T), full[-1])
    if len(held):
        logits = np.array([(lambda v: v[1] @ full[v[0]])(vector(rows[d])) for d in held])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from (id, text, lang) rows; the caller leaves out what is held out."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                        F.col(lang_col).cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    hashed = known.select("lang", "text", F.xxhash64("id", "text").alias("h"))
    # the languages are the model's classes: the most frequent ``rows`` of them, far more than there are
    sizes = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    df, total = document_frequency(known.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1.0
    if not sizes:
        return train([], idf)
    each = rows / len(sizes)
    share = F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(min(1.0, each / r.n)))])
    least = F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(r.least))])
    toss = F.pmod("h", F.lit(1 << 20)) / F.lit(float(1 << 20))
    # by id and text, equal rows once, and one row of every language at least
    sample = hashed.filter((toss < share[F.col("lang")]) | (F.col("h") == least[F.col("lang")])).dropDuplicates(["lang", "h"])

    def run(batches):
        for b in batches:
            langs, out = b.column(1).to_pylist(), []
            for t in b.column(0).to_pylist():
                i, c = sparse_counts(t)
                out.append((i.astype(np.int32).tobytes(), c.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([o[0] for o in out], pa.binary()),
                                              pa.array([o[1] for o in out], pa.binary())], names=["lang", "i", "c"])

    got = (sample.select("text", "lang").mapInArrow(run, "lang string, i binary, c binary")
           .orderBy(F.xxhash64("i", "c"), "lang").limit(2 * rows).toArrow())
    triples = [(lang, np.frombuffer(i, np.int32), np.frombuffer(c, np.int32))
               for lang, i, c in zip(got["lang"].to_pylist(), got["i"].to_pylist(), got["c"].to_pylist(), strict=True)]
    return train([t for t in triples if len(t[1])], idf)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, predicted language and its calibrated probability for every document."""
    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in text_chunks(texts):
                lang, p = model.predict(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(p)],
                                                 names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return got.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op3_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    model = fit(docs.filter(~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
