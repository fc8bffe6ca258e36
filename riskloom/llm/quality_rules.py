"""Quality rules by repetition coverage (operator 5).

For every whole text: words, symbols, repeated lines, and for several n-gram
lengths the share of word characters that lie inside an n-gram found twice or
more in that text. Rolling 64-bit hashes are computed in numpy over the Arrow
buffers of many texts at once; windows are keyed by (text, hash), sorted, and
equal neighbours mark repeats. One narrow pass, no shuffle.

Defined results: a null text counts as an empty one; an empty text has zeros
everywhere and fails the base rule; repeated rows give repeated results; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textops as tx

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
MIN_WORDS = 50
#: share of word characters inside repeated n-grams above which a text is dropped, by n
MAX_COVERAGE = {5: 0.40, 7: 0.35, 10: 0.30}
#: share of line characters in lines that repeat an earlier one above which a text is dropped
MAX_LINE_COVERAGE = 0.30

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more, equal to an earlier one) for each key."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later = np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice = later.copy()
    twice[order[:-1][same]] = True
    return twice, later


def covered(w: tx.Words, n: int) -> np.ndarray:
    """Flags the words that lie in an n-word window found twice or more in their text."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(len(w.hash), bool)
    whole = np.flatnonzero(w.text[:m] == w.text[n - 1:])
    keys = tx.mix64(tx.ngrams(w.hash, n)[whole] + w.text[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = whole[repeated(keys)[0]]
    step = np.zeros(len(w.hash) + 1, np.int32)
    step[at] += 1
    step[at + n] -= 1          # window starts are distinct, so plain indexing adds each once
    return np.cumsum(step[:-1]) > 0


def measure(data: np.ndarray, offs: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The counts of every text in a chunk; line_cov and cov_<n> are shares of characters."""
    texts = len(offs) - 1
    prefix = tx.prefix_sums(data)
    w = tx.words(data, offs, prefix)
    lead = (data & 0xC0) != 0x80                        # one per code point
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=points[1:])
    size = points[w.end] - points[w.start]
    out = {"n_words": np.diff(w.first), "word_chars": np.bincount(w.text, size, texts).astype(np.int64),
           "n_symbols": tx.per_text(IS_SYMBOL[data], offs)}

    breaks = np.flatnonzero(data == 10)
    ls = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    ls = ls[ls < len(data)]
    le = np.concatenate([ls[1:], [len(data)]])
    le = np.where((le > ls) & (data[np.maximum(le, 1) - 1] == 10), le - 1, le) if len(ls) else le[:0]
    some = np.searchsorted(w.start, le) > np.searchsorted(w.start, ls)   # lines with a word
    ls, le = ls[some], le[some]
    lt = np.searchsorted(offs, ls, "right") - 1
    key = tx.mix64(tx.span_hash(prefix, ls, le) + lt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    later = repeated(key)[1]
    chars = points[le] - points[ls]
    out["n_dup_lines"] = np.bincount(lt[later], minlength=texts)
    out["line_cov"] = np.bincount(lt, chars * later, texts) / np.maximum(1, np.bincount(lt, chars, texts))

    out["n_repeat_words"] = np.bincount(w.text[covered(w, 3)], minlength=texts)
    for n in lengths:
        out[f"cov_{n}"] = np.bincount(w.text, size * covered(w, n), texts) / np.maximum(1, out["word_chars"])
    return out


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     max_coverage: dict[int, float] = MAX_COVERAGE, max_line_coverage: float = MAX_LINE_COVERAGE,
                     min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: counts, character coverages, ``base_failed`` and ``kept``."""
    lengths = tuple(sorted(max_coverage))
    floats = ["line_cov", *(f"cov_{n}" for n in lengths)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs, _ = tx.utf8(b.column(1))
            for i, j in tx.chunks(offs):
                o = offs[i:j + 1]
                m = measure(data[o[0]:o[-1]], o - o[0], lengths)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *(pa.array(m[c].astype(np.int64)) for c in COUNTS),
                     *(pa.array(m[c].astype(np.float64)) for c in floats)], names=["id", *COUNTS, *floats])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in floats)])
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    method = F.col("line_cov") <= max_line_coverage
    for n in lengths:
        method &= F.col(f"cov_{n}") <= max_coverage[n]
    return (got.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & method)
            .select(F.col("id").alias(id_col), *COUNTS, "base_failed", "kept", *floats))


def op5_quality_rules(spark, sf_dir):
    return repetition_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_cover(n: int) -> str:
    """CTEs g<n> and c<n>: windows of n words found twice in their text, and the characters they cover."""
    return f"""
g{n} AS (SELECT doc, i FROM (
  SELECT doc, i, count(*) OVER (PARTITION BY doc, g) AS times FROM (
    SELECT doc, unnest(range(1, len(ws) - {n} + 2)) AS i,
           list_aggregate(ws[i:i + {n - 1}], 'string_agg', chr(10)) AS g
    FROM d WHERE len(ws) >= {n})) WHERE times > 1),
c{n} AS (SELECT doc, count(*) AS words, sum(length(ws[p])) AS chars FROM (
  SELECT DISTINCT g{n}.doc, g{n}.i + o AS p FROM g{n}, range({n}) r(o)) JOIN d USING (doc) GROUP BY doc)"""


#: DuckDB twin of the query: whole texts, exact words instead of hashes.
OP5_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
l AS (
  SELECT doc, line, length(line) AS size, row_number() OVER (PARTITION BY doc, line ORDER BY k) AS again
  FROM (SELECT doc, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lines AS (SELECT doc, count(*) FILTER (WHERE again > 1) AS n_dup_lines,
                 coalesce(sum(size) FILTER (WHERE again > 1), 0) / greatest(sum(size), 1) AS line_cov FROM l GROUP BY doc),
{",".join(_sql_cover(n) for n in (3, *MAX_COVERAGE))},
s AS (
  SELECT doc, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols
  FROM d),
m AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(c3.words, 0) AS n_repeat_words, CAST(coalesce(line_cov, 0) AS DOUBLE) AS line_cov,
         {", ".join(f"CAST(coalesce(c{n}.chars, 0) / greatest(word_chars, 1) AS DOUBLE) AS cov_{n}" for n in MAX_COVERAGE)}
  FROM s LEFT JOIN lines USING (doc) LEFT JOIN c3 USING (doc) {" ".join(f"LEFT JOIN c{n} USING (doc)" for n in MAX_COVERAGE)})
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND line_cov <= {MAX_LINE_COVERAGE}
       AND {" AND ".join(f"cov_{n} <= {v}" for n, v in MAX_COVERAGE.items())} AS kept
FROM m
"""
