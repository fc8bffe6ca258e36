"""MinHash near-duplicates by improved consistent weighted sampling (operator 6).

1. Texts with equal word sequences (A-Z folded) form classes; one document stands for each.
2. Features are five-word shingles with TF-IDF weights (1 + ln tf) * idf. Document
   frequencies of all shingles of all documents are counted into a sketch of fixed size
   (two rows of 2^18 counters, mean load removed). With share = df / documents,
   idf = ln(1 + 1 / (max(share, FLOOR) + SMOOTH)): the same for all shingles of up to FLOOR
   of the documents, so that a group of copies keeps its plain similarity, and lower for
   boilerplate; one function at every corpus size. The sketch errs by about (shingles a
   text) / 2^18 of the documents, far below FLOOR.
3. BANDS * ROWS consistent weighted samples (s*, t*) per class; ROWS of them make a band
   key. At similarity 0.8 a pair misses every band with a chance of 8 in 10,000.
4. Classes that share a band key are compared exactly by weighted Jaccard on whole texts.
   A bucket larger than a block is cut into blocks and every two blocks meet in one task;
   inside a task pairs are compared in numpy and only a spanning forest of links leaves it.
   No bucket is capped and no pair is dropped.
5. Components of the links, by alternating stars.

Defined results: a null text is a class of its own; texts without a word are one class
and link with nothing else; texts of fewer than five words have one shingle; repeated
rows of one id share a result; an empty table gives an empty result; extra columns are
ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textops as tx
from riskloom.llm.components import components
from riskloom.llm.groups import in_groups, whole_groups
from riskloom.operators.ordering import global_row_number
from riskloom.session import ensure_checkpoint_dir, reliable_checkpoint

SHINGLE = 5
BANDS, ROWS = 10, 3
THRESHOLD = 0.8
FLOOR, SMOOTH = 0.05, 1.0
SKETCH_BITS = 18
SLOTS = 1 << SKETCH_BITS
SKETCH_CHUNK = 4096              # counters that travel together
BLOCK_TEXTS = 256
BLOCK_BYTES = 4 << 20
CHUNK = 1 << 18                  # bytes of text sampled at a time: the arrays stay in the CPU's cache
FID_BITS = np.uint64(48)
FID_MASK = np.uint64((1 << 48) - 1)

_rng = np.random.default_rng(61)
GAMMA = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32) + np.float32(1e-6)
LOG_GAMMA = np.log(_rng.gamma(2.0, 1.0, 1 << 16) + 1e-9).astype(np.float32)
BETA = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
SEEDS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
ODDS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
SKETCH_ODDS = _rng.integers(1, 2**63, 2, dtype=np.uint64) | np.uint64(1)
MIX = np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- features

def shingles(w: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature id of 48 bits, times found), by text and id."""
    n = np.diff(w.first)
    hashes, texts = [], []
    m = len(w.hash) - SHINGLE + 1
    if m > 0:
        whole = np.flatnonzero(w.text[:m] == w.text[SHINGLE - 1:])
        hashes.append(tx.ngrams(w.hash, SHINGLE)[whole])
        texts.append(w.text[whole])
    for k in range(1, SHINGLE):                              # short texts: all words are one shingle
        short = np.flatnonzero(n == k)
        if len(short):
            at = w.first[short]
            h = np.zeros(len(short), np.uint64)
            for j in range(k):
                h = h * np.uint64(0x9E3779B97F4A7C15) + w.hash[at + j]
            hashes.append(tx.mix64(h + np.uint64(k)))
            texts.append(short)
    if not hashes:
        none = np.zeros(0, np.uint64)
        return none.astype(np.int64), none, none.astype(np.int64)
    key = (np.concatenate(texts).astype(np.uint64) << FID_BITS) | (np.concatenate(hashes) >> np.uint64(16))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> FID_BITS).astype(np.int64), key & FID_MASK, tf


def slots(fid: np.ndarray, row: int) -> np.ndarray:
    return ((tx.mix64(fid) * SKETCH_ODDS[row]) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def weights(fid: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights; ``idf`` holds one table per sketch row (the larger idf has the smaller error)."""
    base = np.maximum(idf[0][slots(fid, 0)], idf[1][slots(fid, 1)])
    return (base * (1 + np.log(tf))).astype(np.float32)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """idf tables (2, SLOTS) from the shingles of all documents; docs has one column, the text."""
    def count(batches):
        sums, texts = np.zeros((2, SLOTS), np.int64), 0
        for b in batches:
            data, offs, _ = tx.utf8(b.column(0))
            texts += b.num_rows
            for i, j in tx.chunks(offs, CHUNK * 4):
                o = offs[i:j + 1]
                _, fid, _ = shingles(tx.words(data[o[0]:o[-1]], o - o[0], lower=True))
                for r in range(2):
                    sums[r] += np.bincount(slots(fid, r), minlength=SLOTS)
        if texts:
            flat = sums.ravel()
            parts = [flat[k:k + SKETCH_CHUNK] for k in range(0, flat.size, SKETCH_CHUNK)]
            at = [k for k, p in enumerate(parts) if p.any()]
            yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()),
                                              pa.array([*(parts[k].tobytes() for k in at), np.array([texts]).tobytes()], pa.binary())],
                                             names=["chunk", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(raw, np.int64)
                sums[k] = sums[k] + v if k in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                             names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    got = docs.mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect()     # 2 * SLOTS counters
    sums, texts = np.zeros(2 * SLOTS, np.int64), 0
    for r in got:
        v = np.frombuffer(r.counts, np.int64)
        if r.chunk < 0:
            texts = int(v[0])
        else:
            sums[r.chunk * SKETCH_CHUNK:][:len(v)] = v
    sums = sums.reshape(2, SLOTS)
    load = (sums.sum(1, keepdims=True) - sums) / (SLOTS - 1)
    share = (sums - load) / max(1, texts)
    return np.log1p(1 / (np.maximum(share, FLOOR) + SMOOTH)).astype(np.float32)


# ---------------------------------------------------------------- samples

def samples(text: np.ndarray, fid: np.ndarray, w: np.ndarray, texts: int) -> np.ndarray:
    """(texts, BANDS) band keys; texts without a feature have zeros."""
    keys = np.zeros((texts, BANDS), np.uint64)
    if not len(fid):
        return keys
    start = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    there, size = text[start], np.diff(np.append(start, len(text)))
    lnw, mixed = np.log(w), tx.mix64(fid)
    low16 = np.uint64(0xFFFF)
    first = np.empty(len(start), np.int64)
    segment = np.repeat(np.arange(len(start)), size)
    for k in range(BANDS * ROWS):
        h = (mixed ^ SEEDS[k]) * ODDS[k]
        h ^= h >> np.uint64(29)
        h *= MIX
        r = GAMMA[h >> np.uint64(48)]
        beta = BETA[(h >> np.uint64(16)) & low16]
        t = np.floor(lnw / r + beta)
        a = LOG_GAMMA[(h >> np.uint64(32)) & low16] - r * (t - beta + 1)
        at = np.flatnonzero(a == np.minimum.reduceat(a, start)[segment])[::-1]
        first[segment[at]] = at                               # the first of equal minima
        pick = tx.mix64(fid[first] + (t[first].astype(np.int64).astype(np.uint64) << FID_BITS))
        keys[there, k // ROWS] = keys[there, k // ROWS] * MIX + pick
    return keys


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(id, text) in; (id, k1, k2, n_words, bytes, bands) out. k1 and k2 name the word sequence; null for a null text."""
    def run(batches):
        for b in batches:
            data, offs, valid = tx.utf8(b.column(1))
            for i, j in tx.chunks(offs, CHUNK):
                o = offs[i:j + 1]
                w = tx.words(data[o[0]:o[-1]], o - o[0], lower=True)
                n = np.diff(w.first)
                place = (np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)).astype(np.uint64)
                k1, k2 = np.zeros((2, j - i), np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    k1[some] = np.add.reduceat(tx.mix64(w.hash + place * MIX), w.first[some])
                    k2[some] = np.add.reduceat(tx.mix64((w.hash ^ MIX) + place * ODDS[0]), w.first[some])
                text, fid, tf = shingles(w)
                keys = samples(text, fid, weights(fid, tf, idf), j - i)
                null = ~valid[i:j]
                bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(k1.view(np.int64), mask=null), pa.array(k2.view(np.int64), mask=null),
                     pa.array(n.astype(np.int64)), pa.array(np.diff(o)), bands],
                    names=["id", "k1", "k2", "n_words", "bytes", "bands"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, k1 long, k2 long, n_words long, bytes long, bands array<long>")


# ---------------------------------------------------------------- exact comparison inside tasks

def forest(n: int):
    """(root, join) of a union-find over n nodes; join tells whether two trees met."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> bool:
        i, j = root(i), root(j)
        parent[max(i, j)] = min(i, j)
        return i != j

    return root, join


def similar(fids: list[np.ndarray], ws: list[np.ndarray], side: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with weighted Jaccard >= threshold (of different sides, if there are two)."""
    n, out = len(fids), []
    root, join = forest(n)
    total = np.array([w.sum(dtype=np.float64) for w in ws])
    two = bool(side.any()) and not bool(side.all())
    if n <= 6:
        for i in range(n):
            for j in range(i + 1, n):
                if two and side[i] == side[j] or min(total[i], total[j]) < threshold * max(total[i], total[j]) or root(i) == root(j):
                    continue
                _, x, y = np.intersect1d(fids[i], fids[j], assume_unique=True, return_indices=True)
                both = np.minimum(ws[i][x], ws[j][y]).sum(dtype=np.float64)
                if both >= threshold * (total[i] + total[j] - both) and join(i, j):
                    out.append((i, j))
        return out
    every = np.concatenate(fids)
    vocabulary, code = np.unique(every, return_inverse=True)
    shared = np.bincount(code) > 1
    place = np.cumsum(shared) - 1
    row = np.repeat(np.arange(n), [len(f) for f in fids])
    keep = shared[code]
    row, col, val = row[keep], place[code[keep]], np.concatenate(ws)[keep]
    first = np.searchsorted(row, np.arange(n + 1))
    dense = np.zeros(int(shared.sum()), np.float32)
    for i in range(n):
        mine = slice(first[i], first[i + 1])
        if first[i] == first[i + 1]:
            continue
        dense[col[mine]] = val[mine]
        both = np.bincount(row, np.minimum(val, dense[col]), n)       # min-sum with every text of the group
        dense[col[mine]] = 0
        hit = both >= threshold * (total + total[i] - both)
        hit[:i + 1] = False
        if two:
            hit &= side != side[i]
        out += [(i, int(j)) for j in np.flatnonzero(hit) if join(i, int(j))]
    return out


def links(work: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Rows (key, side, id, text), dealt out by key; (a, b) of a spanning forest of each group's links."""
    def run(batches):
        for t, starts in whole_groups(batches):
            side, ids = t.column(1).to_numpy(), t.column(2).to_pylist()
            data, offs, _ = tx.utf8(t.column(3))
            fids, ws = [], []
            for i, j in tx.chunks(offs):
                o = offs[i:j + 1]
                text, fid, tf = shingles(tx.words(data[o[0]:o[-1]], o - o[0], lower=True))
                w = weights(fid, tf, idf)
                at = np.searchsorted(text, np.arange(j - i + 1))
                fids += [fid[at[k]:at[k + 1]] for k in range(j - i)]
                ws += [w[at[k]:at[k + 1]] for k in range(j - i)]
            a, b = [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                for x, y in similar(fids[s:e], ws[s:e], side[s:e], threshold):
                    a.append(ids[s + x])
                    b.append(ids[s + y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, t.schema.field(2).type), pa.array(b, t.schema.field(2).type)], names=["a", "b"])

    kind = work.schema["id"].dataType.simpleString()
    return work.mapInArrow(run, f"a {kind}, b {kind}")


# ---------------------------------------------------------------- the operator

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, component_id (smallest id reachable over links), kept (is that id)."""
    ensure_checkpoint_dir(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    idf = document_frequencies(plain.select("text"))
    signed = reliable_checkpoint(signatures(plain, idf))
    classes = reliable_checkpoint(
        signed.filter("k1 IS NOT NULL AND id IS NOT NULL").groupBy("k1", "k2")
        .agg(F.min("id").alias("rep"), F.first("n_words").alias("n_words"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands")))

    banded = classes.filter("n_words > 0").select("rep", "bytes", F.posexplode("bands").alias("band", "h"))
    buckets = (banded.groupBy("band", "h")
               .agg(F.count("*").alias("n"), F.sum("bytes").alias("size"), F.min("rep").alias("low"), F.bit_xor(F.xxhash64("rep")).alias("set"))
               .filter("n > 1")
               .groupBy("n", "size", "low", "set").agg(F.min(F.struct("band", "h")).alias("b"))      # one of the equal buckets
               .select(F.col("b.band").alias("band"), F.col("b.h").alias("h"),
                       F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("size") / BLOCK_BYTES)).alias("blocks")))
    members = banded.join(reliable_checkpoint(buckets), ["band", "h"]).select("band", "h", "rep", "blocks")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    met = members.withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    tasks = reliable_checkpoint(met.select(F.xxhash64("band", "h", low, high).alias("key"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "rep"))
    # of the rows of one id any will do: texts of one id are one document
    texts = plain.filter("id IS NOT NULL AND text IS NOT NULL").withColumnRenamed("id", "rep")
    work = tasks.join(texts, "rep").select("key", "side", F.col("rep").alias("id"), "text")
    found = reliable_checkpoint(links(in_groups(work, "key"), idf, threshold))

    roots = components(found)
    named = (classes.select("k1", "k2", "rep").join(roots, F.col("rep") == F.col("node"), "left")
             .select("k1", "k2", F.coalesce("component", "rep").alias("component_id")))
    out = (signed.select("id", "k1", "k2").join(reliable_checkpoint(named), ["k1", "k2"], "left")
           .select("id", F.coalesce("component_id", "id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group; all columns. Every row is a document of its own,
    also where ids are null or repeat (then rows are numbered in the order of their ids): a text goes only if a near
    copy of that very text stays."""
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if not ids.filter("n > 1 OR id IS NULL").limit(1).count():
        return docs.join(_gone(docs, id_col, text_col, threshold), F.col(id_col) == F.col("_gone"), "left_anti")
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = global_row_number(docs, [id_col, F.xxhash64(F.col(text_col).cast("string"))], out=row).df
    return rows.join(_gone(rows, row, text_col, threshold), F.col(row) == F.col("_gone"), "left_anti").drop(row)


def _gone(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    found = near_duplicates(docs, id_col, text_col, threshold)
    return reliable_checkpoint(found.filter(~F.col("kept")).select(F.col(id_col).alias("_gone")))


def op6_minhash(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
