"""Embedding near-duplicates by product quantisation (operator 1).

Vectors of one label are compared by cosine; links are exact and none is missed.

1. Equal vectors of a label form classes; one row stands for each, with its count.
2. A coarse quantiser (k-means) and residual codebooks are fitted on a bounded sample
   (``FIT_ROWS`` vectors by a hash of the id); every class is indexed: the list of its
   nearest centroid, one code per subspace of its residual, and its quantisation error.
3. Sufficient probes: on the unit sphere cosine >= c means distance <= d = sqrt(2 - 2c).
   Two vectors in different lists lie on different sides of the lists' bisecting plane,
   so their distances to it add up to at most d and one of them is within d / 2. A vector
   therefore visits every list whose plane is within d / 2, and each pair is judged
   where the nearer one visits (or at home): once, with no loss.
4. In a list, table look-ups give each visitor's distance to every code; a member can link
   only if that distance minus its own quantisation error is at most d. The rest are
   reranked by exact cosine in double precision.
5. Lists larger than a block are cut into blocks and every two blocks meet in a task. A task
   returns counts per vector and a spanning forest, never all pairs.

Defined results: rows whose label is null, whose vector is null, empty, zero or holds null
or non-finite components link with nothing; vectors of different lengths do not link;
rows of one id and label share a result (their equal copies still count); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import components
from riskloom.llm.groups import in_groups, whole_groups
from riskloom.session import ensure_checkpoint_dir, reliable_checkpoint

THRESHOLD = 0.93
FIT_ROWS = 16_384
ROWS_OF_A_LIST = 32             # sample vectors that a list is trained on, at least
LEAST_LISTS = 16
PLANE_CELLS = 1 << 21           # cells (vector, list) whose planes are measured at once; a few arrays of 16 MB
SUB_DIMS = 8
CODEWORDS = 256
BLOCK = 512
BROADCAST_ROWS = 50_000


# ---------------------------------------------------------------- vectors

def matrices(col) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double) for each length found in a list column; unusable rows are left out."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return []
    col = col.cast(pa.list_(pa.float64()))
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    item = col.values
    flat = np.asarray(item.fill_null(float("nan"))) if len(item) else np.zeros(0)
    length = np.where(np.asarray(col.is_valid()), np.diff(offs), 0)
    out = []
    for d in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == d)
        v = flat[offs[rows][:, None] + np.arange(d)]
        top = np.abs(v).max(1)
        fine = np.isfinite(top) & (top > 0)
        rows, v = rows[fine], v[fine] / top[fine][:, None]     # no overflow in the norm
        out.append((rows, v / np.sqrt((v * v).sum(1))[:, None]))
    return out


def classes(vectors: DataFrame) -> DataFrame:
    """(id, label, vec) in; adds k1, k2 that name the vector, null for unusable rows."""
    rng = np.random.default_rng(5)
    odd = rng.integers(1, 2**63, (2, 4096), dtype=np.uint64) | np.uint64(1)

    def run(batches):
        for b in batches:
            keys, there = np.zeros((2, b.num_rows), np.uint64), np.zeros(b.num_rows, bool)
            for rows, v in matrices(b.column(2)):
                raw = np.ascontiguousarray(v).view(np.uint64)
                for r in range(2):
                    m = np.resize(odd[r], raw.shape[1])
                    h = (raw ^ (raw >> np.uint64(29))) * m
                    h = ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + m[::-1]) * m
                    keys[r, rows] = h.sum(1, dtype=np.uint64) ^ np.uint64(raw.shape[1])
                there[rows] = True
            gone = ~(there & np.asarray(b.column(1).is_valid()))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(k.view(np.int64), mask=gone) for k in keys)],
                                             names=["id", "label", "vec", "k1", "k2"])

    s = vectors.schema
    kinds = ", ".join(f"{c} {s[c].dataType.simpleString()}" for c in ("id", "label", "vec"))
    return vectors.mapInArrow(run, f"{kinds}, k1 long, k2 long")


# ---------------------------------------------------------------- the index

def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        for d in range(x.shape[1]):
            s = np.bincount(near, x[:, d], k)
            n = np.bincount(near, minlength=k)
            c[:, d] = np.where(n > 0, s / np.maximum(n, 1), c[:, d])
    return c


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (rows of x, rows of c)."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None], 0.0)


def nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([squares(x[k:k + step], c).argmin(1) for k in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


@dataclass
class Index:
    dims: int
    lists: np.ndarray                # centroids (K, dims)
    books: list[np.ndarray]          # per subspace (CODEWORDS, width)
    reach: float                     # d: largest distance of a link
    threshold: float

    def sub(self, x: np.ndarray, m: int) -> np.ndarray:
        return x[:, m * SUB_DIMS:(m + 1) * SUB_DIMS]

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, quantisation errors) of vectors in their lists."""
        r = x - self.lists[home]
        codes = np.stack([nearest(self.sub(r, m), b) for m, b in enumerate(self.books)], 1).astype(np.uint8)
        back = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((r - back) ** 2).sum(1))

    def planes(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Distance of each vector to the plane between its list and every other; infinite at home."""
        d2 = squares(x, self.lists)
        apart = np.sqrt(squares(self.lists[home], self.lists))
        mine = d2[np.arange(len(x)), home][:, None]
        out = np.where(apart > 1e-9, (d2 - mine) / (2 * np.maximum(apart, 1e-9)), 0.0)
        out[np.arange(len(x)), home] = np.inf
        return out

    def table_distances(self, q: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (visitors, members of one list) by table look-up."""
        r = q - self.lists[home]
        d2 = np.zeros((len(q), len(codes)), np.float32)
        for m, book in enumerate(self.books):
            d2 += squares(self.sub(r, m), book).astype(np.float32)[:, codes[:, m]]
        return np.sqrt(d2)


def list_count(rows: int, sample: int) -> int:
    """Lists grow with the square root of the rows (more lists save look-ups but cost visits); each is trained on ``ROWS_OF_A_LIST`` sample vectors or more."""
    return max(LEAST_LISTS, min(math.isqrt(rows) // 4, sample // ROWS_OF_A_LIST))


def fit(reps: DataFrame, threshold: float, rows: int = FIT_ROWS) -> Index | None:
    """Quantisers from at most ``rows`` vectors; the most frequent length of the sample is indexed."""
    n = reps.count()
    sample = reps.orderBy(F.xxhash64("rep", "label"), "rep").limit(rows).select("vec").toArrow()
    parts = matrices(sample["vec"]) if sample.num_rows else []
    if not parts:
        return None
    x = max((v for _, v in parts), key=len)
    lists = kmeans(x, list_count(n, len(x)), 8, 11)
    r = (x - lists[nearest(x, lists)])[:8192]
    books = [kmeans(r[:, k:k + SUB_DIMS], CODEWORDS, 6, 13 + k) for k in range(0, x.shape[1], SUB_DIMS)]
    return Index(x.shape[1], lists, books, float(np.sqrt(2 - 2 * threshold)), threshold)


def indexed(reps: DataFrame, index: Index) -> DataFrame:
    """Adds home list, codes, error, and the lists to visit with the distance to their planes."""
    half = index.reach / 2 + 1e-6

    def run(batches):
        for b in batches:
            n = b.num_rows
            home, err = np.full(n, -1, np.int32), np.zeros(n)
            codes: list[bytes] = [b""] * n
            go: list[np.ndarray] = [np.zeros(0, np.int32)] * n
            gap: list[np.ndarray] = [np.zeros(0)] * n
            for rows, v in matrices(b.column("vec")):
                if v.shape[1] != index.dims:
                    home[rows] = -1 - v.shape[1]              # lists of their own, compared exactly
                    continue
                h = nearest(v, index.lists)
                c, e = index.encode(v, h)
                home[rows], err[rows] = h, e
                step = max(1, PLANE_CELLS // len(index.lists))
                for at in range(0, len(rows), step):
                    p = index.planes(v[at:at + step], h[at:at + step])
                    for k, r in enumerate(rows[at:at + step].tolist()):
                        near = np.flatnonzero(p[k] <= half)
                        codes[r], go[r], gap[r] = c[at + k].tobytes(), near.astype(np.int32), p[k, near]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(home), pa.array(err), pa.array(codes, pa.binary()),
                 pa.array(go, pa.list_(pa.int32())), pa.array(gap, pa.list_(pa.float64()))],
                names=[*b.schema.names, "home", "err", "codes", "go", "gap"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema.fields)
    return reps.mapInArrow(run, f"{kinds}, home int, err double, codes binary, go array<int>, gap array<double>")


# ---------------------------------------------------------------- comparison inside tasks

def judge(index: Index, a: dict, b: dict | None, visiting: bool) -> np.ndarray:
    """Boolean links (rows of a, rows of b; a with itself if b is None); each pair is true in one task only."""
    other = a if b is None else b
    home = int(a["home"][0])
    if home >= 0:
        d = index.table_distances(other["x"], home, a["codes"]).T
        i, j = np.nonzero(d - a["err"][:, None] <= index.reach + 1e-4)
    else:
        i, j = np.nonzero(np.ones((len(a["id"]), len(other["id"])), bool))
    if b is None:
        i, j = i[i != j], j[i != j]
    link = np.zeros((len(a["id"]), len(other["id"])), bool)
    for k in range(0, len(i), 1 << 16):                        # exact rerank
        p, q = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
        good = (a["x"][p] * other["x"][q]).sum(1) >= index.threshold
        p, q = p[good], q[good]
        if visiting and len(p):
            there = b["home"][q]
            x, c = a["x"][p], index.lists
            back = np.maximum(((x - c[there]) ** 2).sum(1) - ((x - c[home]) ** 2).sum(1), 0.0)
            apart = np.sqrt(((c[there] - c[home]) ** 2).sum(1))
            mine = np.where(apart > 1e-9, back / (2 * np.maximum(apart, 1e-9)), 0.0)
            first = (b["gap"][q] < mine - 1e-12) | ((np.abs(b["gap"][q] - mine) <= 1e-12) & (b["id"][q] < a["id"][p]))
            p, q = p[first], q[first]
        link[p, q] = True
    return link | link.T if b is None else link


def roots(link: np.ndarray) -> np.ndarray:
    """Component of rows then columns of a boolean matrix, as the smallest position."""
    n, m = link.shape
    r, c = np.arange(n), np.arange(n, n + m)
    if not link.any():
        return np.concatenate([r, c])
    big = n + m
    while True:
        c2 = np.minimum(c, np.where(link, r[:, None], big).min(0, initial=big))
        r2 = np.minimum(r, np.where(link, c2[None], big).min(1, initial=big))
        if (c2 == c).all() and (r2 == r).all():
            return np.concatenate([r, c])
        r, c = r2, c2


def square_roots(link: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric matrix."""
    r = np.arange(len(link))
    while True:
        r2 = np.minimum(r, np.where(link, r[None], len(r)).min(1, initial=len(r)))
        if (r2 == r).all():
            return r
        r = r2


def compare(tasks: DataFrame, index: Index) -> DataFrame:
    """Rows dealt out by key; (a, b, n): links of a spanning forest (n null) and counts of links (b null)."""
    def run(batches):
        for t, starts in whole_groups(batches):
            col = {c: t.column(c) for c in t.schema.names}
            ids, side, home = col["rep"].to_numpy(), col["side"].to_numpy(), col["home"].to_numpy()
            gap, err, size, visit = (col[c].to_numpy() for c in ("gap", "err", "size", "visit"))
            x: list[np.ndarray] = [np.zeros(0)] * len(ids)
            for rows, v in matrices(col["vec"]):
                for k, r in enumerate(rows.tolist()):
                    x[r] = v[k]
            codes = col["codes"].to_pylist()
            out_a, out_b, out_n = [], [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                parts = []
                for w in (0, 1):
                    at = s + np.flatnonzero(side[s:e] == w)
                    if len(at):
                        parts.append({"id": ids[at], "home": home[at], "gap": gap[at], "err": err[at], "size": size[at],
                                      "x": np.stack([x[k] for k in at]),
                                      "codes": np.frombuffer(b"".join(codes[k] for k in at), np.uint8).reshape(len(at), -1)})
                visiting = bool(visit[s])
                if len(parts) == 1 and (visiting or side[s] == 1):
                    continue
                one, two = parts[0], parts[1] if len(parts) == 2 else None
                link = judge(index, one, two, visiting)
                if not link.any():
                    continue
                sides = [one] if two is None else [one, two]
                every = np.concatenate([p["id"] for p in sides])
                root = square_roots(link) if two is None else roots(link)
                count = [link @ (two or one)["size"], one["size"] @ link][:len(sides)]
                total = np.concatenate(count)
                moved = np.flatnonzero(root != np.arange(len(root)))
                some = np.flatnonzero(total)
                out_a += [every[moved], every[some]]
                out_b += [every[root[moved]], np.full(len(some), -1)]
                out_n += [np.full(len(moved), -1), total[some]]
            if out_a:
                a, b, n = (np.concatenate(v).astype(np.int64) for v in (out_a, out_b, out_n))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=n >= 0), pa.array(n, mask=n < 0)], names=["a", "b", "n"])

    return tasks.mapInArrow(run, "a long, b long, n long")


# ---------------------------------------------------------------- the operator

def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept. Ids are whole numbers."""
    ensure_checkpoint_dir(vectors.sparkSession)
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    named = classes(plain)
    rows = reliable_checkpoint(named.select("id", "label", "k1", "k2"))
    reps = reliable_checkpoint(named.filter("k1 IS NOT NULL AND id IS NOT NULL").groupBy("label", "k1", "k2")
                               .agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("vec").alias("vec")))
    index = fit(reps, threshold)
    if index is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    placed = reliable_checkpoint(indexed(reps.drop("k1", "k2"), index))

    homes = placed.groupBy("label", F.col("home").alias("list")).agg(F.count("*").alias("homes"))
    guests = placed.select("label", F.explode("go").alias("list")).groupBy("label", "list").agg(F.count("*").alias("guests"))
    sizes = reliable_checkpoint(
        homes.join(guests, ["label", "list"], "left")           # a list without members has nothing to visit
        .select(F.col("label").alias("_label"), F.col("list").alias("_list"), F.ceil(F.col("homes") / BLOCK).alias("hb"),
                F.ceil(F.coalesce("guests", F.lit(0)) / BLOCK).alias("gb")))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    keep = ["rep", "size", "vec", "home", "err", "codes", "gap"]
    spread = F.xxhash64("rep")

    def key(*parts):
        return F.xxhash64("label", "list", *parts).alias("key")

    def blocks(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    at_home = (placed.withColumn("list", F.col("home")).withColumn("gap", F.lit(0.0))
               .join(sizes, (F.col("label") == F.col("_label")) & (F.col("list") == F.col("_list")))
               .withColumn("mine", F.pmod(spread, F.col("hb"))))
    low, high = F.least("mine", "o"), F.greatest("mine", "o")
    each_other = (at_home.withColumn("o", blocks("hb"))
                  .select(key(F.lit(0), low, high), (F.col("mine") > F.col("o")).cast("int").alias("side"), F.lit(0).alias("visit"), *keep))
    hosting = (at_home.filter("gb > 0").withColumn("o", blocks("gb"))
               .select(key(F.lit(1), "mine", "o"), F.lit(0).alias("side"), F.lit(1).alias("visit"), *keep))
    visiting = (placed.withColumn("g", F.explode(F.arrays_zip("go", "gap")))
                .withColumn("list", F.col("g.go")).withColumn("gap", F.col("g.gap"))
                .join(sizes, (F.col("label") == F.col("_label")) & (F.col("list") == F.col("_list")))
                .withColumn("mine", F.pmod(spread, F.col("gb"))).withColumn("o", blocks("hb"))
                .select(key(F.lit(1), "o", "mine"), F.lit(1).alias("side"), F.lit(1).alias("visit"), *keep))
    work = in_groups(each_other.unionByName(hosting).unionByName(visiting), "key")
    found = reliable_checkpoint(compare(work, index))

    joined = components(found.filter("b IS NOT NULL").select("a", "b"))
    linked = found.filter("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n"))
    by_class = reliable_checkpoint(
        reps.select("label", "k1", "k2", "rep", "size")
        .join(joined, F.col("rep") == F.col("node"), "left").join(linked, F.col("rep") == F.col("a"), "left")
        .select("label", "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id")))
    out = (rows.join(by_class, ["label", "k1", "k2"], "left")
           .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_vector_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: DuckDB twin of the query: all pairs of equal labels, then the smallest id each vector reaches.
OP1_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (
  SELECT vec_id, vec_id AS low FROM v
  UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.low),
low AS (SELECT vec_id, min(low) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)
"""
