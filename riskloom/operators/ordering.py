"""Global order without a single task: row numbers, percent ranks, exact quantiles.

A window without partition keys plans a ``SinglePartition`` exchange, so the
whole table lands in one task. Instead:

1. range-partition on the order key (Spark samples the bounds) and sort
   within each partition;
2. tag each row with ``monotonically_increasing_id`` -- partition index in
   the upper 31 bits, position inside the partition in the lower 33;
3. write the tagged table to the shared checkpoint folder so every later job
   sees the same partitions (a lost executor cannot reshuffle it);
4. count rows per partition (one row per partition reaches the driver),
   turn the counts into running offsets and broadcast them back.

Ranks, AUC and quantiles sum equal values first, so only distinct values are ordered
and ties of any size are one row. Their order needs no range shuffle: a sketch of the
values (KLL, merged in a tree of bounded fan-in) gives bucket edges, the bucket becomes a
column, and rows meet by (group, bucket) in one hash exchange; running sums stay inside a
bucket, and a small table of bucket totals adds where each begins. Sketches are random, but
only the cut into buckets depends on them: positions are exact and the same in every run.

For row numbers ties should be broken by a spreading column (the row key) so that a value
held by a third of the rows still splits over many range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_of
from ..session import default_parallelism, reliable_checkpoint

_LOCAL_BITS = 33
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1


def range_partitions(df: DataFrame) -> int:
    """Range partitions of a numbering pass: ``riskloom.ordering.partitions``
    when the session sets it, else ``spark.sql.shuffle.partitions`` (which a
    cluster job sizes to its data). Read from configuration only: asking the
    DataFrame for its partition count would run its shuffle stages under AQE.
    The offsets that reach the driver are one row per partition."""
    conf = df.sparkSession.conf.get("riskloom.ordering.partitions", None)
    return max(1, int(conf) if conf else default_parallelism(df.sparkSession))


@dataclass
class Numbered:
    df: DataFrame          # input columns + the row-number column
    total: int             # number of rows numbered
    counts: list = None    # (pid, *count_by, n) rows of the offsets pass


def global_row_number(df: DataFrame, order: Sequence, out: str = "_rn",
                      num_partitions: int | None = None, count_by: Sequence[str] = ()) -> Numbered:
    """1-based position of each row in the order ``order`` (ascending, NULLs first).

    Equal order values get distinct, arbitrary but fixed positions.
    ``count_by`` adds low-cardinality columns to the per-partition counts
    (returned in ``counts``) so callers get group sizes from the same pass.
    """
    spark = df.sparkSession
    n = num_partitions or range_partitions(df)
    order_cols = [col_of(c) for c in order]
    staged = (df.repartitionByRange(n, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("_mid", F.monotonically_increasing_id()))
    staged = reliable_checkpoint(staged)
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    rows = [tuple(r) for r in staged.groupBy(pid.alias("_pid"), *count_by).count().collect()]
    per_pid: dict[int, int] = {}
    for r in rows:
        per_pid[int(r[0])] = per_pid.get(int(r[0]), 0) + int(r[-1])
    offsets, running = [], 0
    for p in sorted(per_pid):
        offsets.append((p, running))
        running += per_pid[p]
    if not offsets:
        return Numbered(staged.drop("_mid").withColumn(out, F.lit(None).cast("long")), 0, rows)
    off_df = spark.createDataFrame(offsets, "_pid long, _off long")
    numbered = (staged.join(F.broadcast(off_df), pid == F.col("_pid"))
                .withColumn(out, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOCAL_MASK)) + 1)
                .drop("_mid", "_pid", "_off"))
    return Numbered(numbered, running, rows)


# ---------------------------------------------------------------- sketches

SKETCH_K = 4096               # size of a KLL sketch of doubles; about a hundred kilobytes
SKETCH_FAN = 16               # sketches that one task merges, at most
SKETCH_ERROR = 2.3 / SKETCH_K ** 0.9      # rank error of a sketch, as a share of the rows


def merged_sketches(df: DataFrame, cols: Sequence) -> DataFrame:
    """One row: ``s<i>``, the KLL sketch of column i, and ``n<i>``, its non-NULL values (NaN counts as the
    largest). Every input partition is sketched where it lies; the sketches, one row a partition, are merged
    ``SKETCH_FAN`` at a time in a tree, so no task reads more than that many."""
    x = [col_of(c).cast("double") for c in cols]
    cells = df.select(F.spark_partition_id().alias("_b"), *[F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v).alias(f"x{i}") for i, v in enumerate(x)])
    level = reliable_checkpoint(cells.groupBy("_b").agg(*[f(i) for i in range(len(x)) for f in (
        lambda i: F.kll_sketch_agg_double(f"x{i}", F.lit(SKETCH_K)).alias(f"s{i}"), lambda i: F.count(f"x{i}").alias(f"n{i}"))]))
    rows = (level.agg(F.max("_b")).first()[0] or 0) + 1
    merge = [f(i) for i in range(len(x)) for f in (lambda i: F.kll_merge_agg_double(f"s{i}").alias(f"s{i}"), lambda i: F.sum(f"n{i}").alias(f"n{i}"))]
    while rows > SKETCH_FAN:
        level = level.groupBy(F.floor(F.col("_b") / SKETCH_FAN).alias("_b")).agg(*merge)
        rows = -(-rows // SKETCH_FAN)
    return level.agg(*merge)


def sketch_quantiles(spark, row, ranks: dict[int, Sequence[float]]) -> dict[int, list[float]]:
    """Approximate values at the ``ranks`` (0 to 1) of each column of a collected ``merged_sketches`` row; these columns
    have values."""
    asked = {i: rs for i, rs in ranks.items() if len(rs)}
    if not asked:
        return {i: [] for i in ranks}
    one = spark.createDataFrame([tuple(bytearray(row[f"s{i}"]) for i in asked)], ", ".join(f"s{i} binary" for i in asked))
    got = one.select(*[F.kll_sketch_get_quantile_double(f"s{i}", F.array(*[F.lit(float(r)) for r in rs])) for i, rs in asked.items()]).collect()[0]
    return {i: [] for i in ranks} | {i: list(v) for i, v in zip(asked, got, strict=True)}


# ---------------------------------------------------------------- positions inside groups

TOTALS_BROADCAST = 100_000     # rows (group, bucket) of totals that are broadcast; more are joined


def bucket_positions(df: DataFrame, groups: Sequence[str], bucket: Column, order: Sequence, weight: str | None = None) -> DataFrame:
    """``_lo`` and ``_hi``: first and last 1-based position of each row inside its group in the order ``order`` when a row
    stands for ``weight`` equal rows (1 without it). ``bucket`` is a small number that ascends with the order and cuts
    a group into parts a task can hold; rows meet by (group, bucket) in one exchange, and a table of the buckets'
    totals says where each begins."""
    g = list(groups)
    n = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    staged = df.withColumn("_bucket", bucket)
    totals = staged.groupBy(*g, "_bucket").agg(F.sum(n).alias("_w"))
    before = Window.partitionBy(*[F.col(c) for c in g] or [F.lit(0)]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = reliable_checkpoint(totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], F.col("_bucket").alias("_b"),
                                               F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off")))
    if starts.count() <= TOTALS_BROADCAST:
        starts = F.broadcast(starts)
    inside = Window.partitionBy(*g, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = staged.withColumn("_in", F.sum(n).over(inside))
    same = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(g):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return (run.join(starts, same).withColumn("_hi", F.col("_off") + F.col("_in")).withColumn("_lo", F.col("_hi") - n + 1)
            .drop("_off", "_in", "_bucket", "_b", *[f"_g{i}" for i in range(len(g))]))


def value_positions(df: DataFrame, groups: Sequence[str], value: str, weight: str, num_partitions: int | None = None,
                    written: bool = False) -> DataFrame:
    """``bucket_positions`` in the order of a numeric column. The rows (distinct values with their weights) are written
    once (by the caller if ``written``); a sketch of the values gives the buckets' edges; NULLs come last."""
    rows = df if written else reliable_checkpoint(df)
    buckets = num_partitions or range_partitions(df)
    found = merged_sketches(rows, [value]).first()
    ranks = [k / buckets for k in range(1, buckets)] if found["n0"] else []
    splits = sorted({v for v in sketch_quantiles(rows.sparkSession, found, {0: ranks})[0] if abs(v) != float("inf")})
    x = F.col(value).cast("double")
    bucket = F.lit(0)
    if splits:
        from pyspark.ml.feature import Bucketizer
        rows = rows.withColumn("_x", F.coalesce(F.when(~F.isnan(x), x), F.lit(float("inf"))))
        rows = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_x", outputCol="_at").transform(rows).drop("_x")
        bucket = F.when(x.isNull(), F.lit(len(splits) + 1)).otherwise(F.col("_at").cast("int"))
    return bucket_positions(rows, groups, bucket, [F.col(value).asc_nulls_last()], weight).drop("_at")


# ---------------------------------------------------------------- percent rank

def _long_values(df: DataFrame, cols: Sequence, *keep) -> DataFrame:
    """(_c, _v, *keep) rows of the non-NULL values: column index, value as double."""
    cells = [col_of(c).cast("double") for c in cols]
    pairs = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(i).alias("_c"), v.alias("_v"))) for i, v in enumerate(cells)])
    return df.select(F.explode(F.array_compact(pairs)).alias("_p"), *keep).select("_p._c", "_p._v", *keep)


def _ranked(df: DataFrame, outs: dict[str, str], key: str | None, num_partitions: int | None) -> DataFrame:
    """Percent ranks ``out -> source column``: equal values are summed, the distinct
    values are placed in order, one join on (column, value) gives every cell its
    rank (AQE splits a value held by many rows), one pivot and one join on the key
    bring the ranks home. The plan has the same size for any number of columns."""
    own = key is None
    if own:
        key = "_row"
        df = reliable_checkpoint(df.withColumn(key, F.monotonically_increasing_id()))
    long = _long_values(df, list(outs.values()), key)
    counts = long.groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = reliable_checkpoint(counts)
    sizes = {r[0]: r[1] for r in counts.groupBy("_c").agg(F.sum("_n")).collect()}      # one row per column
    size = F.element_at(F.array(*[F.lit(float(max(sizes.get(i, 0), 1))) for i in range(len(outs))]), F.col("_c") + 1)
    placed = value_positions(counts, ["_c"], "_v", "_n", num_partitions, written=True)
    ranks = placed.select("_c", "_v", ((F.col("_lo") + F.col("_hi")) / 2.0 / size).alias("_r"))
    cells = long.join(ranks, ["_c", "_v"])
    wide = cells.groupBy(key).agg(*[F.max(F.when(F.col("_c") == i, F.col("_r"))).alias(f"_r{i}") for i in range(len(outs))])
    out = df.join(wide, key, "left").select(*df.columns, *[F.col(f"_r{i}").alias(o) for i, o in enumerate(outs)])
    return out.drop(key) if own else out


def pct_rank(df: DataFrame, value: str, out: str, tiebreak: str | None = None,
             num_partitions: int | None = None) -> DataFrame:
    """Average-tie rank divided by the non-NULL count; NULL stays NULL.
    ``tiebreak`` is the row key (unique); without one a row id is written."""
    return _ranked(df, {out: value}, tiebreak, num_partitions)


def pct_rank_many(df: DataFrame, cols: Sequence[str], suffix: str = "_rank",
                  tiebreak: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Percent ranks ``<col><suffix>`` of several columns from one ordering pass."""
    return _ranked(df, {f"{c}{suffix}": c for c in cols}, tiebreak, num_partitions) if cols else df


# ---------------------------------------------------------------- exact AUC

def roc_auc_table(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = (),
                  num_partitions: int | None = None) -> DataFrame:
    """Exact ROC-AUC (ties count one half) per group; one row per group.

    AUC = (sum over positives of their average-tie rank - P(P+1)/2) / (P N),
    with ranks taken inside each group. Rows are first summed to (group, score)
    -> (positives, rows); only distinct scores are ordered. NULL when a group
    has one class. Rows with a NULL or NaN score or a NULL label are counted
    (``n_null``) in the same aggregation and make the group's AUC NULL; the
    scalar :func:`roc_auc` raises on them.
    """
    g = list(group_cols)
    bad = F.col(score).isNull() | F.isnan(F.col(score).cast("double")) | F.col(label).isNull()
    rows = df.select(*g, F.when(~bad, F.col(score)).alias("_v"), F.when(F.col(label) == 1, 1).otherwise(0).alias("_p"))
    per_value = rows.groupBy(*g, "_v").agg(F.sum("_p").alias("_pos"), F.count(F.lit(1)).alias("_cnt"))
    placed = value_positions(per_value, g, "_v", "_cnt", num_partitions)
    is_bad = F.col("_v").isNull()
    per_group = (placed.groupBy(*g)
                 .agg(F.sum(F.when(~is_bad, F.col("_pos") * (F.col("_lo") + F.col("_hi")) / 2.0)).alias("_s"),
                      F.sum(F.when(~is_bad, F.col("_pos"))).cast("double").alias("n_pos"),
                      F.sum(F.when(~is_bad, F.col("_cnt") - F.col("_pos"))).cast("double").alias("n_neg"),
                      F.sum(F.when(is_bad, F.col("_cnt")).otherwise(0)).alias("n_null")))
    auc = F.try_divide(
        F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0,
        F.col("n_pos") * F.col("n_neg"))
    return per_group.select(*g, F.when(F.col("n_null") == 0, auc).alias("auc"),
                            F.coalesce(F.col("n_pos"), F.lit(0.0)).cast("long").alias("n_pos"),
                            F.coalesce(F.col("n_neg"), F.lit(0.0)).cast("long").alias("n_neg"),
                            F.col("n_null").cast("long").alias("n_null"))


def check_no_null_scores(rows, score: str = "score") -> None:
    bad = sum(r["n_null"] or 0 for r in rows)
    if bad:
        raise ValueError(f"{bad} rows have a NULL label or a NULL or NaN {score!r}")


def roc_auc(df: DataFrame, label: str, score: str) -> float | None:
    """Scalar AUC for driver-side use (fold metrics, search objectives)."""
    row = roc_auc_table(df, label, score).first()
    if row is None:
        return None
    check_no_null_scores([row], score)
    return row["auc"]


# ---------------------------------------------------------------- quantiles

BRACKET_MARGIN = 2.0          # brackets are this many sketch errors wide to either side


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    num_partitions: int | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles per column (NULLs skipped), one
    algorithm at every size:

    1. sketches, merged in a tree, bracket every wanted rank of every column;
    2. one pass counts the rows below each bracket and sums the equal values inside, per task
       and then over all (a bracket that missed its rank is widened and counted again);
    3. the values inside -- a few thousandths of the rows a rank -- are placed in order, and
       the order statistics are read off.

    Returns a small dict (state); all-NULL columns give NULLs; NaN counts as infinity."""
    cols, probs = list(cols), [float(p) for p in probs]
    if not cols:
        return {}
    x = [F.col(c).cast("double") for c in cols]
    sketches = merged_sketches(df, x).first()
    sizes = [sketches[f"n{i}"] or 0 for i in range(len(cols))]
    ranks = {i: sorted({r for p in probs for r in (int((n - 1) * p), min(int((n - 1) * p) + 1, n - 1))})
             for i, n in enumerate(sizes) if n}
    found: dict[tuple[int, int], float] = {}
    margin = BRACKET_MARGIN * SKETCH_ERROR
    while True:
        todo = {i: [r for r in rs if (i, r) not in found] for i, rs in ranks.items()}
        todo = {i: rs for i, rs in todo.items() if rs}
        if not todo:
            break
        found.update(_order_statistics(df, x, sizes, sketches, todo, margin, num_partitions))
        margin *= 8
    out = {}
    for i, c in enumerate(cols):
        out[c] = []
        for p in probs:
            if i not in ranks:
                out[c].append(None)
                continue
            at = (sizes[i] - 1) * p
            low = int(at)
            high = min(low + 1, sizes[i] - 1)
            a, b = found[i, low], found[i, high]
            out[c].append(a if at == low or a == b else (low + 1 - at) * a + (at - low) * b)
    return out


def _brackets(spark, sizes, sketches, todo, margin) -> dict[int, list[tuple[float, float]]]:
    """Per column ascending, disjoint brackets (low, high) around the wanted ranks."""
    asked = {i: [min(1.0, max(0.0, r / max(1, sizes[i] - 1) + d)) for r in rs for d in (-margin, margin)] for i, rs in todo.items()}
    out = {}
    for i, values in sketch_quantiles(spark, sketches, asked).items():
        ends = [float("-inf") if r == 0.0 else float("inf") if r == 1.0 else v for r, v in zip(asked[i], values, strict=True)]
        merged: list[list[float]] = []
        for low, high in sorted(zip(ends[::2], ends[1::2], strict=True)):
            if merged and low <= merged[-1][1]:                                          # overlapping brackets are one
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        out[i] = [tuple(m) for m in merged]
    return out


def _bracket_counts(df, x, brackets) -> DataFrame:
    """(_c, _k, _v, _n) in one pass: per column and bracket the values inside with their counts in a task, and, with _v
    NULL, the rows below it."""
    cols = list(brackets)

    def run(batches):
        under = {(i, j): 0 for i in cols for j in range(len(brackets[i]))}
        held: dict[tuple, list] = {k: [] for k in under}
        for b in batches:
            for at, i in enumerate(cols):
                v = b.column(at).to_numpy(zero_copy_only=False)              # NULL arrives as NaN
                for j, (low, high) in enumerate(brackets[i]):
                    under[i, j] += int((v < low).sum())
                    parts = held[i, j]
                    parts.append(np.unique(v[(v >= low) & (v <= high)], return_counts=True))
                    if len(parts) > 32:
                        held[i, j] = [_summed(parts)]
        for (i, j), n in under.items():
            values, counts = _summed(held[i, j])
            m = len(values) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, i, np.int32)), pa.array(np.full(m, j, np.int32)),
                                              pa.array([None, *values.tolist()], pa.float64()), pa.array([n, *counts.tolist()], pa.int64())],
                                             names=["_c", "_k", "_v", "_n"])

    cells = df.select(*[F.when(F.isnan(x[i]), F.lit(float("inf"))).otherwise(x[i]).alias(f"x{i}") for i in cols])
    return cells.mapInArrow(run, "_c int, _k int, _v double, _n long")


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0), np.zeros(0, np.int64)
    values, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.zeros(len(values), np.int64)
    np.add.at(counts, which, np.concatenate([p[1] for p in parts]))
    return values, counts


def _order_statistics(df, x, sizes, sketches, todo, margin, num_partitions) -> dict[tuple[int, int], float]:
    """(column, rank from 0) -> value for the ranks that their brackets hold."""
    spark = df.sparkSession
    brackets = _brackets(spark, sizes, sketches, todo, margin)
    counts = reliable_checkpoint(_bracket_counts(df, x, brackets).groupBy("_c", "_k", "_v").agg(F.sum("_n").alias("_n")))
    sums = {tuple(r[:3]): r[3] for r in counts.groupBy("_c", "_k", F.col("_v").isNotNull()).agg(F.sum("_n")).collect()}   # two rows per bracket
    placed = value_positions(counts.where(F.col("_v").isNotNull()), ["_c", "_k"], "_v", "_n", num_partitions, written=True)
    wanted = []
    for i, bs in brackets.items():
        for j in range(len(bs)):
            under, inside = sums.get((i, j, False), 0), sums.get((i, j, True), 0)
            wanted += [(i, j, r - under + 1, r) for r in todo[i] if under <= r < under + inside]
    if not wanted:
        return {}
    want = F.broadcast(spark.createDataFrame(wanted, "_c int, _k int, _at long, _rank long"))         # two rows a quantile
    got = placed.join(want, ["_c", "_k"]).where((F.col("_lo") <= F.col("_at")) & (F.col("_at") <= F.col("_hi"))).select("_c", "_rank", "_v").collect()
    return {(r["_c"], r["_rank"]): r["_v"] for r in got}
