import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ordering
from riskloom.operators.impute import fit_medians


def brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    if not pos or not neg:
        return None
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_pct_rank_ties_and_null(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, None)], "k long, v double")
    got = {r.k: r.p for r in ordering.pct_rank(df, "v", "p", "k").collect()}
    assert got[1] == pytest.approx(1 / 3) and got[2] == pytest.approx(5 / 6)
    assert got[3] == pytest.approx(5 / 6) and got[4] is None


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_row_number_is_a_permutation(spark, parts):
    rows = [(i, random.Random(i).randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v int").repartition(7)
    n = ordering.global_row_number(df, ["v", "k"], "rn", num_partitions=parts)
    got = sorted((r.v, r.k, r.rn) for r in n.df.collect())
    assert [x[2] for x in got] == list(range(1, 501)) and n.total == 500


def test_auc_matches_brute_force(spark):
    rng = random.Random(7)
    ys = [rng.randint(0, 1) for _ in range(300)]
    ps = [round(rng.random(), 1) for _ in range(300)]           # many ties
    df = spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(zip(ys, ps))], "k long, y int, p double")
    assert ordering.roc_auc(df, "y", "p") == pytest.approx(brute_auc(ys, ps))
    neg = df.select("k", "y", (-F.col("p")).alias("p"))
    assert ordering.roc_auc(neg, "y", "p") == pytest.approx(1 - brute_auc(ys, ps))
    mono = df.select("k", "y", F.exp(F.col("p") * 3).alias("p"))
    assert ordering.roc_auc(mono, "y", "p") == pytest.approx(brute_auc(ys, ps))


def test_auc_edge_cases(spark):
    one = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.9)], "k long, y int, p double")
    assert ordering.roc_auc(one, "y", "p") is None
    eq = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.5), (3, 0, 0.5)], "k long, y int, p double")
    assert ordering.roc_auc(eq, "y", "p") == 0.5
    perfect = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.1)], "k long, y int, p double")
    assert ordering.roc_auc(perfect, "y", "p") == 1.0
    bad = spark.createDataFrame([(1, 1, None), (2, 0, 0.1)], "k long, y int, p double")
    with pytest.raises(ValueError):
        ordering.roc_auc(bad, "y", "p")


def test_auc_by_group_equals_per_group(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, rng.randint(0, 1), rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, g int, y int, p double")
    t = {r.g: r.auc for r in ordering.roc_auc_table(df, "y", "p", ["g"]).collect()}
    for g in range(3):
        sub = [(y, p) for _, gg, y, p in rows if gg == g]
        assert t[g] == pytest.approx(brute_auc([a for a, _ in sub], [b for _, b in sub]))


def test_median(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 10.0), (5, None)], "k long, x double")
    assert fit_medians(df, ["x"]) == {"x": 2.5}


@pytest.mark.parametrize("n", [1, 2, 7, 400, 30_000])
def test_quantiles_match_numpy(spark, n):
    """Also with a tiny accuracy, so that brackets miss and must widen."""
    rng = np.random.default_rng(n)
    a = [None if u < 0.1 else round(float(u), 3) for u in rng.random(n)]
    b = [float(v) for v in rng.integers(0, 9, n)]
    df = spark.createDataFrame(list(zip(range(n), a, b, [None] * n)), "k long, a double, b double, c double")
    probs = [0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0]
    got = ordering.exact_quantiles(df, ["a", "b", "c"], probs, num_partitions=5)
    for c, vals in (("a", [v for v in a if v is not None]), ("b", b)):
        assert got[c] == (pytest.approx(list(np.quantile(vals, probs))) if vals else [None] * 7)
    assert got["c"] == [None] * 7
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ordering, "SKETCH_K", 8)
        m.setattr(ordering, "BRACKET_MARGIN", 0.01)
        assert ordering.exact_quantiles(df, ["a", "b", "c"], probs, num_partitions=5) == got


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_single_partition_in_rank_and_auc_plans(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 17)) for i in range(100)], "k long, y int, p double")
    ranked = ordering.pct_rank(df, "p", "r", "k")
    auc = ordering.roc_auc_table(df, "y", "p")
    for d in (ranked, auc):
        d.collect()
        lines = _plan(d).splitlines()
        # the only single-partition exchange allowed carries partial aggregates
        # (one row per task for a global sum), never the rows themselves
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert "partial_" in lines[i + 1], "\n".join(lines)
        plan = "\n".join(lines)
        # running sums stay inside one bucket
        assert all("_bucket" in line for line in lines if "Window [" in line)
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_hot_value_spreads_over_partitions(spark):
    """A third of the rows share one score: the key tie-break keeps the range
    partitions balanced, and rank / AUC stay exact."""
    rows = [(i, i % 2, 0.5 if i % 3 == 0 else (i % 97) / 97.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, y int, p double")
    n = ordering.global_row_number(df, ["p", "k"], "rn", num_partitions=8)
    sizes = [r[-1] for r in n.counts]
    assert max(sizes) < 0.2 * 3000
    ys, ps = [r[1] for r in rows], [r[2] for r in rows]
    assert ordering.roc_auc(df, "y", "p") == pytest.approx(brute_auc(ys, ps))
    ranked = {r.k: r.r for r in ordering.pct_rank(df, "p", "r", "k").collect()}
    hot = sorted(ranked[i] for i in range(0, 3000, 3))
    assert hot[0] == hot[-1]                                   # one rank for the tie group
    below = sum(1 for p in ps if p < 0.5)
    assert hot[0] == pytest.approx((below + (1000 + 1) / 2) / 3000)


def test_rank_plan_does_not_grow_with_the_columns(spark, tmp_path):
    """The input is scanned as often for eight columns as for one; no broadcast is needed."""
    rows = [(i, 0.5 if i % 3 == 0 else (None if i % 11 == 0 else (i % 97) / 97.0)) for i in range(3000)]
    spark.createDataFrame(rows, "k long, p double").write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p").select("k", *[(F.col("p") * (i + 1)).alias(f"p{i}") for i in range(8)])
    want = {r.k: r.r for r in ordering.pct_rank(df, "p0", "r", "k", num_partitions=8).collect()}
    scans = []
    for m in (1, 2, 8):
        out = ordering.pct_rank_many(df, [f"p{i}" for i in range(m)], "_rank", "k", 8)
        scans.append(out._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        if m == 8:
            for r in out.collect():
                assert all(r[f"p{i}_rank"] == want[r.k] for i in range(8))
    assert scans[0] == scans[1] == scans[2]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert want == {r.k: r.r for r in ordering.pct_rank(df, "p0", "r", "k", num_partitions=8).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_auc_rejects_null_labels_and_nan_scores(spark):
    rows = [(1, 1, 0.9), (2, 0, 0.1)]
    for bad in ((3, None, 0.5), (3, 1, float("nan")), (3, 0, None)):
        df = spark.createDataFrame([*rows, bad], "k long, y int, p double")
        r = ordering.roc_auc_table(df, "y", "p").first()
        assert (r.auc, r.n_pos, r.n_neg, r.n_null) == (None, 1, 1, 1)
        with pytest.raises(ValueError):
            ordering.roc_auc(df, "y", "p")


def test_sketches_are_merged_in_a_tree(spark, monkeypatch):
    """No merge reads more than a fixed number of sketches, and the merged one stays within its error."""
    monkeypatch.setattr(ordering, "SKETCH_FAN", 4)
    df = spark.range(0, 40_000, 1, 40).select((F.col("id") * 7919 % 40_000).cast("double").alias("a"), F.lit(None).cast("double").alias("b"),
                                              F.when(F.col("id") % 3 == 0, float("nan")).otherwise(1.0).alias("c"))
    merged = ordering.merged_sketches(df, ["a", "b", "c"])
    plan = _plan(merged)
    merged.collect()
    assert plan.count("kll_merge_agg_double(s0") >= 4 and "FLOOR" in plan.upper()       # 40 -> 10 -> 3 -> 1
    row = merged.first()
    assert (row.n0, row.n1, row.n2) == (40_000, 0, 40_000)
    got = ordering.sketch_quantiles(spark, row, {0: [0.0, 0.25, 0.5, 1.0], 2: [0.1, 0.9]})
    assert got[0][0] == 0.0 and got[0][3] == 39_999.0 and got[2] == [1.0, float("inf")]
    assert all(abs(v / 40_000 - r) < 4 * ordering.SKETCH_ERROR for v, r in zip(got[0], (0.0, 0.25, 0.5, 1.0), strict=True))


def test_one_exchange_per_ordering(spark):
    """The rows cross one exchange by (group, bucket); the totals cross their own, summed before."""
    rows = spark.createDataFrame([(i % 3, float(i % 501), 1) for i in range(5000)], "g int, v double, n long").groupBy("g", "v").agg(F.sum("n").alias("n"))
    placed = ordering.value_positions(rows, ["g"], "v", "n", 8)
    plan = _plan(placed)
    assert plan.count("Exchange hashpartitioning(g") == 1 and "rangepartitioning" not in plan and "_bucket" in plan
    got = {(r.g, r.v): (r._lo, r._hi) for r in placed.collect()}
    for g in range(3):
        seen = 0
        for v in sorted(x for k, x in got if k == g):
            n = sum(1 for i in range(5000) if i % 3 == g and i % 501 == v)
            assert got[g, v] == (seen + 1, seen + n)
            seen += n
