"""Property checks against brute force on small random inputs."""

import pytest
from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st

from riskloom.operators import ordering

rows_st = st.lists(st.tuples(st.integers(0, 1), st.one_of(st.none(), st.integers(0, 6))),
                   min_size=2, max_size=40)


def brute_rank(vals):
    present = [v for v in vals if v is not None]
    n = len(present)
    out = []
    for v in vals:
        if v is None:
            out.append(None)
        else:
            below = sum(1 for x in present if x < v)
            ties = sum(1 for x in present if x == v)
            out.append((below + (ties + 1) / 2) / n)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows_st)
def test_pct_rank_brute_force(spark, rows):
    vals = [None if v is None else float(v) for _, v in rows]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k long, v double")
    got = {r.k: r.r for r in ordering.pct_rank(df, "v", "r", "k", num_partitions=3).collect()}
    for i, want in enumerate(brute_rank(vals)):
        assert (got[i] is None and want is None) or got[i] == pytest.approx(want)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows_st)
def test_auc_brute_force_and_symmetry(spark, rows):
    data = [(i, y, float(v)) for i, (y, v) in enumerate(rows) if v is not None]
    pos = [p for _, y, p in data if y == 1]
    neg = [p for _, y, p in data if y == 0]
    df = spark.createDataFrame(data or [(0, 0, 0.0)], "k long, y int, p double")
    got = ordering.roc_auc(df, "y", "p")
    if not pos or not neg:
        assert got is None
        return
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(want)
    flipped = spark.createDataFrame([(k, y, -p) for k, y, p in data], "k long, y int, p double")
    assert ordering.roc_auc(flipped, "y", "p") == pytest.approx(1 - want)
