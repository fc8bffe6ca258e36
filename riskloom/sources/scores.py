"""Score-table scans and sinks.

A score directory holds one Parquet table per base model: ``oof_<version>``
(key, label, pred_<version>) or ``pred_<version>_test`` (key,
pred_<version>). An explicit list of versions is preferred to a glob, which
picks up stale runs; the glob form excludes names containing ``mlp`` and
sorts by name, which fixes the meta-feature order.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import KEY, LABEL


def check_score_contract(df: DataFrame, key: str = KEY, label: str | None = LABEL) -> str:
    """A4: exactly key, (label,) and one score column; returns the score name."""
    expected = {key} | ({label} if label else set())
    scores = [c for c in df.columns if c not in expected]
    missing = expected - set(df.columns)
    if missing or len(scores) != 1:
        raise ValueError(f"score table columns {df.columns}: need {sorted(expected)} + one score")
    return scores[0]


def list_score_tables(spark: SparkSession, directory: str, kind: str = "oof",
                      exclude: str = "mlp") -> list[str]:
    """Sorted table folders of one kind in ``directory``: folder names of the
    Parquet files below it, listed by Spark (no content is read)."""
    glob = "oof_*" if kind == "oof" else "pred_*_test"
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(os.path.join(directory, glob))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    names = [r[0] for r in files.select(name).distinct().collect()]       # one row per table
    return sorted(n for n in names if exclude.lower() not in n.lower())


def scan_score_tables(spark: SparkSession, directory: str, kind: str = "oof",
                      versions: list[str] | None = None, key: str = KEY,
                      label: str = LABEL) -> list[DataFrame]:
    """A3: read the score tables (explicit versions, or the sorted listing)."""
    if versions is not None:
        names = [f"oof_{v}" if kind == "oof" else f"pred_{v}_test" for v in versions]
    else:
        names = list_score_tables(spark, directory, kind)
    if not names:
        raise ValueError(f"no {kind} score tables in {directory}")
    out = []
    for n in names:
        df = spark.read.parquet(os.path.join(directory, n))
        check_score_contract(df, key, label if kind == "oof" else None)
        out.append(df)
    return out


def write_score_table(df: DataFrame, directory: str, version: str, kind: str = "oof") -> str:
    """One writer for both score-table kinds."""
    name = f"oof_{version}" if kind == "oof" else f"pred_{version}_test"
    path = os.path.join(directory, name)
    df.write.mode("overwrite").parquet(path)
    return path
