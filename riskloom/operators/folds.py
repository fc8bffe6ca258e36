"""Deterministic stratified folds (E2) and fold filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import KEY, LABEL
from ..functions.columns import uniform_from_key
from .ordering import bucket_positions, global_row_number, range_partitions


MAX_CLASSES = 100


@dataclass
class FoldConfig:
    n_splits: int = 5
    shuffle: bool = True
    random_state: int = 42


def require_columns(df: DataFrame, names) -> None:
    """L2: fail before any job when a needed column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def shuffle_key(key: str = KEY, seed: int = 42):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def make_stratified_folds(df: DataFrame, label: str = LABEL, cfg: FoldConfig | None = None,
                          key: str = KEY, out: str = "fold") -> DataFrame:
    """fold = (row_number over (label, md5(key|seed), key) - 1) % k.

    Consecutive positions inside a class cycle through the folds, so every
    class and the total split within one row per fold. The row number comes
    is a position inside (label, range of the hash): no single-partition window, one exchange.
    """
    cfg = cfg or FoldConfig()
    require_columns(df, [label, key])
    k = cfg.n_splits
    # a label has few values; more than that is refused before anything is numbered
    classes = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).limit(MAX_CLASSES + 1).collect()}
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"label {label!r} has more than {MAX_CLASSES} values")
    if None in classes:
        raise ValueError(f"label {label!r} has NULL values")
    if not classes or max(classes.values()) < k:
        raise ValueError(f"n_splits={k} exceeds the size of every class: {classes}")
    if not cfg.shuffle:
        numbered = global_row_number(df, [F.col(label), F.col(key)], "_rn")
        return numbered.df.withColumn(out, ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")
    # the hash is uniform: equal ranges of its first digits are buckets of equal size in every class
    buckets = range_partitions(df)
    bucket = F.floor(uniform_from_key(key, cfg.random_state) * buckets).cast("int")
    placed = bucket_positions(df, [label], bucket, [shuffle_key(key, cfg.random_state), F.col(key)])
    first = F.lit(0).cast("long")
    start = 0
    for value in sorted(classes):
        first = F.when(F.col(label) == value, F.lit(start).cast("long")).otherwise(first)
        start += classes[value]
    return placed.withColumn(out, ((first + F.col("_lo") - 1) % k).cast("int")).drop("_lo", "_hi")


def assign_folds(df: DataFrame, label: str = LABEL, cfg: FoldConfig | None = None,
                 key: str = KEY, out: str = "fold") -> DataFrame:
    """Fold column for a wide table: only (key, label) goes through the
    numbering pass (and its checkpoint); the fold is joined back on the key,
    so the wide rows cross one ordinary shuffle instead of being written to
    the checkpoint folder."""
    require_columns(df, [label, key])
    ids = make_stratified_folds(df.select(key, label), label, cfg, key, out).select(key, out)
    return df.join(ids, key, "inner")


def fold_split(df: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, valid) of fold ``fold``: ``fold != k`` / ``fold == k``."""
    require_columns(df, [fold_col])
    return df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold)
