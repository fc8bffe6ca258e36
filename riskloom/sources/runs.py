"""Committed versions of a run's tables.

A run is a folder of Parquet tables and, written last, a manifest: each table's name, row
count and content hash. A loader takes only runs whose manifest is there and whose tables
still are what it says, so a half-written run, a table appended later or tables of two runs
in one folder are refused, and ``latest_run`` goes on with the newest whole one.

The hash is the sum of the rows' hashes modulo 2^63 beside their xor: the same whatever the
files and the order of the rows; a repeated row changes it. One narrow pass a table.

Defined results: an empty table has count and hash 0; a folder without runs has no latest one.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest"
MANIFEST_SCHEMA = "name string, rows long, total long, mixed long, columns string"
HASH_MODULUS = (1 << 61) - 1


class TornRun(ValueError):
    """A run without a manifest, or whose tables are not those of its manifest."""


def content(df: DataFrame) -> tuple[int, int, int, str]:
    """(rows, sum and xor of the rows' hashes, columns with their types)."""
    names = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    h = F.xxhash64(*[F.col(c) for c in df.columns], *[F.col(c).isNull() for c in df.columns])
    row = df.agg(F.count(F.lit(1)), F.try_sum(F.pmod(h, F.lit(HASH_MODULUS)).cast("decimal(38,0)")), F.bit_xor(h)).first()
    return row[0], int(row[1] or 0) % HASH_MODULUS, row[2] or 0, names


@dataclass
class RunWriter:
    """Writes the tables of one run; nothing counts until ``commit``."""
    spark: SparkSession
    path: str

    def write(self, df: DataFrame, name: str) -> None:
        df.write.mode("errorifexists").parquet(os.path.join(self.path, name))

    def commit(self, names: list[str]) -> None:
        """The manifest over the tables as they were written, in one file, last."""
        rows = [(n, *content(self.spark.read.parquet(os.path.join(self.path, n)))) for n in names]
        self.spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("errorifexists").json(os.path.join(self.path, MANIFEST))


def open_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a committed run, each checked against the manifest."""
    try:
        manifest = spark.read.schema(MANIFEST_SCHEMA).json(os.path.join(path, MANIFEST)).collect()     # one row per table
        out = {r.name: spark.read.parquet(os.path.join(path, r.name)) for r in manifest}
    except AnalysisException as e:
        raise TornRun(f"{path}: {e.getCondition()}") from None
    if not manifest:
        raise TornRun(f"{path}: empty manifest")
    for r in manifest:
        if content(out[r.name]) != tuple(r)[1:]:
            raise TornRun(f"{path}: table {r.name} is not the committed one")
    return out


def list_runs(spark: SparkSession, base: str) -> list[str]:
    """Names of the run folders below ``base`` that hold a manifest, ascending."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(os.path.join(base, "*", MANIFEST))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    name = F.regexp_extract("path", rf"([^/]+)/{MANIFEST}/[^/]+$", 1)
    return sorted(r[0] for r in files.select(name).distinct().collect())                                # one row per run


def latest_run(spark: SparkSession, base: str) -> tuple[str, dict[str, DataFrame], list[str]]:
    """(name, tables, names of newer torn runs) of the newest whole run below ``base``."""
    torn = []
    for name in reversed(list_runs(spark, base)):
        try:
            return name, open_run(spark, os.path.join(base, name)), torn
        except TornRun:
            torn.append(name)
    raise TornRun(f"{base}: no whole run; torn: {torn}")
