"""Whole groups inside tasks: rows of one key arrive together, many groups a batch.

``in_groups`` deals rows out by a 64-bit key and sorts them within partitions;
``whole_groups`` re-cuts a task's Arrow batches so that no group is split. Callers
bound a group's rows first (large groups are cut into blocks), so a task holds one
batch and at most one bounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def in_groups(df: DataFrame, key: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key)


def whole_groups(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of several whole groups, first row of each group and the end); the key is column 0."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool):
        t = pa.Table.from_batches(held).combine_chunks()
        k = t.column(0).to_numpy()
        edges = np.flatnonzero(k[1:] != k[:-1]) + 1
        end = len(k) if last else (int(edges[-1]) if len(edges) else 0)
        held.clear()
        if end < len(k):
            held.extend(t.slice(end).to_batches())
        return (t.slice(0, end), np.concatenate([[0], edges[edges < end], [end]])) if end else None

    for b in batches:
        if not b.num_rows:
            continue
        for at in range(0, b.num_rows, 1000):
            held.append(b.slice(at, 1000))
            first, last = held[0].column(0)[0].as_py(), held[-1].column(0)[-1].as_py()
            if first != last and sum(x.nbytes for x in held) > most_bytes:
                got = cut(False)
                if got:
                    yield got
    if held:
        yield cut(True)
