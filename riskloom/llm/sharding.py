"""Sharding by weighted rendezvous hashing (operator 12).

Every shard draws a uniform number u from the record's key and its own name; the record
goes to the shard with the highest -weight / ln(u). A shard's draw depends on no other
shard, so a new shard takes rows from all others in proportion to its weight and moves
no row between them, and a removed shard gives away its own rows only.

One narrow pass decides the shard of every row; nothing is gathered, whatever the number
of equal keys or texts. Slots (gapless places inside a shard) come from one range sort of
narrow rows (no text) by shard and key, so they do not depend on the input's partitions.

Defined results: a null key is a key like any other (all its rows share a shard); a null
text has no bytes and the checksum of the empty text; repeated rows share a shard and
have slots of their own; an empty table gives an empty result; extra columns are ignored
by ``assign`` and kept by ``write_shards``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordering import global_row_number
from riskloom.session import ensure_checkpoint_dir, reliable_checkpoint

SHARDS = 16
DRAW_BITS = 52          # 13 hex digits of the md5 of key and shard: exact in a double


def draw(key: Column, shard: int) -> Column:
    """Uniform in (0, 1) from the key and the shard's name alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{shard}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << DRAW_BITS)


def scores(key: Column, weights: Sequence[float]) -> list[Column]:
    return [F.lit(-float(w)) / F.log(draw(key, k)) for k, w in enumerate(weights) if w > 0]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key``: the highest score, ties to the lower number. Shards without weight take nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    names = [k for k, w in enumerate(weights) if w > 0]
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-k).alias("k")) for s, k in zip(scores(key, weights), names, strict=True)]))
    return -best["k"]


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per row: id, size, text_crc32, shard, slot, and grown_shard under the weights ``grown``.
    Both choices come from one set of draws."""
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = narrow.select("*", rendezvous(F.col("id"), weights).alias("shard"),
                           (rendezvous(F.col("id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"))
    numbered = global_row_number(reliable_checkpoint(placed), ["shard", "id", "text_crc32", "size"], count_by=["shard"])
    counts: dict[int, int] = {}
    for _, shard, n in numbered.counts:
        counts[shard] = counts.get(shard, 0) + n
    start, starts = 0, []
    for shard in range(len(weights)):
        starts.append(F.lit(start))
        start += counts.get(shard, 0)
    first = F.element_at(F.array(*[s.cast("long") for s in starts]), F.col("shard") + 1)
    return numbered.df.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("_rn") - 1 - first).alias("slot"), "grown_shard")


def moves(docs: DataFrame, old: Sequence[float], new: Sequence[float], id_col: str = "doc_id") -> DataFrame:
    """The rows whose shard changes from the weights ``old`` to ``new``: id, shard, new_shard."""
    both = docs.select(id_col, rendezvous(F.col(id_col), old).alias("shard"), rendezvous(F.col(id_col), new).alias("new_shard"))
    return both.filter("shard <> new_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], id_col: str = "doc_id", max_rows: int = 1_000_000) -> None:
    """All rows and columns as Parquet in folders ``shard=k``; files of at most ``max_rows`` rows. Rows are not shuffled:
    each task writes its rows into the folders of their shards."""
    (docs.withColumn("shard", rendezvous(F.col(id_col), weights))
     .write.option("maxRecordsPerFile", max_rows).partitionBy("shard").parquet(path))


def op12_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = assign(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return got.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _draw_sql(shard: str) -> str:
    return f"(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || {shard}), 1, 13) AS BIGINT) + 0.5) / {1 << DRAW_BITS}.0"


#: DuckDB twin; the checksum goes over blocks of 64 bytes, one block of every text a step.
OP12_SQL = f"""
WITH RECURSIVE octets AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM range(256) r(i))),
texts AS MATERIALIZED (SELECT doc_id, text, row_number() OVER () AS id FROM documents),
blocks AS MATERIALIZED (
  SELECT id, k, list_transform(range(0, length(h) // 2), lambda j: CAST('0x' || substr(h, 2 * j + 1, 2) AS BIGINT)) AS b
  FROM (SELECT id, unnest(regexp_extract_all(hex(encode(text)), '.{{1,128}}')) AS h, unnest(range((octet_length(encode(text)) + 63) // 64)) AS k FROM texts)),
state AS (
  SELECT id, 0 AS k, 4294967295 AS c FROM texts
  UNION ALL
  SELECT s.id, s.k + 1, list_reduce(list_prepend(s.c, b.b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))
  FROM state s JOIN blocks b ON b.id = s.id AND b.k = s.k, octets),
checksum AS (SELECT id, xor(arg_max(c, k), 4294967295) AS crc FROM state GROUP BY id),
scored AS (SELECT id, shard, -1.0 / ln({_draw_sql("shard")}) AS score FROM texts, (SELECT unnest(range({SHARDS + 1})) AS shard)),
chosen AS (
  SELECT id, arg_max(shard, (score, -shard)) FILTER (shard < {SHARDS}) AS shard, arg_max(shard, (score, -shard)) AS grown
  FROM scored GROUP BY id)
SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, crc AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, coalesce(octet_length(encode(text)), 0)) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM texts JOIN checksum USING (id) JOIN chosen USING (id)
"""
