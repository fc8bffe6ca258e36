"""Merkle manifest of a dataset (operator 13), climbed by a recursive query.

H is the lower-case hex sha256 of its inputs put together, digests as hex text.

1. A leaf is H of a row's fields. Leaves are numbered per group (here ``lang``) in the
   order of their id; the numbering is one range sort, never one task for a group.
2. Trees are built tile by tile: 2^``TILE`` consecutive nodes of a level go to one task,
   which returns all levels above them. A tile's root is a node of the next round, so a
   group of n leaves takes log(n) / ``TILE`` rounds. The groups' roots, in the order of
   the groups, are the leaves of one more tree.
3. The built levels are stored as rows linked to their parents: a node's address, its
   digest, the siblings of its next ``HOP`` levels (left or right of the way) and the
   address of its ancestor there. With ``hop=1`` each row names its very parent.
4. ``climb`` is a recursive query (WITH RECURSIVE): from every start it joins the links
   by address, appends the siblings and folds the digest, until a node has no link.
   Leaves climb to their tile's root; one climb from each tile's root gives the way to
   the root that its leaves share, so no upper node meets all leaves of a group.

Nothing that grows with the rows reaches the driver or one task: it sees one count and
one digest. A lost executor repeats tasks that read written tables.

Defined results: null fields are ``-``; a null group is a group and comes first, a null
id first in its group; rows of equal id follow the order of their leaves (repeated rows
are leaves of their own); a lone leaf is its group's root, a lone group's root is the
root; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.groups import in_groups, whole_groups
from riskloom.operators.ordering import global_row_number
from riskloom.session import ensure_checkpoint_dir, reliable_checkpoint, scratch_path

TILE = 12           # levels that one task builds above 2^TILE consecutive nodes
HOP = 4             # levels that one link spans
BROADCAST_BYTES = 8 << 20
WAY_BYTES = 4096    # of a way of at most 64 levels with its address and subroot
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
ADDRESS = ["tree", "grp", "level", "pos"]      # tree 0: inside a group; 1: over the groups
WAY = "array<struct<l:binary,r:binary>>"       # per level the sibling to the left or to the right, or none


# ---------------------------------------------------------------- leaves

def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def hex_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def numbered_leaves(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``rows`` (group, id, digest, ...) with grp, n and pos; (group, grp, n) of the groups; their number."""
    placed = global_row_number(rows, ["group", "id", "digest"]).df
    sizes = placed.groupBy("group").agg(F.min("_rn").alias("start"), F.count(F.lit(1)).alias("n"))
    ordered = global_row_number(sizes, ["group"])
    groups = reliable_checkpoint(ordered.df.select("group", "start", "n", (F.col("_rn") - 1).alias("grp")))
    of = groups.withColumnRenamed("group", "_group")
    size = groups.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col("group").cast("string")), F.lit(0)) + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        of = F.broadcast(of)
    leaves = (placed.join(of, F.col("group").eqNullSafe(F.col("_group")))
              .withColumn("pos", F.col("_rn") - F.col("start")).drop("_group", "_rn", "start"))
    return reliable_checkpoint(leaves), groups.select("group", "grp", "n"), ordered.total


# ---------------------------------------------------------------- building

def levels_above(digests: list[bytes]) -> list[list[bytes]]:
    """All levels of the tree over ``digests``, these first, the root last."""
    levels = [digests]
    while len(levels[-1]) > 1:
        low = [d.hex().encode() for d in levels[-1]]
        levels.append([hashlib.sha256(b"".join(low[k:k + 2])).digest() for k in range(0, len(low), 2)])
    return levels


def tile_rows(address: tuple[int, int, int, int], digests: list[bytes], whole: bool, tile: int, hop: int):
    """Link rows of one tile and the row of its root. ``address`` is that of the tile's first node; a tile that
    holds its whole level ends in the root of its tree."""
    tree, grp, level, first = address
    levels = levels_above(digests)
    while not whole and len(levels) <= tile:               # the last tile of many may be short
        levels.append([hashlib.sha256(levels[-1][0].hex().encode()).digest()])
    top = len(levels) - 1
    if not whole:
        root = (tree, grp, level + tile, first >> tile)
    elif tree == 0:
        root = (1, 0, 0, grp)
    else:
        root = (2, 0, 0, 0)
    for base in range(0, top, hop):
        up = min(base + hop, top)
        for k, digest in enumerate(levels[base]):
            way = []
            for at in range(base, up):
                p = k >> (at - base)
                other = levels[at][p ^ 1] if (p ^ 1) < len(levels[at]) else None
                way.append((other, None) if p & 1 else (None, other))
            to = root if up == top else (tree, grp, level + up, (first >> up) + (k >> hop))
            yield (tree, grp, level + base, (first >> base) + k, digest, way, *to)
    if not top:
        yield (*address, digests[0], [], *root)
    yield (*root, levels[-1][0], None, None, None, None, None)


NODE_SCHEMA = f"tree int, grp long, level int, pos long, digest binary, way {WAY}, up_tree int, up_grp long, up_level int, up_pos long"


def tiles(nodes: DataFrame, tile: int = TILE, hop: int = HOP) -> DataFrame:
    """One round: (tree, grp, level, pos, digest, n) of whole levels in, link rows and tile roots (``way`` null) out."""
    def run(batches):
        for t, edges in whole_groups(batches):
            grp, level, pos, n, tree = (t.column(c).to_numpy() for c in ("grp", "level", "pos", "n", "tree"))
            digest = t.column("digest").to_pylist()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                order = a + np.lexsort((pos[a:b], pos[a:b] >> tile, grp[a:b], tree[a:b]))
                name = np.stack([tree[order], grp[order], pos[order] >> tile])
                cuts = np.flatnonzero((name[:, 1:] != name[:, :-1]).any(0)) + 1          # keys are hashes: more than one tile may share one
                for some in np.split(order, cuts):
                    k = int(some[0])
                    address = (int(tree[k]), int(grp[k]), int(level[k]), int(pos[k]))
                    rows = list(tile_rows(address, [digest[i] for i in some.tolist()], int(n[k]) <= 1 << tile, tile, hop))
                    yield node_batch(rows)

    keyed = nodes.select(F.xxhash64("tree", "grp", F.shiftright("pos", tile)).alias("key"), "tree", "grp", "level", "pos", "digest", "n")
    return in_groups(keyed, "key").mapInArrow(run, NODE_SCHEMA)


def node_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    ways = [w or [] for w in cols[5]]
    steps = pa.StructArray.from_arrays([pa.array([s[i] for w in ways for s in w], pa.binary()) for i in (0, 1)], ["l", "r"])
    offsets = pa.array([None if w is None else o for w, o in zip([*cols[5], ()], np.cumsum([0, *map(len, ways)]).tolist(), strict=True)], pa.int32())
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    parts = [*(pa.array(c, k) for c, k in zip(cols[:4], kinds, strict=True)), pa.array(cols[4], pa.binary()),
             pa.ListArray.from_arrays(offsets, steps), *(pa.array(c, k) for c, k in zip(cols[6:], kinds, strict=True))]
    return pa.RecordBatch.from_arrays(parts, names=["tree", "grp", "level", "pos", "digest", "way", "up_tree", "up_grp", "up_level", "up_pos"])


@dataclass
class Manifest:
    leaves: DataFrame        # columns of the rows (group, id, digest, ...), grp, n, pos
    groups: DataFrame        # group, grp, n, subroot
    low: DataFrame           # link rows up to the first round's tile roots
    high: DataFrame          # link rows above them
    tops: DataFrame          # the first round's tile roots
    root: str | None         # hex; None of an empty table
    tile: int


def build(rows: DataFrame, folder: str, tile: int = TILE, hop: int = HOP) -> Manifest:
    """The manifest of rows (group, id, digest, ...); each round's nodes are written below ``folder``."""
    spark = rows.sparkSession
    leaves, groups, many = numbered_leaves(rows)
    most = leaves.agg(F.max("n")).first()[0] or 0
    written: list[DataFrame] = []

    def one_round(nodes: DataFrame) -> DataFrame:
        path = f"{folder}/nodes-{len(written)}"
        tiles(nodes, tile, hop).write.parquet(path)
        written.append(spark.read.parquet(path))
        return written[-1].filter("way IS NULL")

    def fewer(n, rounds: int):
        return F.shiftright(n + ((1 << tile * rounds) - 1), tile * rounds)

    roots = one_round(leaves.select(F.lit(0).alias("tree"), "grp", F.lit(0).alias("level"), "pos", "digest", "n"))
    ends, rounds = [roots.filter("tree = 1")], 1
    while most > 1 << tile * rounds:                             # groups with more than one node left
        above = groups.select("grp", fewer(F.col("n"), rounds).alias("n"))
        roots = one_round(roots.filter("tree = 0").join(above, "grp"))
        ends.append(roots.filter("tree = 1"))
        rounds += 1
    subroots = ends[0]
    for more in ends[1:]:
        subroots = subroots.unionByName(more)
    nodes, left = subroots, many
    while left:                                                  # the tree over the groups
        roots = one_round(nodes.withColumn("n", F.lit(left).cast("long")))
        nodes, left = roots, 0 if left <= 1 << tile else -(-left >> tile)
    top = written[-1].filter("tree = 2").select("digest").first()
    high = written[0].filter("1 = 0")
    for more in written[1:]:
        high = high.unionByName(more)
    named = groups.join(subroots.select(F.col("pos").alias("grp"), hex_text(F.col("digest")).alias("subroot")), "grp")
    return Manifest(leaves, named, written[0].filter("way IS NOT NULL"), high.filter("way IS NOT NULL"),
                    written[0].filter("way IS NULL").select(*ADDRESS, "digest"), top and bytes(top[0]).hex(), tile)


# ---------------------------------------------------------------- climbing

def folded(way: str, digest: str) -> str:
    """SQL: ``digest`` folded with the siblings of ``way``."""
    return (f"aggregate({way}, {digest}, (h, s) -> unhex(sha2(concat(coalesce(lower(hex(s.l)), ''), lower(hex(h)), "
            "coalesce(lower(hex(s.r)), '')), 256)))")


def appended(way: str, siblings: str) -> str:
    """SQL: ``siblings`` with those of ``way`` at the end."""
    return f"aggregate({way}, {siblings}, (p, s) -> concat(p, coalesce(s.l, X''), coalesce(s.r, X'')))"


def climb(start: DataFrame, links: DataFrame, keep: list[str], grow: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per start and node on its way up, as far as links lead: the node's address, the columns ``keep`` of the
    start (c) and those of ``grow``: name -> (SQL at the start, SQL after one link n)."""
    names = ", ".join([*ADDRESS, *keep, *grow])
    first = ", ".join([*ADDRESS, *keep, *(a for a, _ in grow.values())])
    after = ", ".join([*(f"n.up_{c}" for c in ADDRESS), *(f"c.{k}" for k in keep), *(b for _, b in grow.values())])
    return start.sparkSession.sql(f"""
        WITH RECURSIVE climb({names}) AS (
          SELECT {first} FROM {{start}}
          UNION ALL
          SELECT {after} FROM climb c JOIN {{links}} n
          ON n.tree = c.tree AND n.grp = c.grp AND n.level = c.level AND n.pos = c.pos)
        SELECT * FROM climb LIMIT ALL""", start=start, links=links)


def prove(m: Manifest, keep: list[str], digest: str = "digest") -> DataFrame:
    """Per leaf the columns ``keep``, its group's ``subroot``, ``siblings`` (binary: those on its way to the root, in
    order) and ``folded``: the digest in column ``digest`` folded with them up to the root (binary)."""
    start = m.leaves.select(F.lit(0).alias("tree"), "grp", F.lit(0).alias("level"), "pos",
                            F.col(digest).alias("_digest"), *keep)
    low = climb(start, m.low, keep, {"_digest": ("_digest", folded("n.way", "c._digest")),
                                                "_siblings": ("X''", appended("n.way", "c._siblings"))})
    low = low.filter(f"tree = 1 OR level = {m.tile}")
    tops = m.tops.select(*ADDRESS, *[F.col(c).alias(f"_{c}") for c in ADDRESS])
    high = climb(tops, m.high, [f"_{c}" for c in ADDRESS], {"_way": (f"CAST(array() AS {WAY})", "concat(c._way, n.way)")})
    ways = high.filter("tree = 2").select(*[F.col(f"_{c}").alias(c) for c in ADDRESS], "_way", F.expr("if(_tree = 1, _pos, _grp)").alias("_g"))
    ways = ways.join(m.groups.select(F.col("grp").alias("_g"), "subroot"), "_g").drop("_g")
    if m.tops.count() * WAY_BYTES <= BROADCAST_BYTES:
        ways = F.broadcast(ways)
    # else a shuffled join: a tile's root has as many leaves as a tile holds, so it has no hot key
    return (low.join(ways, ADDRESS)
            .select(*keep, "subroot", F.expr(appended("_way", "_siblings")).alias("siblings"), F.expr(folded("_way", "_digest")).alias("folded")))


# ---------------------------------------------------------------- the query

def op13_merkle(spark, sf_dir):
    """Proof and check of every document; n_chars of each seventh (by crc32 of the id) is tampered with."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.col("n_chars") + 1
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf_digest([F.col(c) for c in FIELDS]).alias("digest"),
                       F.when(tampered, leaf_digest([number if c == "n_chars" else F.col(c) for c in FIELDS])).alias("other"))
    rows = rows.withColumn("found", F.coalesce("other", "digest")).drop("other")
    m = build(reliable_checkpoint(rows), scratch_path(spark, f"merkle-{uuid.uuid4().hex}"))
    got = prove(m, ["id", "digest"], "found")
    folded_root = hex_text(F.col("folded"))
    return got.select(F.col("id").alias("doc_id"), hex_text(F.col("digest")).alias("leaf"), "subroot", F.lit(m.root).alias("root"),
                      F.sha2(hex_text(F.col("siblings")).cast("binary"), 256).alias("proof_sha256"), folded_root.alias("folded_root"),
                      (folded_root == F.lit(m.root)).alias("verified"))


_BIT = "xor(x >> 1, 3988292384 * (x & 1))"


def crc32_sql(text: str) -> str:
    """DuckDB SQL: unsigned crc32 of a short text's UTF-8 bytes, bit by bit."""
    step = "xor(c, b)"
    for _ in range(8):
        step = f"list_reduce([{step}, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    octets = f"list_transform(range(1, 1 + octet_length(encode({text}))), lambda k: CAST(('0x' || substr(hex(encode({text})), 2 * k - 1, 2)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: {step}), 4294967295)"


def _field_sql(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"


_LEAF = " || ".join(map(_field_sql, FIELDS))

#: DuckDB twin: levels by recursion over pairs, then every leaf climbs one level a step.
OP13_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN sha256({_LEAF.replace("n_chars", "(n_chars + 1)")}) END AS other
  FROM documents),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY lang) AS n,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM rows),
inner_levels AS (
  SELECT g, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(max(CASE WHEN pos % 2 = 0 THEN h END) || coalesce(max(CASE WHEN pos % 2 = 1 THEN h END), ''))
  FROM inner_levels WHERE n > 1 GROUP BY g, level, pos // 2, n),
outer_levels AS (
  SELECT level, g AS pos, (SELECT count(DISTINCT g) FROM leaves) AS n, h FROM (SELECT 0 AS level, g, h FROM inner_levels WHERE n = 1)
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(max(CASE WHEN pos % 2 = 0 THEN h END) || coalesce(max(CASE WHEN pos % 2 = 1 THEN h END), ''))
  FROM outer_levels WHERE n > 1 GROUP BY level, pos // 2, n),
nodes AS (
  SELECT 0 AS tree, g, level, pos, n, h FROM inner_levels WHERE n > 1
  UNION ALL SELECT 1, 0, level, pos, n, h FROM outer_levels WHERE n > 1),
climb AS (
  SELECT pos AS own_pos, 0 AS tree, g AS own, g, 0 AS level, pos, n, coalesce(other, leaf) AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT c.own_pos, CASE WHEN c.n > 1 THEN c.tree ELSE 1 END, c.own, CASE WHEN c.n > 1 THEN c.g ELSE 0 END,
         CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END, CASE WHEN c.n > 1 THEN c.pos // 2 ELSE c.own END,
         CASE WHEN c.n > 1 THEN (c.n + 1) // 2 ELSE (SELECT count(DISTINCT g) FROM leaves) END,
         CASE WHEN c.n = 1 THEN c.h WHEN c.pos % 2 = 0 THEN sha256(c.h || coalesce(s.h, '')) ELSE sha256(s.h || c.h) END,
         c.proof || coalesce(s.h, '')
  FROM climb c LEFT JOIN nodes s ON s.tree = c.tree AND s.g = c.g AND s.level = c.level AND s.pos = xor(c.pos, 1) AND c.n > 1
  WHERE c.n > 1 OR c.tree = 0),
root AS (SELECT h FROM outer_levels WHERE n = 1)
SELECT l.doc_id, l.leaf, t.h AS subroot, root.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = root.h AS verified
FROM leaves l JOIN climb c ON c.own = l.g AND c.own_pos = l.pos AND c.tree = 1 AND c.n = 1
JOIN inner_levels t ON t.g = l.g AND t.n = 1, root
"""
