"""Mixing sources to target weights by entropy balancing (operator 8).

Native DataFrame expressions only. The mix is the reweighting of the documents
that is closest in relative entropy (over words) to taking each document once and
meets one word constraint per source. Its dual is convex and separable: for a
source with S words and target T it is S * exp(l) - l * T, so the Newton steps
l <- l - (S * exp(l) - T) / (S * exp(l)) of all sources run side by side on Spark,
and each document's rate is exp(l) of its source, at most ``cap``.

Rates become whole copies: every document gets floor(rate); of the rest, documents
in the order of a hash get one more copy as long as the source's target allows it
(first the few that are large for their source, so that the others even them out).
The cut is found by summing words per hash digit, 12 bits at a time, so no source
is ever sorted or held by one task, and what is left is filled by one more copy of the
best-fitting single documents, ``FILL_ROUNDS`` times.

Defined results: null text has size 0 and takes 0 words; a null source is a source
of its own, ordered last; sources without words have target 0; an empty table gives
an empty result; rows that repeat id and text share one decision; extra columns are
kept by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import ensure_checkpoint_dir, reliable_checkpoint

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5                # the mix holds this many times the words of the corpus
CAP = 2.0                  # no source or document more often than this
NEWTON_STEPS = 64
DIGIT_BITS = 12
DIGITS = 2
FILL_ROUNDS = 4
GIANT = 50                 # a document of more than 1 / GIANT of its source is decided before the others
PICKS = GIANT + FILL_ROUNDS
BROADCAST_ROWS = 50_000     # rows of at most a name and eight numbers


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (0 first) by code point, null last. Ranges, then positions within each."""
    spark = sources.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    parts = reliable_checkpoint(sources.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    before = (parts.groupBy("part").count()
              .withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
              .select(F.col("part"), F.coalesce("before", F.lit(0)).alias("before")))    # one row per partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return (parts.withColumn("place", place).join(before, "part")
            .select("source", "source_size", (F.col("before") + F.col("place") - 1).alias("rank")))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``weight`` and ``target``: shares by weight, none above cap times its source, excess reshared."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = reliable_checkpoint(ranked(sources).withColumn("weight", w))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    limit = cap * F.col("source_size")
    level, capped = 0.0, -1
    while True:      # the level only rises, and a source once full stays full
        full = limit < F.col("weight") * level if capped >= 0 else F.lit(False)
        got = table.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
                        F.count_if(full)).first()
        if got[2] == capped or not got[1]:
            break
        capped = got[2]
        level = (share * total - got[0]) / got[1]
    return table.withColumn("target", F.least(limit, F.col("weight") * level))


def newton_rates(table: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds ``rate`` = exp(dual) by Newton steps on the separable dual, at most ``cap``."""
    ratio = F.col("target") / F.col("source_size")
    dual = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0),
                       lambda l, _: l - (F.exp(l) - F.col("ratio")) / F.exp(l))
    return (table.withColumn("ratio", F.when(F.col("source_size") > 0, ratio))
            .withColumn("rate", F.when(F.col("ratio") > 0, F.least(F.lit(cap), F.exp(dual))).otherwise(0.0))
            .drop("ratio"))


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """(size, key): words of the text and the hash that orders the documents of a source."""
    return [words(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col), F.col(source_col)).alias("key")]


def ordinary() -> Column:
    return F.col("size") * GIANT <= F.col("source_size")


def small(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose counted rows are few; else let the join shuffle."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def on_source(left: DataFrame, right: DataFrame, rows: int, how: str = "inner") -> DataFrame:
    """Join on ``source``, nulls equal."""
    named = right.withColumnRenamed("source", "_source")
    return left.join(small(named, rows), F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def decide(base: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, DataFrame, int]:
    """From (source, size, key) rows: the table of sources (source_size, target, rate, whole, cut), the
    single picks (source, key) beside the cut, and the number of sources."""
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = newton_rates(targets(sizes, weights, share, cap), cap)
    whole = F.floor("rate")
    table = reliable_checkpoint(table.withColumn("whole", whole).withColumn("left", F.col("target") - whole * F.col("source_size")))
    n = table.count()
    filled_in = on_source(base.filter("size > 0"), table.select("source", "source_size", "whole", "left"), n)

    # documents of more than 1 / GIANT of their source, fewer than GIANT a source: their part of the words, by hash
    order = Window.partitionBy("source").orderBy("key")
    part = F.col("left") / F.col("source_size") * F.sum("size").over(Window.partitionBy("source"))
    picks = (filled_in.filter(~ordinary()).withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("part", part).filter((F.col("upto") - F.col("size") / 2 <= F.col("part")) & (F.col("upto") <= F.col("left")))
             .groupBy("source", "key").agg(F.sum("size").alias("words")))
    picks = reliable_checkpoint(picks)
    rows = filled_in.filter(ordinary())

    # the hash value up to which the rest of each source's words are used up, 12 bits at a time
    state = on_source(table.select("source", "left"), picks.groupBy("source").agg(F.sum("words").alias("used")), n, "left").select(
        "source", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"), F.lit(0).cast("long").alias("cut"))
    top = F.lit(0).cast("long")
    for level in range(DIGITS):
        here = on_source(rows.drop("left"), state, n).filter(top == F.col("cut"))
        top = F.shiftrightunsigned("key", 64 - DIGIT_BITS * (level + 1))
        sums = here.groupBy("source", top.alias("top")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("top"))      # 2^12 rows a source at most
        over = F.when(F.col("upto") > F.col("left"), F.struct("top", (F.col("upto") - F.col("words")).alias("used")))
        cuts = (sums.withColumn("upto", upto).groupBy("source")
                .agg(F.min(over).alias("x"), F.max("top").alias("last"), F.max("upto").alias("every")))
        cuts = cuts.select("source", F.coalesce("x.top", F.col("last") + 1).alias("at"), F.coalesce("x.used", "every").alias("used"))
        state = reliable_checkpoint(
            on_source(state, cuts, n, "left")
            .select("source", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
                    F.coalesce("at", F.shiftleft("cut", DIGIT_BITS)).alias("cut")))

    # what is left goes to the best-fitting documents that may have one more copy; rows of one key stand or fall together
    below = ordinary() & (top < F.col("cut"))
    rest = reliable_checkpoint(on_source(filled_in.drop("left"), state.select("source", "cut"), n)
                               .filter(F.col("whole") + below.cast("int") < int(cap))
                               .groupBy("source", "key").agg(F.sum("size").alias("words")))
    giants = picks.groupBy("source").agg(F.sum("words").alias("before"))
    start = reliable_checkpoint(on_source(state, giants, n, "left").select("source", (F.col("left") + F.coalesce("before", F.lit(0))).alias("left")))
    for k in range(FILL_ROUNDS):
        used = picks.groupBy("source").agg(F.sum("words").alias("used"))
        room = on_source(start, used, n, "left").select("source", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"))
        taken = picks.select(F.col("source").alias("_source"), F.col("key").alias("_key"))
        free = rest.join(small(taken, n * PICKS), F.col("source").eqNullSafe(F.col("_source")) & (F.col("key") == F.col("_key")), "left_anti")
        near = F.struct(F.abs(F.col("words") - F.col("left")).alias("off"), "words", "key")
        best = (on_source(free, room, n)      # the last one may pass the target if that is nearer
                .filter(F.col("words") <= F.col("left") * (1 if k < FILL_ROUNDS - 1 else 2))
                .groupBy("source").agg(F.min(near).alias("p")).select("source", "p.key", "p.words"))
        picks = reliable_checkpoint(picks.unionByName(best))
    return on_source(table.drop("left"), state.select("source", "cut"), n), picks, n


def with_copies(rows: DataFrame, decided: tuple[DataFrame, DataFrame, int], cap: float = CAP) -> DataFrame:
    """Adds source_size, target, rate and copies to rows that have source, size and key."""
    table, picks, n = decided
    chosen = small(picks.select(F.col("source").alias("_source"), F.col("key").alias("_key"), F.lit(True).alias("_pick")), n * PICKS)
    both = (on_source(rows, table, n, "left")
            .join(chosen, F.col("source").eqNullSafe(F.col("_source")) & (F.col("key") == F.col("_key")), "left"))
    below = ordinary() & (F.shiftrightunsigned("key", 64 - DIGIT_BITS * DIGITS) < F.col("cut"))
    total = F.col("whole") + below.cast("int") + F.coalesce("_pick", F.lit(False)).cast("int")
    copies = F.when(F.col("size") > 0, F.least(total, F.lit(int(cap)))).otherwise(0)
    return both.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("int")).drop("_source", "_key", "_pick", "whole", "cut", "weight", "rank")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per document: id, size, source_size, target, taken, copies and rate."""
    ensure_checkpoint_dir(docs.sparkSession)
    base = reliable_checkpoint(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                           *keyed(docs, id_col, text_col, source_col)))
    out = with_copies(base, decide(base.drop("id"), weights, share, cap), cap)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target",
                      (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix itself: all columns of ``docs``, each row as often as it has copies."""
    ensure_checkpoint_dir(docs.sparkSession)
    cols = [F.col(source_col).cast("string").alias("source"), *keyed(docs, id_col, text_col, source_col)]
    decided = decide(reliable_checkpoint(docs.select(*cols)), weights, share, cap)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    out = with_copies(docs.select(row, *cols), decided, cap)
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def op8_mixing(spark, sf_dir):
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
