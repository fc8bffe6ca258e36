"""Spelling variants by asymmetric q-chunks (operator 11).

1. Words are counted over all texts: one narrow pass with partial sums before the shuffle.
2. Two words are near if one inserted, deleted or replaced character makes them equal. Of
   such a pair the shorter word (ties: the smaller) gives its two disjoint chunks of half
   its length q, at places 0 and q; the other gives all its positional grams of that
   length. One edit leaves one of the two chunks whole, at its place or one further on,
   so a join on (gram, place) with the chunk's place shifted by 0 or 1 misses no pair;
   every candidate is verified by its edit distance.
3. A gram at a place with more than ``HOT`` squared candidates is split: its rows carry in
   addition the word without that gram and each form of it with one character less. Two
   words that share the gram and are one edit apart share such a form, and the rows are
   linear in the group, so no group is ever compared word by word.
4. A word's form is its near word of the highest count, if that is ``RATIO`` times its
   own. Counts grow by that factor from form to form, so a few doublings of the chain
   lead every word to its root.

Defined results: null and empty texts have no words; repeated rows count again; a null id
is written as an empty text in the key of a deletion; ties go to the word first in
code-point order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import ensure_checkpoint_dir, reliable_checkpoint

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
HOT = 256
DELETES = 199           # the query's rule: where it divides the crc32 of id and run, one character goes


def runs_of(text: Column) -> Column:
    """The runs of letters of a text, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), F.lit(0))


def word_counts(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the rows of column ``word`` that are long and frequent enough."""
    return (words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= least_count))


# ---------------------------------------------------------------- near words

def chunk_rows(words: DataFrame) -> DataFrame:
    """(gram, place, word) of the shorter side: two chunks, each where it lies and one further on."""
    half = F.floor(F.length("word") / 2).cast("int")
    places = F.array(F.lit(0), F.lit(1), half, half + 1)
    cut = F.transform(places, lambda p: F.struct(F.substring("word", F.when(p <= 1, F.lit(1)).otherwise(half + 1), half).alias("gram"), p.alias("place")))
    return words.select("word", F.explode(F.array_distinct(cut)).alias("c")).select("c.gram", "c.place", "word")


def gram_rows(words: DataFrame) -> DataFrame:
    """(gram, place, word) of the longer side: all grams of half its own length and of half that of a word one shorter."""
    n = F.length("word")
    sizes = F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")))
    grams = F.flatten(F.transform(sizes, lambda q: F.transform(
        F.sequence(F.lit(0), n - q), lambda p: F.struct(F.substring(F.col("word"), p + 1, q).alias("gram"), p.alias("place")))))
    return words.select("word", F.explode(grams).alias("c")).select("c.gram", "c.place", "word")


def rest_forms() -> Column:
    """The word around its gram at place ``at``, whole and with each one character less; the gap keeps its place."""
    place = F.col("at")
    before = F.substring(F.col("word"), F.lit(1), place)
    after = F.substring(F.col("word"), place + F.length("gram") + 1, F.length("word"))
    rest = F.concat(before, F.lit("\u0000"), after)
    shorter = F.transform(F.filter(F.sequence(F.lit(1), F.length(rest)), lambda k: k != place + 1),
                          lambda k: F.concat(F.substring(rest, F.lit(1), k - 1), F.substring(rest, k + 1, F.length(rest))))
    return F.array_distinct(F.array_append(shorter, rest))


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) once per pair of distinct words of column ``word`` that are one edit apart; a is shorter, or equally long and smaller."""
    ensure_checkpoint_dir(words.sparkSession)
    words = words.select("word")
    # ``at``: where the gram lies in this very word (a chunk is also offered one place further on)
    chunks = chunk_rows(words).withColumn("at", F.when(F.col("place") <= 1, F.lit(0)).otherwise(F.floor(F.length("word") / 2).cast("int")))
    grams = gram_rows(words).withColumn("at", F.col("place"))
    key = ["gram", "place"]
    sides = chunks.select(*key, F.lit(1).alias("c"), F.lit(0).alias("g")).unionByName(grams.select(*key, F.lit(0).alias("c"), F.lit(1).alias("g")))
    sizes = sides.groupBy(*key).agg(F.sum("c").alias("c"), F.sum("g").alias("g"))
    crowded = reliable_checkpoint(sizes.filter(F.col("c") * F.col("g") > hot * hot).select(*key, F.lit(True).alias("crowded")))

    def keyed(rows: DataFrame) -> DataFrame:
        marked = rows.join(crowded, key, "left")
        finer = F.when(F.col("crowded"), rest_forms()).otherwise(F.array(F.lit("")))
        return marked.select(*key, "word", F.explode(finer).alias("rest"))

    a, b = keyed(chunks).withColumnRenamed("word", "a"), keyed(grams).withColumnRenamed("word", "b")
    longer = F.length("b") - F.length("a")
    ordered = (longer == 1) | ((longer == 0) & (F.col("a") < F.col("b")))
    found = a.join(b, [*key, "rest"]).filter(ordered & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "b").distinct()


# ---------------------------------------------------------------- forms and roots

def variants(counts: DataFrame, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """Per row of (word, n): word, form, root, n, n_near, form_n."""
    counts = reliable_checkpoint(counts.select("word", "n"))
    pairs = reliable_checkpoint(near_pairs(counts, hot))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    known = both.join(counts.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = known.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("b"))
    fits = -F.col("b.less") >= ratio * F.col("n")
    formed = reliable_checkpoint(
        counts.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("b.other")).alias("form"),
            F.when(fits, -F.col("b.less")).alias("form_n")))
    # counts grow ``ratio`` times a step, so chains are short; each round doubles the way
    low, high = formed.filter("form IS NOT NULL").agg(F.min("n"), F.max("form_n")).first()
    steps = math.ceil(math.log(high / low, ratio) + 1e-9) if high else 0
    jump = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("to"))
    for _ in range(math.ceil(math.log2(steps)) if steps else 0):
        further = jump.select(F.col("word").alias("to"), F.col("to").alias("next"))
        jump = reliable_checkpoint(jump.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to")))
    return (formed.join(jump, "word", "left")
            .select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n"))


# ---------------------------------------------------------------- the query

def op11_spelling(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"),
                       F.explode(runs_of(F.col("text").cast("string"))).alias("run"))
    h = F.crc32(F.concat("id", "run").cast("binary"))
    at = F.pmod(h, F.length("run").cast("long")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return variants(word_counts(runs.select(F.when(h % DELETES == 0, short).otherwise(F.col("run")).alias("word"))))


#: DuckDB twin: near words by one-character deletions.
OP11_SQL = f"""
WITH RECURSIVE octets AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM range(256) r(i))),
runs AS MATERIALIZED (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(key))),
    lambda j: CAST('0x' || substr(hex(encode(key)), 2 * j + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM runs, octets),
counts AS MATERIALIZED (
  SELECT CASE WHEN h % {DELETES} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST_LENGTH} AND sum(hashed.n) >= {LEAST_COUNT}),
less AS MATERIALIZED (
  SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS v FROM counts, LATERAL (SELECT unnest(range(1, 1 + length(word))) AS k)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.v = b.v AND a.k = b.k AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT less.word, counts.word FROM less JOIN counts ON counts.word = less.v
  UNION SELECT counts.word, less.word FROM less JOIN counts ON counts.word = less.v),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-m.n, other)) AS other, max(m.n) AS m
  FROM near JOIN counts m ON m.word = near.other GROUP BY near.word),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN other END AS form, CASE WHEN m >= {RATIO} * n THEN m END AS form_n
  FROM counts LEFT JOIN best USING (word)),
follow AS (
  SELECT word, word AS last, 0 AS k FROM formed
  UNION ALL SELECT f.word, g.form, k + 1 FROM follow f JOIN formed g ON g.word = f.last WHERE g.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(last, k) AS root FROM follow GROUP BY word) USING (word)
"""
