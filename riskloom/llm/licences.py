"""Licence scan (operator 10): TF-IDF cosine to templates, then directory inheritance.

Native DataFrame expressions only.

1. Candidate texts are those with a licence word. Their sentences with such a word are
   headers; the whole text is a possible licence file.
2. Headers and whole texts are units; equal ones are judged once. A unit's vector holds
   tf * idf of its terms; idf = ln((1 + units) / (1 + df)) + 1 is counted over all units of
   the corpus for the templates' terms, and terms that no template has weigh as if df were 1.
3. A unit's licence is the template of the highest cosine, if that reaches
   ``HEADER_COSINE`` (a header) or ``FILE_COSINE`` (a whole text, or a file named like
   one). Cosines are rounded to 6 digits before they are compared. Whole texts are also
   judged against the full licence texts in ``licence_texts``, with an idf of their own;
   those of ``FULL_COSINE`` are licence files, and the higher cosine names the licence.
4. A file without a licence of its own inherits from the nearest ancestor directory that
   holds a licence file. Directories, not files, are joined to their ancestors; files join
   their directory's row. A directory that holds a third of all files is one row there.

Templates and their terms are fixed and few, so they are broadcast.

Defined results: a null text has no licence of its own but can inherit; a null path
inherits nothing; ties go to the template listed first, then to the smallest path; repeated
rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache, reduce
from importlib.resources import files as package_files
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import ensure_checkpoint_dir, reliable_checkpoint

HEADER_COSINE = 0.6
FILE_COSINE = 0.6
FULL_COSINE = 0.9           # licences of one family reach 0.7 to 0.9 of each other
TRIGGER = (r"(?i)licen[cs]|copyright|rights reserved|spdx|public domain|creative commons"
           r"|hereby granted|redistribution and use")          # every template has one of these
PLAIN_TRIGGERS = ["licen", "copyright", "rights reserved", "spdx", "public domain", "creative commons", "hereby granted",
                  "redistribution and use"]          # every match of TRIGGER holds one of these in lower case
HOT_SHARE = 64              # a unit with more than this part of all rows is dealt out this many times
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"

_FOLDER = package_files("riskloom.llm").joinpath("licence_texts")

#: (licence, text). Fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Released under the ISC License."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. No part may be reproduced without permission."),
]


@cache
def full_texts() -> list[tuple[str, str]]:
    """(licence, whole licence text), by name; read on the driver from the package. A file named ``-composed`` holds a
    text put together from another licence of its family and the licence's own clauses."""
    found = [(f.name.removesuffix(".txt").removesuffix("-composed"), f) for f in _FOLDER.iterdir() if f.name.endswith(".txt")]
    return [(name, f.read_text(encoding="utf-8")) for name, f in sorted(found, key=lambda x: x[0])]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.;!?])[\x20\x09-\x0D]+", "$1\n"), "\n")


def template_terms(spark, templates: list[tuple[str, str]]) -> DataFrame:
    """(place, licence, term, tf) of the fixed templates."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "place int, licence string, text string")
    return rows.select("place", "licence", F.explode(terms(F.col("text"))).alias("term")).groupBy("place", "licence", "term").agg(F.count("*").alias("tf"))


def unit_words(units: DataFrame) -> DataFrame:
    """(unit, whole, term, tf) of distinct units (unit, text, whole): read once, for both sets of templates."""
    words = units.select("unit", "whole", F.explode(terms(F.col("text"))).alias("term"))
    return reliable_checkpoint(words.groupBy("unit", "whole", "term").agg(F.count("*").alias("tf")))


def judge(words: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(unit, term, tf) in; (unit, licence, cosine) of the best template out, if any term is shared."""
    known = template_terms(words.sparkSession, templates)
    total = words.select("unit").distinct().count()
    vocabulary = known.select("term").distinct()
    rare = F.log(F.lit((1 + total) / 2.0)) + 1
    df = words.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("df"))
    idf = vocabulary.join(df, "term", "left").select(
        "term", (F.log(F.lit(1.0 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    idf = F.broadcast(reliable_checkpoint(idf))                       # one row per term of the templates
    weight = (F.col("tf") * F.coalesce("idf", rare)).alias("w")
    mine = words.join(idf, "term", "left").select("unit", "term", weight)
    theirs = known.join(idf, "term").select("place", "licence", "term", (F.col("tf") * F.col("idf")).alias("v"))
    length = theirs.groupBy("place").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("vn"))
    theirs = theirs.join(F.broadcast(length), "place").select("place", "licence", "term", (F.col("v") / F.col("vn")).alias("v"))
    by_term = theirs.groupBy("term").agg(F.collect_list(F.struct("place", "licence", "v")).alias("of"))    # at most one row a template
    # one pass a unit: its length over all terms, and its dot products with the templates
    dots = mine.join(F.broadcast(by_term), "term", "left").select(
        "unit", "w", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("place"), F.lit(None).cast("string").alias("licence"), F.col("w").alias("v"))),
                                        F.coalesce("of", F.expr("array()").cast("array<struct<place:int,licence:string,v:double>>")))).alias("t"))
    sums = dots.groupBy("unit", "t.place", "t.licence").agg(F.sum(F.col("w") * F.col("t.v")).alias("s"))
    # round, then the highest cosine, then the template listed first
    best = (sums.groupBy("unit").agg(F.max(F.when(F.col("place") < 0, F.col("s"))).alias("n2"),
                                     F.max(F.when(F.col("place") >= 0, F.struct(F.round("s", 9).alias("s"), (-F.col("place")).alias("first"), "licence"))).alias("b")))
    return best.filter("b IS NOT NULL").select("unit", F.col("b.licence").alias("licence"), F.round(F.col("b.s") / F.sqrt("n2"), 6).alias("cosine"))


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.regexp_replace(F.regexp_replace(path, r"/[^/]*$|^[^/]*$", ""), r"/+$", "")


def spread(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """``rows`` joined to their units' verdicts. Units that hold more than one row in ``HOT_SHARE`` (so fewer than that many
    units) are dealt out by the row's id, their verdicts repeated."""
    total = rows.count()
    hot = F.broadcast(reliable_checkpoint(
        rows.groupBy("unit").agg(F.count("*").alias("n")).filter(F.col("n") * HOT_SHARE > max(total, HOT_SHARE * HOT_SHARE)).select("unit", F.lit(True).alias("hot"))))
    deal = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "path"), F.lit(HOT_SHARE))).otherwise(F.lit(0).cast("long"))
    copies = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(HOT_SHARE - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left = rows.join(hot, "unit", "left").withColumn("deal", deal).drop("hot")
    right = judged.join(hot, "unit", "left").withColumn("deal", F.explode(copies)).drop("hot")
    return left.join(right, ["unit", "deal"]).drop("deal")


def scan(files: DataFrame, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per file: id, path, licence, how (header, file, inherited or none), cosine and licence_path. Files without
    a path (``path`` None or null) have directories neither to license nor to inherit from."""
    ensure_checkpoint_dir(files.sparkSession)
    path = F.lit(None).cast("string") if path is None else path.cast("string")
    rows = files.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).cast("string").alias("text"))
    named = F.coalesce(F.regexp_extract(F.col("path"), r"([^/]*)$", 1).rlike(FILE_NAME), F.lit(False))
    # plain searches in the lower-cased text (computed once) go before the pattern
    maybe = F.exists(F.array(F.lower("text")), lambda t: reduce(or_, [F.contains(t, F.lit(w)) for w in PLAIN_TRIGGERS]))
    found = reliable_checkpoint(rows.filter(maybe & F.col("text").rlike(TRIGGER))
                                .select("id", "path", "text", F.sha2("text", 256).alias("unit"), named.alias("named")))
    heads = found.select("id", "path", F.explode(F.filter(F.array_distinct(sentences(F.col("text"))), lambda s: s.rlike(TRIGGER))).alias("text"))
    heads = reliable_checkpoint(heads.withColumn("unit", F.sha2("text", 256)))
    texts = found.groupBy("unit").agg(F.first("text").alias("text"))
    units = (heads.select("unit", "text", F.lit(False).alias("whole")).unionByName(texts.select("unit", "text", F.lit(True).alias("whole")))
             .groupBy("unit").agg(F.first("text").alias("text"), F.max("whole").alias("whole")))
    words = unit_words(units)
    judged = reliable_checkpoint(judge(words, TEMPLATES))
    against_full = judge(words.filter("whole"), full_texts()).select("unit", F.struct("cosine", "licence").alias("full"))
    for_texts = reliable_checkpoint(judged.join(against_full, "unit", "full").filter(f"cosine >= {FILE_COSINE / 2} OR full.cosine >= {FULL_COSINE}"))

    # by name alone a file is decided only where no full text is nearer
    near = F.col("named") & (F.col("cosine") >= FILE_COSINE / 2) & (F.col("cosine") >= F.coalesce("full.cosine", F.lit(0.0)))
    line = F.when((F.col("cosine") >= FILE_COSINE) | near, F.struct("cosine", "licence"))
    full = F.when(F.col("full.cosine") >= FULL_COSINE, F.col("full"))
    whole = (spread(found.select("id", "path", "unit", "named"), for_texts)
             .withColumn("best", F.when(full["cosine"] >= F.coalesce(line["cosine"], F.lit(0.0)), full).otherwise(line)).filter("best IS NOT NULL")
             .select("id", "path", F.lit("file").alias("how"), "best.licence", "best.cosine"))
    header = (spread(heads.select("id", "path", "unit"), judged.filter(F.col("cosine") >= HEADER_COSINE))
              .select("id", "path", F.lit("header").alias("how"), "licence", "cosine"))
    rank = F.struct((F.col("how") == "file").cast("int").alias("file"), "cosine", F.col("licence"))
    own = reliable_checkpoint(whole.unionByName(header).groupBy("id", "path").agg(F.max(rank).alias("r"))
                              .select("id", "path", F.when(F.col("r.file") == 1, "file").otherwise("header").alias("how"), "r.licence", "r.cosine"))

    # one licence for each directory with a licence file: highest cosine, then smallest path
    order = F.struct((-F.col("cosine")).alias("far"), "path", "licence")
    granted = (own.filter("how = 'file' AND path IS NOT NULL").groupBy(parent(F.col("path")).alias("up")).agg(F.min(order).alias("g"))
               .select("up", F.col("g.licence").alias("g_licence"), F.col("g.path").alias("g_path"), (-F.col("g.far")).alias("g_cosine")))
    places = rows.filter("path IS NOT NULL").select(parent(F.col("path")).alias("dir")).distinct()
    steps = F.split("dir", "/")
    up = F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(
        k.alias("depth"), F.array_join(F.slice(F.split(F.col("dir"), "/"), F.lit(1), k), "/").alias("up"))))
    nearest = (places.select("dir", up.alias("a")).select("dir", "a.depth", "a.up").join(granted, "up")
               .groupBy("dir").agg(F.max(F.struct("depth", "g_licence", "g_path", "g_cosine")).alias("n"))
               .select("dir", "n.g_licence", "n.g_path", "n.g_cosine"))
    nearest = reliable_checkpoint(nearest)

    ids = rows.select("id", "path", parent(F.col("path")).alias("dir"))
    mine = own.select(F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("how").alias("_how"), F.col("licence").alias("_licence"), F.col("cosine").alias("_cosine"))
    both = (ids.join(mine, F.col("id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left")
            .join(nearest.withColumnRenamed("dir", "_dir"), F.col("dir") == F.col("_dir"), "left"))
    how = F.coalesce("_how", F.when(F.col("g_licence").isNotNull(), "inherited"), F.lit("none"))
    return both.select(F.col("id").alias(id_col), "path", F.coalesce("_licence", "g_licence").alias("licence"), how.alias("how"),
                       F.coalesce("_cosine", "g_cosine").alias("cosine"),
                       F.when(F.col("_licence").isNotNull(), F.col("path")).otherwise(F.col("g_path")).alias("licence_path"))


def document_path() -> Column:
    """Where a document lies: source / language / id, as in a crawl's folders. The tables name no other place."""
    return F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), F.col("doc_id").cast("string"))


def op10_licences(spark, sf_dir):
    """Licences of the documents' own texts; the others inherit that of the nearest directory (``how`` tells which)."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), document_path())


_ROWS = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))


def _judge_sql(p: str, words: str, templates: str) -> str:
    """CTEs, named with prefix ``p``, up to {p}judged (unit, licence, cosine): ``judge`` of the words in CTE ``words``."""
    return rf"""
{p}total AS (SELECT count(DISTINCT unit) AS n FROM {words}),
{p}known AS (SELECT place, licence, term, count(*) AS tf FROM (
  SELECT place, licence, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM {templates}) GROUP BY ALL),
{p}vocabulary AS (SELECT DISTINCT term FROM {p}known),
{p}df AS (SELECT term, count(*) AS df FROM {words} JOIN {p}vocabulary USING (term) GROUP BY term),
{p}idf AS (SELECT term, ln((1.0 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM {p}vocabulary LEFT JOIN {p}df USING (term), {p}total),
{p}mine AS (SELECT unit, term, tf * coalesce(idf, ln((1 + n) / 2.0) + 1) AS w FROM {words} LEFT JOIN {p}idf USING (term), {p}total),
{p}theirs AS (SELECT place, licence, term, tf * idf AS v FROM {p}known JOIN {p}idf USING (term)),
{p}size AS (SELECT place, sqrt(sum(v * v)) AS vn FROM {p}theirs GROUP BY place),
{p}dots AS (SELECT unit, place, licence, round(sum(w * v / vn), 9) AS s FROM {p}mine JOIN {p}theirs USING (term) JOIN {p}size USING (place) GROUP BY ALL),
{p}norm AS (SELECT unit, sum(w * w) AS n2 FROM {p}mine GROUP BY unit),
{p}judged AS (SELECT unit, licence, round(s / sqrt(n2), 6) AS cosine FROM (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY s DESC, place) AS k FROM {p}dots) JOIN {p}norm USING (unit) WHERE k = 1)"""


#: DuckDB twin of the query; the full texts are read from the package's folder.
OP10_SQL = rf"""
WITH docs AS (SELECT doc_id AS id, concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'und'), CAST(doc_id AS VARCHAR)) AS path, text
              FROM documents),
found AS (SELECT * FROM docs WHERE regexp_matches(text, '{TRIGGER}')),
heads AS (SELECT DISTINCT id, path, unit FROM (
  SELECT id, path, unnest(string_split(regexp_replace(text, '([.;!?])[ 	-
]+', '' || chr(10), 'g'), chr(10))) AS unit FROM found)
  WHERE regexp_matches(unit, '{TRIGGER}')),
units AS (SELECT unit FROM heads UNION SELECT text FROM found),
words AS MATERIALIZED (SELECT unit, term, count(*) AS tf FROM (
  SELECT unit, unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM units) GROUP BY ALL),
full_words AS MATERIALIZED (SELECT * FROM words WHERE unit IN (SELECT text FROM found)),
templates(place, licence, text) AS (VALUES {_ROWS}),
full_templates AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY name) AS place, name AS licence, text FROM (
    SELECT regexp_extract(filename, '([^/]*?)(-composed)?\.txt$', 1) AS name, content AS text FROM read_text('{_FOLDER}/*.txt'))),{_judge_sql("line_", "words", "templates")},{_judge_sql("full_", "full_words", "full_templates")},
files AS (
  SELECT f.id, f.path, l.licence AS line_licence, CASE WHEN l.cosine >= {FILE_COSINE} THEN l.cosine END AS line,
         u.licence AS full_licence, CASE WHEN u.cosine >= {FULL_COSINE} THEN u.cosine END AS full_cosine
  FROM found f LEFT JOIN line_judged l ON l.unit = f.text LEFT JOIN full_judged u ON u.unit = f.text),
both_kinds AS (
  SELECT id, path, 1 AS file, CASE WHEN full_cosine >= coalesce(line, 0) THEN full_licence ELSE line_licence END AS licence,
         CASE WHEN full_cosine >= coalesce(line, 0) THEN full_cosine ELSE line END AS cosine
  FROM files WHERE line IS NOT NULL OR full_cosine IS NOT NULL
  UNION ALL SELECT id, path, 0, licence, cosine FROM heads JOIN line_judged USING (unit) WHERE cosine >= {HEADER_COSINE}),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, path ORDER BY file DESC, cosine DESC, licence DESC) AS k FROM both_kinds) WHERE k = 1),
granted AS (SELECT * FROM (
  SELECT regexp_replace(path, '/[^/]*$', '') AS up, licence, path, cosine,
         row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY cosine DESC, path, licence) AS k
  FROM own WHERE file = 1) WHERE k = 1),
places AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM docs),
steps AS (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS depth FROM places),
nearest AS (SELECT * FROM (
  SELECT dir, granted.licence, granted.path, granted.cosine, row_number() OVER (PARTITION BY dir ORDER BY depth DESC) AS k
  FROM steps JOIN granted ON granted.up = array_to_string(string_split(dir, '/')[1:depth], '/')) WHERE k = 1)
SELECT d.id AS doc_id, d.path, coalesce(o.licence, n.licence) AS licence,
       CASE WHEN o.file = 1 THEN 'file' WHEN o.file = 0 THEN 'header' WHEN n.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       coalesce(o.cosine, n.cosine) AS cosine, CASE WHEN o.licence IS NOT NULL THEN d.path ELSE n.path END AS licence_path
FROM docs d LEFT JOIN own o ON o.id IS NOT DISTINCT FROM d.id AND o.path = d.path
LEFT JOIN nearest n ON n.dir = regexp_replace(d.path, '/[^/]*$', '')
"""
