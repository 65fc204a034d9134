"""Licence scan: sparse TF-IDF cosine of lines to templates, then inheritance from the nearest directory above.

DataFrame operations only. Lines and paragraphs of whole texts become token counts; weights are tf x idf, with idf over the
templates (a token that no template has weighs like one that no document has). The cosine of a
line is at most the norm of the template over the tokens that both have. That bound is taken first for whole texts, whose
tokens include those of all their lines, then for the lines of the texts that are left; only lines for which it reaches
the threshold for some template are counted. Neither step loses a line.
The product with the template matrix is a join on tokens. A file with a licence of its own keeps it; others take that
of the nearest directory above them whose licence files state one.

Defined results: null and empty texts state nothing; equal scores go to the licence that sorts first; a directory
takes the licence that most of its licence files state, then the highest score, then the first by name; null paths
inherit nothing; repeated rows are decided alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import stored

#: Least cosine at which a line states a licence.
THRESHOLD = 0.75

#: Words of the templates that ordinary text is full of; the search for lines does without them where it can.
COMMON = frozenset(
    "a an and any are as available be by can charge code conditions either except file following for form forms free from general in into is it "
    "made may modify not obtaining of or person program provided published subject terms that the this to under use version with without work you "
    "mit person public source".split()
)

#: Usual wordings of public licences (SPDX names).
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("EPL-2.0", "Licensed under the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("none-granted", "All rights reserved."),
)


def tokens_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


class Weights:
    """The template matrix; as large as the list of templates."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        counts = [Counter(tokens_of(text)) for _, text in templates]
        seen = Counter(t for c in counts for t in c)
        self.unseen = math.log(1 + len(templates)) + 1
        self.idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in seen.items()}
        self.rows, self.needed, self.reach = [], set(), []
        #: scores are rounded to six digits before they are compared
        self.least = (threshold - 1e-6) ** 2
        for (name, text), c in zip(templates, counts, strict=True):
            weight = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(w * w for w in weight.values()))
            self.rows += [(text, name, t, w / norm, self.idf[t]) for t, w in weight.items()]
            self.reach.append({t: (w / norm) ** 2 for t, w in weight.items()})
            # tokens from the commonest on are spared as long as they alone can't reach the threshold
            left = self.least * norm**2
            for t in sorted(weight, key=lambda t: (t not in COMMON, len(t) > 2, self.idf[t], t)):
                left -= weight[t] ** 2
                if left <= 0:
                    self.needed.add(t)

    def may_reach(self, text: Column) -> Column:
        """Whether the bound for some template reaches the threshold, by the distinct tokens of templates that a text holds."""
        vocabulary = sorted(self.idf)
        at = {t: i for i, t in enumerate(vocabulary)}
        shares = F.array(*[F.array(*[F.lit(r.get(t, 0.0)) for t in vocabulary]) for r in self.reach])
        index = F.create_map(*[F.lit(x) for t in vocabulary for x in (t, at[t])])
        needed = F.array(*[F.lit(t) for t in sorted(self.needed)])
        reaches = lambda places: F.exists(shares, lambda row: F.aggregate(places, F.lit(0.0), lambda total, i: total + F.get(row, i)) >= self.least - 1e-12)

        def held(tokens: Column) -> Column:
            places = F.transform(F.array_intersect(tokens, F.array(*[F.lit(t) for t in vocabulary])), lambda t: F.element_at(index, t))
            return F.arrays_overlap(tokens, needed) & F.exists(F.array(places), reaches)

        # an element of an array is computed once, where a column inside a lambda would be for every use
        return F.exists(F.array(F.split(F.lower(text), "[^a-z0-9]+")), held)


def stated(files: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """file, licence, score (six digits), outer (it stands in the first or last line) of the files that state a licence. `file` names rows."""
    w = Weights(templates, threshold)
    matrix = files.sparkSession.createDataFrame(w.rows, "template string, licence string, token string, share double, idf double")
    cut = F.split(F.col(text), r"\r\n|\r|\n")
    lines = F.transform(cut, lambda x, i: F.struct(x.alias("line"), i.alias("at"), ((i == 0) | (i == F.size(cut) - 1)).alias("outer")))
    parts = F.transform(F.split(F.col(text), r"\n\s*\n"), lambda x: F.struct(x.alias("line"), F.lit(-1).alias("at"), F.lit(False).alias("outer")))
    some = files.filter(w.may_reach(F.col(text))).select("file", F.explode(F.concat(lines, F.filter(parts, lambda p: F.instr(p["line"], "\n") > 0))).alias("l")).select("file", "l.line", "l.at", "l.outer").filter(w.may_reach(F.col("line")))
    some = some.withColumn("tokens", F.regexp_extract_all(F.lower("line"), F.lit("([a-z0-9]+)"), 1))
    bags = some.select("file", "at", "outer", F.xxhash64("line").alias("part"), F.explode("tokens").alias("token"))
    counts = bags.groupBy("file", "at", "outer", "part", "token").agg(F.count("*").alias("tf"))
    idf = matrix.select("token", "idf").distinct()
    weighed = stored(counts.join(F.broadcast(idf), "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(w.unseen))).select("file", "at", "outer", "part", "token", "w"))
    norms = weighed.groupBy("file", "at", "outer", "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    products = weighed.join(F.broadcast(matrix.drop("idf")), "token").groupBy("file", "at", "outer", "part", "licence", "template").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    scores = products.join(norms, ["file", "at", "outer", "part"]).select("file", "at", "outer", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= threshold)
    best = scores.groupBy("file", "licence").agg(F.max("score").alias("score"), F.max("outer").alias("outer"))
    return best.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("back"), "licence", "outer")).alias("m")).select("file", "m.licence", (-F.col("m.back")).alias("score"), "m.outer")


def directory_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(files: DataFrame, licence_file: Column | None = None, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """path, own_licence, own_score, licence, licence_dir for each file (`file` unique, `path`, text).

    licence_file: whether a file speaks for its directory, over `path` and `outer`; by default by its name.
    """
    if licence_file is None:
        licence_file = F.col("path").rlike(r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$")
    own = stored(stated(files, text, templates, threshold))
    named = stored(files.select("file", "path").join(own, "file", "left").withColumn("dir", directory_of(F.col("path"))))
    speaks = named.filter(F.col("licence").isNotNull() & licence_file).groupBy("dir", "licence").agg(F.count("*").alias("n"), F.max("score").alias("score"))
    of_dir = speaks.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("s"), "licence")).alias("m")).select(F.col("dir").alias("up"), F.col("m.licence").alias("dir_licence"))
    parts = F.split("dir", "/")
    above = named.filter("dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    above = above.withColumn("up", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/")).join(of_dir, "up")
    nearest = above.groupBy("dir").agg(F.max(F.struct("depth", "up", "dir_licence")).alias("m")).select("dir", F.col("m.up").alias("up"), F.col("m.dir_licence").alias("dir_licence"))
    out = named.join(nearest, "dir", "left")
    return out.select("file", "path", F.col("licence").alias("own_licence"), F.col("score").alias("own_score"), F.coalesce("licence", "dir_licence").alias("licence"),
                      F.when(F.col("licence").isNull(), F.col("up")).alias("licence_dir"))


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files: each source is a directory, with one below it for each language but English."""
    folder = F.when(F.col("lang") == "en", F.col("source")).otherwise(F.concat_ws("/", "source", F.coalesce("lang", F.lit("und"))))
    return docs.select(F.col("doc_id").alias("file"), F.concat_ws("/", folder, F.col("doc_id").cast("string")).alias("path"), "text")


def documents_licences(docs: DataFrame) -> DataFrame:
    """doc_id and the scan of the tree; documents that open or end with a licence line speak for their directory."""
    return scan(documents_as_files(docs), F.col("outer")).withColumnRenamed("file", "doc_id")


def sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan for documents in SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = ", ".join(f"({i}, {quote(n)}, {quote(t)})" for i, (n, t) in enumerate(templates))
    words = "regexp_extract_all(lower({}), '[a-z0-9]+')"
    return rf"""
WITH t(k, licence, template) AS (VALUES {listed}
), tt AS (SELECT k, licence, token, count(*) AS tf FROM (SELECT k, licence, unnest({words.format("template")}) AS token FROM t) GROUP BY ALL
), idf AS (SELECT token, ln((1.0 + {len(templates)}) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY token
), tw AS (SELECT k, licence, token, tf * idf AS w FROM tt JOIN idf USING (token)
), tn AS (SELECT k, sqrt(sum(w * w)) AS norm FROM tw GROUP BY k
), lines AS (
  SELECT doc_id, line, no, no = 0 OR no = n - 1 AS outside FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no, len(string_split(text, chr(10))) AS n FROM documents)
), bag AS (
  SELECT doc_id, no, outside, token, count(*) AS tf FROM (SELECT doc_id, no, outside, unnest({words.format("line")}) AS token FROM lines) GROUP BY ALL
), bw AS (SELECT doc_id, no, outside, bag.token, tf * coalesce(idf, ln(1.0 + {len(templates)}) + 1) AS w FROM bag LEFT JOIN idf ON idf.token = bag.token
), bn AS (SELECT doc_id, no, sqrt(sum(w * w)) AS norm FROM bw GROUP BY ALL
), score AS (
  SELECT doc_id, no, outside, licence, round(sum(bw.w * tw.w / tn.norm) / any_value(bn.norm), 6) AS score
  FROM bw JOIN tw USING (token) JOIN tn USING (k) JOIN bn USING (doc_id, no) GROUP BY doc_id, no, outside, licence, k
), own AS (
  SELECT doc_id, licence, score, outside FROM (
    SELECT doc_id, licence, max(score) AS score, bool_or(outside) AS outside FROM score WHERE score >= {threshold} GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1
), f AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE concat_ws('/', source, coalesce(lang, 'und')) END AS dir FROM documents
), nf AS (SELECT f.doc_id, dir, licence, score, outside FROM f LEFT JOIN own ON own.doc_id = f.doc_id
), said AS (
  SELECT dir, licence FROM (SELECT dir, licence, count(*) AS n, max(score) AS s FROM nf WHERE outside GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, s DESC, licence) = 1
)
SELECT nf.doc_id, concat_ws('/', nf.dir, CAST(nf.doc_id AS VARCHAR)) AS path, nf.licence AS own_licence, nf.score AS own_score,
       coalesce(nf.licence, a.licence, b.licence) AS licence,
       CASE WHEN nf.licence IS NULL THEN coalesce(a.dir, b.dir) END AS licence_dir
FROM nf LEFT JOIN said a ON a.dir = nf.dir LEFT JOIN said b ON b.dir = string_split(nf.dir, '/')[1]
"""


SQL = sql()
