"""License scan: a trained paragraph classifier, confirmed by templates.

Paragraphs are blocks between blank lines, their wrapped lines joined. The notices below
are cut at punctuation into clauses of ``CLAUSE`` words or more, without those that notices
of several families share. The classifier is a
multinomial logistic regression over hashed word 1- to 3-grams, with an L1 part that leaves
few weights. It learns from notices, clauses and both with words left out, and for the
class ``unknown`` from a bounded sample of paragraphs of the corpus (``SAMPLE`` at most,
of the documents whose ids hash lowest) that share few word pairs with a notice. Every fifth
sampled paragraph is held out; the probability that a family needs is calibrated on these:
above what any of them gets, but never so high that a whole clause would not reach it.

A paragraph is looked at where a clause may stand: in windows of a clause's length (and a
quarter more) that hold at least ``COVER`` of the clause's distinct word pairs. A window is
classified by its words, and counts if the predicted family is the clause's own. A window
that overlaps a fuller one of its clause (ties: a shorter one, then an earlier one) is
passed over.

Two exact filters come first. Of a clause with k pairs of which m must occur, any k - m + 1
pairs hold at least one that occurs; the rarest so many of each clause are its *marks*. A
text without any mark of any clause is passed over, and so is a paragraph.

Everything on the way of the texts is DataFrame functions; the regression is Spark's.

Defined cases: null counts as the empty text; documents without a license have counts 0
and empty families; a doc_id gets one row, with the licenses of all its rows (rows that
are alike in doc_id and text count once); rows without a doc_id form one row; other columns
are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

#: Notices by which texts are put under a license, by family.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "all-rights-reserved": ["All rights reserved.", "No part of this work may be reproduced without written permission."],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Released under the BSD License.",
        "Licensed under the 3-clause BSD license.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 2.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "Licensed under the Mozilla Public License, version 2.0."],
    "public-domain": ["This work has been dedicated to the public domain.", "Licensed under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain."],
}
#: Words that say little about a pair; only the choice of marks looks at them.
COMMON = frozenset("a all an and any are as at be by for has in is it not of on or that the this to under was with you".split())
SAMPLE = 4000
PLACES = 1 << 13
COVER = 0.6
CLAUSE = 12
UNKNOWN = "unknown"
WORD = r"[^\p{L}\p{N}]+"
BLANK = r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*"


def pieces_of(notice: str) -> list[str]:
    """Pieces of a notice, cut at punctuation, of ``CLAUSE`` words or more (a short rest joins the last)."""
    out: list[str] = []
    for piece in re.split(r"(?<=[,;:.])\s+", notice):
        if out and len(re.findall(r"\w+", out[-1])) < CLAUSE:
            out[-1] = f"{out[-1]} {piece}"
        else:
            out.append(piece)
    if len(out) > 1 and len(re.findall(r"\w+", out[-1])) < CLAUSE:
        rest = out.pop()
        out[-1] = f"{out[-1]} {rest}"
    return out


#: Families of each piece: one that several families have says nothing by itself.
SHARED = Counter(piece for own in TEMPLATES.values() for piece in {x for notice in own for x in pieces_of(notice)})


def clauses(notice: str) -> list[str]:
    """Pieces of a notice; those that stand in notices of several families are left out."""
    return [piece for piece in pieces_of(notice) if SHARED[piece] < 2]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD), lambda w: w != "")


def grams(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def pairs(w: Column) -> Column:
    """Hashes of the neighbouring words, in order."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))


def featured(df: DataFrame) -> DataFrame:
    """Add w (words) and features (hashed 1- to 3-grams)."""
    df = df.withColumn("w", words(F.col("paragraph")))
    df = df.withColumn("terms", F.concat("w", grams(F.col("w"), 2), grams(F.col("w"), 3)))
    return HashingTF(inputCol="terms", outputCol="features", numFeatures=PLACES, binary=True).transform(df)


def clause_rows(spark: SparkSession) -> list:
    """Rows (clause, family, paragraph, w, known, need): number, text, words, distinct pairs, pairs that must occur."""
    rows = [(family, c) for family, own in TEMPLATES.items() for notice in own for c in clauses(notice)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "clause int, family string, paragraph string").withColumn("w", words(F.col("paragraph")))
    return df.select("*", F.array_distinct(pairs(F.col("w"))).alias("known")).withColumn("need", F.ceil(COVER * F.size("known")).cast("int")).orderBy("clause").collect()


def marks(clause) -> set[int]:
    """The rarest k - need + 1 pairs of a clause with k pairs: where need pairs occur, one of these does."""
    rare = {}
    for a, b in zip(clause.w, clause.w[1:], strict=False):
        rare.setdefault((a, b), ((a in COMMON) + (b in COMMON), -len(a) - len(b), a, b))
    # pairs and their hashes come in the same order of first occurrence
    order = sorted(zip(rare.values(), clause.known, strict=True))
    return {h for _, h in order[: len(clause.known) - clause.need + 1]}


def long_array(values) -> Column:
    return F.array(*(F.lit(v).cast("bigint") for v in sorted(values)))


def candidates(docs: DataFrame, known: list) -> DataFrame:
    """(doc_id, of, no, w): words of the paragraphs that have a mark; ``of`` is the text's hash, ``no`` the paragraph's number."""
    has = lambda w: F.arrays_overlap(pairs(w), long_array(set().union(*map(marks, known))))
    # generators keep the words from being cut again for each use
    texts = docs.select("doc_id", "text", F.explode(F.array(words(F.col("text")))).alias("w")).filter(has(F.col("w")))
    paragraphs = texts.select("doc_id", F.xxhash64("text").alias("of"), F.posexplode(F.split("text", BLANK)).alias("no", "paragraph"))
    return paragraphs.select("doc_id", "of", "no", F.explode(F.array(words(F.col("paragraph")))).alias("w")).filter(has(F.col("w")))


def windows(held: DataFrame, known: list) -> DataFrame:
    """(doc_id, of, no, clause, said, at, n, share, paragraph): windows that hold enough of a clause of n words; ``said`` is its family."""
    spark = held.sparkSession
    key = ["doc_id", "of", "no"]
    by_pair = spark.createDataFrame([(h, c.clause, len(c.w), c.need) for c in known for h in c.known], "pair bigint, clause int, n int, need int")
    # as many rows as TEMPLATES has pairs
    hits = held.select(*key, F.posexplode(pairs(F.col("w"))).alias("at", "pair")).join(F.broadcast(by_pair), "pair")
    met = hits.groupBy(*key, "clause", "n", "need").agg(F.sort_array(F.collect_set(F.struct("at", "pair"))).alias("hits"))
    span = F.col("n") + F.floor(F.col("n") / 4).cast("int")
    # neighbours are taken one by one: a slice would unpack the whole array each time
    around = lambda name, i, a, b: F.transform(F.sequence(a, b), lambda j: F.get(name, i + j))
    inside = lambda i, x: F.filter(around("hits", i, F.lit(0), span - 2), lambda y: y["at"] < x["at"] + span - 1)
    # the distinct pairs of a window, and where the last of them first occurs
    none = F.struct(F.array().cast("array<bigint>").alias("seen"), F.lit(0).alias("last"))
    first = lambda a, y: F.when(F.array_contains(a["seen"], y["pair"]), a).otherwise(F.struct(F.concat(a["seen"], F.array(y["pair"])).alias("seen"), y["at"].alias("last")))
    measured = lambda i, x: F.aggregate(inside(i, x), none, first, lambda a: F.struct(x["at"].alias("at"), F.size(a["seen"]).alias("kinds"), (a["last"] - x["at"]).alias("reach")))
    starts = F.filter(F.transform("hits", lambda x, i: measured(i, x)), lambda s: s["kinds"] >= F.col("need"))
    enough = met.filter(F.size(F.array_distinct(F.transform("hits", lambda x: x["pair"]))) >= F.col("need")).withColumn("starts", starts).filter(F.size("starts") > 0)
    fuller = lambda x, y: F.struct(-y["kinds"], y["reach"], y["at"]) < F.struct(-x["kinds"], x["reach"], x["at"])
    near = lambda x, y: (F.abs(y["at"] - x["at"]) < F.col("n")) & fuller(x, y)
    # places differ, so what overlaps a window lies at most n starts before or after it
    kept = F.filter("starts", lambda x, i: ~F.exists(around("starts", i, -F.col("n"), F.col("n")), lambda y: F.coalesce(near(x, y), F.lit(False))))
    each = enough.select(*key, "clause", "n", span.alias("span"), F.explode(kept).alias("one"))
    named = spark.createDataFrame([(c.clause, c.family, float(len(c.known))) for c in known], "clause int, said string, k double")
    texts = held.groupBy(*key).agg(F.first("w").alias("w"))  # alike rows have one text
    joined = each.join(texts, (each.doc_id.eqNullSafe(texts.doc_id)) & (each.of == texts.of) & (each.no == texts.no)).select(*(each[c] for c in (*key, "clause", "n", "span", "one")), "w").join(F.broadcast(named), "clause")
    piece = F.array_join(F.slice("w", F.col("one.at") + 1, F.col("span")), " ")
    return joined.select(*key, "clause", "said", F.col("one.at").alias("at"), "n", (F.col("one.kinds") / F.col("k")).alias("share"), piece.alias("paragraph"))


def training_rows(docs: DataFrame, known: list) -> DataFrame:
    """(family, paragraph, held): notices, clauses, both with words left out; and sampled paragraphs of the class unknown."""
    spark = docs.sparkSession
    rows = [(family, t) for family, own in TEMPLATES.items() for notice in own for t in dict.fromkeys([notice, *clauses(notice)])]
    positive = spark.createDataFrame(rows, "family string, paragraph string")
    w = F.split("paragraph", " ")
    thinned = positive.filter(F.size(w) >= 6).select("family", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "paragraph").select("family", F.array_join(F.filter(w, lambda x, i: i % 5 != F.col("k")), " ").alias("paragraph"))
    every = long_array({h for c in known for h in c.known})
    ids = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE // 8)
    few = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select(F.explode(F.split("text", r"\n")).alias("paragraph")).filter(F.length("paragraph").between(1, 2000)).distinct()
    few = few.select("paragraph", F.explode(F.array(words(F.col("paragraph")))).alias("w")).filter((F.size("w") > 0) & (F.size(F.array_intersect(pairs(F.col("w")), every)) <= 0.3 * F.size("w")))
    few = few.orderBy(F.xxhash64("paragraph"), "paragraph").limit(SAMPLE).select(F.lit(UNKNOWN).alias("family"), "paragraph")
    rows = positive.union(thinned).withColumn("held", F.lit(False)).union(few.withColumn("held", F.pmod(F.xxhash64("paragraph"), F.lit(5)) == 0))
    return materialize(rows, "license-training")


def train(docs: DataFrame):
    """(model, labels, needed probability)."""
    known = clause_rows(docs.sparkSession)
    data = training_rows(docs, known)
    labels = [UNKNOWN, *sorted(TEMPLATES)]
    number = F.array_position(F.array(*map(F.lit, labels)), F.col("family")) - 1
    weight = F.when(F.col("family") == UNKNOWN, 1.0).otherwise(5.0)
    fitted = featured(data.filter("NOT held")).withColumn("label", number.cast("double")).withColumn("weight", weight)
    model = LogisticRegression(family="multinomial", maxIter=30, regParam=1e-3, elasticNetParam=0.5, weightCol="weight").fit(fitted.select("label", "features", "weight").coalesce(1))
    own = featured(docs.sparkSession.createDataFrame([(c.family, c.paragraph) for c in known], "family string, paragraph string")).select("family", "features")
    checked = model.transform(own.union(featured(data.filter("held")).select("family", "features"))).select("family", (1 - F.get(vector_to_array("probability"), F.lit(0))).alias("p"))
    worst, least = checked.select(F.max(F.when(F.col("family") == UNKNOWN, F.col("p"))), F.min(F.when(F.col("family") != UNKNOWN, F.col("p")))).first()
    return model, labels, min(max(0.3, worst or 0.0), 0.95 * (least or 1.0))


def classify(rows: DataFrame, trained) -> DataFrame:
    """Columns of ``rows`` (with paragraph), family and probability of those that aren't unknown."""
    model, labels, needed = trained
    scored = model.transform(featured(rows)).withColumn("p", vector_to_array("probability")).drop("w", "terms", "features", "rawPrediction", "prediction", "probability")
    # the most probable family, unknown aside
    own = F.slice("p", 2, len(labels) - 1)
    best = scored.withColumn("probability", F.array_max(own)).withColumn("family", F.get(F.array(*map(F.lit, labels[1:])), (F.array_position(own, F.array_max(own)) - 1).cast("int")))
    unknown = F.get("p", F.lit(0))
    return best.filter((F.col("probability") > unknown) & (1 - unknown >= needed)).drop("p")


def scan(docs: DataFrame, trained=None) -> DataFrame:
    """(doc_id, n_licenses, families, best_probability, n_passages) of each doc_id.

    ``n_licenses`` counts paragraphs with a license, ``n_passages`` the
    windows that say so and don't overlap.
    """
    trained = trained or train(docs)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = clause_rows(docs.sparkSession)
    held = materialize(candidates(own, known), "license-paragraphs")
    sure = classify(windows(held, known), trained).filter("family = said")
    # passages: windows of all clauses, from the first, that don't overlap
    clear = F.aggregate(F.sort_array(F.collect_list(F.struct("at", "n"))), F.struct(F.lit(0).alias("end"), F.lit(0).alias("k")), lambda a, x: F.when(x["at"] >= a["end"], F.struct((x["at"] + x["n"]).alias("end"), (a["k"] + 1).alias("k"))).otherwise(a))
    by_paragraph = sure.groupBy("doc_id", "of", "no").agg(F.collect_set("family").alias("f"), F.max("probability").alias("best"), clear["k"].alias("passages"))
    families = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("f")))), ",")
    by_doc = by_paragraph.groupBy("doc_id").agg(F.count("*").alias("n"), families.alias("families"), F.max("best").alias("best"), F.sum("passages").alias("passages"))
    ids = own.select("doc_id").distinct()
    return ids.join(by_doc, ids.doc_id.eqNullSafe(by_doc.doc_id), "left").select(
        ids.doc_id,
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_licenses"),
        F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("best", F.lit(0.0)).alias("best_probability"),
        F.coalesce("passages", F.lit(0)).cast("bigint").alias("n_passages"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
