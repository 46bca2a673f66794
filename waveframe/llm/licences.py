"""Licence families of documents' paragraphs, scanned in DataFrame operations only.

A multinomial logistic regression over the distinct words, pairs and triples of words of a
paragraph names its family, or the class unknown (a statement on licences that is of no family here, or denies
one) or none (a text that merely mentions such words). It is fitted on the driver from the short statements below,
whole and in parts and within other words; a temperature fitted on statements and mentions of
CALIBRATION, which take no part in the fit, calibrates its probabilities. Its weights are a small
table (their number is fixed by the templates), so scoring is a broadcast join of paragraphs' n-grams with
it and sums by paragraph. A prediction stands if its probability is at least 0.5 and a
template of the family confirms it: the paragraph has at least 0.6 of the template's n-grams, and
among them one that no other family's templates have.

Paragraphs are all runs of consecutive lines, single ones included, so a notice is found however it is
wrapped; a line without words ends them. Between its first and last line a run has at most REACH words, and
as many of those two lines' ends count: twice the longest template. Of confirmed runs of a family within
each other the shortest count. Only runs with a word of `needed()` are cut into n-grams: without any,
no template reaches 0.6.

A document in which no run is confirmed is unknown if the classifier says so of the words around one of its
anchors (ANCHOR; BEFORE and AFTER words of its paragraph): the probability of all classes but none is at least 0.5 there.
So a family that no template confirms makes it unknown too.

Defined results: null and empty texts and texts with neither a confirmed run nor such an anchor have family `none`
and probability 0; an unknown one has the highest such probability; of several confirmed families the
document's is the one of the highest probability, then by name, and `families` lists all;
repeated rows count each; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, text_of, written

ANCHOR = r"licen[cs]|copyright|warrant|spdx|redistribut|permission|gpl|\breserved\b|\bdomain\b|\bcommons\b|\bcc0?\b"
# Usual statements of licences.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license 2.0", "spdx license identifier apache 2.0", "apache license version 2.0 january 2004 terms and conditions for use reproduction and distribution"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "spdx license identifier mit", "distributed under the terms of the mit license"],
    "gpl": ["licensed under the gnu general public license version 3", "this work is licensed under the gnu general public license version 2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "spdx license identifier gpl 3.0 or later", "released under the gpl"],
    "lgpl": ["licensed under the gnu lesser general public license version 2.1", "under the terms of the gnu lesser general public license as published by the free software foundation", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "spdx license identifier lgpl 2.1 only", "released under the lgpl"],
    "agpl": ["licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "spdx license identifier agpl 3.0 only", "released under the agpl"],
    "bsd": ["licensed under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "spdx license identifier bsd 3 clause", "released under the 3 clause bsd license"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license", "spdx license identifier isc"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "spdx license identifier cc by 4.0"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "text is available under the creative commons attribution sharealike license"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under cc by nc sa 4.0"],
    "cc-by-nd": ["licensed under cc by nd 4.0", "this work is licensed under a creative commons attribution noderivatives 4.0 international license"],
    "cc0": ["licensed under cc0 1.0", "to the extent possible under law the author has waived all copyright and related rights to this work", "spdx license identifier cc0 1.0"],
    "public-domain": ["this work is released into the public domain", "this is free and unencumbered software released into the public domain"],
    "proprietary": ["all rights reserved no part of this publication may be reproduced", "copyright all rights reserved", "proprietary and confidential unauthorized copying of this file is strictly prohibited"],
}
UNKNOWN, NONE = "unknown", "none"
# Usual statements of licences that have no family here. Those of CALIBRATION take no part in the fit.
FOREIGN = [
    "the contents of this file are subject to the terms of the common development and distribution license you may not use this file except in compliance with the license",
    "licensed under the european union public licence version 1.2 or later", "this package is licensed under the artistic license 2.0",
    "this program and the accompanying materials are made available under the terms of the common public license version 1.0",
    "distributed under the boost software license version 1.0", "this font software is licensed under the sil open font license version 1.1",
    "use of this source code is governed by a license that can be found in the license file", "see the license file for details", "license terms are described in the accompanying documentation",
    "released under the open database license", "spdx license identifier postgresql", "permission is granted to copy and distribute verbatim copies of this document with this notice",
    "you are free to use copy and modify this software for any purpose without fee", "this software is provided as is without any express or implied warranty", "the public license of this work",
    "this product is provided under a commercial license and its redistribution needs written permission", "licensed under terms that are to be found elsewhere",
]
CALIBRATION = [
    "this software is distributed under the microsoft public license", "the files in this folder are subject to the terms of the academic free license version 3.0", "released under the python software foundation license",
    "this work is licensed under the free art license 1.3", "refer to the license for the terms of redistribution", "spdx license identifier ofl 1.1", "copyright holders permit use in source and binary forms under the license below",
]
MENTIONS = [
    "the driver showed a license to the officer", "a license is needed to fish in this lake", "permission from the owner is needed", "the warranty card is in the box", "copyright law is taught in the second year", "the license plate of the car",
    "please ask for permission before you enter", "a creative commons of ideas", "they warranted a closer look", "the work was released under pressure", "this software is free of charge", "under the terms of the contract",
    "the general public was not informed", "the public domain of the town", "the version 2.0 of the program", "an international conference on the redistribution of wealth", "license", "copyright", "warranty", "permission",
    "he lost his driver license on the way to the city", "the bar had its liquor license revoked", "a warrant for their arrest was issued", "the court heard the copyright case in may",
]
# Names alone state a family that no template confirms.
NAMES = {"apache-2.0": "apache license", "mit": "mit license", "gpl": "gpl license", "lgpl": "lgpl license", "agpl": "agpl license", "bsd": "bsd license", "mpl-2.0": "mozilla public license", "isc": "isc license"}
CALIBRATION_MENTIONS = [
    "a pilot needs a license and many hours in the air", "the judge signed a search warrant", "she asked for permission to leave the room", "the redistribution of land took years", "poetic license is not a crime",
    "the band sued over copyright of the song", "the warranty on the fridge ended last year", "their hunting license had expired",
]
SEED = 5
LEAST_PROBABILITY, LEAST_COVER = 0.5, 0.6
FAMILIES = [*TEMPLATES, UNKNOWN, NONE]
#: Words before and after an anchor that its window has.
BEFORE, AFTER = 10, 18
TOKEN = r"[^a-z0-9.+]+"


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split(TOKEN, text.lower())) if w]


#: Words between the first and last line of a run, and of each of these two.
REACH = 2 * max(len(words_of(t)) for ts in TEMPLATES.values() for t in ts)


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def denied() -> list[str]:
    """Statements that a work isn't under a licence."""
    return [re.sub(r"\b(licensed|released) under", r"not \1 under", t) for ts in TEMPLATES.values() for t in ts if re.search(r"\b(licensed|released) under", t)]


def needed() -> list[str]:
    """Words of which a text must have one to cover LEAST_COVER of any template: frequent in templates, not in English."""
    plain = set("a all and any as at by for from have in is it may no not of on or part be the this to under with without work you can that are use free code file copy person author extent purpose available 3 2.1 3.0".split())
    every = [words_of(t) for ts in TEMPLATES.values() for t in ts]
    found: set[str] = set()
    for words in every:
        whole = grams_of(words)
        while len(left := {g for g in whole if not found.intersection(g.split())}) >= LEAST_COVER * len(whole):
            found.add(max(sorted(set(words) - found - plain) or sorted(set(words) - found), key=lambda w: (sum(w in g.split() for g in left), sum(w in x for x in every))))
    return sorted(found)


@lru_cache(maxsize=1)
def fitted(turns: int = 300, penalty: float = 1e-3) -> tuple[list[tuple[str, int, float]], list[float], float]:
    """(gram, family number, weight) of the features, biases by family, and the temperature."""
    rng = np.random.default_rng(SEED)
    known = sorted(set().union(*(grams_of(words_of(t)) for ts in TEMPLATES.values() for t in ts)))
    number = {g: k for k, g in enumerate(known)}
    filler = sorted({w for t in MENTIONS for w in words_of(t)})

    def varied(text: str) -> list[str]:
        words = words_of(text)
        cut = int(rng.integers(0, max(1, len(words) // 3))) if len(words) > 8 else 0
        words = words[cut:] if rng.random() < 0.5 else words[: len(words) - cut]
        around = [filler[i] for i in rng.integers(0, len(filler), int(rng.integers(0, 12)))]
        at = int(rng.integers(0, len(around) + 1))
        return around[:at] + words + around[at:]

    def examples(times: int, unknown: list[str], none: list[str]):
        rows, classes = [], []
        for k, family in enumerate(FAMILIES):
            for text in {UNKNOWN: unknown, NONE: none}.get(family) or [*TEMPLATES[family], *([NAMES[family]] if family in NAMES else [])]:
                for _ in range(times):
                    rows.append([number[g] for g in grams_of(varied(text)) if g in number])
                    classes.append(k)
        x = np.zeros((len(rows), len(known)))
        for i, r in enumerate(rows):
            x[i, r] = 1
        return x, np.array(classes)

    def logits(x):
        return x @ w + b

    def softmax(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    x, y = examples(6, [*FOREIGN, *denied()], MENTIONS)
    one = np.eye(len(FAMILIES))[y]
    w, b = np.zeros((len(known), len(FAMILIES))), np.zeros(len(FAMILIES))
    fast_w, fast_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(turns):
        gap = (softmax(logits(x)) - one) / len(y)
        fast_w = 0.9 * fast_w - 2.0 * (x.T @ gap + penalty * w)
        fast_b = 0.9 * fast_b - 2.0 * gap.sum(0)
        w, b = w + fast_w, b + fast_b
    held, truth = examples(4, CALIBRATION, CALIBRATION_MENTIONS)
    z = logits(held)
    loss = {t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.25, 4, 33)}
    table = [(g, k, round(float(w[i, k]), 6)) for i, g in enumerate(known) for k in range(len(FAMILIES)) if abs(w[i, k]) > 0.02]
    return table, [round(float(v), 6) for v in b], float(min(loss, key=loss.get))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from constants, as an expression."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    fields = ", ".join(c.replace(" ", ": ", 1) for c in schema.split(", "))
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{fields}>>")).alias("x")).select("x.*")


def line_words(line: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(line), TOKEN), lambda w: F.trim(w, F.lit("."))), lambda w: w != "")


def grams(words: Column) -> Column:
    """Distinct words, pairs and triples of words."""
    # pairs and triples by zipping the words with themselves shifted: linear in the line
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, F.nullif(b, F.lit(""))))
    triples = F.zip_with(F.slice(pairs, 1, F.size(words)), F.slice(words, 3, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    whole = F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_distinct(F.concat(words, whole, F.filter(triples, lambda t: t.isNotNull())))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs_from(ahead: Column, line: Column) -> Column:
    """line, last and words of the runs that begin with the first of the lines ahead and have a needed word."""

    def taken(so_far: Column, x: Column) -> Column:
        size = F.size(x["words"])
        goes = so_far["goes"] & (size > 0) & (so_far["between"] <= REACH)
        between = so_far["between"] + F.when(so_far["n"] > 0, size).otherwise(0)
        return F.struct((so_far["n"] + goes.cast("int")).alias("n"), between.alias("between"), goes.alias("goes"))

    n = F.aggregate(ahead, F.struct(F.lit(0).alias("n"), F.lit(0).alias("between"), F.lit(True).alias("goes")), taken, lambda x: x["n"])

    def run(end: Column) -> Column:
        first, last = F.element_at(ahead, 1)["words"], F.element_at(ahead, end)["words"]
        tail = F.slice(first, F.greatest(F.size(first) - (REACH - 1), F.lit(1)), REACH)
        inner = F.flatten(F.transform(F.slice(ahead, 2, F.greatest(end - 2, F.lit(0))), lambda x: x["words"]))
        words = F.when(end == 1, first).otherwise(F.concat(tail, inner, F.slice(last, 1, REACH)))
        return F.struct(line.alias("line"), (line + end - 1).alias("last"), words.alias("words"))

    ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda end: (end <= n) & F.exists(F.slice(ahead, 1, end), lambda x: x["hit"]))
    return F.transform(ends, run)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, copy (a hash of the text), line, last (numbers of the first and last line) and the templates' grams in it of runs with a needed word."""
    sizes = [(math.ceil(LEAST_COVER * len(g)), sum(" " not in x for x in g)) for g in (grams_of(words_of(t)) for ts in TEMPLATES.values() for t in ts)]
    # so many grams, and so many pairs and triples, has a text that covers LEAST_COVER of any template
    least, longer = min(x for x, _ in sizes), min(x - words for x, words in sizes)
    known = F.lit(sorted(set().union(*(grams_of(words_of(t)) for ts in TEMPLATES.values() for t in ts))))
    hit = rf"(?<![a-z0-9])(?:{'|'.join(re.escape(w) for w in needed())})(?![a-z0-9])"
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text")).where(F.lower("text").rlike(hit))
    each = F.transform(F.split("text", "\n"), lambda x: F.struct(line_words(x).alias("words"), F.lower(x).rlike(hit).alias("hit")))
    starts = let(each, lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: let(F.slice(w, i, REACH + 3), lambda ahead: runs_from(ahead, i)))))
    return rows.select("doc_id", "copy", F.explode(starts).alias("run")).select("doc_id", "copy", "run.line", "run.last", F.array_intersect(grams(F.col("run.words")), known).alias("grams")).where((F.size("grams") >= least) & (F.size(F.filter("grams", lambda g: g.contains(" "))) >= longer))


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, copy and the distinct windows (words joined by a space) of the anchors of texts."""
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), F.lower(text).alias("text")).where(F.col("text").rlike(ANCHOR))
    paragraphs = F.filter(F.split("text", r"\n[^a-z0-9+]*\n"), lambda x: x.rlike(ANCHOR))

    def around(words: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.try_element_at(words, i).rlike(ANCHOR))
        return F.transform(places, lambda i: F.concat_ws(" ", F.slice(words, F.greatest(i - BEFORE, F.lit(1)), F.least(i, F.lit(BEFORE + 1)) + AFTER)))

    each = F.array_distinct(F.flatten(F.transform(paragraphs, lambda x: let(line_words(x), around))))
    return rows.select("doc_id", "copy", F.explode(each).alias("window"))


def scored(long: DataFrame, own: list[str]) -> DataFrame:
    """own, family and probability of the likeliest class, licensed (probability of all classes but none) of rows with grams (own, gram)."""
    table, biases, temperature = fitted()
    weights = F.broadcast(_rows(long.sparkSession, table, "gram string, family int, weight double"))
    sums = long.join(weights, "gram").groupBy(*own, "family").agg(F.sum("weight").alias("z"))
    by_own = sums.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("family", "z"))).alias("z"))  # classes are few
    z = F.transform(F.array(*[F.lit(v) for v in biases]), lambda b, k: (b + F.coalesce(F.try_element_at("z", k), F.lit(0.0))) / temperature)
    top = by_own.select(*own, z.alias("z")).select(*own, "z", F.array_max("z").alias("most"))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("most")))
    family = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.array_position("z", F.col("most")).cast("int"))
    licensed = 1 - F.exp(F.element_at("z", FAMILIES.index(NONE) + 1) - F.col("most")) / total
    return top.select(*own, family.alias("family"), (1 / total).alias("probability"), licensed.alias("licensed"))


def stated(found: DataFrame) -> DataFrame:
    """doc_id, copy and the highest licensed of the windows (doc_id, copy, window), if it is LEAST_PROBABILITY or more."""
    known = F.lit(sorted(set().union(*(grams_of(words_of(t)) for ts in TEMPLATES.values() for t in ts))))
    own = ["doc_id", "copy", "window"]
    long = found.select(*own, F.explode(F.array_intersect(grams(F.split("window", " ")), known)).alias("gram"))
    return scored(long, own).groupBy("doc_id", "copy").agg(F.max("licensed").alias("licensed")).where(F.col("licensed") >= LEAST_PROBABILITY)


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, copy, line, last, family, probability, confirmed of every run of `lines`."""
    families = {}
    for family, ts in TEMPLATES.items():
        for g in set().union(*(grams_of(words_of(t)) for t in ts)):
            families.setdefault(g, set()).add(family)
    cases = [(family, k, g, len(grams_of(words_of(t))), len(families[g]) == 1) for family, ts in TEMPLATES.items() for k, t in enumerate(ts) for g in sorted(grams_of(words_of(t)))]
    templates = F.broadcast(_rows(docs.sparkSession, cases, "family string, template int, gram string, n int, own boolean"))
    own = ["doc_id", "copy", "line", "last"]
    each = written(lines(docs).dropDuplicates(own))
    long = each.select(*own, F.explode("grams").alias("gram"))
    named = scored(long, own).drop("licensed")
    cover = long.join(templates, "gram").groupBy(*own, "family", "template").agg((F.count("*") / F.first("n")).alias("cover"), F.max("own").alias("own")).where("own").groupBy(*own, "family").agg(F.max("cover").alias("cover"))
    both = each.select(*own).join(named, own, "left").join(cover, [*own, "family"], "left")
    stands = ~F.col("family").isin(UNKNOWN, NONE) & (F.col("probability") >= LEAST_PROBABILITY) & (F.col("cover") >= LEAST_COVER)
    return both.select(*own, F.coalesce("family", F.lit(NONE)).alias("family"), F.coalesce("probability", F.lit(0.0)).alias("probability"), F.coalesce(stands, F.lit(False)).alias("confirmed"))


def shortest(found: DataFrame) -> DataFrame:
    """Confirmed runs without those that hold a shorter one of their family; begins: whether it overlaps none before it."""
    by = ["doc_id", "copy", "family"]
    least = found.groupBy(*by, "line").agg(F.min_by(F.struct("last", "probability", "confirmed"), "last").alias("x")).select(*by, "line", "x.*")
    later = F.min("last").over(Window.partitionBy(*by).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1))
    left = least.withColumn("later", later).where("later IS NULL OR last < later").drop("later")
    before = F.lag("last").over(Window.partitionBy(*by).orderBy("line"))
    return left.withColumn("begins", F.coalesce(before < F.col("line"), F.lit(True)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, family, probability, families, n_lines (confirmed) of every document; n_lines: its confirmed runs, overlapping ones of a family as one."""
    found = shortest(classified(docs).where("confirmed"))
    sure = F.when(F.col("confirmed"), F.struct((-F.col("probability")).alias("order"), "family"))
    by_doc = written(found.groupBy("doc_id", "copy").agg(F.min(sure).alias("best"), F.count_if("begins").alias("n_lines"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families")))  # families are few
    done = by_doc.select(F.col("doc_id").alias("its_id"), F.col("copy").alias("its_copy"))
    # written, so that the join isn't pushed below them: windows are moved, texts never
    rest = written(windows(docs).dropDuplicates())
    rest = rest.join(small(done), rest["doc_id"].eqNullSafe(done["its_id"]) & (rest["copy"] == done["its_copy"]), "left_anti")
    unknown = written(stated(rest)).select("doc_id", "copy", F.struct((-F.col("licensed")).alias("order"), F.lit(UNKNOWN).alias("family")).alias("best"), F.lit(0).alias("n_lines"), F.lit("").alias("families"))
    right = by_doc.unionByName(unknown).select(F.col("doc_id").alias("its_id"), F.col("copy").alias("its_copy"), "best", "n_lines", "families")
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("copy"))
    both = slim.join(right, slim["doc_id"].eqNullSafe(right["its_id"]) & (slim["copy"] == right["its_copy"]), "left")
    family = F.coalesce("best.family", F.lit(NONE))
    return both.select("doc_id", family.alias("family"), F.coalesce(-F.col("best.order"), F.lit(0.0)).alias("probability"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))
