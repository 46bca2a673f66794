"""Licence scans on templates, variants and mentions."""

import re
import textwrap

import numpy as np

from waveframe.llm import licences


def test_families(spark, sf_small):
    texts = {
        None: "none", "": "none", "See the license file": "unknown", "driver license lost": "none", "no anchor": "none",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software")': "mit",
        "x\nSPDX-License-Identifier: BSD-3-Clause\ny": "bsd", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "word " * 30_000 + "Released under the MIT License. " + "word " * 10: "mit",
    }
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, family string")
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    assert [got[i]["family"] for i in range(len(texts))] == list(texts.values())
    assert all(0 <= r["probability"] <= 1 for r in got.values())


def test_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    marks = {"gpl": "general public license", "mit": "mit license", "apache-2.0": "apache license", "cc-by-nc": "cc by-nc"}
    got = {r["doc_id"]: r["families"].split(",") for r in licences.scan(docs).collect()}
    for r in docs.collect():
        text = re.sub(r"[^a-z0-9. \n-]", "", r["text"].lower())
        for family, mark in marks.items():
            assert (family in got[r["doc_id"]]) == (mark in text), r["doc_id"]


def test_several_families_and_repeats(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.\nLicensed under CC BY 4.0"), (1, "Released under the MIT License.\nLicensed under CC BY 4.0"), (None, "x")], "doc_id long, text string")
    got = licences.scan(df).collect()
    assert sorted(r["families"] for r in got) == ["", "cc-by,mit", "cc-by,mit"]
    assert licences.scan(df.limit(0)).count() == 0


WRAPPED = {
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "proprietary": "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
}


def test_wrapped_notices(spark):
    rows = [(family, 1, "Some words\nbefore\n" + "\n".join(f"# {x}" for x in textwrap.wrap(text, width)) + "\n#\nOther text.\nMore") for family, text in WRAPPED.items() for width in (12, 25, 40, 60, 72, 80, 1000)]
    rows += [("bsd,gpl", 2, f"{textwrap.fill(WRAPPED['bsd'], 72)}\n{textwrap.fill(WRAPPED['gpl'], 72)}"), ("", 0, textwrap.fill(WRAPPED["bsd"], 72).replace("\n", "\n\n"))]
    df = spark.createDataFrame([(i, x[2]) for i, x in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: (r["families"], r["n_lines"]) for r in licences.scan(df).collect()}
    assert [got[i] for i in range(len(rows))] == [x[:2] for x in rows]


def test_every_template_is_found(spark):
    cases = [(family, t) for family, ts in licences.TEMPLATES.items() for t in ts]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["family"] for r in licences.scan(df).collect()}
    assert [(got[i], t) for i, (_, t) in enumerate(cases)] == cases


def test_native(spark, sf_small):
    plan = licences.scan(spark.read.parquet(f"{sf_small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute(text):
    """families, n_lines and the best family's probability by every run of lines, without the prefilters."""
    table, biases, temperature = licences.fitted()
    weights = {}
    for gram, family, weight in table:
        weights.setdefault(gram, []).append((family, weight))
    templates = [(family, licences.grams_of(licences.words_of(t))) for family, ts in licences.TEMPLATES.items() for t in ts]
    owners = {}
    for family, grams in templates:
        for g in grams:
            owners.setdefault(g, set()).add(family)
    lines = [licences.words_of(x) for x in text.split("\n")]
    least = {}
    for first in range(len(lines)):
        between = 0
        for last in range(first, len(lines)):
            if not lines[last] or between > licences.REACH:
                break
            between += len(lines[last]) if last > first else 0
            words = lines[first] if last == first else lines[first][-licences.REACH :] + [w for x in lines[first + 1 : last] for w in x] + lines[last][: licences.REACH]
            grams = licences.grams_of(words) & owners.keys()
            z = np.array(biases)
            for g in grams:
                for family, weight in weights.get(g, ()):
                    z[family] += weight
            z = z / temperature
            family, probability = licences.FAMILIES[int(z.argmax())], 1 / np.exp(z - z.max()).sum()
            cover = max((len(grams & t) / len(t) for f, t in templates if f == family and any(len(owners[g]) == 1 for g in grams & t)), default=0)
            if grams and probability >= licences.LEAST_PROBABILITY and cover >= licences.LEAST_COVER and first not in least.get(family, {}):
                least.setdefault(family, {})[first] = (last, probability)
    n, best = 0, None
    for family, runs in least.items():
        left = [(a, b, p) for a, (b, p) in sorted(runs.items()) if not any(c > a and d <= b for c, (d, _) in runs.items())]
        n += sum(k == 0 or left[k - 1][1] < a for k, (a, _, _) in enumerate(left))
        best = min([x for x in [best, *[(-p, family) for _, _, p in left]] if x])
    return ",".join(sorted(least)), n, best[1] if best else None, -best[0] if best else 0.0


def test_whole_table_matches_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    for r in docs.collect():
        families, n, family, probability = brute(r["text"] or "")
        found = got[r["doc_id"]]
        assert (found["families"], found["n_lines"]) == (families, n), r["doc_id"]
        assert abs(found["probability"] - probability) < 1e-6 and (family is None or found["family"] == family)


FOREIGN = [
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "MIT License", "SPDX-License-Identifier: 0BSD", "Licensed under the WTFPL", "distributed under the OpenSSL license",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "Not released under the GPL", "This work is not licensed under the MIT license.",
]
MENTIONS = ["the nurse got her license in June after the exam", "copyright", "a fishing license costs ten dollars", "The camera comes with a two year warranty", "They were denied permission to land", "the domain of the function is open", "tables are reserved"]


def likeliest(text):
    """Highest probability of all classes but none around an anchor, in plain Python."""
    table, biases, temperature = licences.fitted()
    weights, best = {}, 0.0
    for gram, family, weight in table:
        weights.setdefault(gram, []).append((family, weight))
    known = set().union(*(licences.grams_of(licences.words_of(t)) for ts in licences.TEMPLATES.values() for t in ts))
    paragraphs, words = [[]], None
    for line in text.split("\n"):
        words = licences.words_of(line)
        paragraphs[-1] += words
        if not words:
            paragraphs.append([])
    for words in paragraphs:
        for i, word in enumerate(words):
            grams = licences.grams_of(words[max(0, i - licences.BEFORE) : i + licences.AFTER + 1]) & known
            if re.search(licences.ANCHOR, word) and any(g in weights for g in grams):
                z = np.array(biases)
                for g in grams:
                    for family, weight in weights.get(g, ()):
                        z[family] += weight
                e = np.exp((z - z.max()) / temperature)
                best = max(best, 1 - e[licences.FAMILIES.index(licences.NONE)] / e.sum())
    return best


def test_unknown_comes_from_the_classifier(spark, sf_small):
    wrapped = ["Words before.\n" + textwrap.fill(t, 22) + "\n\nlicense" for t in FOREIGN[:1]]
    texts = [*FOREIGN, *MENTIONS, *wrapped, "", "\n\n \n", "license " * 50_000, "the terms of the\n\nlicense", *(r["text"] or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect())]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, FOREIGN[0]), (None, FOREIGN[0]), (0, "x")], "doc_id long, text string")
    found = licences.scan(df).collect()
    assert [r["family"] for r in found if r["doc_id"] is None] == ["unknown", "unknown"] and sorted(r["family"] for r in found if r["doc_id"] == 0) == ["none", "unknown"]
    got = {r["doc_id"]: r for r in found if r["doc_id"]}
    for i, t in enumerate(texts):
        if i and not got[i]["families"]:
            want = likeliest(t)
            assert got[i]["family"] == ("unknown" if want >= 0.5 else "none"), t
            assert abs(got[i]["probability"] - (want if want >= 0.5 else 0)) < 1e-6
    n = len(FOREIGN)
    assert [got[i]["family"] for i in range(1, n)] == ["unknown"] * (n - 1) and [got[n + i]["family"] for i in range(len(MENTIONS))] == ["none"] * len(MENTIONS)
    assert got[n + len(MENTIONS)]["family"] == "unknown"
