r"""Licence scans (operator 1): DataFrame operations only.

Every file is a path and a text. Its units of evidence are all lines of the
whole text that hold a licence cue, its header (the first ``header_lines``
lines) if that holds one, and the whole text of a licence file. A unit and the
templates become sparse TF-IDF vectors: inverse document frequencies of the
template terms are counted over all files, terms that no template has weigh
like an unseen term. The cosine is a join of the units' terms with the
templates' postings (a table of fixed size). Longer passages (standard headers,
SPDX tags, titles with a version, body passages) are compared with windows of
their own number of terms, laid over each unit wherever it holds the passage's
first key term. A template counts only where all its key terms (name and
version) stand. Of the templates at or above ``min_cosine`` the one with the
most matched terms (cosine times template terms) names the file's own licence.

Files without one inherit from the licence files of the nearest ancestor
directory: the distinct directories are joined with the licensed directories
over their ancestors, and the longest match is joined back to the files.

Defined results: a null or empty text has no own licence. A null path has no
directory, so it neither gives nor inherits. Of several licence files of a
directory the one with the highest cosine counts, then the licence name. Rows
with equal paths are separate files. An empty table gives no row. Only the
named columns are read.
"""

from __future__ import annotations

from collections import Counter
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.llm.shared import read, stored

# Licence notices as they stand in headers and licence files.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This program is free software; you can redistribute it and or modify it under the terms of the GNU "
               "General Public License version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Key terms a sentence needs; the others need none.
KEYS = {"Apache-2.0": "apache 2.0", "CC-BY-4.0": "attribution 4.0", "CC-BY-NC-4.0": "cc by nc 4.0", "GPL-2.0": "gnu 2",
        "GPL-3.0": "gnu 3", "LGPL-3.0": "lesser 3", "MIT": "mit", "MPL-2.0": "mozilla 2.0"}
_GNU = ("is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License "
        "as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later "
        "version.")
_WARRANTY = (" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
             "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License "
             "for more details.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.")
_SPDX = {"Apache-2.0": "apache 2.0", "BSD-2-Clause": "bsd 2 clause", "BSD-3-Clause": "bsd 3 clause", "MIT": "mit",
         "MIT-0": "mit 0", "MPL-2.0": "mpl 2.0", "GPL-2.0": "gpl 2.0", "GPL-3.0": "gpl 3.0", "LGPL-2.1": "lgpl 2.1",
         "LGPL-3.0": "lgpl 3.0", "AGPL-3.0": "agpl 3.0", "ISC": "isc", "Unlicense": "unlicense", "CC0-1.0": "cc0 1.0",
         "CC-BY-4.0": "cc by 4.0", "CC-BY-SA-4.0": "cc by sa 4.0", "CC-BY-NC-4.0": "cc by nc 4.0",
         "CC-BY-ND-4.0": "cc by nd 4.0", "CC-BY-NC-SA-4.0": "cc by nc sa 4.0", "CC-BY-NC-ND-4.0": "cc by nc nd 4.0"}
# (licence, passage, key terms, the first of which places the windows)
PASSAGES = [
    *[(name, f"SPDX-License-Identifier: {tag}", f"spdx {tag}".replace("cc0", "cc 0")) for name, tag in _SPDX.items()],
    ("Apache-2.0", "Apache License Version 2.0", "apache 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
     "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "apache 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
     "REPRODUCTION, AND DISTRIBUTION", "apache 2.0"),
    ("MIT", "The MIT License", "mit license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "granted sublicense"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies", "fee granted"),
    ("BSD-2-Clause", _BSD, "redistribution binary"),
    ("BSD-3-Clause", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission.",
     "redistribution endorse"),
    ("BSD-3-Clause", "BSD 3-Clause License", "bsd 3 clause"),
    ("BSD-2-Clause", "BSD 2-Clause License", "bsd 2 clause"),
    ("MPL-2.0", "Mozilla Public License Version 2.0", "mozilla 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
     "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software", "unencumbered"),
    *[(name, text, f"{key} {version}") for name, kind, key, version in (
        ("GPL-2.0", "", "gnu", "2"), ("GPL-3.0", "", "gnu", "3"), ("LGPL-2.1", "Lesser ", "lesser", "2.1"),
        ("LGPL-3.0", "Lesser ", "lesser", "3"), ("AGPL-3.0", "Affero ", "affero", "3"))
      for text in (_GNU.format(kind, version), _GNU.format(kind, version) + _WARRANTY.format(kind),
                   f"GNU {kind}General Public License version {version}",
                   f"GNU {kind}General Public License Version {version} Copyright Free Software Foundation, Inc. Everyone is "
                   "permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed")],
    *[(name, text, f"{text.split()[0].lower()} {number}") for name, short, number in (
        ("GPL-2.0", "GPL", "2"), ("GPL-3.0", "GPL", "3"), ("LGPL-3.0", "LGPL", "3"), ("AGPL-3.0", "AGPL", "3"))
      for text in (f"{short} version {number} license",)],
    *[(name, f"{short}v{number} license", f"{short.lower()}v {number}") for name, short, number in (
        ("GPL-2.0", "GPL", "2"), ("GPL-3.0", "GPL", "3"), ("LGPL-3.0", "LGPL", "3"), ("AGPL-3.0", "AGPL", "3"))],
]
CUE = ("licen[cs]e|copyright|spdx|all rights reserved|public domain|creative commons|permission is hereby granted"
       "|redistribution and use")
TERM = "[a-z]+|[0-9]+(?:[.][0-9]+)*"
LICENCE_NAME = "(?i)^(licen[cs]e|copying|unlicense)([-._].*)?$"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)


def template_terms() -> list[tuple[str, str, int]]:
    """(licence, term, count) of the templates."""
    return [(name, t, n) for name, text in TEMPLATES.items() for t, n in Counter(re.findall(TERM, text.lower())).items()]


def passage_terms() -> list[list[str]]:
    """Terms of each passage, in order."""
    return [re.findall(TERM, text.lower()) for _, text, _ in PASSAGES]


def inverse_frequencies(files: DataFrame, text: str) -> tuple[DataFrame, float]:
    """(term, idf) of the template terms over all files, and the weight of a term never seen."""
    vocabulary = sorted({t for _, t, _ in template_terms()} | {t for p in passage_terms() for t in p})
    seen = F.array_intersect(F.array_distinct(_terms(F.col(text))), F.split(F.lit(" ".join(vocabulary)), " "))
    n = files.count()
    df = files.select(F.explode(seen).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    spark = files.sparkSession
    every = spark.createDataFrame([(t,) for t in vocabulary], "term string")  # the terms of the templates
    idf = every.join(df, "term", "left").select(
        "term", (F.log((1 + F.lit(float(n))) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    return idf, float(n)


def units(text: Column, is_licence: Column, header_lines: int) -> Column:
    """Array of the texts that speak for a file's licence."""
    lines = F.split(text, "\n")
    cue = f"(?i)({CUE})"
    head = F.array_join(F.slice(lines, 1, header_lines), "\n")
    whole = F.when(is_licence, F.array(text)).otherwise(F.array().cast("array<string>"))
    found = F.concat(F.filter(lines, lambda x: x.rlike(cue)), F.filter(F.array(head), lambda x: x.rlike(cue)), whole)
    return F.when(text.rlike(cue) | is_licence, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def passage_matches(each: DataFrame, *, idf: DataFrame, unseen: Column, min_cosine: float) -> DataFrame:
    """(uid, licence, cosine, size) of the windows of the units that match a passage.

    ``each``: (uid, no, body). A window has the passage's number of terms and
    begins where the passage would, were the key term found its own."""
    spark = each.sparkSession
    place, weight = [], []
    for k, ((licence, _, keys), terms) in enumerate(zip(PASSAGES, passage_terms())):
        keys = keys.split()
        assert set(keys) <= set(terms), (licence, keys)
        place += [(keys[0], k, at, len(terms), licence, len(set(keys))) for at, t in enumerate(terms) if t == keys[0]]
        weight += [(k, t, n, int(t in keys)) for t, n in Counter(terms).items()]
    before, longest = max(p[2] for p in place), max(p[3] for p in place)
    # tables of fixed size, as the templates are
    place = spark.createDataFrame(place, "anchor string, passage int, at int, size int, licence string, n_keys int")
    weight = spark.createDataFrame(weight, "passage int, term string, n int, key int").join(idf, "term") \
        .select("passage", "term", "key", (F.col("n") * F.col("idf")).alias("p_w"))
    norm = weight.groupBy("passage").agg(F.sqrt(F.sum(F.col("p_w") * F.col("p_w"))).alias("p_norm"))
    anchors = sorted({k.split()[0] for _, _, k in PASSAGES})
    toks = each.select("uid", "no", _terms(F.col("body")).alias("toks"))
    hits = F.filter(F.transform("toks", lambda t, i: F.struct(t.alias("anchor"), i.alias("pos"))),
                    lambda x: x["anchor"].isin(anchors))
    # a hit takes along the terms that a window around it can hold, not those of its whole unit
    first = F.greatest(F.col("pos") - before, F.lit(0))
    near = F.transform(hits, lambda x: x.withField("near", F.slice(
        "toks", F.greatest(x["pos"] - before, F.lit(0)) + 1, before + longest)))
    found = toks.select("uid", "no", F.explode(near).alias("hit")).select("uid", "no", "hit.*") \
        .join(F.broadcast(place), "anchor")
    start = F.greatest(F.col("pos") - F.col("at"), F.lit(0))
    window = found.select("uid", "no", "passage", start.alias("start"),
                          F.explode(F.slice("near", start - first + 1, F.col("size"))).alias("term"),
                          F.lit(1).alias("one"), F.col("at"))
    by = ["uid", "no", "passage", "start", "at"]
    terms = window.groupBy(*by, "term").agg(F.sum("one").alias("tf")).join(F.broadcast(idf), "term", "left") \
        .join(F.broadcast(weight), ["passage", "term"], "left")
    w = F.col("tf") * F.coalesce("idf", unseen)
    scored = terms.groupBy(*by).agg(F.sum(w * F.coalesce("p_w", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(w * w)).alias("norm"),
                                    F.sum(F.coalesce("key", F.lit(0))).alias("keys"))
    sizes = place.select("passage", "size", "licence", "n_keys").distinct()
    return scored.join(F.broadcast(sizes), "passage").join(F.broadcast(norm), "passage") \
        .where(F.col("keys") == F.col("n_keys")) \
        .select("uid", "licence", F.round(F.col("dot") / (F.col("norm") * F.col("p_norm")), 6).alias("cosine"), "size") \
        .where(F.col("cosine") >= min_cosine)


def classify(files: DataFrame, *, uid: str, unit: str, idf: DataFrame, n_files: float,
             min_cosine: float) -> DataFrame:
    """(uid, own, cosine): the best template of every file that has one."""
    spark = files.sparkSession
    unseen = F.log(F.lit(1 + n_files)) + 1
    every = stored(idf, "idf")
    own_terms = spark.createDataFrame([(t,) for t in sorted({t for _, t, _ in template_terms()})], "term string")
    idf = every.join(F.broadcast(own_terms), "term")
    keys = [(name, t) for name, k in KEYS.items() for t in k.split()]
    key = spark.createDataFrame(keys, "licence string, term string").withColumn("key", F.lit(1))
    facts = spark.createDataFrame([(name, len(re.findall(TERM, t.lower())), len(KEYS.get(name, "").split()))
                                   for name, t in TEMPLATES.items()], "licence string, size int, n_keys int")
    post = spark.createDataFrame(template_terms(), "licence string, term string, n int").join(idf, "term") \
        .select("licence", "term", (F.col("n") * F.col("idf")).alias("w"))
    norm = post.groupBy("licence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    post = post.join(norm, "licence").join(key, ["licence", "term"], "left") \
        .select("term", "licence", (F.col("w") / F.col("t_norm")).alias("t_w"), F.coalesce("key", F.lit(0)).alias("key"))
    each = files.select(F.col(uid).alias("uid"), F.posexplode(unit).alias("no", "body"))
    terms = each.select("uid", "no", F.explode(_terms(F.col("body"))).alias("term")) \
        .groupBy("uid", "no", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = stored(terms.join(F.broadcast(idf), "term", "left")  # one row a template term
                   .withColumn("w", F.col("tf") * F.coalesce("idf", unseen)), "terms")
    length = terms.groupBy("uid", "no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = terms.join(F.broadcast(post), "term").groupBy("uid", "no", "licence") \
        .agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"), F.sum("key").alias("keys"))
    cosine = dot.join(length, ["uid", "no"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)) \
        .where(F.col("cosine") >= min_cosine).join(F.broadcast(facts), "licence") \
        .where(F.col("keys") == F.col("n_keys")).select("uid", "licence", "cosine", "size")
    both = cosine.unionByName(passage_matches(each, idf=every, unseen=unseen, min_cosine=min_cosine))
    best = both.groupBy("uid", "licence").agg(F.max("cosine").alias("cosine"),
                                              F.max(F.round(F.col("cosine") * F.col("size"), 6)).alias("matched"))
    first = F.min(F.struct((-F.col("matched")).alias("m"), (-F.col("cosine")).alias("c"), "licence", "cosine"))
    return best.groupBy("uid").agg(first.alias("b")).select("uid", F.col("b.licence").alias("own"), F.col("b.cosine").alias("cosine"))


def nearest_ancestor(dirs: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, inherited, from_dir) for the distinct directories ``dir``; ``licensed``: (dir, licence)."""
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    up = dirs.select("dir", parts.alias("p")).select("dir", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("p")), lambda k: F.when(k == 0, "").otherwise(
            F.array_join(F.slice("p", 1, F.greatest(k, F.lit(1))), "/")))).alias("from_dir"))
    met = up.join(licensed.select(F.col("dir").alias("from_dir"), "licence"), "from_dir")
    deepest = met.groupBy("dir").agg(F.max(F.length("from_dir")).alias("depth"))
    return met.join(deepest, "dir").where(F.length("from_dir") == F.col("depth")) \
        .select("dir", F.col("licence").alias("inherited"), "from_dir")


def scan(files: DataFrame, *, key: str, path: Column, text: str = "text", is_licence: Column | None = None,
         header_lines: int = 20, min_cosine: float = 0.6) -> DataFrame:
    """(key, path, own_license, cosine, license, license_from), one row a file.

    ``is_licence`` tells licence files, by default from the file name."""
    idf, n = inverse_frequencies(files, text)
    name = F.element_at(F.split(path, "/"), -1)
    given = name.rlike(LICENCE_NAME) if is_licence is None else is_licence
    body = F.coalesce(F.col(text), F.lit(""))
    rows = files.select(F.col(key).alias("key"), path.alias("path"), F.coalesce(given, F.lit(False)).alias("is_licence"),
                        body.alias("body"))
    rows = stored(rows.select("key", "path", "is_licence", F.monotonically_increasing_id().alias("uid"),
                              F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", ""))
                              .when(F.col("path").isNotNull(), "").alias("dir"),
                              units(F.col("body"), F.col("is_licence"), header_lines).alias("units")), "files")
    own = stored(classify(rows, uid="uid", unit="units", idf=idf, n_files=n, min_cosine=min_cosine), "licences")
    marked = rows.drop("units").join(own, "uid", "left")
    best = marked.where("is_licence and own is not null and dir is not null") \
        .groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "own"))["own"].alias("licence"))
    down = nearest_ancestor(rows.where("dir is not null").select("dir").distinct(), best)
    # AQE splits a directory that many files share
    out = marked.join(down, "dir", "left")
    return out.select(F.col("key").alias(key), "path", F.col("own").alias("own_license"), "cosine",
                      F.coalesce("own", "inherited").alias("license"),
                      F.when(F.col("own").isNull(), F.col("from_dir")).alias("license_from"))


def query(spark, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: source / hundreds / id. A document of
    which a quarter are licence lines stands for the licence file of its directory."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cue = f"(?i)({CUE})"
    said = F.aggregate(F.filter(F.split("text", "\n"), lambda x: x.rlike(cue)), F.lit(0), lambda a, x: a + F.length(x))
    whole = F.col("text").rlike(cue) & (4 * said >= F.length("text"))
    path = F.concat("source", F.lit("/"), F.expr("cast(doc_id div 1000 as string)"), F.lit("/"),
                    F.expr("cast(doc_id div 100 as string)"), F.lit("/"), F.col("doc_id").cast("string"))
    return scan(docs, key="doc_id", path=path, is_licence=whole)


def _oracle() -> str:
    rows = ", ".join(f"('{a}', '{t}', {n})" for a, t, n in template_terms())
    return f"""
WITH post AS (SELECT * FROM (VALUES {rows}) v(licence, term, n)),
d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS body,
  source || '/' || (doc_id // 1000) || '/' || (doc_id // 100) AS dir FROM documents),
lines AS (SELECT uid, unnest(string_split(body, chr(10))) AS line FROM d),
size AS (SELECT uid, sum(length(line)) AS said FROM lines WHERE regexp_matches(line, '(?i)({CUE})') GROUP BY uid),
f AS (SELECT d.*, coalesce(4 * said >= length(body), false) AS is_licence, said IS NOT NULL AS cue
  FROM d LEFT JOIN size USING (uid)),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT uid, unnest(regexp_extract_all(lower(body), '{TERM}')) AS term FROM d)
  WHERE term IN (SELECT term FROM post) GROUP BY term),
idf AS (SELECT DISTINCT term, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(df, 0))) + 1 AS idf FROM post LEFT JOIN df USING (term)),
tw AS (SELECT licence, term, n * idf AS w FROM post JOIN idf USING (term)),
tn AS (SELECT licence, term, w / sqrt(sum(w * w) OVER (PARTITION BY licence)) AS t_w FROM tw),
unit AS (SELECT DISTINCT uid, body FROM (
  SELECT uid, line AS body FROM lines WHERE regexp_matches(line, '(?i)({CUE})')
  UNION ALL SELECT uid, array_to_string(string_split(body, chr(10))[1:20], chr(10)) FROM f
  UNION ALL SELECT uid, body FROM f WHERE is_licence)
  WHERE regexp_matches(body, '(?i)({CUE})')),
tf AS (SELECT uid, body, term, count(*) AS tf FROM (SELECT uid, body, unnest(regexp_extract_all(lower(body), '{TERM}')) AS term FROM unit)
  GROUP BY ALL),
uw AS (SELECT uid, body, term, tf * coalesce(idf, ln(1.0 + (SELECT count(*) FROM d)) + 1) AS w FROM tf LEFT JOIN idf USING (term)),
un AS (SELECT uid, body, sqrt(sum(w * w)) AS norm FROM uw GROUP BY ALL),
cs AS (SELECT uid, licence, round(sum(w * t_w) / any_value(norm), 6) AS cosine
  FROM uw JOIN tn USING (term) JOIN un USING (uid, body) GROUP BY uid, body, licence),
own AS (SELECT uid, licence AS own, cosine FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY cosine DESC, licence) AS r
  FROM cs WHERE cosine >= 0.6) WHERE r = 1),
best AS (SELECT dir, own AS licence FROM (SELECT dir, own, row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, own) AS r
  FROM f JOIN own USING (uid) WHERE is_licence AND dir IS NOT NULL) WHERE r = 1),
down AS (SELECT dir, inherited, from_dir FROM (SELECT a.dir, b.licence AS inherited, b.dir AS from_dir,
  row_number() OVER (PARTITION BY a.dir ORDER BY length(b.dir) DESC) AS r
  FROM (SELECT DISTINCT dir FROM f) a JOIN best b ON a.dir = b.dir OR starts_with(a.dir, b.dir || '/')) WHERE r = 1)
SELECT doc_id, dir || '/' || doc_id AS path, own AS own_license, cosine, coalesce(own, inherited) AS license,
  CASE WHEN own IS NULL THEN from_dir END AS license_from
FROM f LEFT JOIN own USING (uid) LEFT JOIN down USING (dir)
"""


ORACLE = _oracle()
