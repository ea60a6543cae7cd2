"""License scans: MinHash bands over text windows retrieve templates, containment verifies.

Native: Spark expressions and one broadcast join with the templates' bands; no
Python on the workers, no shuffle of texts. A text becomes the array of hashes of
its five-word shingles. Texts that hold no shingle of any template, nearly all,
leave here; a window without one can neither share a band nor be contained.

Templates of m shingles are looked for in windows of W shingles, W the power of
two from 2m on, that begin every W / 2 shingles: whatever stretch of m shingles
there is lies inside one. W is below 4m, so a window that holds the share c of
the template has a Jaccard similarity of at least c / (5 - c) with it, and there
are as many one-row bands as find that with the target recall. A retrieved
template is reported if the window holds that share of its shingles, counted
exactly.

Result: a row for each document and template found: doc_id, license, the largest
containment, the first word of its first window's match and how many windows
match. Templates with fewer than five words are refused.

Edge cases: a null or empty text, or one of fewer than five words, has no
finding; repeated rows of a doc_id give one row for each template, as do rows
with a null doc_id; equal containments keep the first place; an empty table
gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common

# fixed values: public license notices, by a short name
TEMPLATES = {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class LicenseParams:
    words: int = 5
    containment: float = 0.8
    recall: float = 0.9995
    #: Templates together may have at most so many shingles; bounds what is broadcast.
    max_shingles: int = 200_000

    def bands(self) -> int:
        """One-row bands that find the least similar window with the target recall."""
        c = self.containment
        return math.ceil(math.log(1 - self.recall) / math.log1p(-(c / (5 - c))))


def _shingles(text: Column, k: int) -> Column:
    """Hashes of the k-word shingles of a text, in order; empty if it has fewer words."""
    split = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK), "")
    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
    return common.let(split, lambda w: F.when(F.size(w) >= k, common.let(w, hashes)).otherwise(F.array().cast("array<bigint>")))


def _least(window: Column, bands: int) -> Column:
    """The smallest hash of a window's shingles under each band's function."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.array_min(F.transform(window, lambda x: F.xxhash64(x, b))))


def scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES, p: LicenseParams = LicenseParams()) -> DataFrame:
    """doc_id, license, containment, begin_word, n_windows for every document and template that it holds."""
    spark = documents.sparkSession
    table = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    table = table.select("license", F.array_distinct(_shingles(F.col("text"), p.words)).alias("own"))
    found = table.collect()  # the templates, bounded below
    if any(not r.own for r in found):
        raise ValueError(f"templates need {p.words} words: " + ", ".join(r.license for r in found if not r.own))
    known = sorted({x for r in found for x in r.own})
    if len(known) > p.max_shingles:
        raise ValueError("the templates are too large")
    if not known:
        return documents.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("begin_word"), F.lit(0).cast("long").alias("n_windows")).limit(0)
    width = lambda m: 1 << (2 * m - 1).bit_length()
    widths = sorted({width(len(r.own)) for r in found})

    # shingles come from the row once; where any is a template's, its places are listed
    hashed = documents.select("doc_id", common.let(_shingles(F.col("text"), p.words), lambda h: F.struct(
        h.alias("all"), F.array_compact(F.transform(h, lambda x, i: F.when(x.isin(known), i))).alias("at"))).alias("h"))
    windows = hashed.where(F.size("h.at") > 0).withColumn("width", F.explode(F.array(*map(F.lit, widths))))
    starts = F.expr("filter(array_distinct(flatten(transform(h.at, i -> array(i div (width div 2), i div (width div 2) - 1)))), s -> s >= 0)")
    windows = windows.select("doc_id", "width", F.col("h.all").alias("all"), F.explode(starts).alias("s")).select(
        "doc_id", "width", (F.col("s") * (F.col("width") / 2)).cast("int").alias("start"), F.expr("slice(all, int(s * (width div 2)) + 1, width)").alias("window"))
    banded = windows.select("*", F.posexplode(_least(F.col("window"), p.bands())).alias("band", "least"))
    sizes = F.create_map(*(F.lit(x) for m in {len(r.own) for r in found} for x in (m, width(m))))
    keyed = table.withColumn("width", sizes[F.size("own")]).select("license", "own", "width", F.posexplode(_least(F.col("own"), p.bands())).alias("band", "least"))
    near = banded.join(F.broadcast(keyed), ["width", "band", "least"])  # bounded by max_shingles
    held = F.size(F.array_intersect("own", "window")) / F.size("own")
    begin = F.col("start") + F.array_position(F.transform("window", lambda x: F.array_contains("own", x)), True) - 1
    judged = near.select("doc_id", "license", "start", "width", held.alias("containment"), begin.cast("long").alias("begin_word")).where(F.col("containment") >= p.containment)
    whole = judged.groupBy("doc_id", "license", "start").agg(F.max("containment").alias("containment"), F.min("begin_word").alias("begin_word"))
    return whole.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min_by("begin_word", F.struct(-F.col("containment"), "begin_word")).alias("begin_word"), F.count("*").alias("n_windows"))


def op6_licenses(spark: SparkSession, sf_dir: str, params: LicenseParams = LicenseParams()) -> DataFrame:
    """License notices in every document."""
    return scan(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"), TEMPLATES, params)
