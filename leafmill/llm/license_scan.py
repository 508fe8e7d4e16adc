"""License scans: MinHash bands over text windows, then exact shingle containment.

Only DataFrame operations.  Templates and documents become sequences of word shingles.
Windows of ``WINDOW`` shingles, ``STRIDE`` apart in documents and one apart in templates, get
one MinHash value per band; templates too short for a window are retrieved by single
shingles, which are windows of one.  A template window that a document holds unchanged
collides for certain as soon as one of the document's windows lies inside it, and one at
Jaccard similarity s with probability 1 - (1 - s)^BANDS (0.998 at 0.8), over each of the
template's windows.  Retrieved templates are confirmed by the exact share of their distinct
shingles that the document holds.  Templates with fewer words than a shingle are joined by
their whole word sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import written
from leafmill.llm.wordcols import fits_broadcast, shingles, words

WIDTH, WINDOW, STRIDE, BANDS = 5, 16, 4, 4

#: Notices and standard headers of public licenses, as their publishers word them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
}

#: Notices with fewer words than a shingle.
SHORT_NOTICES = {"all-rights-reserved-notice": "All rights reserved."}


def short_notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SHORT_NOTICES.items()), "template_id string, text string")


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "template_id string, text string")


def shingle_hashes(w: Column) -> Column:
    """64-bit hashes of the shingles of a word array, in order."""
    n = F.size(w)
    at = lambda i: [F.element_at(w, i + k) for k in range(WIDTH)]
    return (
        F.when(n == 0, F.array().cast("array<bigint>"))
        .when(n < WIDTH, F.array(F.xxhash64(w)))
        .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - WIDTH + 1, F.lit(1))), lambda i: F.xxhash64(*at(i))))
    )


def _band_keys(h: Column, stride: int) -> Column:
    """Keys of the windows of a shingle-hash array: the band number and the least value of its permutation."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(h) - WINDOW + 1, F.lit(1)), F.lit(stride))

    def band(k: int) -> Column:
        # The outer transform over one element holds the permuted array, so it is made once.
        held = F.transform(F.array(F.transform(h, lambda x: F.xxhash64(x, F.lit(k)))), lambda m: F.transform(starts, lambda i: F.array_min(F.slice(m, i, WINDOW))))
        return F.array_distinct(F.element_at(held, 1))

    return F.when(F.size(h) >= WINDOW, F.flatten(F.array(*map(band, range(BANDS))))).otherwise(F.array().cast("array<bigint>"))


def _short_matches(rows: DataFrame, short: DataFrame, widths: list[int]) -> DataFrame:
    """Rows (doc_id, w) that hold a template's whole word sequence; short has template_id and w."""
    w, n = F.col("w"), F.size("w")
    runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))
    held = rows.select("doc_id", F.explode(F.concat(*map(runs, widths))).alias("run"))
    known = short.select("template_id", F.array_join("w", " ").alias("run"))
    found = held.join(F.broadcast(known) if fits_broadcast(known, "run") else known, "run")
    return found.select("doc_id", "template_id", F.lit(1).alias("n_shared"), F.lit(1).alias("n_shingles"))


def license_matches(docs: DataFrame, templates: DataFrame | None = None, percent: int = 75) -> DataFrame:
    """(doc_id, template_id, n_shared, n_shingles): templates of which a document holds percent or more.

    docs needs doc_id and text; templates template_id and text.  Shared are the template's
    distinct word shingles that occur anywhere in the document.  Null and empty texts match
    nothing, nor do templates without words.  A template with fewer words than a shingle is
    one shingle, which a document holds if it has those words in a row anywhere.  Repeated documents give one
    row.  Rows without an id are left out, other columns are ignored, empty tables give none.
    """
    templates = default_templates(docs.sparkSession) if templates is None else templates
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    known = templates.where("template_id is not null").select("template_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    known = written(known.select("template_id", "w", F.array_distinct(shingles(F.col("w"), WIDTH)).alias("grams"), shingle_hashes(F.col("w")).alias("h")), "templates")
    short, known = known.where(F.size("w") < WIDTH).select("template_id", "w"), known.where(F.size("w") >= WIDTH).drop("w")
    widths = sorted(r[0] for r in short.select(F.size("w")).distinct().collect())
    # A document that holds percent of a long template's shingles has enough for a window.
    long = (F.size("h") >= WINDOW + STRIDE - 1) & (F.size("grams") * percent >= 100 * WINDOW)
    keys = known.select("template_id", F.explode(F.when(long, _band_keys(F.col("h"), 1)).otherwise(F.array_distinct("h"))).alias("key"), long.alias("long")).distinct()
    keys = written(keys, "keys")
    rows = docs.select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.select("doc_id", "w", shingle_hashes(F.col("w")).alias("h"))
    if keys.where("long").limit(1).count():
        windows = rows.select("doc_id", "w", F.explode(F.concat(_band_keys(F.col("h"), STRIDE), "h")).alias("key"))
    else:
        windows = rows.select("doc_id", "w", F.explode("h").alias("key"))
    shared = lambda w: F.size(F.array_intersect(F.col("grams"), shingles(w, WIDTH)))
    if fits_broadcast(keys, "key") and fits_broadcast(known.select(F.explode(F.flatten("grams")).alias("g")), "g"):
        found = windows.join(F.broadcast(keys), "key").join(F.broadcast(known), "template_id")
        found = found.select("doc_id", "template_id", shared(F.col("w")).alias("n_shared"), F.size("grams").alias("n_shingles"))
    else:
        pairs = windows.select("doc_id", "key").join(keys, "key").select("doc_id", "template_id").distinct()
        found = pairs.join(docs.dropDuplicates(["doc_id"]), "doc_id").join(known, "template_id")
        found = found.select("doc_id", "template_id", shared(words(F.col("text"))).alias("n_shared"), F.size("grams").alias("n_shingles"))
    found = found.where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
    if widths:
        found = found.unionByName(_short_matches(rows.select("doc_id", "w"), short, widths))
    return found.groupBy("doc_id", "template_id").agg(F.max("n_shared").cast("long").alias("n_shared"), F.max("n_shingles").cast("long").alias("n_shingles"))
