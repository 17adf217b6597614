"""Licence scans: headers and licence files by TF-IDF cosine to templates, and inheritance down directories.

Every line of a text (a header is a line), every paragraph and the text as a whole (a licence file
is the licence) is compared with every template.  Vectors are sparse: a weight
per term of the templates, and one number for the length of all other terms.
Inverse document frequencies come from all texts of the collection.

A file without a licence of its own inherits the one of its nearest ancestor
directory that holds a licence file, by a join of ancestor paths.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import carried, keep
from pricetide.llm.words import U, blocks, join_texts, runs, span_hashes, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The usual wordings of notices and the openings of licence files.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["CC0 1.0 Universal public domain dedication"],
    "Proprietary": ["All rights reserved."],
}
THRESHOLD = 0.8
#: Names of licence files.
FILE_NAMES = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)(?:[-_.][^/]*)?$"
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
PARAGRAPHS = re.compile(rb"\n[ \t\r]*\n")


def terms(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each term in order: its text, its hash, and where it begins in the joined bytes; A-Z lower-cased."""
    data, begins = join_texts([x.lower() for x in encoded])
    starts, ends = runs(TERM[data])
    return np.searchsorted(begins, starts, side="right") - 1, span_hashes(data, starts, ends), starts


def vocabulary(templates: dict[str, list[str]]) -> np.ndarray:
    return np.unique(terms([t.encode() for ts in templates.values() for t in ts])[1])


def _frequencies(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for _, encoded in blocks(batch.column(0).to_pylist()):
                text, hashed, _ = terms(encoded)
                at = np.searchsorted(known, hashed).clip(max=len(known) - 1)
                hit = known[at] == hashed
                pairs = np.unique(text[hit] * len(known) + at[hit])
                total += np.bincount(pairs % len(known), minlength=len(known))
                count += len(encoded)
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(known)), -1]), pa.array([*total.tolist(), count])], names=["term", "n"])

    return run


def fit(docs: DataFrame, templates: dict[str, list[str]]) -> dict:
    """Template vectors with inverse document frequencies from all texts; one count per template term reaches the driver."""
    known = vocabulary(templates)
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_frequencies(known), "term long, n long")
    n = {r["term"]: r["sum(n)"] for r in rows.groupBy("term").agg(F.sum("n")).collect()}
    total = n.get(-1) or 0
    idf = np.array([np.log((1 + total) / (1 + (n.get(i) or 0))) + 1 for i in range(len(known))])
    names, vectors = [], []
    for name, wordings in templates.items():
        for wording in wordings:
            at = np.searchsorted(known, terms([wording.encode()])[1])
            v = np.bincount(at, minlength=len(known)) * idf
            names.append(name)
            vectors.append(v / np.linalg.norm(v))
    return {"known": known, "idf": idf, "other": float(np.log(1 + total) + 1), "names": names, "vectors": np.array(vectors)}


def best_match(unit: np.ndarray, count: int, hashed: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``count`` units (``unit`` numbers the terms'): the most similar template and the cosine; the first of equals."""
    best, score = np.zeros(count, np.int64), np.zeros(count)
    known = model["known"]
    at = np.searchsorted(known, hashed).clip(max=len(known) - 1)
    hit = known[at] == hashed
    if not hit.any():
        return best, score
    touched = np.unique(unit[hit])
    # the length of terms outside the templates: their counts, squared and weighted, per unit
    mine = np.isin(unit, touched)
    u, h, a, k = np.searchsorted(touched, unit[mine]), hashed[mine], at[mine], hit[mine]
    order = np.lexsort((h, u))
    u, h, a, k = u[order], h[order], a[order], k[order]
    first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (h[1:] != h[:-1])]))
    tf = np.diff(np.append(first, len(u)))
    u, a, k = u[first], a[first], k[first]
    weight = tf * np.where(k, model["idf"][a], model["other"])
    length = np.sqrt(np.bincount(u, weight * weight, minlength=len(touched)))
    for low in range(0, len(touched), 4096):
        part = k & (u >= low) & (u < low + 4096)
        dense = np.zeros((min(4096, len(touched) - low), len(known)))
        dense[u[part] - low, a[part]] = weight[part]
        cosine = dense @ model["vectors"].T / length[low : low + 4096, None]
        best[touched[low : low + 4096]] = cosine.argmax(axis=1)
        score[touched[low : low + 4096]] = cosine.max(axis=1)
    return best, score


def _scan(shared, threshold: float, at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out: list[tuple] = []
            for _, encoded in blocks(text_of(batch, at).to_pylist()):
                text, hashed, starts = terms(encoded)
                data, _ = join_texts(encoded)
                line = np.searchsorted(np.flatnonzero(data == 10), starts)
                joined = data.tobytes()
                breaks = np.array([m.start() for m in PARAGRAPHS.finditer(joined)], np.int64)
                paragraph = np.searchsorted(breaks, starts) + text  # texts are apart, too
                found = []
                for unit in (text, line, paragraph):
                    values, number = np.unique(unit, return_inverse=True)
                    best, score = best_match(number, len(values), hashed, model)
                    # per text the best of its units, the first of equals
                    owner = text[np.searchsorted(unit, values)]
                    per_text, names = np.zeros(len(encoded)), np.full(len(encoded), -1)
                    order = np.lexsort((np.arange(len(values)), -score))[::-1]
                    per_text[owner[order]], names[owner[order]] = score[order], best[order]
                    found.append((names, per_text))
                for i in range(len(encoded)):
                    whole, header = found[0][1][i], max(found[1][1][i], found[2][1][i])
                    kind = "file" if whole >= threshold else "header" if header >= threshold else None
                    which = 0 if kind == "file" else 1 if found[1][1][i] >= found[2][1][i] else 2
                    out.append((model["names"][found[which][0][i]], kind, float(found[which][1][i])) if kind else (None, None, float(max(whole, header))))
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "license", "origin", "similarity"])

    return run


def scan(docs: DataFrame, carry: list[str], templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``carry`` of ``docs(text)`` with ``license``, ``origin`` and ``similarity``.

    ``origin`` is ``file`` where the whole text reaches the threshold, else ``header`` where a
    line or paragraph does, else null, as is ``license``.  ``similarity`` is the largest cosine.  Null
    and empty texts have none and 0.  Ties go to the earlier unit and template.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, templates))
    rows, at = carried(docs, carry)
    out = rows.mapInArrow(_scan(shared, threshold, at), f"row {rows.schema['row'].dataType.simpleString()}, license string, origin string, similarity double")
    return out.select("row.*", "license", "origin", "similarity")


def folder_of(path: Column) -> Column:
    """The directory a path is in; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(scanned: DataFrame) -> DataFrame:
    """``scanned(path, license, origin, similarity, ...)`` with licences handed down; adds ``from_folder``.

    A licence file is one whose whole text is a licence, or one named like a
    licence file that holds a licence.  A directory has the licence of its most similar
    licence file, the first name of equals.  A row without a licence takes that
    of its nearest ancestor directory that has one: ``origin`` becomes ``inherited`` and
    ``from_folder`` names the directory.  Null paths inherit nothing.  Rows that repeat
    are treated alike.
    """
    scanned = keep(scanned)
    is_file = F.col("license").isNotNull() & ((F.col("origin") == "file") | F.col("path").rlike(FILE_NAMES))
    best = F.min(F.struct((-F.col("similarity")).alias("far"), F.col("license").alias("license")))
    granted = scanned.where(is_file & F.col("path").isNotNull()).groupBy(folder_of(F.col("path")).alias("folder")).agg(best.alias("best"))
    granted = granted.select("folder", F.col("best.license").alias("granted"))
    # directories, not files, look for their ancestors
    own = scanned.where("license is null and path is not null").select(folder_of(F.col("path")).alias("own")).distinct()
    parts = F.split("own", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    nearest = (
        own.select("own", F.explode(F.array_distinct(above)).alias("folder"))
        .join(granted, "folder")
        .groupBy("own")
        .agg(F.max(F.struct(F.length("folder").alias("depth"), F.col("folder").alias("folder"), F.col("granted").alias("granted"))).alias("near"))
    )
    handed = nearest.select(F.col("own").alias("own_folder"), F.col("near.granted").alias("granted"), F.col("near.folder").alias("from_folder"))
    needs = F.when(F.col("license").isNull(), folder_of(F.col("path")))
    out = scanned.withColumn("own_folder", needs).join(handed, "own_folder", "left")
    rest = [F.col(f"`{c}`") for c in scanned.columns if c not in ("license", "origin", "from_folder")]
    origin = F.coalesce("origin", F.when(F.col("granted").isNotNull(), "inherited"))
    return out.select(*rest, F.coalesce("license", "granted").alias("license"), origin.alias("origin"), "from_folder")
