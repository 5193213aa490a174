"""Licence scan (native): Dice coefficient over word bigrams of normalised text against licence templates.

Segments of a text are its lines and, for each template, every window of as many words as the template has, across line
breaks (a text of fewer words is one window). So wrapped notices and notices inside a longer line are found.

Edge cases: null and empty texts have no segments and no licence; a line shorter than two words has no bigram; equal
scores go to the earliest line, then to the template named first; repeated documents keep their rows; texts of any
length are read whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The notices that are searched for, by a name for the licence.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "proprietary": "All rights reserved.",
}
THRESHOLD = 0.8
#: Control characters but the line feed; spaces, like punctuation.
CONTROLS = "".join(map(chr, [*range(1, 10), *range(11, 32), 127]))


def normalised_words(text: str) -> list[str]:
    """A template's words, as `_line_words` takes a line's."""
    kept = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text)
    return "".join(c.lower() if c.isascii() else c for c in kept).split()


def template_bigrams(templates: Mapping[str, str]) -> list[tuple[str, list[str]]]:
    out = []
    for name, text in templates.items():
        w = normalised_words(text)
        out.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:])})))
    return [(n, b) for n, b in out if b]


def anchors(grams: list[str], threshold: float) -> list[str]:
    """Bigrams of a template of which any segment at the threshold holds one.

    |A and B| >= t/2 (|A| + |B|) and |A| >= |A and B| give |A and B| >= t/(2-t) |B|, so less than the rest of B can be
    missing. The longest bigrams are taken, as the rarest.
    """
    need = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
    return sorted(grams, key=lambda b: (-len(b), b))[: len(grams) - need + 1]


def _template_table(templates: Mapping[str, str], threshold: float) -> Column:
    """The templates as a literal array of structs: name, k (order), m (words), grams, anchors, low and high (bounds of a
    segment's number of bigrams)."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    rows = []
    for k, (name, b) in enumerate(template_bigrams(templates)):
        strings = lambda xs: F.array(*map(F.lit, xs))
        rows.append(F.struct(
            F.lit(name).alias("name"), F.lit(k).alias("k"), F.lit(len(normalised_words(templates[name]))).alias("m"), strings(b).alias("grams"),
            strings(anchors(b, threshold)).alias("anchors"), F.lit(len(b) * low - 1e-9).alias("low"), F.lit(len(b) * high + 1e-9).alias("high"),
        ))
    return F.array(*rows)


def _hit(grams: Column, line: Column, t: Column) -> Column:
    """-dice first, so that the least of such structs is the best hit: of equal ones the earliest line, then template."""
    dice = F.lit(2.0) * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + F.size(t["grams"]))
    return F.struct((-dice).alias("minus"), line.cast("long").alias("line"), t["k"].alias("k"), t["name"].alias("name"))


def _bigrams(w: Column) -> Column:
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, dice, line (0-based, where the best match begins), n_matches (lines at which a match begins: each
    matching line's, and each template's best window's) and licenses (sorted names).

    Text is lower-cased (A-Z) with ASCII punctuation as space, so comment marks vanish. Dice = 2|A and B| / (|A| + |B|)
    over sets of bigrams. A text without an anchor of a template has no match and goes no further; lines and windows
    without one of a template's anchors, or outside its size bounds, aren't compared with it. Nothing that reaches the
    threshold is lost by either. One narrow stage, no shuffle.
    """
    known = [(n, b, anchors(b, threshold)) for n, b in template_bigrams(templates)]
    every = sorted({a for _, _, found in known for a in found})
    clean = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + CONTROLS, "abcdefghijklmnopqrstuvwxyz" + " " * (32 + len(CONTROLS)))
    step = docs.select(F.col(doc_id).alias("doc_id"), clean.alias("_clean"))
    none = F.array().cast("array<string>")
    step = step.withColumn("_lines", F.when(F.col("_clean").rlike(_cue(every)), F.split("_clean", "\n")).otherwise(none))
    # a word and its line, over the whole text
    placed = F.flatten(F.transform("_lines", lambda line, i: F.transform(F.array_remove(F.split(line, " +"), ""), lambda w: F.struct(w.alias("w"), i.alias("i")))))
    step = step.withColumn("_placed", placed).withColumn("_words", F.col("_placed.w")).withColumn("_bigrams", _bigrams(F.col("_words")))
    step = step.withColumn("_near", F.filter(F.transform("_bigrams", lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda x: x["b"].isin(every)))
    table = _template_table(templates, threshold)

    def windows(t: Column) -> Column:
        """The best of the template's windows that hold one of its anchors."""
        n, m = F.size("_words"), t["m"]
        at = F.filter("_near", lambda x: F.array_contains(t["anchors"], x["b"]))
        starts = F.array_distinct(F.flatten(F.transform(at, lambda x: F.sequence(F.greatest(F.lit(0), x["i"] - m + 2), F.least(x["i"], F.greatest(F.lit(0), n - m))))))
        return F.array_min(F.transform(starts, lambda s: _hit(F.array_distinct(F.slice("_bigrams", s + 1, m - 1)), F.element_at("_placed", s + 1)["i"], t)))

    def of_line(s: Column) -> Column:
        fits = F.filter(table, lambda t: (F.size(s["b"]) >= t["low"]) & (F.size(s["b"]) <= t["high"]) & F.arrays_overlap(t["anchors"], s["b"]))
        return F.array_min(F.transform(fits, lambda t: _hit(s["b"], s["line"], t)))

    # only lines that share an anchor with a template are cut into bigrams
    cued = F.filter(F.transform("_lines", lambda line, i: F.struct(line.alias("t"), i.alias("line"))), lambda s: s["t"].rlike(_cue(every)))
    step = step.withColumn("_cut", F.transform(cued, lambda s: F.struct(s["line"].alias("line"), F.array_remove(F.split(s["t"], " +"), "").alias("w"))))
    step = step.withColumn("_cut", F.transform("_cut", lambda s: F.struct(s["line"].alias("line"), F.array_distinct(_bigrams(s["w"])).alias("b"))))
    found = F.concat(F.transform("_cut", of_line), F.when(F.size("_near") > 0, F.transform(table, windows)).otherwise(F.array()))
    step = step.withColumn("_hits", F.filter(found, lambda h: h.isNotNull() & (h["minus"] <= -threshold)))
    step = step.withColumn("_best", F.array_min("_hits"))
    return step.select(
        "doc_id", F.col("_best.name").alias("license"), F.coalesce(F.round(-F.col("_best.minus"), 6), F.lit(0.0)).alias("dice"), F.col("_best.line").alias("line"),
        F.size(F.array_distinct("_hits.line")).cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("_hits.name")), ",").alias("licenses"),
    )


def _cue(found: list[str]) -> str:
    """Matches a cleaned text that holds one of the bigrams, across line breaks too; bigrams by their first word."""
    seconds: dict[str, list[str]] = {}
    for b in found:
        a, z = b.split(" ")
        seconds.setdefault(a, []).append(z)
    return r"(?<![^ \n])(?:" + "|".join(f"{a}[ \\n]+(?:{'|'.join(z)})" for a, z in seconds.items()) + r")(?![^ \n])"
