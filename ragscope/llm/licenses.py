"""License scans with DataFrame functions only.

Texts are hashed to five-word shingles. A template of n shingles is looked for by windows of w shingles, w the largest power
of two up to n, that overlap by three quarters. A window's signature has one minimum of its shingles under each of 16 hash
orders, each a band of its own. A window inside a notice that keeps 80 % of the template has a similarity of at least
0.8 w / (n + 0.2 w) > 0.36 with it and so meets it in a band with probability above 1 - 0.64^16 = 0.999; several windows lie in
every notice. Every meeting is checked by exact containment of the template's shingles in the stretch around the window.

A band can only meet on the template's own minimum. Texts that hold no template's minimum at all are therefore left
before any window is made, and signatures are taken only of the windows that lie over such a place, without losing a meeting.
Before texts are hashed, those go that lack a word of every such shingle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_array, materialise, table

SHINGLE = 5
#: The hash orders: a shingle's hash XOR one of these.
ORDERS = [0x243F6A8885A308D3 * (2 * i + 1) % 2**63 for i in range(16)]
CONTAINED = 0.8
#: Notices as they are commonly written (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Hashes of all five-word shingles in order; none if there are fewer words."""
    starts = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(0), F.size(w) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))


def _minima(hashes: Column) -> Column:
    """The shingle that comes first in each order."""
    return F.transform(long_array(ORDERS), lambda o: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(o))).bitwiseXOR(o))


def template_bands(spark: SparkSession, templates: dict[str, str]) -> list:
    """Rows (license, words, all_hashes, hashes, minima), made with the same functions as the texts'; templates are a given, small set."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string").withColumn("words", words(F.col("text")))
    rows = rows.withColumn("all_hashes", shingles(F.col("words"))).withColumn("hashes", F.array_distinct("all_hashes"))
    return [r for r in rows.withColumn("minima", _minima(F.col("hashes"))).collect() if r["hashes"]]


def may_hold(text: Column, known: list) -> Column:
    """A necessary condition for a template's minimum: for one of these shingles, its two longest words."""
    anchors = set()
    for r in known:
        for i, h in enumerate(r["all_hashes"]):
            if h in r["minima"]:
                anchors.add(tuple(sorted(sorted(set(r["words"][i:i + SHINGLE]), key=lambda w: (-len(w), w))[:2])))
    def holds(low: Column) -> Column:
        out = F.lit(False)
        for first in sorted({a[0] for a in anchors}):
            seconds = [low.contains(a[-1]) for a in sorted(anchors) if a[0] == first]
            out = out | (low.contains(first) & reduce(Column.__or__, seconds))
        return out

    return F.exists(F.array(F.lower(F.coalesce(text, F.lit("")))), holds)  # lower-cased once, not in each condition


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text",
                  contained: float = CONTAINED) -> DataFrame:
    """(doc_id, license, n_found, n_shingles): one row per document row and template of which the text holds at least
    ``contained`` of the shingles within one stretch; n_found is the most in any stretch.

    Templates of fewer than five words are left out. Null, empty and shorter texts have no shingles and no row; repeated rows give
    repeated results; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    known = template_bands(spark, TEMPLATES if templates is None else templates)
    minima = sorted({m for r in known for m in r["minima"]})
    # the id, being no pure function of the row, keeps the optimiser from moving the filter below it and hashing texts twice
    hashed = (docs.where(may_hold(F.col(text), known))
              .select(F.col(doc_id).cast("long").alias("doc_id"), words(F.col(text)).alias("words"), F.monotonically_increasing_id().alias("id"))
              .select("id", "doc_id", shingles(F.col("words")).alias("hashes"), F.monotonically_increasing_id().alias("fixed")))
    # the few minima of a text are found once and then looked for at each place
    places = F.transform(F.array(F.array_intersect("hashes", long_array(minima))), lambda present: F.filter(
        F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: F.array_contains(present, F.get("hashes", i))))[0]
    hits = materialise(hashed.where(F.arrays_overlap("hashes", long_array(minima)) if minima else F.lit(False))
                       .select("id", "doc_id", "hashes", places.alias("places")), "license-rows")
    out = spark.createDataFrame([], "id long, doc_id long, license string, n_found int, n_shingles int")
    by_width: dict[int, list] = {}
    for r in known:
        by_width.setdefault(1 << (len(r["hashes"]).bit_length() - 1), []).append(r)
    for width, group in sorted(by_width.items()):
        step = max(1, width // 4)
        bands = spark.createDataFrame([(i, m, r["license"], r["hashes"]) for r in group for i, m in enumerate(r["minima"])],
                                      "band int, minimum long, license string, template array<long>")
        of_group = long_array(sorted({m for r in group for m in r["minima"]}))
        near = F.filter("places", lambda p: F.array_contains(of_group, F.get("hashes", p)))  # noqa: B023
        over = lambda p: F.sequence((F.greatest(p - width + step, F.lit(0)) / step).cast("int") * step, (p / step).cast("int") * step, F.lit(step))  # noqa: B023,E731
        starts = F.array_distinct(F.flatten(F.transform(near, over)))
        signature = lambda at: _minima(F.slice("hashes", at + 1, F.lit(width)))
        windows = (hits.select("id", "doc_id", "hashes", F.explode(F.transform(starts, lambda at: F.struct(at.alias("at"), signature(at).alias("minima")))).alias("window"))
                   .where(F.arrays_overlap("window.minima", of_group)))
        met = windows.select("id", "doc_id", "hashes", "window.at", F.posexplode("window.minima").alias("band", "minimum")).join(F.broadcast(bands), ["band", "minimum"])
        size = F.size("template")
        stretch = F.slice("hashes", F.greatest(F.col("at") - size, F.lit(0)) + 1, 2 * size + width)
        out = out.union(met.select("id", "doc_id", "license", F.size(F.array_intersect("template", stretch)).alias("n_found"), size.alias("n_shingles"))
                        .where(F.col("n_found") >= F.lit(contained) * F.col("n_shingles")))
    return out.groupBy("id", "doc_id", "license").agg(F.max("n_found").cast("long").alias("n_found"), F.max("n_shingles").cast("long").alias("n_shingles")).drop("id")


def op5_license_minhash(spark, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))
