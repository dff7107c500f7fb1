"""License scans by diagonal voting of word k-grams; DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.staging import stage

K = 5
NEAR = 3  # diagonals this close are one passage with words put in or left out
DRIFT = 12  # most words put in or left out of one passage
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Openings and notices of widely used licenses.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def words_of(text: Column) -> Column:
    """Lower-case words.  Letters outside ASCII fold too, which no phrase or template can see."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def gram_rows(words: Column, own: Column, k: int = K) -> Column:
    """Array of the k words from each place, the last k-1 lack some; ``own`` stands in the first element, which is there without words too."""
    return F.arrays_zip(*[(words if i == 0 else F.slice(words, i + 1, F.size(words))).alias(f"w{i}") for i in range(k)], F.array(own).alias("own"))


def template_rows(spark, k: int = K) -> DataFrame:
    """template, label, place, words and hash of every k-gram, and the template's number of k-grams; as many rows as the fixed texts have words."""
    rows = []
    for t, (label, text) in enumerate(TEMPLATES):
        own = re.findall(r"[a-z0-9]+", text.lower())
        rows += [(t, label, i, len(own) - k + 1, *own[i : i + k]) for i in range(len(own) - k + 1)]
    names = [f"w{i}" for i in range(k)]
    out = spark.createDataFrame(rows, "template int, label string, place int, grams int, " + ", ".join(f"{n} string" for n in names))
    return out.select("template", "label", "place", "grams", F.array(*names).alias("t_words"), F.xxhash64(*names).alias("t_hash"))


def phrase_places(words: Column) -> Column:
    """Array of (start, label) wherever a phrase's words stand consecutively."""
    def places(phrase: str, label: str) -> Column:
        own = phrase.split(" ")
        here = lambda i: F.forall(F.array(*[F.coalesce(F.try_element_at(words, i + j) == w, F.lit(False)) for j, w in enumerate(own)]), lambda x: x)
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - len(own) + 1, F.lit(1))), here)
        return F.transform(at, lambda i: F.struct((i - 1).cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*[places(phrase, label) for phrase, label in PHRASES])


def merged(lines: Column) -> Column:
    """Groups (places, from, to, size) of neighbouring diagonals, from ``lines`` (diagonal, from, to, places) in order.

    A diagonal joins the group before it if it is ``NEAR`` the last one and not more than
    ``DRIFT`` from the group's first.
    """
    kind = "struct<first:int,last:int,places:array<int>,from:int,to:int>"

    def step(groups, x):
        own = F.element_at(groups, -1)
        near = (F.size(groups) > 0) & (x["diagonal"] - own["last"] <= NEAR) & (x["diagonal"] - own["first"] <= DRIFT)
        fresh = lambda first, places, start, end: F.struct(first.alias("first"), x["diagonal"].alias("last"), places.alias("places"), start.alias("from"), end.alias("to"))
        joined = fresh(own["first"], F.array_union(own["places"], x["places"]), F.least(own["from"], x["from"]), F.greatest(own["to"], x["to"]))
        return F.when(near, F.array_append(F.slice(groups, 1, F.size(groups) - 1), joined)).otherwise(F.array_append(groups, fresh(x["diagonal"], x["places"], x["from"], x["to"])))

    return F.aggregate(lines, F.array().cast(f"array<{kind}>"), step)


def scan(docs: DataFrame, coverage: float = 0.6, density: float = 0.5) -> DataFrame:
    """Per row of ``docs``: its words, base phrases, labels with those the voting adds, and the verified spans.

    Every k-gram of a text is joined by hash to the template places that have it, and votes,
    where the words are the same, for the diagonal ``text place - template place``.  Diagonals
    ``NEAR`` apart or less are merged, up to ``DRIFT`` in all.  A merged group is verified if its
    distinct places cover ``coverage`` of the template's k-grams, and these make up ``density``
    of the k-grams of its span in the text.  ``spans`` lists label:start:end of verified spans
    (words, end exclusive).  ``score`` is 1 with a base phrase, else the best coverage, else 0.
    Null texts are empty; repeated rows are reported each.  The templates are a fixed text, so
    they are broadcast.  A text is parted into words once; its base and its votes are written.
    """
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    own = F.struct(F.size("words").cast("long").alias("n_words"), F.when(F.array_contains("words", "license"), phrase_places(F.col("words"))).otherwise(none).alias("base"))
    grams = words.select("row", "doc_id", F.posexplode(gram_rows(F.col("words"), own)))  # a text's own facts go with its first k-gram only
    parts = [F.col(f"col.w{i}") for i in range(K)]
    grams = grams.select("row", "doc_id", F.col("pos").alias("at"), F.col("col.own").alias("own"), F.when(parts[-1].isNotNull(), F.xxhash64(*parts)).alias("hash"), *[w.alias(f"w{i}") for i, w in enumerate(parts)])
    same = F.array(*[f"w{i}" for i in range(K)]) == F.col("t_words")  # looked at where hashes agree only
    hits = grams.join(F.broadcast(template_rows(docs.sparkSession)), F.col("hash") == F.col("t_hash"), "left")
    hits = hits.select("row", "doc_id", "at", (F.col("at") == 0).alias("head"), "own", F.when(F.col("template").isNotNull(), F.when(same, F.col("template"))).alias("template"), "label", "place", "grams")
    hits = stage(hits.where(F.col("head") | F.col("template").isNotNull()))
    # the first k-gram's row comes once for each template place that it votes for
    base = hits.where("head").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("own").alias("own"))

    key = ["row", "template"]
    votes = hits.where("template is not null").groupBy(*key, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.first("label").alias("label"), F.first("grams").alias("grams"), F.min("at").alias("from"), F.max("at").alias("to"), F.collect_set("place").alias("places"))
    lines = votes.groupBy(*key).agg(F.first("label").alias("label"), F.first("grams").alias("grams"), F.array_sort(F.collect_list(F.struct("diagonal", "from", "to", "places"))).alias("lines"))
    groups = lines.select("row", "label", "grams", F.explode(merged(F.col("lines"))).alias("g"))
    cover = F.size("g.places") / F.col("grams")
    sure = groups.where((cover >= coverage) & (F.size("g.places") >= density * (F.col("g.to") - F.col("g.from") + 1)))
    named = sure.groupBy("row").agg(F.collect_set("label").alias("voted"), F.max(cover).alias("cover"), F.array_sort(F.collect_list(F.struct(F.col("g.from").alias("start"), (F.col("g.to") + K).alias("end"), "label"))).alias("found"))
    out = base.join(named, "row", "left").select("doc_id", "own.*", "voted", "cover", "found")
    starts, own = F.transform("base", lambda b: b["start"]), F.array_distinct(F.transform("base", lambda b: b["label"]))
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, F.coalesce("voted", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).cast("double").alias("score"),
        F.array_join(F.transform(F.coalesce("found", F.array().cast("array<struct<start:int,end:int,label:string>>")), lambda f: F.concat_ws(":", f["label"], f["start"].cast("string"), f["end"].cast("string"))), ",").alias("spans"),
    )
