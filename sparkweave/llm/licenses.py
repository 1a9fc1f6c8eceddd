"""License scans: MinHash bands over overlapping windows retrieve license templates, exact containment verifies.

The search is :func:`sparkweave.llm.containment.search` with the templates as items: windows that
overlap by half, bands whose collision probability is stated there, and a verified share of the
template's shingles. Templates are a parameter; the default ones are short notices and the key
paragraphs of public licenses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containment

#: Public license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("MIT", "Released under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
)


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(
        [(i, name, text) for i, (name, text) in enumerate(rows)], "template_id long, license string, text string"
    )


def scan(docs: DataFrame, known: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """(doc_id, license, template_id, containment, at_word): the templates found in each document.

    Edge cases are those of containment.search: null or empty texts hold no license, repeated rows repeat their
    matches, extra columns are ignored.
    """
    known = templates(docs.sparkSession) if known is None else known
    hits = containment.search(docs, known, "template_id", threshold=threshold)
    names = known.select(F.col("template_id").cast("long").alias("item"), "license")
    return hits.join(names, "item").select(
        "doc_id", "license", F.col("item").alias("template_id"), "containment", "at_word"
    )
