"""Licence scan with a positional index of rare licence words.

Words are the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. The inverse
document frequency of every template word is counted over all documents. Each template has its own
rare words: those of highest IDF, however common, that hold at least twice the weight that a place
may lack. A file is searched for every template whose mandatory phrases it holds: each occurrence of
a rare word is looked up in the postings (position in the template), and points to the places at
`document position - template position`, give or take `slack` words. A place is accepted if the
IDF-weighted share of template words found there reaches `least` and the template's mandatory phrases
stand in it; places where too few rare words are found to reach `least` with all the others are
passed over, so no acceptable place is lost. Of neighbouring places with equal shares the one with
more words exactly in place counts. Long files are searched a piece at a time.

Besides, the fixed base phrases are found wherever their words stand consecutively.
Nulls are texts without words; they have no labels and score 0. The score is 1 where a base phrase
stands, else the best accepted share. Repeated documents are scanned alike.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import prepare
from .decontaminate import words_of

# Phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label, opening words of the usual notice, mandatory phrases.
TEMPLATES = [
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3", ["gnu affero general public license", "version 3"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "version 2"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("bsl-1", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike 4 0"]),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related rights to this work to the public domain worldwide", ["public domain", "to the extent possible under law"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2", ["gnu general public license", "version 2"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3", ["gnu general public license", "version 3"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("lgpl-2", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1", ["gnu lesser general public license", "version 2 1"]),
    ("lgpl-3", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license version 3", ["gnu lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["free of charge", "without restriction"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["held liable for any damages"]),
]

RESULT = "n_words long, base_starts array<int>, base_labels array<string>, places array<struct<label: string, start: int, share: double>>"


class TemplateIndex:
    """Templates with their words' weights, and postings of each word. Small: it holds templates only."""

    def __init__(self, idf: dict[bytes, float], templates=None, phrases=None):
        self.templates = [(label, t.encode().split(), [k.encode().split() for k in keys]) for label, t, keys in (TEMPLATES if templates is None else templates)]
        self.phrases = [(b" " + b" ".join(p.encode().split()) + b" ", label) for p, label in (BASE_PHRASES if phrases is None else phrases).items()]
        self.idf = idf
        self.vocabulary = frozenset(w for _, words, _ in self.templates for w in words)
        self.keys = [[b" " + b" ".join(key) + b" " for key in keys] for _, _, keys in self.templates]
        self.weights = [[idf.get(w, 0.0) + 0.1 for w in words] for _, words, _ in self.templates]
        self.found: dict[tuple[int, float], tuple[dict[bytes, list[int]], float]] = {}

    def rare(self, t: int, least: float) -> tuple[dict[bytes, list[int]], float]:
        """Positions of the template's rare words, and the weight of them that an acceptable place holds at least."""
        if (t, least) in self.found:
            return self.found[t, least]
        _, words, _ = self.templates[t]
        weights, postings, held = self.weights[t], {}, 0.0
        total = sum(weights)
        for word in sorted(set(words), key=lambda w: (-self.idf.get(w, 0.0), w)):
            if held >= 2 * (1 - least) * total and len(postings) > 1:
                break
            postings[word] = [at for at, w in enumerate(words) if w == word]
            held += sum(weights[at] for at in postings[word])
        self.found[t, least] = postings, held - (1 - least) * total
        return self.found[t, least]

    def base(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start, label) of all places of base phrases; places may overlap."""
        if not words:
            return []
        line = self.line(words)
        found = []
        for phrase, label in self.phrases:
            at, last, start = line.find(phrase), 0, 0
            while at >= 0:
                start += line.count(b" ", last, at)
                found.append((start, label))
                last, at = at, line.find(phrase, at + 1)
        return sorted(found)

    @staticmethod
    def line(words: list[bytes]) -> bytes:
        return b" " + b" ".join(words) + b" "

    def places(self, words: list[bytes], slack: int, least: float) -> list[tuple[str, int, float]]:
        """(label, start, share) of the best accepted place per template and neighbourhood."""
        if not words:
            return []
        line = self.line(words)
        best: dict[tuple[str, int], tuple[float, float, int]] = {}
        positions: dict[bytes, np.ndarray] | None = None
        for t, (label, template, keys) in enumerate(self.templates):
            if not template or not all(key in line for key in self.keys[t]):
                continue
            if positions is None:
                lists = defaultdict(list)
                for at, word in enumerate(words):
                    if word in self.vocabulary:
                        lists[word].append(at)
                positions = {word: np.array(at) for word, at in lists.items()}
            for start in self.starts(positions, t, len(words), slack, least):
                share = self.share(words, t, start, slack)
                if share >= least and all(self.stands(words, key, start - slack, start + len(template) + slack) for key in keys):
                    cell = (label, start // (len(template) + 2 * slack))
                    best[cell] = max(best.get(cell, (0.0, 0.0, 0)), (share, self.share(words, t, start, 0), -start))
        return sorted((label, max(0, -start), share) for (label, _), (share, _, start) in best.items())

    def starts(self, positions: dict[bytes, np.ndarray], t: int, n: int, slack: int, least: float, piece: int = 65_536):
        """Places to which enough weight of the template's rare words points, a piece of the file at a time."""
        postings, needed = self.rare(t, least)
        first, end = -len(self.templates[t][1]) - slack, n + slack
        for low in range(first, end, piece):
            high = min(low + piece, end)
            weight = np.zeros(high - low)
            for word in postings.keys() & positions.keys():
                at = positions[word]
                for pos in postings[word]:
                    some = at[np.searchsorted(at, low + pos - slack) : np.searchsorted(at, high + pos + slack)] - pos - low
                    pointed = np.zeros(high - low, dtype=bool)
                    for shift in range(-slack, slack + 1):
                        moved = some + shift
                        pointed[moved[(moved >= 0) & (moved < high - low)]] = True
                    weight += pointed * self.weights[t][pos]
            yield from (low + np.flatnonzero(weight >= needed - 1e-9)).tolist()

    def share(self, words: list[bytes], t: int, start: int, slack: int) -> float:
        template, weights = self.templates[t][1], self.weights[t]
        found = sum(weight for j, (w, weight) in enumerate(zip(template, weights)) if w in words[max(0, start + j - slack) : max(0, start + j + slack + 1)])
        return found / sum(weights)

    @staticmethod
    def stands(words: list[bytes], phrase: list[bytes], low: int, high: int) -> bool:
        line = TemplateIndex.line(words[max(0, low) : max(0, high)])
        return b" " + b" ".join(phrase) + b" " in line


def licence_word_idf(docs: DataFrame, *, text: str = "text", templates=None) -> dict[bytes, float]:
    """IDF of the template words over all documents; the driver gets one row per template word."""
    prepare(docs.sparkSession)
    vocabulary = TemplateIndex({}, templates).vocabulary

    def count(batches):
        seen: dict[bytes, int] = defaultdict(int)
        rows = 0
        for batch in batches:
            rows += len(batch)
            for t in batch["t"]:
                for word in vocabulary.intersection(words_of(t)):
                    seen[word] += 1
        yield pd.DataFrame({"word": ["", *(w.decode() for w in seen)], "n": [rows, *seen.values()]})

    sums = docs.select(F.col(text).alias("t")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {row.word.encode(): row.n for row in sums.collect()}
    total = n.pop(b"", 0)
    return {w: math.log((total + 1) / (n.get(w, 0) + 1)) for w in vocabulary}


def scan_licenses(
    docs: DataFrame, *, text: str = "text", into: str = "licenses", templates=None, phrases=None, slack: int = 1, least: float = 0.7
) -> DataFrame:
    """`docs` with a struct column `into`: n_words, base phrase places and labels, template places."""
    index = TemplateIndex(licence_word_idf(docs, text=text, templates=templates), templates, phrases)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    @pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = words_of(t)
            base = sent.value.base(words)
            places = [{"label": a, "start": b, "share": c} for a, b, c in sent.value.places(words, slack, least)]
            rows.append((len(words), [a for a, _ in base], [b for _, b in base], places))
        return pd.DataFrame(rows, columns=["n_words", "base_starts", "base_labels", "places"], dtype=object)

    return docs.withColumn(into, scan(F.col(text)))


def license_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = scan_licenses(docs.select("doc_id", "text"), **options)
    both = F.array_sort(F.array_distinct(F.concat("licenses.base_labels", F.transform("licenses.places", lambda p: p["label"]))))
    return found.select(
        "doc_id",
        F.col("licenses.n_words").alias("n_words"),
        F.size("licenses.base_starts").cast("long").alias("n_base"),
        F.array_min("licenses.base_starts").cast("long").alias("first_word"),
        F.array_max("licenses.base_starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("licenses.base_labels")), ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size("licenses.base_starts") > 0, 1.0)
        .otherwise(F.coalesce(F.array_max(F.transform("licenses.places", lambda p: p["share"])), F.lit(0.0)))
        .alias("score"),
    )
