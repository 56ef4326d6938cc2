"""License scans with a positional index of rare licence words.

The templates' words are posted with their positions.  For each template whose mandatory phrase a file holds, the
file looks up the words of that template that are rarest over all documents, subtracts positions, and so gets the places
where the template would have to begin; a place that explains enough words and holds the mandatory phrase gives the
template's label.  So many words vote that the others can't carry a place alone: no place is lost.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatloom.llm.rows import map_texts, plain_words

# Phrases whose places are counted, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Well-known licence notices (label, mandatory phrase, text).
TEMPLATES = (
    ("apache-2.0", "apache license version 2",
     "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at"),
    ("bsd", "redistribution and use in source and binary forms",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met"),
    ("cc-by", "creative commons attribution",
     "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-notice", "gnu general public license",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or at your "
     "option any later version"),
    ("gpl-short", "licensed under the gnu general public license version",
     "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "permission to use copy modify and or distribute this software",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit-notice", "permission is hereby granted free of charge",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the Software), to deal in the Software without restriction"),
    ("mit-short", "the mit license",
     "Released under the MIT License"),
    ("mpl", "mozilla public license",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


class TemplateIndex:
    """Words of the templates with (template, position) postings."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [t[0] for t in templates]
        self.phrases = [b" ".join(plain_words(t[1].encode())) for t in templates]
        self.texts = [plain_words(t[2].encode()) for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for n, words in enumerate(self.texts):
            for at, word in enumerate(words):
                self.postings[word].append((n, at))

    def voters(self, template: int, present, idf: dict[bytes, float], rarest: int, need: int) -> list[bytes]:
        """The template's ``rarest`` words of the file by IDF, and more until each match of ``need`` words gets its votes."""
        size: Counter = Counter(w for w in self.texts[template] if w in present)
        least, left = min(2, len(self.texts[template])), sum(size.values())
        if left < need:
            return []
        chosen = []
        for word in sorted(size, key=lambda w: (-idf.get(w, math.inf), w)):
            if len(chosen) >= rarest and left <= need - least:
                break
            chosen.append(word)
            left -= size[word]
        return chosen

    def candidates(
        self, words: list[bytes], idf: dict[bytes, float], rarest: int, share: float,
    ) -> dict[tuple[int, int], int]:
        """Votes for (template, start) by each template's words of the file with the highest IDF."""
        places = defaultdict(list)
        for at, word in enumerate(words):
            if word in self.postings:
                places[word].append(at)
        votes: Counter = Counter()
        for template, text in enumerate(self.texts):
            need = next((n for n in range(min(2, len(text)), len(text) + 1) if n / len(text) >= share), None) if text else None
            if need is None:
                continue
            for word in self.voters(template, places, idf, rarest, need):
                for other, offset in self.postings[word]:
                    if other == template:
                        for at in places[word]:
                            votes[template, at - offset] += 1
        return votes

    def matches(self, words: list[bytes], idf: dict[bytes, float], rarest: int, share: float):
        """(label, start, coverage) of the places that explain ``share`` of a template and hold its phrase."""
        found = []
        for (template, start), votes in self.candidates(words, idf, rarest, share).items():
            text = self.texts[template]
            if votes < min(2, len(text)):
                continue
            window = words[max(0, start):max(0, start + len(text))]
            skipped = max(0, -start)
            same = sum(a == b for a, b in zip(window, text[skipped:]))
            cover = same / len(text)
            if cover >= share and b" " + self.phrases[template] + b" " in b" " + b" ".join(window) + b" ":
                found.append((self.labels[template], start, cover))
        return found


def document_frequency(df: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many documents each template word stands; at most one number per template word reaches the driver."""
    vocabulary = frozenset(vocabulary)

    def start():
        def each(text):
            for word in vocabulary.intersection(plain_words(text or b"")):
                yield (word.decode("utf-8", "replace"),)
        return each

    schema = T.StructType([T.StructField("word", T.StringType())])
    return {r.word.encode(): r.n for r in
            map_texts(df, [text_col], schema, start).groupBy("word").agg(F.count("*").alias("n")).collect()}


def license_scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = BASE_PHRASES,
    templates=TEMPLATES, rarest: int = 8, share: float = 0.4,
) -> DataFrame:
    """One row per input row: counts and places of the base phrases, labels of phrases and templates, score.

    ``n_words``; ``n_base`` (all places of all phrases); ``first_word``/``last_word`` (smallest and largest word
    index where a phrase begins, else null); ``base_labels`` and ``labels`` (sorted, comma-joined, distinct);
    ``score`` (1 for a fully matching template, else its matching share, at least 0.5 with a base phrase, else 0);
    ``matches`` (array of ``label@word`` strings of verified templates, in order of place): all places with at least two
    words and ``share`` of the template and with its phrase.  ``rarest`` words of each template vote at least.
    Null and empty texts have no words, empty labels and score 0.  Repeated rows are scanned each.  The whole text
    is read; the document frequencies of the template words are counted over all rows first.
    """
    id_type = df.schema[id_col].dataType
    index = TemplateIndex(templates)
    seen = document_frequency(df, set(index.postings), text_col)
    idf = {w: -math.log(n) for w, n in seen.items()}  # the number of documents shifts all alike
    base = [(tuple(plain_words(p.encode())), label) for p, label in sorted(phrases.items())]
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("matches", T.ArrayType(T.StringType()))])

    def start():
        ends = defaultdict(list)
        for phrase, label in base:
            ends[phrase[-1]].append((phrase, label))
        rare, lasts = frozenset(index.postings), frozenset(ends)

        def each(key, text):
            words = plain_words(text or b"")
            present = rare.intersection(words)
            places, base_labels = [], set()
            for last in lasts.intersection(words):
                at = -1
                for _ in range(words.count(last)):
                    at = words.index(last, at + 1)
                    for phrase, label in ends[last]:
                        begin = at - len(phrase) + 1
                        if begin >= 0 and tuple(words[begin:at + 1]) == phrase:
                            places.append(begin)
                            base_labels.add(label)
            found = index.matches(words, idf, rarest, share) if len(present) > 1 else []
            labels = base_labels | {m[0] for m in found}
            score = max([0.5 * bool(base_labels), *(m[2] for m in found)])
            yield (key, len(words), len(places), min(places, default=None), max(places, default=None),
                   ",".join(sorted(base_labels)), ",".join(sorted(labels)), float(score),
                   [f"{m[0]}@{m[1]}" for m in sorted(found, key=lambda m: (m[1], m[0]))])
        return each

    return map_texts(df, [id_col, text_col], schema, start)
