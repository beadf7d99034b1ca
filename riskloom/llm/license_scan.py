"""Licence scan with a positional index of rare words.

Licence templates are indexed by their rarest words, rare by document frequency in the whole corpus. A file's rarest
licence words are looked up; the places that the postings of a template's words agree on, by relative position, are
candidates. At these the template's mandatory key phrase is verified word by word, which gives the label; how many of the
other words agree goes into the score alone.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import batches

#: Words of a text in UTF-8 whose A-Z are lower case: digits, letters and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())  # of bytes, lower() changes A-Z alone


@dataclass(frozen=True)
class Template:
    """text: a licence notice; key: the words of it that must stand there exactly; base: counted in n_base."""

    label: str
    text: str
    key: str
    base: bool = False
    words: list[bytes] = field(init=False, repr=False, compare=False)
    key_words: list[bytes] = field(init=False, repr=False, compare=False)
    key_at: int = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        words, key = words_of(self.text), words_of(self.key)
        places = [i for i in range(len(words)) if words[i : i + len(key)] == key]
        if not places or not key:
            raise ValueError(f"The key phrase of {self.label} is not in its text.")
        for name, value in (("words", words), ("key_words", key), ("key_at", places[0])):
            object.__setattr__(self, name, value)


#: Phrases of the registered query; each place counts.
BASE = (
    Template("cc-by", "CC BY", "cc by", True),
    Template("gpl", "General Public License", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
)

#: Short notices of well-known licences.
NOTICES = (
    Template("mit", "Released under the MIT License.", "mit license"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution and use in source and binary forms"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license version 3"),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public license version 2"),
    Template("lgpl", "licensed under the GNU Lesser General Public License", "lesser general public license"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License", "mozilla public license"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc by sa"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright, dedicated to the public domain under CC0", "cc0"),
    Template("copyright", "Copyright (c) all rights reserved", "copyright c"),
)


@dataclass(frozen=True)
class ScanSetting:
    """rare: indexed words of a template."""

    rare: int = 3


def document_frequency(documents: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many of all texts each word of the templates stands, and the number of texts.

    Only words of the templates are counted, so what reaches the driver is as long as their vocabulary.
    """

    def count(batch: pa.RecordBatch) -> pa.Table:
        seen = Counter({b"": batch.num_rows})
        for text in batch.column(0).to_pylist():
            seen.update(vocabulary.intersection(words_of(text)))
        return pa.table({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    parts = batches(documents.select(F.col("text").cast("string")), count, "word binary, n long")
    found = {bytes(r.word): r.n for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop(b"", 0)


class RareIndex:
    """Postings of the templates' rarest words: word -> [(template, position)]."""

    def __init__(self, templates: Sequence[Template], frequency: dict[bytes, int], texts: int, setting: ScanSetting):
        self.templates, self.setting = tuple(templates), setting
        self.idf = {w: float(np.log((texts + 1) / (frequency.get(w, 0) + 1))) for t in templates for w in t.words}
        self.anchors: list[list[tuple[bytes, int]]] = []  # of each template's key phrase, rarest first
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, template in enumerate(self.templates):
            places = [(w, template.key_at + i) for i, w in enumerate(template.key_words)]
            places = sorted(places, key=lambda p: (-self.idf[p[0]], p))[: setting.rare]
            self.anchors.append(places)
            for word, at in places:
                self.postings[word].append((number, at))

    def candidates(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(template, start of it in `words`) where all its indexed words agree; the start may lie before the text."""
        where: dict[bytes, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            if word in self.postings:
                where[word].append(i)
        starts: dict[int, set[int]] = {}
        met: Counter[int] = Counter()
        for word in sorted(where, key=lambda w: (-self.idf[w], w)):  # the file's rarest licence word first
            for number, at in self.postings[word]:
                if met[number] and not starts[number]:
                    continue
                here = {i - at for i in where[word]}
                starts[number] = starts[number] & here if met[number] else here
                met[number] += 1
        for number, found in starts.items():
            if met[number] == len(self.anchors[number]):
                yield from ((number, start) for start in sorted(found))

    def places(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(start of the key phrase, its length, template, share of the template's words that agree), verified."""
        found = []
        for number, start in self.candidates(words):
            template = self.templates[number]
            at = start + template.key_at
            if at < 0 or words[at : at + len(template.key_words)] != template.key_words:
                continue
            same = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(template.words))
            found.append((at, len(template.key_words), number, same / len(template.words)))
        return sorted(found)


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, places array<struct<label: string, start: long, length: long>>"
)
PLACE = pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
TYPES = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("places", pa.list_(PLACE))]
)


def scan(documents: DataFrame, templates: Sequence[Template] = BASE + NOTICES, setting: ScanSetting = ScanSetting()) -> DataFrame:
    """Licences in every row of `documents` (doc_id, text).

    Returns doc_id, n_words, n_base (places of base templates), first_word and last_word (the smallest and the largest
    start among them, null without any), base_labels and labels (distinct, sorted, joined by commas), score (the best
    agreement with a template, 0 without any) and places (label, first word and length of each key phrase). A null text
    is empty: no words, no labels. Repeated rows give repeated results; other columns are ignored.
    """
    vocabulary = {w for t in templates for w in t.words}
    frequency, texts = document_frequency(documents, vocabulary)
    index = RareIndex(templates, frequency, texts, setting)

    def find(batch: pa.RecordBatch) -> pa.Table:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            places = [(templates[number], at, length, share) for at, length, number, share in index.places(words)]
            base = [(t.label, at) for t, at, _, _ in places if t.base]
            starts = [at for _, at in base]
            rows.append(
                (
                    doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({label for label, _ in base})), ",".join(sorted({t.label for t, *_ in places})),
                    max((share for *_, share in places), default=0.0),
                    [{"label": t.label, "start": at, "length": length} for t, at, length, _ in places],
                )
            )
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), TYPES)], schema=TYPES)

    return batches(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), find, SCHEMA)
