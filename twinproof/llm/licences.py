"""Licence scans with a positional index of rare words.

Licence notices are templates: words at relative positions, a least share of them that must stand, and
key phrases that must be there. Counting in how many of all documents each template word occurs gives its inverse
document frequency. Of a template of m words that needs k of them, the m - k + 1 rarest positions are
indexed: any text that holds k words of the template holds one of those, so a lookup of a file's rarest licence
words misses nothing. Each lookup gives a relative position (place in the file less place in the template);
postings of one template are intersected within ``SLACK`` words around it (words may be inserted or lost), and a
place counts if k template words stand there and every key phrase stands in one piece within its words.

The base phrases are templates of which every word must stand, without slack; only their rarest word is looked up.

Templates are a parameter that the driver holds, so index and word counts are bounded by it; documents are read
twice (counts, places) and never shuffled.

Defined results: a null text has no words; a document without places has an empty list; repeated rows get equal
rows; overlapping places of one template give the one with most words (the first of equals), and of a base phrase all;
an empty table gives an empty table; extra columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import columns
from twinproof.llm.decontaminate import word_spans, words_of

#: Words by which a template's parts may be displaced.
SLACK = 2
#: Share of a notice's words that must stand.
SHARE = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()
    share: float = SHARE
    slack: int = SLACK
    base: bool = False

    @property
    def words(self) -> list[str]:
        return [w.decode() for w in words_of(self.text)]

    @property
    def need(self) -> int:
        """Template words that must stand; a millionth is let off for rounding."""
        return max(1, math.ceil(self.share * len(self.words) - 1e-6))


def phrase(label: str, text: str) -> Template:
    return Template(label, text, (text,), 1.0, 0, True)


# The base phrases with their labels, and sentences of public licence notices.
TEMPLATES = (
    phrase("cc-by", "cc by"),
    phrase("gpl", "general public license"),
    phrase("reserved", "all rights reserved"),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "released into the public domain under cc0 1 0 universal", ("cc0",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license", "version 3")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license", "version 2")),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
             "http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files the software to deal in the software without restriction",
             ("permission is hereby granted free of charge", "without restriction")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("with or without fee",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
             "the following conditions are met", ("source and binary forms", "following conditions")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
             "license as published by the free software foundation", ("gnu general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
)


def document_counts(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """(documents, {template word: documents with it}) over all documents; one number a template word reaches the driver."""
    known = frozenset(w for t in templates for w in t.words)
    raw = {w.encode(): w for w in known}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total.update(raw.keys() & set(words_of(text)))
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([raw[w] for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    texts = columns(docs, text="text")
    counted = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return texts.count(), {r.word: r.n for r in counted.collect()}


class Index:
    """Postings of each template's rarest positions, and the checks of a place."""

    def __init__(self, templates: tuple[Template, ...], n_docs: int, counts: dict[str, int]):
        self.templates = [t for t in templates if t.words]
        idf = lambda w: math.log((n_docs + 1) / (counts.get(w, 0) + 1))
        self.words = [[w.encode() for w in t.words] for t in self.templates]
        self.keys = [[words_of(k) for k in t.keys] for t in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, t in enumerate(self.templates):
            order = sorted(range(len(t.words)), key=lambda i: (-idf(t.words[i]), t.words[i], i))
            for i in order[: len(t.words) - t.need + 1]:
                self.postings[t.words[i].encode()].append((number, i))

    def stands(self, words: list[bytes], number: int, at: int) -> int:
        """Words of a template that stand around their place if the template begins at word ``at``."""
        slack, n = self.templates[number].slack, 0
        for i, w in enumerate(self.words[number]):
            spot = at + i
            if w in words[max(0, spot - slack) : max(0, spot + slack + 1)]:
                n += 1
        return n

    def keyed(self, words: list[bytes], number: int, at: int) -> bool:
        """Every key phrase stands in one piece within the template's words."""
        slack, size = self.templates[number].slack, len(self.words[number])
        part = words[max(0, at - slack) : max(0, at + size + slack)]
        return all(any(part[i : i + len(k)] == k for i in range(len(part) - len(k) + 1)) for k in self.keys[number])

    def places(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, template, words that stand) of every place, in order."""
        looked: dict[int, set[int]] = defaultdict(set)
        for p in [p for p, w in enumerate(words) if w in self.postings]:
            for number, i in self.postings[words[p]]:
                slack = self.templates[number].slack
                looked[number].update(range(p - i - slack, p - i + slack + 1))
        found = []
        for number, starts in looked.items():
            good = []
            for at in starts:
                n = self.stands(words, number, at)
                if n >= self.templates[number].need and self.keyed(words, number, at):
                    good.append((at, n))
            if not self.templates[number].base:
                good = _apart(good, len(self.words[number]))
            found += [(at, number, n) for at, n in good]
        return sorted(found)


def _apart(good: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Of places that overlap, the one with most words: best first, each clearing its surroundings."""
    kept: dict[int, list[int]] = defaultdict(list)
    out = []
    for at, n in sorted(good, key=lambda x: (-x[1], x[0])):
        near = [a for b in (at // size - 1, at // size, at // size + 1) for a in kept[b]]
        if all(abs(a - at) >= size for a in near):
            kept[at // size].append(at)
            out.append((at, n))
    return out


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, and places: (label, base, first, stop, share, start, end).

    ``first`` and ``stop`` are word numbers (stop exclusive) and ``start`` and ``end`` code points of the text.
    """
    n_docs, counts = document_counts(docs, templates)
    source = columns(docs, doc_id="doc_id", text="text")
    kind = source.schema["doc_id"].dataType.simpleString()
    fields = [("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("stop", pa.int64()), ("share", pa.float64()),
              ("start", pa.int64()), ("end", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, n_docs, counts)
        for batch in batches:
            sizes, places = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                rows = []
                for at, number, n in index.places(words):
                    t, m = index.templates[number], len(index.words[number])
                    first = min(max(0, at), len(words) - 1)
                    stop = max(first + 1, min(len(words), at + m))
                    rows.append({"label": t.label, "base": t.base, "first": first, "stop": stop, "share": n / m})
                if rows:
                    spans = word_spans(text, np.array([x for r in rows for x in (r["first"], r["stop"] - 1)]))
                    for i, r in enumerate(rows):
                        r["start"], r["end"] = spans[2 * i][0], spans[2 * i + 1][1]
                places.append(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.struct(fields)))],
                ["doc_id", "n_words", "places"])

    return source.mapInArrow(
        run, f"doc_id {kind}, n_words long, places array<struct<label:string,base:boolean,first:long,stop:long,share:double,start:long,end:long>>")
