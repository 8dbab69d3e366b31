"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers have windows of 13 words (shorter items are one window). Any window holds one whole
block of 7 words that begins at a multiple of 7 in its item, so the automaton holds these blocks only, normalised
and with a space at both ends: about as many characters as the items and not 13 times as many. It
reads each normalised document once. A hit's end gives the word it ends in; the hit is then extended word by word
in the document and the item, and runs of 13 words or more are what the windows cover. ``word_spans`` maps hit words
back to code-point offsets of the original text.

The items are collected to build the automaton, so their total length is checked first: up to
``block_chars`` characters form one part. More items are dealt into several parts by a hash,
each document is scanned once for each part, and hits are merged by document. A worker builds
a part's automaton once.

Defined results: a null text or item has no words; an item without words has no window; a
document without words has no hit and is not contaminated; an item id counts once however often
it is repeated; an item without id marks words but is not listed. Rows that repeat a document
give equal rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import columns, cut, once

WINDOW = 13
#: Measured: about 60 bytes of memory and 0.9 microseconds of building a character, so up to 120 MB a worker.
BLOCK_CHARS = 2_000_000

#: A-Z in lower case, other ASCII bytes but digits and letters as spaces; all other bytes stay.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Scanner:
    """The automaton over the blocks of some items."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        self.size, block = size, (size + 1) // 2
        told: dict[tuple, set] = {}
        for item, text in items:
            words = tuple(words_of(text))
            if words:
                told.setdefault(words, set()).add(item)
        self.items = list(told.items())
        found: dict[bytes, list[tuple[int, int]]] = {}
        for number, (words, _) in enumerate(self.items):
            if len(words) < size:  # one window, which the automaton knows whole
                found.setdefault(b" ".join(words), []).append((number, -1))
            for pos in range(0, len(words) - block + 1, block) if len(words) >= size else ():
                found.setdefault(b" ".join(words[pos : pos + block]), []).append((number, pos))
        self.automaton = ahocorasick.Automaton()
        for words, places in found.items():
            self.automaton.add_word(f" {words.decode()} ", (words.count(b" ") + 1, tuple(places)))
        self.any = bool(found)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set]:
        """(number of words, mask of hit words or an empty array, items)."""
        words = words_of(text)
        if not words or not self.any:
            return len(words), np.zeros(0, dtype=np.int64), set()
        plain = (b" " + b" ".join(words) + b" ").decode()
        hits = list(self.automaton.iter(plain))
        if not hits:
            return len(words), np.zeros(0, dtype=np.int64), set()
        ends = np.cumsum([len(w.decode()) + 1 for w in words])  # the closing space of each word
        steps, items, reached = np.zeros(len(words) + 1, dtype=np.int64), set(), {}
        last = np.searchsorted(ends, [end for end, _ in hits])
        for word, (_, (n, places)) in zip(last.tolist(), hits):
            start = word + 1 - n
            for number, pos in places:
                own, ids = self.items[number]
                first, stop = start, word + 1
                if pos >= 0:
                    if reached.get((number, start - pos), -1) > start:
                        continue  # within a run that is known already
                    i, j = pos, pos + n
                    while first and i and words[first - 1] == own[i - 1]:
                        first, i = first - 1, i - 1
                    while stop < len(words) and j < len(own) and words[stop] == own[j]:
                        stop, j = stop + 1, j + 1
                    reached[number, start - pos] = stop
                    if stop - first < self.size:
                        continue
                steps[first] += 1
                steps[stop] -= 1
                items.update(ids)
        return len(words), np.flatnonzero(np.cumsum(steps[:-1]) > 0), items


def word_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans in the original text of the given words (by number)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.frombuffer(raw.tobytes().translate(FOLD), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    starts, ends = points[np.flatnonzero(edge == 1)], points[np.flatnonzero(edge == -1)]
    return list(zip(starts[hit].tolist(), ends[hit].tolist()))


def _scan(source: DataFrame, items: list[tuple], size: int) -> DataFrame:
    sent = source.sparkSession.sparkContext.broadcast(items)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = once(key, lambda: Scanner(sent.value, size))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [scanner.scan(t) for t in texts]
            spans = [word_spans(t, hit) if len(hit) else [] for t, (_, hit, _) in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array([n for n, _, _ in found], pa.int64()),
                 pa.array([hit.tolist() for _, hit, _ in found], pa.list_(pa.int64())),
                 pa.array([[list(s) for s in x] for x in spans], pa.list_(pa.list_(pa.int64()))),
                 pa.array([sorted(str(i) for i in ids if i is not None) for _, _, ids in found], pa.list_(pa.string()))],
                ["doc_id", "key", "n_words", "hits", "spans", "items"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, key long, n_words long, hits array<long>, "
                                  "spans array<array<long>>, items array<string>")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_chars: int = BLOCK_CHARS,
                   key: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    ``spans`` has the (start, end) code points of the hit words in the original text.
    Contaminated: some word is hit, and at least one word in twenty. ``key`` adds the hash of the
    text, which tells rows of one doc_id apart.
    """
    source = columns(docs, doc_id="doc_id", text="text").withColumn("key", F.xxhash64("text"))
    tests = columns(items, item_id="item_id", text="text").filter(F.col("text").isNotNull())
    total = tests.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    n_blocks = max(1, -(-total // block_chars))
    if n_blocks == 1:
        found = _scan(source, [tuple(r) for r in tests.collect()], size)
    else:
        dealt = cut(tests.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))))
        parts = None
        for b in range(n_blocks):
            block = [tuple(r) for r in dealt.filter(F.col("block") == b).select("item_id", "text").collect()]
            part = _scan(source, block, size)
            parts = part if parts is None else parts.unionByName(part)
        merged = parts.filter(F.size("items") + F.size("hits") > 0).groupBy("doc_id", "key").agg(
            *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("hits", "spans", "items")])
        first = _scan(source, [], size).select("doc_id", "key", "n_words")
        found = first.alias("d").join(
            merged.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.key") == F.col("m.key")), "left"
        ).select("d.doc_id", "d.key", "n_words", *[F.coalesce(c, F.array().cast(merged.schema[c].dataType)).alias(c)
                                          for c in ("hits", "spans", "items")])
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", *["key"] * key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "items", "spans",
    )

