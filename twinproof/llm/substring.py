"""Exact substring dedup with fixed-block anchors.

Words covered by a window of ``WINDOW`` words that occurs twice anywhere are removed, all
occurrences alike. A repeated window contains a whole block of its own document's grid of
``BLOCK`` words (2 * BLOCK - 1 <= WINDOW), and that block's words occur at its partner too. So:

1. Index the non-overlapping blocks and probe them with every rolling window of BLOCK words. Both
   only meet as hashes: tasks drop their own repeats, pack 32 bits a probe by bucket, and a
   bucket returns the blocks that some other window matches. The bucket count follows the input.
2. Blocks that were hit give their documents the places where repeats can be.
3. Hits are extended: around each one, every window of WINDOW words that contains the block
   is counted by a 64-bit hash over all documents. Windows of a copied passage share their rows
   before the shuffle, and only those found once are sent back, so no passage is hot.
4. The other candidates are repeats; their covered words merge into ranges and are cut out.

A probe's 32 bits only propose candidates; the count in step 3 decides.

Defined results: null texts have no words; documents of fewer than WINDOW words lose nothing and
only their white space is unified in ``kept``; rows that repeat a document are occurrences of
their own; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import columns
from twinproof.llm.wordhash import PLAIN, Hasher

WINDOW = 35
BLOCK = 18
BUCKET_CHARS = 4_000_000
LEAST_BUCKETS = 64
PACKED = 4_000_000


def _grid(counts: np.ndarray, step: int, size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in it, position in all) of windows of ``size`` words at multiples of ``step``.

    Only texts of at least ``least`` words have any.
    """
    number = np.where(counts >= max(least, size), (counts - size) // step + 1, 0)
    text = np.repeat(np.arange(len(counts)), number)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)) * step
    return text, at, at + np.repeat(np.cumsum(counts) - counts, number)


def probed(rows: DataFrame, buckets: int, block: int, window: int) -> DataFrame:
    """(bucket, low): blocks of the grid whose words are also found in another window."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, grid, size = Hasher(), [], [], 0
        for batch in batches:
            for _, words, counts in hasher.texts(batch.column("text").to_pylist()):
                _, at, place = _grid(counts, 1, block, window)
                found = hasher.windows(words, place, block)
                held.append(found)
                grid.append(found[at % block == 0])
                size += len(found)
                if size > PACKED:
                    yield from told(held, grid)
                    held, grid, size = [], [], 0
        if size:
            yield from told(held, grid)

    def dealt(hashes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        key = (hashes >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
        key, n = np.unique(key, return_counts=True)
        key = np.repeat(key, np.minimum(n, most))
        return key, np.searchsorted(key, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))

    def told(held: list[np.ndarray], grid: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        # What this task has twice is sent twice, which is enough to call it repeated.
        (probes, edges), (blocks, marks) = dealt(np.concatenate(held), 2), dealt(np.concatenate(grid), 1)
        part = lambda key, edge, b: key[edge[b] : edge[b + 1]].astype(np.uint32).tobytes()
        for at in range(0, buckets, 4096):
            some = [b for b in range(at, min(buckets, at + 4096)) if edges[b] < edges[b + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), pa.array([part(probes, edges, b) for b in some], pa.binary()),
                 pa.array([part(blocks, marks, b) for b in some], pa.binary())], ["bucket", "probes", "blocks"])

    def meet(table: pa.Table) -> pa.Table:
        read = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.uint32)
        seen, n = np.unique(read("probes"), return_counts=True)
        found = np.intersect1d(seen[n > 1], read("blocks")).astype(np.int64)
        return pa.table({"bucket": pa.array(np.full(len(found), table.column("bucket")[0].as_py(), dtype=np.int64)), "low": found})

    packed = rows.select("text").mapInArrow(pack, "bucket long, probes binary, blocks binary")
    return packed.groupBy("bucket").applyInArrow(meet, "bucket long, low long")


def hit_blocks(rows: DataFrame, hits: DataFrame, buckets: int, block: int, window: int) -> DataFrame:
    """(owner, hits): the first words of each document's blocks that were hit."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            owners = batch.column("owner").to_numpy()
            for first, words, counts in hasher.texts(batch.column("text").to_pylist()):
                text, at, place = _grid(counts, block, block, window)
                found = hasher.windows(words, place, block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owners[first + text]), pa.array(at.astype(np.int32)),
                     pa.array(((found >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)),
                     pa.array((found & np.uint64(0xFFFFFFFF)).astype(np.int64))], ["owner", "at", "bucket", "low"])

    own = rows.select("owner", "text").mapInArrow(blocks, "owner long, at int, bucket long, low long")
    return own.join(hits, ["bucket", "low"]).groupBy("owner").agg(F.array_sort(F.collect_set("at")).alias("hits"))


def _candidates(counts: np.ndarray, hits: list, block: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the windows that contain a hit block."""
    texts, starts = [], []
    for i, found in enumerate(hits):
        if found is None or not len(found):
            continue
        marks = np.zeros(counts[i] + 1, dtype=np.int64)
        found = np.asarray(found)
        np.add.at(marks, np.maximum(0, found - (window - block)), 1)
        np.add.at(marks, found + 1, -1)
        own = np.flatnonzero(np.cumsum(marks[: max(0, counts[i] - window + 1)]) > 0)
        texts.append(np.full(len(own), i))
        starts.append(own)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *texts]), np.concatenate([none, *starts])


def single_windows(rows: DataFrame, block: int, window: int) -> DataFrame:
    """(owner, singles): starts of candidate windows that occur nowhere else."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            owners, hits = batch.column("owner").to_numpy(), batch.column("hits").to_pylist()
            for first, words, counts in hasher.texts(batch.column("text").to_pylist()):
                text, start = _candidates(counts, hits[first : first + len(counts)], block, window)
                place = start + (np.cumsum(counts) - counts)[text]
                found = hasher.windows(words, place, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(owners[first + text]), pa.array(start.astype(np.int32))],
                    ["hash", "owner", "start"])

    # All columns, so that this reads the same exchange of the texts as the last step does.
    counted = rows.select("doc_id", "text", "owner", "hits").mapInArrow(candidates, "hash long, owner long, start int").groupBy("hash").agg(
        F.count("*").alias("n"), F.min("owner").alias("owner"), F.min("start").alias("start"))
    return counted.filter("n = 1").groupBy("owner").agg(F.array_sort(F.collect_list("start")).alias("singles"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text, of every row."""
    if 2 * block - 1 > window:
        raise ValueError("a window must contain a whole block wherever it starts")
    rows = columns(docs, doc_id="doc_id", text="text").withColumn("owner", F.xxhash64("doc_id", "text"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, chars // BUCKET_CHARS)
    hits = hit_blocks(rows, probed(rows, buckets, block, window), buckets, block, window)
    placed = rows.join(hits, "owner", "left")
    singles = single_windows(placed.filter("hits is not null"), block, window)
    final = placed.join(singles, "owner", "left")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, hit, single in zip(*[batch.column(c).to_pylist() for c in ("text", "hits", "singles")]):
                words = (raw or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()
                n = len(words)
                if hit:
                    _, starts = _candidates(np.array([n]), [hit], block, window)
                    starts = np.setdiff1d(starts, np.asarray(single or [], dtype=np.int64), assume_unique=False)
                    marks = np.zeros(n + 1, dtype=np.int64)
                    marks[starts] += 1
                    marks[starts + window] -= 1
                    stay = np.cumsum(marks[:n]) == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                plain = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(plain).hexdigest(), plain.decode("utf-8", "surrogatepass") if text else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())[: 3 + text]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + text])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return final.select("doc_id", "text", "hits", "singles").mapInArrow(
        cut_out, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text)
