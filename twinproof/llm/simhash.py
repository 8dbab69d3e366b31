"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified links, components.

A fingerprint has the majority bits of the 64-bit hashes of a text's 3-word shingles. Equal
fingerprints are one node, so copies never meet in pairs. Two fingerprints that differ in at
most 2 bits agree in two of four 16-bit blocks; each node therefore gets six keys of two blocks,
nodes are joined on their keys, and pairs within 2 bits are links.

A key held by more than ``BUCKET`` nodes isn't joined: its pairs would grow with the square of
the group. Its nodes take an exact way of bounded size instead: each one visits itself and the 64
values one bit away. Nodes that visit the same value are within 2 bits of each other, and nodes
within 2 bits always share such a value, so linking each visitor to the smallest one keeps every
connection with 65 rows a node.

Components come from label passing with pointer jumping, a few joins a round and about log(n)
rounds; a node has a bounded number of links, so no key is hot.

Defined results: null and word-less texts have fingerprint zero and link like any other; texts
of one or two words are one shingle; repeated rows get one row each; ``component_id`` is the
smallest non-null doc_id reachable (null only if all are null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import columns, cut, packed, unpacked

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BLOCKS = 4
BUCKET = 64

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """Eight bytes, the highest bit first."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return bytes(8)
    joined, hashed = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 100_000):
        spans = zip(starts[at : min(n, at + 100_000)].tolist(), last[at : at + 100_000].tolist())
        raw = np.frombuffer(b"".join([hashed(joined[a:b], SEED) for a, b in spans]), dtype=np.uint8)
        counts += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(source: DataFrame, *keep: str) -> DataFrame:
    """The kept columns of ``source`` and ``print``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join([fingerprint(t) for t in batch.column("text").to_pylist()])
            prints = pa.array(np.frombuffer(found, dtype=">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], prints], [*keep, "print"])

    kinds = [f"{c} {source.schema[c].dataType.simpleString()}" for c in keep]
    return source.mapInArrow(run, ", ".join([*kinds, "print long"]))


def links(nodes: DataFrame, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect the same nodes as all pairs within MAX_BITS bits do."""
    width = 64 // blocks
    keys = []
    for n, same in enumerate(combinations(range(blocks), blocks - MAX_BITS)):
        mask = sum(((1 << width) - 1) << (width * b) for b in same)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(n).alias("part"), F.col("print").bitwiseAND(F.lit(mask)).alias("bits")))
    keyed = nodes.select("print", F.inline(F.array(*keys)))
    sizes = keyed.groupBy("part", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keyed.join(sizes, ["part", "bits"]))
    small = shared.filter(F.col("n") <= bucket)
    pairs = (
        small.alias("x").join(small.alias("y"), ["part", "bits"])
        .filter("x.print < y.print").filter(F.bit_count(F.expr("x.print ^ y.print")) <= MAX_BITS)
        .select(F.col("x.print").alias("a"), F.col("y.print").alias("b"))
    )
    hot = shared.filter(F.col("n") > bucket).select("print").distinct()
    ball = [F.col("print"), *[F.col("print").bitwiseXOR(F.lit((1 << i) - ((i == 63) << 64))) for i in range(64)]]
    visits = hot.select("print", F.explode(F.array(*ball)).alias("value"))
    least = visits.groupBy("value").agg(F.min("print").alias("b"), F.count("*").alias("n")).filter("n > 1")
    stars = visits.join(least, "value").filter("print <> b").select(F.col("print").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")))
    label = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("root")))
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("root").alias("seen"))
        seen = label.join(near, label.node == near.a).select("node", "root", F.least("root", "seen").alias("low"))
        # The lowest label seen around a tree also goes to the tree's root.
        offers = seen.select("node", "low").union(seen.filter("low < root").select(F.col("root").alias("node"), "low"))
        hooked = offers.groupBy("node").agg(F.min("low").alias("up"))
        top = hooked.select(F.col("node").alias("up"), F.col("up").alias("top"))
        after = cut(label.join(hooked, "node").join(top, "up").select(
            "node", F.col("top").alias("root"), (F.col("top") < F.col("root")).alias("moved")))
        label = after.select("node", "root")
        if after.filter("moved").isEmpty():
            return label


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (hash of the text), print, component_id and root.

    ``root`` is the smallest fingerprint of the component. Unlike ``component_id``, which is null or
    shared where doc_ids are null or repeat, it tells components apart.
    """
    source = columns(docs, doc_id="doc_id", text="text").withColumn("key", F.xxhash64("text"))
    prints = cut(fingerprints(source, "doc_id", "key"))
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    label = components(links(nodes))
    rooted = nodes.join(label.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", F.coalesce("root", "print").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("print", "component_id", "root"), "print")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but one of each component: that of the smallest doc_id, nulls last.

    Where several rows of the component have that doc_id (or all have none), the one of the smallest
    text hash stays. Rows of one doc_id in different components stay for each of them.
    """
    groups = near_groups(docs)
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(
        F.min("key").alias("key")).select(F.col("component_id").alias("id"), F.col("key").alias("hash"))
    rows = packed(docs, doc_id="doc_id", text="text").withColumn("key", F.xxhash64("text"))
    held = rows.join(stay, rows.doc_id.eqNullSafe(stay.id) & (rows.key == stay.hash), "left_semi")
    repeats = held.groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter("n > 1")
    if repeats.isEmpty():
        return unpacked(held, docs)
    return unpacked(held.dropDuplicates(["doc_id", "key"]), docs)
