"""Merkle manifest of a dataset: one leaf a row, a tree a source, and a tree over the sources.

Rows become (source key, id, leaf digest); texts don't move. A leaf's place within its source is its rank in
one range-partitioned sort by (source, id, leaf): the rows of each (partition, source) are counted, and running
sums of those counts carry the ranks across partitions, so that a source with any share of the rows is
spread over as many tasks. Each level is then one aggregation on (source, place / fanout): conditional
aggregates put the children into ``fanout`` columns by slot (``c0`` ...). Joining the columns and hashing
gives the parent; the columns but the own slot give a child's siblings. Levels are written to the shared
folder, each a ``fanout``-th of the one below.

Proofs go down the levels, so that the path above a parent is put together once for all its children. A path is a
list of (left, right) sibling texts, from the leaf's own run to the root.

Defined results: nulls in any field are hashed as ``-``; a null source is the first source; null ids come first
in a source, and equal ids are ordered by leaf; repeated rows are leaves of their own; an empty table has no
leaf and no root; extra columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinproof.llm.common import columns
from twinproof.session import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
STEP = "array<struct<left:string,right:string>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field as byte count, colon and value, or ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    return sha(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def leaves(docs: DataFrame, claimed: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, source, g, hash, claim) of every row; ``g`` is a source key that sorts like the source and is never null.

    ``claimed`` may use the columns named in ``fields``; ``claim`` is the row's digest with it for a text, else null.
    """
    rows = columns(docs, **{f: f for f in dict.fromkeys((*fields, "doc_id", "source"))})
    own = [F.col(f) for f in fields]
    other = F.lit(None).cast("string") if claimed is None else leaf(*[claimed if f == "text" else F.col(f) for f in fields])
    return rows.select(
        "doc_id", "source", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string"))).alias("g"),
        leaf(*own).alias("hash"), other.alias("claim"))


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with ``at``, their rank from 0 by ``order`` within their ``g``, and ``n``, the size of that group."""
    keys = ["g", *order, "tie"]
    tied = nodes.withColumn("tie", F.monotonically_increasing_id())
    rows = stored(tied.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "merkle-sorted")
    counts = rows.groupBy("g", "part").agg(F.count("*").alias("held"))
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("g", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"), F.sum("held").over(group).alias("n"))
    ranked = rows.withColumn("inside", F.row_number().over(Window.partitionBy("g", "part").orderBy(*order, "tie")) - 1)
    return ranked.join(shifts, ["g", "part"]).withColumn("at", F.col("before") + F.col("inside")).drop("part", "before", "inside", "tie")


@dataclass
class Tree:
    """``nodes`` (g, at, n, hash, ...) and the levels above them, each (g, at, n, c0 ..., hash)."""

    nodes: DataFrame
    levels: list[DataFrame]
    fanout: int

    def roots(self) -> DataFrame:
        """(g, root) of every group."""
        ends = [x.filter("n = 1").select("g", F.col("hash").alias("root")) for x in (self.nodes, *self.levels)]
        out = ends[0]
        for e in ends[1:]:
            out = out.unionByName(e)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """``nodes`` with ``path``, the (left, right) siblings up to the group's root and on along ``above`` (g, path, ...).

        Further columns of ``above`` come along from parent to child, so no group is joined as a whole.
        """
        slots = range(self.fanout)
        along = [c for c in above.columns if c not in ("g", "path")]
        slot = F.col("at") % self.fanout
        parents = None
        for i, own in reversed(list(enumerate([self.nodes, *self.levels]))):
            top = own.filter("n = 1").join(above, "g")
            if parents is None:
                parents = top
                continue
            told = parents.select("g", F.col("at").alias("up"), *[F.col(f"c{k}").alias(f"s{k}") for k in slots], F.col("path").alias("on"), *along)
            step = F.struct(
                F.concat_ws("", *[F.when(slot > k, F.col(f"s{k}")) for k in slots]).alias("left"),
                F.concat_ws("", *[F.when(slot < k, F.col(f"s{k}")) for k in slots]).alias("right"))
            rest = own.filter("n > 1").withColumn("up", F.expr(f"at div {self.fanout}")).join(told, ["g", "up"])
            rest = rest.withColumn("path", F.concat(F.array(step), F.col("on"))).select(*own.columns, "path", *along)
            parents = rest.unionByName(top.select(*own.columns, "path", *along))
        return parents.select(*self.nodes.columns, "path", *along)


def tree(nodes: DataFrame, fanout: int = FANOUT) -> Tree:
    """The tree over the placed ``nodes`` of each group; a single node is its own root."""
    if fanout < 2:
        raise ValueError("fanout is at least 2")
    most = nodes.agg(F.max("n")).first()[0] or 1
    levels, below = [], nodes
    while most > 1:
        slot = F.col("at") % fanout
        runs = below.filter("n > 1").groupBy(
            "g", F.expr(f"at div {fanout}").alias("up"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n")
        ).agg(*[F.max(F.when(slot == k, F.col("hash"))).alias(f"c{k}") for k in range(fanout)])
        slots = [f"c{k}" for k in range(fanout)]
        up = runs.select("g", F.col("up").alias("at"), "n", *slots, sha(F.concat_ws("", *slots)).alias("hash"))
        below = stored(up, "merkle-level")
        levels.append(below)
        most = -(-most // fanout)
    return Tree(nodes, levels, fanout)


@dataclass
class Manifest:
    sources: Tree
    top: Tree

    def subroots(self) -> DataFrame:
        """(source, subroot, n): the roots of the sources, n leaves each."""
        sizes = self.sources.nodes.filter("at = 0").select("g", "source", "n")
        return sizes.join(self.top.nodes.select(F.col("key").alias("g"), F.col("hash").alias("subroot")), "g").select("source", "subroot", "n")

    def root(self) -> DataFrame:
        """One row (root), none for an empty dataset."""
        return self.top.roots().select("root")

    def proofs(self) -> DataFrame:
        """(doc_id, source, leaf, claim, subroot, root, path) of every leaf."""
        top = self.top.roots().select("g", F.array().cast(STEP).alias("path"), "root")
        above = stored(self.top.paths(top).select(F.col("key").alias("g"), "path", F.col("hash").alias("subroot"), "root"), "merkle-top")
        return self.sources.paths(above).select("doc_id", "source", F.col("hash").alias("leaf"), "claim", "subroot", "root", "path")


def manifest(docs: DataFrame, claimed: Column | None = None, fanout: int = FANOUT) -> Manifest:
    """Leaves ordered by doc_id within their source, a tree a source, and the tree over the sources' roots."""
    sources = tree(stored(placed(stored(leaves(docs, claimed), "merkle-rows"), "doc_id", "hash"), "merkle-leaves"), fanout)
    roots = sources.roots().select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("root").alias("hash"))
    return Manifest(sources, tree(stored(placed(roots, "key"), "merkle-sources"), fanout))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf digest gives along its path."""
    return F.aggregate(path, start, lambda acc, s: sha(F.concat(s["left"], acc, s["right"])))


def siblings(path: Column) -> Column:
    """All siblings of a path, from the leaf's run upwards, each run from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def changed(old: Manifest, new: Manifest) -> DataFrame:
    """(source, change) of sources that were added, removed or differ; equal sources aren't read below their subroot."""
    a, b = (m.subroots().withColumn("told", F.lit(True)) for m in (old, new))
    both = a.alias("a").join(b.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "full")
    kind = F.when(F.col("a.told").isNull(), "added").when(F.col("b.told").isNull(), "removed").when(
        F.col("a.subroot") != F.col("b.subroot"), "differs")
    return both.select(F.coalesce("a.source", "b.source").alias("source"), kind.alias("change")).filter("change is not null")
