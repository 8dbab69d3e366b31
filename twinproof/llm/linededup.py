"""Line dedup over overlapping three-line windows.

Each document becomes an array of 128-bit window hashes without leaving its row; only hashes
and positions are exploded. Windows found more than once are counted globally (pre-aggregated,
so a passage in a third of all documents sends one row a task), later occurrences are found by
joining them back, and the covered positions of a document merge into line ranges that are cut
out of its text. An occurrence is later than another if its (doc_id, hash of the text, line) is larger,
so rows of one id, or without id, but with different texts follow each other too.

A removed line always has an equal line earlier on: the first occurrence of any line content is
in no later window. Windows are judged on the input.

Defined results: null texts and texts of fewer than three lines stay as they are; null doc_ids come
first; rows that share doc_id and text count as one document and are treated alike; a text
may become empty; an empty table gives an empty table; columns but text are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import packed, unpacked

LINES = 3


def windows(rows: DataFrame) -> DataFrame:
    """(doc_id, key, at, a, b): the hash of every window of LINES lines."""
    hashed = rows.select("doc_id", "key", F.split("text", "\n").alias("lines")).filter(F.size("lines") >= LINES).select(
        "doc_id", "key", F.transform("lines", lambda x: F.xxhash64(x)).alias("first"),
        F.transform("lines", lambda x: F.xxhash64(F.lit("second"), x)).alias("second"))
    window = lambda c, i: F.xxhash64(*[F.get(c, i + k) for k in range(LINES)])
    return hashed.select("doc_id", "key", F.inline(F.transform(
        F.sequence(F.lit(0), F.size("first") - LINES),
        lambda i: F.struct(i.alias("at"), window("first", i).alias("a"), window("second", i).alias("b")))))


def later_starts(rows: DataFrame) -> DataFrame:
    """(doc_id, key, at) of windows that occur before, in another document or in the same one."""
    found = windows(rows)
    repeated = found.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "at")).alias("first")
    ).filter("n > 1").select("a", "b", "first")
    later = found.join(repeated, ["a", "b"]).filter(
        ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("key") != F.col("first.key")) | (F.col("at") > F.col("first.at")))
    return later.select("doc_id", "key", "at")


def dedup_lines(docs: DataFrame, with_counts: bool = False) -> DataFrame:
    """``docs`` with later occurrences of repeated windows cut out of ``text``.

    ``with_counts`` returns only doc_id, text, n_lines and n_removed instead.
    """
    rows = packed(docs, doc_id="doc_id", text="text").withColumn("key", F.xxhash64("text"))
    starts = later_starts(rows.select("doc_id", "key", "text")).groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set("at")).alias("starts"))
    # Covered ranges begin where no start lies within LINES before, and end likewise.
    ranged = starts.select(
        F.col("doc_id").alias("id"), F.col("key").alias("hash"),
        F.filter("starts", lambda s, i: (i == 0) | (s - F.get("starts", i - 1) > LINES)).alias("begins"),
        F.transform(F.filter("starts", lambda s, i: (i == F.size("starts") - 1) | (F.get("starts", i + 1) - s > LINES)),
                    lambda s: s + LINES).alias("ends"))
    joined = rows.join(ranged, rows.doc_id.eqNullSafe(ranged.id) & (rows.key == ranged.hash), "left")
    lines = joined.withColumn("lines", F.when(F.col("begins").isNotNull(), F.split("text", "\n")))
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("begins")),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get("ends", i - 1)).alias("start"),
            F.coalesce(F.get("begins", i), F.size("lines")).alias("stop")))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice("lines", g["start"] + 1, g["stop"] - g["start"])))
    cleaned = lines.withColumn("cleaned", F.when(F.col("begins").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    if not with_counts:
        return unpacked(cleaned, docs, text=F.col("cleaned"))
    removed = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0), lambda acc, x: acc + x)
    return cleaned.select(
        "doc_id", F.col("cleaned").alias("text"),
        F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"))
