"""Document intake: file checks, scanned or digital, page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.functions.text import strip

MAX_BYTES = 50 * 1024 * 1024
MAGIC = "%PDF-"
SCAN_PAGES, SCAN_CHARS = 3, 50


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Binary files as ``path, length, content``; larger files keep their length but aren't loaded."""
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= max_bytes).select("path", "length", "content")
    large = files.filter(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def check_files(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``sha256`` and ``problem``: empty, not a PDF, or too large (also if not loaded)."""
    data = F.col(content)
    head = F.decode(F.substring(data, 1, len(MAGIC)), "ISO-8859-1")
    problem = (
        F.when(data.isNull(), F.lit("too_large"))
        .when(F.length(data) == 0, F.lit("empty"))
        .when(head != MAGIC, F.lit("not_a_pdf"))
        .when(F.length(data) > MAX_BYTES, F.lit("too_large"))
    )
    return files.withColumns({"sha256": F.sha2(data, 256), "problem": problem})


def document_kinds(pages: DataFrame, documents: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """``scanned`` when none of the first three pages has fifty characters of text.

    A document without any page row is scanned too, provided ``documents`` lists it.
    """
    probe = pages.filter(F.col("page") <= SCAN_PAGES)
    texty = probe.groupBy(key).agg(
        F.max(F.length(strip(F.coalesce("text", F.lit("")))) >= SCAN_CHARS).alias("_text"))
    base = texty if documents is None else documents.select(key).distinct().join(texty, key, "left")
    return base.select(key, F.when(F.coalesce("_text", F.lit(False)), F.lit("digital"))
                       .otherwise(F.lit("scanned")).alias("kind"))


def page_counts(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    return pages.groupBy(key).agg(F.max("page").cast("bigint").alias("pages"))


def assemble_text(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``[Page N]`` blocks in page order; the whole document is one value by definition."""
    block = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("page", block.alias("block"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p["block"]), "\n\n").alias("text"))


def vision_documents(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with image pages: text assembly must not be asked for them."""
    return pages.filter(F.col("source") == "vision").select(key).distinct()
