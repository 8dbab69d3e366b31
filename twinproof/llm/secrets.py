"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger has one row
per blob and rule version that was ever scanned, with its findings (also none). A scan takes the
(blob, rule version) pairs that the ledger lacks, one path each as the place to read the blob
from, finds the rules' matches, and gives new ledger rows; findings then join back to all
paths whose versions have that content. Copies are scanned once, a rule change rescans with the
changed rules only, and an unchanged corpus scans nothing. ``extend`` keeps the ledger as a table, a folder a batch.

Positions are code points. The pieces between matches (``split``) and the matches
(``regexp_extract_all``) alternate, so running sums of their lengths give the spans.

Defined results: null content is the empty text; rows of one path are its versions and each gets
a row; an empty table gives an empty table; overlapping findings of different rules are all kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinproof.llm.common import columns


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``least`` is the fewest characters that ``group`` of a match must have."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    base: bool = False


RULES = (
    # Fixed patterns: the base kinds in their listed order.
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, True),
    # Kinds that this operator adds.
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
BLOB = "blob binary, kind string, version int, spans array<struct<start:long,stop:long>>"


def versions(docs: DataFrame) -> DataFrame:
    """(path, blob, text) of every row."""
    rows = columns(docs, path="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def unseen(stored: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """(blob, path, todo): blobs with rules to run, and one path where each blob can be read."""
    places = stored.groupBy("blob").agg(F.min("path").alias("path"))
    every = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        return places.withColumn("todo", every)
    seen = ledger.groupBy(F.col("blob").alias("known")).agg(F.collect_set(F.struct("kind", "version")).alias("done"))
    joined = places.join(seen, places.blob == seen.known, "left")
    todo = F.when(F.col("done").isNull(), every).otherwise(F.array_except(every, F.col("done")))
    return joined.select("blob", "path", todo.alias("todo")).filter(F.size("todo") > 0)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """The new ledger rows (blob, kind, version, spans): one per unseen blob and rule version."""
    stored = versions(docs)
    todo = unseen(stored.select("path", "blob"), rules, ledger)
    place = todo.select(F.col("blob").alias("b"), F.col("path").alias("p"), "todo")
    texts = stored.join(place, F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b"))).select("blob", "text", "todo")
    runs = [
        F.when(
            F.array_contains("todo", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")))
            & F.col("text").rlike(r.pattern),
            F.struct(
                F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                F.transform(F.split("text", r.pattern), lambda x: F.length(x)).alias("gaps"),
                F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)), lambda x: F.length(x)).alias("sizes"),
                F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), lambda x: F.length(x) >= r.least).alias("good"),
            ),
        )
        for r in rules
    ]
    hits = texts.select("blob", F.explode(F.array_compact(F.array(*runs))).alias("run")).select("blob", "run.*")
    each = hits.select("blob", "kind", "version", F.posexplode(F.arrays_zip("gaps", "sizes", "good")).alias("at", "m")).select(
        "blob", "kind", "version", "at", "m.gaps", "m.sizes", "m.good").filter("sizes is not null").distinct()
    before = Window.partitionBy("blob", "kind", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("stop", F.sum(F.col("gaps") + F.col("sizes")).over(before)).filter("good").select(
        "blob", "kind", "version", F.struct((F.col("stop") - F.col("sizes")).alias("start"), F.col("stop").alias("stop")).alias("span"))
    found = placed.groupBy("blob", "kind", "version").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    scanned = todo.select("blob", F.explode("todo").alias("t")).select("blob", "t.kind", "t.version")
    return scanned.join(found, ["blob", "kind", "version"], "left").select(
        "blob", "kind", "version", F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"))


def read_ledger(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """The stored ledger (but for one batch); empty where there is none yet."""
    try:
        rows = spark.read.schema(f"{BLOB}, batch string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], f"{BLOB}, batch string")
    return (rows if without is None else rows.filter(F.col("batch") != without)).drop("batch")


def extend(docs: DataFrame, path: str, batch: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks, store it as ``batch`` and return the whole ledger.

    A batch that is run again replaces its own folder: it sees the ledger without itself.
    """
    spark = docs.sparkSession
    scan(docs, rules, read_ledger(spark, path, batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return read_ledger(spark, path)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per version: (path, blob, found), found holding (start, rank, kind, stop) of the current rules, in order."""
    current = F.array(*[
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(i).alias("rank"), F.lit(r.base).alias("base"))
        for i, r in enumerate(rules)])
    rank = F.get(F.filter(current, lambda c: (c["kind"] == F.col("kind")) & (c["version"] == F.col("version"))), 0)
    some = ledger.filter(F.size("spans") > 0).withColumn("rule", rank).filter("rule is not null")
    per_blob = some.groupBy(F.col("blob").alias("known")).agg(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.col("rule.rank").alias("rank"), F.col("kind").alias("kind"),
        s["stop"].alias("stop"), F.col("rule.base").alias("base"))))).alias("found"))
    per_blob = per_blob.select("known", F.sort_array("found").alias("found"))
    paths = versions(docs).select("path", "blob")
    return paths.join(per_blob, F.col("blob") == F.col("known"), "left").select("path", "blob", "found")


def joined_spans(found) -> object:
    """``kind:start:stop`` of each finding, comma-joined; an empty text for none."""
    return F.coalesce(F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["stop"])), ","), F.lit(""))
