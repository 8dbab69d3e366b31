"""Quality rules: plain limits, then robust multivariate outliers.

Each document is reduced to counts of words, symbols, repeated lines and repeated 3-word windows
by array functions within its row; after that only narrow rows move. Documents that pass
the plain limits become transformed statistic vectors (``FEATURES``). For each language and
source the minimum covariance determinant is approached by concentration steps: from a start,
the ``SHARE`` of rows nearest by Mahalanobis distance give the next mean and covariance. Two
deterministic starts (coordinate-wise medians and quartile spreads; means and variances) run
side by side until their determinants stop falling, and the smaller one wins. Rows farther than the
97.5 % point of chi-square are rejected.

Groups of fewer than ``LEAST_ROWS`` rows, too few for a covariance of five features, use the estimate of their language, and then the one of
all rows. A variance floor keeps columns that hardly vary (no repeated lines, say) from turning
every small deviation into an outlier. The nearest rows of a group are cut at an approximate
quantile (an aggregate of bounded size), so a source with a third of all rows is never
gathered.

Defined results: null texts have no words and fail; null languages or sources are groups of their
own; repeated rows get one row each; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinproof.llm.common import SPACES, columns, cut, shared_folder

LEAST_WORDS = 50
REPEAT_PERCENT = 50
SHARE = 0.75
#: Five rows a feature, as is usual for this estimator.
LEAST_ROWS = 25
#: Steps end when no determinant falls; this is only a guard against an endless loop.
STEPS = 100
#: Fall of a log determinant that counts.
FALL = 1e-6
#: Up to so many groups (about 500 bytes each) their estimates are sent to every executor; more
#: groups are joined by shuffle.
SENT_GROUPS = 20_000
#: The nearest three quarters vary too little; for normal rows with five features this mends it:
#: SHARE / P(chi-square with 7 degrees <= the SHARE point of chi-square with 5).
CONSISTENT = 1.4121
#: Squared distance beyond which a row is an outlier: the 97.5 % point of chi-square with 5 degrees.
CUT = 12.8325
FEATURES = ("f_words", "f_length", "f_symbols", "f_lines", "f_repeats")
#: Smallest standard deviation of each feature.
FLOOR = (0.5, 0.08, 0.05, 0.05, 0.08)


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, key (hash of the text), the kept columns and the five counts of every row."""
    rows = columns(docs, doc_id="doc_id", text="text", **{k: k for k in keep}).withColumn("key", F.xxhash64("text"))
    keep = ("key", *keep)
    words = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(
        "words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    told = words.select(
        "doc_id", *keep, F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), F.when(F.size("words") >= 3, hashes).otherwise(F.array().cast("array<bigint>")).alias("hashes"))
    told = told.select(
        "doc_id", *keep, "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform(
            "hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))).alias("sorted"))
    same = lambda i, j: F.get("sorted", i)["h"].eqNullSafe(F.get("sorted", j)["h"])
    repeated = F.transform(
        F.filter("sorted", lambda x, i: ((i > 0) & same(i, i - 1)) | same(i, i + 1)), lambda x: x["at"])
    told = told.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       F.sort_array(repeated).alias("starts"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("starts", start, lambda acc, s: F.struct(
        (s + 3).alias("end"), (acc["n"] + s + 3 - F.greatest(acc["end"], s)).alias("n")))["n"]
    return told.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words").alias("f_words"), F.log1p(F.col("word_chars") / n).alias("f_length"),
        F.sqrt(F.col("n_symbols") / n).alias("f_symbols"), F.sqrt(F.col("n_dup_lines") / n).alias("f_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("f_repeats"),
    ]


def distance(low: list[list[Column]], centre: list[Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    solved: list[Column] = []
    for i, name in enumerate(FEATURES):
        rest = F.col(name) - centre[i]
        for k in range(i):
            rest = rest - low[i][k] * solved[k]
        solved.append(rest / low[i][i])
    return sum((s * s for s in solved[1:]), solved[0] * solved[0])


def _moments() -> list[Column]:
    p = range(len(FEATURES))
    own = [F.avg(FEATURES[i]).alias(f"m{i}") for i in p]
    return [F.count("*").alias("rows"), *own, *[
        F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"v{i}{j}") for i in p for j in range(i + 1)]]


def _estimate(moments: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Group keys, centre m*, covariance v* as it came, Cholesky factor l* and log determinant of the scaled and floored one."""
    p = range(len(FEATURES))
    raw = [f"v{i}{j}" for i in p for j in range(i + 1)]
    floored = moments.select(*keys, *[f"m{i}" for i in p], *raw, *[
        (F.coalesce(f"v{i}{j}", F.lit(0.0)) * scale + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"w{i}{j}") for i in p for j in range(i + 1)])
    for i in p:  # one column of the factor after the other, so that no expression grows
        done = lambda a, b: F.col(f"l{a}{b}")
        for j in range(i + 1):
            rest = F.col(f"w{i}{j}")
            for k in range(j):
                rest = rest - done(i, k) * done(j, k)
            floored = floored.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / done(j, j))
    logdet = sum((2 * F.log(F.col(f"l{i}{i}")) for i in p), F.lit(0.0))
    return floored.select(*keys, *[f"m{i}" for i in p], *raw, *[f"l{i}{j}" for i in p for j in range(i + 1)], logdet.alias("ld"))


def _sent(groups: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(groups) if few else groups


def _far(rows: DataFrame, estimate: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the other columns of their group's estimates, one row an estimate, and the squared distance ``d``."""
    p = range(len(FEATURES))
    low = [[F.col(f"l{i}{j}") for j in range(i + 1)] for i in p]
    used = [f"m{i}" for i in p] + [f"l{i}{j}" for i in p for j in range(i + 1)]
    rest = [c for c in estimate.columns if c not in used and not c.startswith("v")]
    return rows.join(_sent(estimate.select(*rest, *used), few), "g").withColumn("d", distance(low, [F.col(f"m{i}") for i in p])).drop(*used)


def concentrate(rows: DataFrame, few: bool) -> DataFrame:
    """The minimum-covariance-determinant estimate (g, m*, l*) of each group ``g``, of which there may be few.

    Each step is one query over the rows: the limit of each (group, start), then the moments of the rows within it.
    Its result, a row a (group, start), is written to the shared folder; the next step reads those that still fall.
    """
    p, group = range(len(FEATURES)), ["g", "start"]
    diagonal = lambda value: [(value(i) if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i in p for j in range(i + 1)]
    plain = rows.groupBy("g").agg(
        *[F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, f in enumerate(FEATURES)],
        *[F.avg(f).alias(f"a{i}") for i, f in enumerate(FEATURES)], *[F.var_pop(f).alias(f"s{i}") for i, f in enumerate(FEATURES)])
    median = plain.select("g", F.lit("median").alias("start"), *[F.col(f"q{i}")[1].alias(f"m{i}") for i in p],
                          *diagonal(lambda i: ((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2))
    mean = plain.select("g", F.lit("mean").alias("start"), *[F.col(f"a{i}").alias(f"m{i}") for i in p], *diagonal(lambda i: F.col(f"s{i}")))
    live = _estimate(median.unionByName(mean), group, 1.0).withColumn("ld", F.lit(float("inf")))
    spark, base = rows.sparkSession, shared_folder(rows.sparkSession) + f"/quality-{uuid.uuid4().hex}"
    schema, steps = None, 0
    while steps < STEPS:
        far = _far(rows, live.withColumnRenamed("ld", "last"), few)
        limit = far.groupBy(*group).agg(F.percentile_approx("d", SHARE, 1000).alias("limit"), F.max("last").alias("last"))
        near = far.drop("last").join(_sent(limit, few), group).filter(F.col("d") <= F.col("limit"))
        step = _estimate(near.groupBy(*group, "last").agg(*_moments()), [*group, "last"], 1.0)
        step.write.parquet(f"{base}/step={steps}")
        schema, steps = step.schema, steps + 1
        live = spark.read.schema(schema).parquet(f"{base}/step={steps - 1}").filter(F.col("ld") < F.col("last") - FALL).drop("last")
        if live.isEmpty():
            break
    found = spark.read.schema(schema).parquet(*[f"{base}/step={k}" for k in range(steps)]).drop("last")
    least = found.groupBy(*group).agg(F.min_by(F.struct(*[c for c in found.columns if c not in group]), "ld").alias("e")).select(*group, "e.*")
    estimate = _estimate(least, group, CONSISTENT)
    best = estimate.groupBy("g").agg(F.min_by(F.struct(*[c for c in estimate.columns if c not in group]), "ld").alias("e"))
    return cut(best.select("g", "e.*").drop("ld"))


def judge(docs: DataFrame, key: bool = False) -> DataFrame:
    """doc_id, the five counts, base_failed, d (squared distance, null if base_failed) and kept.

    ``key`` adds the hash of the text, which tells rows of one doc_id apart.
    """
    told = cut(counts(docs, "lang", "source").withColumn("base_failed", base_failed()))
    rows = told.filter(~F.col("base_failed")).select("*", *features())
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    of_lang = Window.partitionBy("lang")
    level = F.when(F.col("n") >= LEAST_ROWS, 0).when(F.col("n_lang") >= LEAST_ROWS, 1).otherwise(2)
    levels = sizes.withColumn("n_lang", F.sum("n").over(of_lang)).withColumn("level", level)
    levels = cut(levels.withColumn("lang_used", F.max((F.col("level") == 1).cast("int")).over(of_lang) == 1))
    few, all_used = levels.count() <= SENT_GROUPS, not levels.filter("level = 2").isEmpty()
    name = lambda depth, *keys: F.to_json(F.struct(F.lit(depth).alias("level"), *keys))
    names = [name(0, "lang", "source"), name(1, "lang"), name(2)]
    groups = levels.select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"),
        F.when(F.col("level") == 0, names[0]).when(F.col("level") == 1, names[1]).otherwise(names[2]).alias("own"),
        F.array_compact(F.array(F.when(F.col("level") == 0, names[0]), F.when(F.col("lang_used"), names[1]), *[names[2]] * all_used)).alias("used"))
    grouped = cut(rows.join(
        _sent(groups, few), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))).drop("g_lang", "g_source"))
    estimates = concentrate(grouped.select(F.explode("used").alias("g"), *FEATURES), few)
    judged = _far(grouped.withColumnRenamed("own", "g"), estimates, few)
    told_columns = ["doc_id", *["key"] * key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = judged.select(*told_columns, "d").unionByName(
        told.filter("base_failed").select(*told_columns, F.lit(None).cast("double").alias("d")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("d", F.lit(0.0)) <= CUT))
