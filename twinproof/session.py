"""Session defaults and the one place that decides where shared files go."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "twinproof", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters pass their own session in."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.twinproof.scanPartitions", "8" if cores == "*" else cores)
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the wide projections need.

    The JVM leaves methods above 8000 bytecodes interpreted. With this limit Spark compiles
    such a stage as split, JIT-friendly projections instead of one huge method.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") != "8000":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_twinproof_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "twinproof-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*")):
            if path.suffix in (".py", ".json"):
                out.write(path, path.relative_to(root.parent).as_posix())
    sc.addPyFile(str(archive))
    sc._twinproof_shipped = True


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later passes read it, none recomputes it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: A session may name the partitions of its scans; otherwise they follow its cores.
SCAN_PARTITIONS = "spark.twinproof.scanPartitions"
#: Partitions a core of a scan that is dealt out. Two was the best of single runs (README).
DEALT_PER_CORE, LEAST_DEALT = 2, 8


def spread(df: DataFrame, *keys: str | Column, always: bool = False) -> DataFrame:
    """A scan dealt out by ``keys``: to the partitions that the session asks for, with ``always`` else by its cores.

    A row group is read by one task, and a narrow row can stand for a whole pair of documents: one row group of
    150,000 orders is two million field comparisons. Dealing the narrow rows costs little beside
    that. ``keys`` should be unique so that no partition is hot.
    """
    spark = df.sparkSession
    wanted = spark.conf.get(SCAN_PARTITIONS, None)
    if not wanted and always:
        wanted = max(DEALT_PER_CORE * spark.sparkContext.defaultParallelism, LEAST_DEALT)
    return df.repartition(int(wanted), *keys) if wanted else df


def late_filter(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on derived columns where they are computed.

    A plain filter is pushed below every projection by substituting their expressions, which
    re-runs the parsers inside the predicate (and makes it enormous). Going through a
    generated marker keeps each expression evaluated once.
    """
    return unrolled(df, "_keep", F.when(condition, F.array(F.lit(True)))).drop("_keep")


def unrolled(df: DataFrame, name: str, elements: Column) -> DataFrame:
    """``df`` with one row an element of the array, as ``name``; null elements and empty arrays give no row.

    A projection builds the array before the generator sees it. Inside a generator Spark interprets it row by row
    where the stage is too large to compile, and works out its type anew for every row. The outer variant
    keeps the optimizer from building the array twice for a size filter.
    """
    built = df.withColumn(f"{name}_all", elements)
    return built.select(*df.columns, F.explode_outer(f"{name}_all").alias(name)).filter(F.col(name).isNotNull())


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's checkpoint folder.

    ``spark.checkpoint.dir`` is the folder every executor can reach. Only in a local session
    that leaves it unset (tests) does a temporary folder stand in for it.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/twinproof/{name}-{uuid.uuid4().hex}"


MAX_DIM_ROWS = 10_000


def inline_dim(spark: SparkSession, columns: list[tuple[str, str]], rows: list[tuple]) -> DataFrame:
    """Broadcast a configuration table whose size is known and checked on the driver."""
    if len(rows) > MAX_DIM_ROWS:
        raise ValueError(f"configuration table has {len(rows)} rows; limit is {MAX_DIM_ROWS}")

    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, (int, float)):
            return repr(value)
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in columns)
    casts = ", ".join(f"CAST({name} AS {dtype}) AS {name}" for name, dtype in columns)
    return F.broadcast(spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})"))
