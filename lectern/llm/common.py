"""Helpers that the training-data operators share: tables, work folder, gapless ranks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_work: dict[str, str] = {}
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, so that they find it wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="lectern-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def work_dir(spark: SparkSession) -> str:
    """A folder of this application below the one all executors share (spark.checkpoint.dir); it goes when the
    driver's JVM ends. Without that setting a temporary folder serves a local master; a cluster is refused,
    as its executors would not see each other's files."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _work:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _work[app] = f"{shared.rstrip('/')}/lectern-{app}" if shared else tempfile.mkdtemp(prefix="lectern-work-")
        path = context._jvm.org.apache.hadoop.fs.Path(_work[app])
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return _work[app]


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and where it is."""
    path = f"{work_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written within has its shuffle files deleted as soon as it stands, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, gives the reader true sizes,
    and survives the loss of executors."""
    return stored(df, label)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing will read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def join_skewed(rows: DataFrame, values: DataFrame, keys: list[str], total: int, parts: int = 1000) -> DataFrame:
    """rows inner-joined with values (keys, _n, ...), which has one row for each key; _n: the rows that hold it,
    of `total` in all. Keys are not null; other columns of values have names of their own.

    Fewer than `parts` keys can hold over 1/parts of the rows: their values are broadcast. The others are
    sorted and merged, where no key has more than that share."""
    heavy = F.col("_n") * parts > total
    names = [c for c in values.columns if c not in (*keys, "_n")]
    hot = values.where(heavy).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.struct(F.lit(1).alias("_one"), *names).alias("_value"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_hot_{k}"))
    marked = rows.join(F.broadcast(hot), same, "left").drop(*[f"_hot_{k}" for k in keys])
    near = marked.where("_value is not null").select(*rows.columns, *[F.col(f"_value.{c}").alias(c) for c in names])
    far = marked.where("_value is null").drop("_value").join(values.where(~heavy).drop("_n").hint("merge"), keys)
    return near.unionByName(far.select(near.columns))


#: Rows of one part of a key, on average, that salted_rank lets a task order.
PART_ROWS = 1_000_000


def salted_rank(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Adds `name`: a gapless rank from 0 of each row within keys, without a task that sees a whole key.

    Rows of a key are dealt over parts by a hash of `order`, as many as `rows` (how many df has) asks for; each
    part ranks its own rows and starts where the parts before it end. The table of part sizes has at most
    keys x parts rows."""
    salts = max(64, -(-rows // PART_ROWS))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salts)))
    sizes = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    on: Column = F.lit(True)
    left, right = salted.alias("l"), starts.alias("r").hint("merge")
    for c in [*keys, "_salt"]:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return (
        left.join(right, on)
        .select("l.*", F.col("r._start"))
        .withColumn(name, F.col("_start") + F.row_number().over(within) - 1)
        .drop("_salt", "_start")
    )
