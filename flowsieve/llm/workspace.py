"""Tables that cut lineage, kept in the folder every executor shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, a local folder of this process, but only in local mode, where every task sees it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (root or _own_root()).rstrip("/")


@lru_cache(maxsize=1)
def _own_root() -> str:
    path = tempfile.mkdtemp(prefix="flowsieve-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def purge(spark: SparkSession) -> None:
    """Removes all intermediate tables; results that were not yet computed can no longer be."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/flowsieve")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Workspace:
    """A folder of intermediate Parquet tables for one run of an operator.

    A table written here survives the loss of executors and ends the plan above it.
    ``drop`` removes a table that later steps no longer read; ``close`` removes all.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/flowsieve/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, table: str, files: int | None = None, compression: str | None = None) -> DataFrame:
        """The table as written; ``files`` bounds the number of its files (see ``files_for``)."""
        to = f"{self.path}/{table}"
        (df if files is None else df.coalesce(files)).write.mode("overwrite").parquet(to, compression=compression)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, table: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        self.drop()


def files_for(rows: int, rows_a_file: int = 1 << 16) -> int:
    """Files that a table of at most so many rows is written to; small tables in many files cost more than they hold."""
    return max(1, -(-rows // rows_a_file))


#: Keys that may be hot at most: a key is if it has more than this part of all rows.
HOT_KEYS = 1000


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, total: int, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``left`` join ``right`` (one row a key) on ``key``; a key with over a thousandth of the ``total`` rows is dealt over many tasks by ``spread``.

    At most HOT_KEYS keys can be hot, so their list is broadcast whatever the input, and ``right`` grows by 2 * HOT_KEYS rows at most.
    ``left`` is read twice, or ``counted`` in its place where that has the same keys."""
    most = max(1 << 12, total // HOT_KEYS)
    sizes = (left if counted is None else counted).groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    hot = F.broadcast(sizes.select("__hot", F.ceil(F.col("__n") / most).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    dealt = left.join(hot, left[key] == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("__hot", "__salts")
    copies = right.join(hot, right[key] == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__hot", "__salts")
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")


def shuffle_width(spark: SparkSession) -> int:
    """Partitions to deal rows into: the session's own setting, which grows with the cluster and input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of one Arrow batch on its way to Python; Spark's own limit lets a task hold several times 64 MB.
BATCH_BYTES = 8 << 20


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of at most BATCH_BYTES (or one row), with this package on the workers' path.

    Lowers the session's ``spark.sql.execution.arrow.maxBytesPerBatch`` where it is higher."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    size = (spark.conf.get(key) or "").rstrip("b")
    if not size.isdigit() or int(size) > BATCH_BYTES or int(size) <= 0:
        spark.conf.set(key, f"{BATCH_BYTES}b")
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if HOME not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (HOME, paths) if x)
    return df.mapInArrow(run, schema)


def even_buckets(spark: SparkSession, n: int) -> list[int]:
    """n numbers that ``repartition(n, number)`` deals to n different partitions, in the partitions' order."""
    tried = spark.range(60 * n).select(F.col("id").cast("int").alias("x"))
    found = tried.groupBy(F.pmod(F.hash("x"), F.lit(n)).alias("p")).agg(F.min("x").alias("x")).collect()  # n rows
    return [r["x"] for r in sorted(found, key=lambda r: r["p"])]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
