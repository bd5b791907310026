"""Session and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corvane")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one made here where that is unset and everything runs on this machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", where)
        atexit.register(shutil.rmtree, where.removeprefix("file://"), True)
    return where


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, so that a lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    _forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed and sorted by ``key``: joins on it don't shuffle it again."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"corvane_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    _forget_at_exit(spark, path)
    table = spark.table(name)
    table._corvane = (name, path)
    return table


def drop(table: DataFrame) -> None:
    """Deletes a table made by ``bucketed`` that nothing reads any more."""
    spark, (name, path) = table.sparkSession, table._corvane
    spark.sql(f"drop table if exists {name}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    def forget() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone, and so is its cleaner
            pass

    atexit.register(forget)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
