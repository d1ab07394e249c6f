"""The shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, one below the warehouse, but only on a local master."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a shared folder")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files are deleted as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, and safe from lost executors. What was shuffled
    for it is deleted then, not when the driver's JVM comes to collect garbage, so that it takes no disk beside later steps."""
    spark, at = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(at)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by `written` whose readers are written themselves, so that nothing can need them again."""
    for df in tables:
        spark = df.sparkSession
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not at.split(":", 1)[-1].lstrip("/").startswith(shared_dir(spark).split(":", 1)[-1].lstrip("/") + "/"):
                raise ValueError(f"{at} is not in the shared folder")
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
