"""Physical-plan helpers: parallelism of Arrow stages and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cores(spark: SparkSession) -> int:
    return max(int(spark.sparkContext.defaultParallelism), int(spark.conf.get("spark.sql.shuffle.partitions", "8")) // 4, 2)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` only if the scan has fewer partitions than twice the cores.

    At scale a scan has thousands of splits and nothing is moved. A small file arrives as one split, and a
    CPU-bound Arrow stage over it would run on one core. Hashing by key, unlike round robin, gives the same
    partitions when a lost task is run again.
    """
    want = 2 * cores(df.sparkSession)
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application's checkpoints.

    It lies in the one the session names in spark.checkpoint.dir, shared by all executors. Only where that is unset and
    the master is local is it a temporary folder, removed when Python ends.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="litgraph-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and drop its lineage: for small tables, and those read once."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder: for large tables that several steps read.

    Columns are coded and compressed, and each reader takes only those it needs.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key up to which a window numbers them in one task
IN_ONE_TASK = 1_000_000


def place_within(df: DataFrame, key: str, order: list[Column], name: str, most: int = IN_ONE_TASK) -> DataFrame:
    """``df`` with the place, from 1, that a row has among those of its ``key``. The order has to be total.

    Keys of any size: beyond ``most`` rows of one, all are range-partitioned by key and order and sorted there, and
    each partition's rows are counted on from those before it.
    """
    largest = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    rows = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    rows = written(rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    parts = rows.groupBy(key, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(key, "__part", (before - F.col("__first") + 1).alias("__start"))
    return rows.join(starts, [key, "__part"]).withColumn(name, (F.col("__start") + F.col("__at")).cast("int")).drop("__part", "__at", "__start")
