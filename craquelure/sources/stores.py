"""Tables on disk: splinters, settings, layers, sensor and summary exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
LAYER_PARTITIONS = ["prop", "boundary", "thickness", "break_pos"]


def bucket(column: str = "specimen_id", buckets: int = BUCKETS):
    return F.pmod(F.hash(column), F.lit(buckets))


def save_splinters(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Partitioned by a hash of the specimen, sorted inside a file.

    A range shuffle on (bucket, specimen, splinter) balances the files also when one
    specimen holds much of the data, and keeps the file count near the task count.
    """
    d = df.withColumn("bucket", bucket(buckets=buckets))
    d = d.repartitionByRange("bucket", "specimen_id", "splinter_key").sortWithinPartitions("bucket", "specimen_id")
    d.write.mode("overwrite").partitionBy("bucket").parquet(path)


def load_splinters(spark: SparkSession, path: str, specimens=None, buckets: int = BUCKETS) -> DataFrame:
    """All splinters, or those of a few specimens: the folders of other buckets are pruned."""
    d = spark.read.parquet(path)
    if specimens is not None:
        ids = [int(s) for s in specimens]
        wanted = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "specimen_id bigint").select(bucket(buckets=buckets)).distinct().collect()]
        d = d.filter(F.col("bucket").isin(wanted) & F.col("specimen_id").isin(ids))
    return d.drop("bucket")


def save_layer(long: DataFrame, path: str) -> None:
    """Store a layer; missing values and incomplete grids are refused."""
    value = F.col("value")
    if not long.filter(value.isNull() | F.isnan(value)).isEmpty():
        raise ValueError("layer contains missing values")
    per_row = long.groupBy(*LAYER_PARTITIONS, "specimen_id", "u").agg(F.count(F.lit(1)).alias("n"))
    uneven = per_row.groupBy(*LAYER_PARTITIONS).agg(F.min("n").alias("a"), F.max("n").alias("b")).filter("a <> b")
    if not uneven.isEmpty():
        raise ValueError("layer rows differ in their number of radii")
    d = long.repartition(*LAYER_PARTITIONS, F.pmod(F.hash("specimen_id"), F.lit(16))).sortWithinPartitions(*LAYER_PARTITIONS, "u", "r")
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYER_PARTITIONS).parquet(path)


def load_layer(spark: SparkSession, path: str, **where) -> DataFrame:
    """Rows of the chosen ``prop``, ``boundary``, ``thickness``, ``break_pos``; others are pruned."""
    d = spark.read.parquet(path)
    for column, value in where.items():
        d = d.filter(F.col(column) == value)
    return d


def has_layer(spark: SparkSession, path: str, **where) -> bool:
    try:
        return not load_layer(spark, path, **where).isEmpty()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def read_fall_heights(spark: SparkSession, path: str) -> DataFrame:
    """``;`` separated, one header line, name first; numeric column 7 is the height in cm."""
    columns = ["name"] + [f"v{i}" for i in range(8)]
    schema = ", ".join(["name string"] + [f"{c} double" for c in columns[1:]])
    d = spark.read.option("sep", ";").option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    return d.select("name", (F.col("v7") * 1e-2).alias("fall_height_m"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """One settings file per specimen folder: the text and the folder name."""
    d = spark.read.option("wholetext", True).text(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return d.select(name.alias("name"), F.col("value").alias("settings"))
