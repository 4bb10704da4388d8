"""Residual-stress project files: one XML row per ``Measurement`` node.

The curves are base64 blocks of little-endian float32, bool or int8; they are decoded a
whole Arrow batch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from craquelure.functions.names import normalised_name

# Element and attribute names of a project file.
MEASUREMENT_SCHEMA = (
    "Specimen struct<_Name:string,_Note:string,_Direction:string,_GlassThickness:double>, "
    "StressDistribution struct<Depth:string,Stress:string,Active:string,Fit:string>, "
    "MeasuredData struct<Data:array<struct<StressDistribution:struct<Retardation:string>>>>, "
    "StressValues string"
)
NUMPY_TYPES = {"float": np.float32, "boolean": np.bool_, "tinyint": np.int8}
ARROW_TYPES = {"float": pa.float32(), "boolean": pa.bool_(), "tinyint": pa.int8()}


def decoded(col: Column, kind: str = "float") -> Column:
    """Base64 text to an array of numbers; missing text stays missing."""
    dtype, arrow = NUMPY_TYPES[kind], ARROW_TYPES[kind]

    def read(blocks: pa.Array) -> pa.Array:
        values = [None if b is None else np.frombuffer(b, dtype=dtype) for b in blocks.to_pylist()]
        return pa.array(values, pa.list_(arrow))

    return F.arrow_udf(read, f"array<{kind}>")(F.unbase64(F.trim(col)))


def encoded(col: Column) -> Column:
    """Array of numbers to the base64 text of its float32 block."""

    def write(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else np.asarray(v, np.float32).tobytes() for v in values.to_pylist()], pa.binary())

    return F.base64(F.arrow_udf(write, "binary")(col))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "Measurement").schema(MEASUREMENT_SCHEMA).load(path)
    return measurements(raw)


def parse_measurements(df: DataFrame, column: str) -> DataFrame:
    """The same from a column of ``Measurement`` texts."""
    parsed = df.select(F.from_xml(column, MEASUREMENT_SCHEMA, {"rowTag": "Measurement"}).alias("_m"))
    return measurements(parsed.select("_m.*"))


def measurements(raw: DataFrame) -> DataFrame:
    """Nodes without specimen or stress curve are left out."""
    d = raw.filter("Specimen is not null and StressDistribution is not null")
    curve = lambda name, kind: decoded(F.col(f"StressDistribution.{name}"), kind).alias(name.lower())
    texts = F.transform(F.col("MeasuredData.Data"), lambda x: x["StressDistribution"]["Retardation"])
    pair = r'<(\w+)[^>]*?\bCol1="([^"]*)"(?:[^>]*?\bCol2="([^"]*)")?'
    part = lambda group: F.regexp_extract_all("StressValues", F.lit(pair), F.lit(group))
    values = F.zip_with(
        F.arrays_zip(part(1).alias("name"), part(2).alias("avg")),
        part(3),
        lambda a, dev: F.struct(
            a["name"].alias("name"),
            F.coalesce(a["avg"].try_cast("double"), F.lit(0.0)).alias("value"),
            F.coalesce(dev.try_cast("double"), F.lit(0.0)).alias("deviation"),
        ),
    )
    return d.select(
        normalised_name(F.col("Specimen._Name")).alias("specimen"),
        F.col("Specimen._Note").alias("location"),
        F.replace(F.col("Specimen._Direction"), F.lit("-axis"), F.lit("")).alias("orientation"),
        F.col("Specimen._GlassThickness").alias("measured_thickness"),
        values.alias("stress_values"),
        curve("Depth", "float"),
        curve("Stress", "float"),
        curve("Active", "boolean"),
        curve("Fit", "tinyint"),
        F.filter(texts, lambda x: x.isNotNull()).alias("retardation_text"),
    )


def retardations(df: DataFrame) -> DataFrame:
    """One row per measured retardation curve, numbered in file order."""
    d = df.select("specimen", "location", "orientation", F.posexplode("retardation_text").alias("nr", "text"))
    return d.select("specimen", "location", "orientation", "nr", decoded(F.col("text")).alias("retardation"))


def depth_rows(df: DataFrame) -> DataFrame:
    """Text export: one row per depth of a measurement."""
    kept = lambda c: F.coalesce(F.col(c), F.array()).alias(c)
    zipped = F.arrays_zip(*[kept(c) for c in ("depth", "stress", "active", "fit")])
    d = df.select("specimen", "location", "orientation", F.posexplode(zipped).alias("i", "z"))
    return d.select("specimen", "location", "orientation", "i", "z.depth", "z.stress", "z.active", "z.fit")
