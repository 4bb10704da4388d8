"""Report tables and file sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from craquelure.operators.ordered import chunk_of, key_stats

# The three 50 x 50 mm report boxes sit 75 mm from the corners and in the middle.
REPORT_BOX = 50.0
REPORT_OFFSET = 75.0


def region_report(df: DataFrame) -> DataFrame:
    """Splinters inside the three report boxes, renumbered per box, with box statistics."""
    half = REPORT_BOX / 2
    w, h = F.col("w_mm"), F.col("h_mm")
    centres = [
        (F.lit(REPORT_OFFSET), F.lit(REPORT_OFFSET)),
        (w / 2, h / 2),
        (w - REPORT_OFFSET, h - REPORT_OFFSET),
    ]
    box: Column = F.lit(None).cast("int")
    for k, (cx, cy) in enumerate(centres):
        inside = F.col("x_mm").between(cx - half, cx + half) & F.col("y_mm").between(cy - half, cy + half)
        box = F.when(inside, F.lit(k)).otherwise(box)
    d = df.withColumn("box", box).filter("box is not null")
    d = d.withColumn("to_impact_x", F.col("ip_x") - F.col("x_mm")).withColumn("to_impact_y", F.col("ip_y") - F.col("y_mm"))
    keys = ["specimen_id", "box"]
    d = key_stats(d, keys, mean_area=F.avg("area"), std_area=F.stddev_pop("area"))
    # numbered by counts per key prefix, so no task orders a whole box
    return numbered(d, keys, "splinter_key")


def numbered(df: DataFrame, keys, order: str, out: str = "nr", prefix: int = 3) -> DataFrame:
    """0-based number per key in text order, built from counts per leading characters."""
    keys = list(keys)
    d = df.withColumn("_p", F.substring(order, 1, prefix))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        d.groupBy(*keys, "_p")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*keys, "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys, "_p").orderBy(order)
    return (
        d.withColumn(out, F.row_number().over(inside) - 1)
        .join(starts, keys + ["_p"])
        .withColumn(out, (F.col(out) + F.col("_start")).cast("bigint"))
        .drop("_p", "_start")
    )


def wide_channels(df: DataFrame, channels, key: str = "specimen_id") -> DataFrame:
    """Recording as a wide table: three summary rows, then one row per sample number.

    The channel list is given, so the pivot needs no extra pass; short channels end in
    missing values.
    """
    from craquelure.operators.signals import extremes

    channels = list(channels)
    body = df.groupBy(key, "seq").pivot("channel", channels).agg(F.first("value"))
    body = body.select(key, F.lit("").alias("label"), F.col("seq").cast("bigint").alias("seq"), *channels)
    summary = extremes(df, (key, "channel"))
    parts = [("Maximum", "maximum"), ("Minimum", "minimum"), ("Time of Maximum", "t_maximum")]
    rows = F.array(
        *[F.struct(F.lit(i - len(parts)).alias("seq"), F.lit(name).alias("label"), F.col(c).alias("v")) for i, (name, c) in enumerate(parts)]
    )
    head = summary.select(key, "channel", F.explode(rows).alias("_r")).select(key, "channel", "_r.*")
    head = head.groupBy(key, "label", "seq").pivot("channel", channels).agg(F.first("v"))
    return head.select(key, "label", F.col("seq").cast("bigint").alias("seq"), *channels).unionByName(body)


def write_csv(df: DataFrame, path: str, sep: str = ";", decimal: str = ".", order=()) -> None:
    """Distributed CSV; a decimal comma is applied to the numeric columns only."""
    d = df
    if decimal != ".":
        for field in df.schema.fields:
            if field.dataType.typeName() in ("double", "float"):
                d = d.withColumn(field.name, F.translate(F.col(field.name).cast("string"), ".", decimal))
    if order:
        d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    d.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# Fields of a simulation record.
SIMULATION_SCHEMA = (
    "energy double, fracture_intensity double, hc_radius double, acceptance double, "
    "impact_position array<double>, area double, size array<double>, nue double, sizef double, "
    "reference string, reference_sigma double, reference_thickness double, mse double"
)


def fixed(x: Column, digits: int) -> Column:
    """Text with a fixed number of digits, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(x.cast("double"), digits))


def appendix_table(df: DataFrame) -> DataFrame:
    """Formatted table, ordered by thickness, stress, boundary and number.

    Rows of unknown boundary and rows with any missing column are dropped.
    """
    scalp = lambda c: F.when(F.col("has_scalp"), c)
    area_m2 = (F.col("w_mm") * 1e-3) * (F.col("h_mm") * 1e-3)
    d = df.filter(F.col("boundary").isin("A", "B", "Z")).orderBy("thickness", "nom_stress", "boundary", "nbr", "specimen_id")
    return d.select(
        "thickness",
        fixed(F.col("nom_stress"), 0).alias("stress"),
        "boundary",
        "nbr",
        scalp(fixed(F.col("measured_thickness"), 2)).alias("t_real"),
        scalp(fixed(-F.col("sig_h"), 0)).alias("stress_real"),
        F.when(F.col("has_splinters"), fixed(F.col("n50"), 0)).alias("n50"),
        scalp(fixed(F.col("u") * area_m2, 1)).alias("ut"),
        scalp(fixed(F.col("u"), 0)).alias("u"),
        scalp(fixed(F.col("u_d"), 0)).alias("ud"),
        fixed(F.col("crack_surface") * 1e-6, 2).alias("farea"),
        "specimen_id",
    ).na.drop("any")
