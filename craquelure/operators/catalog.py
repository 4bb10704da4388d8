"""Catalog scans, settings and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craquelure.functions import names
from craquelure.operators.ordered import sequence_number

# Setting keys, their types and defaults.
SETTINGS_SCHEMA = (
    "break_mode string, break_pos string, actual_break_pos array<double>, "
    "custom_break_pos_exclusion_radius double, custom_edge_exclusion_distance double, "
    "fall_height_m double, real_size_mm array<double>, fall_repeat int, "
    "excluded_sensor_positions array<int>, exclude_all_sensors boolean, "
    "excluded_positions array<array<double>>, excluded_positions_radius double"
)
SETTINGS_DEFAULTS = {
    "break_mode": "'punch'",
    "break_pos": "'corner'",
    "actual_break_pos": "cast(null as array<double>)",
    "custom_break_pos_exclusion_radius": "20e0",
    "custom_edge_exclusion_distance": "10e0",
    "fall_height_m": "0.07e0",
    "real_size_mm": "array(500e0, 500e0)",
    "fall_repeat": "1",
    "excluded_sensor_positions": "cast(array() as array<int>)",
    "exclude_all_sensors": "false",
    "excluded_positions": "cast(array() as array<array<double>>)",
    "excluded_positions_radius": "100e0",
}
# Default impact positions by break position (mm).
BREAK_POSITIONS = {"center": (250.0, 250.0), "corner": (50.0, 50.0), "navid": (1050.0, 10.0)}


def specimen_predicate(
    name=None,
    sigmas=None,
    delta: float = 10.0,
    energy: float | None = None,
    exclude: str | None = None,
    needs_scalp: bool = True,
    needs_splinters: bool = True,
    needs_scans: bool = False,
) -> Column:
    """Catalog predicate over ``name, sig_h, u, has_scalp, has_splinters[, has_scans]``.

    The last three tests exclude each other: with a stress range the energy is not
    looked at, and with either of them the scans are not.
    """
    keep = names.name_filter(F.col("name"), name)
    if exclude is not None:
        keep = ~names.prefix_match(F.col("name"), exclude) & keep
    if needs_scalp:
        keep = keep & F.col("has_scalp")
    if needs_splinters:
        keep = keep & F.col("has_splinters")
    limits = names.stress_range(sigmas, delta)
    if limits is not None:
        return keep & F.abs("sig_h").between(*limits)
    if energy is not None:
        return keep & (F.abs(F.col("u") - energy) < 0.05 * energy)
    if needs_scans:
        return keep & F.col("has_scans")
    return keep


def scan(
    catalog: DataFrame,
    decider: Column | None = None,
    value: Column | None = None,
    sort_by=None,
    max_n: int | None = None,
) -> DataFrame:
    """Filter, project, order and, if asked to, cap; hidden entries (leading dot) never show."""
    d = catalog.filter(~F.col("name").startswith("."))
    if decider is not None:
        d = d.filter(decider)
    order = list(sort_by or ["name", "specimen_id"])
    if value is not None:
        d = d.select(*order, value)
    d = d.orderBy(*order)
    return d.limit(max_n) if max_n is not None else d


def by_names(catalog: DataFrame, wanted) -> DataFrame:
    """A text is a prefix pattern, a one-element list a search, a longer list exact names."""
    col = F.col("name")
    if isinstance(wanted, str):
        return catalog.filter(names.prefix_match(col, wanted))
    if len(wanted) == 1:
        return catalog.filter(col.rlike(wanted[0]))
    return catalog.filter(col.isin(list(wanted)))


def settings(df: DataFrame, json_column: str) -> DataFrame:
    """Known keys only: the file's value where present, else the default."""
    parsed = df.withColumn("_s", F.from_json(json_column, SETTINGS_SCHEMA))
    filled = [
        F.coalesce(F.col(f"_s.{key}"), F.expr(default)).alias(key)
        for key, default in SETTINGS_DEFAULTS.items()
    ]
    return parsed.select(*[c for c in df.columns if c != json_column], *filled)


def impact_position(df: DataFrame) -> DataFrame:
    """Explicit position where set, else the default of the break position."""
    x = F.lit(None).cast("double")
    y = F.lit(None).cast("double")
    for pos, (px, py) in BREAK_POSITIONS.items():
        x = F.when(F.col("break_pos") == pos, F.lit(px)).otherwise(x)
        y = F.when(F.col("break_pos") == pos, F.lit(py)).otherwise(y)
    explicit = F.col("actual_break_pos")
    return df.withColumn("ip_x", F.coalesce(F.get(explicit, F.lit(0)), x)).withColumn(
        "ip_y", F.coalesce(F.get(explicit, F.lit(1)), y)
    )


def upsert(current: DataFrame, changes: DataFrame, keys) -> DataFrame:
    """New version of a keyed table: changed rows replace, new rows append."""
    kept = current.join(changes.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changes)


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """Keep the first row per key as one aggregate, so duplicates combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


def last_per_key(df: DataFrame, keys, order) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


def grid(spark, axes: dict) -> DataFrame:
    """Every combination of a few parameter lists, decoded from one distributed range."""
    size = 1
    for values in axes.values():
        size *= len(values)
    d = spark.range(size)
    step = size
    columns = []
    for name, values in axes.items():
        step //= len(values)
        index = (F.floor(F.col("id") / step) % len(values)).cast("int")
        columns.append(F.get(F.array(*[F.lit(v) for v in values]), index).alias(name))
    return d.select(F.col("id").alias("combination"), *columns)


def free_labels(spark, used: DataFrame, thicknesses, stresses, boundaries, numbers, n: int = 24) -> DataFrame:
    """The first ``n`` labels of the product (in list order) that are not in use."""
    label = F.concat_ws(
        ".",
        F.col("thickness").cast("string"),
        F.col("nom_stress").cast("string"),
        F.col("boundary"),
        names.two_digits(F.col("nbr")),
    )
    product = grid(
        spark,
        {"thickness": thicknesses, "nom_stress": stresses, "boundary": boundaries, "nbr": numbers},
    ).withColumn("name", label)
    free = product.join(used.select("name").distinct(), "name", "left_anti")
    return free.orderBy("combination").limit(n)


def distinct_valid(parts, keys=("name",), order=("name",), valid: Column | None = None) -> DataFrame:
    """Flatten several lists, drop invalid rows, keep the first row per name."""
    d = parts[0]
    for other in parts[1:]:
        d = d.unionByName(other)
    if valid is not None:
        d = d.filter(valid)
    return first_per_key(d, list(keys), list(order))


def every_nth(df: DataFrame, order, n: int) -> DataFrame:
    """Rows 0, n, 2n, … ordered by a numeric column and tie breakers."""
    numbered = sequence_number(df.withColumn("_all", F.lit(0)), ["_all"], order[0], order[1:], out="_i")
    return numbered.filter(F.col("_i") % n == 0).drop("_i", "_all")
