"""Ordered series that stay balanced when one series holds most of the rows.

A plain ``Window.partitionBy(series).orderBy(t)`` puts a whole recording into one
task. Everything here works on bounded, order-preserving chunks of a series instead:
the frame functions see a chunk plus the few neighbour rows their frame needs, and
running totals are chunk totals plus the position inside the chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 17
# Rows that a call on whole groups takes together
RUN_ROWS = 1 << 16
# Quantiles that cuts are chosen from, and the accuracy of the sketch they are read from
SHARES = [i / 1024 for i in range(1, 1024)]
ACCURACY = 10_000


def key_stats(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """One row per key, joined back to every row of ``df``.

    The aggregate combines map-side, so a hot key costs nothing extra; the join is left
    to the optimizer, which broadcasts only below its size threshold and splits hot
    partitions beyond it.
    """
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, list(keys))


def cuts_of(quantiles: str, parts: Column) -> Column:
    """Inner borders of ``parts`` equally full parts, out of the quantiles for ``SHARES``."""
    places = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.ceil(i * (len(SHARES) + 1) / parts).cast("int") - 1)
    found = F.array_distinct(F.transform(places, lambda i: F.get(F.col(quantiles), i)))
    return F.when(parts > 1, found).otherwise(F.array().cast("array<double>"))


def part_of(value: Column, cuts: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= value))


def quantiles(column: str) -> Column:
    return F.percentile_approx(F.col(column).cast("double"), SHARES, ACCURACY)


def stretches(df: DataFrame, keys: Sequence[str], column: str, rows: int, out: str = "_cell") -> DataFrame:
    """Numbers, along ``column``, the stretches of about ``rows`` rows each key is cut into.

    The cuts come from a mergeable quantile sketch, so a burst gets as many stretches as it has
    rows for. Equal values stay together, and a key has ``len(SHARES) + 1`` stretches at most.
    """
    keys = list(keys)
    full = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), quantiles(column).alias("_q"))
    parts = F.ceil(F.col("_m") / rows).cast("int")
    d = df.join(full.select(*keys, cuts_of("_q", parts).alias("_cuts")), keys)
    return d.withColumn(out, part_of(F.col(column), F.col("_cuts")).cast("bigint")).drop("_cuts")


def sequence_number(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    ties: Sequence[str] = (),
    out: str = "seq",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """0-based row number per key, ordered by the numeric ``position`` and ``ties``.

    Rows are numbered inside :func:`stretches` of about ``chunk_rows`` rows and shifted by the
    number of rows in the stretches before.
    """
    keys = list(keys)
    d = stretches(df, keys, position, chunk_rows)
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        d.groupBy(*keys, "_cell")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*keys, "_cell", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(position, *ties)
    return (
        d.withColumn(out, F.row_number().over(inside) - 1)
        .join(starts, keys + ["_cell"])
        .withColumn(out, (F.col(out) + F.col("_start")).cast("bigint"))
        .drop("_cell", "_start")
    )


def chunk_of(seq: str = "seq", chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.floor(F.col(seq) / chunk_rows)


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    exprs: dict,
    before: int,
    after: int,
    seq: str = "seq",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Frame functions that look at most ``before``/``after`` rows away.

    ``exprs`` maps an output name to a function of the window specification. A row is
    copied to the neighbour chunks whose frames reach it, so every chunk is complete.
    """
    keys = list(keys)
    first = F.floor((F.col(seq) - after) / chunk_rows) if after else chunk_of(seq, chunk_rows)
    last = F.floor((F.col(seq) + before) / chunk_rows) if before else chunk_of(seq, chunk_rows)
    d = df.withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    w = Window.partitionBy(*keys, "_chunk").orderBy(seq)
    for name, build in exprs.items():
        d = d.withColumn(name, build(w))
    return d.filter(F.col("_chunk") == chunk_of(seq, chunk_rows)).drop("_chunk")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    sums: dict,
    seq: str = "seq",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Inclusive running sums along ``seq``: chunk-local sums plus the total before."""
    keys = list(keys)
    d = df.withColumn("_chunk", chunk_of(seq, chunk_rows))
    local = Window.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    for name, expr in sums.items():
        d = d.withColumn(f"_v_{name}", expr)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    totals = totals.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0.0)).alias(f"_b_{n}") for n in sums],
    )
    for name in sums:
        d = d.withColumn(name, F.sum(f"_v_{name}").over(local))
    d = d.join(totals, keys + ["_chunk"])
    for name in sums:
        d = d.withColumn(name, F.col(name) + F.col(f"_b_{name}"))
    return d.drop("_chunk", *[f"_{p}_{n}" for n in sums for p in ("v", "b")])


def neighbour(column: str, offset: int):
    """``lag`` (negative offset) or ``lead`` for :func:`rolling`."""
    if offset < 0:
        return lambda w: F.lag(column, -offset).over(w)
    return lambda w: F.lead(column, offset).over(w)


def framed(agg, before: int, after: int):
    """Aggregate over ``rowsBetween(-before, after)`` for :func:`rolling`."""
    return lambda w: agg.over(w.rowsBetween(-before, after))


def python_groups(df: DataFrame, *keys: str):
    """Groups for a Python function, on as many partitions as shuffles are set to.

    Such stages are bound by CPU, not by bytes, so they must not be merged into a few
    partitions just because their input is small. Grouping by the same keys needs no
    further shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).groupBy(*keys)


def _run_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First rows of the runs of equal ``keys``; missing values equal each other."""
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for key in keys:
        c = table.column(key).combine_chunks()
        a, b = c[:-1], c[1:]
        differ = pc.fill_null(pc.not_equal(a, b), False)
        if c.null_count:
            differ = pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b)))
        new |= differ.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1]) if table.num_rows else np.zeros(0, np.int64)


def in_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[pa.Table, np.ndarray], pa.Table | Iterator[pa.Table]],
    schema: str,
    shrink: Callable[[pa.Table], pa.Table] | None = None,
    rows: int = RUN_ROWS,
) -> DataFrame:
    """``fn(table, starts)`` on whole groups of ``keys``, many small ones in a call.

    Partitions are sorted by ``keys`` and ``order``, so that a group is a run of rows from one of
    ``starts`` to the next. A call of Python for every group would cost more than the work on it.
    A group longer than a batch is gathered first; ``shrink`` may make what was gathered smaller.
    What is much longer than its rows is better given back as several tables.
    """
    keys = list(keys)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartition(n, *keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, rows

        def given(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                made = fn(table, starts)
                for part in [made] if isinstance(made, pa.Table) else made:
                    yield from part.to_batches()

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < enough:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _run_starts(table, keys)
            last = int(starts[-1])
            yield from given(table.slice(0, last), starts[:-1])
            rest = table.slice(last)
            if shrink is not None and last == 0:
                rest = shrink(rest)
            held, size = rest.combine_chunks().to_batches(), rest.num_rows
            # a long group is not looked through again for every batch
            enough = max(rows, 2 * size)
        if size:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from given(table, _run_starts(table, keys))

    return d.mapInArrow(run, schema)
