"""Pairs within a distance, nearest neighbours, touching contours.

Points are bucketed by grid cell and compared with the cells around, never across a pane.
Blocks of cells are part of the shuffle's key, so one huge pane spreads over them. Points at the
same location are merged first wherever only counts matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from craquelure.operators.ordered import cuts_of, in_runs, part_of, python_groups, quantiles
from craquelure.session import checkpointed

# Points a tile of the neighbour search should have
TILE_POINTS = 4096
# A block of the pair counts has 2**BLOCK_BITS cells a side; pairs that are looked at together
BLOCK_BITS = 3
# The same for the lists of pairs, where a point carries its name: fewer copies
PAIR_BLOCK_BITS = 4
PAIRS_AT_ONCE = 1 << 20
# hashes of eight bytes that may go to every task
SPOTS_SENT = 1 << 20
# the cell itself and the four cells "ahead"; the other four are reached from there
HALF_BLOCK = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]


def cell(df: DataFrame, size: float, x="x_mm", y="y_mm") -> DataFrame:
    return df.withColumn("_cx", F.floor(F.col(x) / size)).withColumn("_cy", F.floor(F.col(y) / size))


def _in_blocks(points: DataFrame, d_max: float, x: str, y: str, bits: int = BLOCK_BITS) -> DataFrame:
    """Points with their cell ``_cx, _cy``, once for each block ``_bx, _by`` of ``2**bits`` cells that looks at them.

    A block looks at its own cells and at those that :data:`HALF_BLOCK` reaches from them. A point
    without a place keeps block 0.
    """
    none = F.lit(0).cast("bigint")
    d = cell(points, d_max, x, y).withColumn("_cx", F.coalesce("_cx", none)).withColumn("_cy", F.coalesce("_cy", none))
    block = lambda c: F.shiftright(c, bits)
    d = d.withColumn("_xs", F.sequence(block(F.col("_cx") - 1), block(F.col("_cx"))))
    d = d.withColumn("_ys", F.sequence(block(F.col("_cy") - 1), block(F.col("_cy") + 1)))
    d = d.withColumn("_bx", F.explode("_xs")).withColumn("_by", F.explode("_ys"))
    return d.select(*points.columns, "_cx", "_cy", "_bx", "_by")


def _merged(columns: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct combination, its total weight); values are told apart by their bits."""
    bits = [(c + 0.0).view(np.int64) if c.dtype.kind == "f" else c for c in columns]
    order = np.lexsort(bits[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([b[order][1:] != b[order][:-1] for b in bits])
    first = np.flatnonzero(new)
    return order[first], np.add.reduceat(weight[order], first) if len(first) else weight[:0]


def _candidates(looking: np.ndarray, low: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, other row) for each of ``looking`` with ``many`` rows from ``low`` on, about ``PAIRS_AT_ONCE`` at a time."""
    ends = np.cumsum(many)
    begin = 0
    while begin < len(looking):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + PAIRS_AT_ONCE, "right")))
        n = many[begin:end]
        a = np.repeat(looking[begin:end], n)
        yield a, np.arange(n.sum()) - np.repeat(ends[begin:end] - n - before, n) + np.repeat(low[begin:end], n)
        begin = end


def pairs_within(points: DataFrame, keys, ident: str, d_max: float, x="x_mm", y="y_mm") -> DataFrame:
    """Pairs ``(id_a, id_b, dist)`` with ``id_a < id_b`` and distance up to ``d_max``.

    A point crosses one shuffle for each block of ``2**PAIR_BLOCK_BITS`` cells a side that looks at it.
    There a row looks into its own cell and four of the eight neighbours; inside a cell ``ident``
    decides which of two rows looks at the other. Rows without a key or a place have no pair.
    """
    keys = list(keys)
    at = [*keys, "_bx", "_by"]
    side, inner = 1 << PAIR_BLOCK_BITS, (1 << PAIR_BLOCK_BITS) + 2
    types = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + f"id_a {types[ident]}, id_b {types[ident]}, dist double"
    d = points.select(*keys, F.col(ident).alias("_id"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    there = [F.col(k).isNotNull() for k in keys] + [F.abs(c) < F.lit(float("inf")) for c in ("_x", "_y")]
    d = _in_blocks(d.filter(reduce(Column.__and__, there)), d_max, "_x", "_y", PAIR_BLOCK_BITS).drop("_cx", "_cy")

    def pairs(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        lengths = np.diff(np.append(starts, table.num_rows))
        group = np.repeat(np.arange(len(starts)), lengths)
        px, py, bx, by = (table.column(c).to_numpy() for c in ("_x", "_y", "_bx", "_by"))
        # the place among the cells that the block looks at
        rx = np.floor(px / d_max).astype(np.int64) - side * bx
        ry = np.floor(py / d_max).astype(np.int64) - side * by + 1
        spot = (group * inner + rx) * inner + ry
        name = table.column("_id").combine_chunks()
        rank = pc.rank(name, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        nameless = name.is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((rank, spot))
        cells, px, py, rank = spot[order], px[order], py[order], rank[order]
        looking = np.flatnonzero(((rx < side) & (ry >= 1) & (ry <= side))[order])
        # behind the rows of a cell that share a name
        last = np.ones(len(order), bool)
        last[:-1] = (cells[1:] != cells[:-1]) | (rank[1:] != rank[:-1])
        behind = np.flatnonzero(last) + 1
        behind = behind[np.cumsum(last) - last]
        for i, j in HALF_BLOCK:
            target = cells[looking] + i * inner + j
            low = behind[looking] if (i, j) == (0, 0) else np.searchsorted(cells, target)
            for a, b in _candidates(looking, low, np.searchsorted(cells, target, "right") - low):
                dx, dy = px[a] - px[b], py[a] - py[b]
                dist = np.sqrt(dx * dx + dy * dy)
                near = dist <= d_max
                a, b, dist = a[near], b[near], dist[near]
                swap = rank[a] > rank[b]
                a, b = order[np.where(swap, b, a)], order[np.where(swap, a, b)]
                # a missing name gives way to the other, as in ``least``
                first, second = pa.array(np.where(nameless[a], b, a)), pa.array(b)
                out = {k: table.column(k).take(second) for k in keys}
                yield pa.table(out | {"id_a": name.take(first), "id_b": name.take(second), "dist": pa.array(dist)})

    return in_runs(d, at, [], pairs, schema)


def pair_counts(points: DataFrame, keys, d_max: float, steps: int, weight: bool = False, x="x_mm", y="y_mm", size=None) -> DataFrame:
    """Ordered pairs per key and distance step ``(k-1, k] * d_max/steps``; step 0 = same place.

    A pane is cut into blocks of ``2**BLOCK_BITS`` cells a side, and a point crosses one shuffle
    for each block that looks at it. Coinciding points are merged into one location with a count,
    so a pile of copies costs one row. ``weight`` applies the translation edge correction with
    pane columns ``size``.
    """
    keys = list(keys)
    extra = list(size or []) if weight else []
    at = [*keys, "_bx", "_by"]
    side, inner = 1 << BLOCK_BITS, (1 << BLOCK_BITS) + 2
    types = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "step int, pairs double"
    d = points.select(*keys, *extra, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    d = _in_blocks(d, d_max, "_x", "_y").withColumn("_w", F.lit(1.0))

    def values(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Coordinates and sizes as numbers, and which of them are missing."""
        columns = [table.column(c) for c in ("_x", "_y", *extra)]
        missing = [c.is_null().to_numpy().astype(np.int64) for c in columns]
        return [pc.fill_null(c.cast(pa.float64()), 0.0).to_numpy() for c in columns], missing

    def shrink(table: pa.Table) -> pa.Table:
        numbers, missing = values(table)
        kept, w = _merged([*numbers, *missing], table.column("_w").to_numpy())
        out = table.take(pa.array(kept))
        return out.set_column(out.column_names.index("_w"), "_w", pa.array(w))

    def count(table: pa.Table, starts: np.ndarray) -> pa.Table:
        lengths = np.diff(np.append(starts, table.num_rows))
        group = np.repeat(np.arange(len(starts)), lengths)
        numbers, missing = values(table)
        bx, by, cx, cy = (table.column(c).to_numpy() for c in ("_bx", "_by", "_cx", "_cy"))
        rx, ry = cx - side * bx, cy - side * by + 1
        spot = (group * inner + rx) * inner + ry
        kept, w = _merged([spot, *numbers, *missing], table.column("_w").to_numpy())
        spot, group = spot[kept], group[kept]
        own = (rx[kept] < side) & (ry[kept] >= 1) & (ry[kept] <= side)
        px, py, *sizes = (v[kept] for v in numbers)
        placed = np.isfinite(px) & np.isfinite(py) & (missing[0][kept] + missing[1][kept] == 0)
        piled = np.flatnonzero(own & (w > 1))
        groups, found, totals = [group[piled]], [np.zeros(len(piled), np.int64)], [w[piled] * (w[piled] - 1)]
        # locations are in the order of their cells, those without a place left out
        cells, px, py, w, group = spot[placed], px[placed], py[placed], w[placed], group[placed]
        sizes, looking = [v[placed] for v in sizes], np.flatnonzero(own[placed])
        for i, j in HALF_BLOCK:
            target = cells[looking] + i * inner + j
            low = looking + 1 if (i, j) == (0, 0) else np.searchsorted(cells, target)
            for a, b in _candidates(looking, low, np.searchsorted(cells, target, "right") - low):
                dx, dy = px[a] - px[b], py[a] - py[b]
                dist = np.sqrt(dx * dx + dy * dy)
                near = dist <= d_max
                a, b, dist = a[near], b[near], dist[near]
                value = 2 * w[a] * w[b]
                if weight:
                    across, up = np.abs(dx[near]), np.abs(dy[near])
                    value = value * (sizes[0][a] * sizes[1][a]) / ((sizes[0][a] - across) * (sizes[1][a] - up))
                step = np.minimum(np.ceil(dist / (d_max / steps)), steps).astype(np.int64)
                code, back = np.unique(group[a] * (steps + 1) + step, return_inverse=True)
                groups.append(code // (steps + 1))
                found.append(code % (steps + 1))
                totals.append(np.bincount(back, value, len(code)))
        group = np.concatenate(groups)
        out = {k: table.column(k).take(pa.array(starts[group])) for k in keys}
        out |= {"step": pa.array(np.concatenate(found), pa.int32()), "pairs": pa.array(np.concatenate(totals), pa.float64())}
        return pa.table(out)

    return in_runs(d, at, [], count, schema, shrink).groupBy(*keys, "step").agg(F.sum("pairs").alias("pairs"))


def _closest(qx, qy, px, py, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, distance) of the ``k`` nearest points of each query, nearest first, ties by the point's place in line."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    # few enough distances at once that they stay in the processor's cache
    step = min(max(1, (1 << 15) // max(1, len(px))), max(1, len(qx)))
    held = np.empty((2, step, len(px)))
    for at in range(0, len(qx), step):
        dist, dy = held[:, : min(step, len(qx) - at)]
        np.subtract(qx[at : at + step, None], px[None], out=dist)
        np.subtract(qy[at : at + step, None], py[None], out=dy)
        dist *= dist
        dy *= dy
        dist += dy
        np.sqrt(dist, out=dist)
        if len(px) > k:
            reached = dist <= np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
            if (np.count_nonzero(reached, axis=1) == k).all():
                p = (np.flatnonzero(reached) % len(px)).reshape(-1, k)
                d = np.take_along_axis(dist, p, 1)
                # points come in their order, which a stable sort keeps among equal distances
                order = np.argsort(d, axis=1, kind="stable")
                p, d = (np.take_along_axis(v, order, 1).ravel() for v in (p, d))
                found.append((np.repeat(np.arange(at, at + len(dist)), k), p, d))
                continue
            q, p = np.nonzero(reached)
        else:
            q, p = (v.ravel() for v in np.indices(dist.shape))
        d = dist[q, p]
        order = np.lexsort((p, d, q))
        q, p, d = q[order], p[order], d[order]
        some = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((q[some] + at, p[some], d[some]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _nearest(
    points: DataFrame, keys, ident: str, k: int, x: str, y: str, tile_points: int, totals: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ``k`` nearest points of every point: in lists ``near`` for panes of one tile; the points of larger panes,
    and ``(rank, neighbour, dist)`` for each of their places. With ``totals`` a list is added up where it was found.

    A pane is cut into tiles of about ``tile_points`` points (see :func:`tiled`), and a tile
    searches its own. A point farther from the tile's border than from its k-th nearest is
    done; the others visit the tiles that their circle reaches. A pane that fits a tile has no
    borders.
    """
    keys = list(keys)
    d = points.select(*keys, ident, x, y).join(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    each = ", ".join(f"`{c}` {types[c]}" for c in [*keys, ident])
    each += ", n bigint, farthest double, total double" if totals else f", near array<struct<neighbour:{types[ident]},dist:double>>"

    def whole(table: pa.Table, starts: np.ndarray) -> pa.Table:
        """A row for each point: its nearest in a list, or their number, largest and total distance."""
        made = []
        for first, n in zip(starts, np.diff(np.append(starts, table.num_rows))):
            pane = table.slice(first, n).sort_by(ident)
            px, py = (pane.column(c).to_numpy() for c in (x, y))
            q, p, dist = _closest(px, py, px, py, k)
            ends = np.searchsorted(q, np.arange(n + 1))
            out = pane.select([*keys, ident])
            if totals:
                out = out.append_column("n", pa.array(np.diff(ends), pa.int64()))
                # nearest first: the last one is the farthest
                out = out.append_column("farthest", pa.array(np.append(dist, 0.0)[ends[1:] - 1]))
                made.append(out.append_column("total", pa.array(np.bincount(q, dist, n))))
                continue
            names = pane.column(ident).combine_chunks().take(pa.array(p))
            near = pa.StructArray.from_arrays([names, pa.array(dist)], ["neighbour", "dist"])
            made.append(out.append_column("near", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)))
        return pa.concat_tables(made).combine_chunks()

    placed = d.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    small = in_runs(placed.filter(F.col("_n") <= tile_points).drop("_n"), keys, [], whole, each, rows=tile_points)
    large = placed.filter(F.col("_n") > tile_points)
    return small, large, _nearest_in_tiles(large, keys, ident, k, x, y, tile_points)


def nearest(points: DataFrame, keys, ident: str, k: int, x="x_mm", y="y_mm", tile_points: int = TILE_POINTS) -> DataFrame:
    """The ``k`` nearest points of every point, itself included: ``(id, rank, neighbour, dist)``, ties by id."""
    keys = list(keys)
    small, large, places = _nearest(points, keys, ident, k, x, y, tile_points)
    small = small.select(*keys, ident, F.posexplode("near").alias("rank", "_near"))
    small = small.select(*keys, ident, (F.col("rank") + 1).alias("rank"), "_near.neighbour", "_near.dist")
    large = large.select(*keys, x, y, ident).join(places, [*keys, x, y])
    return small.unionByName(large.select(*keys, ident, "rank", "neighbour", "dist"))


def nearest_totals(points: DataFrame, keys, ident: str, k: int, x="x_mm", y="y_mm", tile_points: int = TILE_POINTS) -> DataFrame:
    """Number, largest and total distance of the points that :func:`nearest` finds: ``(id, n, farthest, total)``.

    A row for each point that has any; the pairs are added up where they were found.
    """
    keys = list(keys)
    small, large, places = _nearest(points, keys, ident, k, x, y, tile_points, totals=True)
    totals = places.groupBy(*keys, x, y).agg(
        F.count(F.lit(1)).alias("n"), F.max("dist").alias("farthest"), F.sum("dist").alias("total")
    )
    large = large.select(*keys, x, y, ident).join(totals, [*keys, x, y])
    return small.filter("n > 0").unionByName(large.select(small.columns))


def tiled(points: DataFrame, keys, x: str, y: str, tile_points: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points with ``_strip, _tile`` and their box; the strips of each key ``_xs``; the tiles of each strip ``_ys``.

    Strips along ``x`` hold equally many points, tiles along ``y`` equally many of a strip's, cut
    by mergeable quantile sketches: a crowded place gets as many tiles as it has points for.
    """
    keys = list(keys)
    full = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), quantiles(x).alias("_q"))
    strips = full.select(*keys, cuts_of("_q", F.ceil(F.sqrt(F.col("_m") / tile_points)).cast("int")).alias("_xs"))
    d = points.join(strips, keys).withColumn("_strip", part_of(F.col(x), F.col("_xs")))
    full = d.groupBy(*keys, "_strip").agg(F.count(F.lit(1)).alias("_m"), quantiles(y).alias("_q"))
    tiles = full.select(*keys, "_strip", cuts_of("_q", F.ceil(F.col("_m") / tile_points).cast("int")).alias("_ys"))
    d = d.join(tiles, [*keys, "_strip"]).withColumn("_tile", part_of(F.col(y), F.col("_ys")))
    least, most = F.lit(float("-inf")), F.lit(float("inf"))
    for part, cuts, low, high in (("_strip", "_xs", "_x0", "_x1"), ("_tile", "_ys", "_y0", "_y1")):
        d = d.withColumn(low, F.coalesce(F.get(cuts, F.col(part) - 1), least))
        d = d.withColumn(high, F.coalesce(F.get(cuts, F.col(part)), most))
    return d.drop("_xs", "_ys"), strips, tiles


def _nearest_in_tiles(points: DataFrame, keys, ident: str, k: int, x: str, y: str, tile_points: int) -> DataFrame:
    """:func:`nearest` for each place in panes of several tiles; of the points in one place only
    the ``k`` with the smallest id can be among anybody's nearest, which a limited ranking keeps before the shuffle."""
    keys = list(keys)
    place = [*keys, x, y]
    rank_here = F.row_number().over(Window.partitionBy(*place).orderBy(ident))
    cand = points.select(*place, ident).withColumn("_r", rank_here).filter(F.col("_r") <= k).drop("_r")
    cand, strips, tiles = tiled(cand, keys, x, y, tile_points)
    at = [*keys, "_strip", "_tile"]
    types = {f.name: f.dataType.simpleString() for f in cand.schema.fields}
    found = ", ".join(f"`{c}` {types[c]}" for c in place) + f", rank int, neighbour {types[ident]}, dist double"

    def rows(key, qx, qy, rank, names, dist) -> pa.Table:
        made = {c: pa.repeat(v, len(qx)) for c, v in zip(keys, key)}
        made |= {x: pa.array(qx), y: pa.array(qy), "rank": pa.array(rank, pa.int32())}
        return pa.table(made | {"neighbour": names, "dist": pa.array(dist)})

    def own(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(ident)
        px, py = (table.column(c).to_numpy() for c in (x, y))
        x0, x1, y0, y1 = (table.column(c)[0].as_py() for c in ("_x0", "_x1", "_y0", "_y1"))
        qx, qy = np.unique(np.stack([px, py]), axis=1)
        q, p, dist = _closest(qx, qy, px, py, k)
        rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
        reach = np.full(len(qx), np.inf)
        reach[q[rank == k]] = dist[rank == k] * (1 + 1e-9)
        out = (qx - reach < x0) | (qx + reach >= x1) | (qy - reach < y0) | (qy + reach >= y1)
        some, names = ~out[q], table.column(ident).combine_chunks()
        inside = rows(key, qx[q[some]], qy[q[some]], rank[some], names.take(pa.array(p[some])), dist[some])
        n = int(out.sum())
        beyond = rows(key, qx[out], qy[out], np.zeros(n, np.int32), pa.nulls(n, names.type), reach[out])
        return pa.concat_tables([inside, beyond])

    def visited(key: tuple, table: pa.Table, guests: pa.Table) -> pa.Table:
        table = table.sort_by(ident)
        px, py = (table.column(c).to_numpy() for c in (x, y))
        qx, qy, reach = (guests.column(c).to_numpy() for c in (x, y, "reach"))
        q, p, dist = _closest(qx, qy, px, py, k) if len(px) else (np.zeros(0, np.int64),) * 3
        some = dist <= reach[q]
        q, p, dist = q[some], p[some], dist[some]
        names = table.column(ident).combine_chunks().take(pa.array(p))
        return rows(key, qx[q], qy[q], np.zeros(len(q), np.int32), names, dist)

    groups = python_groups(cand, *at)
    first = groups.applyInArrow(own, found)
    guests = first.filter("rank = 0").select(*place, F.col("dist").alias("reach")).join(strips, keys)
    low, high = (lambda c: F.col(c) - F.col("reach")), (lambda c: F.col(c) + F.col("reach"))
    span = lambda c, cuts: F.explode(F.sequence(part_of(low(c), F.col(cuts)), part_of(high(c), F.col(cuts))))
    guests = guests.withColumn("_strip", span(x, "_xs")).drop("_xs").join(tiles, [*keys, "_strip"])
    guests = guests.withColumn("_tile", span(y, "_ys")).select(*at, x, y, "reach")
    guests = guests.select(*(F.col(c).alias(c) for c in guests.columns))
    met = groups.cogroup(guests.groupBy(*at)).applyInArrow(visited, found)
    merged = F.row_number().over(Window.partitionBy(*place).orderBy("dist", "neighbour"))
    met = met.withColumn("rank", merged).filter(F.col("rank") <= k)
    return first.filter("rank > 0").unionByName(met)


# ---- contours that touch ----------------------------------------------------------------


def contested(contour_points: DataFrame, keys) -> DataFrame:
    """Contour points in places that occur more than once.

    One hash per point crosses the shuffle and is counted behind it. The hashes that occur twice
    are kept and counted: few go to every task, so that the points themselves are not shuffled at
    all; too many are joined by a shuffle. Equal hashes of different places only leave more
    points for the joins on the places that follow.
    """
    spot = F.xxhash64(*keys, "px", "py")
    spots = contour_points.select(spot.alias("_spot")).repartition("_spot")
    twice = spots.groupBy("_spot").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_spot")
    twice = checkpointed(twice)
    if twice.count() <= SPOTS_SENT:
        twice = F.broadcast(twice)
    return contour_points.withColumn("_spot", spot).join(twice, "_spot", "left_semi").drop("_spot")


def common_points(contour_points: DataFrame, keys=("specimen_id",), ident: str = "splinter_key") -> DataFrame:
    """Pairs of splinters with a common contour point (``id_a < id_b``) and their number."""
    keys = list(keys)
    p = contested(contour_points, keys).select(*keys, ident, "px", "py").distinct()
    on = [*keys, "px", "py"]
    pairs = p.withColumnRenamed(ident, "id_a").join(p.withColumnRenamed(ident, "id_b"), on).filter("id_a < id_b")
    return pairs.groupBy(*keys, "id_a", "id_b").agg(F.count(F.lit(1)).alias("n"))


def touching(contour_points: DataFrame, keys=("specimen_id",), ident: str = "splinter_key") -> DataFrame:
    """Pairs of splinters with a common contour point, each pair once (``id_a < id_b``)."""
    return common_points(contour_points, keys, ident).drop("n")


def shared_points(contour_points: DataFrame, keys=("specimen_id",), ident="splinter_key") -> DataFrame:
    """Matching entries of the flat point list, the earlier entry first."""
    keys = list(keys)
    p = contested(contour_points, keys)
    p = p.select(*keys, "px", "py", F.struct(ident, "k").alias("e"))
    pairs = p.withColumnRenamed("e", "a").join(p.withColumnRenamed("e", "b"), [*keys, "px", "py"]).filter("a < b")
    return pairs.select(
        *keys, "px", "py", F.col(f"a.{ident}").alias("id_a"), F.col("a.k").alias("k_a"), F.col(f"b.{ident}").alias("id_b"), F.col("b.k").alias("k_b")
    )


def symmetric(edges: DataFrame, keys=("specimen_id",)) -> DataFrame:
    """Both directions of every edge, without duplicates."""
    keys = list(keys)
    back = edges.select(*keys, F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))
    return edges.select(*keys, "id_a", "id_b").unionByName(back).distinct()


def neighbour_counts(splinters: DataFrame, edges: DataFrame, keys=("specimen_id",), ident="splinter_key") -> DataFrame:
    """Number of neighbours per splinter, zero included; ``edges`` must be symmetric."""
    keys = list(keys)
    counts = edges.groupBy(*keys, F.col("id_a").alias(ident)).agg(F.count(F.lit(1)).alias("n"))
    d = splinters.select(*keys, ident).join(counts, [*keys, ident], "left")
    return d.withColumn("n", F.coalesce("n", F.lit(0)))
