"""Contour geometry. A contour is ``array<struct<px:int,py:int>>``, closed implicitly.

Sums over the edges, the convex hull and the simplification run on whole Arrow batches;
everything derived from them is a Column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


# Sums over the edges of a contour, relative to its first point and free of rounding:
# a = 2 m00, bx/by = 6 m10/m01, cxx/cyy = 12 m20/m02, cxy = 24 m11; peri/open are the
# lengths with and without the closing edge. mu20/mu02/mu11 are the central second moments,
# orientation-free; as expressions they are needed so often that the code Spark makes of them
# gets too long for the JVM's compiler.
MEASURES = (
    "struct<a:bigint,bx:bigint,by:bigint,cxx:bigint,cyy:bigint,cxy:bigint,peri:double,open:double,"
    "mu20:double,mu02:double,mu11:double>"
)


def flat(contours: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All points of a batch in a row: x, y, first position and length per contour."""
    points = contours.flatten()
    x = points.field("px").to_numpy(zero_copy_only=False).astype("int64")
    y = points.field("py").to_numpy(zero_copy_only=False).astype("int64")
    counts = contours.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    return x, y, np.cumsum(counts) - counts, counts


def _measure(contours: pa.Array) -> pa.Array:
    x, y, start, n = flat(contours)
    owner = np.repeat(np.arange(len(n)), n)
    following = np.arange(len(x)) + 1
    closing = following == (start + n)[owner]
    following = np.where(closing, start[owner], following)
    x0, y0 = x[start[owner]], y[start[owner]]
    x, y = x - x0, y - y0
    u, v = x[following], y[following]
    cross = x * v - u * y
    length = np.sqrt(((u - x) ** 2 + (v - y) ** 2).astype(float))

    def add(values):
        # an empty contour has no first position to reduce from
        full = n > 0
        out = np.zeros(len(n), values.dtype)
        if full.any():
            out[full] = np.add.reduceat(values, start[full])
        return out

    total = [
        add(cross),
        add(cross * (x + u)),
        add(cross * (y + v)),
        add(cross * (x * x + x * u + u * u)),
        add(cross * (y * y + y * v + v * v)),
        add(cross * (x * (2 * y + v) + u * (y + 2 * v))),
        add(length),
        add(np.where(closing, 0.0, length)),
    ]
    return pa.StructArray.from_arrays(
        [pa.array(t) for t in total] + _central(*total[:6]),
        ["a", "bx", "by", "cxx", "cyy", "cxy", "peri", "open", "mu20", "mu02", "mu11"],
    )


def _central(a, bx, by, cxx, cyy, cxy) -> list[pa.Array]:
    """Central second moments (20, 02, 11) out of the sums over the edges; missing without an area."""
    a, flatly = a.astype(float), a == 0
    sign, m00, mx, my = np.sign(a), np.where(flatly, 1.0, a / 2.0), bx / 6.0, by / 6.0
    found = [cxx / 12.0 - mx * mx / m00, cyy / 12.0 - my * my / m00, cxy / 24.0 - mx * my / m00]
    return [pa.array(sign * mu, mask=flatly) for mu in found]


def measures(contour: str | Column) -> Column:
    """Moments and lengths of each contour, a whole Arrow batch of edges at a time."""
    return F.arrow_udf(_measure, MEASURES)(contour)


@dataclass
class Shape:
    """Column expressions derived from one measures column (and the contour)."""

    m: Column
    contour: str = "contour"

    @property
    def perimeter(self) -> Column:
        return self.m["peri"]

    @property
    def open_length(self) -> Column:
        return self.m["open"]

    @property
    def area_px(self) -> Column:
        return F.abs(self.m["a"]) / 2.0

    def area(self, px_per_mm: float = 8.0) -> Column:
        return self.area_px / px_per_mm**2

    def _mean(self, part: str) -> Column:
        return F.try_divide(self.m[part] / 3.0, self.m["a"].cast("double"))

    @property
    def centroid(self) -> tuple[Column, Column]:
        p0 = F.get(self.contour, F.lit(0))
        return p0["px"] + self._mean("bx"), p0["py"] + self._mean("by")

    @property
    def centroid_px(self) -> tuple[Column, Column]:
        """Truncated towards zero; missing for a contour without area."""
        x, y = self.centroid
        trunc = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")
        return trunc(x), trunc(y)

    @property
    def central(self) -> tuple[Column, Column, Column]:
        """Central second moments (20, 02, 11), orientation-free."""
        return self.m["mu20"], self.m["mu02"], self.m["mu11"]

    @property
    def orientation_deg(self) -> Column:
        mu20, mu02, mu11 = self.central
        angle = F.degrees(0.5 * F.atan2(2 * mu11, mu20 - mu02))
        return F.when(angle < 0, angle + 180).otherwise(angle)

    @property
    def axis(self) -> tuple[Column, Column]:
        """Unit vector of the principal (major) axis; missing for five points or fewer."""
        rad = F.radians(self.orientation_deg)
        enough = F.size(self.contour) > 5
        return F.when(enough, F.cos(rad)), F.when(enough, F.sin(rad))

    @property
    def axis_lengths(self) -> tuple[Column, Column]:
        """Full axes of the ellipse with the same second moments."""
        mu20, mu02, mu11 = self.central
        m00 = self.area_px
        spread = F.sqrt(4 * mu11 * mu11 + (mu20 - mu02) * (mu20 - mu02))
        enough = F.size(self.contour) > 5

        def axis(sign):
            return F.when(enough, 4 * F.sqrt(F.greatest(F.lit(0.0), F.try_divide((mu20 + mu02 + sign * spread) / 2, m00))))

        return axis(1), axis(-1)


def roundness(area_px: Column, perimeter_px: Column) -> Column:
    return area_px / (perimeter_px * perimeter_px / (4 * math.pi))


# ---- vectors ----------------------------------------------------------------------------


def angle_deg(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.try_divide(ax * bx + ay * by, F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))


def alignment(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.abs(cosine(ax, ay, bx, by))


def signed_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle from a to b in 0..2π, by the sign of the cross product."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(ax, ay, bx, by)))
    return F.when(ax * by - ay * bx < 0, 2 * math.pi - F.acos(c)).otherwise(F.acos(c))


def ellipse_radius(a: Column, b: Column, theta: Column) -> Column:
    p, q = b * F.cos(theta), a * F.sin(theta)
    return a * b / F.sqrt(p * p + q * q)


# ---- hull and simplification ------------------------------------------------------------


# contours up to so many points are wrapped together, longer ones are chained one by one
TOGETHER = 64
# numbers that one array of projections may hold
PROJECTED = 1 << 22


def _padded(x: np.ndarray, y: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ragged contours of similar length as two arrays, short ones padded with their first point."""
    column = np.arange(n.max())
    take = start[:, None] + np.where(column[None, :] < n[:, None], column[None, :], 0)
    return x[take], y[take]


def hull_chain(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closed hull of one contour: the lower and the upper chain over its sorted points."""
    points = np.unique(np.column_stack([x, y]), axis=0).tolist()
    if len(points) < 3:
        ring = points + points[:1]
        return np.array([p[0] for p in ring]), np.array([p[1] for p in ring])

    def chain(ordered):
        out = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    ring = np.array(chain(points)[:-1] + chain(points[::-1]))
    return ring[:, 0], ring[:, 1]


def hull_points(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gift wrapping for a whole batch at once; finished hulls repeat their start."""
    rows = np.arange(len(x))
    start = np.lexsort((y, x), axis=1)[:, 0] if x.ndim > 1 else 0
    sx, sy = x[rows, start], y[rows, start]
    cx, cy = sx.copy(), sy.copy()
    hx, hy = [sx], [sy]
    done = np.zeros(len(x), bool)
    for _ in range(x.shape[1]):
        nx, ny = cx.copy(), cy.copy()
        for j in range(x.shape[1]):
            px, py = x[:, j], y[:, j]
            cross = (nx - cx) * (py - cy) - (ny - cy) * (px - cx)
            far = (px - cx) ** 2 + (py - cy) ** 2 > (nx - cx) ** 2 + (ny - cy) ** 2
            take = (cross < 0) | ((cross == 0) & far)
            nx, ny = np.where(take, px, nx), np.where(take, py, ny)
        done |= (nx == sx) & (ny == sy)
        cx, cy = np.where(done, sx, nx), np.where(done, sy, ny)
        hx.append(cx)
        hy.append(cy)
        if done.all():
            break
    return np.stack(hx, 1), np.stack(hy, 1)


def _boxes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Perimeter, sides and direction of the smallest rectangle around each closed hull."""
    dx, dy = np.diff(x, axis=1), np.diff(y, axis=1)
    length = np.hypot(dx, dy)
    with np.errstate(invalid="ignore", divide="ignore"):
        ux, uy = dx / length, dy / length
    # projections of every hull point on every edge direction
    along = ux[:, :, None] * x[:, None, :] + uy[:, :, None] * y[:, None, :]
    across = -uy[:, :, None] * x[:, None, :] + ux[:, :, None] * y[:, None, :]
    la, lb = np.ptp(along, axis=2), np.ptp(across, axis=2)
    size = np.where(length > 0, la * lb, np.inf)
    best = size.argmin(1)
    rows = np.arange(len(x))
    return np.column_stack([length.sum(1), la[rows, best], lb[rows, best], ux[rows, best], uy[rows, best]])


def hull_box(contours: pa.Array) -> pa.Array:
    """Hull perimeter and the smallest enclosing rectangle of each contour; missing for an empty one.

    ``la`` runs along the unit vector ``(ux, uy)`` of a hull edge, ``lb`` across it. Contours
    are taken together with others of like length, so a long one costs the others nothing.
    """
    x, y, start, n = flat(contours)
    out = np.full((len(n), 5), np.nan)
    kind = np.ceil(np.log2(np.maximum(n, 1))).astype(int)
    for k in np.unique(kind[(n > 0) & (n <= TOGETHER)]):
        rows = np.flatnonzero((kind == k) & (n > 0))
        many = max(1, PROJECTED // (2**k + 1) ** 2)
        for at in range(0, len(rows), many):
            some = rows[at : at + many]
            out[some] = _boxes(*hull_points(*_padded(x, y, start[some], n[some])))
    for i in np.flatnonzero(n > TOGETHER):
        hx, hy = hull_chain(x[start[i] : start[i] + n[i]], y[start[i] : start[i] + n[i]])
        out[i] = _boxes(hx[None, :], hy[None, :])[0]
    columns = [pa.array(c, mask=n == 0) for c in out.T]
    return pa.StructArray.from_arrays(columns, ["hull", "la", "lb", "ux", "uy"])


def hull_columns(contour: str | Column = "contour") -> Column:
    return F.arrow_udf(hull_box, "struct<hull:double,la:double,lb:double,ux:double,uy:double>")(contour)


def _keep_far(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on an open line, iterative."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        inner = points[a + 1 : b] - points[a]
        norm = np.hypot(*d)
        off = np.abs(d[0] * inner[:, 1] - d[1] * inner[:, 0]) / norm if norm else np.hypot(inner[:, 0], inner[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplified(points: np.ndarray, share: float) -> np.ndarray:
    """Closed contour split at the point farthest from its first one, both halves thinned; an empty one stays empty."""
    if not len(points):
        return points
    ring = np.vstack([points, points[:1]])
    tolerance = share * np.hypot(*np.diff(ring, axis=0).T).sum()
    split = int(np.hypot(*(points - points[0]).T).argmax())
    if split == 0:
        return points[:1]
    first = _keep_far(ring[: split + 1], tolerance)
    second = _keep_far(ring[split:], tolerance)
    return ring[np.concatenate([first, second[1:-1], [False]])]


def _far(ring: list[complex], stack: list[tuple[int, int]], tolerance: float) -> list[bool]:
    """:func:`_keep_far` for a few points, on plain numbers: an array for each short line costs more than its sums."""
    keep = [False] * len(ring)
    while stack:
        a, b = stack.pop()
        keep[a] = keep[b] = True
        if b - a < 2:
            continue
        first, d = ring[a], ring[b] - ring[a]
        norm, most, at = abs(d), -1.0, a
        for i in range(a + 1, b):
            p = ring[i] - first
            off = abs(d.real * p.imag - d.imag * p.real) / norm if norm else abs(p)
            if off > most:
                most, at = off, i
        if most > tolerance:
            stack += [(a, at), (at, b)]
    return keep


def simplified_together(points: np.ndarray, share: float) -> list[list[list[float]]]:
    """:func:`simplified` for contours of the same small number of points, ``points[contour, point, axis]``."""
    ring = np.concatenate([points, points[:, :1]], axis=1)
    side, away = np.diff(ring, axis=1), points - points[:, :1]
    tolerance = (share * np.hypot(side[..., 0], side[..., 1]).sum(1)).tolist()
    split = np.hypot(away[..., 0], away[..., 1]).argmax(1).tolist()
    out = []
    for rows, line, limit, at in zip(ring.tolist(), (ring[..., 0] + 1j * ring[..., 1]).tolist(), tolerance, split):
        if at == 0:
            out.append(rows[:1])
            continue
        last = len(line) - 1
        keep = _far(line, [(0, at), (at, last)], limit)
        out.append([p for p, kept in zip(rows[:last], keep) if kept])
    return out


def simplify(contour: str = "contour", share: float = 0.02) -> Column:
    """Thinned contour as ``array<array<double>>``."""

    def thin(contours: pa.Array) -> pa.Array:
        x, y, start, n = flat(contours)
        points = np.column_stack([x, y]).astype(float)
        thinned = [[]] * len(n)
        for k in np.unique(n[(n > 0) & (n <= TOGETHER)]):
            rows = np.flatnonzero(n == k)
            for i, found in zip(rows, simplified_together(points[start[rows][:, None] + np.arange(k)], share)):
                thinned[i] = found
        for i in np.flatnonzero(n > TOGETHER):
            thinned[i] = simplified(points[start[i] : start[i] + n[i]], share).tolist()
        return pa.array(thinned, pa.list_(pa.list_(pa.float64())))

    return F.arrow_udf(thin, "array<array<double>>")(contour)
