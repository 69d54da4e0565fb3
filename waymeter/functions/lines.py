"""Distances of many polylines at once: Arrow batches of pairs, every vertex of one line against every segment of the other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geo import DEGREE_M, EARTH_M

#: Pairs of a vertex and a segment that are measured at a time.
AT_ONCE = 1 << 19


def flat(line: Column) -> Column:
    """A line's latitudes and longitudes in one array of numbers, by turns: the distances here read it like the line, and it goes to Python faster."""
    return F.flatten(F.transform(line, lambda p: F.array(p["lat"], p["lon"])))


def _places(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each line begins, its number of vertices, and all latitudes and longitudes."""
    size = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lines.flatten()
    if not pa.types.is_struct(flat.type):
        size, flat = size // 2, flat.to_numpy(zero_copy_only=False).astype(float)
        return np.cumsum(size) - size, size, flat[::2], flat[1::2]
    lat, lon = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lon"))
    return np.cumsum(size) - size, size, lat, lon


def _metres(y, x, y0, x0, y1, x1) -> np.ndarray:
    """As :func:`geo.segment_distance`."""
    k = np.cos(np.radians((y0 + y1) / 2)) * DEGREE_M
    dx, dy, px, py = (x1 - x0) * k, (y1 - y0) * DEGREE_M, (x - x0) * k, (y - y0) * DEGREE_M
    square = dx * dx + dy * dy
    t = np.clip((px * dx + py * dy) / square, 0.0, 1.0)
    d = np.hypot(px - t * dx, py - t * dy)
    at = np.flatnonzero(square == 0)
    if at.size:
        la, lb = np.radians(y[at]), np.radians(y0[at])
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(x0[at] - x[at]) / 2) ** 2
        d[at] = 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))
    return d


def _degrees(y, x, y0, x0, y1, x1) -> np.ndarray:
    """As :func:`spatial.planar`."""
    dx, dy, px, py = x1 - x0, y1 - y0, x - x0, y - y0
    square = dx * dx + dy * dy
    t = np.where(square == 0, 0.0, np.clip((px * dx + py * dy) / square, 0.0, 1.0))
    return np.hypot(px - t * dx, py - t * dy)


def _distances(a: pa.Array, b: pa.Array, over=np.fmax, metric=_metres) -> np.ndarray:
    """Of each pair of lines the largest (``over``) of the distances of a's vertices from b: NaN where a has no vertex, infinite where b has none. Vertices without a place are left out."""
    first, size, lat, lon = _places(a)
    begin, n, blat, blon = _places(b)
    out = np.where((size > 0) & (n == 0), np.inf, np.nan)
    segments = np.maximum(n - 1, np.minimum(n, 1))  # a single vertex is a segment without length

    def measured(p: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Over ``count`` vertices from ``at`` of each pair ``p``."""
        s, work = segments[p], count * segments[p]
        k = np.arange(work.sum()) - np.repeat(np.cumsum(work) - work, work)
        s = np.repeat(s, work)
        v, q = np.repeat(at, work) + k // s, np.repeat(begin[p], work) + k % s
        r = q + np.repeat((n[p] > 1).astype(np.int64), work)
        with np.errstate(all="ignore"):
            d = metric(lat[v], lon[v], blat[q], blon[q], blat[r], blon[r])
        return over.reduceat(np.fmin.reduceat(d, np.flatnonzero(k % s == 0)), np.cumsum(count) - count)

    work = size * segments
    small = np.flatnonzero((work > 0) & (work <= AT_ONCE))
    cuts = np.flatnonzero(np.diff((np.cumsum(work[small]) - 1) // AT_ONCE)) + 1
    for p in np.split(small, cuts):
        if p.size:
            out[p] = measured(p, first[p], size[p])
    for i in np.flatnonzero(work > AT_ONCE):
        step = max(1, AT_ONCE // segments[i])
        parts = [measured(np.array([i]), np.array([first[i] + j]), np.array([min(step, size[i] - j)]))[0] for j in range(0, size[i], step)]
        out[i] = over.reduce(parts)
    return out


def _column(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


@F.arrow_udf(T.DoubleType())
def directed_hausdorff(observed: pa.Array, source: pa.Array) -> pa.Array:
    """The largest distance of a vertex of ``observed`` from ``source``, as :func:`geo.directed_hausdorff`."""
    return _column(_distances(observed, source))


@F.arrow_udf(T.DoubleType())
def least_distance(observed: pa.Array, source: pa.Array) -> pa.Array:
    """The least distance of a vertex of ``observed`` from ``source``."""
    return _column(_distances(observed, source, np.fmin))


@F.arrow_udf(T.DoubleType())
def planar_distance(observed: pa.Array, source: pa.Array) -> pa.Array:
    """Degrees, as on a plane, of a vertex of ``observed`` from ``source`` at the least."""
    return _column(_distances(observed, source, np.fmin, _degrees))


def hausdorff(a: Column, b: Column) -> Column:
    return F.greatest(directed_hausdorff(a, b), directed_hausdorff(b, a))
