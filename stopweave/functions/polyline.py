"""Polyline kernels in numpy: projection, sub-lines, simplification, Fréchet distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stopweave.functions.geo import EARTH_M


def haversine_m(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Metres between points (lat, lon in the last axis)."""
    a, b = np.radians(a), np.radians(b)
    h = np.sin((b[..., 0] - a[..., 0]) / 2) ** 2
    h = h + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.sin((b[..., 1] - a[..., 1]) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(h))


def _measures(line: np.ndarray) -> np.ndarray:
    return np.r_[0.0, np.cumsum(np.hypot(*np.diff(line, axis=0).T))] if len(line) else np.zeros(0)


def project(line: np.ndarray, point: np.ndarray) -> tuple[float, float]:
    """Planar distance of a point from a line and the fraction of the line's length at which it is nearest."""
    if len(line) == 1:
        return float(np.hypot(*(point - line[0]))), 0.0
    a, d = line[:-1], np.diff(line, axis=0)
    size = (d**2).sum(1)
    t = np.clip(np.where(size > 0, ((point - a) * d).sum(1) / np.where(size > 0, size, 1), 0), 0, 1)
    dist = np.hypot(*(a + t[:, None] * d - point).T)
    i = int(np.argmin(dist))
    m = _measures(line)
    return float(dist[i]), float((m[i] + t[i] * (m[i + 1] - m[i])) / m[-1]) if m[-1] > 0 else 0.0


def at_fraction(line: np.ndarray, fraction: float) -> np.ndarray:
    m = _measures(line)
    return np.array([np.interp(fraction * m[-1], m, line[:, k]) for k in (0, 1)])


def part(line: np.ndarray, begin: float, end: float) -> np.ndarray:
    """The piece between two fractions; reversed if they descend."""
    if begin > end:
        return part(line, end, begin)[::-1]
    m = _measures(line)
    inner = line[(m > begin * m[-1]) & (m < end * m[-1])]
    return np.concatenate([at_fraction(line, begin)[None], inner, at_fraction(line, end)[None]])


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Points that are needed to stay within the tolerance: the farthest from a chord is kept while it is beyond."""
    keep = np.zeros(len(line), bool)
    if not len(line):
        return line
    keep[[0, -1]] = True
    stack = [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        chord = line[b] - line[a]
        size = (chord**2).sum()
        inner = line[a + 1 : b] - line[a]
        t = np.clip(inner @ chord / size, 0, 1) if size > 0 else np.zeros(len(inner))
        dist = np.hypot(*(inner - t[:, None] * chord).T)
        i = int(np.argmax(dist))
        if dist[i] > tolerance:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return line[keep]


def densified(line: np.ndarray, metres: float) -> np.ndarray:
    """Extra points, so that no two neighbours are more than so many metres apart."""
    out = [line[:1]]
    for p, q in zip(line[:-1], line[1:], strict=True):
        n = max(1, int(np.ceil(haversine_m(p, q) / metres)))
        out.append(p + (q - p) * (np.arange(1, n + 1) / n)[:, None])
    return np.concatenate(out)


def frechet(a: np.ndarray, b: np.ndarray, metres: float | None = None, total: bool = False) -> float:
    """Discrete Fréchet distance in metres: the largest step, or with ``total`` the sum over steps, of the best walk."""
    if not (len(a) and len(b)):
        return float("nan")
    if metres:
        a, b = densified(a, metres), densified(b, metres)
    join = np.add if total else np.maximum
    last = None
    for p in a:
        d = haversine_m(p[None], b)
        row = np.empty(len(b))
        if last is None:
            row = join.accumulate(d)
        else:
            before = np.minimum(last, np.r_[np.inf, last[:-1]])
            for j in range(len(b)):
                best = before[j] if j == 0 else min(before[j], row[j - 1])
                row[j] = best + d[j] if total else max(best, d[j])
        last = row
    return float(last[-1])


def segments(line: np.ndarray, dists: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """A shape cut at the distances of its stops (as its points count them); degenerate pieces are single points."""
    inside = np.clip(stops, dists[0], dists[-1])
    cut = lambda d: np.array([np.interp(d, dists, line[:, k]) for k in (0, 1)])
    out = []
    for a, b in zip(inside[:-1], inside[1:], strict=True):
        middle = line[(dists > a) & (dists < b)]
        out.append(np.concatenate([cut(a)[None], middle, cut(b)[None]]))
    return out


def _line(points) -> np.ndarray:
    return np.array([(p["lat"], p["lon"]) for p in points], float).reshape(-1, 2)


def simplify_udf(tolerance: float):
    """Arrays of structs (lat, lon), simplified to a tolerance in degrees."""

    @F.pandas_udf("array<struct<lat:double,lon:double>>")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: None if x is None else [{"lat": p[0], "lon": p[1]} for p in simplified(_line(x), tolerance)])

    return run


def frechet_udf(metres: float | None = None, total: bool = False):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else frechet(_line(x), _line(y), metres, total) for x, y in zip(a, b, strict=True)], dtype=float)

    return run
