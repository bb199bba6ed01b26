"""Geodesics on an ellipsoid, after C. F. F. Karney, "Algorithms for geodesics", J. Geodesy 87 (2013), over numpy arrays.

Series are taken to the sixth order in the small parameter. The inverse problem solves for the first azimuth by Newton's
method kept inside a bracket, so that nearly opposite points converge as well. Columns pass through Arrow in batches.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.core import WGS84, Num, c
from geoloom.functions.geodesy import ELLIPSOIDS

# The paper's series. Rows are harmonics, entries the coefficients of rising powers of epsilon.
_C1 = [[0, -1 / 2, 0, 3 / 16, 0, -1 / 32, 0], [0, 0, -1 / 16, 0, 1 / 32, 0, -9 / 2048], [0, 0, 0, -1 / 48, 0, 3 / 256, 0],
       [0, 0, 0, 0, -5 / 512, 0, 3 / 512], [0, 0, 0, 0, 0, -7 / 1280, 0], [0, 0, 0, 0, 0, 0, -7 / 2048]]
_C1P = [[0, 1 / 2, 0, -9 / 32, 0, 205 / 1536, 0], [0, 0, 5 / 16, 0, -37 / 96, 0, 1335 / 4096], [0, 0, 0, 29 / 96, 0, -75 / 128, 0],
        [0, 0, 0, 0, 539 / 1536, 0, -2391 / 2560], [0, 0, 0, 0, 0, 3467 / 7680, 0], [0, 0, 0, 0, 0, 0, 38081 / 61440]]
_C2 = [[0, 1 / 2, 0, 1 / 16, 0, 1 / 32, 0], [0, 0, 3 / 16, 0, 1 / 32, 0, 35 / 2048], [0, 0, 0, 5 / 48, 0, 5 / 256, 0],
       [0, 0, 0, 0, 35 / 512, 0, 7 / 512], [0, 0, 0, 0, 0, 63 / 1280, 0], [0, 0, 0, 0, 0, 0, 77 / 2048]]


def _c3(n: float) -> list[list[float]]:
    return [
        [0, 1 / 4 - n / 4, 1 / 8 - n**2 / 8, 3 / 64 + 3 * n / 64 - n**2 / 64, 5 / 128 + n / 64, 3 / 128],
        [0, 0, 1 / 16 - 3 * n / 32 + n**2 / 32, 3 / 64 - n / 32 - 3 * n**2 / 64, 3 / 128 + n / 128, 5 / 256],
        [0, 0, 0, 5 / 192 - 3 * n / 64 + 5 * n**2 / 192, 3 / 128 - 5 * n / 192, 7 / 512],
        [0, 0, 0, 0, 7 / 512 - 7 * n / 256, 7 / 512],
        [0, 0, 0, 0, 0, 21 / 2560],
    ]


def _poly(row: list[float], x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for k in reversed(row):
        out = out * x + k
    return out


def _sines(table: list[list[float]], eps: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Sum of coefficient times sine of twice the multiples of an angle, by Clenshaw's recurrence."""
    turn, now, last = 2 * np.cos(2 * angle), 0.0, 0.0
    for row in reversed(table):
        now, last = turn * now - last + _poly(row, eps), now
    return np.sin(2 * angle) * now


def _turned(degrees: np.ndarray) -> np.ndarray:
    """Degrees in [0, 360)."""
    x = degrees % 360.0
    return np.where(x >= 360.0 - 1e-12, 0.0, x)


class Geodesic:
    """Direct and inverse problems on one ellipsoid; arguments and results are arrays in degrees and metres."""

    def __init__(self, crs: str = WGS84) -> None:
        e = ELLIPSOIDS[crs]
        self.a, self.f, self.b = e.a, e.f, e.b
        self.n = self.f / (2 - self.f)
        self.ep2 = e.e2 / (1 - e.e2)
        self.a3 = [1, -(1 / 2 - self.n / 2), -(1 / 4 + self.n / 8 - 3 * self.n**2 / 8), -(1 / 16 + 3 * self.n / 16 + self.n**2 / 16), -(3 / 64 + self.n / 32), -3 / 128]
        self.c3 = _c3(self.n)

    def _eps(self, cos_a0: np.ndarray) -> np.ndarray:
        k2 = self.ep2 * cos_a0**2
        root = np.sqrt(1 + k2)
        return k2 / (2 * (1 + root) + k2)

    @staticmethod
    def _a1(eps: np.ndarray) -> np.ndarray:
        return (1 + eps**2 / 4 + eps**4 / 64 + eps**6 / 256) / (1 - eps)

    @staticmethod
    def _a2(eps: np.ndarray) -> np.ndarray:
        return (1 - eps) * (1 + eps**2 / 4 + 9 * eps**4 / 64 + 25 * eps**6 / 256)

    def _longitude(self, sin_a0: np.ndarray, eps: np.ndarray, sigma: np.ndarray, omega: np.ndarray) -> np.ndarray:
        return omega - self.f * sin_a0 * _poly(self.a3, eps) * (sigma + _sines(self.c3, eps, sigma))

    def _reduced(self, lat: np.ndarray) -> np.ndarray:
        return np.arctan2((1 - self.f) * np.sin(np.radians(lat)), np.cos(np.radians(lat)))

    def direct(self, lat, lon, azimuth, meters):
        """Latitude, longitude and azimuth reached from a point."""
        lat, lon, azimuth, meters = np.broadcast_arrays(*(np.asarray(x, float) for x in (lat, lon, azimuth, meters)))
        beta, alpha = self._reduced(lat), np.radians(azimuth)
        sin_a0 = np.sin(alpha) * np.cos(beta)
        cos_a0 = np.hypot(np.cos(alpha), np.sin(alpha) * np.sin(beta))
        sigma1 = np.arctan2(np.sin(beta), np.cos(alpha) * np.cos(beta))
        omega1 = np.arctan2(sin_a0 * np.sin(sigma1), np.cos(sigma1))
        eps = self._eps(cos_a0)
        a1 = self._a1(eps)
        tau = sigma1 + _sines(_C1, eps, sigma1) + meters / (self.b * a1)
        sigma2 = tau + _sines(_C1P, eps, tau)
        beta2 = np.arctan2(cos_a0 * np.sin(sigma2), np.hypot(cos_a0 * np.cos(sigma2), sin_a0))
        omega2 = np.arctan2(sin_a0 * np.sin(sigma2), np.cos(sigma2))
        # Whole turns of the auxiliary sphere that the arc tangents leave out, on the side that the azimuth goes.
        side = np.where(sin_a0 < 0, -1.0, 1.0)
        turn = lambda o, s: o + side * (s - np.arctan2(np.sin(s), np.cos(s)))
        lam1, lam2 = self._longitude(sin_a0, eps, sigma1, turn(omega1, sigma1)), self._longitude(sin_a0, eps, sigma2, turn(omega2, sigma2))
        lat2 = np.degrees(np.arctan2(np.sin(beta2), (1 - self.f) * np.cos(beta2)))
        lon2 = (lon + np.degrees(lam2 - lam1) + 180.0) % 360.0 - 180.0
        return lat2, lon2, _turned(np.degrees(np.arctan2(sin_a0, cos_a0 * np.cos(sigma2))))

    def _hybrid(self, b1, b2, alpha1, order: bool):
        """From reduced latitudes (b1 <= 0, |b2| <= -b1) and a first azimuth: the longitude reached and, by its
        derivative's parts, the second azimuth, both arcs and epsilon."""
        sin_a0 = np.sin(alpha1) * np.cos(b1)
        cos_a0 = np.hypot(np.cos(alpha1), np.sin(alpha1) * np.sin(b1))
        sin_a2 = np.clip(sin_a0 / np.maximum(np.cos(b2), 1e-300), -1, 1)
        cross = np.where(np.cos(b1) < -np.sin(b1), (np.cos(b2) - np.cos(b1)) * (np.cos(b1) + np.cos(b2)), (np.sin(b1) - np.sin(b2)) * (np.sin(b1) + np.sin(b2)))
        cos_a2 = np.sqrt(np.maximum((np.cos(alpha1) * np.cos(b1)) ** 2 + cross, 0.0)) / np.maximum(np.cos(b2), 1e-300)
        s1, c1 = np.sin(b1), np.cos(alpha1) * np.cos(b1)
        s2, c2 = np.sin(b2), cos_a2 * np.cos(b2)
        sigma1 = np.arctan2(s1, c1)
        sigma2 = np.arctan2(s2, c2)
        omega1, omega2 = np.arctan2(sin_a0 * np.sin(sigma1), np.cos(sigma1)), np.arctan2(sin_a0 * np.sin(sigma2), np.cos(sigma2))
        eps = self._eps(cos_a0)
        lam = self._longitude(sin_a0, eps, sigma2, omega2) - self._longitude(sin_a0, eps, sigma1, omega1)
        return lam, np.arctan2(sin_a2, cos_a2), sigma1, sigma2, eps

    def _lengths(self, eps, sigma1, sigma2):
        """Distance and reduced length."""
        a1, a2 = self._a1(eps), self._a2(eps)
        i1 = lambda s: a1 * (s + _sines(_C1, eps, s))
        i2 = lambda s: a2 * (s + _sines(_C2, eps, s))
        k2 = 4 * eps / (1 - eps) ** 2
        j12 = (i1(sigma2) - i2(sigma2)) - (i1(sigma1) - i2(sigma1))
        d1, d2 = np.sqrt(1 + k2 * np.sin(sigma1) ** 2), np.sqrt(1 + k2 * np.sin(sigma2) ** 2)
        m12 = self.b * (d2 * np.cos(sigma1) * np.sin(sigma2) - d1 * np.sin(sigma1) * np.cos(sigma2) - np.cos(sigma1) * np.cos(sigma2) * j12)
        return self.b * (i1(sigma2) - i1(sigma1)), m12

    def inverse(self, lat1, lon1, lat2, lon2):
        """Distance and the azimuths at both ends; azimuths of coincident points are 0."""
        lat1, lon1, lat2, lon2 = np.broadcast_arrays(*(np.asarray(x, float) for x in (lat1, lon1, lat2, lon2)))
        turn = (lon2 - lon1 + 180.0) % 360.0 - 180.0
        east = np.where(turn < 0, -1.0, 1.0)
        lam12 = np.radians(np.abs(turn))
        swap = np.abs(lat1) < np.abs(lat2)
        p, q = np.where(swap, lat2, lat1), np.where(swap, lat1, lat2)
        flip = np.where(p > 0, -1.0, 1.0)
        b1, b2 = self._reduced(p * flip), self._reduced(q * flip)
        tiny = 1e-15
        b1 = np.where(np.abs(b1) < 1e-18, -1e-18, b1)
        meridian = (lam12 <= tiny) | (np.abs(p) == 90.0)
        opposite = lam12 >= np.pi - tiny
        # Along the equator up to where a way over the north or south gets shorter.
        equator = (lat1 == 0) & (lat2 == 0) & (lam12 <= (1 - self.f) * np.pi)
        lo, hi = np.zeros_like(lam12), np.full_like(lam12, np.pi)
        # A start from the sphere; beyond it the bracket decides.
        w = lam12 / np.sqrt(1 - self.f * (2 - self.f) * np.cos((b1 + b2) / 2) ** 2)
        w = np.minimum(w, np.pi)
        alpha = np.arctan2(np.cos(b2) * np.sin(w), np.cos(b1) * np.sin(b2) - np.sin(b1) * np.cos(b2) * np.cos(w))
        alpha = np.clip(np.where(np.isfinite(alpha), alpha, np.pi / 2), 1e-12, np.pi - 1e-12)
        # Rows leave the search one by one: settled, or as near as rounding lets them come.
        at, found, least = np.flatnonzero(~meridian & ~equator & ~np.isnan(b1 + b2 + lam12)), alpha.copy(), np.full(alpha.shape, np.inf)
        for k in range(64):
            if not len(at):
                break
            north, south, now = b1[at], b2[at], alpha[at]
            lam, alpha2, s1, s2, eps = self._hybrid(north, south, now, True)
            miss = lam - lam12[at]
            low, high = np.where(miss < 0, now, lo[at]), np.where(miss >= 0, now, hi[at])
            better, stuck = np.abs(miss) < least[at], (np.abs(miss) < 1e-13) & (np.abs(miss) >= least[at])
            found[at], least[at] = np.where(better, now, found[at]), np.where(better, np.abs(miss), least[at])
            _, m12 = self._lengths(eps, s1, s2)
            below = np.cos(alpha2) * np.cos(south)
            with np.errstate(all="ignore"):
                slope = np.where(np.abs(below) > 1e-12, m12 / self.a / below, -2 * np.sqrt(1 - self.f * (2 - self.f) * np.cos(north) ** 2) / np.sin(north))
                step = now - miss / slope
            good = np.isfinite(step) & (step > low) & (step < high)
            lo[at], hi[at] = low, high
            alpha[at] = np.where(good & (k % 8 != 7), step, (low + high) / 2)
            at = at[~(stuck | (np.abs(miss) < 1e-15) | (high - low < 1e-15))]
        alpha = found
        alpha = np.where(meridian, np.where(np.abs(p) == 90.0, lam12, 0.0), alpha)
        lam, alpha2, s1, s2, eps = self._hybrid(b1, b2, alpha, True)
        # Along a meridian: straight up to the other latitude, or over the pole where the ends face each other.
        s, _ = self._lengths(eps, s1, s2)
        flat = np.where(np.abs(p) == 90.0, 0.0, np.where(lam12 <= tiny, 0.0, alpha))
        up = np.arctan2(np.sin(b1), np.cos(b1)), np.arctan2(np.sin(b2), np.cos(b2))
        full = self._eps(np.ones_like(lam12))
        straight, _ = self._lengths(full, *up)
        s = np.where(meridian, straight, s)
        over = opposite & (np.abs(p) != 90.0)
        back, _ = self._lengths(full, up[0], np.pi - up[1]) if np.any(over) else (s, None)
        south, _ = self._lengths(full, -np.pi - up[1], up[0]) if np.any(over) else (s, None)
        polar = np.where(over, np.minimum(back, south), np.inf)
        use = polar < s
        s = np.where(use, polar, s)
        a1, a2 = np.where(meridian, flat, alpha), np.where(meridian, np.where(np.abs(p) == 90.0, lam12, 0.0), alpha2)
        a1 = np.where(np.abs(p) == 90.0, lam12, a1)
        a2 = np.where(np.abs(p) == 90.0, 0.0, a2)
        a1, a2 = np.where(use, np.where(south < back, np.pi, 0.0), a1), np.where(use, np.where(south < back, 0.0, np.pi), a2)
        a1, a2 = np.where(swap, a2, a1), np.where(swap, a1, a2)
        # Swapped ends turn the line round; a flip mirrors north and south.
        turned = swap ^ (flip < 0)
        a1, a2 = np.where(turned, np.pi - a1, a1), np.where(turned, np.pi - a2, a2)
        s = np.where((lat1 == lat2) & (lam12 == 0), 0.0, np.where(equator, self.a * lam12, s))
        a1, a2 = np.where(equator, np.pi / 2, a1), np.where(equator, np.pi / 2, a2)
        same = s == 0
        return s, *(_turned(np.where(same, 0.0, np.degrees(x) * east)) for x in (a1, a2))


@lru_cache(maxsize=8)
def solver(crs: str) -> Geodesic:
    return Geodesic(crs)


def _numpy(*columns: pd.Series) -> list[np.ndarray]:
    return [x.to_numpy(dtype=float, na_value=np.nan) for x in columns]


def _known(out: pd.DataFrame, ok: np.ndarray) -> pd.DataFrame:
    """``out`` with null in the rows that are not ``ok``."""
    return out.where(np.repeat(np.asarray(ok)[:, None], out.shape[1], axis=1))


def inverse(lat1: Num, lon1: Num, lat2: Num, lon2: Num, crs: str = WGS84) -> Column:
    """STRUCT<distance_m, initial_deg, final_deg>; nulls give nulls."""

    @F.pandas_udf("distance_m double, initial_deg double, final_deg double")
    def run(a: pd.Series, b: pd.Series, p: pd.Series, q: pd.Series) -> pd.DataFrame:
        s, x, y = solver(crs).inverse(*_numpy(a, b, p, q))
        return _known(pd.DataFrame({"distance_m": s, "initial_deg": x, "final_deg": y}), ~np.isnan(s))

    return run(c(lat1), c(lon1), c(lat2), c(lon2))


def geodesic_distance(lat1: Num, lon1: Num, lat2: Num, lon2: Num, crs: str = WGS84) -> Column:
    return inverse(lat1, lon1, lat2, lon2, crs)["distance_m"]


def destination(lat: Num, lon: Num, bearing_deg: Num, meters: Num, crs: str = WGS84) -> Column:
    """STRUCT<lat, lon> at a distance along a bearing."""

    @F.pandas_udf("lat double, lon double")
    def run(a: pd.Series, b: pd.Series, p: pd.Series, q: pd.Series) -> pd.DataFrame:
        x, y, _ = solver(crs).direct(*_numpy(a, b, p, q))
        return pd.DataFrame({"lat": x, "lon": y})

    return run(c(lat), c(lon), c(bearing_deg), c(meters))


def intermediate(lat1: Num, lon1: Num, lat2: Num, lon2: Num, fraction: Num, crs: str = WGS84) -> Column:
    """STRUCT<lat, lon> at a fraction of the geodesic; both null for a fraction outside [0, 1]."""

    @F.pandas_udf("lat double, lon double")
    def run(a: pd.Series, b: pd.Series, p: pd.Series, q: pd.Series, f: pd.Series) -> pd.DataFrame:
        a, b, p, q, f = _numpy(a, b, p, q, f)
        s, azimuth, _ = solver(crs).inverse(a, b, p, q)
        x, y, _ = solver(crs).direct(a, b, azimuth, s * f)
        return _known(pd.DataFrame({"lat": x, "lon": y}), (f >= 0) & (f <= 1))

    return run(c(lat1), c(lon1), c(lat2), c(lon2), c(fraction))


def midpoint(lat1: Num, lon1: Num, lat2: Num, lon2: Num, crs: str = WGS84) -> Column:
    return intermediate(lat1, lon1, lat2, lon2, 0.5, crs)


def farthest(lat: Num, lon: Num, points: Column, crs: str = WGS84) -> Column:
    """Metres from a centre to the farthest of an array of STRUCT<lat, lon>; null for no points."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, ends: pd.Series) -> pd.Series:
        own = [[] if e is None else list(e) for e in ends]
        n = np.array([len(e) for e in own])
        flat = np.array([(p["lat"], p["lon"]) for e in own for p in e], float).reshape(-1, 2)
        a, b = _numpy(a, b)
        out = np.full(len(n), np.nan)
        if len(flat):
            s, _, _ = solver(crs).inverse(np.repeat(a, n), np.repeat(b, n), flat[:, 0], flat[:, 1])
            some = n > 0
            out[some] = np.maximum.reduceat(s, (np.cumsum(n) - n)[some])
        return pd.Series(out)

    return run(c(lat), c(lon), points)


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    p, l = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(p) * np.cos(l), np.cos(p) * np.sin(l), np.sin(p)], axis=-1)


def _heading(lat: np.ndarray, lon: np.ndarray, azimuth: np.ndarray) -> np.ndarray:
    p, l, t = np.radians(lat), np.radians(lon), np.radians(azimuth)
    north = np.stack([-np.sin(p) * np.cos(l), -np.sin(p) * np.sin(l), np.cos(p)], axis=-1)
    east = np.stack([-np.sin(l), np.cos(l), np.zeros_like(l)], axis=-1)
    return north * np.cos(t)[..., None] + east * np.sin(t)[..., None]


def track_foot(g: Geodesic, lat, lon, lat1, lon1, lat2, lon2, steps: int = 100):
    """Signed metres across a path (positive to its right) and along it from its start to the foot of a point.

    The foot moves along the path by what a sphere of the path's mean radius makes of the point's distance and direction, until it
    stands still; the ellipsoid's small flattening shrinks each move. NaN for a path of one point.
    """
    lat, lon, lat1, lon1, lat2, lon2 = np.broadcast_arrays(*(np.asarray(x, float) for x in (lat, lon, lat1, lon1, lat2, lon2)))
    length, azimuth, _ = g.inverse(lat1, lon1, lat2, lon2)
    radius, along = (2 * g.a + g.b) / 3, np.zeros_like(length)
    away, angle, at = np.zeros_like(length), np.zeros_like(length), np.arange(length.size)
    for _ in range(steps):
        y, x, heading = g.direct(lat1[at], lon1[at], azimuth[at], along[at])
        away[at], toward, _ = g.inverse(y, x, lat[at], lon[at])
        angle[at] = np.radians(toward - heading)
        move = radius * np.arctan2(np.cos(angle[at]) * np.sin(away[at] / radius), np.cos(away[at] / radius))
        along[at] = along[at] + move
        at = at[np.abs(move) > 1e-6]
        if not len(at):
            break
    nowhere = length == 0
    across = away * np.where(np.sin(angle) < 0, -1.0, 1.0)
    return np.where(nowhere, np.nan, across), np.where(nowhere, np.nan, along)


def track_offset(lat: Num, lon: Num, lat1: Num, lon1: Num, lat2: Num, lon2: Num, crs: str = WGS84) -> Column:
    """STRUCT<cross_m, along_m> of a point beside the geodesic through two others; both null for a path of one point."""

    @F.pandas_udf("cross_m double, along_m double")
    def run(a: pd.Series, b: pd.Series, p: pd.Series, q: pd.Series, r: pd.Series, s: pd.Series) -> pd.DataFrame:
        cross, along = track_foot(solver(crs), *_numpy(a, b, p, q, r, s))
        return _known(pd.DataFrame({"cross_m": cross, "along_m": along}), ~np.isnan(cross))

    return run(*map(c, (lat, lon, lat1, lon1, lat2, lon2)))


def cross_track(lat: Num, lon: Num, lat1: Num, lon1: Num, lat2: Num, lon2: Num, crs: str = WGS84) -> Column:
    return track_offset(lat, lon, lat1, lon1, lat2, lon2, crs)["cross_m"]


def along_track(lat: Num, lon: Num, lat1: Num, lon1: Num, lat2: Num, lon2: Num, crs: str = WGS84) -> Column:
    return track_offset(lat, lon, lat1, lon1, lat2, lon2, crs)["along_m"]


def crossings(g: Geodesic, lat1, lon1, bearing1, lat2, lon2, bearing2, steps: int = 50):
    """(kind, lat, lon) of two geodesics' crossing ahead of both starts; kind 0 crossing, 1 one geodesic, 2 none ahead.

    Seeded on the sphere; at each step both feet move to where great circles through them, under the headings there, cross.
    """
    apart, toward, arrive = g.inverse(lat1, lon1, lat2, lon2)
    flat = lambda x: np.abs((x + 90.0) % 180.0 - 90.0)
    same = np.where(apart == 0, flat(bearing1 - bearing2) < 1e-9, (flat(toward - bearing1) < 1e-9) & (flat(arrive - bearing2) < 1e-9))
    radius = (2 * g.a + g.b) / 3
    s1, s2 = np.zeros_like(apart), np.zeros_like(apart)
    ahead = np.ones(len(apart), bool)
    for k in range(steps):
        y1, x1, h1 = g.direct(lat1, lon1, bearing1, s1)
        y2, x2, h2 = g.direct(lat2, lon2, bearing2, s2)
        u1, u2, t1, t2 = _unit(y1, x1), _unit(y2, x2), _heading(y1, x1, h1), _heading(y2, x2, h2)
        cross = np.cross(np.cross(u1, t1), np.cross(u2, t2))
        with np.errstate(all="ignore"):
            cross = cross / np.linalg.norm(cross, axis=1, keepdims=True)
        dot = lambda a, b: (a * b).sum(axis=1)
        side = dot(cross, t1) if k == 0 else dot(cross, u1)  # first the one ahead, then the one at hand
        cross = cross * np.where(side < 0, -1.0, 1.0)[:, None]
        m1, m2 = (radius * np.arctan2(dot(cross, t), dot(cross, u)) for t, u in ((t1, u1), (t2, u2)))
        s1, s2 = s1 + m1, s2 + m2
        if np.all(~(np.maximum(np.abs(m1), np.abs(m2)) > 1e-6) | same):
            break
    ahead = (s1 >= -1e-6) & (s2 >= -1e-6)
    y, x, _ = g.direct(lat1, lon1, bearing1, s1)
    kind = np.where(same, 1, np.where(ahead, 0, 2))
    return kind, np.where(kind == 0, y, np.nan), np.where(kind == 0, x, np.nan)


def intersection(lat1: Num, lon1: Num, bearing1: Num, lat2: Num, lon2: Num, bearing2: Num, crs: str = WGS84) -> Column:
    """STRUCT<kind, lat, lon>: Crossing, SameGeodesic or NoForwardCrossing of two geodesics from their starts."""

    @F.pandas_udf("kind string, lat double, lon double")
    def run(a: pd.Series, b: pd.Series, p: pd.Series, q: pd.Series, r: pd.Series, s: pd.Series) -> pd.DataFrame:
        given = _numpy(a, b, p, q, r, s)
        kind, lat, lon = crossings(solver(crs), *given)
        known = ~np.isnan(np.sum(given, axis=0))
        names = np.array(["Crossing", "SameGeodesic", "NoForwardCrossing"], object)[kind]
        return _known(pd.DataFrame({"kind": names, "lat": lat, "lon": lon}), known)

    return run(*map(c, (lat1, lon1, bearing1, lat2, lon2, bearing2)))


#: Degrees added to grown boxes against rounding.
MARGIN_DEG = 1e-9


def grown(g: Geodesic, south, west, north, east, meters, steps: int = 60):
    """Edges of boxes grown by a distance: every point within it of the box is inside.

    Within reach of a pole a box has all longitudes. The farthest longitude lies off the edge next to a pole, at a bearing that is
    searched for.
    """
    up, _, _ = g.direct(north, 0.0, 0.0, meters)
    down, _, _ = g.direct(south, 0.0, 180.0, meters)
    to_north, to_south = g.inverse(north, 0.0, 90.0, 0.0)[0] <= meters, g.inverse(south, 0.0, -90.0, 0.0)[0] <= meters
    polar = np.maximum(np.abs(north), np.abs(south))
    low, high = np.zeros_like(polar), np.full_like(polar, 180.0)
    reach = lambda bearing: g.direct(polar, 0.0, bearing, meters)[1]
    for _ in range(steps):
        third = (high - low) / 3
        less = reach(low + third) < reach(high - third)
        low, high = np.where(less, low + third, low), np.where(less, high, high - third)
    wide = reach(low) + MARGIN_DEG
    span = np.where(west > east, east - west + 360.0, east - west)
    whole = to_north | to_south | (span + 2 * wide >= 360.0)
    wrap = lambda x: (x + 180.0) % 360.0 - 180.0
    out = (
        np.where(to_south, -90.0, np.maximum(down - MARGIN_DEG, -90.0)), np.where(whole, -180.0, wrap(west - wide)),
        np.where(to_north, 90.0, np.minimum(up + MARGIN_DEG, 90.0)), np.where(whole, 180.0, wrap(east + wide)),
    )
    return tuple(np.where(meters == 0, old, new) for old, new in zip((south, west, north, east), out))


def box_expand(b: Column, meters: Num, crs: str = WGS84) -> Column:
    """A box grown by a geodesic distance on every side; null for a negative or infinite one."""

    @F.pandas_udf("south double, west double, north double, east double")
    def run(s: pd.Series, w: pd.Series, n: pd.Series, e: pd.Series, m: pd.Series) -> pd.DataFrame:
        given = _numpy(s, w, n, e, m)
        ok = np.isfinite(np.sum(given, axis=0)) & (given[4] >= 0)
        edges = grown(solver(crs), *(np.where(ok, x, 0.0) for x in given))
        return _known(pd.DataFrame(dict(zip(("south", "west", "north", "east"), edges))), ok)

    return run(b["south"], b["west"], b["north"], b["east"], c(meters))
