"""Rhumb lines (lines of one bearing) on an ellipsoid as Column expressions, by the fourth-order rectifying series.

A rhumb line is straight in isometric latitude and longitude; its length is the rectifying latitude's share.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.core import WGS84, Num, c, finite, let, normalize_degrees, wrap_longitude
from geoloom.functions.geodesy import ELLIPSOIDS
from geoloom.functions.grids import kruger, latitude_of_conformal

#: Radians next to a pole that count as the pole, and differences of isometric latitude that the slope stands for.
POLE, NEAR = 1e-12, 1e-5


def _isometric(lat: Column, crs: str) -> Column:
    s, ecc = F.sin(F.radians(lat)), ELLIPSOIDS[crs].e2 ** 0.5
    return F.atanh(s) - F.atanh(s * ecc) * ecc


def _rectified(chi: Column, crs: str) -> Column:
    out = chi
    for k, a in enumerate(kruger(crs)[1], 1):
        out = out + F.sin(chi * (2 * k)) * a
    return out


def _rectifying(lat: Column, crs: str) -> Column:
    """Rectifying latitude in radians; a quarter turn at a pole."""
    return F.when(F.abs(lat) == 90.0, F.signum(lat) * (pi / 2)).otherwise(let(F.atan(F.sinh(_isometric(lat, crs))), lambda chi: _rectified(chi, crs)))


def _latitude(mu: Column, crs: str) -> Column:
    """Degrees of latitude of a rectifying latitude."""
    chi = mu
    for k, b in enumerate(kruger(crs)[2], 1):
        chi = chi - F.sin(mu * (2 * k)) * b
    return F.when(F.abs(mu) >= pi / 2 - POLE, F.signum(mu) * 90.0).otherwise(let(chi, lambda x: latitude_of_conformal(F.tan(x), crs)))


def _scale(psi1: Column, psi2: Column, crs: str) -> Column:
    """Metres of one radian of longitude on a line between two isometric latitudes."""
    radius, alpha, _ = kruger(crs)
    chi = lambda psi: F.atan(F.sinh(psi))

    def slope(x: Column) -> Column:
        total = F.lit(1.0)
        for k, a in enumerate(alpha, 1):
            total = total + F.cos(x * (2 * k)) * (2 * k * a)
        return total * F.cos(x)

    apart = (let(chi(psi2), lambda x: _rectified(x, crs)) - let(chi(psi1), lambda x: _rectified(x, crs))) / (psi2 - psi1)
    return F.when(F.abs(psi2 - psi1) < NEAR, let(chi((psi1 + psi2) / 2.0), slope)).otherwise(apart) * radius


def _turn(lon1: Column, lon2: Column) -> Column:
    return F.radians(wrap_longitude(lon2 - lon1))


def rhumb_distance(lat1: Num, lon1: Num, lat2: Num, lon2: Num, crs: str = WGS84) -> Column:
    """Metres along the line of one bearing, the shorter way round; from or to a pole along a meridian."""
    lat1, lon1, lat2, lon2 = c(lat1), c(lon1), c(lat2), c(lon2)
    radius = kruger(crs)[0]
    along = lambda p: _scale(p["a"], p["b"], crs) * F.hypot(p["b"] - p["a"], _turn(lon1, lon2))
    plain = let(F.struct(_isometric(lat1, crs).alias("a"), _isometric(lat2, crs).alias("b")), along)
    pole = (F.abs(lat1) == 90.0) | (F.abs(lat2) == 90.0)
    return F.when(pole, F.abs(_rectifying(lat2, crs) - _rectifying(lat1, crs)) * radius).otherwise(plain)


def rhumb_bearing(lat1: Num, lon1: Num, lat2: Num, lon2: Num, crs: str = WGS84) -> Column:
    """Bearing in [0, 360); null for coincident points. From a pole it is read against the start's own meridian."""
    lat1, lon1, lat2, lon2 = c(lat1), c(lon1), c(lat2), c(lon2)
    same = (lat1 == lat2) & ((F.abs(lat1) == 90.0) | (_turn(lon1, lon2) == 0))
    plain = F.degrees(F.atan2(_turn(lon1, lon2), _isometric(lat2, crs) - _isometric(lat1, crs)))
    return F.when(
        ~same,
        normalize_degrees(F.when(lat1 == 90.0, F.lit(180.0) - (lon2 - lon1)).when(lat1 == -90.0, lon2 - lon1).when(lat2 == 90.0, 0.0).when(lat2 == -90.0, 180.0).otherwise(plain)),
    )


def rhumb_destination(lat: Num, lon: Num, bearing_deg: Num, meters: Num, crs: str = WGS84) -> Column:
    """(lat, lon) at a distance along a bearing.

    On a meridian the line goes over the poles; any other spirals towards one, and a distance that would carry it there
    gives null, as do a negative or infinite distance and a bearing that is not finite.
    """
    lat, lon, bearing, meters = c(lat), c(lon), normalize_degrees(bearing_deg), c(meters)
    radius = kruger(crs)[0]
    from_pole = F.abs(lat) == 90.0
    start = F.when(lat == 90.0, lon + 180.0 - bearing).when(lat == -90.0, lon + bearing).otherwise(lon)
    way = F.when(lat == 90.0, 180.0).when(lat == -90.0, 0.0).otherwise(bearing)
    point = lambda a, b: F.struct((a + 0.0).alias("lat"), wrap_longitude(b).alias("lon"))

    def go(s: Column) -> Column:
        north = s["way"] == 0.0
        x = F.pmod(F.when(north, s["mu"]).otherwise(-s["mu"]) + meters / radius + pi / 2, F.lit(2 * pi)) - pi / 2
        over = x > pi / 2
        mu = F.when(over, F.lit(pi) - x).otherwise(x)
        meridian = point(_latitude(F.when(north, mu).otherwise(-mu), crs), s["lon"] + F.when(over, 180.0).otherwise(0.0))

        def oblique(end: Column) -> Column:
            lat2 = _latitude(end, crs)
            east = let(F.struct(_isometric(lat, crs).alias("a"), lat2.alias("lat")), lambda p: point(p["lat"], lon + F.degrees(meters * F.sin(F.radians(bearing)) / _scale(p["a"], _isometric(p["lat"], crs), crs))))
            return F.when(~((F.abs(end) >= pi / 2 - POLE) & (F.abs(end) > F.abs(s["mu"]))), east)

        slant = let(s["mu"] + meters * F.cos(F.radians(bearing)) / radius, oblique)
        return F.when(meters == 0, point(lat, lon)).when((s["way"] == 0.0) | (s["way"] == 180.0) | from_pole, meridian).otherwise(slant)

    ok = finite(meters) & (meters >= 0) & finite(bearing_deg) & lat.isNotNull() & lon.isNotNull()
    return F.when(ok, let(F.struct(_rectifying(lat, crs).alias("mu"), start.alias("lon"), way.alias("way")), go))
