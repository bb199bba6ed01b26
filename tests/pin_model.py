"""The pin hierarchy one node after another, as its definition says, for tests."""

from __future__ import annotations

from math import atan2, cos, degrees, hypot, log, pi, radians, sin, sqrt

DEEPEST = 22


def square(lat: float, lon: float) -> tuple[float, float]:
    s = sin(radians(max(-85.05112877980659, min(85.05112877980659, lat))))
    return (lon + 180) / 360, min(1.0, max(0.0, 0.5 - log((1 + s) / (1 - s)) / (4 * pi)))


def unit(lat: float, lon: float) -> tuple[float, float, float]:
    p, l = radians(lat), radians(lon)
    return cos(p) * cos(l), cos(p) * sin(l), sin(p)


def pins(points: list[tuple[int, float, float]], radius_px: float, tile_px: float) -> dict[int, dict[int, dict]]:
    """zoom to id to pin; a pin has its points in depth-first order, its mean, and its children."""
    below = {i: {"key": (lat, lon, i), "points": [i], "sum": unit(lat, lon), "at": (lat, lon), "children": [], "err": 0.0} for i, lat, lon in points}
    out = {DEEPEST + 1: below}
    for zoom in range(DEEPEST, -1, -1):
        r, seeds, members = radius_px / tile_px / 2.0**zoom, [], {}
        for i in sorted(below, key=lambda i: below[i]["key"]):
            x, y = square(*below[i]["at"])
            for s in seeds:
                a, b = square(*below[s]["at"])
                dx = min(abs(a - x), 1 - abs(a - x))
                if dx * dx + (b - y) ** 2 <= r * r:
                    members[s].append(i)
                    break
            else:
                seeds.append(i)
                members[i] = [i]
        level = {}
        for s in seeds:
            kids = [below[m] for m in members[s]]
            if len(kids) == 1:
                level[s] = {**kids[0], "children": members[s]}
                continue
            total = [sum(k["sum"][a] for k in kids) for a in range(3)]
            n = sum(len(k["points"]) for k in kids)
            at = kids[0]["at"] if sqrt(sum(t * t for t in total)) < 1e-9 * n else (degrees(atan2(total[2], hypot(total[0], total[1]))), degrees(atan2(total[1], total[0])))
            level[s] = {"key": kids[0]["key"], "points": [p for k in kids for p in k["points"]], "sum": total, "at": at, "children": members[s]}
        out[zoom] = below = level
    return out
