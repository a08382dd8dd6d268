"""Named synthetic conduits: axes, widths and strengths read from tables over depth.

A shape is a list of limbs. A limb is a chain of displacements from its site, each north and east in degrees
as a function of depth, with a width in units of the radius and a strength in units of the amplitude.
All shapes are read by one function; where limbs overlap the stronger one counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from terravox.functions import geo
from terravox.operators.injection import AZIMUTH_DEG, BASE_KM, LEAN, LEAN_COS_FLOOR, TAPER_KM, TOP_KM
from terravox.operators.routing import Grid

Table = Callable[[np.ndarray], np.ndarray]


def knots(*points: tuple[float, float]) -> Table:
    """Straight lines between (depth, value) points, level beyond the ends."""
    at, value = zip(*points)
    return lambda z: np.interp(z, at, value)


def level(value: float) -> Table:
    return lambda z: np.full_like(z, value)


def gaps(*pieces: tuple[float, float]) -> Table:
    """One, and zero inside the given depth intervals."""
    return lambda z: 1.0 - np.any([(z > a) & (z < b) for a, b in pieces], axis=0)


DOWN = knots((TOP_KM, 0.0), (BASE_KM, 1.0))


@dataclass(frozen=True)
class Limb:
    """``along`` the azimuth as a share of the full offset, which itself turns by ``turn`` degrees; ``across``
    it in degrees. Together or one after the other, which matters for the length of a degree east."""

    along: Table = level(0.0)
    across: Table = level(0.0)
    turn: Table = level(0.0)
    width: float = 1.0
    strength: Table = level(1.0)
    together: bool = False

    def axis(self, z: np.ndarray, lat: float, lon: float, offset_deg: float) -> tuple[np.ndarray, np.ndarray]:
        bearing = np.radians(AZIMUTH_DEG + self.turn(z))
        side = math.radians(AZIMUTH_DEG + 90.0)
        d, x = offset_deg * self.along(z), self.across(z)
        moves = [(d * np.cos(bearing), d * np.sin(bearing)), (x * math.cos(side), x * math.sin(side))]
        if self.together:
            moves = [(moves[0][0] + moves[1][0], moves[0][1] + moves[1][1])]
        north, east = np.full_like(z, lat), np.full_like(z, lon)
        for n, e in moves:
            north = north + n
            east = east + e / np.maximum(np.cos(np.radians(north)), LEAN_COS_FLOOR)
        return north, east


def _wall(radius_km: float) -> list[Limb]:
    spacing = radius_km / 2.0 / geo.KM_PER_DEGREE_TABLE
    return [Limb(DOWN, level(spacing * n)) for n in range(-4, 5)]


def shapes(radius_km: float) -> dict[str, list[Limb]]:
    """The twelve shapes. Depths, shares and widths are fixed values of their definitions."""
    apart = knots((600.0, 1.0), (1500.0, 0.0))
    branch = knots((2000.0, 1.0), (2600.0, 0.0))
    halves = (1.0, -1.0)
    return {
        "vertical": [Limb()],
        "uniform": [Limb(DOWN)],
        "transition": [Limb(knots(*LEAN["transition"]))],
        "s_shaped": [Limb(lambda z: 0.5 * np.sin(2.0 * np.pi * DOWN(z)) + 0.25 * DOWN(z))],
        "reversing": [Limb(DOWN, turn=lambda z: 90.0 * DOWN(z))],
        "bifurcating": [Limb(DOWN, lambda z, h=h: 5.0 * h * apart(z), width=0.8, strength=lambda z: 1.0 - 0.5 * apart(z)) for h in halves],
        "sheet": _wall(radius_km),
        "tapered": [Limb(DOWN, strength=lambda z: 0.33 + 0.67 * DOWN(z))],
        "gapped": [Limb(DOWN, strength=gaps((1400.0, 1800.0)))],
        "narrow_in_broad": [Limb(DOWN), Limb(DOWN, width=5.0, strength=level(0.25))],
        "twin_branch": [Limb(DOWN, lambda z, h=h: 4.0 * h * branch(z), width=0.8, together=True) for h in halves],
        "broken_beside_whole": [Limb(strength=gaps((900.0, 1100.0), (1500.0, 1700.0), (2100.0, 2300.0))), Limb(DOWN)],
    }


def strength_at(z: np.ndarray) -> np.ndarray:
    """Ends of every shape: nothing above the top, a straight ramp to nothing at the base."""
    return np.clip((BASE_KM - z) / TAPER_KM, 0.0, 1.0) * (z >= TOP_KM)


def axes(name: str, depth: Sequence[float], lat: float, lon: float, radius_km: float, offset_deg: float = 10.0) -> list[tuple[int, int, float, float, float, float]]:
    """(limb, shell, latitude, longitude, radius in km, strength) where a shape has any strength."""
    z = np.asarray(depth, float)
    out = []
    for n, limb in enumerate(shapes(radius_km)[name]):
        north, east = limb.axis(z, lat, lon, offset_deg)
        s = limb.strength(z) * strength_at(z)
        out += [(n, int(k), float(north[k]), float(east[k]), radius_km * limb.width, float(s[k])) for k in np.flatnonzero(s)]
    return out


def added(name: str, grid: Grid, lat: float, lon: float, amp: float, radius_km: float, offset_deg: float = 10.0) -> dict[int, np.ndarray]:
    """What a shape adds to each shell it touches."""
    p, q = np.radians(np.array(grid.lat))[:, None], np.radians(np.array(grid.lon))[None]
    out: dict[int, np.ndarray] = {}
    stronger = np.minimum if amp < 0 else np.maximum
    for _, k, la, lo, r, s in axes(name, grid.depth, lat, lon, radius_km, offset_deg):
        a, b = math.radians(la), math.radians(lo)
        far = geo.EARTH_KM * np.arccos(np.clip(math.sin(a) * np.sin(p) + math.cos(a) * np.cos(p) * np.cos(q - b), -1.0, 1.0))
        limb = amp * s * np.exp(-0.5 * (far / (r / 2.0)) ** 2)
        out[k] = stronger(out[k], limb) if k in out else limb
    return out
