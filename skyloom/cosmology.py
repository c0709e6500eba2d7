"""Distances in a flat universe, physical scales as angles, and generators of redshift bins."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

import numpy as np

from .functions.bins import Binning

SPEED = 299792.458  # km/s

ANGULAR = {"rad": 1.0, "deg": math.pi / 180, "arcmin": math.pi / 10800, "arcsec": math.pi / 648000}
PHYSICAL = {"kpc": 1e-3, "Mpc": 1.0}
COMOVING = {"kpc/h": 1e-3, "Mpc/h": 1.0}


class Cosmology(Protocol):
    """What a custom cosmology has to have; distances in Mpc."""

    def comoving_distance(self, z): ...

    def angular_diameter_distance(self, z): ...


@dataclass(frozen=True)
class FlatLambda:
    """Flat model with radiation and neutrinos, one of them massive."""

    name: str
    h0: float
    om0: float
    tcmb: float = 0.0
    neff: float = 3.046
    neutrino_ev: tuple[float, ...] = ()

    def _energy(self, z: np.ndarray) -> np.ndarray:
        """H(z) / H0."""
        a = 1 + z
        photons = 2.4728e-5 * (self.tcmb / 2.7255) ** 4 / (self.h0 / 100) ** 2
        per = 7 / 8 * (4 / 11) ** (4 / 3) * (self.neff / 3)
        kinds = (list(self.neutrino_ev) + [0.0] * 3)[:3]
        temperature = 0.7137658555036082 * self.tcmb * 8.617333262e-5  # of neutrinos, in eV
        # fit to the energy of a massive neutrino between the relativistic and the cold limit
        curve = lambda z: sum((1 + (0.3173 * m / (temperature * (1 + z))) ** 1.83) ** (1 / 1.83) if m and self.tcmb else 1.0 for m in kinds)
        radiation = lambda z: photons * (1 + per * curve(z)) if self.tcmb else 0.0
        rest = 1 - self.om0 - radiation(0.0)
        return np.sqrt(self.om0 * a**3 + radiation(z) * a**4 + rest)

    def comoving_distance(self, z):
        z = np.asarray(z, float)
        x, w = np.polynomial.legendre.leggauss(64)
        half = z[..., None] / 2
        out = (w / self._energy(half * (x + 1))).sum(-1) * half[..., 0] * SPEED / self.h0
        return out if out.ndim else float(out)

    def angular_diameter_distance(self, z):
        return self.comoving_distance(z) / (1 + np.asarray(z, float))


COSMOLOGIES = {
    c.name: c
    for c in (
        FlatLambda("Planck15", 67.74, 0.3075, 2.7255, 3.046, (0.0, 0.0, 0.06)),
        FlatLambda("Planck13", 67.77, 0.30712, 2.7255, 3.046, (0.0, 0.0, 0.06)),
        FlatLambda("Planck18", 67.66, 0.30966, 2.7255, 3.046, (0.0, 0.0, 0.06)),
        FlatLambda("WMAP9", 69.32, 0.2865, 2.725, 3.04),
        FlatLambda("WMAP7", 70.4, 0.272, 2.725, 3.04),
        FlatLambda("WMAP5", 70.2, 0.277, 2.725, 3.04),
    )
}
DEFAULT = "Planck15"


def named(cosmology: str | Cosmology | None) -> Cosmology:
    if cosmology is None or isinstance(cosmology, str):
        try:
            return COSMOLOGIES[cosmology or DEFAULT]
        except KeyError:
            raise ValueError(f"unknown cosmology: {cosmology}") from None
    if not (hasattr(cosmology, "comoving_distance") and hasattr(cosmology, "angular_diameter_distance")):
        raise TypeError("a cosmology needs 'comoving_distance' and 'angular_diameter_distance'")
    return cosmology


def angles(scales: list[tuple[float, float]], unit: str, z: float, cosmology: str | Cosmology | None = None) -> list[tuple[float, float]]:
    """The scales in radians at redshift ``z``."""
    for lo, hi in scales:
        if not lo < hi:
            raise ValueError("scales: 'min' must be smaller than 'max'")
    if unit in ANGULAR:
        factor = ANGULAR[unit]
    elif unit in PHYSICAL:
        factor = PHYSICAL[unit] / named(cosmology).angular_diameter_distance(z)
    elif unit in COMOVING:
        factor = COMOVING[unit] / named(cosmology).comoving_distance(z)
    else:
        raise ValueError(f"invalid unit: {unit}")
    return [(lo * factor, hi * factor) for lo, hi in scales]


def binning(zmin: float, zmax: float, num_bins: int = 30, method: str = "linear", closed: str = "right", cosmology: str | Cosmology | None = None) -> Binning:
    """Edges equally spaced in redshift, comoving distance or ln(1 + z)."""
    if method == "linear":
        edges = np.linspace(zmin, zmax, num_bins + 1)
    elif method == "logspace":
        edges = np.exp(np.linspace(math.log(1 + zmin), math.log(1 + zmax), num_bins + 1)) - 1
    elif method == "comoving":
        cosmo = named(cosmology)
        low, high = cosmo.comoving_distance(zmin), cosmo.comoving_distance(zmax)
        edges = np.array([invert(cosmo.comoving_distance, d, zmin, zmax) for d in np.linspace(low, high, num_bins + 1)])
    else:
        raise ValueError(f"invalid binning method: {method}")
    edges[0], edges[-1] = zmin, zmax
    return Binning(tuple(float(e) for e in edges), closed)


def invert(f, value: float, low: float, high: float) -> float:
    for _ in range(80):
        mid = (low + high) / 2
        if f(mid) < value:
            low = mid
        else:
            high = mid
    return (low + high) / 2
