"""Configuration of measurements: frozen, checked, to and from dicts and YAML."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from . import cosmology as cosmo
from .functions.bins import CLOSED, Binning
from .operators.pairs import RESOLUTION, Limits

UNITS = (*cosmo.PHYSICAL, *cosmo.ANGULAR, *cosmo.COMOVING)
METHODS = ("linear", "comoving", "logspace", "custom")
KEEP: Any = object()


class ConfigError(Exception):
    """A wrong parameter; its message begins with the parameter's dotted path."""

    def __init__(self, message: str, path: str = ""):
        self.message, self.path = message, path
        super().__init__(f"{path}: {message}" if path else message)

    def within(self, section: str) -> ConfigError:
        return ConfigError(self.message, f"{section}.{self.path}" if self.path else section)


def checked(given: dict, required: tuple[str, ...], optional: tuple[str, ...]) -> dict:
    """``given``, if it has all required keys and no unknown ones."""
    if not isinstance(given, dict):
        raise ConfigError("expected a section of parameters")
    for k in required:
        if k not in given:
            raise ConfigError("parameter is required", k)
    for k in given:
        if k not in required + optional:
            raise ConfigError("unknown configuration parameter", k)
    return given


def section(name: str, make, given: dict):
    try:
        return make(given)
    except ConfigError as e:
        raise e.within(name) from None


def chosen(value: str, choices: tuple[str, ...], name: str) -> str:
    if value not in choices:
        raise ConfigError(f"invalid choice '{value}', options are: {', '.join(choices)}", name)
    return value


def numbers(value, name: str) -> tuple[float, ...]:
    try:
        return tuple(float(v) for v in (value if isinstance(value, (list, tuple)) else [value]))
    except (TypeError, ValueError):
        raise ConfigError(f"not a number: {value!r}", name) from None


def number(value, kind, name: str):
    try:
        return None if value is None else kind(value)
    except (TypeError, ValueError):
        raise ConfigError(f"not a number: {value!r}", name) from None


def plain(values: tuple[float, ...]):
    return values[0] if len(values) == 1 else list(values)


class Section:
    def modify(self, **changes):
        """A new instance; parameters that aren't given stay as they are."""
        return type(self).create(**(self.to_dict() | {k: v for k, v in changes.items() if v is not KEEP}))


@dataclass(frozen=True)
class ScalesConfig(Section):
    rmin: tuple[float, ...]
    rmax: tuple[float, ...]
    unit: str = "kpc"
    rweight: float | None = None
    resolution: int | None = None

    @classmethod
    def create(cls, rmin, rmax, unit="kpc", rweight=None, resolution=None) -> ScalesConfig:
        low, high = numbers(rmin, "rmin"), numbers(rmax, "rmax")
        if len(low) != len(high):
            raise ConfigError("'rmin' and 'rmax' differ in length", "rmin")
        if any(not a < b for a, b in zip(low, high)):
            raise ConfigError("'rmin' must be smaller than 'rmax'", "rmin")
        return cls(low, high, chosen(unit, UNITS, "unit"), number(rweight, float, "rweight"), number(resolution, int, "resolution"))

    @classmethod
    def from_dict(cls, given: dict) -> ScalesConfig:
        return cls.create(**checked(given, ("rmin", "rmax"), ("unit", "rweight", "resolution")))

    def to_dict(self) -> dict:
        return {"rmin": plain(self.rmin), "rmax": plain(self.rmax), "unit": self.unit, "rweight": self.rweight, "resolution": self.resolution}

    @property
    def num_scales(self) -> int:
        return len(self.rmin)

    def limits(self, binning: Binning, cosmology=None) -> Limits:
        """The scales as angles at each bin's middle."""
        scales = list(zip(self.rmin, self.rmax))
        return Limits(tuple(tuple(cosmo.angles(scales, self.unit, z, cosmology)) for z in binning.mids))

    @property
    def fine(self) -> int:
        return self.resolution or RESOLUTION


@dataclass(frozen=True)
class BinningConfig(Section):
    binning: Binning
    method: str = "linear"

    @classmethod
    def create(cls, zmin=None, zmax=None, num_bins=30, method="linear", edges=None, closed="right", cosmology=None) -> BinningConfig:
        """Given edges win over generated ones."""
        chosen(closed, CLOSED, "closed")
        chosen(method, METHODS, "method")
        try:
            if edges is not None:
                return cls(Binning(numbers(edges, "edges"), closed), "custom")
            if zmin is None or zmax is None:
                raise ConfigError("either 'edges' or 'zmin' and 'zmax' are required", "edges")
            if method == "custom":
                raise ConfigError("custom bins need 'edges'", "edges")
            return cls(cosmo.binning(number(zmin, float, "zmin"), number(zmax, float, "zmax"), number(num_bins, int, "num_bins"), method, closed, cosmology), method)
        except ValueError as e:
            raise ConfigError(str(e), "edges") from None

    @classmethod
    def from_dict(cls, given: dict, cosmology=None) -> BinningConfig:
        return cls.create(**checked(given, (), ("zmin", "zmax", "num_bins", "method", "edges", "closed")), cosmology=cosmology)

    def to_dict(self) -> dict:
        e = self.binning.edges
        if self.method == "custom":
            return {"edges": list(e), "closed": self.binning.closed}
        return {"zmin": e[0], "zmax": e[-1], "num_bins": len(self.binning), "method": self.method, "closed": self.binning.closed}

    def modify(self, *, cosmology=None, **changes) -> BinningConfig:
        new = {k: v for k, v in changes.items() if v is not KEEP}
        old = self.to_dict()
        if old.get("edges") and {"zmin", "zmax", "num_bins", "method"} & new.keys() and "edges" not in new:
            b = self.binning
            old = {"zmin": b.edges[0], "zmax": b.edges[-1], "num_bins": len(b), "closed": b.closed}
        return BinningConfig.create(**(old | new), cosmology=cosmology)


@dataclass(frozen=True)
class Configuration:
    scales: ScalesConfig
    binning: BinningConfig
    cosmology: Any = cosmo.DEFAULT
    max_workers: int | None = None  # accepted; the cluster decides

    SCALES = ("rmin", "rmax", "unit", "rweight", "resolution")

    @classmethod
    def create(cls, *, cosmology=cosmo.DEFAULT, max_workers=None, **parameters) -> Configuration:
        """All parameters of scales and bins at once."""
        model = cls.model(cosmology)
        scales = {k: v for k, v in parameters.items() if k in cls.SCALES}
        bins = {k: v for k, v in parameters.items() if k not in cls.SCALES}
        return cls(section("scales", ScalesConfig.from_dict, scales), section("binning", lambda g: BinningConfig.from_dict(g, model), bins), cosmology, max_workers)

    @staticmethod
    def model(cosmology):
        try:
            return cosmo.named(cosmology)
        except (ValueError, TypeError) as e:
            raise ConfigError(str(e), "cosmology") from None

    def modify(self, *, cosmology=KEEP, max_workers=KEEP, **changes) -> Configuration:
        model = self.cosmology if cosmology is KEEP else cosmology
        scales = {k: v for k, v in changes.items() if k in self.SCALES}
        bins = {k: v for k, v in changes.items() if k not in self.SCALES}
        return dataclasses.replace(
            self, scales=self.scales.modify(**scales), binning=self.binning.modify(cosmology=self.model(model), **bins),
            cosmology=model, max_workers=self.max_workers if max_workers is KEEP else max_workers)

    @property
    def limits(self) -> Limits:
        return self.scales.limits(self.binning.binning, self.model(self.cosmology))

    @classmethod
    def from_dict(cls, given: dict) -> Configuration:
        checked(given, ("scales", "binning"), ("cosmology", "max_workers"))
        name = given.get("cosmology") or cosmo.DEFAULT
        model = cls.model(name)
        return cls(section("scales", ScalesConfig.from_dict, given["scales"]), section("binning", lambda g: BinningConfig.from_dict(g, model), given["binning"]), name, number(given.get("max_workers"), int, "max_workers"))

    def to_dict(self) -> dict:
        if not isinstance(self.cosmology, str):
            raise ConfigError("a custom cosmology cannot be stored", "cosmology")
        return {"scales": self.scales.to_dict(), "binning": self.binning.to_dict(), "cosmology": self.cosmology, "max_workers": self.max_workers}

    @classmethod
    def from_file(cls, path: str) -> Configuration:
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text()))

    def to_file(self, path: str) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(self.to_dict(), sort_keys=False))
