"""The setup of a project: correlation parameters, input catalogs and tasks, from YAML."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from ..config import ConfigError, Configuration, checked, number, section

COLUMNS = ("ra", "dec", "weight", "redshift", "patches")


def existing(path, name: str) -> str:
    """A path as text; one of this machine must exist, one of another store is left to Spark."""
    if not isinstance(path, (str, Path)):
        raise ConfigError("expected a path", name)
    if "://" not in str(path) and not Path(path).exists():
        raise ConfigError(f"input file not found: {path}", name)
    return str(path)


def by_bin(given, name: str) -> dict[int, str]:
    """Paths by tomographic bin."""
    if not isinstance(given, dict) or not given:
        raise ConfigError("expected a mapping of bins to paths", name)
    if any(v is None for v in given.values()):
        raise ConfigError("a bin's path may not be empty; leave the parameter out instead", name)
    return {number(k, int, name): existing(v, name) for k, v in given.items()}


@dataclass(frozen=True)
class Pair:
    """A data catalog and its randoms, with the names of their columns."""

    path_data: str
    path_rand: str | None
    columns: dict[str, str | None]


@dataclass(frozen=True)
class Reference:
    path_data: str
    path_rand: str | None
    ra: str
    dec: str
    redshift: str
    weight: str | None = None
    patches: str | None = None

    @classmethod
    def from_dict(cls, given: dict) -> Reference:
        own = dict(checked(given, ("path_data", "ra", "dec", "redshift"), ("path_rand", "weight", "patches")))
        own["path_data"] = existing(own["path_data"], "path_data")
        own["path_rand"] = None if own.get("path_rand") is None else existing(own["path_rand"], "path_rand")
        return cls(**own)

    @property
    def pair(self) -> Pair:
        return Pair(self.path_data, self.path_rand, {c: getattr(self, c) for c in COLUMNS})


@dataclass(frozen=True)
class Unknown:
    path_data: dict[int, str]
    path_rand: dict[int, str] | None
    ra: str
    dec: str
    weight: str | None = None
    redshift: str | None = None
    patches: str | None = None

    @classmethod
    def from_dict(cls, given: dict) -> Unknown:
        own = dict(checked(given, ("path_data", "ra", "dec"), ("path_rand", "weight", "redshift", "patches")))
        own["path_data"] = by_bin(own["path_data"], "path_data")
        own["path_rand"] = None if own.get("path_rand") is None else by_bin(own["path_rand"], "path_rand")
        if own["path_rand"] is not None and own["path_rand"].keys() != own["path_data"].keys():
            raise ConfigError("bins of 'path_data' and 'path_rand' differ")
        return cls(**own)

    @property
    def pairs(self) -> dict[int, Pair]:
        columns = {c: getattr(self, c) for c in COLUMNS}
        return {k: Pair(p, self.path_rand and self.path_rand[k], columns) for k, p in sorted(self.path_data.items())}


@dataclass(frozen=True)
class Inputs:
    reference: Reference | None = None
    unknown: Unknown | None = None
    num_patches: int | None = None
    cache_path: str | None = None

    @classmethod
    def from_dict(cls, given: dict) -> Inputs:
        checked(given, (), ("reference", "unknown", "num_patches", "cache_path"))
        parts = {n: section(n, c.from_dict, given[n]) if given.get(n) is not None else None for n, c in (("reference", Reference), ("unknown", Unknown))}
        cache = given.get("cache_path")
        return cls(**parts, num_patches=number(given.get("num_patches"), int, "num_patches"), cache_path=None if cache is None else str(cache))


@dataclass(frozen=True)
class Setup:
    correlation: Configuration
    inputs: Inputs
    tasks: tuple[str, ...]

    @classmethod
    def from_dict(cls, given: dict) -> Setup:
        checked(given, ("correlation", "inputs", "tasks"), ())
        tasks = given["tasks"]
        if not isinstance(tasks, list) or not all(isinstance(t, str) for t in tasks):
            raise ConfigError("expected a list of tasks", "tasks")
        return cls(section("correlation", Configuration.from_dict, given["correlation"]), section("inputs", Inputs.from_dict, given["inputs"]), tuple(tasks))

    @classmethod
    def from_file(cls, path: str | Path) -> Setup:
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text()))

    @property
    def bins(self) -> list[int]:
        return [] if self.inputs.unknown is None else sorted(self.inputs.unknown.path_data)


#: Sections and parameters with their defaults (``...``: required) and what they are.
PARAMETERS = (
    ("correlation", None, "parameters of the measurements"),
    ("correlation.scales", None, "scales that pairs are counted on"),
    ("correlation.scales.rmin", ..., "least separation, or a list of them"),
    ("correlation.scales.rmax", ..., "largest separation, or a list of them"),
    ("correlation.scales.unit", "kpc", "unit of the separations"),
    ("correlation.scales.rweight", "null", "power of the separation that pairs are weighted by"),
    ("correlation.scales.resolution", "null", "logarithmic bins for these weights"),
    ("correlation.binning", None, "redshift bins of the reference"),
    ("correlation.binning.zmin", ..., "lowest edge, unless edges are given"),
    ("correlation.binning.zmax", ..., "highest edge, unless edges are given"),
    ("correlation.binning.num_bins", 30, "number of bins"),
    ("correlation.binning.method", "linear", "linear, comoving or logspace"),
    ("correlation.binning.edges", "null", "edges of bins, in place of the above"),
    ("correlation.binning.closed", "right", "side that belongs to a bin"),
    ("correlation.cosmology", "Planck15", "name of a cosmological model"),
    ("correlation.max_workers", "null", "accepted; the cluster decides"),
    ("inputs", None, "input catalogs"),
    ("inputs.reference", None, "reference sample (optional)"),
    ("inputs.reference.path_data", ..., "catalog"),
    ("inputs.reference.path_rand", "null", "randoms"),
    ("inputs.reference.ra", ..., "column with right ascension in degrees"),
    ("inputs.reference.dec", ..., "column with declination in degrees"),
    ("inputs.reference.redshift", ..., "column with redshifts"),
    ("inputs.reference.weight", "null", "column with weights"),
    ("inputs.reference.patches", "null", "column with patch ids"),
    ("inputs.unknown", None, "unknown samples by tomographic bin (optional)"),
    ("inputs.unknown.path_data", ..., "mapping of bins to catalogs"),
    ("inputs.unknown.path_rand", "null", "mapping of the same bins to randoms"),
    ("inputs.unknown.ra", ..., "column with right ascension in degrees"),
    ("inputs.unknown.dec", ..., "column with declination in degrees"),
    ("inputs.unknown.redshift", "null", "column with redshifts"),
    ("inputs.unknown.weight", "null", "column with weights"),
    ("inputs.unknown.patches", "null", "column with patch ids"),
    ("inputs.num_patches", "null", "patches to make, unless columns give them"),
    ("inputs.cache_path", "null", "folder for catalogs outside of the project"),
)


def default_yaml(width: int = 40) -> str:
    """A setup with all parameters, their defaults and comments."""
    from .tasks import TASKS

    lines = []
    for path, default, about in PARAMETERS:
        parts = path.split(".")
        value = "" if default is None or default is ... else f" {default}"
        lines.append(f"{'    ' * (len(parts) - 1)}{parts[-1]}:{value}".ljust(width) + f"# {about}" + (" (required)" if default is ... else ""))
    lines += ["tasks:".ljust(width) + "# what to run, in any order"]
    lines += [f"  - {t.name}".ljust(width) + f"# {t.about}" for t in TASKS.values() if not t.linked]
    return "\n".join(lines) + "\n"
