"""Where a project keeps its catalogs, counts and results.

::

    cache/{reference,unknown_<bin>}/{data,rand}    catalogs by patch, Parquet
    cache/patch_centers.json                       centres that all catalogs share
    paircounts/{cross_<bin>,auto_ref,auto_unk_<bin>}
    estimate/{nz_est_<bin>,auto_ref,auto_unk_<bin>}.{dat,smp,cov}
    true/nz_true_<bin>.{dat,smp,cov}
    plots/*.png
    pipeline.yml  pipeline.log  .tasklock  .project_info

The driver and the executors must share the folder.  A table without its
``_SUCCESS`` mark is not there: a task that was cut off is run again.
"""

from __future__ import annotations

import json
import shutil
from pathlib import Path

from .. import __version__


class Directory:
    def __init__(self, path: str | Path, cache: str | Path | None = None):
        self.path = Path(path)
        self.cache = Path(cache) if cache else self.path / "cache"

    @classmethod
    def created(cls, path: str | Path, setup_text: str, cache: str | Path | None = None, overwrite: bool = False, resume: bool = False) -> Directory:
        out = cls(path, cache)
        if out.path.exists():
            if not (overwrite or resume):
                raise FileExistsError(f"project directory exists: {out.path}")
            if not out.info.exists():
                raise FileExistsError(f"not a project directory: {out.path}")
            if overwrite:
                out.drop_cache()
                shutil.rmtree(out.path)
        elif resume:
            raise FileNotFoundError(f"no project directory to resume: {out.path}")
        for d in (out.path, out.cache, *(out.path / n for n in ("paircounts", "estimate", "true", "plots"))):
            d.mkdir(parents=True, exist_ok=True)
        if cache and not (out.path / "cache").exists():
            (out.path / "cache").symlink_to(out.cache.absolute(), target_is_directory=True)
        out.info.write_text(json.dumps({"version": __version__}) + "\n")
        if not (resume and out.setup.exists()):
            out.setup.write_text(setup_text)
        return out

    info = property(lambda self: self.path / ".project_info")
    lock = property(lambda self: self.path / ".tasklock")
    setup = property(lambda self: self.path / "pipeline.yml")
    log = property(lambda self: self.path / "pipeline.log")

    def catalog(self, bin_: int | None, kind: str) -> Path:
        return self.cache / ("reference" if bin_ is None else f"unknown_{bin_}") / kind

    def counts(self, name: str, bin_: int | None = None) -> Path:
        return self.path / "paircounts" / (name if bin_ is None else f"{name}_{bin_}")

    def estimate(self, name: str, bin_: int | None = None) -> Path:
        return self.path / "estimate" / (name if bin_ is None else f"{name}_{bin_}")

    def true(self, bin_: int) -> Path:
        return self.path / "true" / f"nz_true_{bin_}"

    @property
    def centers(self) -> list[tuple[float, float]] | None:
        path = self.cache / "patch_centers.json"
        return [tuple(c) for c in json.loads(path.read_text())] if path.exists() else None

    def set_centers(self, centers: list[tuple[float, float]]) -> None:
        """The first catalog's centres are all catalogs' from there on."""
        if self.centers is None:
            (self.cache / "patch_centers.json").write_text(json.dumps(centers))

    def drop_cache(self) -> None:
        for d in self.cache.glob("*"):
            shutil.rmtree(d) if d.is_dir() else d.unlink()


def complete(path: Path) -> bool:
    """Whether a stored table is whole."""
    return (path / "_SUCCESS").exists()


def counted(path: Path) -> bool:
    return complete(path / "about")


def text_complete(path: Path) -> bool:
    return all(Path(f"{path}.{s}").exists() for s in ("dat", "smp", "cov"))
