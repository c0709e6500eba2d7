"""The tasks of a project: what each needs, when it is done, and how it runs."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import SparkSession

from .. import measurements as m
from ..catalog import Catalog
from .directory import Directory, complete, counted, text_complete
from .setup import Pair, Setup

logger = logging.getLogger("skyloom")


class TaskError(Exception):
    """A task that cannot run with a setup."""


@dataclass(frozen=True)
class Job:
    spark: SparkSession
    setup: Setup
    directory: Directory


@dataclass(frozen=True)
class Task:
    name: str
    about: str
    run: Callable[[Job], None]
    done: Callable[[Job], bool]
    #: Parts of the setup that must be there; of a group in a tuple, one.
    needs: tuple[str | tuple[str, ...], ...] = ()
    #: Tasks that come along, and those that go first if they are asked for.
    inputs: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    #: Comes along by itself and need not be listed.
    linked: bool = False


def missing(setup: Setup, path: str) -> str | None:
    """The part of a dotted path where a setup has nothing."""
    at, seen = setup, []
    for name in path.split("."):
        at = getattr(at, name)
        seen.append(name)
        if at is None:
            return ".".join(seen)
    return None


def check(task: Task, setup: Setup) -> None:
    for need in task.needs:
        group = need if isinstance(need, tuple) else (need,)
        lost = [missing(setup, p) for p in group]
        if all(lost):
            said = " and/or ".join(f"'{p}'" for p in (group if len(group) > 1 else lost))
            raise TaskError(f"task '{task.name}' requires {said}")


def load(job: Job, pair: Pair, bin_: int | None) -> None:
    """Randoms first: their patches are better filled.  The first catalog's centres are all others'."""
    c = pair.columns
    for kind, source in (("rand", pair.path_rand), ("data", pair.path_data)):
        if source is None:
            continue
        if c["patches"]:
            how = {"patch_name": c["patches"]}
        elif job.directory.centers:
            how = {"patch_centers": job.directory.centers}
        else:
            how = {"patch_num": job.setup.inputs.num_patches}
        made = Catalog.from_file(
            job.spark, source, c["ra"], c["dec"], weight=c["weight"], redshift=c["redshift"], path=str(job.directory.catalog(bin_, kind)), overwrite=True, **how)
        if not c["patches"]:
            job.directory.set_centers(made.centers)


def loaded(job: Job, pair: Pair, bin_: int | None) -> bool:
    return all(complete(job.directory.catalog(bin_, kind)) for kind, p in (("rand", pair.path_rand), ("data", pair.path_data)) if p)


def restored(job: Job, bin_: int | None) -> tuple[Catalog, Catalog | None]:
    own = job.setup.inputs.reference.pair if bin_ is None else job.setup.inputs.unknown.pairs[bin_]
    read = lambda kind: Catalog.restored(job.spark, str(job.directory.catalog(bin_, kind)), own.columns["weight"] is not None)
    return read("data"), read("rand") if own.path_rand else None


def run_auto(job: Job, bin_: int | None, name: str) -> None:
    data, random = restored(job, bin_)
    (corr,) = m.autocorrelate(job.setup.correlation, data, random)
    corr.to_file(str(job.directory.counts(name, bin_)), overwrite=True)
    corr.released()


def run_cross(job: Job) -> None:
    ref, ref_rand = restored(job, None)
    for b in job.setup.bins:
        unk, unk_rand = restored(job, b)
        (corr,) = m.crosscorrelate(job.setup.correlation, ref, unk, ref_rand=ref_rand, unk_rand=unk_rand)
        corr.to_file(str(job.directory.counts("cross", b)), overwrite=True)
        corr.released()


def sampled(job: Job, name: str, bin_: int | None = None) -> m.CorrData | None:
    """A correlation function from its counts, stored as text; None without counts."""
    path = job.directory.counts(name, bin_)
    if not counted(path):
        return None
    data = m.CorrFunc.from_file(job.spark, str(path)).sample()
    data.to_files(str(job.directory.estimate(name, bin_)))
    return data


def run_estimate(job: Job) -> None:
    d = job.directory
    auto_ref = sampled(job, "auto_ref")
    for b in job.setup.bins:
        auto_unk = sampled(job, "auto_unk", b)
        if counted(d.counts("cross", b)):
            cross = m.CorrFunc.from_file(job.spark, str(d.counts("cross", b))).sample()
            m.RedshiftData.from_corrdata(cross, auto_ref, auto_unk).to_files(str(d.estimate("nz_est", b)))


def estimated(job: Job) -> bool:
    d = job.directory
    wanted = [(d.counts("auto_ref"), d.estimate("auto_ref"))]
    wanted += [x for b in job.setup.bins for x in ((d.counts("auto_unk", b), d.estimate("auto_unk", b)), (d.counts("cross", b), d.estimate("nz_est", b)))]
    there = [text_complete(e) for c, e in wanted if counted(c)]
    return bool(there) and all(there)


def run_hist(job: Job) -> None:
    for b in job.setup.bins:
        m.HistData.from_catalog(restored(job, b)[0], job.setup.correlation).to_files(str(job.directory.true(b)))


def run_plot(job: Job) -> None:
    from .. import plots

    d = job.directory
    read = lambda cls, path: cls.from_files(job.spark, str(path)) if text_complete(path) else None
    some = lambda cls, paths: {k: x for k, p in paths.items() if (x := read(cls, p)) is not None}
    figures = {
        "auto_ref": some(m.CorrData, {"reference": d.estimate("auto_ref")}),
        "auto_unk": some(m.CorrData, {f"bin {b}": d.estimate("auto_unk", b) for b in job.setup.bins}),
        "redshifts": some(m.RedshiftData, {f"bin {b}": d.estimate("nz_est", b) for b in job.setup.bins}),
    }
    true = some(m.HistData, {f"bin {b}": d.true(b) for b in job.setup.bins})
    if not plots.available():
        logger.warning("matplotlib is missing: no plots")
        return
    for name, data in figures.items():
        if data or name == "redshifts" and true:
            plots.figure(str(d.path / "plots" / f"{name}.png"), data, true if name == "redshifts" else {})


TASKS = {t.name: t for t in (
    Task("load_ref", "load the reference catalog and its randoms", lambda j: load(j, j.setup.inputs.reference.pair, None), lambda j: loaded(j, j.setup.inputs.reference.pair, None), ("inputs.reference",), linked=True),
    Task("load_unk", "load the unknown catalogs and their randoms", lambda j: [load(j, p, b) for b, p in j.setup.inputs.unknown.pairs.items()] and None,
         lambda j: all(loaded(j, p, b) for b, p in j.setup.inputs.unknown.pairs.items()), ("inputs.unknown",), after=("load_ref",), linked=True),
    Task("auto_ref", "count pairs of the reference with itself", lambda j: run_auto(j, None, "auto_ref"), lambda j: counted(j.directory.counts("auto_ref")), ("inputs.reference.path_rand",), ("load_ref",)),
    Task("auto_unk", "count pairs of each unknown bin with itself", lambda j: [run_auto(j, b, "auto_unk") for b in j.setup.bins] and None,
         lambda j: all(counted(j.directory.counts("auto_unk", b)) for b in j.setup.bins), ("inputs.unknown.path_rand", "inputs.unknown.redshift"), ("load_unk",)),
    Task("cross_corr", "count pairs of the reference with each unknown bin", run_cross, lambda j: all(counted(j.directory.counts("cross", b)) for b in j.setup.bins),
         ("inputs.reference", "inputs.unknown", ("inputs.reference.path_rand", "inputs.unknown.path_rand")), ("load_ref", "load_unk")),
    Task("estimate", "correlation functions and n(z), with autocorrelations against bias", run_estimate, estimated, after=("cross_corr", "auto_ref", "auto_unk")),
    Task("hist", "redshift histograms of the unknown bins", run_hist, lambda j: all(text_complete(j.directory.true(b)) for b in j.setup.bins), ("inputs.unknown.redshift",), ("load_unk",)),
    Task("plot", "plots of all that is there", run_plot, lambda j: any((j.directory.path / "plots").iterdir()), after=("estimate", "hist")),
)}


def ordered(names: tuple[str, ...], setup: Setup) -> list[Task]:
    """The tasks and what comes along with them, each after what it needs."""
    unknown = [n for n in names if n not in TASKS]
    if unknown:
        raise TaskError(f"unknown task '{unknown[0]}', options are: {', '.join(TASKS)}")
    wanted: dict[str, None] = {}
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted[name] = None
            todo += TASKS[name].inputs
    if "estimate" in wanted and not wanted.keys() & {"cross_corr", "auto_ref", "auto_unk"}:
        raise TaskError("task 'estimate' requires 'cross_corr', 'auto_ref' or 'auto_unk'")
    graph = {n: [x for x in (*TASKS[n].inputs, *TASKS[n].after) if x in wanted] for n in TASKS if n in wanted}
    # what was asked for is checked first: its needs are what the user can tell
    for n in (*(n for n in TASKS if n in names), *(n for n in wanted if n not in names)):
        check(TASKS[n], setup)
    return [TASKS[n] for n in TopologicalSorter(graph).static_order()]
