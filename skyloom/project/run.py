"""Runs a project, and its command line."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .. import __version__
from ..config import ConfigError
from .directory import Directory
from .setup import Setup, default_yaml
from .tasks import Job, Task, logger, ordered


def run(path: str, setup_file: str, *, spark: SparkSession | None = None, cache_path: str | None = None, workers: int | None = None, drop: bool = False, overwrite: bool = False, resume: bool = False,
        verbose: bool = False, quiet: bool = False, progress: bool = False) -> list[str]:
    """Runs what the setup asks for; returns the names of the tasks that ran.

    ``resume`` leaves out what is done; a task that was cut off is named in the lock file and runs again.
    Spark shows ``progress`` itself.  All is checked before the directory is touched.
    """
    text = Path(setup_file).read_text()
    setup = Setup.from_file(setup_file)
    if workers is not None:
        setup = dataclasses.replace(setup, correlation=setup.correlation.modify(max_workers=workers))
    if setup.correlation.scales.num_scales != 1:
        raise ConfigError("a project takes one scale", "correlation.scales")
    queue = ordered(setup.tasks, setup)
    directory = Directory.created(path, text, cache_path or setup.inputs.cache_path, overwrite, resume)
    if directory.lock.exists() and not resume:
        raise FileExistsError(f"another run holds {directory.lock}")
    cut_off = directory.lock.read_text().strip() if directory.lock.exists() else ""
    spark = spark or SparkSession.builder.config("spark.ui.showConsoleProgress", str(progress).lower()).getOrCreate()
    job, ran = Job(spark, setup, directory), []
    with logged(directory, verbose, quiet):
        for task in queue:
            if resume and task.name != cut_off and task.done(job):
                logger.info("%s is done", task.name)
                continue
            step(job, task)
            ran.append(task.name)
        if drop:
            directory.drop_cache()
    return ran


def step(job: Job, task: Task) -> None:
    job.directory.lock.write_text(task.name + "\n")
    logger.info("running %s", task.name)
    task.run(job)
    job.directory.lock.unlink()


class logged:  # noqa: N801
    """Messages go to the project's log, and to the terminal unless it is quiet."""

    def __init__(self, directory: Directory, verbose: bool, quiet: bool):
        self.handlers = [logging.FileHandler(directory.log), *([] if quiet else [logging.StreamHandler(sys.stderr)])]
        self.level = logging.DEBUG if verbose else logging.INFO

    def __enter__(self) -> None:
        logger.setLevel(self.level)
        for h in self.handlers:
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            logger.addHandler(h)

    def __exit__(self, kind, error, trace) -> None:
        if error is not None:
            logger.error("%s: %s", kind.__name__, error)
        for h in self.handlers:
            logger.removeHandler(h)
            h.close()


class Dump(argparse.Action):
    def __call__(self, parser, *_):
        print(default_yaml(), end="")
        parser.exit()


def file_path(text: str) -> str:
    if not Path(text).is_file():
        raise argparse.ArgumentTypeError(f"file '{text}' not found")
    return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("skyloom", description="Clustering redshifts: runs the tasks of a setup file in a project directory.")
    p.add_argument("path", help="project directory")
    p.add_argument("setup_file", metavar="setup", type=file_path, help="YAML file with parameters, inputs and tasks")
    p.add_argument("--cache-path", help="folder for catalogs, in place of the setup's")
    p.add_argument("--workers", type=int, help="accepted in place of the setup's; the cluster decides")
    for name, about in (("drop", "delete the catalogs at the end"), ("overwrite", "replace the project directory"), ("resume", "go on where a run ended"), ("quiet", "write to the log only"), ("progress", "show progress")):
        p.add_argument(f"--{name}", action="store_true", help=about)
    p.add_argument("-v", "--verbose", action="store_true", help="log more")
    p.add_argument("-d", "--dump", action=Dump, nargs=0, default=argparse.SUPPRESS, help="print a setup with all parameters")
    p.add_argument("--version", action="version", version=f"skyloom {__version__}")
    return p


def main(args: list[str] | None = None) -> None:
    run(**vars(parser().parse_args(args)))
