"""Plots of results with their errors; matplotlib is optional."""

from __future__ import annotations

import numpy as np

STYLES = ("point", "line", "step")


def available() -> bool:
    try:
        import matplotlib  # noqa: F401
    except ModuleNotFoundError:
        return False
    return True


def values(data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin edges, data and errors."""
    n = len(data.binning)
    errors = np.full(n, np.nan)
    for r in data.error.collect():
        errors[r.zbin] = np.nan if r.error is None else r.error
    return np.array(data.binning.edges), data.data, errors


def plot(data, axis, style: str = "point", label: str | None = None, offset: float = 0.0, **options):
    """Draws a result: points with bars, or a line or steps with a band; ``offset`` is a share of the bin widths."""
    if style not in STYLES:
        raise ValueError(f"invalid style '{style}', options are: {', '.join(STYLES)}")
    edges, y, error = values(data)
    x = (edges[1:] + edges[:-1]) / 2 + offset * np.diff(edges)
    axis.axhline(0.0, color="0.6", lw=0.8, zorder=-2)
    if style == "point":
        axis.errorbar(x, y, error, fmt=".", label=label, **options)
    elif style == "line":
        (line,) = axis.plot(x, y, label=label, **options)
        axis.fill_between(x, y - error, y + error, alpha=0.2, color=line.get_color())
    else:
        line = axis.stairs(y, edges, label=label, **options)
        axis.fill_between(edges, np.append(y - error, y[-1] - error[-1]), np.append(y + error, y[-1] + error[-1]), step="post", alpha=0.2, color=line.get_edgecolor())
    return axis


def heat_map(data, axis, **options):
    """The correlation matrix of a result."""
    n = len(data.binning)
    matrix = np.full((n, n), np.nan)
    for r in data.correlation.collect():
        matrix[r.zbin_i, r.zbin_j] = np.nan if r.corr is None else r.corr
    e = data.binning.edges
    return axis.pcolormesh(e, e, matrix, **({"vmin": -1, "vmax": 1, "cmap": "RdBu_r"} | options))


def figure(path: str, results: dict, steps: dict | None = None) -> None:
    """One panel for each name: points of ``results`` over steps of ``steps``."""
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    names = sorted({*results, *(steps or {})})
    fig, axes = plt.subplots(1, len(names), figsize=(4 * len(names), 3), squeeze=False)
    for name, axis in zip(names, axes[0]):
        if steps and name in steps:
            plot(steps[name].normalised(), axis, "step")
        if name in results:
            data = results[name]
            plot(data.normalised() if hasattr(data, "normalised") else data, axis)
        axis.set_title(name)
        axis.set_xlabel("redshift")
    fig.tight_layout()
    fig.savefig(path)
    plt.close(fig)
