import copy
import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import yaml

from skyloom import measurements as m
from skyloom.config import ConfigError
from skyloom.project import run as project
from skyloom.project.setup import Setup, default_yaml
from skyloom.project.tasks import TaskError, ordered


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Data and randoms with a patch column, 2 x 2 patches."""
    folder, rng = tmp_path_factory.mktemp("inputs"), np.random.default_rng(8)
    out = {}
    for name, n in (("data", 400), ("rand", 900)):
        ra, dec = rng.uniform(10, 14, n), rng.uniform(-2, 2, n)
        table = {"RA": ra, "Dec": dec, "redshift": rng.uniform(0.15, 0.7, n), "wei": rng.uniform(0.5, 2, n), "patch": ((ra > 12) * 2 + (dec > 0)).astype("int16")}
        out[name] = str(folder / f"{name}.parquet")
        pq.write_table(pa.table(table), out[name])
    return out


def setup(files, tasks="auto_ref auto_unk cross_corr estimate hist plot", **changes):
    """A whole setup; changes are dotted paths (``__`` for a dot) to new values, None drops the part."""
    data, rand = files["data"], files["rand"]
    out = {
        "correlation": {"scales": {"rmin": 100, "rmax": 5000, "unit": "kpc"}, "binning": {"zmin": 0.15, "zmax": 0.7, "num_bins": 2}},
        "inputs": {
            "reference": {"path_data": data, "path_rand": rand, "ra": "RA", "dec": "Dec", "redshift": "redshift", "patches": "patch"},
            "unknown": {"path_data": {1: data}, "path_rand": {1: rand}, "ra": "RA", "dec": "Dec", "weight": "wei", "redshift": "redshift", "patches": "patch"},
        },
        "tasks": tasks.split(),
    }
    out = copy.deepcopy(out)
    for path, value in changes.items():
        *parts, last = path.split("__")
        at = out
        for p in parts:
            at = at[p]
        if value is None:
            del at[last]
        else:
            at[last] = value
    return out


REF, UNK = "inputs__reference", "inputs__unknown"
VALID = {
    "all": {},
    "no_unk_z": {"tasks": "auto_ref cross_corr estimate plot", f"{UNK}__redshift": None},
    "no_wpp": {"tasks": "auto_ref cross_corr estimate hist plot", f"{UNK}__path_rand": None},
    "no_wss": {"tasks": "auto_unk cross_corr estimate hist plot", f"{REF}__path_rand": None},
    "only_hist": {"tasks": "hist plot", REF: None, f"{UNK}__path_rand": None},
    "only_wpp": {"tasks": "auto_unk estimate plot", REF: None},
    "only_wsp": {"tasks": "cross_corr estimate hist plot"},
    "only_wsp_no_ref_rand": {"tasks": "cross_corr estimate hist plot", f"{REF}__path_rand": None},
    "only_wsp_no_unk_rand": {"tasks": "cross_corr estimate hist plot", f"{UNK}__path_rand": None},
    "only_wss": {"tasks": "auto_ref estimate plot", UNK: None},
}
INVALID = {
    "extra_rand": ({f"{UNK}__path_rand": lambda f: {1: f["rand"], 2: f["rand"]}}, ConfigError, "inputs.unknown"),
    "extra_data": ({f"{UNK}__path_data": lambda f: {1: f["data"], 2: f["data"]}}, ConfigError, "inputs.unknown"),
    "extra_value": ({f"{REF}__unknown": "test"}, ConfigError, "inputs.reference.unknown: unknown configuration parameter"),
    "missing_binning": ({"correlation__binning": None}, ConfigError, "correlation.binning"),
    "missing_scales": ({"correlation__scales": None}, ConfigError, "correlation.scales"),
    "no_rand": ({"tasks": "cross_corr estimate hist plot", f"{REF}__path_rand": None, f"{UNK}__path_rand": None}, TaskError, "requires 'inputs.reference.path_rand' and/or 'inputs.unknown.path_rand'"),
    "no_ref_coord": ({f"{REF}__dec": None}, ConfigError, "inputs.reference.dec: parameter is required"),
    "no_ref": ({REF: None}, TaskError, "requires 'inputs.reference'"),
    "no_ref_z": ({f"{REF}__redshift": None}, ConfigError, "inputs.reference.redshift"),
    "no_unk": ({UNK: None}, TaskError, "requires 'inputs.unknown'"),
    "only_hist_no_unk_z": ({"tasks": "hist plot", REF: None, f"{UNK}__redshift": None}, TaskError, "requires 'inputs.unknown.redshift'"),
    "only_wpp_no_rand": ({"tasks": "auto_unk plot", REF: None, f"{UNK}__path_rand": None}, TaskError, "requires 'inputs.unknown.path_rand'"),
    "only_wpp_no_unk_z": ({"tasks": "auto_unk plot", f"{UNK}__redshift": None}, TaskError, "requires 'inputs.unknown.redshift'"),
    "mixed_rands": ({f"{UNK}__path_data": lambda f: {1: f["data"], 2: f["data"]}, f"{UNK}__path_rand": lambda f: {1: f["rand"], 2: None}}, ConfigError, "inputs.unknown.path_rand"),
    "null_rands": ({f"{UNK}__path_rand": lambda f: {1: None}}, ConfigError, "inputs.unknown.path_rand"),
    "only_wss_no_rand": ({"tasks": "auto_ref plot", f"{REF}__path_rand": None}, TaskError, "requires 'inputs.reference.path_rand'"),
    "no_file": ({f"{REF}__path_data": "/nowhere.parquet"}, ConfigError, "inputs.reference.path_data: input file not found"),
    "no_task": ({"tasks": "count"}, TaskError, "unknown task 'count'"),
    "two_scales": ({"correlation__scales__rmin": [1, 2], "correlation__scales__rmax": [3, 4]}, ConfigError, "correlation.scales"),
}


@pytest.mark.parametrize("name", VALID)
def test_valid_setups(files, name):
    own = Setup.from_dict(setup(files, **VALID[name]))
    names = [t.name for t in ordered(own.tasks, own)]
    assert set(own.tasks) <= set(names) and ("load_ref" in names) == (bool({"auto_ref", "cross_corr"} & set(names)))
    for first, then in (("load_ref", "load_unk"), ("load_unk", "cross_corr"), ("auto_ref", "estimate"), ("cross_corr", "estimate"), ("estimate", "plot"), ("hist", "plot")):
        assert first not in names or then not in names or names.index(first) < names.index(then)


@pytest.mark.parametrize("name", INVALID)
def test_invalid_setups(files, tmp_path, name):
    changes, kind, message = INVALID[name]
    text = yaml.safe_dump(setup(files, **{k: v(files) if callable(v) else v for k, v in changes.items()}))
    (tmp_path / "s.yml").write_text(text)
    with pytest.raises(kind) as e:
        project.run(str(tmp_path / "p"), str(tmp_path / "s.yml"), quiet=True)
    assert message in str(e.value) and not (tmp_path / "p").exists()


def test_whole_project(spark, files, tmp_path):
    (tmp_path / "s.yml").write_text(yaml.safe_dump(setup(files)))
    path = tmp_path / "p"
    go = lambda **k: project.run(str(path), str(tmp_path / "s.yml"), spark=spark, quiet=True, **k)
    assert set(go()) == {"load_ref", "load_unk", "auto_ref", "auto_unk", "cross_corr", "estimate", "hist", "plot"}
    nz = m.RedshiftData.from_files(spark, str(path / "estimate" / "nz_est_1"))
    parts = [m.CorrFunc.from_file(spark, str(path / "paircounts" / n)) for n in ("cross_1", "auto_ref", "auto_unk_1")]
    want = m.RedshiftData.from_corrfuncs(*parts)
    assert np.allclose(nz.data, want.data, atol=1e-4, equal_nan=True) and nz.samples.shape == (4, 2)
    assert m.HistData.from_files(spark, str(path / "true" / "nz_true_1")).data.sum() > 0
    assert not (path / ".tasklock").exists() and "running cross_corr" in (path / "pipeline.log").read_text() and (path / "pipeline.yml").exists()
    with pytest.raises(FileExistsError):
        go()
    assert set(go(resume=True)) <= {"plot"}
    # a task that was cut off, and one whose result is lost
    (path / ".tasklock").write_text("hist\n")
    (path / "paircounts" / "auto_ref" / "about" / "_SUCCESS").unlink()
    with pytest.raises(FileExistsError):
        go()
    assert set(go(resume=True)) - {"plot"} == {"hist", "auto_ref"}
    with pytest.raises(FileExistsError, match="not a project"):
        project.run(str(tmp_path), str(tmp_path / "s.yml"), spark=spark, quiet=True, overwrite=True)


def test_made_patches_external_cache_and_drop(spark, files, tmp_path):
    own = setup(files, "hist", **{REF: None, f"{UNK}__path_rand": None, f"{UNK}__patches": None, "inputs__num_patches": 3})
    (tmp_path / "s.yml").write_text(yaml.safe_dump(own))
    args = [str(tmp_path / "p"), str(tmp_path / "s.yml"), "--quiet", "--overwrite", "--cache-path", str(tmp_path / "cache")]
    project.main(args)
    assert len(json.loads((tmp_path / "cache" / "patch_centers.json").read_text())) == 3 and (tmp_path / "p" / "cache").is_symlink()
    project.main([*args, "--drop"])
    assert not any((tmp_path / "cache").iterdir()) and (tmp_path / "p" / "true" / "nz_true_1.dat").exists()


def test_command_line(capsys):
    for args in (["--dump"], ["--version"]):
        with pytest.raises(SystemExit):
            project.parser().parse_args(args)
    given = yaml.safe_load(default_yaml())
    assert given["correlation"]["binning"]["num_bins"] == 30 and given["tasks"] == ["auto_ref", "auto_unk", "cross_corr", "estimate", "hist", "plot"]
    assert "# number of bins" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        project.parser().parse_args(["p", "/nowhere.yml"])
