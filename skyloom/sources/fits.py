"""FITS binary tables and HDF5 columns as Spark data sources.

``spark.read.format("skyfits").option("hdu", 1).load(uri)`` after ``register(spark)``.
The table is read in ranges of rows, each by its own task, and only within the
file's row bytes; any store that Arrow's file systems open will do (``file:``,
``hdfs:``, ``s3:`` or a plain path that all executors have).

Columns with one value per row are read: numbers, logicals and strings; others
are left out.  Scaled columns (TSCAL, TZERO) become double.  A null string is
an empty one, trailing spaces go.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

BLOCK = 2880
CARD = 80
#: Fixed by the format: code, numpy type, Spark type.
TYPES = {
    "L": ("S1", "boolean"),
    "B": ("u1", "short"),
    "I": (">i2", "short"),
    "J": (">i4", "int"),
    "K": (">i8", "long"),
    "E": (">f4", "float"),
    "D": (">f8", "double"),
    "A": ("S", "string"),
}
WIDE = {"L": 1, "X": 0, "B": 1, "I": 2, "J": 4, "K": 8, "A": 1, "E": 4, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}
#: Integers with an offset and no scale stay whole, one size larger.
SHIFTED = {"B": "short", "I": "int", "J": "long", "K": "decimal(20,0)"}
ROWS = 1 << 20


def opened(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(uri)
    system, path = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))
    return system.open_input_file(path)


def value(text: str):
    text = text.strip()
    if text.startswith("'"):
        return re.match("'((?:[^']|'')*)'", text)[1].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text


def header(file) -> dict:
    out: dict = {}
    while True:
        block = file.read(BLOCK).decode("ascii")
        if len(block) < BLOCK:
            raise ValueError("the FITS file ends within a header")
        for at in range(0, BLOCK, CARD):
            card = block[at : at + CARD]
            key = card[:8].rstrip()
            if key == "END":
                return out
            if card[8:10] == "= ":
                out[key] = value(card[10:])


def located(file, hdu: int) -> tuple[dict, int]:
    """Header of the ``hdu``-th unit (0: the primary one) and where its data begin."""
    for k in range(hdu + 1):
        h = header(file)
        if k == hdu:
            return h, file.tell()
        cells = int(np.prod([h[f"NAXIS{i + 1}"] for i in range(h.get("NAXIS", 0))], dtype=np.int64)) if h.get("NAXIS", 0) else 0
        size = abs(h["BITPIX"]) // 8 * h.get("GCOUNT", 1) * (h.get("PCOUNT", 0) + cells)
        file.seek(file.tell() + -(-size // BLOCK) * BLOCK)
    raise AssertionError


def fields(h: dict, wanted: list[str] | None = None) -> list[tuple]:
    """name, code, offset, width, scale, zero and null of the columns that are read: the wanted ones, or all."""
    if h.get("XTENSION") != "BINTABLE":
        raise ValueError("the HDU is not a binary table")
    out, at = [], 0
    for k in range(1, h["TFIELDS"] + 1):
        repeat, code = re.match(r"(\d*)([A-Z])", h[f"TFORM{k}"]).groups()
        n = int(repeat or 1)
        width = -(-n // 8) if code == "X" else n * WIDE[code]
        if code in TYPES and (n == 1 or code == "A" and n):
            out.append((h.get(f"TTYPE{k}", f"col{k}"), code, at, width, float(h.get(f"TSCAL{k}", 1)), h.get(f"TZERO{k}", 0), h.get(f"TNULL{k}")))
        at += width
    if wanted is None:
        return out
    return [f for f in out if f[0] in wanted]


def shifted(f: tuple) -> bool:
    return f[1] in SHIFTED and f[4] == 1.0 and f[5] != 0 and float(f[5]).is_integer()


def scaled(f: tuple) -> bool:
    return f[1] in "BIJKED" and (f[4], f[5]) != (1.0, 0) and not shifted(f)


def spark_type(f: tuple) -> str:
    return "double" if scaled(f) else SHIFTED[f[1]] if shifted(f) else TYPES[f[1]][1]


def wanted_columns(options: dict) -> list[str] | None:
    return json.loads(options["columns"]) if "columns" in options else None


class FitsReader(DataSourceReader):
    def __init__(self, path: str, hdu: int, rows: int, wanted: list[str] | None = None):
        self.path, self.hdu, self.rows, self.wanted = path, hdu, rows, wanted

    def partitions(self):
        with opened(self.path) as f:
            n = located(f, self.hdu)[0]["NAXIS2"]
        return [InputPartition((at, min(n, at + self.rows))) for at in range(0, n, self.rows)] or [InputPartition((0, 0))]

    def read(self, partition):
        first, last = partition.value
        with opened(self.path) as f:
            h, begin = located(f, self.hdu)
            size, own = h["NAXIS1"], fields(h, self.wanted)
            step = max(1, (16 << 20) // max(1, size))
            kind = np.dtype({"names": [str(k) for k in range(len(own))], "formats": [f"S{x[3]}" if x[1] == "A" else TYPES[x[1]][0] for x in own], "offsets": [x[2] for x in own], "itemsize": size})
            for at in range(first, last, step):
                f.seek(begin + at * size)
                rows = np.frombuffer(f.read((min(last, at + step) - at) * size), kind)
                yield pa.RecordBatch.from_arrays([self.column(rows[str(k)], x) for k, x in enumerate(own)], [x[0] for x in own])

    @staticmethod
    def column(v: np.ndarray, f: tuple) -> pa.Array:
        if f[1] == "A":
            return pa.array([x.split(b"\0")[0].decode("ascii", "replace").rstrip() for x in v.tolist()], pa.string())
        if f[1] == "L":
            return pa.array([{b"T": True, b"F": False}.get(x) for x in v.tolist()], pa.bool_())
        v = v.astype(v.dtype.newbyteorder("="))
        lost = None if f[6] is None or f[1] not in SHIFTED else v == f[6]
        if scaled(f):
            return pa.array(v.astype(np.float64) * f[4] + float(f[5]), mask=lost)
        if shifted(f):
            if f[1] == "K":
                return pa.array([None if lost is not None and lost[k] else int(x) + int(f[5]) for k, x in enumerate(v.tolist())], pa.decimal128(20, 0))
            return pa.array(v.astype({"B": np.int16, "I": np.int32, "J": np.int64}[f[1]]) + int(f[5]), mask=lost)
        return pa.array(v.astype(np.int16) if f[1] == "B" else v, mask=lost)


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skyfits"

    def _path(self) -> str:
        return self.options["path"]

    def _hdu(self) -> int:
        return int(self.options.get("hdu", 1))

    def schema(self) -> str:
        with opened(self._path()) as f:
            h, _ = located(f, self._hdu())
        return ", ".join(f"`{x[0]}` {spark_type(x)}" for x in fields(h, wanted_columns(self.options)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return FitsReader(self._path(), self._hdu(), int(self.options.get("rows", ROWS)), wanted_columns(self.options))


class HdfReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], rows: int):
        self.path, self.names, self.rows = path, names, rows

    def partitions(self):
        import h5py

        with h5py.File(self.path, "r") as f:
            sizes = {len(f[n]) for n in self.names}
        if len(sizes) > 1:
            raise ValueError("the HDF5 columns differ in length")
        n = sizes.pop()
        return [InputPartition((at, min(n, at + self.rows))) for at in range(0, n, self.rows)] or [InputPartition((0, 0))]

    def read(self, partition):
        import h5py

        first, last = partition.value
        with h5py.File(self.path, "r") as f:
            yield pa.RecordBatch.from_arrays([pa.array(f[n][first:last].astype(np.float64)) for n in self.names], self.names)


class HdfSource(DataSource):
    """Top-level numeric datasets as double columns; needs h5py on all executors, and a path they share."""

    @classmethod
    def name(cls) -> str:
        return "skyhdf"

    def _names(self) -> list[str]:
        import h5py

        with h5py.File(self.options["path"], "r") as f:
            wanted = wanted_columns(self.options)
            return [n for n, d in f.items() if (wanted is None or n in wanted) and isinstance(d, h5py.Dataset) and d.ndim == 1 and d.dtype.kind in "iuf"]

    def schema(self) -> str:
        return ", ".join(f"`{n}` double" for n in self._names())

    def reader(self, schema: StructType) -> DataSourceReader:
        return HdfReader(self.options["path"], schema.fieldNames(), int(self.options.get("rows", ROWS)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsSource)
    spark.dataSource.register(HdfSource)
