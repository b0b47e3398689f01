"""Binary sources as Python data sources: navigation records, frame headers, image cubes.

Each splits a file into record-aligned byte ranges, reads only those, and yields Arrow
batches. Files must be reachable from the executors (a mounted file system); for object
stores read with ``binaryFile`` and use the ``decode_*`` functions in ``mapInArrow``.
"""

from __future__ import annotations

import glob
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

# The navigation record, 17 little-endian doubles.
NAV_FIELDS = (
    "time latitude longitude altitude x_velocity y_velocity z_velocity roll pitch platform_heading wander_angle "
    "x_body_accel y_body_accel z_body_accel x_body_ang_rate y_body_ang_rate z_body_ang_rate"
).split()
NAV_BYTES = 8 * len(NAV_FIELDS)
# A frame line of 1280 x 328 16-bit numbers and the places of its header fields.
LINE_BYTES, HEADER_BYTES = 1280 * 328 * 2, 2560
INTERNAL_AT, FLAG_AT, NAV_AT, GPS_AT, PPS_AT, TELEGRAM_AT, FLAG = 0, 80, 103, 116, 164, 168, 0xBABE
#: ENVI data type codes.
ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}


def _files(path: str) -> list[str]:
    """A file, a pattern, or all files below a folder."""
    if os.path.isdir(path):
        return sorted(str(p) for p in Path(path).rglob("*") if p.is_file())
    return sorted(glob.glob(path, recursive=True)) or [path]


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


def decode_nav(raw: bytes) -> np.ndarray:
    if len(raw) % NAV_BYTES:
        raise ValueError(f"{len(raw)} bytes are no whole number of {NAV_BYTES}-byte records")
    return np.frombuffer(raw, "<f8").reshape(-1, len(NAV_FIELDS))


class NavSource(DataSource):
    """spark.read.format('nav').load(path). Options: every (n-th record), units (rad or deg), heading (plus, minus, raw), records (per partition)."""

    @classmethod
    def name(cls):
        return "nav"

    def schema(self):
        return ", ".join(f"{f} double" for f in NAV_FIELDS) + ", true_heading double, file string"

    def reader(self, schema):
        return _NavReader(self.options)


class _NavReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.every = options["path"], int(options.get("every", 1))
        self.units, self.heading, self.records = options.get("units", "rad"), options.get("heading", "plus"), int(options.get("records", 200_000))
        self.low, self.high = -np.inf, np.inf

    def pushFilters(self, filters):
        """Bounds on time are found by binary search in the file; all filters are still applied above."""
        for f in filters:
            if getattr(f, "attribute", None) == ("time",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, float(f.value))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, float(f.value))
            yield f

    def partitions(self):
        out = []
        for path in _files(self.path):
            size = os.path.getsize(path)
            if size % NAV_BYTES:
                raise ValueError(f"{path}: {size} bytes are no whole number of {NAV_BYTES}-byte records")
            a, b = 0, size // NAV_BYTES
            if np.isfinite(self.low) or np.isfinite(self.high):
                times = np.memmap(path, "<f8", "r").reshape(-1, len(NAV_FIELDS))[:, 0] if b else np.zeros(0)
                if len(times) and self._sorted(times):
                    a, b = int(np.searchsorted(times, self.low, "left")), int(np.searchsorted(times, self.high, "right"))
            out += [_Range(path, k, min(b, k + self.records)) for k in range(a, b, self.records)]
        return out or [_Range("", 0, 0)]

    @staticmethod
    def _sorted(times) -> bool:
        """Probes only: the ends and a few places between must rise."""
        at = np.unique(np.linspace(0, len(times) - 1, 64).astype(np.int64))
        return bool(np.all(np.diff(times[at]) >= 0))

    def read(self, partition):
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            f.seek(partition.first * NAV_BYTES)
            x = decode_nav(f.read((partition.last - partition.first) * NAV_BYTES)).copy()
        if self.every > 1:  # counted from 1 over the whole file
            x = x[(np.arange(partition.first, partition.last) + 1) % self.every == 0]
        h = x[:, 9]
        heading = np.mod(h + x[:, 10], 2 * np.pi) if self.heading == "plus" else h - x[:, 10] if self.heading == "minus" else h
        if self.units == "deg":
            x[:, [1, 2, 7, 8, 9, 10]] = np.degrees(x[:, [1, 2, 7, 8, 9, 10]])
            heading = np.degrees(heading)
        yield pa.RecordBatch.from_arrays([*[pa.array(x[:, k]) for k in range(x.shape[1])], pa.array(heading), pa.array([partition.path] * len(x))], names=[*NAV_FIELDS, "true_heading", "file"])


def decode_headers(raw: np.ndarray) -> dict[str, np.ndarray]:
    """Fields of line headers (n, bytes): the counters of pulse and telegram are big-endian by words, little-endian within them."""
    u = lambda at, kind: raw[:, at : at + np.dtype(kind).itemsize].copy().view(kind)[:, 0].astype(np.int64)

    def words(at):
        w = raw[:, at : at + 4].copy().view("<u2").astype(np.int64)
        return w[:, 0] << 16 | w[:, 1]

    return {"internal_time": u(INTERNAL_AT, "<u4"), "flagged": u(FLAG_AT, "<u2") == FLAG, "gps_pps": u(GPS_AT, ">u4"), "internal_pps": words(PPS_AT), "nav_time": u(NAV_AT, ">u4"), "telegram_time": words(TELEGRAM_AT)}


FRAME_FIELDS = ("internal_time", "flagged", "gps_pps", "internal_pps", "nav_time", "telegram_time")


class FrameSource(DataSource):
    """spark.read.format('frames').load(path): one row per line; only header bytes are read."""

    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        return "file string, line_id long, internal_time long, flagged boolean, gps_pps long, internal_pps long, nav_time long, telegram_time long"

    def reader(self, schema):
        return _FrameReader(self.options)


class _FrameReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.line, self.lines = options["path"], int(options.get("line_bytes", LINE_BYTES)), int(options.get("lines", 2000))

    def partitions(self):
        out = []
        for path in _files(self.path):
            size = os.path.getsize(path)
            if size % self.line:
                raise ValueError(f"{path}: {size} bytes are no whole number of {self.line}-byte lines")
            n = size // self.line
            out += [_Range(path, k, min(n, k + self.lines)) for k in range(0, n, self.lines)]
        return out or [_Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        head = min(HEADER_BYTES, self.line)
        raw = np.zeros((partition.last - partition.first, head), np.uint8)
        with open(partition.path, "rb") as f:
            for k in range(len(raw)):
                f.seek((partition.first + k) * self.line)
                raw[k] = np.frombuffer(f.read(head), np.uint8)
        d = decode_headers(raw)
        n = np.arange(partition.first, partition.last)
        yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(n)), pa.array(n), *[pa.array(d[k]) for k in FRAME_FIELDS]], names=["file", "line_id", *FRAME_FIELDS])


def envi_header(path: str) -> dict:
    """Keys of a header file, numbers converted, lists split."""
    text = Path(path).read_text()
    out, key, held = {}, None, ""
    for line in text.splitlines()[1:]:
        if key is None:
            if "=" not in line:
                continue
            key, _, held = line.partition("=")
            key = key.strip().lower()
        else:
            held += " " + line
        if "{" in held and "}" not in held:
            continue
        v = held.strip()
        if v.startswith("{"):
            items = [x.strip() for x in v.strip("{} ").split(",") if x.strip()]
            out[key] = [float(x) if x.replace(".", "", 1).replace("-", "", 1).replace("e", "", 1).replace("+", "", 1).isdigit() else x for x in items]
        else:
            out[key] = int(v) if v.lstrip("-").isdigit() else v
        key = None
    return out


def write_envi_header(path: str, lines: int, samples: int, bands: int, data_type: int, interleave: str = "bil", **more) -> None:
    """Lists go in braces; default bands count from 1."""
    show = lambda v: "{" + ", ".join(str(x) for x in v) + "}" if isinstance(v, (list, tuple)) else str(v)
    rows = {"samples": samples, "lines": lines, "bands": bands, "header offset": 0, "file type": "ENVI Standard", "data type": data_type, "interleave": interleave, "byte order": 0} | {k.replace("_", " "): v for k, v in more.items()}
    Path(path).write_text("ENVI\n" + "".join(f"{k} = {show(v)}\n" for k, v in rows.items()))


def raw_header(path: str, samples: int, bands: int, data_type: int = 12) -> dict:
    """Stands for the header of a headerless file of frames (line, sample, band); a partial last line is left out."""
    size = samples * bands * np.dtype(ENVI_TYPES[data_type]).itemsize
    return {"lines": os.path.getsize(path) // size, "samples": samples, "bands": bands, "data type": data_type, "interleave": "bip"}


class CubeSource(DataSource):
    """spark.read.format('cube').option('header', path).load(path): line, sample, spectrum; option bands picks some (from 0), as pruning.

    Without a header, options raw_samples and raw_bands describe a file of raw frames. Option
    flip is combined with every whole number by exclusive or (0x8000 makes signed from unsigned).
    """

    @classmethod
    def name(cls):
        return "cube"

    def schema(self):
        return "line int, sample int, spectrum array<double>"

    def reader(self, schema):
        return _CubeReader(self.options)


class _CubeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        raw = options.get("raw_samples")
        self.head = raw_header(self.path, int(raw), int(options["raw_bands"])) if raw else envi_header(options.get("header", self.path + ".hdr"))
        self.flip = int(options.get("flip", "0"), 0)
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.lines = int(options.get("lines", 256))

    def partitions(self):
        n = self.head["lines"]
        return [_Range(self.path, k, min(n, k + self.lines)) for k in range(0, n, self.lines)]

    def read(self, partition):
        h = self.head
        lines, samples, bands = h["lines"], h["samples"], h["bands"]
        kind = np.dtype(ENVI_TYPES[h["data type"]]).newbyteorder(">" if h.get("byte order") else "<")
        mode = h.get("interleave", "bil").lower()
        shape = {"bil": (lines, bands, samples), "bip": (lines, samples, bands), "bsq": (bands, lines, samples)}[mode]
        cube = np.memmap(partition.path, kind, "r", offset=h.get("header offset", 0), shape=shape)
        for line in range(partition.first, partition.last):
            x = {"bil": lambda: cube[line].T, "bip": lambda: cube[line], "bsq": lambda: cube[:, line].T}[mode]()
            x = x if self.bands is None else x[:, self.bands]
            x = np.ascontiguousarray(x ^ x.dtype.type(self.flip) if self.flip else x, np.float64)
            at = pa.array(np.arange(samples + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(samples, line, np.int32)), pa.array(np.arange(samples, dtype=np.int32)), pa.ListArray.from_arrays(at, pa.array(x.reshape(-1)))], names=["line", "sample", "spectrum"])


def raw_to_bil(spark, source: str, target: str, samples: int, bands: int, flip: int = 0x8000) -> int:
    """Raw 16-bit frames (line, sample, band) to a BIL cube of part files and a header, values XOR ``flip``; lines written. Each task reads and writes its own lines."""
    lines = raw_header(source, samples, bands)["lines"]
    cube = spark.read.format("cube").options(raw_samples=samples, raw_bands=bands, flip=flip).load(source)
    write_cube(cube, target, lines, samples, bands, 12)
    return lines


def reinterleave(spark, source: str, target: str, per_file: int = 512) -> None:
    """A cube of any interleave (its header beside it) as BIL."""
    h = envi_header(source + ".hdr")
    write_cube(spark.read.format("cube").load(source), target, h["lines"], h["samples"], h["bands"], h["data type"], per_file)


def register(spark) -> None:
    """Make the sources known to a session, and let filters reach them, which the navigation reader needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in (NavSource, FrameSource, CubeSource):
        spark.dataSource.register(s)


def write_cube(cube, path: str, lines: int, samples: int, bands: int, data_type: int = 4, per_file: int = 512) -> None:
    """A cube (line, sample, spectrum) as BIL: one part file per range of lines, written by the tasks, and one header.

    The parts in name order are the cube; the folder has to be visible to all executors.
    """
    from pyspark.sql import functions as F

    kind = "<" + ENVI_TYPES[data_type]
    os.makedirs(path, exist_ok=True)

    def work(batches):
        held: dict[int, dict[int, np.ndarray]] = {}
        for b in batches:
            for line, sample, s in zip(b.column("line").to_pylist(), b.column("sample").to_pylist(), b.column("spectrum").to_pylist(), strict=True):
                part = held.setdefault(line // per_file, {})
                part.setdefault(line, np.zeros((bands, samples), kind))[:, sample] = s
        for part, rows in held.items():
            last = min((part + 1) * per_file, lines)
            target = f"{path}/part-{part:08d}.bil"
            with open(target + ".tmp", "wb") as f:
                for line in range(part * per_file, last):
                    f.write(rows.get(line, np.zeros((bands, samples), kind)).tobytes())
            os.replace(target + ".tmp", target)  # a task that runs again writes the same file
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(rows)], pa.int64())], names=["part", "lines"])

    dealt = cube.withColumn("part", (F.col("line") / per_file).cast("int")).repartition("part").select("line", "sample", "spectrum")
    dealt.mapInArrow(work, "part long, lines long").write.format("noop").mode("overwrite").save()
    write_envi_header(f"{path}/cube.hdr", lines, samples, bands, data_type)


def write_rgb(cube, wavelengths: list[float], path: str, lines: int, samples: int, targets=(650.0, 550.0, 450.0)) -> list[int]:
    """Three bands next to the targets as an 8-bit BIL cube, each stretched between its 2nd and 98th percentile, with their wavelengths in the header; which bands they are."""
    from pyspark.sql import functions as F

    from ..operators.stats import percentiles

    bands = [min(range(len(wavelengths)), key=lambda b: abs(wavelengths[b] - t)) for t in targets]
    own = cube.select("line", "sample", *[F.get("spectrum", F.lit(b)).cast("double").alias(f"c{k}") for k, b in enumerate(bands)])
    out = []
    for k in range(len(bands)):
        low, high = percentiles(own, f"c{k}", (0.02, 0.98)).first()
        share = (F.col(f"c{k}") - low) / (high - low) if low is not None and high > low else F.lit(0.0)
        out.append(F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 255))
    write_cube(own.select("line", "sample", F.array(*out).alias("spectrum")), path, lines, samples, len(bands), 1)
    write_envi_header(f"{path}/cube.hdr", lines, samples, len(bands), 1, wavelength=[wavelengths[b] for b in bands], default_bands=list(range(1, len(bands) + 1)))
    return bands


def write_tiles(grid, path: str) -> None:
    """Output cells as Parquet, one folder per tile, so that a reader prunes by tile."""
    grid.repartition("tile_row", "tile_col").write.partitionBy("tile_row", "tile_col").parquet(path)
