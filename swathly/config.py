"""Settings as frozen records: read from a mapping, a JSON or an INI file, checked, written back."""

from __future__ import annotations

import configparser
import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Lens:
    """Intrinsics of a frame camera in pixels; a size of 0 is unknown."""

    fx: float
    fy: float
    cx: float
    cy: float
    k1: float = 0.0
    k2: float = 0.0
    k3: float = 0.0
    p1: float = 0.0
    p2: float = 0.0
    width: int = 0
    height: int = 0

    def __post_init__(self):
        if self.fx <= 0 or self.fy <= 0:
            raise ValueError("focal lengths have to be positive")

    def as_camera(self) -> dict:
        """As ``geometry.validate_control`` takes it."""
        return {"fx": self.fx, "fy": self.fy, "cx": self.cx, "cy": self.cy, "distortion": (self.k1, self.k2, self.k3, self.p1, self.p2), "width": self.width, "height": self.height}


@dataclass(frozen=True)
class Mounting:
    """Boresight in degrees, lever arm in metres (forward, right, down)."""

    roll: float = 0.0
    pitch: float = 0.0
    yaw: float = 0.0
    x: float = 0.0
    y: float = 0.0
    z: float = 0.0

    @property
    def boresight(self) -> tuple[float, float, float]:
        return self.roll, self.pitch, self.yaw

    @property
    def lever(self) -> tuple[float, float, float]:
        return self.x, self.y, self.z


@dataclass(frozen=True)
class Validation:
    """A control-point validation: files, formats, camera and threshold."""

    observations: str
    points: str
    trajectory: str
    lens: Lens
    timing: str | None = None
    mounting: Mounting = field(default_factory=Mounting)
    observation_format: str = "blocks"
    v_up: bool = True
    threshold: float = 3.0

    def __post_init__(self):
        if self.observation_format not in ("blocks", "csv"):
            raise ValueError(f"observation_format is blocks or csv, not {self.observation_format}")
        if self.threshold <= 0:
            raise ValueError("the threshold has to be positive")


@dataclass(frozen=True)
class Components:
    """A principal-component reduction."""

    variance: float = 0.99
    most: int | None = None
    output_type: str = "float32"
    interleave: str = "bil"
    chunk_lines: int = 4096
    nodata: float = 0.0

    def __post_init__(self):
        if not 0 < self.variance <= 1:
            raise ValueError(f"variance lies above 0 and is at most 1, not {self.variance}")
        if self.output_type not in ("float32", "float64"):
            raise ValueError(f"output_type is float32 or float64, not {self.output_type}")
        if self.interleave not in ("bil", "bsq", "bip"):
            raise ValueError(f"interleave is bil, bsq or bip, not {self.interleave}")
        if self.chunk_lines < 1:
            raise ValueError("chunk_lines is at least 1")


@dataclass(frozen=True)
class LineCamera:
    """The polynomial camera of a line of pixels."""

    f: float
    centre: float
    width: int
    across: tuple[float, ...] = (0.0,)
    along: tuple[float, ...] = (0.0,)
    first: int = 0

    def __post_init__(self):
        if self.f <= 0 or self.width < 2:
            raise ValueError("a line camera needs a positive focal length and two pixels or more")

    def as_camera(self):
        from .functions.camera import PolynomialCamera

        return PolynomialCamera(**dataclasses.asdict(self))


def build(kind, values: dict):
    """A record from a mapping; nested records from nested mappings. Unknown and missing names are errors."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - set(fields)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    nested = {"lens": Lens, "mounting": Mounting}
    own = {k: build(nested[k], v) if k in nested and isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for k, v in values.items()}
    missing = [n for n, f in fields.items() if n not in own and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return kind(**own)


def read(path: str, kind):
    """From a JSON file, or an INI file: its section ``main`` has plain values, other sections are nested records."""
    if path.endswith(".json"):
        return build(kind, json.loads(Path(path).read_text()))
    ini = configparser.ConfigParser()
    ini.read_string(Path(path).read_text())

    def value(text: str):
        try:
            return json.loads(text)
        except ValueError:
            return text

    parts = {s: {k: value(v) for k, v in ini[s].items()} for s in ini.sections()}
    return build(kind, parts.pop("main", {}) | parts)


def write(record, path: str) -> None:
    """As JSON, which ``read`` takes back."""
    Path(path).write_text(json.dumps(dataclasses.asdict(record), indent=1, sort_keys=True) + "\n")
