"""The detector dimension: read from TOML, kept as a small table, written back."""

from __future__ import annotations

import math
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamloom.functions import coords, units


@dataclass
class Detector:
    name: str
    kind: str = ""
    role: str = "none"
    layout: str = "orthogonal"
    position: tuple = (0.0, 0.0, 0.0)
    orientation: tuple = (0.0, 0.0, 0.0)
    n_cols: int = 0
    n_rows: int = 0
    pitch_x: float = 0.0
    pitch_y: float = 0.0
    gap_x: float = 0.0
    gap_y: float = 0.0
    res_x: float = 0.0
    res_y: float = 0.0
    source: str = ""
    channels: tuple = ()
    mask_file: str = ""
    roi: tuple = ()
    dies: dict = field(default_factory=dict)

    def rotation(self) -> list[list[float]]:
        """Rz * Ry * Rx."""
        (a, b, c) = self.orientation
        (ca, sa), (cb, sb), (cc, sc) = ((math.cos(t), math.sin(t)) for t in (a, b, c))
        return [[cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa], [sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa], [-sb, cb * sa, cb * ca]]

    def effective_pitch(self) -> tuple[float, float]:
        """By the layout's rule."""
        return self.rules().pitch(self)

    def rules(self) -> Layout:
        """What the detector's layout decides; the generic rules where the layout is not known."""
        return LAYOUTS.get(self.layout, LAYOUTS[""])

    def die_pixels(self) -> dict[str, list]:
        """The pixels (column, row) of each die: of the dies file in its order or, without one, of the layout's rule."""
        return self.dies or self.rules().dies(self)

    def is_pixel(self) -> bool:
        return self.n_cols > 0 and self.n_rows > 0

    def die_labels(self) -> list[str]:
        return list(self.die_pixels())

    def has_die_split(self) -> bool:
        return bool(self.die_labels())

    def unknown_layout(self) -> bool:
        """A layout is named that no rule is registered for; the generic one takes its place."""
        return bool(self.layout) and self.layout not in LAYOUTS

    def size(self) -> tuple[float, float]:
        px, py = self.effective_pitch()
        return (self.n_cols - 1) * px + self.pitch_x, (self.n_rows - 1) * py + self.pitch_y

    def row(self) -> dict:
        r, (px, py), (sx, sy) = self.rotation(), self.effective_pitch(), self.size()
        out = {"detector": self.name, "kind": self.kind, "role": self.role, "n_cols": self.n_cols, "n_rows": self.n_rows, "pitch_x": px, "pitch_y": py, "size_x": sx, "size_y": sy, "res_x": self.res_x, "res_y": self.res_y}
        out |= {f"p{a}": float(v) for a, v in zip("xyz", self.position, strict=True)}
        out |= {f"r{i}{j}": r[i][j] for i in range(3) for j in range(3)}
        return out | {"tilt": math.sqrt(sum(t * t for t in self.orientation)), "has_dies": self.has_die_split(), "is_pixel": self.is_pixel()}


def _shared_gap(d: Detector) -> tuple[float, float]:
    """The gap is shared out over the steps between pixels."""
    steps = (max(d.n_cols - 1, 0), max(d.n_rows - 1, 0))
    return tuple(p + (g / k if k else 0.0) for p, g, k in zip((d.pitch_x, d.pitch_y), (d.gap_x, d.gap_y), steps, strict=True))


@dataclass(frozen=True)
class Layout:
    """What a board's layout decides: the step between pixels, dies of its own (pixels by label), and by which of the ways in
    `operators.align.CENTRES` a profile of track positions gives its place."""

    pitch: Callable[[Detector], tuple[float, float]] = _shared_gap
    dies: Callable[[Detector], dict[str, list]] = lambda d: {}
    centre: str = "plateau"


#: Layouts by the name in a geometry file; the empty name is the generic one.
LAYOUTS = {"": Layout(), "orthogonal": Layout(), "OrthogonalLayout": Layout()}


def register(name: str, layout: Layout) -> None:
    """Makes a layout known under the name that geometry files give."""
    LAYOUTS[name] = layout


def bound(detectors: list[Detector], name: str = "", kind: str = "") -> list[Detector]:
    """The detector of a name or, without one, all of a type; neither is an error, as is a name that does not occur."""
    if name:
        found = [d for d in detectors if d.name == name]
        if not found:
            raise KeyError(f"no detector {name}")
        return found
    if not kind:
        raise ValueError("a name or a type is needed")
    return [d for d in detectors if d.kind == kind]


def with_die(df: DataFrame, dies: DataFrame, col: str = "col", row: str = "row", out: str = "die") -> DataFrame:
    """df (detector and a position in pixels) with the die of the nearest pixel, halves up; "" outside of all dies. Where dies share a
    pixel, the first in the detector's file is taken."""
    first = dies.groupBy("detector", F.col("col").alias("__c"), F.col("row").alias("__r")).agg(F.min_by("die", "place").alias("__die"))
    at = df.withColumns({"__c": coords.nearest_index(F.col(col)), "__r": coords.nearest_index(F.col(row))})
    return at.join(first, ["detector", "__c", "__r"], "left").withColumn(out, F.coalesce("__die", F.lit(""))).drop("__c", "__r", "__die")


def table(spark: SparkSession, detectors: list[Detector]) -> DataFrame:
    """One row a detector, with rotation, effective pitch and size worked out."""
    rows = [d.row() for d in detectors]
    kinds = {str: "string", int: "int", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in rows[0].items())
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def die_table(spark: SparkSession, detectors: list[Detector]) -> DataFrame:
    """detector, die, place (the die's in the order of the file), col, row."""
    rows = [(d.name, die, k, int(c), int(r)) for d in detectors for k, (die, pixels) in enumerate(d.die_pixels().items()) for c, r in pixels]
    return spark.createDataFrame(rows, "detector string, die string, place int, col int, row int")


def _list(v, convert) -> tuple:
    return tuple(convert(x) for x in (v if isinstance(v, list) else [v]))


def read(path: str) -> list[Detector]:
    """Detectors in the order of the file; lengths and angles may carry units; dies may stand in a file of their own."""
    text = Path(path).read_text()
    raw = tomllib.loads(text)
    general = raw.pop("General", {})
    dies = tomllib.loads((Path(path).parent / general["dies_file"]).read_text()) if "dies_file" in general else {}
    out = []
    for name, t in raw.items():
        pitch, n = _list(t.get("pixel_pitch", [0.0, 0.0]), units.parse), _list(t.get("number_of_pixels", [0, 0]), int)
        res = _list(t.get("spatial_resolution", [p / math.sqrt(12) for p in pitch]), units.parse)
        d = Detector(
            name, t.get("type", ""), t.get("role", "none"), t.get("layout", "orthogonal"), _list(t.get("position", [0, 0, 0]), units.parse), _list(t.get("orientation", [0, 0, 0]), units.parse),
            n[0], n[1], pitch[0], pitch[1], units.parse(t.get("pitch_x_gap", 0.0)), units.parse(t.get("pitch_y_gap", 0.0)), res[0], res[1], t.get("source_sensor", name), _list(t.get("source_channels", []), int), t.get("mask_file", ""), tuple(map(tuple, t.get("roi", []))),
        )
        for die in dies.get(name, {}).get("dies", []) + t.get("dies", []):
            d.dies[die["name"]] = [tuple(p) for p in die["pixels"]]
        out.append(d)
    return out


def write(path: str, source: str, detectors: list[Detector]) -> None:
    """The source file with new positions and orientations in fitting units, all other lines and their order as they were."""
    by_name, now, out = {d.name: d for d in detectors}, None, []
    for line in Path(source).read_text().splitlines():
        head = line.strip()
        if head.startswith("[") and not head.startswith("[["):
            now = by_name.get(head.strip("[]").strip('"'))
        key = head.split("=")[0].strip()
        if now and key == "position":
            line = "position = [" + ", ".join(f'"{units.display(v, "length", 12)}"' for v in now.position) + "]"
        elif now and key == "orientation":
            line = "orientation = [" + ", ".join(f'"{units.display(v, "angle", 12)}"' for v in now.orientation) + "]"
        out.append(line)
    Path(path).write_text("\n".join(out) + "\n")
