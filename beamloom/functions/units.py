"""Units: base units are mm, ns and rad."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the unit system.
UNITS = {"nm": 1e-6, "um": 1e-3, "mm": 1.0, "cm": 10.0, "m": 1000.0, "ps": 1e-3, "ns": 1.0, "us": 1e3, "ms": 1e6, "s": 1e9, "deg": 0.017453292519943295, "rad": 1.0, "mrad": 1e-3}
_FAMILIES = {"length": ("nm", "um", "mm", "cm", "m"), "time": ("ps", "ns", "us", "ms", "s"), "angle": ("deg", "rad", "mrad")}


def parse(value: str | float) -> float:
    """A number, or a number with a unit, in base units; 0.0 for an unknown unit or no number."""
    if not isinstance(value, str):
        return float(value)
    text = value.strip()
    number = text.rstrip(string.ascii_letters)
    unit = text[len(number) :]
    try:
        return float(number) * (UNITS.get(unit, 0.0) if unit else 1.0)
    except ValueError:
        return 0.0


def display(value: float, family: str, digits: int = 6) -> str:
    """The value in the largest unit of a family that keeps it at one or above, else in the smallest."""
    names = sorted(_FAMILIES[family], key=UNITS.get) if family != "angle" else ["mrad", "deg", "rad"]
    fit = [n for n in names if abs(value) >= UNITS[n]]
    unit = fit[-1] if fit else names[0]
    return f"{value / UNITS[unit]:.{digits}g}{unit}"


def count(value: int) -> str:
    """A count in thousands with one digit, or in millions with two."""
    for size, digits, sign in ((1_000_000, 2, "M"), (1_000, 1, "k")):
        if value >= size:
            return f"{value / size:.{digits}f}{sign}"
    return str(value)


def cfd_folder(fraction: float) -> str:
    return f"cfd_{fraction:.2f}"


def padded(number: int, width: int) -> str:
    return f"{number:0{width}d}"


def listed(text: str) -> list[str]:
    """The parts of a comma-separated list; empty ones are left out."""
    return [p.strip() for p in text.split(",") if p.strip()]


def unit_to_base(c: Column) -> Column:
    """The same for a column of strings."""
    text = F.trim(c)
    unit = F.regexp_extract(text, "[A-Za-z]*$", 0)
    number = F.trim(F.substring(text, F.lit(1), F.length(text) - F.length(unit)))
    factor = F.when(unit == "", F.lit(1.0))
    for name, size in UNITS.items():
        factor = factor.when(unit == name, F.lit(size))
    return F.coalesce(number.try_cast("double"), F.lit(0.0)) * factor.otherwise(0.0)
