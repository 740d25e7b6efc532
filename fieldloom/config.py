"""Years, months and variable names; month specifications."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

# Years, months and the names that coordinates, masks and variables go by.
BASELINE_YEARS = (1961, 2015)
HOLDOUT_YEARS = (2016, 2025)
PREDICTOR_YEARS = (1985, 2025)
OUTPUT_MONTHS = (5, 6, 7, 8, 9)

TIME_NAMES = ("time", "date")
LAT_NAMES = ("lat", "latitude", "y")
LON_NAMES = ("lon", "longitude", "x")
MASK_NAMES = ("land_mask", "mask", "lsm", "land")
#: Names under which observed fields of a variable may come, in order of preference.
VARIABLE_NAMES = {
    "tmax": ("tmax", "Tmax", "tmx", "tasmax", "Band1"),
    "tmin": ("tmin", "Tmin", "tmn", "tasmin", "Band1"),
}


@dataclass(frozen=True)
class Resolution:
    """One refining step: names of its coarse and fine grid, and whether corrected fields are filled in the mask."""

    coarse: str
    fine: str
    fill_corrected: bool = False


STEPS = (Resolution("025", "005"), Resolution("005", "001", fill_corrected=True))


def parse_months(spec: str | Iterable[int] | None = None) -> list[int]:
    """Sorted distinct calendar months of '5,6,7'; the default months for an empty one."""
    if spec is None or (isinstance(spec, str) and not spec.strip()):
        return list(OUTPUT_MONTHS)
    parts = spec.split(",") if isinstance(spec, str) else list(spec)
    months = sorted({int(p) for p in parts if str(p).strip()})
    if not months:
        raise ValueError("at least one month is needed")
    if wrong := [m for m in months if not 1 <= m <= 12]:
        raise ValueError(f"not a calendar month: {wrong[0]}")
    return months


def months_in(available: Iterable[int], spec: str | Iterable[int] | None = None) -> list[int]:
    """Requested months that are available; an error if there are none."""
    wanted, there = parse_months(spec), {int(m) for m in available}
    if not (both := [m for m in wanted if m in there]):
        raise ValueError(f"none of the months {wanted} is among {sorted(there)}")
    return both
