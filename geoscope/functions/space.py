"""The space-order key of a coordinate, and the runs of keys that boxes touch.

The globe is laid out in cells of 1/64 degree; a cell's key interleaves the bits of its row and column
(Z-order), so cells near each other mostly have keys near each other, and a square degree is one run
of 4,096 keys. Coordinates off the globe count to the outermost cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The column that stores keep the key in.
PLACE = "place"
PER_DEGREE = 64
#: Runs are joined across their smallest gaps until so many are left, as each becomes a filter.
MOST_RUNS = 32


def _spread_bits(value: Column) -> Column:
    """Bit i of a number below 2**16 goes to bit 2i."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return value


def place_of(lat: str = "reclat", lon: str = "reclong") -> Column:
    """The key of a coordinate; null where the coordinate is."""

    def at(name: str, limit: int) -> Column:
        return F.greatest(F.least(F.floor((F.col(name) + limit) * PER_DEGREE), F.lit(2 * limit * PER_DEGREE)), F.lit(0).cast("long"))

    known = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return F.when(known, F.shiftleft(_spread_bits(at(lat, 90)), 1).bitwiseOR(_spread_bits(at(lon, 180))))


def _interleaved(y: int, x: int) -> int:
    out = 0
    for bit in range(16):
        out |= (x >> bit & 1) << 2 * bit | (y >> bit & 1) << 2 * bit + 1
    return out


def place_runs(boxes: list[tuple[float, float, float, float]], most: int = MOST_RUNS) -> list[tuple[int, int]]:
    """Runs of keys, first and last, that hold every coordinate in the boxes (south, north, west, east)."""

    def degrees(low: float, high: float, limit: int) -> range:
        clamp = lambda v: min(max(math.floor(v + limit), 0), 2 * limit)
        return range(clamp(low), clamp(high) + 1)

    keys = set()
    for south, north, west, east in boxes:
        keys.update((y, x) for y in degrees(south, north, 90) for x in degrees(west, east, 180))
    size = PER_DEGREE * PER_DEGREE
    runs: list[list[int]] = []
    for first in sorted(_interleaved(y * PER_DEGREE, x * PER_DEGREE) for y, x in keys):
        if runs and runs[-1][1] + 1 == first:
            runs[-1][1] = first + size - 1
        else:
            runs.append([first, first + size - 1])
    gaps = sorted(range(1, len(runs)), key=lambda i: runs[i - 1][1] - runs[i][0])  # widest first
    starts = [0, *sorted(gaps[: most - 1]), len(runs)]
    return [(runs[a][0], runs[b - 1][1]) for a, b in zip(starts, starts[1:]) if a < b]
