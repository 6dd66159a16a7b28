"""Regular grids over longitude and latitude, Z-order keys and Web Mercator tiles.

Like the geometry functions these take and return SQL expression text.
"""

from __future__ import annotations

import math

from mapshelf.functions.geometry import MAP_BOX, num

# Depth of the finest grid; every coarser grid is a right shift of its integers.
FINEST = 24


def _cell(value: str, low: float, span: float, bits: int) -> str:
    n = 1 << bits
    return f"int(greatest(0, least({n - 1}, floor(({value} + {num(-low)}) / {num(span / n)}))))"


def world_column(x: str, bits: int = FINEST) -> str:
    """Column of a 2^bits wide grid over -180..180; values outside go to the edge columns."""
    return _cell(x, -180.0, 360.0, bits)


def world_row(y: str, bits: int = FINEST) -> str:
    """Row of a 2^bits high grid over -90..90, counted from the south."""
    return _cell(y, -90.0, 180.0, bits)


def cell_key(column: str, row: str, bits: int) -> str:
    return f"(shiftleft(bigint({column}), {bits}) | bigint({row}))"


def interleave(column: str, row: str, bits: int) -> str:
    """Z-order key: bit i of the column goes to bit 2i, bit i of the row to bit 2i + 1."""
    if bits > 31:
        raise ValueError("at most 31 bits per axis")

    def spread(v: str, gap: int) -> str:
        return " | ".join(f"shiftleft(bigint({v}) & {1 << i}L, {i + gap})" for i in range(bits))
    return f"({spread(column, 0)} | {spread(row, 1)})"


def mercator_x(lon: str) -> str:
    """Position in the unit square, 0 at longitude -180."""
    return f"(({lon} + 180.0D) / 360.0D)"


def mercator_y(lat: str) -> str:
    """Position in the unit square, 0 at the northern edge of the map."""
    phi = f"greatest({num(MAP_BOX[1])}, least({num(MAP_BOX[3])}, {lat})) * {num(math.pi / 180.0)}"
    return f"((1.0D - ln(tan({phi}) + 1.0D / cos({phi})) / {num(math.pi)}) / 2.0D)"


def tile_index(unit: str, level) -> str:
    """Tile column or row of a unit-square position; the far edge belongs to the last tile."""
    n = f"shiftleft(1L, {level})" if isinstance(level, str) else f"{1 << level}L"
    return f"greatest(0L, least({n} - 1L, bigint(floor({unit} * {n}))))"
