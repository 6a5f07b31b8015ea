"""Cells of a regular grid and the rings that draw them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Grid


def inside(lon: Column, lat: Column, g: Grid) -> Column:
    """Within the box, its edges included."""
    return (lon >= g.west) & (lon <= g.east) & (lat >= g.south) & (lat <= g.north)


def col_row(lon: Column, lat: Column, g: Grid) -> tuple[Column, Column]:
    col = F.least(F.floor((lon - g.west) / g.cell).cast("int"), F.lit(g.max_col))
    row = F.least(F.floor((lat - g.south) / g.cell).cast("int"), F.lit(g.max_row))
    return col, row


def cell_id(lon: Column, lat: Column, g: Grid) -> Column:
    """``r{row}_c{col}``; null outside."""
    col, row = col_row(lon, lat, g)
    return F.when(inside(lon, lat, g), F.concat(F.lit("r"), row.cast("string"), F.lit("_c"), col.cast("string")))


def ring(col: Column, row: Column, g: Grid) -> Column:
    """Closed outline of a cell, five corners."""
    w, s = F.round(g.west + col * g.cell, 6), F.round(g.south + row * g.cell, 6)
    e, n = F.round(g.west + (col + 1) * g.cell, 6), F.round(g.south + (row + 1) * g.cell, 6)
    return F.array(*[F.array(x, y) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])
