"""Column expressions shared by the operators. All are built-in functions, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bounding box of the taxi grid and its spans in degrees: fixed values.
LAT_MIN, LAT_MAX, LAT_SPAN = 40.4774, 40.9176, 0.4402
LON_MIN, LON_MAX, LON_SPAN = -74.2591, -73.7004, 0.5587
GRID = 10
OUTSIDE = "CELL_OUT"


def bucket_start(column: str, width: int) -> Column:
    """Start of the ``width``-wide bucket that holds an integer column (floor, also below zero)."""
    return F.col(column) - F.pmod(F.col(column), F.lit(width).cast("long"))


def bucket(column: str, width: int) -> Column:
    """Ordinal of that bucket; integer arithmetic only, so exact for any epoch value."""
    return F.expr(f"(`{column}` - pmod(`{column}`, {int(width)}L)) div {int(width)}L")


def window_end(column: str, width: int) -> Column:
    """End of the tumbling window an event belongs to, in the unit of the column."""
    return bucket_start(column, width) + F.lit(width).cast("long")


def safe_divide(total: Column, count: Column) -> Column:
    return F.when(count > 0, total / count).otherwise(F.lit(0.0))


def null_safe_mean(column: str) -> Column:
    """Mean in which a missing reading adds nothing but still counts."""
    return safe_divide(F.sum(F.coalesce(F.col(column), F.lit(0.0))), F.count(F.lit(1)))


def clamp(value: Column, low: int | None, high: int | None) -> Column:
    if low is not None:
        value = F.greatest(value, F.lit(low).cast("long"))
    if high is not None:
        value = F.least(value, F.lit(high).cast("long"))
    return value


def zero_if_missing(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def one_if_missing(value: Column) -> Column:
    """Update counters: a missing or zero counter reads as one."""
    return F.when(value.isNull() | (value == 0), F.lit(1)).otherwise(value)


def geo_cell(lat: Column, lon: Column) -> Column:
    """Grid cell of a coordinate. Bounds are inclusive: a point on the far longitude gets index 10."""
    outside = (lat < LAT_MIN) | (lat > LAT_MAX) | (lon < LON_MIN) | (lon > LON_MAX)
    x = ((lon - LON_MIN) / LON_SPAN * GRID).cast("int")
    y = ((lat - LAT_MIN) / LAT_SPAN * GRID).cast("int")
    return F.when(outside, F.lit(OUTSIDE)).otherwise(F.format_string("CELL_%d_%d", x, y))


def zone_cell(zone: Column) -> tuple[Column, Column]:
    """(x, y) of a zone id, null when it is not of the form ``CELL_x_y``."""
    shape = r"^CELL_(\d+)_(\d+)$"
    x = F.expr("cast(null as int)")
    parsed = zone.rlike(shape)
    return (F.when(parsed, F.regexp_extract(zone, shape, 1).cast("int")).otherwise(x),
            F.when(parsed, F.regexp_extract(zone, shape, 2).cast("int")).otherwise(x))


def house_cell(house: Column) -> tuple[Column, Column]:
    """(row, column) of ``HOUSE_n`` on the 10-wide house grid, null when n does not parse."""
    shape = r"^HOUSE_(\d+)$"
    n = F.when(house.rlike(shape), F.regexp_extract(house, shape, 1).cast("int"))
    return F.floor(n / GRID).cast("int"), (n % GRID).cast("int")


def label_of(strategy: Column, labels: dict[str, str]) -> Column:
    """Display label of a strategy id; the id itself when it has none."""
    if not labels:
        return strategy
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(table, strategy), strategy)


def normalised_lateness(lateness: Column, slack: Column, cap: float = 2.0) -> Column:
    """Lateness as a share of the slack, capped; zero when there is no slack."""
    return F.least(F.lit(cap), F.when(slack > 0, lateness / slack).otherwise(F.lit(0.0)))
