"""Report formats as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcloom.functions import languages as L

# Labels and bands of the reports.
STATUS_LABELS = {
    "completed": "✓ COMPLETADO", "failed": "✗ FALLIDO", "in_progress": "⟳ EN PROGRESO", "paused": "⏸ PAUSADO",
}
UNKNOWN_STATUS = "DESCONOCIDO"


def money(amount: Column) -> Column:
    """``S/. 1,234.50``."""
    return F.concat(F.lit("S/. "), F.format_number(F.round(amount, 2), 2))


def report_duration(seconds: Column) -> Column:
    whole = lambda x: F.floor(x).cast("long").cast("string")
    return (
        F.when(seconds < 60, F.concat(F.bround(seconds, 0).cast("long").cast("string"), F.lit(" segundos")))
        .when(seconds < 3600, F.concat(whole(seconds / 60), F.lit("m "), whole(seconds % 60), F.lit("s")))
        .otherwise(F.concat(whole(seconds / 3600), F.lit("h "), whole((seconds % 3600) / 60), F.lit("m")))
    )


def tile_duration(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(
        F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))
    )


def rate_band(rate: Column) -> Column:
    return F.when(rate >= 80, "success").when(rate >= 50, "warning").otherwise("danger")


def status_label(status: Column) -> Column:
    return F.coalesce(L.lookup(STATUS_LABELS, status), F.lit(UNKNOWN_STATUS))


def timestamp_second(iso: Column) -> Column:
    return F.left(iso, F.lit(19))


def timestamp_day(iso: Column) -> Column:
    return F.left(iso, F.lit(10))


def migration_sides(kind: Column) -> tuple[Column, Column]:
    """Source and target of ``a_to_b``: before the first, after the last ``_to_``."""
    parts = F.split(kind, "_to_", -1)
    return parts[0], F.element_at(parts, -1)
