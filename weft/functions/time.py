"""Display time (``%Y-%m-%d %H:%M`` in the session time zone, or ``never``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import col_

DISPLAY_FORMAT = "yyyy-MM-dd HH:mm"


def display_time(epoch_seconds) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm`` in the session time zone;
    ``never`` when null or 0."""
    x = col_(epoch_seconds).cast("double")
    ts = F.timestamp_micros((F.nullif(x, F.lit(0.0)) * 1_000_000).cast("long"))
    return F.coalesce(F.date_format(ts, DISPLAY_FORMAT), F.lit("never"))
