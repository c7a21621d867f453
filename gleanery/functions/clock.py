"""Clock columns of the jobs: what a row's time is when a pass runs at a local moment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BOOK_ZONE = "+08:00"


def book_time(local: Column | None = None) -> Column:
    """UTC+8, whatever the session's zone; ``local`` is a moment of the session, now by default."""
    local = F.localtimestamp() if local is None else local
    return F.convert_timezone(F.current_timezone(), F.lit(BOOK_ZONE), local.cast("timestamp_ntz")).cast("timestamp_ntz")


def series_time(local: Column | None = None) -> Column:
    return (F.localtimestamp() if local is None else local).cast("timestamp_ntz")
