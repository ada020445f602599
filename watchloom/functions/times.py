"""Zone-less time literals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(moment: datetime | str) -> Column:
    """A zone-less literal that means the same in every session zone.

    ``F.lit(datetime)`` would be an instant, shifted by the session zone when cast.
    """
    text = moment if isinstance(moment, str) else moment.replace(tzinfo=None).isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")
