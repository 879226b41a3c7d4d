"""Placement on a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _third(centre: Column, size: Column, low: str, high: str) -> Column:
    share = centre / size
    return F.when(share < F.lit(1.0 / 3.0), low).when(share > F.lit(2.0 / 3.0), high).otherwise("centre")


def position_bucket(x: Column, y: Column, w: Column, h: Column, pw: Column, ph: Column) -> Column:
    """Cell of a 3x3 grid that holds the centre of a box, in words."""
    unknown = (
        F.coalesce(pw <= 0, F.lit(True)) | F.coalesce(ph <= 0, F.lit(True)) | x.isNull() | y.isNull()
    )
    across = _third(x + F.coalesce(w, F.lit(0.0)) / 2, pw, "left", "right")
    down = _third(y + F.coalesce(h, F.lit(0.0)) / 2, ph, "upper", "lower")
    words = F.when((down == "centre") & (across == "centre"), F.lit("centre")).otherwise(
        F.concat_ws("-", down, across)
    )
    label = F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)), F.lit(" of page"))
    return F.when(unknown, "Position unavailable").otherwise(label)
