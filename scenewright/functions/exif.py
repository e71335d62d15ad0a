"""Metadata of images as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def camera_key(make, model, width, height, projection, focal) -> Column:
    """One text for all images of a camera: version, make, model without the make, size, projection and focal."""
    rest = F.trim(F.replace(_c(model), _c(make), F.lit("")))
    return F.lower(F.concat_ws(" ", F.lit("v2"), F.trim(_c(make)), rest, _c(width), _c(height).cast("string"), _c(projection), F.substring(_c(focal), 1, 6)))


def focal_ratio(focal_35mm, focal_mm, sensor_mm) -> tuple[Column, Column]:
    """(35 mm equivalent, ratio): the 35 mm tag where positive, else focal over sensor width, else zeros."""
    tag, own = F.coalesce(_c(focal_35mm), F.lit(0.0)), F.try_divide(_c(focal_mm), F.nullif(_c(sensor_mm), F.lit(0.0)))
    ratio = F.when(tag > 0, tag / 36.0).otherwise(F.coalesce(own, F.lit(0.0)))
    return F.when(tag > 0, tag).otherwise(ratio * 36.0), ratio


def normalized(px, py, width, height) -> tuple[Column, Column]:
    """Pixel coordinates about the image centre over the larger side; pixel centres lie at one half."""
    size = F.greatest(_c(width), _c(height)).cast("double")
    return (_c(px) + 0.5 - _c(width) / 2.0) / size, (_c(py) + 0.5 - _c(height) / 2.0) / size


def denormalized(x, y, width, height) -> tuple[Column, Column]:
    size = F.greatest(_c(width), _c(height)).cast("double")
    return _c(x) * size - 0.5 + _c(width) / 2.0, _c(y) * size - 0.5 + _c(height) / 2.0


def upright(x, y, orientation) -> tuple[Column, Column]:
    """Normalised coordinates turned by the EXIF orientation (1, 3, 6, 8; others as 1)."""
    x, y, o = _c(x), _c(y), _c(orientation)
    return (
        F.when(o == 3, -x).when(o == 6, -y).when(o == 8, y).otherwise(x),
        F.when(o == 3, -y).when(o == 6, x).when(o == 8, -x).otherwise(y),
    )


def dms(value) -> tuple[Column, Column, Column]:
    """Whole degrees, whole minutes and seconds of the size of an angle."""
    v = F.abs(_c(value))
    d = F.floor(v)
    m = F.floor((v - d) * 60)
    return d, m, F.round(((v - d) * 60 - m) * 60, 6)


def dop_or_default(dop, default: float = 15.0) -> Column:
    """Zero and missing mean not reported."""
    return F.coalesce(F.nullif(_c(dop), F.lit(0.0)), F.lit(default))
