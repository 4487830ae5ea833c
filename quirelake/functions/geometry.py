"""Coordinate expressions: file and screen space, rotation, scale.

File space has its origin bottom-left, screen space top-left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PAGE_HEIGHT = 792.0
MAX_IMAGE_SIDE = 1600
THUMBNAIL_SIDE = 160


def flip_y(y: Column, height: Column, page_height: Column) -> Column:
    """Screen y from file y, or file y from screen y: the map is its own inverse."""
    return page_height - y - height


def _box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def rotate_box(x, y, width, height, page_width, page_height, rotation) -> Column:
    """Where a box of the unrotated page appears on the rotated page."""
    return (
        F.when(rotation == 90, _box(page_height - (y + height), x, height, width))
        .when(rotation == 180, _box(page_width - (x + width), page_height - (y + height), width, height))
        .when(rotation == 270, _box(y, page_width - (x + width), height, width))
        .otherwise(_box(x, y, width, height))
    )


def unrotate_box(x, y, width, height, page_width, page_height, rotation) -> Column:
    """Inverse of :func:`rotate_box`."""
    return (
        F.when(rotation == 90, _box(y, page_height - (x + width), height, width))
        .when(rotation == 180, _box(page_width - (x + width), page_height - (y + height), width, height))
        .when(rotation == 270, _box(page_width - (y + height), x, height, width))
        .otherwise(_box(x, y, width, height))
    )


def norm_rotation(rotation: Column, delta: Column) -> Column:
    return F.pmod(rotation + delta, F.lit(360))


def fit_scale(width: Column, height: Column, max_side: float = MAX_IMAGE_SIDE) -> Column:
    """Factor that brings the longer side down to the limit; never above one."""
    return F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(width, height))


def thumbnail_scale(width: Column) -> Column:
    return F.least(F.lit(float(THUMBNAIL_SIDE)) / F.greatest(width, F.lit(1.0)), F.lit(5.0))
