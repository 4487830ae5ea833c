"""Colour expressions: hex notation, CMYK, stamp colours and pixel filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stamp label to red, green, blue.
STAMP_COLORS = {
    "APPROVED": (0.0, 0.5, 0.0),
    "REJECTED": (0.8, 0.0, 0.0),
    "CONFIDENTIAL": (0.6, 0.0, 0.6),
    "DRAFT": (0.8, 0.4, 0.0),
}
STAMP_DEFAULT = (0.0, 0.0, 0.8)

# Thresholds and weights of the pixel filters.
ECO_LIMIT = 200
BLACK_WHITE_LIMIT = 128
LIGHTEN_STEP = 20
SHADOW_LIMIT = 230
SEPIA = {
    "r": (0.393, 0.769, 0.189),
    "g": (0.349, 0.686, 0.168),
    "b": (0.272, 0.534, 0.131),
}
LUMA = (299, 587, 114)


def _rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def parse_color(text: Column) -> Column:
    """``#RGB``, ``#RGBA``, ``#RRGGBB`` or ``#RRGGBBAA`` to r, g, b in 0..1.

    The ``#`` is optional. Anything else, names included, is NULL.
    """
    digits = F.regexp_extract(F.trim(text), r"^#?([0-9A-Fa-f]{8}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{3,4})$", 1)
    short = F.length(digits) <= 4

    def channel(i: int) -> Column:
        one = F.substring(digits, i + 1, 1)
        two = F.substring(digits, 2 * i + 1, 2)
        return F.conv(F.when(short, F.concat(one, one)).otherwise(two), 16, 10).cast("double") / 255

    return F.when(digits != "", _rgb(channel(0), channel(1), channel(2)))


def color_or(text: Column, default: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Column:
    return F.coalesce(parse_color(text), _rgb(*[F.lit(float(v)) for v in default]))


def format_color(r: Column, g: Column, b: Column, mode: str = "floor") -> Column:
    """``#RRGGBB`` from channels in 0..1, truncating or rounding."""

    def byte(v: Column) -> Column:
        scaled = v * 255
        whole = F.floor(scaled) if mode == "floor" else F.floor(scaled + 0.5)
        return F.greatest(F.least(whole, F.lit(255)), F.lit(0)).cast("int")

    return F.format_string("#%02X%02X%02X", byte(r), byte(g), byte(b))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return _rgb((1 - c) * (1 - k), (1 - m) * (1 - k), (1 - y) * (1 - k))


def rgb_to_cmyk(r: Column, g: Column, b: Column) -> Column:
    """Full black generation: ``k = 1 - max(r, g, b)``."""
    top = F.greatest(r, g, b)
    k = 1 - top

    def ink(v: Column) -> Column:
        return F.when(top <= 0, F.lit(0.0)).otherwise((top - v) / F.when(top <= 0, F.lit(1.0)).otherwise(top))

    return F.struct(ink(r).alias("c"), ink(g).alias("m"), ink(b).alias("y"), k.alias("k"))


def stamp_color(label: Column) -> Column:
    """The fixed colour of a stamp label."""
    out = None
    for name, rgb in STAMP_COLORS.items():
        value = _rgb(*[F.lit(v) for v in rgb])
        out = F.when(label == name, value) if out is None else out.when(label == name, value)
    return out.otherwise(_rgb(*[F.lit(v) for v in STAMP_DEFAULT]))


def apply_filter(name: str, r: Column, g: Column, b: Column) -> Column:
    """A pixel filter over integer channels 0..255, as a struct r, g, b."""
    mean = F.floor((r + g + b) / 3)
    white = _rgb(F.lit(255), F.lit(255), F.lit(255))
    same = _rgb(r.cast("int"), g.cast("int"), b.cast("int"))
    if name == "inverted":
        return _rgb((255 - r).cast("int"), (255 - g).cast("int"), (255 - b).cast("int"))
    if name == "eco":
        return F.when(mean > ECO_LIMIT, white).otherwise(same)
    if name == "black_white":
        return F.when(mean > BLACK_WHITE_LIMIT, white).otherwise(_rgb(F.lit(0), F.lit(0), F.lit(0)))
    if name == "lighten":
        return _rgb(*[F.least(v + LIGHTEN_STEP, F.lit(255)).cast("int") for v in (r, g, b)])
    if name == "no_shadow":
        bright = (r > SHADOW_LIMIT) & (g > SHADOW_LIMIT) & (b > SHADOW_LIMIT)
        return F.when(bright, white).otherwise(same)
    if name == "sepia":
        # Single precision, so that truncation falls where the filter defines it.
        def tone(weights: tuple[float, float, float]) -> Column:
            wr, wg, wb = [F.lit(w).cast("float") for w in weights]
            total = r.cast("float") * wr + g.cast("float") * wg + b.cast("float") * wb
            return F.floor(F.least(total, F.lit(255.0).cast("float"))).cast("int")

        return _rgb(tone(SEPIA["r"]), tone(SEPIA["g"]), tone(SEPIA["b"]))
    if name == "grayscale":
        wr, wg, wb = LUMA
        luma = F.floor((r * wr + g * wg + b * wb) / 1000).cast("int")
        return _rgb(luma, luma, luma)
    if name == "none":
        return same
    raise ValueError(f"unknown filter: {name}")
