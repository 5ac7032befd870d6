"""Colour columns: hex, RGB, HSL, Lab, luminance, contrast, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfacts.functions.base import ColumnOrName, clamp, col, first_match, let, round_half_up


def clean_hex(c: ColumnOrName) -> Column:
    """Six lower-case digits without ``#``; three-digit form expanded; null when not a hex colour."""
    h = F.lower(F.regexp_replace(col(c), "^#", ""))
    long = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return F.when(long.rlike("^[0-9a-f]{6}$"), long)


def channel(c: ColumnOrName, i: int) -> Column:
    """Channel 0 = red, 1 = green, 2 = blue of a hex colour, 0..255."""
    return F.conv(F.substring(clean_hex(c), 1 + 2 * i, 2), 16, 10).cast("int")


def hex_to_rgb(c: ColumnOrName) -> Column:
    return F.when(
        clean_hex(c).isNotNull(),
        F.struct(channel(c, 0).alias("r"), channel(c, 1).alias("g"), channel(c, 2).alias("b")),
    )


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    """``#RRGGBB``; channels rounded and clamped."""
    parts = [clamp(round_half_up(x.cast("double")), 0, 255).cast("int") for x in (r, g, b)]
    return F.upper(F.format_string("#%02x%02x%02x", *parts))


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, unrounded, 0 for greys."""
    rd, gd, bd = (x.cast("double") / 255 for x in (r, g, b))
    mx, mn = F.greatest(rd, gd, bd), F.least(rd, gd, bd)
    d = mx - mn
    return first_match(
        (d == 0, F.lit(0.0)),
        (mx == rd, F.pmod((gd - bd) / d, F.lit(6.0)) * 60),
        (mx == gd, ((bd - rd) / d + 2) * 60),
        otherwise=((rd - gd) / d + 4) * 60,
    )


def lightness(r: Column, g: Column, b: Column) -> Column:
    mx, mn = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    return (mx + mn) / 510


def hsl_saturation(r: Column, g: Column, b: Column) -> Column:
    mx, mn = F.greatest(r, g, b).cast("double") / 255, F.least(r, g, b).cast("double") / 255
    l = (mx + mn) / 2
    return F.when(mx == mn, F.lit(0.0)).otherwise((mx - mn) / (1 - F.abs(2 * l - 1)))


def rgb_to_hsl(r: Column, g: Column, b: Column) -> Column:
    """Whole degrees and whole percents."""
    return F.struct(
        F.pmod(round_half_up(hue(r, g, b)), F.lit(360)).cast("int").alias("h"),
        round_half_up(hsl_saturation(r, g, b) * 100).cast("int").alias("s"),
        round_half_up(lightness(r, g, b) * 100).cast("int").alias("l"),
    )


def hsl_to_rgb(h: Column, s: Column, l: Column) -> Column:
    """Degrees and percents to 0..255 channels."""
    hd, sd, ld = F.pmod(h.cast("double"), F.lit(360.0)), clamp(s, 0, 100) / 100, clamp(l, 0, 100) / 100
    c = (1 - F.abs(2 * ld - 1)) * sd
    x = c * (1 - F.abs(F.pmod(hd / 60, F.lit(2.0)) - 1))
    m = ld - c / 2
    zero = F.lit(0.0)
    sector = F.floor(hd / 60)

    def pick(*six: Column) -> Column:
        v = first_match(*[(sector == i, six[i]) for i in range(5)], otherwise=six[5])
        return round_half_up((v + m) * 255).cast("int")

    return F.struct(
        pick(c, x, zero, zero, x, c).alias("r"),
        pick(x, c, c, x, zero, zero).alias("g"),
        pick(zero, zero, x, c, c, x).alias("b"),
    )


def adjust_color(c: ColumnOrName, saturation: float, light: float) -> Column:
    """Shift saturation and lightness (percent points, clamped) and return ``#RRGGBB``."""
    def shifted(hsl: Column) -> Column:
        return hsl_to_rgb(hsl["h"], clamp(hsl["s"] + F.lit(saturation), 0, 100), clamp(hsl["l"] + F.lit(light), 0, 100))

    out = let(let(hex_to_rgb(c), lambda x: rgb_to_hsl(x["r"], x["g"], x["b"])), shifted)
    return F.when(clean_hex(c).isNotNull(), let(out, lambda x: rgb_to_hex(x["r"], x["g"], x["b"])))


def _linear(channel_value: Column) -> Column:
    v = channel_value.cast("double") / 255
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


# sRGB D65 matrix and white point, CIE constants.
_XYZ = [(0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041)]
_WHITE = (95.047, 100.0, 108.883)
_EPSILON, _KAPPA = 0.008856, 903.3


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    lin = F.array(*[_linear(x) * 100 for x in (r, g, b)])

    def ratios(v: Column) -> Column:
        return F.array(*[(v[0] * m[0] + v[1] * m[1] + v[2] * m[2]) / w for m, w in zip(_XYZ, _WHITE)])

    def curve(t: Column) -> Column:
        return F.when(t > _EPSILON, F.cbrt(t)).otherwise((t * _KAPPA + 16) / 116)

    return let(
        F.transform(let(lin, ratios), curve),
        lambda f: F.struct((f[1] * 116 - 16).alias("l"), ((f[0] - f[1]) * 500).alias("a"), ((f[1] - f[2]) * 200).alias("b")),
    )


def hex_to_lab(c: ColumnOrName) -> Column:
    return let(hex_to_rgb(c), lambda x: rgb_to_lab(x["r"], x["g"], x["b"]))


def delta_e(lab1: Column, lab2: Column) -> Column:
    """CIE76 distance of two Lab structs."""
    return F.sqrt(
        F.pow(lab1["l"] - lab2["l"], F.lit(2.0)) + F.pow(lab1["a"] - lab2["a"], F.lit(2.0)) + F.pow(lab1["b"] - lab2["b"], F.lit(2.0))
    )


def lab(l: float, a: float, b: float) -> Column:
    """A fixed Lab colour, such as the reference white (100, 0, 0)."""
    return F.struct(F.lit(float(l)).alias("l"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"))


def delta_e_to(c: ColumnOrName, reference: Column) -> Column:
    """Distance of a hex colour to a Lab struct."""
    return let(hex_to_lab(c), lambda x: delta_e(x, reference))


def delta_e_hex(c1: ColumnOrName, c2: ColumnOrName) -> Column:
    return let(F.struct(hex_to_lab(c1).alias("x"), hex_to_lab(c2).alias("y")), lambda p: delta_e(p["x"], p["y"]))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return _linear(r) * 0.2126 + _linear(g) * 0.7152 + _linear(b) * 0.0722


def hex_luminance(c: ColumnOrName) -> Column:
    return luminance(channel(c, 0), channel(c, 1), channel(c, 2))


def contrast_ratio(l1: Column, l2: Column) -> Column:
    """WCAG contrast of two luminances."""
    return (F.greatest(l1, l2) + 0.05) / (F.least(l1, l2) + 0.05)


def rgb_distance(c1: ColumnOrName, c2: ColumnOrName) -> Column:
    sq = [F.pow((channel(c1, i) - channel(c2, i)).cast("double"), F.lit(2.0)) for i in range(3)]
    return F.sqrt(sq[0] + sq[1] + sq[2])


def color_similarity(c1: ColumnOrName, c2: ColumnOrName) -> Column:
    """1 for equal colours, 0 for black against white or an invalid colour."""
    return F.coalesce(1 - rgb_distance(c1, c2) / F.sqrt(F.lit(195075.0)), F.lit(0.0))


def brightness(c: ColumnOrName) -> Column:
    return channel(c, 0) * 0.299 + channel(c, 1) * 0.587 + channel(c, 2) * 0.114


def hsv_saturation(r: Column, g: Column, b: Column) -> Column:
    mx, mn = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    return F.when(mx == 0, F.lit(0.0)).otherwise((mx - mn) / mx)


def is_neon(c: ColumnOrName) -> Column:
    r, g, b = (channel(c, i) for i in range(3))
    return (hsv_saturation(r, g, b) > 0.8) & (F.greatest(r, g, b) > 200)
