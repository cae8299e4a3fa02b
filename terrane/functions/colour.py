"""Contrast, colour difference, ramps and zoom-dependent widths as Column expressions; colours are r, g, b in 0..255."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: D65 white, and the sRGB primaries' rows (fixed values of the public standards).
WHITE = (0.95047, 1.0, 1.08883)
RGB_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))


def linear(c: Column, knee: float = 0.03928) -> Column:
    v = c / 255.0
    return F.when(v <= knee, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast_ratio(a: tuple, b: tuple) -> Column:
    x, y = luminance(*a), luminance(*b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    rgb = [linear(c, 0.04045) for c in (r, g, b)]
    f = []
    for row, white in zip(RGB_XYZ, WHITE, strict=True):
        t = sum(k * c for k, c in zip(row, rgb, strict=True)) / white
        f.append(F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def ciede2000(l1, a1, b1, l2, a2, b2, keep=lambda _, c: c) -> Column:
    """The CIE's formula of 2000 for two Lab colours.  keep(name, part) may store a part that is used more than once."""
    c = (F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2
    c7 = keep("c7", F.pow(c, F.lit(7.0)))
    g = keep("g", 0.5 * (1 - F.sqrt(c7 / (c7 + 25.0**7))))
    p1, p2 = keep("p1", (1 + g) * a1), keep("p2", (1 + g) * a2)
    c1, c2 = keep("c1", F.sqrt(p1 * p1 + b1 * b1)), keep("c2", F.sqrt(p2 * p2 + b2 * b2))
    angle = lambda y, x: F.when((x == 0) & (y == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)))
    h1, h2 = keep("h1", angle(b1, p1)), keep("h2", angle(b2, p2))
    grey = c1 * c2 == 0
    d = keep("d", h2 - h1)
    dh = keep("dh", F.when(grey, 0.0).when(F.abs(d) <= 180, d).when(d > 180, d - 360).otherwise(d + 360))
    dl, dc = l2 - l1, c2 - c1
    dhh = 2 * F.sqrt(c1 * c2) * F.sin(F.radians(dh / 2))
    lm, cm = keep("lm", (l1 + l2) / 2), keep("cm", (c1 + c2) / 2)
    hm = keep("hm", F.when(grey, h1 + h2).when(F.abs(d) <= 180, (h1 + h2) / 2).when(h1 + h2 < 360, (h1 + h2 + 360) / 2).otherwise((h1 + h2 - 360) / 2))
    cos = lambda v: F.cos(F.radians(v))
    t = 1 - 0.17 * cos(hm - 30) + 0.24 * cos(2 * hm) + 0.32 * cos(3 * hm + 6) - 0.20 * cos(4 * hm - 63)
    cm7 = keep("cm7", F.pow(cm, F.lit(7.0)))
    rt = -2 * F.sqrt(cm7 / (cm7 + 25.0**7)) * F.sin(F.radians(60 * F.exp(-F.pow((hm - 275) / 25, 2))))
    sl = 1 + 0.015 * F.pow(lm - 50, 2) / F.sqrt(20 + F.pow(lm - 50, 2))
    sc, sh = 1 + 0.045 * cm, 1 + 0.015 * cm * t
    x, y, z = keep("x", dl / sl), keep("y", dc / sc), keep("z", dhh / sh)
    return F.sqrt(x * x + y * y + z * z + rt * y * z)


def with_difference(df: DataFrame, name: str, one: tuple, two: tuple) -> DataFrame:
    """df and the difference of two Lab colours.  Parts that the formula uses again are columns for a while: as one expression it would
    repeat them, and its code would be too large to compile."""
    before = df.columns

    def keep(part: str, c: Column) -> Column:
        nonlocal df
        df = df.withColumn(f"__{part}", c)
        return F.col(f"__{part}")

    labs = [keep(f"lab{i}", c) for i, c in enumerate((*one, *two))]
    delta = ciede2000(*labs, keep=keep)
    return df.select(*before, delta.alias(name))


def fraction(v: Column, low: Column, high: Column) -> Column:
    """Where v lies between low and high, kept in 0..1; a half where they are equal; NaN stays."""
    return F.when(F.isnan(v), v).when(low == high, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low))))


def ramp(t: Column, stops: list[tuple[float, float, float]]) -> tuple[Column, Column, Column]:
    """A colour on evenly spaced stops, rounded."""
    n = len(stops) - 1
    k = F.least(F.floor(t * n), F.lit(n - 1)).cast("int")
    w = t * n - k
    table = lambda c: F.array(*(F.lit(float(s[c])) for s in stops))
    return tuple(F.round(F.get(table(c), k) * (1 - w) + F.get(table(c), k + 1) * w).cast("int") for c in range(3))


def width_at(zoom: Column, stops: list[tuple[float, float]]) -> Column:
    """A width between zoom stops, in equal ratios; constant beyond them."""
    out = F.when(zoom <= stops[0][0], stops[0][1])
    for (z0, w0), (z1, w1) in zip(stops, stops[1:], strict=False):
        t = (zoom - z0) / (z1 - z0)
        out = out.when(zoom <= z1, F.lit(w0) * F.pow(F.lit(w1 / w0), t) if w0 > 0 and w1 > 0 else w0 + (w1 - w0) * t)
    return out.otherwise(stops[-1][1])


def mix(a: Column, b: Column, t: Column) -> Column:
    return F.round(a + (b - a) * t).cast("int")


def haze(distance: Column, scale: Column) -> Column:
    return 1 - F.exp(-F.pow(distance / scale, 2))


def smoothstep(t: Column) -> Column:
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return x * x * (3 - 2 * x)


def exaggeration(zoom: Column) -> Column:
    """How much relief is raised at small scales."""
    return F.greatest(F.lit(1.0), F.pow(F.lit(1.6), (13 - zoom) / 2))


def hillshade(dzdx: Column, dzdy: Column, altitude: float = 45.0, azimuth: float = 315.0) -> Column:
    """Shade of a slope, -1..1, zero on level ground."""
    alt, az = math.radians(altitude), math.radians(azimuth)
    east, north = math.sin(az) * math.cos(alt), math.cos(az) * math.cos(alt)
    lit = (math.sin(alt) - east * dzdx - north * dzdy) / F.sqrt(1 + dzdx * dzdx + dzdy * dzdy)
    return F.tanh((lit - math.sin(alt)) / 0.35)


def terrarium(r: Column, g: Column, b: Column) -> Column:
    """Metres from an elevation pixel."""
    return (r * 256 + g + b / 256.0 - 32768).cast("float")


#: How far the darkest and the lightest ground go towards their tints (fixed values).
SHADOW, LIGHT = 0.45, 0.45


def shaded(channel: Column, amount: Column, dark: Column, light: Column) -> Column:
    """One channel of a pixel under relief of -1..1: drawn towards the dark tint below zero and the light one above; a tint or an
    amount that is null leaves it."""
    to, t = F.when(amount < 0, dark).otherwise(light), F.when(amount < 0, -amount * SHADOW).otherwise(amount * LIGHT)
    mixed = F.floor(channel + (to - channel) * t + 0.5).cast("int")
    return F.when(amount.isNull() | F.isnan(amount) | (amount == 0) | to.isNull(), channel.cast("int")).otherwise(mixed)
