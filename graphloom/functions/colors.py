"""Colours and small scalar functions."""

from __future__ import annotations

import colorsys
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The basic colour names of CSS.
NAMES = {
    "black": (0, 0, 0), "silver": (192, 192, 192), "gray": (128, 128, 128), "grey": (128, 128, 128), "white": (255, 255, 255),
    "maroon": (128, 0, 0), "red": (255, 0, 0), "purple": (128, 0, 128), "fuchsia": (255, 0, 255), "green": (0, 128, 0),
    "lime": (0, 255, 0), "olive": (128, 128, 0), "yellow": (255, 255, 0), "navy": (0, 0, 128), "blue": (0, 0, 255),
    "teal": (0, 128, 128), "aqua": (0, 255, 255), "orange": (255, 165, 0), "pink": (255, 192, 203), "brown": (165, 42, 42),
}


def parse(text: str) -> list[float] | None:
    """[r, g, b] or [r, g, b, a] of hex3, hex6, rgb(a), hsl(a) or a name; None if it is none."""
    text = text.strip().lower()
    if text in NAMES:
        return list(NAMES[text])
    if re.fullmatch(r"#[0-9a-f]{3}", text):
        return [int(c * 2, 16) for c in text[1:]]
    if re.fullmatch(r"#[0-9a-f]{6}", text):
        return [int(text[i : i + 2], 16) for i in (1, 3, 5)]
    m = re.fullmatch(r"(rgb|hsl)a?\(([^)]*)\)", text)
    if not m:
        return None
    parts = [p.strip() for p in m[2].split(",")]
    if len(parts) not in (3, 4):
        return None
    try:
        if m[1] == "rgb":
            out = [math.floor(float(p[:-1]) * 255 / 100 if p.endswith("%") else float(p)) for p in parts[:3]]
            if not all(0 <= v <= 255 for v in out):
                return None
        else:
            h, s, lum = float(parts[0]) % 360 / 360, *(float(p.rstrip("%")) / 100 for p in parts[1:3])
            out = [math.floor(v * 255 + 0.5) for v in colorsys.hls_to_rgb(h, lum, s)]
        if len(parts) == 4:
            out.append(float(parts[3].rstrip("%")) / (100 if parts[3].endswith("%") else 1))
    except ValueError:
        return None
    return out


def camel_to_dash(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "([A-Z])", "-$1"))


def dash_to_camel(c: Column) -> Column:
    parts = F.split(c, "-")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, 1000), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), ""))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def clamp(lo: Column, v: Column, hi: Column) -> Column:
    return F.least(F.greatest(lo, v), hi)


def hash_int(c: Column, seed: int = 9261, factor: int = 65599) -> Column:
    """seed * factor + code, code by code, wrapping at 32 bits, over a text's code points."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    step = lambda h, x: (h * factor + x).bitwiseAND(F.lit(0xFFFFFFFF))
    h = F.aggregate(codes, F.lit(seed).cast("long"), step)
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def quadratic_roots(a: Column, b: Column, c: Column) -> Column:
    """Real roots of a t^2 + b t + c, smaller first; empty if there are none."""
    d = b * b - 4 * a * c
    roots = F.array_sort(F.array((-b - F.sqrt(F.greatest(d, F.lit(0.0)))) / (2 * a), (-b + F.sqrt(F.greatest(d, F.lit(0.0)))) / (2 * a)))
    return F.when(d >= 0, roots).otherwise(F.array().cast("array<double>"))


def bezier_at(p0: Column, p1: Column, p2: Column, t: Column) -> Column:
    return (1 - t) * (1 - t) * p0 + 2 * (1 - t) * t * p1 + t * t * p2
