"""Tests of values by their kind, integer hashes, and plane mathematics, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seeds and factor of the string hashes (sdbm and djb2) and the factor that joins two hashes.
SEED, FACTOR, SEED_ALT, JOIN = 9261, 65599, 5381, 0x200000
NUMBERS = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def _kind(c: Column) -> Column:
    return F.typeof(c)


def is_defined(c: Column) -> Column:
    return c.isNotNull()


def is_string(c: Column) -> Column:
    return c.isNotNull() & (_kind(c) == "string")


def is_bool(c: Column) -> Column:
    return c.isNotNull() & (_kind(c) == "boolean")


def is_number(c: Column) -> Column:
    """Any number but NaN."""
    kind = _kind(c)
    return c.isNotNull() & (kind.isin(NUMBERS) | kind.startswith("decimal")) & (c.cast("string") != "NaN")


def is_integer(c: Column) -> Column:
    v = c.cast("string").try_cast("double")
    return is_number(c) & F.coalesce(F.floor(v) == v, F.lit(False))


def is_array(c: Column) -> Column:
    return c.isNotNull() & _kind(c).startswith("array")


def is_plain_object(c: Column) -> Column:
    """Structs and maps."""
    return c.isNotNull() & (_kind(c).startswith("struct") | _kind(c).startswith("map"))


def is_object(c: Column) -> Column:
    """Structs, maps and arrays."""
    return is_plain_object(c) | is_array(c)


def is_empty_string(c: Column) -> Column:
    """Null, empty, or only white space."""
    return c.isNull() | c.cast("string").rlike(r"^\s*$")


def is_nonempty_string(c: Column) -> Column:
    return is_string(c) & ~c.cast("string").rlike(r"^\s*$")


def is_bounding_box(c: Column, fields: list[str]) -> Column:
    """A struct, of these fields, with numbers ``x1, x2, y1, y2``."""
    if not {"x1", "x2", "y1", "y2"} <= set(fields):
        return F.lit(False)
    tests = [is_number(c.getField(k)) for k in ("x1", "x2", "y1", "y2")]
    return tests[0] & tests[1] & tests[2] & tests[3]


def _int32(h: Column) -> Column:
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def hash_number(number: Column, seed: Column | int = SEED) -> Column:
    """One step of sdbm, wrapped to 32 bits."""
    return _int32((F.lit(seed) if isinstance(seed, int) else seed).cast("long") * FACTOR + number.cast("long"))


def hash_number_alt(number: Column, seed: Column | int = SEED_ALT) -> Column:
    """One step of djb2, wrapped to 32 bits; the shift wraps first."""
    start = (F.lit(seed) if isinstance(seed, int) else seed).cast("long")
    return _int32(_int32(start * 32) + start + number.cast("long"))


def hash_numbers(numbers: Column, seed: int = SEED) -> Column:
    """sdbm over an array of integers."""
    return F.aggregate(numbers, F.lit(seed).cast("long"), lambda h, x: _int32(h * FACTOR + x.cast("long")))


def combine_hashes(a: Column, b: Column) -> Column:
    return (a.cast("double") * JOIN + b.cast("double")).cast("double")


def hash_pairs(a: Column, b: Column) -> Column:
    """Two pairs [sdbm, djb2] to one: each hash takes in the other pair's."""
    return F.array(hash_number(F.get(b, F.lit(0)), F.get(a, F.lit(0))), hash_number_alt(F.get(b, F.lit(1)), F.get(a, F.lit(1))))


def real_cubic_roots(a: float, b: float, c: float, d: float) -> list[float]:
    """Real roots of a t^3 + b t^2 + c t + d (a not 0), rising, repeated ones once."""
    p, q = (3 * a * c - b * b) / (3 * a * a), (2 * b**3 - 9 * a * b * c + 27 * a * a * d) / (27 * a**3)
    shift, disc = -b / (3 * a), (q / 2) ** 2 + (p / 3) ** 3
    if disc > 1e-12:
        root = math.sqrt(disc)
        return [math.cbrt(-q / 2 + root) + math.cbrt(-q / 2 - root) + shift]
    if abs(p) < 1e-12:
        return [shift]
    arc = math.acos(max(-1.0, min(1.0, 3 * q / (2 * p) * math.sqrt(-3 / p)))) / 3
    return sorted({round(2 * math.sqrt(-p / 3) * math.cos(arc - 2 * math.pi * k / 3) + shift, 12) for k in range(3)})


def rotated(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> Column:
    """A point turned about a centre, as ``x, y``."""
    t = F.radians(degrees)
    return F.struct(((x - cx) * F.cos(t) - (y - cy) * F.sin(t) + cx).alias("x"), ((x - cx) * F.sin(t) + (y - cy) * F.cos(t) + cy).alias("y"))


def line_meets_circle(x1: Column, y1: Column, x2: Column, y2: Column, cx: Column, cy: Column, radius: Column) -> Column:
    """Places along the segment, 0 to 1, where it meets the circle, rising; empty if it doesn't."""
    dx, dy, fx, fy = x2 - x1, y2 - y1, x1 - cx, y1 - cy
    a, b, c = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - radius * radius
    d = b * b - 4 * a * c
    root = F.sqrt(F.greatest(d, F.lit(0.0)))
    both = F.array_distinct(F.array(F.try_divide(-b - root, 2 * a), F.try_divide(-b + root, 2 * a)))
    return F.filter(F.when(d >= 0, both).otherwise(F.array().cast("array<double>")), lambda t: t.isNotNull() & (t >= 0) & (t <= 1))


def polygons_overlap(p: list[tuple[float, float]], q: list[tuple[float, float]], dx: Column, dy: Column) -> Column:
    """Whether the convex polygon ``p`` and ``q``, moved by (dx, dy), share a point: no side's direction separates them."""
    test = F.lit(True)
    for poly in (p, q):
        for (ax, ay), (bx, by) in zip(poly, [*poly[1:], poly[0]], strict=True):
            nx, ny = by - ay, ax - bx
            own, other = [nx * x + ny * y for x, y in p], [nx * x + ny * y for x, y in q]
            move = dx * nx + dy * ny
            test = test & (F.lit(max(own)) >= move + min(other)) & (move + max(other) >= F.lit(min(own)))
    return test
