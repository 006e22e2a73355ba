"""Column expressions shared by the operators: integers as the codec uses them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import EPOCH_1904, PROFILES, RATES


def whole_div(a: Column, b: Column) -> Column:
    """Division that truncates toward zero."""
    return F.call_function("div", a, b)


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def align(v: Column, to: int) -> Column:
    """The next multiple of a power of two."""
    return (v + (to - 1)).bitwiseAND(~(to - 1))


def descale(v: Column, bits: int) -> Column:
    """Rounding shift: half goes up."""
    return F.shiftright(v + (1 << (bits - 1)), bits)


def log2(v: Column) -> Column:
    """Floor of the logarithm of a positive integer."""
    return F.length(F.bin(v)) - 1


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2, 2, ... as 0, 1, 2, 3, 4, ..."""
    return F.when(v < 0, -2 * v - 1).otherwise(2 * v)


def lookup(values, index: Column) -> Column:
    """The value at an index from 0 of a short fixed table."""
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def big_endian(v: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(v.cast("long")), 2 * size, "0"))


def _book(book: Column) -> tuple[Column, Column, Column, Column]:
    switch = book.bitwiseAND(F.lit(3)) + 1
    rice, exp = F.shiftright(book, 5), F.shiftright(book, 2).bitwiseAND(F.lit(7))
    return switch, rice, exp, switch * F.call_function("shiftleft", F.lit(1), rice)


def code_bits(book: Column, value: Column) -> Column:
    """Length of a codeword: Rice below the book's switch value, exponential-Golomb from there."""
    switch, rice, exp, limit = _book(book)
    rest = value - limit + F.call_function("shiftleft", F.lit(1), exp)
    return F.when(value >= limit, 2 * log2(F.greatest(rest, F.lit(1))) - exp + switch + 1).otherwise(F.call_function("shiftright", value, rice) + 1 + rice).cast("long")


def code_word(book: Column, value: Column) -> Column:
    """The codeword's number; with ``code_bits`` it has its leading zeros."""
    _, rice, exp, limit = _book(book)
    unit = F.call_function("shiftleft", F.lit(1), rice)
    return F.when(value >= limit, value - limit + F.call_function("shiftleft", F.lit(1), exp)).otherwise(unit + value.bitwiseAND(unit - 1)).cast("long")


def rate_fraction(fps: Column) -> Column:
    """A frame rate as struct(num, den): a usual one, a whole one, or the nearest fraction with den up to 1001."""
    nearest = F.array_min(
        F.transform(F.sequence(F.lit(1), F.lit(1001)), lambda d: F.struct(F.abs(fps - F.floor(fps * d + 0.5) / d).alias("err"), d.cast("long").alias("den"), F.floor(fps * d + 0.5).cast("long").alias("num")))
    )
    out = F.when(fps == F.floor(fps), F.struct(fps.cast("long").alias("num"), F.lit(1).cast("long").alias("den"))).otherwise(F.struct(nearest["num"].alias("num"), nearest["den"].alias("den")))
    for value, num, den in reversed(RATES):
        out = F.when(F.abs(fps - value) < 0.01, F.struct(F.lit(num).cast("long").alias("num"), F.lit(den).cast("long").alias("den"))).otherwise(out)
    return out


def resolve_rate(num: Column, den: Column, fps: Column) -> Column:
    """An explicit fraction, else a frame rate's, else 30/1."""
    given = F.when(num.isNotNull() & den.isNotNull(), F.struct(num.cast("long").alias("num"), den.cast("long").alias("den")))
    return F.coalesce(given, F.when(fps.isNotNull(), rate_fraction(fps)), F.struct(F.lit(30).cast("long").alias("num"), F.lit(1).cast("long").alias("den")))


def human_size(n: Column) -> Column:
    """Bytes, or kibibytes with one place, or mebibytes with two; no separators."""
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.2f MB", n / (1 << 20)))


def fourcc(profile: Column) -> Column:
    """A profile's four-character code."""
    return lookup([p[1] for p in PROFILES], profile)


def profile_of(code: Column) -> Column:
    """The profile of a four-character code; null if there is none."""
    place = F.array_position(F.array(*(F.lit(p[1]) for p in PROFILES)), code)
    return F.when(place > 0, place - 1)


def movie_time(at: Column) -> Column:
    """A timestamp as seconds since 1904, in 32 bits."""
    return (F.unix_timestamp(at) + EPOCH_1904).bitwiseAND(F.lit(0xFFFFFFFF))
