"""Scalar expressions: casts, defaults, fitness, and numbers as text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unknown attributes at the sinks.
UNKNOWN_INT, UNKNOWN_DOUBLE, NO_GENERATOR = -9999, -9999.9, -1


def _lenient(c: Column, kind: str) -> Column:
    digits = F.regexp_extract(F.coalesce(c, F.lit("")), r"^[ \t]*([+-]?[0-9]+)", 1)
    error = F.raise_error(F.concat(F.lit(f"over the range of {kind}: "), digits)).cast(kind)
    return F.when(digits == "", F.lit(0).cast(kind)).otherwise(F.coalesce(digits.try_cast(kind), error))


def lenient_int(c: Column) -> Column:
    """The number a text begins with, after blanks and a sign; 0 where there is none, an error where it is too large."""
    return _lenient(c, "int")


def lenient_long(c: Column) -> Column:
    """The same for ids, of 64 bits."""
    return _lenient(c, "bigint")


def clean_number(c: Column) -> Column:
    """A number from text with blanks and thousands commas; null where it is none."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")


def float_floor(c: Column) -> Column:
    return F.floor(c.cast("float")).cast("int")


def float_ceil(c: Column) -> Column:
    return F.ceil(c.cast("float")).cast("int")


def attribute_or(c: Column, default: int | float) -> Column:
    return F.coalesce(c, F.lit(default))


def node_type(code: Column) -> Column:
    return F.when(code == 0, "seed").when(code == 1, "agent").otherwise("undefined")


def fitness_at(age: Column, lag: Column, peak: Column, duration: Column) -> Column:
    """1 before the lag, the peak while it lasts, then its decay by the cube of the years since."""
    since = (age - lag - duration + 1).cast("double")
    return F.when(age < lag, F.lit(1)).when(age <= lag + duration, peak).otherwise(F.floor(peak.cast("double") / F.pow(since, F.lit(3.0))).cast("int"))


def round_even(c: Column, digits: int) -> Column:
    """A double at so many digits after the point, half to even, in doubles as SQL does it: a zero keeps its sign."""
    scaled = F.rint(c * F.lit(10.0**digits)) / F.lit(10.0**digits)
    return F.when(F.abs(scaled) < float("inf"), scaled).otherwise(c)


def general(c: Column, digits: int = 10) -> Column:
    """A double as C prints it by %.10g: so many significant digits of its exact value, half to even.

    Java's formats round the shortest digits that tell a double apart, half up, so a tie and what is almost one differ.
    """

    @F.arrow_udf("string")
    def printed(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else "NaN" if x != x else f"{x:.{digits}g}" for x in v.to_pylist()], pa.string())

    return printed(c)


def elapsed(seconds: Column) -> Column:
    """d-h:m:s of whole seconds, as log lines have it."""
    s = seconds.cast("long")
    return F.format_string("%d-%d:%d:%d", F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60)


def dash_for_none(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(0)) == 0, "-").otherwise(c.cast("string"))


def fixed(c: Column, digits: int) -> Column:
    """A double with so many digits after the point, as C prints it by %.nf: the nearest to its exact value (17 digits)."""
    return F.replace(F.format_number(c.cast("double"), digits), F.lit(","), F.lit(""))


def by_magnitude(c: Column, most: Column) -> Column:
    """A number as a report's column has it, whose largest amount tells the form: millions, whole or with two digits."""
    double = c.cast("double")
    text = F.when(most > 1e6, F.concat(fixed(double / 1e6, 2), F.lit("M"))).when(most > 1e3, fixed(double, 0)).otherwise(fixed(double, 2))
    return F.when(c.isNull(), F.lit("")).otherwise(text)
