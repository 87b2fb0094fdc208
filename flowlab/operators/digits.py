"""Digits of the order of numbers: the bits of a double as a long that grows with it.

Counting rows by leading digits and looking further only where it matters finds exact ranks without a sort; each count
has at most 65,536 groups below one prefix, whatever the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one digit, and the shift that leaves the first one.
WIDTH = 16
FIRST_SHIFT = 64 - WIDTH
#: Rows below one prefix that may be ranked in one task; more are counted by another digit.
OPENED = 100_000


def _exponent(size: Column) -> Column:
    """The exponent of a size, or one more or less where the logarithm is rounded."""
    return F.least(F.greatest(F.floor(F.log2(size)).try_cast("int"), F.lit(-1022)), F.lit(1023))


def _unit(size: Column, exponent: Column) -> Column:
    """1 to 2 if the exponent is right, less below it and for the smallest numbers, up to 4 above it."""
    return size / F.pow(F.lit(2.0), exponent)


def _bits(value: Column, size: Column, exponent: Column, unit: Column) -> Column:
    """The bits rise with the unit, half as steeply from each power of two to the next: the least of three lines."""
    below = (unit - 1) * F.when(exponent == -1022, F.lit(float(2**52))).otherwise(F.lit(float(2**53)))
    fraction = F.least(below, (unit - 1) * F.lit(float(2**52)), unit * F.lit(float(2**51))).try_cast("long")
    bits = F.shiftleft((exponent + 1023).cast("long"), 52) + fraction
    bits = F.when(size == F.lit(float("inf")), F.lit(2047 * 2**52)).otherwise(bits)
    return F.when(F.isnan(value), F.lit(2**63 - 1)).when(value < 0, -bits).otherwise(bits)


def ordered_bits(value: Column) -> Column:
    """A long that grows with a double: the bits of its size (exponent, then fraction), negated below zero.

    Both zeros are 0; NaN, which sorts last, is the largest. Every step is exact: powers of two are multiplied and
    divided, and a rounded logarithm does no harm.
    """
    size = F.abs(value)
    exponent = _exponent(size)
    return _bits(value, size, exponent, _unit(size, exponent))


def with_ordered_bits(df: DataFrame, value: str, bits: str = "_bits") -> DataFrame:
    """``df`` with the ``ordered_bits`` of a double column without nulls.

    Size, exponent and unit are columns of their own, each computed once a row; written out in one expression the
    logarithm is repeated at every use, and the code is too long to be compiled.
    """
    value, columns = F.col(value), df.columns
    steps = df.withColumn("_size", F.abs(value)).withColumn("_exponent", _exponent(F.col("_size")))
    steps = steps.withColumn("_unit", _unit(F.col("_size"), F.col("_exponent")))
    found = _bits(value, F.col("_size"), F.col("_exponent"), F.col("_unit"))
    return steps.select(*columns, F.coalesce(found, F.lit(0)).alias(bits))  # never null, so no filter computes it again


def prefix(bits: Column, shift: int) -> Column:
    return F.shiftright(bits, shift)
