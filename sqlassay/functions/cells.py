"""Result cells in one canonical text form, so results of different types compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlassay.functions.rows import let

# Sums of doubles differ in their last digits with the order of the rows; these digits hold.
SIGNIFICANT_DIGITS = 12


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def half_even(value: Column, decimals: int) -> Column:
    """Half-even rounding of the binary value, as numpy and C do it.

    ``bround`` rounds the printed decimals instead: 0.5015 is below the half in binary.
    """
    scale = F.lit(float(10**decimals))
    # Beyond 1e15 a double has no fraction left to round.
    return F.when(F.abs(value) < F.lit(1e15), F.rint(value * scale) / scale).otherwise(value)


def significant(value: Column, digits: int = SIGNIFICANT_DIGITS) -> Column:
    """A double to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(value))).cast("double"))
    usual = F.abs(value).between(*_PLAIN)
    # Far from one the scale itself is inexact; there the digits are taken from the text.
    tiny = F.format_string(f"%.{digits - 1}e", value).cast("double")
    return F.when(usual & (F.abs(value) < F.lit(_SMALL)), tiny).when(usual, F.rint(value * scale) / scale).otherwise(value)


#: Sizes written without an exponent; what is outside has one, whatever its type.
_PLAIN = (1e-15, 1e15)
#: Below this a double's twelve digits may reach beyond the decimals of the plain form's type.
_SMALL = 1e-9
_NUMBER = r"^-?(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?$"


def _with_exponent(text: Column) -> Column:
    """A number's text as digits and exponent: ``-1.25e-21``, ``1e16``, zero as ``0``."""

    def form(number: Column) -> Column:
        whole, part = F.regexp_extract(number, _NUMBER, 1), F.regexp_extract(number, _NUMBER, 2)
        exponent = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(number, _NUMBER, 3), F.lit("")), F.lit("S9999")).cast("int"), F.lit(0))
        return let(F.concat(whole, part), lambda all_: let(F.regexp_replace(F.regexp_replace(all_, "^0+", ""), "0+$", ""), lambda digits: _joined(number, whole, all_, digits, exponent)))

    return let(text, form)


def _joined(number: Column, whole: Column, all_: Column, digits: Column, exponent: Column) -> Column:
    zeros = F.length(all_) - F.length(F.regexp_replace(all_, "^0+", ""))
    power = F.length(whole) - 1 - zeros + exponent
    rest = F.substring(digits, F.lit(2), F.length(digits))
    sign = F.when(number.startswith("-"), "-").otherwise("")
    mantissa = F.concat(F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
    return F.when(digits == "", "0").otherwise(F.concat(sign, mantissa, F.lit("e"), power.cast("string")))


def rounded(col: Column, dtype: T.DataType, decimals: int | None) -> Column:
    """Half-even rounding of fractional columns; 0 or None leaves the value alone."""
    if not decimals or not isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return col
    if isinstance(dtype, T.DecimalType):
        return F.bround(col, decimals)
    return half_even(col.cast("double"), decimals)


def _short(decimal_text: Column) -> Column:
    """Closing zeros of a decimal fraction off."""
    return F.regexp_replace(F.regexp_replace(decimal_text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _small(value: Column) -> Column:
    """Plain text of a double below ``_SMALL`` from its digits: zeros first, then all twelve but closing zeros."""

    def form(text: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(F.substring_index(text, "e", 1), "[-.]", ""), "0+$", "")
        zeros = F.repeat(F.lit("0"), -F.substring_index(text, "e", -1).cast("int") - 1)
        return F.concat(F.when(text.startswith("-"), "-").otherwise(""), F.lit("0."), zeros, digits)

    return let(F.format_string(f"%.{SIGNIFICANT_DIGITS - 1}e", value), form)


def cell(col: Column, dtype: T.DataType, decimals: int | None = None) -> Column:
    """Canonical text of a value: 1, 1.0 and DECIMAL 1.00 agree, NaN counts as null.

    Integers and decimals keep all their digits, doubles twelve. The form follows from the value
    alone: plain from 1e-15 up to 1e15, digits and exponent outside.
    """
    if isinstance(dtype, T.DecimalType):
        value = rounded(col, dtype, decimals)
        text = _short(value.cast("string")) if dtype.scale else value.cast("string")
        if dtype.precision - dtype.scale <= 15 and dtype.scale <= 6:
            return text
        outside = (value != 0) & ~F.abs(value.cast("double")).between(*_PLAIN)
        return F.when(outside, _with_exponent(value.cast("string"))).otherwise(_short(value.cast("string")) if dtype.scale else text)
    if isinstance(dtype, T.LongType):
        return F.when(F.abs(col.cast("double")) > F.lit(_PLAIN[1]), _with_exponent(col.cast("string"))).otherwise(col.cast("string"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        number = col.cast("double")
        value = half_even(number, decimals) if decimals else significant(number)
        plain = F.abs(value).between(*_PLAIN)
        finite = F.abs(value) < F.lit(float("inf"))
        return (
            F.when(F.isnan(value), F.lit(None).cast("string"))
            .when((value == 0) | (plain & (value == F.floor(value))), value.cast("bigint").cast("string"))
            .when(plain & (F.abs(value) < F.lit(_SMALL)), _small(value))
            .when(plain, _short(value.cast("decimal(38,22)").cast("string")))
            .when(finite, _with_exponent(F.format_string(f"%.{SIGNIFICANT_DIGITS - 1}e", value)))
            .otherwise(value.cast("string"))
        )
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col)
    return col.cast("string")
