"""Results as text: central value and error, plainly or as papers print them.

All are built-in expressions. Rounding is half up in decimal; a null central
value or error gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _exponent(x: Column) -> Column:
    """The power of ten of x's first digit; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.floor(F.log10(F.abs(x)))).cast("int")


def _ten(power: Column) -> Column:
    return F.pow(F.lit(10.0), power)


def _fixed(x: Column, digits: Column) -> Column:
    """x with a number of digits after the point; fewer than none round before it."""
    coarse = F.round(x / _ten(-digits)) * _ten(-digits)
    shown = F.greatest(digits, F.lit(0))
    return F.format_string("%s", F.call_function("format_string", F.concat(F.lit("%."), shown.cast("string"), F.lit("f")), F.when(digits < 0, coarse).otherwise(x)))


def basic(central: Column, error: Column, width: int = 0) -> Column:
    """(central +- error), filled up with blanks to a width."""
    text = F.concat(F.lit("("), central.cast("string"), F.lit(" +- "), error.cast("string"), F.lit(")"))
    return F.when(F.char_length(text) < width, F.rpad(text, width, " ")).otherwise(text) if width else text


def _padded(text: Column, width: int) -> Column:
    return F.when(F.char_length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def _power(exponent: Column) -> Column:
    return F.when(exponent != 0, F.concat(F.lit("\\times 10^{"), exponent.cast("string"), F.lit("}"))).otherwise("")


def _signed(x: Column, text: Column) -> Column:
    """The digits with a blank or a minus before them."""
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(" "), F.ltrim(F.translate(text, "-", "")))


def published_value(x: Column, figures: int = 3, threshold: int = 3, round_power: int | None = None, width: int = 0) -> Column:
    """One number with so many figures: decimal if its exponent is within the threshold, else times a power of ten."""
    exponent = F.when(F.abs(_exponent(x)) <= threshold, 0).otherwise(_exponent(x)).cast("int")
    last = F.lit(round_power) if round_power is not None else _exponent(x) - figures + 1
    text = _fixed(x / _ten(exponent), exponent - last)
    zero = ~text.rlike("[1-9]")
    return F.when(x.isNotNull(), _padded(F.concat(F.when(zero, F.lit("0")).otherwise(_signed(x, text)), _power(exponent)), width))


def published(central: Column, error: Column, figures: int = 3, of: str = "largest", threshold: int = 3, round_power: int | None = None, width: int = 0) -> Column:
    """central(error) with a common exponent, so many figures of the central value, the error or the larger of both.

    The threshold is tested on the central value's exponent; the error's leading
    zeros are left out.
    """
    own = _exponent(central)
    exponent = F.when(F.abs(own) <= threshold, 0).otherwise(own).cast("int")
    leading = {"central": own, "error": _exponent(error), "largest": F.when(F.abs(central) >= F.abs(error), own).otherwise(_exponent(error))}[of]
    last = F.lit(round_power) if round_power is not None else leading - figures + 1
    digits = exponent - last
    c, e = _fixed(central / _ten(exponent), digits), _fixed(error / _ten(exponent), digits)
    # A zero shows all its digits only beside an error that is smaller than one.
    small = (_exponent(e.try_cast("double")) + exponent < 0) & e.rlike("[1-9]")
    c = F.when(~c.rlike("[1-9]") & ~small, F.lit("0")).otherwise(_signed(central, c))
    e = F.when(~e.rlike("[1-9]"), F.lit("0")).when(e.try_cast("double") < 1, F.regexp_replace(e, r"^0?\.?0*", "")).otherwise(e)
    return F.when(central.isNotNull() & error.isNotNull(), _padded(F.concat(c, F.lit("("), e, F.lit(")"), _power(exponent)), width))
