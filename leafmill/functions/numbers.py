"""Numbers: rounding of doubles by their exact value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Magnitude up to which ten times a double keeps its fraction.
EXACT_BELOW = float(1 << 48)


def tenths(c: Column | str) -> Column:
    """A double rounded to one decimal: to the nearest by its exact binary value, ties to even.

    round() and bround() go by the printed decimal, for which 0.35 is a tie; its value is
    below, so 0.3 is nearest.  8 x and 2 x are exact, so the error of their sum is too, and
    it says on which side of a half the product lies when the sum itself is one.
    """
    x = F.col(c) if isinstance(c, str) else c
    x = x.cast("double")
    high = x * 8 + x * 2
    low = x * 2 - (high - x * 8)
    whole = F.floor(high)
    rest = high - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((low > 0) | ((low == 0) & (whole % 2 != 0))))
    return F.when(F.abs(x) < EXACT_BELOW, (whole + up.cast("int")) / F.lit(10.0)).otherwise(F.bround(x, 1))
