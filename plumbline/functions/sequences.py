"""Low-discrepancy designs as Column expressions: a point needs its index only, so any range of a pool can be made
anywhere, and made again after a loss.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 30
#: Degree, inner coefficients and first direction numbers of Sobol's dimensions from the second on.
PRIMITIVE = (
    (1, 0, (1,)),
    (2, 1, (1, 3)),
    (3, 1, (1, 3, 1)),
    (3, 2, (1, 1, 1)),
    (4, 1, (1, 1, 3, 3)),
    (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)),
    (5, 4, (1, 1, 5, 5, 5)),
    (5, 7, (1, 1, 7, 11, 19)),
    (5, 11, (1, 1, 5, 1, 1)),
)


def directions(dimension: int) -> list[int]:
    """Direction integers of a dimension (from 0), scaled to BITS bits."""
    if dimension == 0:
        return [1 << (BITS - 1 - k) for k in range(BITS)]
    degree, inner, first = PRIMITIVE[dimension - 1]
    v = [m << (BITS - 1 - k) for k, m in enumerate(first)]
    for k in range(degree, BITS):
        value = v[k - degree] ^ (v[k - degree] >> degree)
        for j in range(1, degree):
            if inner >> (degree - 1 - j) & 1:
                value ^= v[k - j]
        v.append(value)
    return v


def sobol(index: Column, dimension: int, shift: int = 0) -> Column:
    """Coordinate in [0, 1) of the point with this index, with a digital shift."""
    gray = index.bitwiseXOR(F.shiftright(index, 1))
    bits = [F.when(gray.bitwiseAND(F.lit(1 << k)) != 0, F.lit(v)).otherwise(F.lit(0)) for k, v in enumerate(directions(dimension))]
    return reduce(lambda a, b: a.bitwiseXOR(b), bits, F.lit(shift)) / F.lit(float(1 << BITS))


def ceil_to_multiple(value: Column, multiple: int) -> Column:
    """The smallest multiple that is not below value."""
    return (F.ceil(value / multiple) * multiple).cast("int")
