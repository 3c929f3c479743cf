"""Random numbers as columns that depend on a seed, a key and a draw only.

A number is 52 bits of the md5 of "seed:draw:key", so a row has the same one whatever partition it is in, on any
engine. A null key is written as nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52
#: Coefficients of the rational approximations of the normal distribution's quantiles (algorithm AS 241,
#: PPND16), numerator and denominator by ascending power, for the middle, the tails and the far tails.
MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def bits(seed: int, draw: Column | str, key: Column, digits: int = BITS // 4) -> Column:
    """A whole number of 4 x digits random bits."""
    draw = F.lit(draw) if isinstance(draw, str) else draw.cast("string")
    text = F.concat(F.lit(f"{seed}:"), draw, F.lit(":"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def uniform(seed: int, draw: Column | str, key: Column) -> Column:
    """A number between 0 and 1, neither of them."""
    return (bits(seed, draw, key) + 0.5) / float(1 << BITS)


def _ratio(x: Column, fraction: tuple[Sequence[float], Sequence[float]]) -> Column:
    sums = []
    for powers in fraction:
        total = F.lit(powers[-1])
        for p in powers[-2::-1]:
            total = total * x + p
        sums.append(total)
    return sums[0] / sums[1]


def normal_quantile(u: Column) -> Column:
    """The standard normal distribution's quantile of u, between 0 and 1."""
    q = u - 0.5
    tail = F.sqrt(-F.log(F.least(u, 1.0 - u)))
    far = F.when(tail <= 5.0, _ratio(tail - 1.6, TAIL)).otherwise(_ratio(tail - 5.0, FAR))
    return F.when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, MIDDLE)).when(q < 0, -far).otherwise(far)


def normal_quantiles(us: Column) -> Column:
    """``normal_quantile`` of an array's numbers. Each step is an array of its own: in a lambda nothing is computed once for several uses."""
    bent = F.transform(us, lambda u: F.struct((u - 0.5).alias("q"), F.sqrt(-F.log(F.least(u, 1.0 - u))).alias("tail")))
    x = lambda p: F.when(F.abs(p["q"]) <= 0.425, 0.180625 - p["q"] * p["q"]).when(p["tail"] <= 5.0, p["tail"] - 1.6).otherwise(p["tail"] - 5.0)
    placed = F.transform(bent, lambda p: F.struct(p["q"].alias("q"), p["tail"].alias("tail"), x(p).alias("x")))
    far = lambda p: F.when(p["tail"] <= 5.0, _ratio(p["x"], TAIL)).otherwise(_ratio(p["x"], FAR)) * F.when(p["q"] < 0, -1.0).otherwise(1.0)
    return F.transform(placed, lambda p: F.when(F.abs(p["q"]) <= 0.425, p["q"] * _ratio(p["x"], MIDDLE)).otherwise(far(p)))


def truncated_normal(u: Column, mean: float, sd: float, low: float, high: float) -> Column:
    """The quantile of u of a normal distribution that is cut at low and high."""
    whole = NormalDist(mean, sd)
    below, inside = whole.cdf(low), whole.cdf(high) - whole.cdf(low)
    return F.least(F.greatest(mean + sd * normal_quantile(below + u * inside), F.lit(float(low))), F.lit(float(high)))


def derived_seeds(seed: int, key: Column, count: int) -> Column:
    """``count`` different whole numbers below 2^32 for each key, as an array."""
    #: Twice as many and some more are drawn; so many equal ones among 2^32 do not occur.
    drawn = F.transform(F.sequence(F.lit(0), F.lit(2 * count + 16)), lambda i: bits(seed, i, key, 8))
    return F.slice(F.array_distinct(drawn), 1, count)


def noise(flat: Column, share: float, seed: int, key: Column) -> Column:
    """A symmetric flat 6x6 array of normal numbers whose Frobenius norm is ``share`` of flat's."""
    drawn = normal_quantiles(F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: uniform(seed, i, key)))
    even = lambda a: F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: (a[i] + a[(i % 6) * 6 + F.floor(i / 6).cast("int")]) / 2.0)
    size = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    #: Each step is the one element of an array, so that it is computed once.
    sized = F.transform(F.transform(F.array(drawn), even), lambda a: F.struct(a.alias("a"), size(flat).alias("whole"), size(a).alias("own")))
    scaled = F.transform(sized, lambda s: F.transform(s["a"], lambda x: F.try_divide(x * share * s["whole"], s["own"])))
    return scaled[0]


def with_noise(flat: Column, share: float, seed: int, key: Column) -> Column:
    """flat with ``noise`` added."""
    return F.zip_with(flat, noise(flat, share, seed, key), lambda a, b: a + b)
