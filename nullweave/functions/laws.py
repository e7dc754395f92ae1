"""Pair laws as Column builders.

A pair's law is a family at q (plain), or an occupation probability pi and the
family's law at q given a positive weight (zero-inflated).  All sums run in log
space, so large rates don't underflow.  With u = -ln P(0) of the plain law:
ME u = q, B u = M ln(1 + q), W u = -M ln(1 - q).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Family

#: q of the W family stays below 1 by this much.
MARGIN = 1e-15


def _d(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


@dataclass(frozen=True)
class Law:
    """The law of pairs whose rate is the column q; `pi` is the occupation of a zero-inflated law."""

    family: Family
    layers: int
    q: Column
    pi: Column | None = None

    def _q(self) -> Column:
        return F.least(self.q, F.lit(1.0 - MARGIN)) if self.family == Family.W else self.q

    def exponent(self) -> Column:
        """u = -ln P(0) of the plain law."""
        m = float(self.layers)
        if self.family == Family.ME:
            return self.q
        if self.family == Family.B:
            return F.log1p(self.q) * m
        return F.log1p(-self._q()) * (-m)

    def plain_mean(self) -> Column:
        m = float(self.layers)
        if self.family == Family.ME:
            return self.q
        if self.family == Family.B:
            return self.q * m / (self.q + 1)
        return F.when(self.q >= 1, F.lit(float("inf"))).otherwise(self._q() * m / (F.lit(1.0) - self._q()))

    def positive(self) -> Column:
        """P(t > 0) of the plain law."""
        return -F.expm1(-self.exponent())

    def occupation(self) -> Column:
        got = self.positive() if self.pi is None else self.pi
        return F.when(self.q <= 0, F.lit(0.0) if self.pi is None else clamp(self.pi)).otherwise(clamp(got))

    def positive_mean(self) -> Column:
        """E[t | t > 0]: 1 in the limit of q = 0."""
        return F.when(self.q <= 0, F.lit(1.0)).otherwise(self.plain_mean() / self.positive())

    def expected(self) -> Column:
        if self.pi is None:
            return F.when(self.q <= 0, F.lit(0.0)).otherwise(self.plain_mean())
        return self.pi * self.positive_mean()

    def plain_cdf(self, w: Column) -> Column:
        """P(t <= w) of the plain law, w >= 0 (0 below): terms by their logarithms' recurrence."""
        q = self._q()
        if self.family == Family.W and self.layers == 1:
            inside = F.lit(1.0) - F.pow(q, w + 1)
        else:
            inside = self._summed(w)
        return F.when(w < 0, F.lit(0.0)).when(self.q <= 0, F.lit(1.0)).otherwise(clamp(inside))

    def ratio(self, k: Column) -> Column:
        """P(k) / P(k - 1) over q."""
        m = float(self.layers)
        if self.family == Family.ME:
            return F.lit(1.0) / k
        if self.family == Family.B:
            return F.greatest(F.lit(m) - k + 1, F.lit(0.0)) / k
        return (k + (m - 1)) / k

    def _summed(self, w: Column) -> Column:
        start = F.struct((-self.exponent()).alias("t"), F.exp(-self.exponent()).alias("s"), F.log(self._q()).alias("l"))
        steps = F.when(w >= 1, F.sequence(F.lit(1).cast("bigint"), w.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))

        def step(a, k):
            r = self.ratio(k.cast("double"))
            t = F.when(r > 0, a["t"] + F.log(r) + a["l"]).otherwise(F.lit(float("-inf")))
            return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"), a["l"].alias("l"))

        return F.aggregate(steps, start, step, lambda a: a["s"])

    def lower(self, w: Column) -> Column:
        """P(t <= w)."""
        if self.pi is None:
            return self.plain_cdf(w)
        p0 = F.exp(-self.exponent())
        inner = F.when(self.q <= 0, F.lit(1.0)).otherwise((self.plain_cdf(w) - p0) / self.positive())
        return F.when(w <= 0, F.lit(1.0) - clamp(self.pi)).otherwise(clamp(F.lit(1.0) - self.pi + self.pi * clamp(inner)))

    def upper(self, w: Column) -> Column:
        """P(t >= w)."""
        if self.pi is None:
            return F.when(w <= 0, F.lit(1.0)).when(self.q <= 0, F.lit(0.0)).otherwise(clamp(F.lit(1.0) - self.plain_cdf(w - 1)))
        inner = F.when(self.q <= 0, F.when(w <= 1, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise((F.lit(1.0) - self.plain_cdf(w - 1)) / self.positive())
        return F.when(w <= 0, F.lit(1.0)).otherwise(clamp(self.pi * clamp(inner)))

    def draw(self, u: Column, v: Column | None = None) -> Column:
        """The weight at uniforms u (and v for a zero-inflated law): the smallest w with CDF(w) > u.

        Counts the CDF's steps up to a bound that the law exceeds with a chance below 1e-15."""
        if self.pi is not None:
            floor = F.exp(-self.exponent())
            inner = F.when(self.q <= 0, F.lit(1).cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), Law(self.family, self.layers, self.q).draw(floor + v * self.positive())))
            return F.when(u < self.pi, inner).otherwise(F.lit(0).cast("bigint"))
        q = self._q()
        if self.family == Family.W and self.layers == 1:
            got = F.floor(F.log(F.lit(1.0) - u) / F.log(q)).cast("bigint")
        else:
            mean = self.plain_mean()
            if self.family == Family.B:
                bound = F.lit(self.layers).cast("bigint")
            elif self.family == Family.ME:
                bound = F.ceil(mean + F.sqrt(mean) * 10 + 40).cast("bigint")
            else:
                bound = F.ceil(mean + (F.lit(40.0) + self.layers * 4) / (F.lit(1.0) - q)).cast("bigint")
            start = F.struct((-self.exponent()).alias("t"), F.exp(-self.exponent()).alias("s"), F.log(q).alias("l"), F.lit(0).cast("bigint").alias("n"))

            def step(a, k):
                r = self.ratio(k.cast("double"))
                t = F.when(r > 0, a["t"] + F.log(r) + a["l"]).otherwise(F.lit(float("-inf")))
                more = F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"), a["l"].alias("l"), (a["n"] + 1).alias("n"))
                return F.when(a["s"] <= u, more).otherwise(a)

            got = F.aggregate(F.sequence(F.lit(1).cast("bigint"), bound), start, step, lambda a: a["n"])
        return F.when(self.q <= 0, F.lit(0).cast("bigint")).otherwise(got)


def log_growth(law: Law) -> Column:
    """ln(e^u - 1), the positive part of the partition function, for any u > 0."""
    u = law.exponent()
    return u + F.log(-F.expm1(-u))


def inflated(family: Family, layers: int, q: Column, odds: Column) -> Law:
    """The zero-inflated law with occupation odds `odds` * (e^u - 1), computed through logarithms."""
    plain = Law(family, layers, q)
    pi = F.when((q <= 0) | (odds <= 0), F.lit(0.0)).otherwise(F.lit(1.0) / (F.exp(-(F.log(odds) + log_growth(plain))) + 1))
    return Law(family, layers, q, pi)


def conditional(upper: Column, lower: Column, occupation: Column) -> tuple[Column, Column]:
    """p-values of an observed (positive) weight given that the pair is occupied."""
    up = F.when(occupation <= 0, F.lit(1.0)).otherwise(F.least(upper / occupation, F.lit(1.0)))
    low = F.when(occupation <= 0, F.lit(1.0)).otherwise(clamp((lower - (F.lit(1.0) - occupation)) / occupation))
    return up, low


def uniform(seed: int, *keys) -> Column:
    """Counter-based uniform in (0, 1): 52 bits of the md5 of seed and keys, whatever the partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Planar metres of degrees (spherical Web Mercator, latitudes cut at 85.05112878)."""
    radius, limit = 6_378_137.0, 85.05112878
    cut = F.least(F.greatest(lat, F.lit(-limit)), F.lit(limit))
    return F.radians(lon) * radius, F.log(F.tan(F.radians(cut) / 2 + 0.7853981633974483)) * radius
