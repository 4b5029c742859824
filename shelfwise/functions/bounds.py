"""Exact bounds of shares as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.measures import bound

#: Halvings of the interval; 50 leave less than 1e-15 of it.
HALVINGS = 50


def _log_factorial(n: Column) -> Column:
    """Logarithm of n!: Stirling's series, whose error is below 1e-15 from 20 on, and the product itself below."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(x * 2 * math.pi) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(n < 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _at_most(hits: Column, tries: Column, ways: Column, p: Column) -> Column:
    """Probability of at most so many hits, for p from hits / tries on: terms of the binomial distribution from hits down.

    ways is the logarithm of the number of ways to hit so often. Term j is at most exp(-j (j - 1) / (2 hits)) of the first,
    so those after 10 roots of hits are below 1e-21 of it and change no digit of the sum.
    """
    odds = (1 - p) / p
    first = F.exp(ways + hits * F.log(p) + (tries - hits) * F.log(1 - p))
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] * ((hits - j + 1) / (tries - hits + j)) * odds
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    most = F.least(hits, F.ceil(10 * F.sqrt(hits)) + 2)
    js = F.when(hits >= 1, F.sequence(F.lit(1).cast("long"), most)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(js, start, add, lambda s: s["sum"])


def binomial_upper(hits: Column, tries: Column, level: float = 0.95) -> Column:
    """One-sided exact upper bound of a share when so many of the tries hit (Clopper-Pearson), by bisection.

    1 where every try hits or there is none; null where hits or tries is null. A bound takes HALVINGS times a few roots of hits steps.
    """
    hits, tries = hits.cast("long"), tries.cast("long")
    start = F.struct((hits / tries).cast("double").alias("low"), F.lit(1.0).alias("high"))

    def search(ways: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            return bound(((s["low"] + s["high"]) / 2), lambda middle: half(s, middle))

        def half(s: Column, middle: Column) -> Column:
            more = F.when(middle <= 0, True).when(middle >= 1, False).otherwise(_at_most(hits, tries, ways, middle) > 1 - level)
            return bound(more, lambda up: F.struct(F.when(up, middle).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(middle).alias("high")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: s["high"])

    upper = bound(_log_factorial(tries) - _log_factorial(hits) - _log_factorial(tries - hits), search)
    return F.when(hits.isNull() | tries.isNull(), None).when((tries <= 0) | (hits >= tries), 1.0).otherwise(upper)
