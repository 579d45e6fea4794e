"""Statistics that Spark has no function for."""

from __future__ import annotations

from math import exp, lgamma

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fisher(a: int, n1: int, b: int, n2: int) -> float:
    """Two-sided exact p of a of n1 against b of n2: all tables with the same margins that are no likelier than this one.

    Likelihoods rise to one mode and fall after it, so the tables that count are two
    tails.  Each is found by bisection and summed outwards until nothing is added: some
    multiples of the deviation, not all tables.  Two within 1e-7 are as likely.
    """
    if min(n1, n2) <= 0:
        return 1.0
    hits = a + b
    low, high = max(0, hits - n2), min(n1, hits)

    def log(k: int) -> float:
        return -lgamma(k + 1) - lgamma(n1 - k + 1) - lgamma(hits - k + 1) - lgamma(n2 - hits + k + 1)

    mode = min(max((hits + 1) * (n1 + 1) // (n1 + n2 + 2), low), high)
    bar = log(a) + 1e-7
    if log(mode) <= bar:
        return 1.0
    total = lgamma(n1 + 1) + lgamma(n2 + 1) + lgamma(hits + 1) + lgamma(n1 + n2 - hits + 1) - lgamma(n1 + n2 + 1)

    def tail(end: int, step: int) -> float:
        """The sum of the tables beyond the mode in one direction."""
        near, far = mode, end + step  # near doesn't count, far does or is outside
        while abs(far - near) > 1:
            k = (near + far) // 2
            near, far = (near, k) if log(k) <= bar else (k, far)
        if far == end + step:
            return 0.0
        k, term = far, exp(log(far) + total)
        out = 0.0
        while (k - end) * step <= 0 and term > out * 1e-18:
            out += term
            if step < 0:
                term *= k * (n2 - hits + k) / ((n1 - k + 1) * (hits - k + 1))
            else:
                term *= (n1 - k) * (hits - k) / ((k + 1) * (n2 - hits + k + 1))
            k += step
        return out

    return min(1.0, tail(low, -1) + tail(high, 1))


@F.arrow_udf(T.DoubleType())
def fisher_p(a: pa.Array, n1: pa.Array, b: pa.Array, n2: pa.Array) -> pa.Array:
    rows = zip(*[x.to_pylist() for x in (a, n1, b, n2)], strict=True)
    return pa.array([None if None in r else fisher(*r) for r in rows], pa.float64())
