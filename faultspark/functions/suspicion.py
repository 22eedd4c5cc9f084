"""Suspiciousness of a statement from its four counters, as Column expressions.

Counters: ef and ep are failing and passing tests that execute the statement,
nf and np those that don't. Divisions are guarded, so ANSI mode never raises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def _ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(otherwise))


def tarantula(ef, ep, nf, np):
    failed, passed = _ratio(ef, ef + nf), _ratio(ep, ep + np)
    return _ratio(failed, failed + passed)


def ochiai(ef, ep, nf, np):
    return _ratio(ef, F.sqrt((ef + nf) * (ef + ep)))


def jaccard(ef, ep, nf, np):
    return _ratio(ef, ef + nf + ep)


def dstar(ef, ep, nf, np):
    """D* with exponent two; infinite for a statement that all failing tests and no passing ones execute."""
    unlike = ep + nf
    return F.when(unlike > 0, ef * ef / F.when(unlike > 0, unlike)).when(ef > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def gp19(ef, ep, nf, np):
    """Zero, and not NaN, for statements that no test executes."""
    runs = 2.0 * ep + ef
    return F.when((ef + nf > 0) & (runs > 0), ef * (1.0 + 1.0 / F.when(runs > 0, runs))).otherwise(F.lit(0.0))


def barinel(ef, ep, nf, np):
    return F.when(ef + ep > 0, 1.0 - ef / F.greatest(ef + nf, F.lit(1.0))).otherwise(F.lit(0.0))


def crosstab(ef, ep, nf, np):
    total = ef + ep + nf + np
    expected = _ratio((ef + ep) * (ef + nf), total)
    return _ratio(F.abs(ef - expected), F.sqrt(expected))


def zoltar(ef, ep, nf, np):
    return F.when(ef > 0, ef / (ef + nf + ep + 10000.0 * nf * ep / F.when(ef > 0, ef))).otherwise(F.lit(0.0))


def ample(ef, ep, nf, np):
    failed, passed = ef + nf, ep + np
    both = F.abs(_ratio(ef, failed) - _ratio(ep, passed))
    return F.when((failed > 0) & (passed > 0), both).otherwise(_ratio(ef, failed))


METRICS: dict[str, Callable] = {f.__name__: f for f in (tarantula, ochiai, jaccard, dstar, gp19, barinel, crosstab, zoltar, ample)}


def score(metric: str, ef="a_ef", ep="a_ep", nf="a_nf", np="a_np") -> Column:
    """The metric by name over counter columns, as a double."""
    return METRICS[metric](*(F.col(c).cast("double") for c in (ef, ep, nf, np)))
