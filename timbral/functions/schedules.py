"""Closed forms of learning-rate and margin schedules, as functions of a step column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def warm_up(step: Column, warm_steps: int) -> Column:
    return F.least(step / max(1, warm_steps), F.lit(1.0)) if warm_steps else F.lit(1.0)


def exponential(step: Column, initial: float, final: float, steps: int, warm_steps: int = 0) -> Column:
    return warm_up(step, warm_steps) * initial * F.exp(step / steps * math.log(final / initial))


def cosine(step: Column, high: float, low: float, warm_steps: int, fixed: int) -> Column:
    """Linear up to high over warm_steps, half a cosine down to low at fixed, low from there on."""
    fall = low + 0.5 * (high - low) * (1 + F.cos(F.lit(math.pi) * (step - warm_steps) / max(1, fixed - warm_steps)))
    return F.when(step < warm_steps, high * step / max(1, warm_steps)).when(step < fixed, fall).otherwise(low)


def stepped(step: Column, initial: float, warm_steps: int, decay_steps: int, gamma: float) -> Column:
    """Linear warm-up, then a factor of gamma for each decay_steps."""
    return initial * F.when(step < warm_steps, (step + 1) / (warm_steps + 1)).otherwise(F.pow(F.lit(gamma), F.floor((step - warm_steps) / decay_steps)) if decay_steps > 0 else F.lit(1.0))


def triangular2(step: Column, low: float, high: float, half_cycle: int) -> Column:
    """A saw between the bounds whose height halves with each cycle."""
    cycle = F.floor(1 + step / (2 * half_cycle))
    x = F.abs(step / half_cycle - 2 * cycle + 1)
    return low + (high - low) * F.greatest(F.lit(0.0), 1 - x) / F.pow(F.lit(2.0), cycle - 1)


def margin(step: Column, start: int, fixed: int, initial: float, final: float, kind: str = "exp") -> Column:
    """initial before start, final from fixed on, a curve between them."""
    span = max(1, fixed - start)
    t = (step - start) / span
    grown = 1 - F.exp(t * math.log(1e-3 / (1 + 1e-6))) if kind == "exp" else t
    return F.when(step >= fixed, final).when(step < start, initial).otherwise(initial + (final - initial) * grown)
