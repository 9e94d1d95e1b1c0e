"""Glicko-2: column expressions for single formulas, and the state update as a small function for the fold.

The update is that of the published Glicko-2 description (Glickman, "Example of
the Glicko-2 system"): its worked example is in the tests.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The rating system's defaults.
SCALE = 173.7178
INITIAL_RATING, INITIAL_DEVIATION, INITIAL_VOLATILITY = 1500.0, 350.0, 0.06
TAU, TOLERANCE, PERIOD_DAYS = 0.5, 1e-6, 28
MIN_MATCHES, MAX_DEVIATION, MIN_OPPONENTS, MAX_INACTIVE_DAYS = 10, 110.0, 3, 365


@dataclass(frozen=True)
class State:
    rating: float = INITIAL_RATING
    deviation: float = INITIAL_DEVIATION
    volatility: float = INITIAL_VOLATILITY


def inflate(s: State, days: float) -> State:
    """Deviation grown over days without a match, up to the initial one."""
    phi, top = s.deviation / SCALE, INITIAL_DEVIATION / SCALE
    return State(s.rating, SCALE * min(top, math.sqrt(phi * phi + s.volatility**2 * max(0.0, days) / PERIOD_DAYS)), s.volatility)


def _g(phi: float) -> float:
    return 1 / math.sqrt(1 + 3 * phi * phi / math.pi**2)


def update(s: State, seen: list[tuple[float, float, float]]) -> State:
    """The state after one period of (opponent's rating, opponent's deviation, score)."""
    if not seen:
        return s
    information = gain = 0.0
    for rating, deviation, score in seen:
        g = _g(deviation / SCALE)
        e = 1 / (1 + math.exp(-g * (s.rating - rating) / SCALE))
        information += g * g * e * (1 - e)
        gain += g * (score - e)
    return settled(s, information, gain)


def settled(s: State, information: float, gain: float) -> State:
    """The state after a period whose matches sum to so much information (g^2 E (1 - E)) and gain (g (score - E))."""
    mu, phi, v = (s.rating - INITIAL_RATING) / SCALE, s.deviation / SCALE, 1 / information
    delta, a = v * gain, math.log(s.volatility**2)

    def f(x: float) -> float:
        ex = math.exp(x)
        return ex * (delta**2 - phi**2 - v - ex) / (2 * (phi**2 + v + ex) ** 2) - (x - a) / TAU**2

    low = a
    if delta**2 > phi**2 + v:
        high = math.log(delta**2 - phi**2 - v)
    else:
        k = 1
        while f(a - k * TAU) < 0:
            k += 1
        high = a - k * TAU
    f_low, f_high = f(low), f(high)
    while abs(high - low) > TOLERANCE:
        mid = low + (low - high) * f_low / (f_high - f_low)
        f_mid = f(mid)
        if f_mid * f_high <= 0:
            low, f_low = high, f_high
        else:
            f_low /= 2
        high, f_high = mid, f_mid
    volatility = math.exp(low / 2)
    wide = math.sqrt(phi**2 + volatility**2)
    narrow = 1 / math.sqrt(1 / wide**2 + 1 / v)
    return State(INITIAL_RATING + SCALE * (mu + narrow**2 * gain), SCALE * narrow, volatility)


def settled_all(rating: np.ndarray, deviation: np.ndarray, volatility: np.ndarray, information: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`settled` for many players at once: each one's steps are the same as there, and a player is done when theirs are."""
    mu, phi2, v = (rating - INITIAL_RATING) / SCALE, (deviation / SCALE) ** 2, 1 / information
    delta2, a = (v * gain) ** 2, np.log(volatility**2)

    def f(x: np.ndarray, i) -> np.ndarray:
        ex = np.exp(x)
        return ex * (delta2[i] - phi2[i] - v[i] - ex) / (2 * (phi2[i] + v[i] + ex) ** 2) - (x - a[i]) / TAU**2

    over = delta2 > phi2 + v
    low, high = a.copy(), np.where(over, np.log(np.where(over, delta2 - phi2 - v, 1.0)), a - TAU)
    i, k = np.flatnonzero(~over), 1
    while len(i := i[f(high[i], i) < 0]):
        k += 1
        high[i] = a[i] - k * TAU
    f_low, f_high = f(low, slice(None)), f(high, slice(None))
    i = np.flatnonzero(abs(high - low) > TOLERANCE)
    while len(i):
        lo, hi, f_lo, f_hi = low[i], high[i], f_low[i], f_high[i]
        mid = lo + (lo - hi) * f_lo / (f_hi - f_lo)
        f_mid = f(mid, i)
        crossed = f_mid * f_hi <= 0
        low[i], f_low[i] = np.where(crossed, hi, lo), np.where(crossed, f_hi, f_lo / 2)
        high[i], f_high[i] = mid, f_mid
        i = i[abs(high[i] - low[i]) > TOLERANCE]
    new = np.exp(low / 2)
    narrow = 1 / np.sqrt(1 / (phi2 + new**2) + 1 / v)
    return INITIAL_RATING + SCALE * (mu + narrow**2 * gain), SCALE * narrow, new


def g_of(deviation: Column) -> Column:
    return 1 / F.sqrt(1 + 3 * F.pow(deviation / SCALE, F.lit(2)) / math.pi**2)


def expected_score(rating: Column, other: Column, other_deviation: Column) -> Column:
    """The chance of beating an opponent of that rating and deviation."""
    return 1 / (1 + F.exp(-g_of(other_deviation) * (rating - other) / SCALE))


def inflated_deviation(deviation: Column, volatility: Column, days: Column) -> Column:
    grown = F.sqrt(F.pow(deviation / SCALE, F.lit(2)) + volatility * volatility * F.greatest(days, F.lit(0)) / PERIOD_DAYS)
    return SCALE * F.least(F.lit(INITIAL_DEVIATION / SCALE), grown)


def predicted(r1: Column, d1: Column, r2: Column, d2: Column) -> Column:
    """A symmetric chance that the first wins: the mean of both points of view."""
    return (expected_score(r1, r2, d2) + 1 - expected_score(r2, r1, d1)) / 2


def eligibility(critical: Column, matches: Column, opponents: Column, days: Column, deviation: Column) -> Column:
    """Why a player is not ranked; "ranked" if they are.  The first that holds counts."""
    return F.when(critical, "critical_data_issue").when(matches < MIN_MATCHES, "insufficient_matches").when(opponents < MIN_OPPONENTS, "insufficient_opponents").when(days > MAX_INACTIVE_DAYS, "inactive").when(deviation > MAX_DEVIATION, "high_uncertainty").otherwise("ranked")


def confidence(deviation: Column, *provisional: Column) -> Column:
    """How far a rating can be trusted; low for a provisional one."""
    out = F.when(deviation <= 70, "high").when(deviation <= 120, "medium").otherwise("low")
    for p in provisional:
        out = F.when(p, "low").otherwise(out)
    return out


def is_provisional(matches: Column, deviation: Column) -> Column:
    return (matches < MIN_MATCHES) | (deviation > MAX_DEVIATION)


def attributed_change(opponent_deviation: Column, deviation_after: Column, surprise: Column) -> Column:
    """What one match adds to the period's change of rating: the shares of all its matches add up to the whole."""
    return F.pow(deviation_after, F.lit(2)) / SCALE * g_of(opponent_deviation) * surprise


def information(expected: Column, opponent_deviation: Column) -> Column:
    """What one match tells of the rating."""
    return F.pow(g_of(opponent_deviation), F.lit(2)) * expected * (1 - expected)
