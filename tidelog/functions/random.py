"""Repeatable generators: shift registers of 64 bits and Zipf picks, the same on every run and engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the generators.
SHIFTS = (13, 7, 17)  # left, right, left
STAR_SHIFTS = (12, 25, 27)  # right, left, right
STAR_FACTOR = 0x2545F4914F6CDD1D
THETA = 0.99
MOST_RECORDS = 1 << 24  # the table of a Zipf pick is computed in every worker: 128 MB at most

_HALF = 0xFFFFFFFF


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_HALF))


def _join(high: Column, low: Column) -> Column:
    return F.shiftleft(_low(high), 32).bitwiseOR(_low(low))


def _plus(a: Column, b: Column) -> Column:
    """The sum modulo 2^64."""
    low = _low(a) + _low(b)
    return _join(_high(a) + _high(b) + _high(low), low)


def times(a: Column, factor: int) -> Column:
    """The product modulo 2^64, by 16 bits of the factor at a time so that no step overflows."""
    out = F.lit(0).cast("long")
    for i in range(4):
        digit = factor >> 16 * i & 0xFFFF
        low = _low(a) * digit
        out = _plus(out, F.shiftleft(_join(_high(a) * digit + _high(low), low), 16 * i))
    return out


def _steps(state: Column, moves: tuple) -> Column:
    """Each step is a let: the state is named once, however often it is used."""

    def moved(move: Callable[[Column, int], Column], n: int) -> Callable[[Column], Column]:
        return lambda x: x.bitwiseXOR(move(x, n))

    for move, n in moves:
        state = F.element_at(F.transform(F.array(state), moved(move, n)), 1)
    return state


def xorshift(state: Column) -> Column:
    """The next state, as the signed long of its bits; state 0 stays 0."""
    a, b, c = SHIFTS
    return _steps(state, ((F.shiftleft, a), (F.shiftrightunsigned, b), (F.shiftleft, c)))


def xorshift_star(state: Column) -> Column:
    """The next state; what is drawn is times(state, STAR_FACTOR)."""
    a, b, c = STAR_SHIFTS
    return _steps(state, ((F.shiftrightunsigned, a), (F.shiftleft, b), (F.shiftrightunsigned, c)))


def nth(state: Column, n: Column, step=xorshift) -> Column:
    """The state after n steps."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), state, lambda s, _: step(s))).otherwise(state)


def below(drawn: Column, n: int) -> Column:
    """The draw, read as unsigned, modulo n < 2^31."""
    return F.pmod(F.pmod(_high(drawn), F.lit(n)) * F.lit((1 << 32) % n) + _low(drawn), F.lit(n))


def uniform(drawn: Column) -> Column:
    """The upper 53 bits as a number from 0 to less than 1."""
    return F.shiftrightunsigned(drawn, 11) / F.lit(float(1 << 53))


def zipf_pick(u: Column, latest: Column, records: int, theta: float = THETA) -> Column:
    """Records picked by uniform numbers u: rank i of the newest min(latest, records) has weight (i + 1)^-theta, and ranks count up from the first of them."""
    if not 0 < records <= MOST_RECORDS:
        raise ValueError(f"between 1 and {MOST_RECORDS} records")

    @F.pandas_udf("long")
    def pick(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weights = np.cumsum(1.0 / np.arange(1, records + 1, dtype=np.float64) ** theta)
        table = weights / weights[-1]
        for us, latests in batches:
            window = np.clip(latests.to_numpy(np.int64), 1, records)
            rank = np.searchsorted(table, us.to_numpy(np.float64) * table[window - 1], side="left")
            yield pd.Series(records - window + np.minimum(rank, window - 1))

    return pick(u, latest)
