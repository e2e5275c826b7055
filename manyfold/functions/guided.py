"""Proposals of a tree-structured Parzen search, from the trials of a key seen so far.

The trials of a key are parted into a good share and the rest. Each parameter has one density over the
good values and one over the others; candidates are drawn from the first, and the one with the largest
ratio of the two is proposed.

The rule comes twice: as expressions over a table of trials, and as :class:`Search` for a task that holds a
whole group and goes on from trial to trial without another job. Both draw the same numbers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

from manyfold.functions.draws import Choice, IntRange, normal, uniform

# Fixed values of the search: the share of good trials and its cap, and candidates per proposal.
GOOD_SHARE = 0.1
GOOD_CAP = 25
CANDIDATES = 24
START_TRIALS = 10


def coded_value(param, value: Column) -> Column:
    """The position of a value on the axis of its parameter."""
    return (param.index_of(value) if isinstance(param, Choice) else value).cast("double")


def _width(param) -> float:
    return float(len(param.values)) if isinstance(param, Choice) else float(param.high - param.low + 1)


def _bandwidth(param, seen: Column) -> Column:
    return F.lit(_width(param)) / F.least(F.lit(100.0), F.size(seen) + F.lit(1.0))


def candidate(param, good: Column, seed: int, *parts) -> Column:
    """A draw near one of the good values, or from the whole range as often as one good value."""
    pick = F.floor(uniform(seed, *parts, F.lit("pick")) * (F.size(good) + F.lit(1.0))).cast("int")
    anywhere = uniform(seed, *parts, F.lit("any"))
    centre = F.get(good, pick)
    if isinstance(param, Choice):
        # A good choice is taken as it is; any other choice comes from the uniform share.
        return F.when(centre.isNotNull(), centre).otherwise(F.floor(anywhere * F.lit(_width(param))))
    near = F.round(centre + _bandwidth(param, good) * normal(seed, *parts, F.lit("step")))
    inside = F.greatest(F.lit(float(param.low)), F.least(F.lit(float(param.high)), near))
    return F.when(centre.isNotNull(), inside).otherwise(
        F.lit(float(param.low)) + F.floor(anywhere * F.lit(_width(param)))
    )


def density(param, value: Column, seen: Column) -> Column:
    """Up to a constant factor: one share for the whole range and one for every value seen."""
    if isinstance(param, Choice):
        share = F.size(F.filter(seen, lambda s: s == value)) + F.lit(1.0 / _width(param))
    else:
        h = _bandwidth(param, seen)
        peak = h * F.lit(2.5066282746310002)  # the square root of two pi
        bumps = F.transform(seen, lambda s: F.exp(-(value - s) * (value - s) / (F.lit(2.0) * h * h)) / peak)
        share = F.aggregate(bumps, F.lit(1.0 / _width(param)), lambda total, b: total + b)
    return share / (F.size(seen) + F.lit(1.0))


def good_trials(trial: int) -> int:
    """How many of the trials before this one make the good share."""
    return min(GOOD_CAP, -(-trial // int(1 / GOOD_SHARE)))


def decoded(param, code: Column) -> Column:
    return param.value_at(code.cast("int")) if isinstance(param, Choice) else code.cast(param.kind)


def _number(head, tail: bytes) -> float:
    """The draw named by a beginning, already hashed, and an ending."""
    digest = head.copy()
    digest.update(tail)
    return (int.from_bytes(digest.digest()[:7], "big") >> 4) / float(1 << 52)


def _numbers(head, tails: list[bytes], where: np.ndarray) -> np.ndarray:
    return np.array([_number(head, tails[k]) for k in where.tolist()])


PICK, ANY, RADIUS, ANGLE = (
    [f"|{k}|{what}".encode() for k in range(CANDIDATES)] for what in ("pick", "any", "step|r", "step|a")
)


@dataclass(frozen=True)
class Search:
    """The trials of single groups: ``space`` by name, and the numbers of the trials to propose."""

    space: dict
    rounds: range

    def most_trees(self) -> int:
        """No trial has more trees."""
        param = self.space["n_estimators"]
        return max(param.values) if isinstance(param, Choice) else param.high

    def code(self, name: str, value) -> float:
        """The position on the parameter's axis; a missing value is that of ``None``."""
        param = self.space[name]
        if isinstance(param, Choice):
            return float(param.values.index(None if np.isnan(value) else value))
        return float(value)

    def _best_choice(self, param: Choice, good: list[int], rest: list[int], head) -> int:
        """The first of the best candidates. No more of them are drawn once one is as good as any value could be."""
        width, best = _width(param), None
        one, other = ([(seen.count(v) + 1.0 / width) / (len(seen) + 1.0) for v in range(len(param.values))] for seen in (good, rest))
        ratio = [g / r for g, r in zip(one, other)]
        most = max(ratio)
        for k in range(CANDIDATES):
            pick = int(_number(head, PICK[k]) * (len(good) + 1.0))
            value = good[pick] if pick < len(good) else int(_number(head, ANY[k]) * width)
            if best is None or ratio[value] > ratio[best]:
                best = value
            if ratio[best] == most:
                break
        return best

    def _candidates(self, param: IntRange, good: np.ndarray, head) -> np.ndarray:
        pick = (_numbers(head, PICK, np.arange(CANDIDATES)) * (len(good) + 1.0)).astype(int)
        out = np.empty(CANDIDATES)
        free, near = np.flatnonzero(pick >= len(good)), np.flatnonzero(pick < len(good))
        out[free] = param.low + np.floor(_numbers(head, ANY, free) * _width(param))
        radius = np.sqrt(-2.0 * np.log(1.0 - _numbers(head, RADIUS, near)))
        step = radius * np.cos(6.283185307179586 * _numbers(head, ANGLE, near))
        at = good[pick[near]] + _width(param) / min(100.0, len(good) + 1.0) * step
        # Halves are rounded away from zero.
        out[near] = np.clip(np.copysign(np.floor(np.abs(at) + 0.5), at), param.low, param.high)
        return out

    def _density(self, param: IntRange, at: np.ndarray, seen: np.ndarray) -> np.ndarray:
        h = _width(param) / min(100.0, len(seen) + 1.0)
        gap = at[:, None] - seen
        bumps = np.exp(-gap * gap / (2.0 * h * h)) / (h * 2.5066282746310002)
        # One after the other, as the table's rule adds them.
        total = np.cumsum(np.column_stack([np.full(len(at), 1.0 / _width(param)), bumps]), axis=1)[:, -1]
        return total / (len(seen) + 1.0)

    def propose(self, tried: dict[str, np.ndarray], errors: np.ndarray, label: str, trial: int, seed: int) -> dict:
        """The next trial of a group, from the coded values and the errors of its trials, in order of trial."""
        order = np.argsort(errors, kind="stable")  # a missing error is NaN and comes last
        good, rest = np.split(order, [good_trials(trial)])
        chosen = {}
        for name, param in self.space.items():
            g, r = np.sort(tried[name][good]), np.sort(tried[name][rest])
            head = hashlib.md5("|".join(str(x) for x in (seed, label, trial, name)).encode())
            if isinstance(param, Choice):
                value = param.values[self._best_choice(param, *(list(map(int, side)) for side in (g, r)), head)]
            else:
                at = self._candidates(param, g, head)
                value = int(at[np.argmax(self._density(param, at, g) / self._density(param, at, r))])
            chosen[name] = np.nan if value is None else value
        return chosen
