"""Ordered rule lists, induced by incremental reduced-error pruning, as SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold!r}"


@dataclass
class RuleList:
    """Rules in order, the first that holds decides; ``default`` where none does."""

    rules: list[tuple[tuple[Condition, ...], str]] = field(default_factory=list)
    default: str = ""

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        out, left = np.full(n, self.default, object), np.ones(n, bool)
        for conditions, kind in self.rules:
            hit = left & _covered(conditions, x)
            out[hit], left = kind, left & ~hit
        return out

    def sql(self) -> str:
        """A CASE expression over the features' columns."""
        if not self.rules:
            return f"'{self.default}'"
        return "CASE " + " ".join(f"WHEN {' AND '.join(c.sql() for c in cs)} THEN '{k}'" for cs, k in self.rules) + f" ELSE '{self.default}' END"


def _covered(conditions, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in conditions:
        out &= c.holds(x)
    return out


def _thresholds(values: np.ndarray, most: int) -> np.ndarray:
    distinct = np.unique(values)
    if len(distinct) < 2:
        return np.empty(0)
    middle = (distinct[1:] + distinct[:-1]) / 2
    return middle if len(middle) <= most else middle[np.linspace(0, len(middle) - 1, most).astype(int)]


def _grow(x: dict[str, np.ndarray], y: np.ndarray, candidates: dict[str, np.ndarray]) -> tuple[Condition, ...]:
    """Add the condition of the greatest information gain until no other class is covered."""
    chosen: list[Condition] = []
    inside = np.ones(len(y), bool)
    while (inside & ~y).any() and len(chosen) < 6:
        p0, n0 = (inside & y).sum(), (inside & ~y).sum()
        base, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-9
        for name, cuts in candidates.items():
            if not len(cuts):
                continue
            value = x[name]
            for above in (True, False):
                hit = inside & ((value[None, :] >= cuts[:, None]) if above else (value[None, :] < cuts[:, None]))
                p, n = (hit & y).sum(1), (hit & ~y).sum(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1)
                k = int(np.argmax(g))
                if g[k] > gain:
                    # of equally good cuts the middle one, farthest from either side
                    same = np.flatnonzero(g >= g[k] - 1e-12)
                    gain, best = g[k], Condition(name, above, round(float(cuts[same[len(same) // 2]]), 6))
        if best is None:
            break
        chosen.append(best)
        inside &= best.holds(x)
    return tuple(chosen)


def _prune(conditions: tuple[Condition, ...], x: dict[str, np.ndarray], y: np.ndarray) -> tuple[Condition, ...]:
    """The beginning of the conditions with the best worth on documents that the rule wasn't grown on."""

    def worth(cs) -> float:
        hit = _covered(cs, x)
        p, n = (hit & y).sum(), (hit & ~y).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((conditions[: k + 1] for k in range(len(conditions))), key=lambda cs: (worth(cs), -len(cs)))


def induce(x: dict[str, np.ndarray], labels: np.ndarray, order: list[str], default: str, seed: int = 7, cuts: int = 32, least: float = 0.9) -> RuleList:
    """Rules for each class of ``order`` in turn: grown on two thirds of what is left, pruned on one third,
    and kept while at least the share ``least`` of what they cover there is of the class."""
    rng, out = np.random.default_rng(seed), RuleList(default=default)
    left = np.ones(len(labels), bool)
    for kind in order:
        while (left & (labels == kind)).sum() >= 3:
            at = np.flatnonzero(left)
            grown = np.zeros(len(labels), bool)
            for side in (labels[at] == kind, labels[at] != kind):
                part = rng.permutation(at[side])
                grown[part[: max(1, len(part) * 2 // 3)]] = True
            g, p = left & grown, left & ~grown
            sub = lambda m: {k: v[m] for k, v in x.items()}
            xs = sub(g)
            rule = _grow(xs, labels[g] == kind, {k: _thresholds(v, cuts) for k, v in xs.items()})
            if not rule:
                break
            rule = _prune(rule, sub(p), labels[p] == kind)
            hit = _covered(rule, x)
            good, bad = (hit & p & (labels == kind)).sum(), (hit & p & (labels != kind)).sum()
            if good == 0 or good < least * (good + bad):
                break
            out.rules.append((rule, kind))
            left &= ~hit
    return out
