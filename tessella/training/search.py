"""Parameter search: grids, guided products, random draws that narrow around the best."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Mapping, Sequence
from typing import Any


def grid(ranges: Mapping[str, tuple[float, float]], max_round: int) -> list[dict[str, float]]:
    """Equal steps in every range, as many as fit max_round points in all."""
    steps = max(1, int(round(max_round ** (1 / max(1, len(ranges))) - 1e-9)))
    axes = [[lo + (hi - lo) * i / max(1, steps - 1) for i in range(steps)] for lo, hi in ranges.values()]
    return [dict(zip(ranges, p, strict=True)) for p in itertools.product(*axes)][:max_round]


def guided(choices: Mapping[str, Sequence[Any]], max_round: int, seed: int = 1) -> list[dict[str, Any]]:
    """The product of all choices, or a random subset of max_round."""
    every = [dict(zip(choices, p, strict=True)) for p in itertools.product(*choices.values())]
    return every if len(every) <= max_round else random.Random(seed).sample(every, max_round)


def draw(spec: Mapping[str, Sequence[float]], rng: random.Random) -> dict[str, float]:
    """One value is fixed, two are a range, more are choices."""
    return {k: v[0] if len(v) == 1 else rng.uniform(*v) if len(v) == 2 else rng.choice(list(v)) for k, v in spec.items()}


def narrowed(spec: Mapping[str, Sequence[float]], best: Mapping[str, float], ratio: float) -> dict[str, Sequence[float]]:
    """Ranges of ``ratio`` their width around the best, within the old ones."""
    out: dict[str, Sequence[float]] = {}
    for k, v in spec.items():
        half = (v[1] - v[0]) * ratio / 2 if len(v) == 2 else 0.0
        out[k] = (max(v[0], best[k] - half), min(v[1], best[k] + half)) if len(v) == 2 else v
    return out


def monte_carlo(spec: Mapping[str, Sequence[float]], loss: Callable[[dict[str, float]], float], rounds: int, *, tolerance: float = 0.0, min_loss: float = float("-inf"), seed: int = 1) -> tuple[dict[str, float], float]:
    """The best of random draws; stops early when the gain is below the tolerance and the loss below min_loss."""
    rng, best, least = random.Random(seed), {}, float("inf")
    for _ in range(rounds):
        p = draw(spec, rng)
        now = loss(p)
        if now < least:
            gain, best, least = least - now, p, now
            if gain < tolerance and least < min_loss:
                break
    return best, least
