"""Effect sizes and their verbal classes."""

from __future__ import annotations

import math

# Upper bounds of negligible, small and medium by kind of effect.
BANDS = {
    "cohens_d": (0.2, 0.5, 0.8),
    "eta_squared": (0.01, 0.06, 0.14),
    "omega_squared": (0.01, 0.06, 0.14),
    "epsilon_squared": (0.01, 0.06, 0.14),
    "cramers_v": (0.1, 0.3, 0.5),
    "r": (0.1, 0.3, 0.5),
    "rank_biserial": (0.1, 0.3, 0.5),
    "r_squared": (0.01, 0.09, 0.25),
}


def classify_effect(value: float, effect_type: str) -> str:
    for bound, word in zip(BANDS.get(effect_type, BANDS["cohens_d"]), ("negligible", "small", "medium"), strict=True):
        if abs(value) < bound:
            return word
    return "large"


def d_from(diff: float, sd: float) -> float | None:
    return diff / sd if sd > 0 else None


def pooled_sd(n1: int, v1: float, n2: int, v2: float) -> float:
    return math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) if n1 + n2 > 2 else 0.0


def eta_squared(ss_between: float, ss_total: float) -> float:
    return ss_between / ss_total if ss_total > 0 else 0.0


def omega_squared(ss_between: float, ss_total: float, df_between: float, ms_within: float) -> float:
    return max(0.0, (ss_between - df_between * ms_within) / (ss_total + ms_within)) if ss_total + ms_within > 0 else 0.0


def partial_eta_squared(ss_effect: float, ss_error: float) -> float:
    return ss_effect / (ss_effect + ss_error) if ss_effect + ss_error > 0 else 0.0


def cramers_v(chi2: float, n: float, min_dim: int) -> float:
    return math.sqrt(chi2 / (n * (min_dim - 1))) if n > 0 and min_dim > 1 else 0.0


def rank_biserial(u: float, n1: int, n2: int) -> float:
    return 1 - 2 * u / (n1 * n2) if n1 * n2 else 0.0


def epsilon_squared(h: float, n: int) -> float:
    return h / (n - 1) if n > 1 else 0.0
