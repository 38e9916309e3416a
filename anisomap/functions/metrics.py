"""Direction-dependent lengths F(u) = r * phi(s), with r = |u| and s the cosine with the last axis.

Every metric gives Catalyst expressions (``length_col``, ``grad_col``) and NumPy twins (``length``, ``grad``) that the
optimizers use. Where a direction is forbidden the column is NULL and the NumPy value infinite.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from anisomap.functions.vectors import EPS, norm


class Metric:
    """Subclasses give phi and its derivative as columns and as arrays."""

    def phi_col(self, s: Column) -> Column:
        raise NotImplementedError

    def dphi_col(self, s: Column) -> Column:
        raise NotImplementedError

    def phi(self, s: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def dphi(self, s: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def length_col(self, u: Column) -> Column:
        r, s = _split_col(u)
        return F.when(r <= EPS, F.lit(0.0)).otherwise(r * self.phi_col(s))

    def grad_col(self, u: Column) -> Column:
        """Gradient of the length by u: zero at the origin."""
        r, s = _split_col(u)
        phi, dphi, last = self.phi_col(s), self.dphi_col(s), F.size(u) - 1
        safe = F.when(r > EPS, r)
        value = F.transform(u, lambda x, i: (phi - s * dphi) * x / safe + F.when(i == last, dphi).otherwise(0.0))
        return F.when(r <= EPS, F.transform(u, lambda x: F.lit(0.0))).otherwise(value)

    def length(self, u: np.ndarray) -> np.ndarray:
        r, s = _split(u)
        with np.errstate(all="ignore"):
            return np.where(r <= EPS, 0.0, r * self.phi(s))

    def grad(self, u: np.ndarray) -> np.ndarray:
        r, s = _split(u)
        with np.errstate(all="ignore"):
            phi, dphi = self.phi(s), self.dphi(s)
            out = ((phi - s * dphi) / np.maximum(r, EPS))[..., None] * u
        out[..., -1] += dphi
        out[r <= EPS] = 0
        return out

    def pairwise(self, x: np.ndarray) -> np.ndarray:
        return self.length(x[None, :, :] - x[:, None, :])


def _split_col(u: Column) -> tuple[Column, Column]:
    r = norm(u)
    return r, F.when(r > EPS, F.element_at(u, -1) / r).otherwise(0.0)


def _split(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = np.sqrt((u * u).sum(-1))
    return r, np.where(r > EPS, u[..., -1] / np.maximum(r, EPS), 0.0)


def _positive(value: float, name: str, strict: bool = False) -> None:
    if not np.isfinite(value) or value < 0 or (strict and value == 0):
        raise ValueError(f"{name} must be {'positive' if strict else 'at least 0'}")


@dataclass(frozen=True)
class Randers(Metric):
    """phi = 1 + alpha s, with 0 <= alpha < 1."""

    alpha: float = 0.0

    def __post_init__(self):
        if not 0 <= self.alpha < 1:
            raise ValueError("alpha must be in [0, 1)")

    def phi_col(self, s):
        return F.lit(1.0) + self.alpha * s

    def dphi_col(self, s):
        return F.lit(float(self.alpha))

    def phi(self, s):
        return 1 + self.alpha * s

    def dphi(self, s):
        return np.full_like(s, self.alpha)


@dataclass(frozen=True)
class Matsumoto(Metric):
    """phi = 1 / (1 - alpha s), forbidden where that is not positive; optionally capped at ``max_phi``."""

    alpha: float = 0.5
    max_phi: float | None = None
    forbidden_grad_norm: float | None = None

    def __post_init__(self):
        _positive(self.alpha, "alpha")
        for name in ("max_phi", "forbidden_grad_norm"):
            if getattr(self, name) is not None:
                _positive(getattr(self, name), name, strict=True)

    def phi_col(self, s):
        room = F.lit(1.0) - self.alpha * s
        value = F.when(room > 0, F.lit(1.0) / F.when(room > 0, room))
        return value if self.max_phi is None else F.least(F.coalesce(value, F.lit(float(self.max_phi))), F.lit(float(self.max_phi)))

    def dphi_col(self, s):
        room = F.lit(1.0) - self.alpha * s
        value = F.when(room > 0, self.alpha / F.when(room > 0, room * room))
        if self.max_phi is None:
            return value
        free = (room > 0) & (F.lit(1.0) / F.when(room > 0, room) < self.max_phi)
        return F.when(free, value).otherwise(0.0)

    def phi(self, s):
        room = 1 - self.alpha * s
        value = np.where(room > 0, 1 / np.where(room > 0, room, 1), np.inf)
        return value if self.max_phi is None else np.minimum(value, self.max_phi)

    def dphi(self, s):
        room = 1 - self.alpha * s
        value = np.where(room > 0, self.alpha / np.where(room > 0, room, 1) ** 2, np.nan)
        return value if self.max_phi is None else np.where(self.phi(s) < self.max_phi, value, 0.0)

    def grad(self, u):
        out = super().grad(u)
        if self.forbidden_grad_norm is not None:
            r, s = _split(u)
            bad = (1 - self.alpha * s <= 0) & (r > EPS)
            along = -s[..., None] * u / np.maximum(r, EPS)[..., None]  # direction in which s grows
            along[..., -1] += 1
            size = np.sqrt((along * along).sum(-1, keepdims=True))
            out = np.where(bad[..., None], self.forbidden_grad_norm * along / np.maximum(size, EPS), out)
        return out


@dataclass(frozen=True)
class ConvexMatsumoto(Metric):
    """1 / (1 - alpha s) up to s = 1 / (2 alpha), its tangent cone 4 alpha s beyond."""

    alpha: float = 0.5

    def __post_init__(self):
        _positive(self.alpha, "alpha")

    def _inner(self, s):
        return s * (2 * self.alpha) <= 1

    def phi_col(self, s):
        inner = self._inner(s)
        return F.when(inner, F.lit(1.0) / F.when(inner, F.lit(1.0) - self.alpha * s)).otherwise(4 * self.alpha * s)

    def dphi_col(self, s):
        inner = self._inner(s)
        return F.when(inner, self.alpha / F.when(inner, F.pow(F.lit(1.0) - self.alpha * s, F.lit(2.0)))).otherwise(F.lit(4.0 * self.alpha))

    def phi(self, s):
        return np.where(self._inner(s), 1 / np.where(self._inner(s), 1 - self.alpha * s, 1), 4 * self.alpha * s)

    def dphi(self, s):
        return np.where(self._inner(s), self.alpha / np.where(self._inner(s), 1 - self.alpha * s, 1) ** 2, 4.0 * self.alpha)


def slope(s: np.ndarray) -> np.ndarray:
    """g = s / sqrt(1 - s^2), with signed infinity at the ends."""
    rest = 1 - s * s
    return np.where(rest > EPS, s / np.sqrt(np.where(rest > EPS, rest, 1)), np.copysign(np.inf, s))


def dslope(s: np.ndarray) -> np.ndarray:
    rest = 1 - s * s
    return np.where(rest > EPS, np.where(rest > EPS, rest, 1) ** -1.5, np.inf)


def slope_col(s: Column) -> Column:
    """NULL where the slope is infinite."""
    rest = F.lit(1.0) - s * s
    return F.when(rest > EPS, s / F.sqrt(F.when(rest > EPS, rest)))


def dslope_col(s: Column) -> Column:
    rest = F.lit(1.0) - s * s
    return F.when(rest > EPS, F.pow(F.when(rest > EPS, rest), F.lit(-1.5)))


@dataclass(frozen=True)
class Tobler(Metric):
    """Walking time exp(a |g + b|) / speed at slope g."""

    a: float = 3.5
    b: float = 0.05
    speed: float = 1.0

    def __post_init__(self):
        _positive(self.a, "a")
        _positive(self.speed, "speed", strict=True)

    def phi_col(self, s):
        return F.exp(self.a * F.abs(slope_col(s) + self.b)) / self.speed

    def dphi_col(self, s):
        g = slope_col(s)
        return self.phi_col(s) * self.a * F.signum(g + self.b) * dslope_col(s)

    def phi(self, s):
        return np.exp(self.a * np.abs(slope(s) + self.b)) / self.speed

    def dphi(self, s):
        return self.phi(s) * self.a * np.sign(slope(s) + self.b) * dslope(s)


def _cubic_root(c: float) -> float:
    """The positive g with g + g^3 = c."""
    half = c / 2
    size = np.sqrt(half * half + 1 / 27)
    return float(np.cbrt(half + size) + np.cbrt(half - size))


@dataclass(frozen=True)
class ConvexTobler(Tobler):
    """Tobler's time between the two slopes where climbing per time is best; zigzag cones beyond."""

    def __post_init__(self):
        super().__post_init__()
        _positive(self.a, "a", strict=True)

    @property
    def caps(self) -> tuple[float, float, float, float]:
        """(lowest s, highest s, climb per time at the lowest, at the highest)."""
        up = _cubic_root(1 / self.a)
        down = -max(up, self.b)
        at = [g / np.sqrt(1 + g * g) for g in (down, up)]
        climb = [s / float(np.exp(self.a * abs(g + self.b)) / self.speed) for s, g in zip(at, (down, up), strict=True)]
        return float(at[0]), float(at[1]), float(climb[0]), float(climb[1])

    def phi_col(self, s):
        lo, hi, z_lo, z_hi = self.caps
        return F.when(s > hi, s / z_hi).when(s < lo, s / z_lo).otherwise(super().phi_col(s))

    def dphi_col(self, s):
        lo, hi, z_lo, z_hi = self.caps
        return F.when(s > hi, F.lit(1 / z_hi)).when(s < lo, F.lit(1 / z_lo)).otherwise(super().dphi_col(s))

    def phi(self, s):
        lo, hi, z_lo, z_hi = self.caps
        return np.where(s > hi, s / z_hi, np.where(s < lo, s / z_lo, super().phi(np.clip(s, lo, hi))))

    def dphi(self, s):
        lo, hi, z_lo, z_hi = self.caps
        return np.where(s > hi, 1 / z_hi, np.where(s < lo, 1 / z_lo, super().dphi(np.clip(s, lo, hi))))


@dataclass(frozen=True)
class Minetti(Metric):
    """Walking cost by a quintic of the slope over a power; forbidden beyond ``g_max``."""

    # The published fit of the energy cost of walking, from the fifth power of the slope down.
    coefficients: tuple[float, ...] = (155.4, -30.4, -43.3, 46.3, 19.5, 3.6)
    g_max: float = 0.45
    power: float = 3.6

    def __post_init__(self):
        _positive(self.g_max, "g_max", strict=True)
        _positive(self.power, "power", strict=True)

    def phi_col(self, s):
        g = slope_col(s)
        value = F.lit(float(self.coefficients[0]))
        for c in self.coefficients[1:]:
            value = value * g + c
        return F.when(F.abs(g) <= self.g_max, value / self.power)

    def dphi_col(self, s):
        g = slope_col(s)
        n = len(self.coefficients) - 1
        value = F.lit(float(self.coefficients[0] * n))
        for i, c in enumerate(self.coefficients[1:-1], 1):
            value = value * g + c * (n - i)
        return F.when(F.abs(g) <= self.g_max, value * dslope_col(s) / self.power)

    def phi(self, s):
        g = slope(s)
        ok = np.abs(g) <= self.g_max
        return np.where(ok, np.polyval(self.coefficients, np.where(ok, g, 0)) / self.power, np.inf)

    def dphi(self, s):
        g = slope(s)
        ok = np.abs(g) <= self.g_max
        return np.where(ok, np.polyval(np.polyder(self.coefficients), np.where(ok, g, 0)) * dslope(s) / self.power, np.nan)


NAMES = {
    "randers": Randers,
    "matsumoto": Matsumoto,
    "convexified_matsumoto": ConvexMatsumoto,
    "matsumoto_convexified": ConvexMatsumoto,
    "tobler": Tobler,
    "convexified_tobler": ConvexTobler,
    "tobler_convexified": ConvexTobler,
    "minetti": Minetti,
    "minetti_cost": Minetti,
}


def get_metric(name: str, **parameters) -> Metric:
    key = name.strip().lower().replace("-", "_")
    if key not in NAMES:
        raise ValueError(f"unknown metric {name!r}; known are {', '.join(sorted(NAMES))}")
    return NAMES[key](**parameters)


def randers_dissimilarity(x: np.ndarray, alpha: float) -> np.ndarray:
    """All Randers lengths between rows of ``x``."""
    return Randers(alpha).pairwise(x)


def randers_length(a: np.ndarray, b: np.ndarray, alpha: float) -> float:
    """Randers length from ``a`` to ``b``."""
    return float(Randers(alpha).length(np.asarray(b, float) - np.asarray(a, float)))
