"""Models of area against level, as data: what the distributed fits need of each. A caller may add its own."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least distance above a base level, and the relative step of numeric slopes.
FLOOR, STEP = 1e-6, 1e-6


@dataclass(frozen=True)
class Extent:
    """What start values are told from: the ends of a lake's levels and areas."""

    h_min: float
    h_max: float
    a_min: float
    a_max: float

    @property
    def below(self) -> float:
        """A tenth of the range of levels below the least one; the range counts as 1 where it is 0."""
        return self.h_min - 0.1 * ((self.h_max - self.h_min) or 1.0)


@dataclass(frozen=True)
class Model:
    """The curve sum(c[j] * basis(h, t)[j]), of coefficients c, which are solved for, and shape parameters t, which are searched.

    start: the shape from a lake's extent. slopes: from h, t and the basis, for each shape parameter, the slope of each basis function; numeric ones if not given.
    order: which of (*c, *t) each reported parameter is. held: shape parameters that stay at their start, because the others can
    make up for any change; they count as parameters. turn: for curves in powers of h, the matrix that takes coefficients around a mean level
    to those around 0; such models are fitted around the mean, and not at all if their coefficients are not determined.
    """

    name: str
    basis: Callable[[Column, Sequence[Column]], list[Column]]
    n_basis: int
    start: Callable[[Extent], list[float]] = lambda e: []
    n_shape: int = 0
    slopes: Callable[[Column, Sequence[Column], Sequence[Column]], list[list[Column]]] | None = None
    order: tuple[int, ...] | None = None
    held: tuple[int, ...] = ()
    turn: Callable[[float], np.ndarray] | None = None

    @property
    def n_params(self) -> int:
        return self.n_basis + self.n_shape

    @property
    def places(self) -> tuple[int, ...]:
        return self.order or tuple(range(self.n_params))

    def slope_columns(self, h: Column, t: Sequence[Column], basis: Sequence[Column]) -> list[Column]:
        """The slopes of all basis functions by the first shape parameter, by the second, and so on."""
        return [s for by_one in self._slopes(h, t, basis) for s in by_one]

    def _slopes(self, h: Column, t: Sequence[Column], basis: Sequence[Column]) -> list[list[Column]]:
        if self.slopes or not self.n_shape:
            return self.slopes(h, t, basis) if self.slopes else []
        out = []
        for k in range(self.n_shape):
            step = STEP * F.greatest(F.abs(t[k]), F.lit(1e-3))
            up, down = ([*t[:k], t[k] + d, *t[k + 1 :]] for d in (step, -step))
            out.append([(a - b) / (2 * step) for a, b in zip(self.basis(h, up), self.basis(h, down), strict=True)])
        return out

    def curve(self, p: Column, h: Column) -> Column:
        """The area at a level; p: an array of the parameters as reported."""
        at = {place: k for k, place in enumerate(self.places)}
        c, t = [p[at[j]] for j in range(self.n_basis)], [p[at[self.n_basis + k]] for k in range(self.n_shape)]
        out = F.lit(0.0)
        for x, b in zip(c, self.basis(h, t), strict=True):
            out = out + x * b
        return out


def _above(h: Column, base: Column) -> Column:
    return F.greatest(h - base, F.lit(FLOOR))


def _there(h: Column, base: Column, slope: Column) -> Column:
    """A slope by a base level: 0 where levels are not above it."""
    return F.when(h - base > FLOOR, slope).otherwise(0.0)


#: In the order that breaks ties.
MODELS = (
    Model("linear", lambda h, t: [h, F.lit(1.0)], 2, turn=lambda m: np.array([[1, 0], [-m, 1]])),
    Model("quadratic", lambda h, t: [h * h, h, F.lit(1.0)], 3, turn=lambda m: np.array([[1, 0, 0], [-2 * m, 1, 0], [m * m, -m, 1]])),
    # c * max(h - t1, FLOOR) ^ t0
    Model(
        "power", lambda h, t: [F.pow(_above(h, t[1]), t[0])], 1, lambda e: [1.0, e.below], 2,
        lambda h, t, b: [[b[0] * F.ln(_above(h, t[1]))], [_there(h, t[1], -t[0] * b[0] / _above(h, t[1]))]],
    ),
    # c * exp(t0 * (h - t1)): c makes up for any t1
    Model("exponential", lambda h, t: [F.exp(t[0] * (h - t[1]))], 1, lambda e: [1.0, e.below], 2, lambda h, t, b: [[(h - t[1]) * b[0]], [-t[0] * b[0]]], held=(1,)),
    # c0 * ln(max(h - t0, FLOOR)) + c1
    Model("logarithmic", lambda h, t: [F.ln(_above(h, t[0])), F.lit(1.0)], 2, lambda e: [e.below], 1, lambda h, t, b: [[_there(h, t[0], -1.0 / _above(h, t[0])), F.lit(0.0)]], order=(0, 2, 1)),
)


def by_model(models: Sequence[Model], which: Column, of: Callable[[Model], Column]) -> Column:
    """of(model) for the model whose place in models is which."""
    out = F.lit(None)
    for i, model in reversed(list(enumerate(models))):
        out = F.when(which == i, of(model)).otherwise(out)
    return out
