"""Thin-plate regression splines of one variable, cut to their leading eigenvectors."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ROWS_AT_ONCE = 1024


@dataclass
class ThinPlateBasis:
    """The k - 2 roughest-penalised shapes of the full spline through ``centres``, a constant and a line.

    The full spline has a radial function |x - c|^3 / 12 at each centre, with
    coefficients d of no sum and no first moment; its integrated squared second
    derivative is d'Ed, E the radial functions at the centres.  Only the span
    of the k eigenvectors of E of largest absolute value is kept.  With k equal
    to the number of centres this is the natural cubic spline through them.
    """

    centres: np.ndarray
    k: int
    middle: float = field(init=False)
    scale: float = field(init=False)
    shapes: np.ndarray = field(init=False)
    penalty: np.ndarray = field(init=False)
    null: np.ndarray | None = None

    def __post_init__(self) -> None:
        if not 3 <= self.k <= len(self.centres):
            raise ValueError(f"a thin-plate basis of {self.k} needs 3 to as many distinct centres, not {len(self.centres)}")
        self.middle = float(self.centres.mean())
        self.scale = float(np.ptp(self.centres))
        at = (self.centres - self.middle) / self.scale
        value, vector = np.linalg.eigh(self._radial(at, at))
        lead = np.argsort(-np.abs(value), kind="stable")[: self.k]
        value, vector = value[lead], vector[:, lead]
        # the sign of an eigenvector is arbitrary; its largest entry is made positive
        vector = vector * np.sign(vector[np.argmax(np.abs(vector), axis=0), np.arange(self.k)])
        moments = vector.T @ np.stack([np.ones(len(at)), at], axis=1)
        free = np.linalg.qr(moments, mode="complete")[0][:, 2:]
        self.shapes = vector @ free
        self.penalty = np.zeros((self.k, self.k))
        rough = free.T @ (value[:, None] * free)
        # second derivatives by x, not by the scaled variable
        self.penalty[: self.k - 2, : self.k - 2] = (rough + rough.T) / 2 / self.scale**3

    @staticmethod
    def _radial(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.abs(x[:, None] - centres[None, :]) ** 3 / 12

    def raw(self, x: np.ndarray) -> np.ndarray:
        u, at = (x - self.middle) / self.scale, (self.centres - self.middle) / self.scale
        out = np.empty((len(u), self.k))
        for start in range(0, len(u), ROWS_AT_ONCE):
            part = u[start : start + ROWS_AT_ONCE]
            out[start : start + ROWS_AT_ONCE, : self.k - 2] = self._radial(part, at) @ self.shapes
        out[:, self.k - 2] = 1.0
        out[:, self.k - 1] = u
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) @ self.null

    def absorb(self, column_sums: np.ndarray) -> None:
        """Keep only shapes whose sum over the data is zero."""
        q, _ = np.linalg.qr(column_sums.reshape(-1, 1), mode="complete")
        self.null = q[:, 1:]
