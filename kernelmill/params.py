"""Parameters of the generic string kernel."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class KernelParams:
    """sigma_p: width over positions; sigma_c: width over letters; n: longest gram compared; normalized: cosine form."""

    sigma_p: float
    sigma_c: float
    n: int
    normalized: bool = False

    def __post_init__(self):
        if self.n < 1 or self.sigma_p <= 0 or self.sigma_c <= 0:
            raise ValueError("n must be at least 1 and both widths positive")
