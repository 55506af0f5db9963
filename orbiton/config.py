"""Policies of a computation."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

import numpy as np

from .errors import InvalidConfiguration

EPS32 = float(np.finfo(np.float32).eps)
#: Default weld radius: a chord of sqrt(2 * 64) * eps32.
WELD_RADIUS = float(np.float32(math.sqrt(128.0) * EPS32))
#: Weld pairs that a computation accepts.
MOST_WELD_PAIRS = 1 << 20
#: Vertices of degenerate configurations are one within this distance.
RECONCILE = 1e-6
#: Endpoints' dot product at or below -1 + NEAR_PI: an edge of almost pi.
NEAR_PI = 1e-5
#: On-sphere tolerance of a squared norm.
ON_SPHERE = 1e-4


class PreprocessMode(Enum):
    DISABLED = "disabled"
    WELD = "weld"
    MERGE_WITHIN = "merge_within"


class DegenerateMode(Enum):
    STRICT = "strict"
    PERTURB_COPLANAR = "perturb_coplanar"


class LocalRebuildMode(Enum):
    DISABLED = "disabled"
    HULL3D = "hull3d"


class CellKillingPolicy(Enum):
    PRESERVE = "preserve"
    ERROR = "error"


@dataclass(frozen=True)
class VoronoiConfig:
    preprocess: PreprocessMode = PreprocessMode.WELD
    merge_within: float | None = None
    degenerate: DegenerateMode = DegenerateMode.PERTURB_COPLANAR
    local_rebuild: LocalRebuildMode = LocalRebuildMode.HULL3D
    cell_killing: CellKillingPolicy = CellKillingPolicy.PRESERVE
    #: Run the strict gate on every result.
    verify: bool = False

    def weld_radius(self) -> float | None:
        """The chord below which sites are one, as a 32-bit value; None: no welding."""
        if self.preprocess is PreprocessMode.DISABLED:
            return None
        if self.preprocess is PreprocessMode.WELD:
            return WELD_RADIUS
        t = self.merge_within
        if t is None or not math.isfinite(t) or t <= 0 or float(np.float32(t) * np.float32(t)) == 0.0:
            raise InvalidConfiguration(f"merge threshold {t} must be finite, positive and have a 32-bit square")
        return float(np.float32(t))


def check_simplification_threshold(t: float) -> float:
    """A chord threshold for simplification: finite, above 0, at most 2."""
    if not math.isfinite(t) or t <= 0 or t > 2:
        raise InvalidConfiguration(f"simplification threshold {t} must be in (0, 2]")
    return float(t)
