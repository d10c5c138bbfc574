"""Settings of a scoring run and the ordered categories."""

from __future__ import annotations

from dataclasses import dataclass

#: The categories from low to high.
CATEGORIES = ("Differentiated", "Unipotent", "Oligopotent", "Multipotent", "Pluripotent", "Totipotent")
#: Upper edges of the categories on [0, 1].
EDGES = tuple((k + 1) / len(CATEGORIES) for k in range(len(CATEGORIES)))


@dataclass(frozen=True)
class Settings:
    """Keyword arguments of :func:`plurigrade.plans.potency.score`; wrong values raise ``ValueError``."""

    species: str = "mouse"
    batch_size: int = 10_000
    smooth_batch_size: int = 1_000
    seed: int = 14
    max_cores: int | None = None
    neighbours: int = 30
    top_features: int = 1_000
    components: int = 30
    least_for_smoothing: int = 100
    least_for_batches: int = 1_000

    def __post_init__(self) -> None:
        if self.species not in ("mouse", "human"):
            raise ValueError(f"species must be mouse or human, not {self.species!r}")
        if not 0 <= self.seed < 2**32:
            raise ValueError("seed must lie in [0, 2**32)")
        if self.max_cores is not None and self.max_cores < 1:
            raise ValueError("max_cores must be at least 1")
        if min(self.batch_size, self.smooth_batch_size, self.neighbours, self.top_features) < 1:
            raise ValueError("sizes must be at least 1")


def usable_cores(wanted: int | None, available: int) -> int:
    """At least one core, at most those there are."""
    return max(1, min(wanted or available, available))
