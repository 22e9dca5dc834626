"""Settings of the workflows as frozen records."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from episodica.functions.vectors import bool_mask
from episodica.operators.influence import Optimiser


@dataclass(frozen=True)
class Rates:
    """The learning-rate schedule."""

    warmup: int = 400
    peak: float = 2.5e-5
    decay: int = 10_000
    end: float = 2.5e-6


@dataclass(frozen=True)
class Data:
    """Roots (source first, target last), their mixture and the shape of actions. The defaults."""

    roots: tuple[str, ...] = ()
    weights: tuple[float, ...] = (0.5, 0.5)
    horizon: int = 15
    action_mask: tuple[bool, ...] = tuple(bool_mask(6, -1))
    mixture_rows: int = 100_000


@dataclass(frozen=True)
class Workflow:
    """All settings of a run. The defaults."""

    data: Data = field(default_factory=Data)
    rates: Rates = field(default_factory=Rates)
    optimiser: Optimiser = field(default_factory=Optimiser)
    seed: int = 42
    batch_size: int = 8
    low: float = 20
    high: float = 80

    def __post_init__(self):
        if self.data.roots and len(self.data.roots) != len(self.data.weights):
            raise ValueError("one weight for each root")
        if len(set(self.data.roots)) != len(self.data.roots):
            raise ValueError("a root is given twice")


def with_overrides(base: Workflow, **changes) -> Workflow:
    """A copy with the settings that are given and not None."""
    return replace(base, **{k: v for k, v in changes.items() if v is not None})


def iteration_folder(base: str, turn: int) -> str:
    return f"{base.rstrip('/')}/iter_{turn}"


def previous_index(base: str, turn: int) -> str | None:
    """Where the selection that iteration `turn` starts from is kept; the first starts from everything."""
    return f"{iteration_folder(base, turn - 1)}/include.json" if turn else None
